"""Near-duplicate texts by banded minhash signatures (problem 4).

Words are lower-case runs of letters, digits and underscores after tags are taken out and entities
decoded; two texts of one field are alike if at least ``similarity`` of the distinct word triples
that either has are in both. Texts of fewer than ``min_words`` words, nulls and empty texts are in
no pair. Equal word sequences are one class: they are collapsed before the search and expanded
afterwards. Repeated ids stay what they are: rows with one id never pair with themselves. Extra
columns are ignored.

Method: an LSH forest. Each class has a signature of ``TREES * LEVELS`` minima; each of the ``TREES``
trees is a sorted order of all classes by the ``DEPTH`` minima that the tree reads one after
another, so a longer common prefix in the order is a deeper common node of the tree. The candidates
of a class are its ``REACH`` nearest neighbours on either side that have a common prefix with it at all: where a
region is dense they share deep nodes, where it is sparse one level is enough. Orders are
range-partitioned; what stands near a border is looked at again with the other side. Candidates whose
4-bit sketches disagree are dropped, the others are checked exactly on their sets of triples, by
components of the candidates: a component's triples meet once, in blocks of at most about ``BLOCK`` classes
(only the blocks that have a candidate pair in common meet). Two things come on top, both exact:

* A node of ``CROWDED`` levels with more classes than ``REACH`` lets meet is crowded. All its pairs are
  checked that no earlier step has joined.
* ``closure``: the components of the links are completed. All pairs of a component are checked, so
  no new link can appear. (Components that are complete already are left alone.)

Scale: signatures are made where the texts are read; what is shuffled is 40 bytes for each class and
tree, and the triples of the classes, twice. Tasks are sized by bytes, a tree's hot node is spread over
as many as it needs. Nothing is sent to the driver or broadcast but counts. Python works on Arrow
batches with numpy; the groups of a sorted partition are streamed.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from fernglass.session import written

TREES, LEVELS, REACH = 16, 3, 24
#: Levels of a tree's order, and the bits that are kept of each; levels past the tree's own are those of the next trees.
DEPTH, BITS = 5, (26, 26, 22, 21, 21)
CROWDED = 3
SKETCH = 32  # minima of which 4 bits are kept
#: Of 32; a pair alike by 0.5 has 17 in the mean, an unrelated one 3. The second holds under a node of fewer than CROWDED levels.
SKETCH_LEAST, SKETCH_SHALLOW = 10, 13
#: Classes, and bytes of their triples, in a block of those that are paired in full.
BLOCK, BLOCK_BYTES = 1000, 16_000_000
#: Bytes that a task is to get.
TASK_BYTES = 6_000_000
#: Equal texts of one class that meet all others of it in one place.
MEMBERS = 2000

_TAG = re.compile(r"<[^<>]*>")
_WORD = re.compile(r"\w+")
_rng = np.random.default_rng(20240229)
_MULT = (_rng.integers(0, 2**31, TREES * LEVELS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_XOR = _rng.integers(0, 2**32, TREES * LEVELS, dtype=np.uint64).astype(np.uint32)


def words(text: str) -> list[str]:
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return _WORD.findall(text.lower())


class _Hasher:
    """Hashes of words, remembered by the worker."""

    known: dict[str, int] = {}

    @classmethod
    def of(cls, ws: list[str]) -> np.ndarray:
        known = cls.known
        if len(known) > 500_000:
            known.clear()
        for w in set(ws).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))


def _triples(ws: list[str]) -> np.ndarray:
    """32-bit hashes of the word triples, repeats and all."""
    h = _Hasher.of(ws)
    x = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + (h[1:-1] ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def _class_of(field: str, ws: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(ws), xxhash.xxh32_intdigest(field)) - 2**63


def _each(batches: Iterator[pa.RecordBatch], fields: list[str], min_words: int):
    """(field number, id, class, words) of every text that is long enough."""
    for b in batches:
        ids = b.column(0).to_pylist()
        for k, f in enumerate(fields):
            for i, t in zip(ids, b.column(k + 1).to_pylist(), strict=True):
                if t and len(t) >= min_words:
                    ws = words(t)
                    if len(ws) >= max(min_words, 3):
                        yield k, i, _class_of(f, ws), ws


def _signed(fields: list[str], min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            sets = [_triples(r[3]) for r in rows if r[3]]
            sigs = iter(())
            if sets:
                flat = np.concatenate(sets)
                starts = np.cumsum([0, *map(len, sets)])[:-1]
                sig = np.empty((len(sets), len(_MULT)), np.uint32)
                for p in range(len(_MULT)):
                    sig[:, p] = np.minimum.reduceat((flat ^ _XOR[p]) * _MULT[p], starts)
                sigs = iter(sig)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([next(sigs).tobytes() if r[3] else None for r in rows], pa.binary()), pa.array([r[4] for r in rows], pa.int32())], ["field", "id", "cls", "sig", "n_words"])

        size = 0
        for k, i, c, ws in _each(batches, fields, min_words):
            new = c not in done
            done.add(c)
            rows.append((k, i, c, ws if new else None, len(ws)))
            size += len(ws) if new else 1
            if size > 1_000_000:
                yield out()
                rows, size = [], 0
                if len(done) > 200_000:
                    done = set()
        if rows:
            yield out()

    return run


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each class and tree: its place in the tree's order (12 bits of tree and field, then the levels), and its sketch."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        field = b.column(0).to_numpy().astype(np.uint64)
        cls = b.column(1).to_numpy()
        sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(n, -1).astype(np.uint64)
        nib = (sig[:, :SKETCH] >> np.uint64(13)) & np.uint64(15)
        sk = [np.bitwise_or.reduce(nib[:, j : j + 16] << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1) for j in (0, 16)]
        # minima are small numbers: multiplied, their upper bits tell them apart
        level = (sig * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) ^ (sig >> np.uint64(7))
        field = (field * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
        for t in range(TREES):
            keys = [(field + np.uint64(t * 257)) & np.uint64(0xFFF), np.zeros(n, np.uint64)]
            for d, bits in enumerate(BITS):
                x = (level[:, (t * LEVELS + d) % sig.shape[1]] >> np.uint64(32 - bits)) & np.uint64((1 << bits) - 1)
                k = 0 if d < 2 else 1
                keys[k] = (keys[k] << np.uint64(bits)) | x
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (*keys, cls, *sk)], PLACED.split())


PLACED = "k1 k2 cls s1 s2"


def _common_levels(k1: np.ndarray, k2: np.ndarray, q1: np.ndarray, q2: np.ndarray) -> np.ndarray:
    """How many levels the places (k1, k2) and (q1, q2) have in common."""
    x, y = (k1 ^ q1).view(np.uint64), (k2 ^ q2).view(np.uint64)
    out = (x >> np.uint64(BITS[1]) == 0).astype(np.int8)
    out += x == 0
    for low in (BITS[3] + BITS[4], BITS[4], 0):
        out += (x == 0) & (y >> np.uint64(low) == 0)
    return out


def _agree(a1: np.ndarray, a2: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """How many of the 4-bit minima are equal."""
    total = np.zeros(len(a1), np.int64)
    low = np.uint64(0x1111111111111111)
    for x in (a1 ^ b1, a2 ^ b2):
        x = x.view(np.uint64)
        x = x | (x >> np.uint64(1)) | (x >> np.uint64(2)) | (x >> np.uint64(3))
        total += 16 - np.bitwise_count(x & low).astype(np.int64)
    return total


def _neighbours(bordered: bool):
    """Of a sorted partition: pairs of classes that stand at most REACH apart and have a level in common; (a, bucket) of the
    classes of crowded nodes; and the rows near its borders, which ``bordered`` partitions consist of (they have none)."""
    far = REACH + 1
    names = ["a", "b", "bucket", "border", *PLACED.split()]

    def rows(n: int, **cols: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(cols[c]), pa.int64()) if c in cols else pa.nulls(n, pa.int64()) for c in names], names)

    def edge(border: int, cols: list[np.ndarray]) -> pa.RecordBatch:
        return rows(len(cols[0]), border=np.full(len(cols[0]), border), **dict(zip(PLACED.split(), cols, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] | None = None
        opened = 0  # rows sent to the border before
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy() for i in range(5)]
            fresh = 0
            if held is not None:
                fresh = len(held[0])
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            k1, k2, c = cols[:3]
            keep = np.ones(len(c), bool)  # a class that was signed in several tasks counts once
            keep[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (c[1:] != c[:-1])
            keep[:fresh] = True
            cols = [x[keep] for x in cols]
            k1, k2, c, s1, s2 = cols
            if not bordered and opened < far:
                new = [x[fresh:][: far - opened] for x in cols]
                opened += len(new[0])
                yield edge(part, new)
            left, right = [], []
            for w in range(1, min(REACH, len(c) - 1) + 1):
                common = _common_levels(k1[w:], k2[w:], k1[:-w], k2[:-w])
                at = np.flatnonzero(common > 0) + w
                at = at[at >= fresh]
                if not len(at):
                    break
                ok = _agree(s1[at], s2[at], s1[at - w], s2[at - w]) >= np.where(common[at - w] >= CROWDED, SKETCH_LEAST, SKETCH_SHALLOW)
                left.append(c[at[ok] - w])
                right.append(c[at[ok]])
            if left:
                x, y = np.concatenate(left), np.concatenate(right)
                ok = x != y
                yield rows(int(ok.sum()), a=np.minimum(x, y)[ok], b=np.maximum(x, y)[ok])
            at = np.flatnonzero(_common_levels(k1[far:], k2[far:], k1[:-far], k2[:-far]) >= CROWDED) + far
            at = at[at >= fresh]
            if len(at):
                cover = np.zeros(len(c) + 1, np.int64)
                np.add.at(cover, at - far, 1)
                np.add.at(cover, at + 1, -1)
                crowd = np.cumsum(cover[:-1]) > 0
                node = (k1.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (k2.view(np.uint64) >> np.uint64(BITS[3] + BITS[4]))
                yield rows(int(crowd.sum()), a=c[crowd], bucket=node[crowd].view(np.int64))
            held = [x[-far:] for x in cols]
        if held is not None and not bordered:
            yield edge(part + 1, held)

    return run


def _sets(fields: list[str], min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        cls, sets = [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(sets, pa.binary())], ["cls", "tri"])

        for _, _, c, ws in _each(batches, fields, min_words):
            if c not in seen:
                seen.add(c)
                cls.append(c)
                sets.append(np.unique(_triples(ws)).tobytes())
                if len(cls) >= 2000:
                    yield out()
                    cls, sets = [], []
                    if len(seen) > 200_000:
                        seen = set()
        if cls:
            yield out()

    return run


def _common(x: list[np.ndarray], y: list[np.ndarray] | None) -> np.ndarray:
    """How many triples each set of ``x`` has in common with each of ``y`` (None: of ``x``)."""
    sets = x if y is None else x + y
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, tok = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.bincount(tok[row < len(x)], minlength=int(tok.max()) + 1)
    last = first - 1 if y is None else np.bincount(tok[row >= len(x)], minlength=len(first))
    shared = (first > 0) & (last > 0)
    col = np.cumsum(shared) - 1
    ok = shared[tok]
    row, tok = row[ok], col[tok[ok]]
    order = np.argsort(tok, kind="stable")
    row, tok = row[order], tok[order]
    total = np.zeros((len(x), len(sets) - len(x) if y is not None else len(x)), np.float32)  # exact up to 2**24
    wide = min(int(shared.sum()), 4096)
    for lo in range(0, int(shared.sum()), max(wide, 1)):
        a, z = np.searchsorted(tok, [lo, lo + wide])
        has = np.zeros((len(sets), wide), np.float32)
        has[row[a:z], tok[a:z] - lo] = 1
        total += has[: len(x)] @ (has if y is None else has[len(x) :]).T
    return total


def _labels(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The component of each of m nodes under the links (i, j)."""
    label = np.arange(m)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _checked(least: float, closure: bool):
    """Of each block of candidates: the alike pairs (and, where the block is a whole component of candidates, all alike pairs
    of each component of links); and the triples that are asked for again. The rows are sorted: first the block's own
    classes, then each guest from another block before its pairs, so that only the block is held."""

    def common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if len(sets) > 8 and len(i) > 0.05 * len(sets) ** 2:
            return _common(sets, None)[i, j].astype(np.float64)
        return np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(i.tolist(), j.tolist(), strict=True)], np.float64)

    def alike(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(x) for x in sets])
        n = common(sets, i, j)
        sim = n / (size[i] + size[j] - n)
        ok = sim >= least
        return i[ok], j[ok], sim[ok]

    def links(by_class: dict[int, np.ndarray], pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = {c: k for k, c in enumerate(by_class)}
        sets, ids = list(by_class.values()), np.fromiter(by_class, np.int64, len(by_class))
        i, j, sim = alike(sets, np.array([at[a] for a, _ in pairs], np.int64), np.array([at[b] for _, b in pairs], np.int64))
        if closure and len(i) > 1:
            label = _labels(len(sets), i, j)
            own, n = np.unique(label, return_counts=True)
            have = np.bincount(label[i], minlength=len(sets))[own]
            part = own[have < n * (n - 1) // 2]
            rest = ~np.isin(label[i], part)
            found = [(i[rest], j[rest], sim[rest])]
            for c in part.tolist():
                own = np.flatnonzero(label == c)
                p, q = np.triu_indices(len(own), 1)
                x, y, s = alike([sets[k] for k in own], p, q)
                found.append((own[x], own[y], s))
            i, j, sim = (np.concatenate([f[k] for f in found]) for k in range(3))
        return ids[i], ids[j], sim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        sets: dict[int, np.ndarray] = {}
        guest: tuple[int, np.ndarray] | None = None
        pairs: list[tuple[int, int]] = []
        kept: list[tuple[int, bytes]] = []
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal size
            x, y, sim = (np.concatenate([f[k] for f in found]) if found else np.empty(0) for k in range(3))
            x, y = x.astype(np.int64), y.astype(np.int64)
            n = len(kept)
            arrays = [
                pa.array(np.concatenate([np.minimum(x, y), np.array([c for c, _ in kept], np.int64)])),
                pa.concat_arrays([pa.array(np.maximum(x, y)), pa.nulls(n, pa.int64())]),
                pa.concat_arrays([pa.array(sim, pa.float64()), pa.nulls(n, pa.float64())]),
                pa.concat_arrays([pa.nulls(len(x), pa.binary()), pa.array([t for _, t in kept], pa.binary())]),
            ]
            found.clear()
            kept.clear()
            size = 0
            return pa.RecordBatch.from_arrays(arrays, ["a", "b", "similarity", "tri"])

        def end() -> None:
            nonlocal size
            if pairs:
                found.append(links(sets, pairs))
                size += len(found[-1][0]) + 1
            sets.clear()
            pairs.clear()

        for batch in batches:
            for comp, j, whole, visit, a, b, keep, tri in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block is None or block[:2] != (comp, j):
                    end()
                    block, guest = (comp, j, whole), None
                if tri is not None and visit:
                    guest = (a, np.frombuffer(tri, np.uint32))
                elif tri is not None:
                    if a not in sets:
                        sets[a] = np.frombuffer(tri, np.uint32)
                        if keep:
                            kept.append((a, tri))
                            size += 100
                elif whole:
                    pairs.append((a, b))
                else:
                    x, y = guest[1] if guest is not None and guest[0] == a else sets[a], sets[b]
                    n = len(np.intersect1d(x, y, assume_unique=True))
                    if n >= least * (len(x) + len(y) - n):
                        found.append((np.array([a]), np.array([b]), np.array([n / (len(x) + len(y) - n)])))
                        size += 1
                if size > 200_000:
                    yield out()
        end()
        if size:
            yield out()

    return run


def _crossed(least: float):
    """Alike pairs of each pair of blocks, the rows sorted by it: those of different groups that have no earlier bucket in common."""

    def pairs(rows: list[tuple]) -> pa.RecordBatch | None:
        sides = [[r for r in rows if r[3] == k] for k in (rows[0][1], rows[0][2])]
        same = rows[0][1] == rows[0][2]
        if not all(sides):
            return None
        x, y = sides
        ask = np.ones((len(x), len(y)), bool)
        if same:
            ask &= np.tri(len(x), k=-1, dtype=bool).T
        if rows[0][5] is not None:
            ask &= np.array([r[5] for r in x])[:, None] != np.array([r[5] for r in y])
            holders: list[dict[int, list[int]]] = [{}, {}]
            for z, held in zip(sides, holders, strict=True):
                for i, r in enumerate(z):
                    for k in r[6]:
                        if k < rows[0][0]:
                            held.setdefault(k, []).append(i)
            for k in holders[0].keys() & holders[1].keys():
                ask[np.ix_(holders[0][k], holders[1][k])] = False
        if not ask.any():
            return None
        x, y = [[(r[4], np.frombuffer(r[7], np.uint32)) for r in z] for z in (x, y)]
        i, j = np.nonzero(ask)
        if len(i) > 0.02 * ask.size:
            both = _common([s for _, s in x], None if same else [s for _, s in y])[i, j]
        else:
            both = np.array([len(np.intersect1d(x[p][1], y[q][1], assume_unique=True)) for p, q in zip(i, j, strict=True)])
        sim = both.astype(np.float64)
        sim /= np.array([len(s) for _, s in x])[i] + np.array([len(s) for _, s in y])[j] - sim
        ok = sim >= least
        a, b = np.array([c for c, _ in x])[i[ok]], np.array([c for c, _ in y])[j[ok]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sim[ok])], ["a", "b", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[0][:3] != r[:3]:
                    if (out := pairs(rows)) is not None:
                        yield out
                    rows = []
                rows.append(r)
        if rows and (out := pairs(rows)) is not None:
            yield out

    return run


def signatures(sources: list[tuple[DataFrame, str, list[str]]], min_words: int = 30) -> DataFrame:
    """(field, id, cls, sig, n_words) of every text that is long enough. ``sources``: a DataFrame, its id column, its text columns."""
    out = None
    for df, key, fields in sources:
        names = F.create_map(*[F.lit(x) for i, f in enumerate(fields) for x in (i, f)])
        one = df.select(F.col(key).cast("long").alias("id"), *fields).mapInArrow(_signed(fields, min_words), "field int, id long, cls long, sig binary, n_words int")
        one = one.withColumn("field", names[F.col("field")])
        out = one if out is None else out.unionByName(one)
    return out


def _tasks(n_bytes: int | None) -> int:
    return max(1, -(-(n_bytes or 0) // TASK_BYTES))


def candidates(signed: DataFrame) -> DataFrame:
    """(a, b, bucket): candidate pairs of classes, a < b, without a bucket; and the classes (a) of crowded nodes, without b."""
    own = signed.where("sig is not null").select(F.crc32(F.col("field").cast("binary")).alias("field"), "cls", "sig")
    n = _tasks(own.count() * TREES * 40)
    shape = ", ".join(f"{c} long" for c in ["a", "b", "bucket", "border", *PLACED.split()])
    # with the class in the range, a node with a third of all classes is spread over many tasks
    ordered = own.mapInArrow(_planted, ", ".join(f"{c} long" for c in PLACED.split())).repartitionByRange(n, "k1", "k2", "cls").sortWithinPartitions("k1", "k2", "cls")
    first = written(ordered.mapInArrow(_neighbours(False), shape))
    borders = first.where("border is not null").select("border", *PLACED.split()).repartition("border").sortWithinPartitions("border", "k1", "k2", "cls").drop("border")
    again = borders.mapInArrow(_neighbours(True), shape)
    return first.where("border is null").unionByName(again).select("a", "b", "bucket").distinct()


def triples_of(sources: list[tuple[DataFrame, str, list[str]]], min_words: int = 30) -> DataFrame:
    """(cls, tri) of every text that is long enough; a class comes once a task."""
    out = None
    for df, key, fields in sources:
        one = df.select(F.col(key).cast("long").alias("id"), *fields).mapInArrow(_sets(fields, min_words), "cls long, tri binary")
        out = one if out is None else out.unionByName(one)
    return out


def components(links: DataFrame) -> DataFrame:
    """(cls, comp): the classes of ``links`` (a, b) and the least class that they lead to, by alternating large and small stars."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first()
        if now == state:
            return edges.select(F.col("a").alias("cls"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("cls"), F.col("b").alias("comp")).distinct())
        state = now
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = ways.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = written(small.distinct())


def crossed(members: DataFrame, tri: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similarity): all alike pairs within each bucket. ``members``: bucket, cls, grp, buckets; with grp, only pairs of different ones, in the first of their common buckets. ``tri``: cls, tri, n_words."""
    words = tri.select("cls", "n_words")
    sizes = written(members.select("bucket", "cls").join(words, "cls").groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.col("n_words") * 4) / BLOCK_BYTES)).cast("int").alias("n"), F.sum(F.col("n_words") * 4).alias("bytes")))
    n = _tasks(sizes.agg(F.sum(F.col("bytes") * F.col("n"))).first()[0])
    small = members.join(sizes.select("bucket", "n"), "bucket").withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = small.join(tri.select("cls", "tri"), "cls").select("bucket", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "cls", "grp", "buckets", "tri")
    return met.repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_crossed(similarity), "a long, b long, similarity double")


def checked(sources: list[tuple[DataFrame, str, list[str]]], signed: DataFrame, pairs: DataFrame, crowds: DataFrame, similarity: float, min_words: int, closure: bool) -> DataFrame:
    """(a, b, similarity, tri): the alike ones of the candidate ``pairs``, completed within the components of links where a
    component of candidates is one block; without b, the triples of the classes of all other components, and of ``crowds``."""
    comps = written(components(pairs))
    lone = crowds.select("cls").distinct().join(comps, "cls", "left_anti").select("cls", F.col("cls").alias("comp"))
    comps = comps.unionByName(lone)
    words = signed.where("sig is not null").groupBy("cls").agg(F.max("n_words").alias("n_words"))
    again = comps.join(crowds.select("cls").distinct(), "cls", "left_semi").select("comp", F.lit(True).alias("again")).distinct()
    comps = comps.join(words, "cls")
    sizes = comps.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.col("n_words") * 4) / BLOCK_BYTES)).cast("int").alias("n"))
    sizes = sizes.join(again, "comp", "left").withColumn("again", F.coalesce("again", F.lit(False)) | (F.col("n") > 1))
    homes = written(comps.join(sizes, "comp").withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("n")).cast("int")))
    a, b = (homes.select(F.col("cls").alias(c), "comp", "n", F.col("blk").alias(f"of_{c}")) for c in ("a", "b"))
    asked = written(pairs.join(a, "a").join(b.drop("comp", "n"), "b").select("comp", F.col("of_b").alias("j"), (F.col("n") == 1).alias("whole"), F.lit(True).alias("visit"), "a", "b", (F.col("of_a") != F.col("of_b")).alias("far")))
    block = ["comp", "j", "whole", "visit"]
    # each class's triples stand in its own block once, and visit the blocks of its partners
    home = homes.select("comp", F.col("blk").alias("j"), (F.col("n") == 1).alias("whole"), F.lit(False).alias("visit"), "cls", F.col("again").alias("keep"))
    guests = asked.where("far").select(*block, F.col("a").alias("cls"), F.lit(False).alias("keep")).distinct()
    triples = home.unionByName(guests).join(triples_of(sources, min_words), "cls").select(*block, F.col("cls").alias("a"), F.lit(None).cast("long").alias("b"), "keep", "tri")
    rows = triples.unionByName(asked.select(*block, "a", "b", F.lit(False).alias("keep"), F.lit(None).cast("binary").alias("tri")))
    n = _tasks(homes.agg(F.sum(F.col("n_words") * 4)).first()[0])
    ordered = rows.repartition(n, "comp", "j").sortWithinPartitions("comp", "j", "visit", "a", F.col("tri").isNull())
    return written(ordered.mapInArrow(_checked(similarity, closure), "a long, b long, similarity double, tri binary"))


def similar_classes(sources: list[tuple[DataFrame, str, list[str]]], signed: DataFrame, similarity: float, min_words: int = 30, closure: bool = True) -> DataFrame:
    """(a, b, similarity): pairs of different classes that are alike."""
    found = written(candidates(signed))
    pairs = found.where("b is not null").select("a", "b")
    crowds = found.where("b is null").select("bucket", F.col("a").alias("cls"))
    first = checked(sources, signed, pairs, crowds, similarity, min_words, closure)
    alike = first.where("b is not null").select("a", "b", "similarity")
    tri = first.where("b is null").select(F.col("a").alias("cls"), "tri", F.expr("length(tri) div 4").alias("n_words"))
    if tri.isEmpty():
        return alike
    # what is left: components of several blocks, and those with a class of a crowded node
    far = alike.join(tri.select(F.col("cls").alias("a")), "a", "left_semi").select("a", "b", "similarity")
    near = alike.join(tri.select(F.col("cls").alias("a")), "a", "left_anti").select("a", "b", "similarity")
    comps = written(components(far))

    def part(far: DataFrame, comps: DataFrame) -> DataFrame:
        """The members of the components that lack a pair."""
        have = far.join(comps, far["a"] == comps["cls"]).groupBy("comp").agg(F.count("*").alias("links"))
        lack = comps.groupBy("comp").agg(F.count("*").alias("n")).join(have, "comp").where("links < n * (n - 1) / 2").select("comp")
        return comps.join(lack, "comp").select(F.col("comp").alias("bucket"), "cls", F.lit(None).cast("long").alias("grp"), F.lit(None).cast("array<long>").alias("buckets"))

    # crowded nodes whose classes are not one component yet, together with the components that lack a pair
    crowds = crowds.join(comps, "cls", "left").select("bucket", "cls", F.coalesce("comp", "cls").alias("grp"))
    mixed = crowds.groupBy("bucket").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("bucket")
    crowds = crowds.join(mixed, "bucket")
    every = crowds.groupBy("cls").agg(F.collect_set("bucket").alias("buckets"))  # TREES at most
    members = crowds.join(every, "cls").select("bucket", "cls", "grp", "buckets")
    members = written(members.unionByName(part(far, comps)) if closure else members)
    if members.isEmpty():
        return near.unionByName(far)
    more = written(crossed(members, tri, similarity))
    new = more.join(far.select("a", "b"), ["a", "b"], "left_anti")
    far = written(far.unionByName(new))
    of_a, of_b = (comps.select(F.col("cls").alias(c), F.col("comp").alias(f"of_{c}")) for c in ("a", "b"))
    joins = new.join(of_a, "a", "left").join(of_b, "b", "left").where(~F.coalesce(F.col("of_a") == F.col("of_b"), F.lit(False)))
    if not closure or joins.isEmpty():
        return near.unionByName(far)
    # crowded nodes joined components: these are completed once more
    members = written(part(far, written(components(far))))
    if members.isEmpty():
        return near.unionByName(far)
    new = crossed(members, tri, similarity).join(far.select("a", "b"), ["a", "b"], "left_anti")
    return near.unionByName(far).unionByName(new)


def similar_pairs(sources: list[tuple[DataFrame, str, list[str]]], similarity: float = 0.8, min_words: int = 30, closure: bool = True) -> DataFrame:
    """(field, id_a, id_b, similarity), id_a < id_b: every pair of records whose texts are equal or alike."""
    signed = written(signatures(sources, min_words))
    members = signed.select("field", "id", "cls")
    classes = similar_classes(sources, signed, similarity, min_words, closure)
    left, right = members.select("field", F.col("id").alias("p"), F.col("cls").alias("a")), members.select(F.col("id").alias("q"), F.col("cls").alias("b"))
    across = classes.join(left, "a").join(right, "b").select("field", "p", "q", "similarity")
    # a class with a third of all rows: its members are parted, and each part meets all members
    parts = members.groupBy("cls").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")).where("parts > 1 or parts is null")
    dealt = left.join(parts.withColumnRenamed("cls", "a"), "a", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = dealt.withColumn("part", F.pmod(F.xxhash64("p"), F.col("parts")).cast("int")).drop("parts")
    all_ = dealt.select(F.col("p").alias("q"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    equal = mine.join(all_, ["a", "part"]).where("p < q").select("field", "p", "q", F.lit(1.0).alias("similarity"))
    both = across.unionByName(equal).where("p <> q")
    return both.select("field", F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"), "similarity")


def groups(sources: list[tuple[DataFrame, str, list[str]]], similarity: float = 0.8, min_words: int = 30) -> DataFrame:
    """(field, id, class_id, group_id, n_links): every text that is long enough, its class of equal texts, the group of classes
    that links lead to (its least class), and to how many other classes that one is alike."""
    signed = written(signatures(sources, min_words))
    alike = written(similar_classes(sources, signed, similarity, min_words).select("a", "b"))
    links = alike.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    rows = signed.select("field", "id", "cls").join(links.join(components(alike), "cls"), "cls", "left")
    return rows.select("field", "id", F.col("cls").alias("class_id"), F.coalesce("comp", "cls").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
