"""The language of each text, and of each stretch of a mixed text, with a confidence (problem 3).

Method: nearest centroid. A text is the TF-IDF vector of its words' character n-grams (1 to 4, with
the word's ends marked), hashed and normalised. Each language has several centroids, clustered from
its labelled samples by spherical k-means; a text takes the language of the centroid with the
largest cosine, unless that is below ``REJECT`` (then it has none). The confidence is the margin over
the best other language, relative to the best. A word's share in all cosines is worked out once and
remembered by the worker, so a text costs one lookup a word.

A text's lines are its paragraphs. Those that do not count are left out: what the caller's
``own_lines`` leaves out (boilerplate), headings, lists of names and figures, lines of fewer than
``MIN_WORDS`` words, and rejected lines. Runs of lines in one language are segments, numbered from 0.
Null, empty and blank texts, and texts with nothing that counts, have no segments. Repeated rows come
out repeatedly; extra columns are ignored; a very long text is one list of lines in one worker.

The samples are the one bounded input: at most ``MAX_SAMPLES`` of them are used, by id.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fernglass.llm.words import Words, pieces

DIM = 1 << 15
CENTROIDS = 3
MAX_SAMPLES = 20_000
MIN_WORDS = 4
REJECT = 0.1

# Names and codes of the languages, as labels give them.
LABELS = {
    "en": "en eng english englisch anglais inglés inglês engels",
    "de": "de deu ger german deutsch allemand alemán alemão duits",
    "fr": "fr fra fre french français francais französisch francés francês frans",
    "es": "es spa spanish español espanol castellano spanisch espagnol espanhol spaans",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués portugees",
    "nl": "nl nld dut dutch nederlands niederländisch néerlandais neerlandés holandês flemish",
}

_WORDS = re.compile(r"[^\W\d_]+")
_LINK = re.compile(r"\]\([^)\s]*\)")
_ITEM = re.compile(r"\s*[-*•]\s")


def label_language(label: Column) -> Column:
    """The two-letter code that a stored label names, whatever its region, case or spelling; null if it names none."""
    known = F.create_map(*[F.lit(x) for code, names in LABELS.items() for n in names.split() for x in (n, code)])
    return F.try_element_at(known, F.regexp_extract(F.lower(F.trim(label)), r"^(\p{L}+)(?:[-_ ].*)?$", 1))


def grams(word: str) -> list[int]:
    w = f"\x02{word}\x03"
    if w.isascii():
        b, crc = w.encode(), zlib.crc32
        return [crc(b[i : i + n]) & (DIM - 1) for n in (1, 2, 3, 4) for i in range(len(b) - n + 1)]
    return [zlib.crc32(w[i : i + n].encode()) & (DIM - 1) for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)]


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def all_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ``grams`` of every word, end to end, and how many each has: all n-grams of one n grow by a character at once."""
    data = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode(), np.uint8)
    begin = np.flatnonzero((data & 0xC0) != 0x80)  # of each character
    width = np.diff(begin, append=len(data))
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    of = np.repeat(np.arange(len(words)), lens)
    place = np.arange(len(of)) - (np.cumsum(lens) - lens)[of]
    sizes = np.maximum(lens[:, None] - np.arange(4), 0)  # n-grams of 1 to 4 characters
    many = sizes.sum(1)
    at = np.cumsum(many) - many
    out = np.empty(int(many.sum()), np.int64)
    crc = np.full(len(of), 0xFFFFFFFF, np.uint32)
    for n in range(4):
        on = np.flatnonzero(place + n < lens[of])
        c, first, wide = crc[on], begin[on + n], width[on + n]
        c = _CRC[(c ^ data[first]) & 0xFF] ^ (c >> 8)
        for k in range(1, int(wide.max(initial=1))):
            more = np.flatnonzero(wide > k)
            c[more] = _CRC[(c[more] ^ data[first[more] + k]) & 0xFF] ^ (c[more] >> 8)
        crc[on] = c
        out[at[of[on]] + place[on]] = ~c & (DIM - 1)
        at = at + sizes[:, n]
    return out, many


@dataclass
class Model:
    langs: list[str]  # of each centroid
    table: np.ndarray  # DIM x centroids: idf times the centroid's weight
    idf: np.ndarray


def fit(samples: list[tuple[str, str]], k: int = CENTROIDS, rounds: int = 8, seed: int = 5) -> Model:
    """``samples``: (language, text)."""
    rows = np.zeros((len(samples), DIM), np.float32)
    for i, (_, t) in enumerate(samples):
        for w in _WORDS.findall(t.lower()):
            np.add.at(rows[i], grams(w), 1)
    idf = np.log((1 + len(samples)) / (1 + (rows > 0).sum(0))).astype(np.float32) + 1
    rows *= idf
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    rng = np.random.default_rng(seed)
    langs, cents = [], []
    for lang in sorted({s for s, _ in samples}):
        own = rows[[i for i, (s, _) in enumerate(samples) if s == lang]]
        c = own[rng.choice(len(own), min(k, len(own)), replace=False)]
        for _ in range(rounds):
            near = (own @ c.T).argmax(1)
            c = np.stack([own[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        langs += [lang] * len(c)
        cents.append(c)
    table = (np.concatenate(cents).T * idf[:, None]).astype(np.float32) if cents else np.zeros((DIM, 0), np.float32)
    return Model(langs, table, idf)


def fit_table(samples: DataFrame, lang: str = "lang", text: str = "text", key: str = "sample_id") -> Model:
    usable = samples.where(f"{lang} is not null and {text} is not null").orderBy(key).limit(MAX_SAMPLES)
    return fit([(r[0], r[1]) for r in usable.select(lang, text).collect()])


class Classifier:
    """A worker's model, with the words it has met."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.codes = np.array([sorted(set(model.langs)).index(x) for x in model.langs], np.int64)
        self.names = sorted(set(model.langs))
        self.words = Words(_WORDS.findall)
        self.known = 0
        self.rows = np.zeros((len(model.langs) + 2, 1024), np.float32)  # of each word: shares in the products, squared length, length

    def _vector(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of a word, and their TF-IDF weights."""
        g = grams(word)
        if len(set(g)) == len(g):
            at = np.array(g, np.int64)
            return at, self.model.idf[at]
        n: dict[int, int] = {}
        for x in g:
            n[x] = n.get(x, 0) + 1
        at = np.fromiter(n, np.int64, len(n))
        return at, np.fromiter(n.values(), np.float32, len(n)) * self.model.idf[at]

    def _learn(self) -> None:
        """Columns of new words, all at once."""
        first, self.known = self.known, len(self.words.words)
        size = self.rows.shape[1]
        while size < self.known:
            size *= 2
        if size > self.rows.shape[1]:
            self.rows = np.concatenate([self.rows, np.zeros((len(self.rows), size - self.rows.shape[1]), np.float32)], 1)
        for lo in range(first, self.known, 2000):
            hi = min(lo + 2000, self.known)
            g, lens = all_grams(self.words.words[lo:hi])
            starts, of = np.cumsum(lens) - lens, np.repeat(np.arange(len(lens)), lens)
            self.rows[:-2, lo:hi] = np.add.reduceat(self.model.table.take(g, 0), starts, axis=0).T
            key, n = np.unique(of * DIM + g, return_counts=True)
            square = np.bincount(key // DIM, (n * self.model.idf[key % DIM]) ** 2, len(lens))
            self.rows[-2, lo:hi], self.rows[-1, lo:hi] = square, np.sqrt(square)

    def _length(self, words: list[str]) -> float:
        g, x = (np.concatenate(c) for c in zip(*map(self._vector, words), strict=True))
        return float(np.sqrt((np.bincount(np.unique(g, return_inverse=True)[1], x) ** 2).sum()))

    def classify(self, lines: list[str]) -> list[tuple[str | None, float]]:
        """(language, confidence) of every line."""
        return [x for part in pieces(lines) for x in self._classify(part)]

    def _classify(self, lines: list[str]) -> list[tuple[str | None, float]]:
        if self.words.full():
            self.words.clear()
            self.known = 0
        plain = [(_LINK.sub("]", s) if "](" in s else s).lower() for s in lines]
        lens, ids = self.words.numbers(plain)
        self._learn()
        sums = np.zeros((len(self.rows), len(lines)), np.float64)
        some = lens > 0
        if len(ids):
            starts = (np.cumsum(lens) - lens)[some]
            for to, row in zip(sums, self.rows, strict=True):
                to[some] = np.add.reduceat(row.take(ids), starts)
        best = np.full((len(lines), max(len(self.names), 1)), -1.0)
        for c in range(len(self.names)):
            best[:, c] = sums[:-2][self.codes == c].max(0)
        long = best.max(1)
        least, most = np.sqrt(np.maximum(sums[-2], 1e-18)), np.maximum(sums[-1], 1e-9)
        near = long >= REJECT * most
        for i in np.flatnonzero(~near & (long >= REJECT * least) & (lens >= MIN_WORDS)):
            near[i] = long[i] >= REJECT * self._length(_WORDS.findall(plain[i]))
        order = np.argsort(-best, axis=1)
        top = best[np.arange(len(lines)), order[:, 0]]
        second = best[np.arange(len(lines)), order[:, min(1, best.shape[1] - 1)]]
        ok = (lens >= MIN_WORDS) & near & (len(self.names) > 0)
        sure = np.round((top - second) / np.maximum(top, 1e-9), 4).tolist()
        return [(self.names[k], x) if good else (None, 0.0) for k, x, good in zip(order[:, 0].tolist(), sure, ok.tolist(), strict=True)]


def counts(line: str) -> bool:
    """Whether a line may have a language of its own: it is no heading, and if it is a list item, a sentence."""
    s = line.strip()
    if not s or s[0] == "#":
        return False
    return _ITEM.match(line) is None or s.rstrip("\"'”»«)]*_").endswith((".", "!", "?", "…"))


def segments(df: DataFrame, key: str, text: str, label: str, model: Model, own_lines: Callable[[list[str], list], list[list[str]]] | None = None, more: str | None = None) -> DataFrame:
    """(record_id, label, segment_no, lang, confidence, n_lines, n_segments) of every record.

    ``own_lines(texts, more)`` gives the lines of each text that are its own; ``more`` is a column for it."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # DIM x (languages x CENTROIDS) weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                texts = [t or "" for t in b.column(1).to_pylist()]
                lines = own_lines(texts, b.column(3).to_pylist()) if own_lines else [t.split("\n") for t in texts]
                lines = [[s for s in ls if counts(s)] for ls in lines]
                found = iter(classifier.classify([s for ls in lines for s in ls]))
                out: list[list] = [[] for _ in range(6)]
                for i, ls in enumerate(lines):
                    runs: list[list] = []
                    for s in ls:
                        lang, sure = next(found)
                        if lang is None:
                            continue
                        if not runs or runs[-1][0] != lang:
                            runs.append([lang, 0.0, 0, 0])
                        r = runs[-1]
                        r[1] += sure * len(s)
                        r[2] += len(s)
                        r[3] += 1
                    for n, (lang, sure, chars, count) in enumerate(runs):
                        for col, v in zip(out, (i, n, lang, sure / chars, count, len(runs)), strict=True):
                            col.append(v)
                at = pa.array(out[0], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.int32()), pa.array(out[5], pa.int32())], ["record_id", "label", "segment_no", "lang", "confidence", "n_lines", "n_segments"])

    src = df.select(F.col(key).cast("long").alias("record_id"), F.col(text), F.col(label).cast("string").alias("label"), (F.col(more) if more else F.lit(None)).cast("string").alias("more"))
    return src.where(F.trim(text) != "").mapInArrow(run, "record_id long, label string, segment_no long, lang string, confidence double, n_lines int, n_segments int")


def mislabelled(found: DataFrame) -> DataFrame:
    """The segments of records whose label is missing, names no single language or another one, or that are mixed."""
    said = label_language(F.col("label"))
    return found.where((F.col("n_segments") > 1) | said.isNull() | (said != F.col("lang")))
