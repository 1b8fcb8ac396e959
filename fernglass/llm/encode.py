"""Encoding of whole texts with a public byte-level BPE tokenizer (problem 8).

``ids`` and ``token_counts`` take any DataFrame with an id and a text column. Null and empty texts
have an empty list (0 tokens). Strings that look like special tokens are ordinary text. Repeated
rows come out repeatedly, extra columns are left out, very long texts need no special case.

How: one pass over all texts counts their chunks (a chunk is what lies between two single spaces
that have no other white space beside them; such a place is always a boundary of the tokenizer's
pattern, and what follows does not depend on what came before). The chunks are cut into pre-tokens
by the tokenizer's pattern, and the ``lexicon_size`` most frequent go into the transducer of
``lexicon``. The second pass looks chunks up in a cache of the worker; the pre-tokens of new chunks
are looked up in the mapped automaton together, and those that it lacks are merged exactly. So the
size of the lexicon changes the speed and never the result.
"""

from __future__ import annotations

import base64
import os
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from fernglass.llm.lexicon import Lexicon, compile_lexicon, merge

#: Words that the transducer holds at most; all others are merged.
LEXICON_SIZE = 60_000
#: Chunks that a worker remembers before it begins anew.
CACHE_SIZE = 250_000

_SINGLE = re.compile(r"(?<=\S) (?=\S)")
_CROWDED = re.compile(r"(?:\s|\A) | (?:\s|\Z)")


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the vocabulary lies: in the folder $FERNGLASS_TOKENIZERS, else in /opt/tokenizers."""
    return os.path.join(os.environ.get("FERNGLASS_TOKENIZERS", "/opt/tokenizers"), name)


# Fixed value: the pre-tokenisation pattern of the byte_bpe tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def chunks(text: str) -> list[str]:
    """The text cut at its safe spaces; every chunk but the first is to be read with a space before it."""
    return _SINGLE.split(text) if _CROWDED.search(text) else text.split(" ")


def _count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()  # chunks that a space stands before
    firsts: Counter = Counter()  # chunks that a text begins with

    def out() -> pa.RecordBatch:
        cols = [*seen, *firsts], [False] * len(seen) + [True] * len(firsts), [*seen.values(), *firsts.values()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.int64()), strict=True)], ["chunk", "first", "n"])

    for b in batches:
        for t in b.column(0).to_pylist():
            if t:
                first, *rest = chunks(t)
                seen.update(rest)
                firsts[first] += 1
        if len(seen) + len(firsts) > 200_000:
            yield out()
            seen.clear()
            firsts.clear()
    if seen or firsts:
        yield out()


def _count_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import regex

    cut = regex.compile(PATTERN).findall
    for b in batches:
        seen: Counter = Counter()
        for c, first, n in zip(*(x.to_pylist() for x in b.columns), strict=True):
            for p in cut(c if first else " " + c):
                seen[p.encode("utf-8", "surrogatepass")] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])


def build_lexicon(texts: DataFrame, text: str, ranks: dict[bytes, int], lexicon_size: int = LEXICON_SIZE) -> str:
    """Count the words of all texts, compile the most frequent, hand the file to the executors; returns its name.

    The driver's file server hands it to every executor, also to late ones (as with code); no job reads the driver's folder."""
    counted = texts.select(F.col(text).alias("text")).mapInArrow(_count_chunks, "chunk string, first boolean, n long").groupBy("chunk", "first").agg(F.sum("n").alias("n"))
    pieces = counted.mapInArrow(_count_pieces, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    top = pieces.where(F.length("piece") <= 64).orderBy(F.desc("n"), "piece").limit(lexicon_size).select("piece").toArrow().column(0).to_pylist()
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="fernglass-"), name)
    compile_lexicon(top, lambda w: merge(w, ranks), path)
    texts.sparkSession.sparkContext.addFile(path)
    return name


class Encoder:
    """A worker's view of the lexicon, with the cache of chunks."""

    made: dict[str, Encoder] = {}

    def __init__(self, lexicon: Lexicon, ranks: dict[bytes, int]) -> None:
        import regex

        self.lexicon, self.ranks, self.cut = lexicon, ranks, regex.compile(PATTERN).findall
        self.cache: dict[str, tuple[int, ...]] = {}
        self.firsts: dict[str, tuple[int, ...]] = {}

    @classmethod
    def of(cls, name: str, ranks) -> Encoder:
        if name not in cls.made:
            cls.made.clear()
            cls.made[name] = cls(Lexicon(SparkFiles.get(name)), ranks.value)
        return cls.made[name]

    def learn(self, texts: list[list[str]]) -> None:
        """Have every chunk of these texts in the cache; a text's first chunk has one of its own."""
        if len(self.cache) + len(self.firsts) > CACHE_SIZE:
            self.cache, self.firsts = {}, {}
        new = [(self.cache, c, " " + c) for c in {c for t in texts for c in t[1:]} if c not in self.cache]
        new += [(self.firsts, c, c) for c in {t[0] for t in texts if t} if c not in self.firsts]
        cut = [self.cut(c) for _, _, c in new]
        words = list({p.encode("utf-8", "surrogatepass") for ps in cut for p in ps})
        places = self.lexicon.find(words)
        ids = {w: self.lexicon.get(p) if p >= 0 else tuple(merge(w, self.ranks)) for w, p in zip(words, places.tolist(), strict=True)}
        for (into, c, _), ps in zip(new, cut, strict=True):
            into[c] = tuple(chain.from_iterable(ids[p.encode("utf-8", "surrogatepass")] for p in ps))

    def encode(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """All ids of the texts in a row, and the number of each text."""
        cut = [chunks(t) if t else [] for t in texts]
        self.learn(cut)
        get, flat, lens = self.cache.__getitem__, [], []
        for c in cut:
            before = len(flat)
            if c:
                flat.extend(self.firsts[c[0]])
                flat.extend(chain.from_iterable(map(get, c[1:])))
            lens.append(len(flat) - before)
        return flat, lens


def _groups(batches: Iterator[pa.RecordBatch], chars: int = 4_000_000) -> Iterator[tuple[pa.Array, list]]:
    """(ids, texts) in slices of bounded size, so that long texts cannot fill the worker."""
    for b in batches:
        ids, texts = b.column(0), b.column(1).to_pylist()
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size > chars:
                yield ids.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0
        if start < len(texts):
            yield ids.slice(start), texts[start:]


def _prepared(df: DataFrame, doc_id: str, text: str, path: str | None, lexicon_size: int):
    ranks = read_ranks(path or tokenizer_file())
    name = build_lexicon(df, text, ranks, lexicon_size)
    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), name, df.sparkSession.sparkContext.broadcast(ranks), kind


def ids(df: DataFrame, doc_id: str, text: str, path: str | None = None, lexicon_size: int = LEXICON_SIZE) -> DataFrame:
    """(doc_id, ids): the token ids of every text. ``path`` is the vocabulary, as base64 bytes and ranks."""
    src, name, ranks, kind = _prepared(df, doc_id, text, path, lexicon_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, texts in _groups(batches):
            flat, lens = Encoder.of(name, ranks).encode(texts)
            values = pa.array(np.array(flat, np.int32))
            offsets = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([key, pa.ListArray.from_arrays(offsets, values)], ["doc_id", "ids"])

    return src.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def token_counts(df: DataFrame, doc_id: str, text: str, path: str | None = None, lexicon_size: int = LEXICON_SIZE) -> DataFrame:
    """(doc_id, n_tokens): the number of tokens of every text."""
    src, name, ranks, kind = _prepared(df, doc_id, text, path, lexicon_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, texts in _groups(batches):
            _, lens = Encoder.of(name, ranks).encode(texts)
            yield pa.RecordBatch.from_arrays([key, pa.array(lens, pa.int64())], ["doc_id", "n_tokens"])

    return src.mapInArrow(run, f"doc_id {kind}, n_tokens long")
