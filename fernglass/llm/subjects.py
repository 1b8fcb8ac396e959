"""Subject areas of documents by seeded non-negative matrix factorisation (problem 10).

The document-term matrix of the hand-labelled documents (at most ``MAX_TRAIN`` of them, by hash of the
id: the one bound) is factored, A ~ W H, by alternating multiplicative updates that lower the
Kullback-Leibler divergence, with one anchored component for each subject. Anchoring: a labelled
document starts with weight on its labelled subjects and ``DOUBT`` on each of the others;
multiplicative updates move the weights as the words demand, so wrong labels lose their hold, and
of a document with two subjects each word goes to the one whose other documents have it. The
components then say, for each term, how much of it comes from which subject. Terms whose documents
have no subject in common (the language's own words) are left out of the matrix.

Every document is then folded in, sentence by sentence: the rows of the sentence-term matrix are factored by the same
multiplicative updates with H fixed (``FOLDS`` of them, from even weights). A row's weights, normalised, are the sentence's
mixture; a sentence is about a subject that has most of it (and at least ``LEAST`` terms of evidence), and the
document's mixture is the share of its sentences for each subject. A document has every subject with a share of ``MIN_SHARE`` or more.

Null, empty and blank texts have no sentences and no subjects; a document may have none. Labels of
unknown documents or of subjects that are not in the table are ignored, repeated labels count once.
Very long texts are lists of sentences in one worker; repeated rows come out repeatedly; extra
columns are ignored. Without any usable label no document has a subject.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MAX_TRAIN = 8_000
STEPS = 12
CONCENTRATED = 0.35  # a term's share (of its documents and one more) in one subject's seeds, from which it is used
MIN_DOCS = 3  # documents that a term must be in
DOUBT = 0.03
MIN_SHARE = 0.25
LEAST = 0.6
FOLDS = 2

_WORDS = re.compile(r"[^\W\d_]{2,}")
_SENTENCES = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+|\n+")


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCES.split(text) if s and _WORDS.search(s)]


@dataclass
class Factors:
    subjects: list[str]
    terms: dict[str, int]
    h: np.ndarray  # terms x subjects: H, each subject's terms summing to 1
    trust: np.ndarray  # of each term: what one place of it counts


def term_counts(text: str) -> Counter:
    return Counter(_WORDS.findall(text.lower()))


def factor(docs: list[tuple[dict[str, int], set[str]]], subjects: list[str], steps: int = STEPS) -> Factors:
    """``docs``: (the counts of its terms, its labels)."""
    bags = [b for b, _ in docs]
    none = Factors(subjects, {}, np.zeros((0, len(subjects)), np.float32), np.zeros(0, np.float32))
    df = Counter(w for b in bags for w in b)
    least = MIN_DOCS if len(docs) >= 50 else 2
    terms = {w: j for j, w in enumerate(sorted(w for w, n in df.items() if n >= least))}
    k = len(subjects)
    coo = [(i, terms[w], n) for i, b in enumerate(bags) for w, n in b.items() if w in terms]
    if not coo:
        return none
    rows, cols, vals = (np.array(x) for x in zip(*coo, strict=True))
    seed = np.array([[1.0 / len(own) if name in own else 0.0 for name in subjects] for _, own in docs])
    # words that documents of many subjects share are the language's own: they would make the components languages
    share = np.stack([np.bincount(cols, seed[rows, c], len(terms)) for c in range(k)], 1)
    least_share = max(CONCENTRATED, 1.3 / max(k, 1))  # with few subjects, an even spread is a large share
    keep = share.max(1) >= least_share * (share.sum(1) + 1)
    terms = {w: int(j) for (w, old), j in zip(terms.items(), np.cumsum(keep) - 1, strict=True) if keep[old]}
    there = keep[cols]
    rows, cols, vals = rows[there], (np.cumsum(keep) - 1)[cols[there]], vals[there]
    vals = np.log1p(vals.astype(np.float64))
    w = np.where(seed > 0, seed, DOUBT)
    h = np.zeros((k, len(terms)))
    for c in range(h.shape[0]):  # start from the weighted counts of the seeds
        h[c] = np.bincount(cols, vals * w[rows, c], len(terms)) + 1e-6
    h /= h.sum(1, keepdims=True)
    w *= (np.bincount(rows, vals, len(docs)) / w.sum(1))[:, None]
    if not terms:
        return none
    for _ in range(steps):
        ratio = vals / np.maximum((w[rows] * h.T[cols]).sum(1), 1e-12)
        grown = np.zeros_like(w)
        for c in range(w.shape[1]):
            grown[:, c] = np.bincount(rows, ratio * h[c, cols], len(docs))
        w *= grown / np.maximum(h.sum(1), 1e-12)
        ratio = vals / np.maximum((w[rows] * h.T[cols]).sum(1), 1e-12)
        for c in range(h.shape[0]):
            h[c] *= np.bincount(cols, ratio * w[rows, c], len(terms)) / max(w[:, c].sum(), 1e-12)
        h = np.maximum(h, 1e-12)
    n = np.bincount(cols, minlength=len(terms))
    part = (h * w.sum(0)[:, None]).T
    part /= part.sum(1, keepdims=True)
    trust = n / (n + 1.0) * (part.max(1) > least_share)  # a term that many subjects share says little about any
    return Factors(subjects, terms, (h / h.sum(1, keepdims=True)).T.astype(np.float32), trust.astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, subjects: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Factors:
    names = sorted(r[0] for r in subjects.select("subject").distinct().collect() if r[0])  # a configuration table
    own = labels.where(F.col("subject").isin(names)).groupBy("doc_id").agg(F.collect_set("subject").alias("own")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0)
    kind = docs.schema[doc_id].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [term_counts(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([list(x) for x in bags], pa.list_(pa.string())), pa.array([list(x.values()) for x in bags], pa.list_(pa.int32()))], ["doc_id", "own", "terms", "n"])

    labelled = src.join(F.broadcast(own), "doc_id").select("doc_id", "text", "own")  # at most MAX_TRAIN labelled rows
    got = labelled.mapInArrow(count, f"doc_id {kind}, own array<string>, terms array<string>, n array<int>").toArrow().to_pylist()  # their counts, no texts
    got.sort(key=lambda r: r["doc_id"])
    return factor([(dict(zip(r["terms"], r["n"], strict=True)), set(r["own"])) for r in got], names)


class Folder:
    """A worker's factors."""

    def __init__(self, f: Factors) -> None:
        self.f = f
        k = len(f.subjects)
        self.h = np.concatenate([f.h, np.full((1, k), 1.0 / max(k, 1), np.float32)])  # the last row: no known term
        self.trust = np.concatenate([f.trust, np.zeros(1, np.float32)])

    def weights(self, lines: list[str], folds: int = FOLDS) -> np.ndarray:
        """Sentences x subjects: the weights W of each sentence's row, W H ~ its counts."""
        get, none = self.f.terms.get, len(self.f.terms)
        found = [[j for w in _WORDS.findall(s.lower()) if (j := get(w, none)) != none] or [none] for s in lines]
        lens = np.array(list(map(len, found)), np.int64)
        starts, row = np.cumsum(lens) - lens, np.repeat(np.arange(len(lines)), lens)
        ids = np.fromiter((j for x in found for j in x), np.int64, int(lens.sum()))
        h, counts = self.h[ids], self.trust[ids]
        w = np.full((len(lines), h.shape[1]), 1.0, np.float32)
        for _ in range(folds):
            ratio = counts / np.maximum((w[row] * h).sum(1), 1e-12)
            w *= np.add.reduceat(ratio[:, None] * h, starts, axis=0)
        return w

    def about(self, lines: list[str]) -> np.ndarray:
        """The subject's number for every sentence, or -1."""
        if not lines or not self.f.subjects:
            return np.full(len(lines), -1)
        w = self.weights(lines)
        top = w.argmax(1)
        best, total = w[np.arange(len(lines)), top], w.sum(1)
        return np.where((best >= LEAST) & (best > 0.5 * total), top, -1)


def mixtures(docs: DataFrame, factors: Factors, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, subject, n_sentences, share): every subject that any sentence of a document is about."""
    shared = docs.sparkSession.sparkContext.broadcast(factors)  # terms of at most MAX_TRAIN documents
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(shared.value)
        names = pa.array(folder.f.subjects, pa.string())
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                cut = [sentences(t) if t else [] for t in b.column(1).to_pylist()]
                about = folder.about([s for c in cut for s in c])
                lens = np.array([len(c) for c in cut], np.int64)
                row = np.repeat(np.arange(len(cut)), lens)
                on = about >= 0
                k = max(len(folder.f.subjects), 1)
                pairs, counts = np.unique(row[on] * k + about[on], return_counts=True)
                at = pairs // k
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), names.take(pa.array(pairs % k)), pa.array(lens[at]), pa.array(counts / lens[at])], ["doc_id", "subject", "n_sentences", "share"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, subject string, n_sentences long, share double")
