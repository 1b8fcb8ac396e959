"""Mixing sources to target weights (problem 9).

Input: documents (id, source, size in tokens) and targets (source, target_share, max_repeats).
Output of ``mix``: one row for each use of a document, with its copy number, its output shard and
its place there; ``shares`` reports what came out.

The total T is the largest at which every source that has any tokens can contribute its share
without a document being used more than max_repeats times (or ``total_tokens``, if that is given:
then a source that cannot reach its share gives all it may, and the report shows the shortfall). A
source uses its documents in whole passes, each in another random order, and of the last pass a
prefix that ends with the document nearest to the quota. Targets without documents (or whose documents
have no tokens) contribute nothing. Sources without a target, documents with a null source and
documents of no tokens (empty or null texts) are not part of the mix. Shares are taken relative to
their sum; null, zero and negative shares and repeats count as zero. Of repeated target rows the
first by share and repeats counts. Repeated document rows are separate documents.

Method: every source's uses, in random order, are cut into blocks of ``block_tokens``. A splitting
tree over the output shards parts the sources' block quotas exactly: at each node the blocks that
go left are a multivariate hypergeometric draw, so every shard is a uniform random sample of the
mix without any shard or source overrunning. Each shard then owns disjoint ranges of every source's
permuted blocks and is shuffled by itself. The tree needs the quotas only (one number for each
source); documents meet their shard by a join on block ranges, never in one task.

Scale: running sums are taken in two steps (sums of hash ranges, then within a range), so that a
source with a third of all rows is many small windows.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

#: Hash ranges into which each pass over a source is cut for the running sums.
RANGES = 1024


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int, limit: int = 900_000_000) -> int:
    """How many of ``drawn`` are good. numpy draws from fewer than 10^9 of each kind; from larger urns by inversion."""
    if drawn == 0 or good == 0:
        return 0
    if bad == 0:
        return drawn
    if max(good, bad) < limit:
        return int(rng.hypergeometric(good, bad, drawn))
    return _by_inversion(rng, good, bad, drawn)


def _by_inversion(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """A hypergeometric number by inversion from the mode: the probabilities of the neighbours follow from its own."""
    mode = min(max((drawn + 1) * (good + 1) // (good + bad + 2), max(0, drawn - bad)), min(good, drawn))
    u = rng.random()
    # ratios of neighbours from the mode on; beyond 12 standard deviations nothing is left in double precision
    spread = sqrt(drawn * (good / (good + bad)) * (bad / (good + bad)) * max(good + bad - drawn, 1) / (good + bad))
    reach = int(12 * spread) + 20
    low, high = max(mode - reach, max(0, drawn - bad)), min(mode + reach, min(good, drawn))
    up = np.arange(mode, high, dtype=np.float64)
    down = np.arange(mode, low, -1, dtype=np.float64)
    over = np.concatenate([[0.0], np.cumsum(np.log((good - up) * (drawn - up)) - np.log((up + 1) * (bad - drawn + up + 1)))])
    under = np.cumsum(np.log(down * (bad - drawn + down)) - np.log((good - down + 1) * (drawn - down + 1)))
    weight = np.exp(np.concatenate([under[::-1], over]))
    return low + int(np.searchsorted(np.cumsum(weight), u * weight.sum()))


def split_quotas(quotas: dict[str, int], shards: int, seed: int) -> list[dict[str, int]]:
    """Part the block quotas among the shards by a tree of multivariate hypergeometric draws."""
    names = sorted(quotas)
    out: list[dict[str, int]] = [{} for _ in range(shards)]

    def part(counts: np.ndarray, lo: int, hi: int, node: int) -> None:
        if hi - lo == 1:
            out[lo] = dict(zip(names, counts.tolist(), strict=True))
            return
        mid = (lo + hi) // 2
        total = int(counts.sum())
        left = total * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, node])
        drawn = np.zeros_like(counts)
        rest, need = total, left  # conditional draws, source by source
        for i, c in enumerate(counts.tolist()):
            rest -= c
            drawn[i] = hypergeometric(rng, c, rest, need)
            need -= int(drawn[i])
        part(drawn, lo, mid, 2 * node + 1)
        part(counts - drawn, mid, hi, 2 * node + 2)

    part(np.array([quotas[n] for n in names], np.int64), 0, shards, 0)
    return out


def plan(sizes: dict[str, int], targets: list[tuple[str, float, int]], total_tokens: int | None = None) -> dict[str, int]:
    """The tokens that each source is to give. ``targets`` is a small configuration table."""
    share_sum = sum(s for _, s, _ in targets) or 1.0
    have = {n: (s / share_sum, sizes.get(n, 0) * r) for n, s, r in targets if s > 0 and r > 0 and sizes.get(n, 0) > 0}
    if not have:
        return {}
    total = min(cap / share for share, cap in have.values()) if total_tokens is None else total_tokens
    return {n: min(cap, round(total * share)) for n, (share, cap) in have.items()}


def _targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    best: dict[str, tuple[float, int]] = {}
    for r in targets.select("source", "target_share", "max_repeats").collect():  # a configuration table, one row a source
        if r[0] is not None:
            row = (max(float(r[1] or 0), 0.0), max(int(r[2] or 0), 0))
            best[r[0]] = max(best.get(r[0], row), row)
    return [(n, s, k) for n, (s, k) in sorted(best.items())]


def uses(sized: DataFrame, quotas: dict[str, int], sizes: dict[str, int], seed: int) -> DataFrame:
    """(doc_id, source, n_tokens, copy_no, start): every use, with the source's tokens before it."""
    spark = sized.sparkSession
    passes = [(s, c, sizes[s] * c, min(q - sizes[s] * c, sizes[s])) for s, q in sorted(quotas.items()) for c in range(-(-q // sizes[s]))]
    passes_df = spark.createDataFrame(passes or [("", 0, 0, 0)], "source string, copy_no int, base long, take long").where(F.col("take") > 0)
    each = sized.join(F.broadcast(passes_df), "source").withColumn("order", F.xxhash64(F.lit(seed), "copy_no", "doc_id"))  # passes: sources x repeats, both from the targets
    each = each.withColumn("range", F.shiftright("order", 64 - RANGES.bit_length() + 1))
    key = ["source", "copy_no", "range"]
    sums = each.groupBy(key).agg(F.sum("n_tokens").alias("in_range"))
    before = Window.partitionBy("source", "copy_no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy(key).orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(sums, key)
    at = F.col("before") + F.col("inside")
    # a document belongs to the quota if its middle does: the last one lands nearest to the quota
    return each.where(at + F.col("n_tokens") / 2 <= F.col("take")).select("doc_id", "source", "n_tokens", "copy_no", (F.col("base") + at).alias("start"))


def mix(sized: DataFrame, targets: DataFrame, shards: int = 16, block_tokens: int = 4096, total_tokens: int | None = None, seed: int = 7) -> DataFrame:
    """(doc_id, source, copy_no, shard, place, n_tokens): the mixture. ``sized`` has doc_id, source and n_tokens."""
    spark = sized.sparkSession
    wanted = _targets(targets)
    names = [n for n, _, _ in wanted]
    sized = sized.where(F.col("source").isin(names) & (F.col("n_tokens") > 0)).select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens"))
    sizes = {r[0]: int(r[1]) for r in sized.groupBy("source").agg(F.sum("n_tokens")).collect()}  # a row for each target
    quotas = plan(sizes, wanted, total_tokens)
    blocks = {n: -(-q // block_tokens) for n, q in quotas.items()}
    ranges, first = [], dict.fromkeys(blocks, 0)
    for shard, counts in enumerate(split_quotas(blocks, shards, seed) if blocks else []):
        for n, k in counts.items():
            if k:
                ranges.append((n, first[n], first[n] + k, shard))
            first[n] += k
    owners = spark.createDataFrame(ranges or [("", 0, 0, 0)], "source string, lo long, hi long, shard int")  # sources x shards rows
    used = uses(sized, quotas, sizes, seed).withColumn("block", F.least(F.floor(F.col("start") / block_tokens), F.element_at(F.create_map(*[F.lit(x) for n in (blocks or {"": 1}) for x in (n, max((blocks or {"": 1})[n] - 1, 0))]), F.col("source"))))
    owned = used.join(F.broadcast(owners), (used.source == owners.source) & (used.block >= owners.lo) & (used.block < owners.hi)).drop(owners.source)
    order = F.xxhash64(F.lit(seed + 1), "doc_id", "copy_no")
    return owned.select("doc_id", "source", "copy_no", "shard", order.alias("place"), "n_tokens")


def shares(mixed: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, docs, tokens_available, tokens_used, uses, most_repeats, actual_share, corpus_share): the
    report; corpus_share is the size of the mix, copies and all, over the tokens of all target sources (the scarcest source decides it)."""
    have = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens_available"))
    per_doc = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("times"), F.sum("n_tokens").alias("tokens"))
    got = per_doc.groupBy("source").agg(F.sum("tokens").alias("tokens_used"), F.sum("times").alias("uses"), F.max("times").alias("most_repeats"))
    total = got.agg(F.sum("tokens_used").alias("total")).join(have.agg(F.sum("tokens_available").alias("corpus")))  # one row each
    zero = F.lit(0).cast("long")
    return (
        targets.select("source", "target_share", "max_repeats")
        .join(have, "source", "left")
        .join(got, "source", "left")
        .join(total)  # one row
        .select("source", "target_share", "max_repeats", *[F.coalesce(c, zero).alias(c) for c in ("docs", "tokens_available", "tokens_used", "uses", "most_repeats")], F.coalesce(F.col("tokens_used") / F.col("total"), F.lit(0.0)).alias("actual_share"), F.coalesce(F.col("total") / F.col("corpus"), F.lit(0.0)).alias("corpus_share"))
    )
