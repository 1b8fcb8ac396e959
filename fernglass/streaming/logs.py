"""Structured Streaming twins of the batch operators over logs (T1-T7). Each equals its batch form over the same rows.

Event time is the log's own stamp, never a publisher's date. What comes later than the watermark allows is dropped by
the state, as in any Structured Streaming query; within it, rows may come in any order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fernglass.operators.upsert import Snapshots, upsert

Sink = Callable[[DataFrame, int], None]


def _us(x: pd.Timestamp) -> int:
    return x.value // 1_000


def tail_run(log: DataFrame, key: str, at: str, counts: Column, resets: Column, delay: str = "1 hour") -> DataFrame:
    """T5: R1 as keyed state, in update mode: (key, run_length, run_latest) whenever a key changes; length 0 is no run.

    The state is the last reset, and the counted rows after it: those that a late reset can still overtake one by one
    (they are within ``delay`` of the key's newest row), older ones as a number and a time."""
    kind = dict(log.dtypes)[key]
    wait = pd.Timedelta(delay).value // 1_000

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reset, old_n, old_latest, recent, newest = state.get if state.exists else (None, 0, None, "[]", None)
        times: list[int] = json.loads(recent)
        for b in batches:
            for t, c, r in zip(b["_at"], b["_counts"], b["_resets"], strict=True):
                if pd.isna(t):
                    continue
                t = _us(t)
                newest = t if newest is None else max(newest, t)
                if r and (reset is None or t > reset):
                    reset = t
                if c:
                    times.append(t)
        times = sorted(t for t in times if reset is None or t > reset)
        if old_latest is not None and reset is not None and reset >= old_latest:
            old_n, old_latest = 0, None
        edge = (newest or 0) - wait
        old = [t for t in times if t < edge]
        if old:
            old_n, old_latest = old_n + len(old), max(old[-1], old_latest or old[-1])
            times = times[len(old) :]
        state.update((reset, old_n, old_latest, json.dumps(times), newest))
        n = old_n + len(times)
        latest = times[-1] if times else old_latest
        yield pd.DataFrame({key: [keys[0]], "run_length": [n], "run_latest": [pd.Timestamp(latest * 1_000) if n and latest is not None else pd.NaT]})

    rows = log.select(key, F.col(at).cast("timestamp_ntz").alias("_at"), counts.alias("_counts"), resets.alias("_resets"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, run_length long, run_latest timestamp_ntz", "reset long, old_n long, old_latest long, recent string, newest long", "update", GroupStateTimeout.NoTimeout)


def changed(docs: DataFrame, key: str, order: str, doc_id: str, hashed: Column) -> DataFrame:
    """W4 as keyed state: (key, doc_id) of each document that differs from the one before it of its source. Documents of
    one micro-batch are taken in order; across batches, in the order of arrival."""
    types = dict(docs.dtypes)

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["_o", doc_id])
        keep = []
        for i, h in zip(rows[doc_id], rows["_h"], strict=True):
            if held is None or h != held:
                keep.append(i)
            held = h
        state.update((held,))
        yield pd.DataFrame({key: [keys[0]] * len(keep), doc_id: keep})

    rows = docs.select(key, doc_id, F.col(order).alias("_o"), hashed.alias("_h"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {types[key]}, {doc_id} {types[doc_id]}", "held string", "append", GroupStateTimeout.NoTimeout)


def settled(versions: DataFrame, key: str, at: str, quiet: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """(key, since, until, arrivals): bursts of versions that an hour of quiet has closed, in append mode."""
    return versions.withWatermark(at, delay).groupBy(key, F.session_window(at, quiet).alias("w")).agg(F.count("*").alias("arrivals")).select(key, F.col("w.start").alias("since"), F.col("w.end").alias("until"), "arrivals")


def buckets(records: DataFrame, at: str, series: str, value: str, width: str, delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """G8 as a stream: tumbling (or sliding) windows that the watermark has closed, in append mode."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return records.withWatermark(at, delay).groupBy(w.alias("w"), series).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), F.max(value).alias("highest")).select(F.col("w.start").alias("bucket"), series, "n", "total", "highest")


def once_per_key(jobs: DataFrame, keys: list[str], at: str, delay: str = "1 hour") -> DataFrame:
    """At most one job of each key within the watermark."""
    return jobs.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def upserting(snapshots: Snapshots, keys: list[str], update: list[str], order: list[str]) -> Sink:
    """A foreachBatch sink that upserts into a snapshot table; a batch that is replayed changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        held = snapshots.read()
        new = upsert(held, batch, keys, update, order).drop("disposition") if held is not None else upsert(batch.limit(0), batch, keys, update, order).drop("disposition")
        snapshots.commit(new, batch_id)

    return write


def drain(stream: DataFrame, checkpoint: str, sink: Sink | None = None, path: str | None = None, mode: str = "append") -> None:
    """Everything there is now, then stop (availableNow): a cron tick."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(sink).start() if sink is not None else w.format("parquet").option("path", path).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
