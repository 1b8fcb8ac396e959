"""Tail runs over append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fernglass.functions.pace import HOST_PROBE, due_at

HOST_THRESHOLD = 5


def tail_run(log: DataFrame, key: str, at: str, counts: Column, resets: Column) -> DataFrame:
    """(key, run_length, run_latest): rows that count and came strictly after the key's last reset.

    Rows that neither count nor reset are stepped over; a count at the very time of the reset belongs to the
    past. Keys without a run are absent: left join them and take 0. One shuffle, on the key."""
    flagged = log.select(key, F.col(at).alias("_at"), counts.alias("_counts"), resets.alias("_resets"))
    reset_at = F.max(F.when(F.col("_resets"), F.col("_at"))).over(Window.partitionBy(key))
    tail = flagged.withColumn("_reset", reset_at).where(F.col("_counts") & (F.col("_reset").isNull() | (F.col("_at") > F.col("_reset"))))
    return tail.groupBy(key).agg(F.count("*").alias("run_length"), F.max("_at").alias("run_latest"))


def tail_run_two_step(log: DataFrame, key: str, at: str, counts: Column, resets: Column) -> DataFrame:
    """R1 for keys that hold a large part of the log: the reset points are partial aggregates, and the log meets them
    by a join (which AQE may split), so no task ever holds one key's rows."""
    flagged = log.select(key, F.col(at).alias("_at"), counts.alias("_counts"), resets.alias("_resets"))
    reset = flagged.where("_resets").groupBy(key).agg(F.max("_at").alias("_reset"))
    tail = flagged.where("_counts").join(reset, key, "left").where(F.col("_reset").isNull() | (F.col("_at") > F.col("_reset")))
    return tail.groupBy(key).agg(F.count("*").alias("run_length"), F.max("_at").alias("run_latest"))


def feed_failures(polls: DataFrame, key: str = "feed_id") -> DataFrame:
    """Failed polls count, anything else ends the run."""
    return tail_run_two_step(polls, key, "polled_at", F.col("outcome") == "failed", F.col("outcome") != "failed")


def host_failures(captures: DataFrame, policy: str = "2") -> DataFrame:
    """R2: failed captures of the current policy count; only an ok ends the run."""
    now = captures.where(F.col("capture_policy") == policy)
    return tail_run_two_step(now, "host_id", "fetched_at", F.col("outcome") == "failed", F.col("outcome") == "ok")


def gone(polls: DataFrame, key: str = "feed_id") -> DataFrame:
    """Keys that ever answered 410, whatever came later."""
    return polls.where(F.col("status") == 410).select(key).distinct()


def refusing(failures: Column, last_failure: Column, now: Column, threshold: int = HOST_THRESHOLD) -> Column:
    """Too many failures in a row, and the next probe is not due yet."""
    return (failures >= threshold) & (due_at(last_failure, failures - threshold, HOST_PROBE) > now)


def health(entities: DataFrame, log: DataFrame, key: str, at: str, counts: Column, resets: Column) -> DataFrame:
    """Q27: the entities with their run, whether they are gone, and their last outcome. ``log`` has outcome, status and
    log_id; entities without a log have a run of 0."""
    run = tail_run_two_step(log, key, at, counts, resets)
    last = log.groupBy(key).agg(F.max_by("outcome", F.struct(at, "log_id")).alias("last_outcome"), F.bool_or(F.col("status") == 410).alias("gone"), F.count("*").alias("visits"))
    return (
        entities.join(last, key, "left")
        .join(run, key, "left")
        .withColumn("run_length", F.coalesce("run_length", F.lit(0)))
        .withColumn("gone", F.coalesce("gone", F.lit(False)))
        .withColumn("visits", F.coalesce("visits", F.lit(0)))
    )
