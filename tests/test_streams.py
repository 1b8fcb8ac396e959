import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fernglass.operators import changes, runs, upsert
from fernglass.streaming import logs

T0 = datetime(2024, 1, 1)


def written_in_parts(spark, rows, schema, path, parts=3):
    """Micro-batches: one file a batch."""
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_tail_run_equals_batch(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(rnd.randint(1, 5), T0 + timedelta(minutes=i), rnd.choice("FFFox")) for i in range(120)]
    for i in range(0, 119, 7):  # out of order, within the delay
        rows[i], rows[i + 1] = rows[i + 1], rows[i]
    schema = "k long, at timestamp_ntz, x string"
    counts, resets = F.col("x") == "F", F.col("x") == "o"
    s = written_in_parts(spark, rows, schema, f"{tmp_path}/in")
    held = upsert.Snapshots(spark, f"file://{tmp_path}/table")
    logs.drain(logs.tail_run(s, "k", "at", counts, resets), f"{tmp_path}/state", logs.upserting(held, ["k"], ["run_length", "run_latest"], ["run_latest"]), mode="update")
    want = {(r.k, r.run_length, r.run_latest) for r in runs.tail_run(spark.createDataFrame(rows, schema), "k", "at", counts, resets).collect()}
    assert {(r.k, r.run_length, r.run_latest) for r in held.read().where("run_length > 0").collect()} == want


def test_changed_equals_batch(spark, tmp_path):
    rows = [(1 + i % 2, i, T0 + timedelta(hours=i), "ABBA"[i % 4]) for i in range(24)]
    schema = "k long, id long, at timestamp_ntz, h string"
    s = written_in_parts(spark, rows, schema, f"{tmp_path}/in")
    logs.drain(logs.changed(s, "k", "at", "id", F.col("h")), f"{tmp_path}/state", path=f"{tmp_path}/out")
    want = sorted(r.id for r in changes.changed_from_previous(spark.createDataFrame(rows, schema), "k", ["at", "id"], F.col("h")).collect())
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == want


def test_settle_buckets_and_once(spark, tmp_path):
    rows = [(1, T0 + timedelta(minutes=m), 1.0) for m in (0, 20, 50, 300, 310, 900)] + [(2, T0 + timedelta(minutes=5), 2.0)]
    schema = "k long, at timestamp, v double"
    s = written_in_parts(spark, rows, schema, f"{tmp_path}/in", parts=1)
    logs.drain(logs.settled(s, "k", "at"), f"{tmp_path}/a", path=f"{tmp_path}/settled")
    assert sorted((r.k, r.arrivals) for r in spark.read.parquet(f"{tmp_path}/settled").collect()) == [(1, 2), (1, 3), (2, 1)]
    logs.drain(logs.buckets(s, "at", "k", "v", "1 hour"), f"{tmp_path}/b", path=f"{tmp_path}/buckets")
    assert sorted((r.k, r.n) for r in spark.read.parquet(f"{tmp_path}/buckets").collect()) == [(1, 2), (1, 3), (2, 1)]
    logs.drain(logs.once_per_key(s, ["k"], "at", "1 day"), f"{tmp_path}/c", path=f"{tmp_path}/once")
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/once").collect()) == [1, 2]
