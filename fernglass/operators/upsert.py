"""Writing to immutable snapshots (S9-S13, Q26, Q28): upserts as joins, commits as a pointer swap."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from fernglass.operators.latest import latest_by


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str], order: list[str] | None = None) -> DataFrame:
    """Insert what is new; on a conflict of ``keys`` (nulls equal) overwrite ``update`` only.

    Several source rows of one key: the last by ``order`` wins. The result has the target's columns; ``disposition``
    is inserted, updated or kept."""
    src = latest_by(source, keys, order) if order else source.dropDuplicates(keys)
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), src.withColumn("_s", F.lit(True)).alias("s")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    both = t.join(s, on, "full_outer")
    cols = []
    for c in target.columns:
        if c in keys or c not in src.columns:
            cols.append((F.when(F.col("_t"), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")) if c in src.columns else F.col(f"t.{c}")).alias(c))
        elif c in update:
            cols.append(F.when(F.col("_s"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            cols.append(F.when(F.col("_t"), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c))
    return both.select(*cols, F.when(F.col("_t").isNull(), "inserted").when(F.col("_s"), "updated").otherwise("kept").alias("disposition"))


def insert_missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Append the source's keys that the target lacks, once each; conflicts do nothing."""
    return target.unionByName(source.dropDuplicates(keys).join(target, keys, "left_anti").select(*target.columns))


class Snapshots:
    """A mutable table as immutable snapshots. A commit writes a new folder, then moves one small pointer file by
    an atomic rename, so a reader sees the whole of a commit or nothing, and a batch that is replayed is skipped."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self) -> dict | None:
        p = self._path(f"{self.root}/_current")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return json.loads(bytes(b & 0xFF for b in stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        at = self._pointer()
        return self.spark.read.parquet(f"{self.root}/{at['folder']}") if at else None

    def commit(self, df: DataFrame, batch_id: int | None = None) -> bool:
        """Make ``df`` the table; False if this batch was committed before."""
        at = self._pointer()
        if batch_id is not None and at is not None and at.get("batch") is not None and at["batch"] >= batch_id:
            return False
        folder = f"snapshot-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        temp = self._path(f"{self.root}/_next-{uuid.uuid4().hex}")
        stream = self._fs.create(temp)
        stream.write(bytearray(json.dumps({"folder": folder, "batch": batch_id if batch_id is not None else (at or {}).get("batch")}).encode()))
        stream.close()
        sc = self.spark.sparkContext
        kind = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        over = sc._gateway.new_array(kind, 1)
        over[0] = kind.OVERWRITE
        files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), sc._jsc.hadoopConfiguration())
        files.rename(temp, self._path(f"{self.root}/_current"), over)
        return True


def subscribed_again(feeds: DataFrame, subscriptions: DataFrame, asked: DataFrame) -> DataFrame:
    """Q26: (url, disposition) of each address asked for: added, reactivated or nothing to do."""
    held = feeds.select("feed_id", "url").join(subscriptions.select("feed_id", "active"), "feed_id", "left")
    state = F.when(F.col("feed_id").isNull(), "added").when(F.coalesce("active", F.lit(False)), "unchanged").otherwise("reactivated")
    return asked.select("url").distinct().join(held, "url", "left").select("url", state.alias("disposition"))
