"""Latest-per-key, chains and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fernglass.functions.pace import gap_for


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of every key, by a total order (all of ``order``, largest last; nulls are oldest).

    row_number() = 1 prunes within each partition before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows; one heap for each partition. ``order`` must end with a unique key."""
    return df.orderBy(*order).limit(k)


def top_k_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of every key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def heads(versions: DataFrame, key: str = "version_id", before: str = "supersedes_id") -> DataFrame:
    """Versions that no version supersedes (a root without successors is a head too)."""
    later = versions.where(F.col(before).isNotNull()).select(F.col(before).alias(key)).distinct()
    return versions.join(later, key, "left_anti")


def revisions(versions: DataFrame, item: str = "item_id", key: str = "version_id") -> DataFrame:
    """Each version's number, the one before it and its item's count of versions."""
    w = Window.partitionBy(item).orderBy(key)
    return versions.withColumn("revision", F.row_number().over(w)).withColumn("previous_id", F.lag(key).over(w)).withColumn("version_count", F.count("*").over(Window.partitionBy(item)))


def chain_violations(versions: DataFrame) -> DataFrame:
    """(version_id, fault): versions that break the chain's checks."""
    v = versions.select("version_id", "item_id", "supersedes_id")
    w = Window.partitionBy("item_id")
    roots = F.count_if(F.col("supersedes_id").isNull()).over(w)
    v = v.withColumn("roots", roots)
    # roots have no version before them: they are neither counted nor joined by that null
    later = v.where("supersedes_id is not null")
    twice = later.groupBy("supersedes_id").agg(F.count("*").alias("twice"))
    parents = v.select(F.col("version_id").alias("supersedes_id"), F.col("item_id").alias("parent_item"))
    none = v.where("supersedes_id is null").withColumn("twice", F.lit(0).cast("long")).withColumn("parent_item", F.lit(None).cast("long"))
    checked = later.join(twice, "supersedes_id").join(parents, "supersedes_id", "left").unionByName(none)
    fault = (
        F.when(F.col("supersedes_id") >= F.col("version_id"), "not after the version it supersedes")
        .when((F.col("supersedes_id").isNotNull()) & (F.col("twice") > 1), "supersedes a version twice")
        .when(F.col("supersedes_id").isNotNull() & F.col("parent_item").isNull(), "supersedes no version")
        .when(F.col("parent_item") != F.col("item_id"), "supersedes another item")
        .when(F.col("roots") != 1, "not one root")
    )
    return checked.withColumn("fault", fault).where("fault is not null").select("version_id", "fault")


def staggered(jobs: DataFrame, host: str, order: list[str], crawl_delay: str) -> DataFrame:
    """``delay`` in seconds: the nth job on its host waits n - 1 gaps."""
    n = F.row_number().over(Window.partitionBy(host).orderBy(*order))
    return jobs.withColumn("delay", (n - 1) * gap_for(F.col(crawl_delay)))
