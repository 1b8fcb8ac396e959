"""Observability queries (G6-G9, G11, G12, F22, F23, S14, S15) and the corpus questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


def silent(records: DataFrame, wanted: Column, at: str, now: Column, hours: int) -> DataFrame:
    """One row if nothing wanted was recorded in the last hours, else none."""
    return records.where(wanted & (F.col(at) > F.timestamp_add("HOUR", F.lit(-hours), now)) & (F.col(at) <= now)).agg(F.count("*").alias("seen")).where("seen = 0")


def overdue(records: DataFrame, wanted: Column, at: str, now: Column, hours: int) -> DataFrame:
    """One row (latest) if the latest wanted record is older than the hours, or there is none."""
    return records.where(wanted).agg(F.max(at).alias("latest")).where(F.col("latest").isNull() | (F.col("latest") < F.timestamp_add("HOUR", F.lit(-hours), now)))


def all_failing(records: DataFrame, key: str, ok: Column) -> DataFrame:
    """Keys that have records, none of them ok (a missing status is not ok)."""
    return records.groupBy(key).agg(F.count("*").alias("records"), F.sum(F.when(ok, 1).otherwise(0)).alias("good")).where("records > 0 and good = 0").select(key, "records")


def bucketed(records: DataFrame, at: str, series: str, value: str, width: str, now: Column) -> DataFrame:
    """(bucket, series, n, total, mean, highest) by fixed-width buckets; the current, partial one is left out."""
    b = records.withColumn("bucket", F.window(at, width)["start"])
    return b.groupBy("bucket", series).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("highest")).where(F.timestamp_add("SECOND", F.lit(_seconds(width)), F.col("bucket")) <= now)


def _seconds(width: str) -> int:
    n, unit = width.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3_600, "day": 86_400}[unit.rstrip("s")]


def top_groups(records: DataFrame, by: Column, name: str, value: str, k: int = 20) -> DataFrame:
    """The largest groups by count, with mean and maximum."""
    g = records.groupBy(by.alias(name)).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("highest"))
    return g.orderBy(F.col("n").desc(), F.col(name).asc_nulls_last()).limit(k)


def attribute(json: str, key: str) -> Column:
    """an attribute of a JSON column, as text."""
    return F.get_json_object(json, f"$.{key}")


def depths(jobs: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Jobs by status, with a row for every known status, be it 0."""
    known = jobs.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return known.join(jobs.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("jobs"))


@dataclass(frozen=True)
class Browser:
    """How a table is listed: its columns (never bodies), what a search looks at, what may be sorted by."""

    columns: tuple[str, ...]
    searchable: tuple[str, ...]
    sortable: tuple[str, ...]
    default_sort: str
    unique: str

    def rows(self, df: DataFrame, search: str = "", sort: str | None = None, descending: bool = False, limit: int = 50) -> DataFrame:
        by = sort if sort in self.sortable else self.default_sort
        hit = F.lit(not search)
        for c in self.searchable if search else ():
            hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(search.lower())), F.lit(False))
        order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
        return df.where(hit).select(*self.columns).orderBy(order, F.col(self.unique)).limit(limit)


def volume(items: DataFrame, at: str) -> DataFrame:
    """Items and distinct addresses for each feed and day."""
    return items.groupBy("feed_id", F.to_date(at).alias("day")).agg(F.count("*").alias("sightings"), F.count_distinct("canonical_url").alias("addresses"))


def cross_feed(items: DataFrame) -> DataFrame:
    """Addresses that more than one feed carries: (canonical_url, feeds, sightings)."""
    return items.where("canonical_url <> ''").groupBy("canonical_url").agg(F.count_distinct("feed_id").alias("feeds"), F.count("*").alias("sightings")).where("feeds > 1")


def cut_articles(versions: DataFrame, readings: DataFrame) -> DataFrame:
    """Versions whose text is a strict prefix of the text of the version they supersede: (version_id, supersedes_id, chars_lost)."""
    from fernglass.operators.reading import fullest_reading

    text = fullest_reading(readings, "version_id").where("body <> ''").select("version_id", "body")
    pairs = versions.where("supersedes_id is not null").select("version_id", "supersedes_id").join(text, "version_id").join(text.select(F.col("version_id").alias("supersedes_id"), F.col("body").alias("old")), "supersedes_id")
    return pairs.where((F.length("old") > F.length("body")) & F.col("old").startswith(F.col("body"))).select("version_id", "supersedes_id", (F.length("old") - F.length("body")).alias("chars_lost"))
