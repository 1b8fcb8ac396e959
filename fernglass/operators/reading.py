"""Which stored text a reader is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fernglass.operators.latest import latest_by

PREFERENCE = ("feed", "page")


def _rank(source: Column) -> Column:
    out = F.lit(len(PREFERENCE))
    for i, s in reversed(list(enumerate(PREFERENCE))):
        out = F.when(source == s, i).otherwise(out)
    return out


def fullest_reading(readings: DataFrame, key: str, entities: DataFrame | None = None) -> DataFrame:
    """Q18, Q19: (key, source, body): of the newest reading of each source the longest; of equals the feed's, then
    the page's, then any other's. Entities without a reading have ''. ``key`` is the version, or the item for the
    reading across its versions."""
    newest = latest_by(readings.select(key, "source", "created_at", "extraction_id", "body"), [key, "source"], ["created_at", "extraction_id"])
    order = F.struct(F.length(F.coalesce("body", F.lit(""))), -_rank(F.col("source")), F.col("extraction_id"))
    best = newest.groupBy(key).agg(F.max_by(F.struct("source", "body"), order).alias("_r")).select(key, F.col("_r.source").alias("source"), F.coalesce(F.col("_r.body"), F.lit("")).alias("body"))
    if entities is None:
        return best
    return entities.select(key).join(best, key, "left").select(key, "source", F.coalesce("body", F.lit("")).alias("body"))


def current_extraction(readings: DataFrame, versions: DataFrame) -> DataFrame:
    """The newest reading of any version of each item."""
    return latest_by(readings.join(versions.select("version_id", "item_id"), "version_id"), ["item_id"], ["created_at", "extraction_id"])


def has_feed_text(carvings: DataFrame) -> DataFrame:
    """Versions whose newest carving holds any bytes."""
    newest = carvings.groupBy("version_id").agg(F.max_by(F.octet_length("body"), F.struct("captured_at", "capture_id")).alias("_n"))
    return newest.where(F.coalesce("_n", F.lit(0)) > 0).select("version_id")


def source_ratio(readings: DataFrame) -> DataFrame:
    """(version_id, feed_chars, page_chars, ratio): how much more a page's newest reading holds than the feed's."""
    newest = latest_by(readings, ["version_id", "source"], ["created_at", "extraction_id"])
    wide = newest.groupBy("version_id").pivot("source", list(PREFERENCE)).agg(F.max("char_count"))
    return wide.where("feed is not null and page is not null").select("version_id", F.col("feed").alias("feed_chars"), F.col("page").alias("page_chars"), F.round(F.col("page") / F.nullif(F.col("feed"), F.lit(0)), 4).alias("ratio"))
