"""Views of the driver's tables under the archive's names. Logs that the driver has no table for stand in from
``events``: they have the shape of the archive's logs, not their meaning. Each view has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fernglass.functions.pace import robots_expiry
from fernglass.session import table

NOW = "2025-12-20 12:00:00"
LOG_NOW = "2024-01-31 00:00:00"


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def polls(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    dead = (F.col("event_type") == "click") & (F.col("value") > 90)
    outcome = F.when(F.col("event_type") == "error", "failed").when(dead, "failed").when(F.col("event_type") == "signup", "not_modified").when(F.col("event_type") == "view", "disallowed").otherwise("ok")
    status = F.when(dead, 410).when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 304).when(F.col("event_type") != "view", 200)
    return e.select(F.col("user_id").alias("feed_id"), F.col("ts").alias("polled_at"), F.col("event_id").alias("log_id"), outcome.alias("outcome"), status.alias("status"), F.floor(F.col("value") / 10).cast("int").alias("new_items"))


def captures(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    names = F.create_map(*[F.lit(x) for kv in {"error": "failed", "purchase": "ok", "signup": "unknown_rules", "click": "gone", "view": "disallowed"}.items() for x in kv])
    return e.select(F.col("event_id").alias("version_id"), F.col("event_id").alias("capture_id"), (F.col("user_id") % 60 + 1).alias("host_id"), F.col("ts").alias("fetched_at"), names[F.col("event_type")].alias("outcome"), F.when(F.col("value") >= 5, "2").otherwise("1").alias("capture_policy"))


def robots(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hosts").where(F.col("first_seen_at") < at("2023-12-15 00:00:00"))
    fetched = F.timestamp_add("DAY", F.lit(60), F.col("first_seen_at"))
    return h.select("host_id", "host_name", fetched.alias("fetched_at"), F.lit(200).alias("status"), F.when(F.col("requires_www"), 10.0).alias("crawl_delay_seconds"), robots_expiry(fetched, F.lit(200)).alias("expires_at"))


def subscriptions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feeds").select("feed_id", F.col("last_polled_at").isNotNull().alias("active"))


def versions(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "parsed_items", "parsed_id", "url", "canonical_url")
    v = table(spark, d, "item_versions", "version_id", "item_id", "feed_id", "parsed_id", "supersedes_id", "observed_at", "title")
    return v.join(items, "parsed_id", "left").withColumn("target", F.coalesce(F.nullif("canonical_url", F.lit("")), "url"))


def page_captures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pending_pages", "capture_id", "version_id", "body", "fetched_at", "final_url").withColumn("outcome", F.lit("ok"))


def rules(spark: SparkSession, d: str) -> DataFrame:
    """Every tag of an item is a global title rule; every host name that needs www a rule on the addresses of its feeds."""
    tags = table(spark, d, "parsed_items", "tags").select(F.explode("tags").alias("pattern")).distinct()
    own = table(spark, d, "feeds", "feed_id", "host_id").join(table(spark, d, "hosts").where("requires_www"), "host_id")
    return tags.select(F.lit("title_phrase").alias("dimension"), "pattern", F.lit(True).alias("blocks"), F.lit(None).cast("long").alias("feed_id")).unionByName(own.select(F.lit("url_pattern").alias("dimension"), F.col("host_name").alias("pattern"), F.lit(True).alias("blocks"), "feed_id"))


SQL = {
    "polls": """polls as (select user_id as feed_id, ts as polled_at, event_id as log_id,
        case when event_type = 'error' or (event_type = 'click' and value > 90) then 'failed' when event_type = 'signup' then 'not_modified'
             when event_type = 'view' then 'disallowed' else 'ok' end as outcome,
        case when event_type = 'click' and value > 90 then 410 when event_type = 'error' then 500 when event_type = 'signup' then 304
             when event_type <> 'view' then 200 end as status, cast(floor(value / 10) as integer) as new_items from events)""",
    "captures": """captures as (select event_id as version_id, event_id as capture_id, user_id % 60 + 1 as host_id, ts as fetched_at,
        case event_type when 'error' then 'failed' when 'purchase' then 'ok' when 'signup' then 'unknown_rules' when 'click' then 'gone'
             when 'view' then 'disallowed' end as outcome, case when value >= 5 then '2' else '1' end as capture_policy from events)""",
    "robots": """robots as (select host_id, host_name, first_seen_at + interval 60 day as fetched_at, 200 as status,
        case when requires_www then 10.0 end as crawl_delay_seconds, first_seen_at + interval 61 day as expires_at
        from hosts where first_seen_at < timestamp '2023-12-15 00:00:00')""",
    "subscriptions": "subscriptions as (select feed_id, last_polled_at is not null as active from feeds)",
    "versions": """versions as (select v.version_id, v.item_id, v.feed_id, v.parsed_id, v.supersedes_id, v.observed_at, v.title, p.url,
        coalesce(nullif(p.canonical_url, ''), p.url) as target from item_versions v left join parsed_items p using (parsed_id))""",
    "rules": """rules as (select distinct 'title_phrase' as dimension, unnest(tags) as pattern, true as blocks, cast(null as bigint) as feed_id from parsed_items
        union all select 'url_pattern', h.host_name, true, f.feed_id from feeds f join hosts h using (host_id) where h.requires_www)""",
}


def ctes(*names: str) -> str:
    return "with " + ",\n".join(SQL[n] for n in names)
