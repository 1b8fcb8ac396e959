"""Work found by what is missing (Q1, Q2, Q8-Q15, Q23-Q25, P1, P10, P11, P13, G1, G2): the due sweeps.

Every sweep filters before it limits, orders by a total order, and takes the clock as a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fernglass.functions.pace import CAPTURE_RETRY, INGEST, due_at, settled_by
from fernglass.functions.urls import host_of
from fernglass.operators.latest import heads, top_k, top_k_per_key
from fernglass.operators.runs import feed_failures, gone, host_failures, refusing

MAX_VERSIONS = 5


def subscribed(df: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """The rows whose feed has an active subscription."""
    return df.join(subscriptions.where("active").select("feed_id"), "feed_id", "left_semi")


def due_polls(feeds: DataFrame, subscriptions: DataFrame, polls: DataFrame, hosts: DataFrame, now: Column, limit: int = 50) -> DataFrame:
    """Q1: feeds to poll: subscribed, never gone, not given up, due; the longest due first."""
    live = subscribed(feeds, subscriptions).join(gone(polls), "feed_id", "left_anti").join(feed_failures(polls), "feed_id", "left")
    due = live.where((F.coalesce("run_length", F.lit(0)) < INGEST.give_up) & (F.col("next_poll_at") <= now)).join(hosts.select("host_id", "host_name"), "host_id")
    return top_k(due.select("feed_id", "url", "host_name", "next_poll_at", F.coalesce("run_length", F.lit(0)).alias("failures")), [F.col("next_poll_at").asc_nulls_last(), F.col("feed_id")], limit)


def subscribed_hosts(feeds: DataFrame, subscriptions: DataFrame, polls: DataFrame, hosts: DataFrame) -> DataFrame:
    """Q2: names of the hosts of subscribed feeds that are not gone."""
    return subscribed(feeds, subscriptions).join(gone(polls), "feed_id", "left_anti").join(hosts, "host_id").select("host_name").distinct()


def settled_versions(captures: DataFrame, robots: DataFrame, hosts_refusing: DataFrame) -> DataFrame:
    """Versions that need no capture now: captured, on a refusing host (whatever the outcome), refused by rules
    that have not been read anew, or of unknown rules that are still unknown. A comparison with missing rules is
    neither true nor false, so it settles nothing."""
    c = captures.join(robots.select("host_id", F.col("fetched_at").alias("rules_at")), "host_id", "left").join(hosts_refusing.select("host_id", F.lit(True).alias("refuses")), "host_id", "left")
    done = (F.col("outcome") == "ok") | F.coalesce("refuses", F.lit(False)) | ((F.col("outcome") == "disallowed") & F.coalesce(F.col("fetched_at") > F.col("rules_at"), F.lit(False))) | ((F.col("outcome") == "unknown_rules") & F.col("rules_at").isNull())
    return c.where(done).select("version_id").distinct()


def refusing_hosts(captures: DataFrame, now: Column) -> DataFrame:
    return host_failures(captures).where(refusing(F.col("run_length"), F.col("run_latest"), now)).select("host_id")


def due_captures(versions: DataFrame, subscriptions: DataFrame, captures: DataFrame, robots: DataFrame, hosts: DataFrame, blocked_ids: DataFrame, now: Column, limit: int = 25, rules_before_limit: bool = False) -> DataFrame:
    """Q8: head versions whose page is to be fetched, the longest seen first. ``versions`` has version_id, item_id,
    feed_id, supersedes_id, observed_at and target (the address to fetch).

    As in the archive, hosts without known rules are dropped after the limit; ``rules_before_limit`` repairs that.
    Pages that are gone (404, 410) stay due, as there."""
    counts = versions.groupBy("item_id").agg(F.count("*").alias("version_count"))
    tried = captures.where("outcome = 'failed' and capture_policy = '2'").groupBy("version_id").agg(F.count("*").alias("tries"), F.max("fetched_at").alias("last_try"))
    due = (
        subscribed(heads(versions), subscriptions)
        .join(settled_versions(captures, robots, refusing_hosts(captures, now)), "version_id", "left_anti")
        .join(counts.where(F.col("version_count") <= MAX_VERSIONS), "item_id")
        .join(blocked_ids, "version_id", "left_anti")
        .join(tried, "version_id", "left")
        .where(settled_by(F.col("observed_at"), now, F.col("supersedes_id").isNull()))
        .where(F.col("tries").isNull() | ((F.col("tries") < CAPTURE_RETRY.give_up) & (due_at(F.col("last_try"), F.col("tries"), CAPTURE_RETRY) <= now)))
        .withColumn("host_name", host_of(F.col("target")))
    )
    known = robots.select("host_id").join(hosts.select("host_id", "host_name"), "host_id").select("host_name").where("host_name <> ''").distinct()
    if rules_before_limit:
        due = due.join(known, "host_name", "left_semi")
    first = top_k(due.select("version_id", "item_id", "feed_id", "target", "host_name", "observed_at"), [F.col("observed_at").asc_nulls_last(), F.col("version_id")], limit)
    return first if rules_before_limit else first.join(known, "host_name", "left_semi").select(*first.columns)


def article_hosts(versions: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Q9: the hosts of all versions' addresses of subscribed feeds."""
    return subscribed(versions, subscriptions).select(host_of(F.col("target")).alias("host_name")).where("host_name <> ''").distinct()


def due_extractions(versions: DataFrame, captures: DataFrame, readings: DataFrame, extractor_version: str, limit: int = 25) -> DataFrame:
    """Head versions with a captured page that the current extractor has not read."""
    page = captures.where("outcome = 'ok' and octet_length(body) > 0").select("version_id").distinct()
    read = readings.where((F.col("source") == "page") & (F.col("extractor_version") == extractor_version)).select("version_id").distinct()
    return top_k(heads(versions).join(page, "version_id", "left_semi").join(read, "version_id", "left_anti").select("version_id"), [F.col("version_id")], limit)


def due_feed_extractions(versions: DataFrame, with_text: DataFrame, readings: DataFrame, extractor_version: str, limit: int = 25) -> DataFrame:
    """Q11: head versions with feed text that the current extractor has not read, the newest first."""
    read = readings.where((F.col("source") == "feed") & (F.col("extractor_version") == extractor_version)).select("version_id").distinct()
    due = heads(versions).join(with_text.select("version_id"), "version_id", "left_semi").join(read, "version_id", "left_anti")
    return top_k(due.select("version_id", "observed_at"), [F.col("observed_at").desc_nulls_last(), F.col("version_id").desc()], limit)


def due_feed_captures(versions: DataFrame, parsed: DataFrame, carvings: DataFrame, parser_version: str, limit: int = 50) -> DataFrame:
    """Q12, P10: documents behind a head version that the current parser has not carved, the newest first."""
    carved = carvings.where(F.col("parser_version") == parser_version).select("version_id").distinct()
    due = heads(versions).join(carved, "version_id", "left_anti").join(parsed.select("parsed_id", "document_id"), "parsed_id").select("document_id").distinct()
    return top_k(due, [F.col("document_id").desc()], limit)


def carved(wanted: DataFrame, entries: DataFrame, held: DataFrame) -> DataFrame:
    """Q13: (version_id, text, kept): what each wanted version is stored with: its entry's content, else summary; without
    any text what is held, else nothing. ``entries``: document_id, identity_key, item_no, content, summary."""
    from fernglass.operators.latest import latest_by

    first = entries.groupBy("document_id", "identity_key").agg(F.min_by(F.struct("content", "summary"), "item_no").alias("_e"))
    newest = latest_by(held, ["version_id"], ["captured_at", "capture_id"]).select("version_id", F.col("body").alias("_held"))
    text = F.coalesce(F.nullif(F.col("_e.content"), F.lit("")), F.nullif(F.col("_e.summary"), F.lit("")))
    return wanted.join(first, ["document_id", "identity_key"], "left").join(newest, "version_id", "left").select("version_id", F.coalesce(text, "_held", F.lit("")).alias("text"), (text.isNull()).alias("kept"))


def due_images(slots: DataFrame, role: str, limit: int = 25) -> DataFrame:
    """Q14: slots of a role without a capture."""
    return top_k(slots.where((F.col("role") == role) & F.col("image_capture_id").isNull()), [F.col("slot_id")], limit)


def usable(content_type: str = "content_type", status: str = "status", body: str = "body") -> Column:
    """P5: an image answer that can be shown."""
    return (F.octet_length(body) > 0) & F.col(status).between(200, 299) & F.col(content_type).startswith("image/")


def linked_images(slots: DataFrame, images: DataFrame) -> DataFrame:
    """Q15: each slot with the newest usable capture of its address, if there is one."""
    newest = images.where(usable()).groupBy("url").agg(F.max_by("capture_id", F.struct("fetched_at", "capture_id")).alias("found"))
    return slots.join(newest, "url", "left").select("slot_id", "url", F.coalesce("image_capture_id", "found").alias("image_capture_id"))


def due_encodes(images: DataFrame, spec: str, encoder_version: str, limit: int = 25) -> DataFrame:
    """Usable images of another specification or encoder, the largest first."""
    due = images.where(usable() & (~F.col("spec").eqNullSafe(F.lit(spec)) | ~F.col("encoder_version").eqNullSafe(F.lit(encoder_version))))
    return top_k(due, [F.col("byte_size").desc_nulls_last(), F.col("capture_id")], limit)


def wanting_a_dictionary(bodies: DataFrame, dictionaries: DataFrame, key: str, now: Column, min_samples: int = 20, max_age_days: int = 30, limit: int = 5) -> DataFrame:
    """Keys with enough non-empty bodies and no fresh dictionary, most bodies first."""
    fresh = dictionaries.where(F.col("trained_at") > F.timestamp_add("DAY", F.lit(-max_age_days), now)).select(key).distinct()
    n = bodies.where("octet_length(body) > 0").groupBy(key).agg(F.count("*").alias("samples")).where(F.col("samples") >= min_samples)
    return top_k(n.join(fresh, key, "left_anti"), [F.col("samples").desc(), F.col(key)], limit)


def samples(bodies: DataFrame, key: str, order: list[Column], k: int = 100) -> DataFrame:
    """The newest bodies of each key."""
    return top_k_per_key(bodies.where("octet_length(body) > 0"), [key], order, k)


def stale_hosts(candidates: DataFrame, robots: DataFrame, now: Column, limit: int = 50) -> DataFrame:
    """Q24: hosts whose rules are unknown or have expired, by name. ``robots``: host_name, expires_at."""
    due = candidates.select("host_name").distinct().join(robots.select("host_name", "expires_at"), "host_name", "left").where(F.col("expires_at").isNull() | (F.col("expires_at") <= now))
    return top_k(due.select("host_name"), [F.col("host_name")], limit)


def crawl_delays(candidates: DataFrame, robots: DataFrame) -> DataFrame:
    """Q25: (host_name, crawl_delay_seconds) of the hosts that ask for one."""
    return candidates.select("host_name").distinct().join(robots.where("crawl_delay_seconds is not null").select("host_name", "crawl_delay_seconds"), "host_name")
