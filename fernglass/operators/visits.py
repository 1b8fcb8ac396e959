"""What a visit came to (P4, P6, P12, Q7, Q16, Q17, Q28, S2, S8, A6): outcome ladders over answers as rows.

Answers arrive as a DataFrame (url, final_url, status, headers, body, error); nothing here opens a connection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fernglass.functions.pace import INGEST, next_interval, plus_seconds, retry_after
from fernglass.functions.urls import host_of

ROBOTS_CAP = 512 * 1024
PAGE_TYPES = ("text/html", "application/xhtml+xml")


def capture_outcome(status: Column, error: Column) -> Column:
    """Of a page: failed without an answer, ok, gone (404, 410), else failed."""
    return F.when(error.isNotNull() | status.isNull(), "failed").when(status.between(200, 299), "ok").when(status.isin(404, 410), "gone").otherwise("failed")


def capture_ladder(jobs: DataFrame) -> DataFrame:
    """Q17: jobs (rules_known, allowed, host_refuses, status, error, target, final_url, redirect_known, redirect_allowed)
    with the outcome that is recorded: unknown rules, disallowed, refused, then what the answer says; a redirect to
    another host must be allowed by that host's known rules."""
    elsewhere = host_of(F.col("final_url")) != host_of(F.col("target"))
    after = F.when(elsewhere & ~F.coalesce("redirect_known", F.lit(False)), "unknown_rules").when(elsewhere & ~F.coalesce("redirect_allowed", F.lit(False)), "disallowed")
    outcome = (
        F.when(~F.col("rules_known"), "unknown_rules")
        .when(~F.col("allowed"), "disallowed")
        .when(F.col("host_refuses"), "refused")
        .otherwise(F.coalesce(F.when(F.col("status").between(200, 299), after), capture_outcome(F.col("status"), F.col("error"))))
    )
    return jobs.withColumn("outcome", outcome)


def poll_outcome(status: Column, error: Column, allowed: Column) -> Column:
    """Q7: of a feed: disallowed, failed, not modified, ok."""
    return F.when(~F.coalesce(allowed, F.lit(True)), "disallowed").when(error.isNotNull() | status.isNull(), "failed").when(status == 304, "not_modified").when(status.between(200, 299), "ok").otherwise("failed")


def rescheduled(answers: DataFrame) -> DataFrame:
    """Each poll's outcome and the time of the next. ``answers``: feed_id, polled_at, last_polled_at,
    next_poll_at, status, error, allowed, new_items, failures (before this poll), ttl_seconds, retry_header."""
    a = answers.withColumn("outcome", poll_outcome(F.col("status"), F.col("error"), F.col("allowed")))
    before = F.timestamp_diff("SECOND", F.col("last_polled_at"), F.col("next_poll_at"))
    run = F.when(F.col("outcome") == "failed", F.col("failures") + 1).otherwise(0)
    wait = F.when(F.col("outcome") == "disallowed", INGEST.maximum).otherwise(
        F.coalesce(F.when(F.col("outcome") == "failed", retry_after(F.col("status"), F.col("retry_header"))), next_interval(before, F.col("new_items"), run, F.when(F.col("outcome") != "failed", F.col("ttl_seconds"))))
    )
    return a.withColumn("wait_seconds", wait.cast("int")).withColumn("next_due_at", plus_seconds(F.col("polled_at"), wait))


def accepted(answers: DataFrame, cap_bytes: int = 16 * 1024 * 1024, types: tuple[str, ...] = PAGE_TYPES) -> DataFrame:
    """Answers with the source's own refusals as errors: wrong type of content, too large."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(F.try_element_at(F.col("headers"), F.lit("content-type")), F.lit("")), ";", 1)))
    refused = F.when((F.col("status") < 300) & ~kind.isin(*types), "wrong content type").when(F.octet_length("body") > cap_bytes, "too large")
    return answers.withColumn("error", F.coalesce("error", refused))


def robots_read(answers: DataFrame) -> DataFrame:
    """Rules as read: a redirect to another host is no answer; the body is cut at 512 KiB; they hold a day, or an hour."""
    moved = F.col("error").isNull() & (host_of(F.col("final_url")) != host_of(F.col("url")))
    good = F.col("error").isNull() & ~moved & F.col("status").between(200, 299)
    return answers.select(
        host_of(F.col("url")).alias("host_name"),
        F.when(good, F.expr(f"substring(body, 1, {ROBOTS_CAP})")).otherwise(F.lit(b"")).alias("body"),
        "status",
        F.when(moved, "redirected to another host").otherwise(F.col("error")).alias("error"),
        "fetched_at",
        plus_seconds(F.col("fetched_at"), F.when(good, 86_400).otherwise(3_600)).alias("expires_at"),
    )


def held_once(captures: DataFrame) -> DataFrame:
    """Q16: each (url, body hash) is stored once: every capture with the first capture that holds its bytes."""
    first = captures.groupBy("url", "body_hash").agg(F.min("capture_id").alias("holder_id"))
    return captures.join(first, ["url", "body_hash"]).select("capture_id", "url", "holder_id")


def backfilled_outcome(status: Column, error: Column) -> Column:
    """Q28: the outcome of old rows that recorded only a status."""
    return F.when(error.startswith("disallowed"), "disallowed").otherwise(capture_outcome(status, F.when(error != "", error)))
