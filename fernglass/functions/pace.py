"""Politeness arithmetic (D1-D12, F21, W5): backoff, schedules, gaps. The clock is always a parameter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Policy:
    """Seconds at least and at most between tries, the factor of the growth, tries before giving up."""

    minimum: float
    maximum: float
    factor: float = 2.0
    give_up: int | None = None


# The archive's policies.
CAPTURE_RETRY = Policy(900, 86_400, 3.0, 5)
HOST_PROBE = Policy(1_800, 86_400, 2.0)
INGEST = Policy(300, 86_400, 2.0, 10)
DEFAULT_INTERVAL = 1_800
SETTLE_SECONDS = 3_600
MIN_GAP = 5.0


def clamp(x: Column, policy: Policy) -> Column:
    """Within the policy, truncated to whole seconds."""
    return F.least(F.greatest(x.cast("double"), F.lit(float(policy.minimum))), F.lit(float(policy.maximum))).cast("int")


def interval(failures: Column, policy: Policy, base: float | None = None) -> Column:
    """clamp(base * factor ^ failures); base is the policy's minimum unless given."""
    return clamp(F.lit(float(policy.minimum if base is None else base)) * F.pow(F.lit(float(policy.factor)), failures), policy)


def plus_seconds(at: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds.cast("int"), at)


def due_at(last: Column, failures: Column, policy: Policy) -> Column:
    """D3: when the next try is due; null if there was no try."""
    return plus_seconds(last, interval(failures, policy))


def next_interval(current: Column, new_items: Column, failures: Column, ttl: Column) -> Column:
    """Seconds to the next poll. Failures back off from the default; else a busy source is visited twice as
    often and an idle one less; a source's own time to live may exceed the ceiling. 0 and null are no interval."""
    usual = F.coalesce(F.when(current != 0, current), F.lit(DEFAULT_INTERVAL)).cast("double")
    calm = clamp(usual * F.when(new_items > 0, 0.5).otherwise(1.5), INGEST)
    return F.greatest(F.when(failures > 0, interval(failures, INGEST, DEFAULT_INTERVAL)).otherwise(calm), F.coalesce(ttl, F.lit(0)))


def retry_after(status: Column, header: Column) -> Column:
    """seconds that a 429 or 503 asks for, within 300 and 86400; 86400 if it gives no number; else null."""
    asked = F.least(F.greatest(header.try_cast("long"), F.lit(300)), F.lit(86_400))
    return F.when(status.isin(429, 503) & header.isNotNull(), F.when(header.try_cast("long").isNull(), F.lit(86_400)).otherwise(asked)).cast("int")


def clamp_future(published: Column, observed: Column) -> Column:
    """A publication date after the sighting is the sighting; null stays null."""
    return F.when(published > observed, observed).otherwise(published)


def settled_by(observed: Column, now: Column, is_root: Column, seconds: int = SETTLE_SECONDS) -> Column:
    """A root counts at once, a later version after an hour of quiet."""
    return is_root | (observed <= F.timestamp_add("SECOND", F.lit(-seconds), now))


def gap_for(crawl_delay: Column, minimum: float = MIN_GAP) -> Column:
    """Seconds between visits to a host."""
    return F.greatest(F.lit(float(minimum)), F.coalesce(crawl_delay, F.lit(0.0)))


def robots_expiry(fetched: Column, status: Column) -> Column:
    """Rules hold a day, a failed read an hour."""
    return plus_seconds(fetched, F.when(status.between(200, 299), 86_400).otherwise(3_600))


def ttl_seconds(ttl_minutes: Column, period: Column, frequency: Column) -> Column:
    """ttl in minutes, else the update period over its frequency; null if neither can be read."""
    hours = F.create_map(*[F.lit(x) for kv in {"hourly": 3_600, "daily": 86_400, "weekly": 604_800, "monthly": 2_592_000, "yearly": 31_536_000}.items() for x in kv])
    by_ttl = F.greatest(F.trim(ttl_minutes).try_cast("int"), F.lit(0)) * 60
    by_ttl = F.when(F.trim(ttl_minutes).try_cast("int").isNotNull(), by_ttl)
    by_period = F.floor(F.try_element_at(hours, F.lower(F.trim(period))) / F.greatest(F.coalesce(F.trim(frequency).try_cast("int"), F.lit(1)), F.lit(1))).cast("int")
    return F.coalesce(by_ttl, by_period)
