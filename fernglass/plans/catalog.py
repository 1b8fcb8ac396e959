"""The named queries over the archive's tables (everything outside ``llm``)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fernglass.functions import pace, texts, urls
from fernglass.operators import changes, latest, observe, reading, rules, runs, sweeps, upsert, visits
from fernglass.operators.instants import instants
from fernglass.plans import views
from fernglass.plans.views import LOG_NOW, NOW, at, ctes
from fernglass.session import shared_dir, table
from fernglass.sources import article, codec, discovery, feeds, opml, robots
from fernglass.streaming import logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every published_at, updated_at and published_claim that denotes an instant (problem 2)."""
    zones = table(spark, sf_dir, "feeds", "feed_id", "time_zone")
    items = table(spark, sf_dir, "parsed_items", "parsed_id", "feed_id", "published_at", "updated_at").join(zones, "feed_id", "left")
    versions = table(spark, sf_dir, "item_versions", "version_id", "feed_id").join(zones, "feed_id", "left")
    claims = table(spark, sf_dir, "articles", "extraction_id", "version_id", "published_claim").join(versions, "version_id", "left")
    return instants(items, ["published_at", "updated_at"], "parsed_id", "time_zone").unionByName(instants(claims, ["published_claim"], "extraction_id", "time_zone"))


# --- logs: tail runs, health -------------------------------------------------------------------------------------


@query
def feed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every polled feed with its run of failures, whether it is gone, and its last outcome."""
    log = views.polls(spark, sf_dir)
    out = runs.health(log.select("feed_id").distinct(), log, "feed_id", "polled_at", F.col("outcome") == "failed", F.col("outcome") != "failed")
    return out.select("feed_id", "run_length", "run_latest", "gone", "last_outcome", "visits")


SQL["feed_health"] = (
    ctes("polls")
    + """ select f.feed_id,
    (select count(*) from polls p where p.feed_id = f.feed_id and p.outcome = 'failed' and p.polled_at > coalesce((select max(q.polled_at) from polls q where q.feed_id = f.feed_id and q.outcome <> 'failed'), timestamp '1900-01-01')) as run_length,
    (select max(polled_at) from polls p where p.feed_id = f.feed_id and p.outcome = 'failed' and p.polled_at > coalesce((select max(q.polled_at) from polls q where q.feed_id = f.feed_id and q.outcome <> 'failed'), timestamp '1900-01-01')) as run_latest,
    exists (select 1 from polls p where p.feed_id = f.feed_id and p.status = 410) as gone,
    (select outcome from polls p where p.feed_id = f.feed_id order by polled_at desc, log_id desc limit 1) as last_outcome,
    (select count(*) from polls p where p.feed_id = f.feed_id) as visits
    from (select distinct feed_id from polls) f"""
)


@query
def host_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts with a run of failed captures under the current policy, and whether they are left alone now."""
    f = runs.host_failures(views.captures(spark, sf_dir))
    return f.select("host_id", "run_length", "run_latest", runs.refusing(F.col("run_length"), F.col("run_latest"), at(LOG_NOW), 3).alias("refusing"))


SQL["host_failures"] = (
    ctes("captures")
    + """, now2 as (select * from captures where capture_policy = '2'),
    r as (select host_id, max(fetched_at) as reset_at from now2 where outcome = 'ok' group by 1),
    t as (select c.host_id, count(*) as run_length, max(c.fetched_at) as run_latest from now2 c left join r using (host_id)
          where c.outcome = 'failed' and (r.reset_at is null or c.fetched_at > r.reset_at) group by 1)
    select host_id, run_length, run_latest, run_length >= 3 and run_latest + to_seconds(cast(least(greatest(1800 * power(2, run_length - 3), 1800), 86400) as integer)) > timestamp '2024-01-31 00:00:00' as refusing from t"""
)


@query
def tail_run_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 in one shuffle: runs of errors since each user's last purchase; other events are stepped over."""
    e = table(spark, sf_dir, "events", "user_id", "ts", "event_type")
    return runs.tail_run(e, "user_id", "ts", F.col("event_type") == "error", F.col("event_type") == "purchase")


SQL["tail_run_window"] = """select user_id, count(*) as run_length, max(ts) as run_latest from events e where event_type = 'error'
    and not exists (select 1 from events r where r.user_id = e.user_id and r.event_type = 'purchase' and r.ts >= e.ts) group by 1"""


# --- chains ------------------------------------------------------------------------------------------------------


@query
def head_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that nothing supersedes."""
    return latest.heads(table(spark, sf_dir, "item_versions", "version_id", "item_id", "supersedes_id")).select("version_id", "item_id")


SQL["head_versions"] = "select version_id, item_id from item_versions v where not exists (select 1 from item_versions w where w.supersedes_id = v.version_id)"


@query
def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revision numbers, previous versions and counts."""
    return latest.revisions(table(spark, sf_dir, "item_versions", "version_id", "item_id")).select("version_id", "item_id", F.col("revision").cast("long").alias("revision"), "previous_id", "version_count")


SQL["revisions"] = """select version_id, item_id, row_number() over (partition by item_id order by version_id) as revision,
    lag(version_id) over (partition by item_id order by version_id) as previous_id, count(*) over (partition by item_id) as version_count from item_versions"""


@query
def chain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that break the chain's checks; the archive's own do not, so some are given a wrong predecessor."""
    v, one = table(spark, sf_dir, "item_versions", "version_id", "item_id", "supersedes_id"), F.col("version_id")
    wrong = F.when(one % 40 == 7, one + 1).when(one % 40 == 9, one - 8).when(one % 40 == 11, one - 10).when(one % 40 == 13, F.lit(-1)).when(one % 40 == 15, F.lit(None)).otherwise(F.col("supersedes_id"))
    return latest.chain_violations(v.withColumn("supersedes_id", wrong))


SQL["chain_violations"] = """with w as (select version_id, item_id, case version_id % 40 when 7 then version_id + 1 when 9 then version_id - 8 when 11 then version_id - 10 when 13 then -1
      when 15 then null else supersedes_id end as supersedes_id from item_versions), c as (select v.*, p.item_id as parent_item, count(*) filter (v.supersedes_id is null) over (partition by v.item_id) as roots,
      count(v.supersedes_id) over (partition by v.supersedes_id) as twice from w v left join w p on p.version_id = v.supersedes_id)
    select version_id, fault from (select version_id, case when supersedes_id >= version_id then 'not after the version it supersedes'
      when supersedes_id is not null and twice > 1 then 'supersedes a version twice' when supersedes_id is not null and parent_item is null then 'supersedes no version'
      when parent_item <> item_id then 'supersedes another item' when roots <> 1 then 'not one root' end as fault from c) where fault is not null"""


@query
def current_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: every item's head with its hash and canonical address."""
    v = changes.current_versions(table(spark, sf_dir, "item_versions"), table(spark, sf_dir, "parsed_items", "parsed_id", "canonical_url"))
    return v.select("feed_id", "item_id", "version_id", F.lower(F.hex("content_hash")).alias("content_hash"), "canonical_url")


SQL["current_versions"] = """select v.feed_id, v.item_id, v.version_id, lower(hex(v.content_hash)) as content_hash, p.canonical_url from item_versions v
    left join parsed_items p using (parsed_id) where v.version_id not in (select supersedes_id from item_versions where supersedes_id is not null)"""


# --- change detection --------------------------------------------------------------------------------------------


@query
def changed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed documents that differ from the one before of their feed."""
    docs = table(spark, sf_dir, "parsed_feeds", "document_id", "feed_id", "fetched_at", "title", "description", "ok")
    hashed = texts.fingerprint(F.col("title"), F.col("description"), F.col("ok").cast("string"))
    return changes.changed_from_previous(docs, "feed_id", ["fetched_at", "document_id"], hashed).select("document_id", "feed_id")


_NORMAL = "trim(regexp_replace(regexp_replace(coalesce({0}, ''), '<!--.*?-->', '', 'gs'), '[\\s\\x{{a0}}\\x{{85}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{1c}}-\\x{{1f}}\\x{{b}}]+', ' ', 'g'))"
SQL["changed_documents"] = (
    "with d as (select document_id, feed_id, "
    + " || chr(31) || ".join(_NORMAL.format(c) for c in ("title", "description", "cast(ok as varchar)"))
    + " as h, fetched_at from parsed_feeds), e as (select *, lag(h) over (partition by feed_id order by fetched_at, document_id) as b from d) select document_id, feed_id from e where b is null or b <> h"
)


@query
def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity, tier and fingerprint of every parsed item."""
    return changes.sightings(table(spark, sf_dir, "parsed_items")).select("parsed_id", "identity_key", "tier", "fingerprint")


_FILES = "list_sort(list_transform(coalesce(enclosures, []), lambda e: coalesce(e.length, '') || chr(31) || coalesce(e.type, '') || chr(31) || coalesce(e.url, '')))"
_SIGHTINGS = (
    "select parsed_id, document_id, feed_id, item_no, observed_at, canonical_url, case when coalesce(guid, '') <> '' then guid when coalesce(canonical_url, '') <> '' then canonical_url else sha256(coalesce(title, '') || chr(31) || coalesce(published_at, '') || chr(31) || coalesce(summary, '') || chr(31)) end as identity_key, "
    "case when coalesce(guid, '') <> '' then 'guid' when coalesce(canonical_url, '') <> '' then 'link' else 'hash' end as tier, sha256("
    + " || chr(31) || ".join([_NORMAL.format(c) for c in ("title", "author", "canonical_url", "summary", "content", "comments_url", "published_at", "updated_at", "array_to_string(coalesce(tags, []), chr(30))", f"array_to_string({_FILES}, chr(30))")])
    + " || chr(31)) as fingerprint from parsed_items"
)
SQL["sightings"] = f"select parsed_id, identity_key, tier, fingerprint from ({_SIGHTINGS})"


@query
def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each sighting of an item was: new, version, unchanged or duplicate; and churn."""
    return changes.dispositions(changes.sightings(table(spark, sf_dir, "parsed_items"))).select("parsed_id", "disposition", "churn")


_DISPOSED = f"""with s as ({_SIGHTINGS}), f as (select *, row_number() over (partition by feed_id, document_id, identity_key order by item_no, parsed_id) as n from s),
    k as (select *, lag(fingerprint) over (partition by feed_id, identity_key order by observed_at, document_id, parsed_id) as before from f where n = 1),
    d as (select *, case when before is null then 'new' when before = fingerprint then 'unchanged' else 'version' end as disposition from k),
    sp as (select feed_id, canonical_url, identity_key, observed_at, document_id,
        lead(observed_at) over w as to_at, lead(document_id) over w as to_doc from d where disposition <> 'unchanged' window w as (partition by feed_id, identity_key order by observed_at, document_id)),
    m as (select d.feed_id, d.parsed_id, d.tier, d.disposition, d.disposition = 'new' and coalesce(d.canonical_url, '') <> '' and exists (select 1 from sp where sp.feed_id = d.feed_id and sp.canonical_url = d.canonical_url
        and sp.identity_key <> d.identity_key and (sp.observed_at, sp.document_id) < (d.observed_at, d.document_id) and (sp.to_at is null or (sp.to_at, sp.to_doc) >= (d.observed_at, d.document_id))) as churn from d
        union all select feed_id, parsed_id, tier, 'duplicate', false from f where n > 1)"""
SQL["dispositions"] = _DISPOSED + " select parsed_id, disposition, churn from m"


@query
def disposition_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of an ingest, by feed."""
    return changes.tally(changes.dispositions(changes.sightings(table(spark, sf_dir, "parsed_items"))), "feed_id")


SQL["disposition_tally"] = (
    _DISPOSED
    + """ select feed_id, count(*) filter (disposition = 'new') as new_items, count(*) filter (disposition = 'version') as new_versions,
    count(*) filter (disposition = 'unchanged') as unchanged, count(*) filter (disposition = 'duplicate') as duplicate_identity, count(*) filter (churn) as guid_churn from m group by 1"""
)


@query
def refreshed_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: feeds after their newest readable document."""
    return changes.refreshed(table(spark, sf_dir, "feeds"), table(spark, sf_dir, "parsed_feeds"))


SQL["refreshed_feeds"] = """with l as (select * from (select *, row_number() over (partition by feed_id order by fetched_at desc, document_id desc) as n from parsed_feeds where ok) where n = 1)
    select f.feed_id, coalesce(nullif(f.title, ''), l.title) as title, coalesce(nullif(l.site_url, ''), f.site_url) as site_url, coalesce(nullif(l.platform, ''), f.platform) as platform,
    coalesce(nullif(l.hub_url, ''), f.hub_url) as hub_url, coalesce(l.ttl_seconds, f.ttl_seconds) as ttl_seconds from feeds f left join l using (feed_id)"""


@query
def identity_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus question: how items are told apart, by feed."""
    return changes.sightings(table(spark, sf_dir, "parsed_items")).groupBy("feed_id", "tier").agg(F.count_distinct("identity_key").alias("items"), F.count("*").alias("sightings"))


SQL["identity_tiers"] = f"select feed_id, tier, count(distinct identity_key) as items, count(*) as sightings from ({_SIGHTINGS}) group by 1, 2"


# --- addresses ---------------------------------------------------------------------------------------------------


@query
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """items' addresses in canonical form."""
    return table(spark, sf_dir, "parsed_items", "parsed_id", "url").select("parsed_id", urls.canonical_url(F.col("url")).alias("canonical"))


_TRACKED = " or ".join([f"starts_with(lower(split_part(p, '=', 1)), '{x}')" for x in urls.TRACKING_PREFIXES] + ["lower(split_part(p, '=', 1)) in (" + ", ".join(f"'{x}'" for x in urls.TRACKING_NAMES) + ")"])
SQL["canonical_urls"] = f"""with u as (select parsed_id, trim(coalesce(url, '')) as u from parsed_items),
    s as (select *, regexp_extract(u, '^([A-Za-z]+)://', 1) as scheme, regexp_replace(regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1), '^www\\.', '') as host,
      rtrim(regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/') as path, list_sort(list_filter(string_split(regexp_extract(u, '\\?([^#]*)', 1), '&'), lambda p: p <> '' and not ({_TRACKED}))) as q from u)
    select parsed_id, case when u = '' then '' when host = '' then u else lower(scheme) || '://' || lower(host) || case when path = '' then '/' else path end
      || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end end as canonical from s"""


@query
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, their www form and their locks."""
    f = table(spark, sf_dir, "feeds", "feed_id", "url")
    host = urls.host_of(F.col("url"))
    return f.select("feed_id", host.alias("host"), urls.with_www(F.col("url")).alias("www_url"), urls.host_lock(host).alias("lock"))


SQL["url_hosts"] = """select feed_id, h as host, case when regexp_matches(url, '^https?://www\\.') then url else regexp_replace(url, '^(https?://)', '\\1www.') end as www_url, 'host:' || h as lock
    from (select feed_id, url, regexp_replace(regexp_extract(lower(url), '^https?://([^:/?#]+)', 1), '^www\\.', '') as h from feeds)"""


@query
def cross_feed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus question: addresses that several feeds carry."""
    return observe.cross_feed(table(spark, sf_dir, "parsed_items", "feed_id", "canonical_url"))


SQL["cross_feed_addresses"] = "select canonical_url, count(distinct feed_id) as feeds, count(*) as sightings from parsed_items where canonical_url <> '' group by 1 having count(distinct feed_id) > 1"


@query
def daily_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus question: sightings and addresses by feed and day."""
    return observe.volume(table(spark, sf_dir, "parsed_items", "feed_id", "canonical_url", "observed_at"), "observed_at")


SQL["daily_volume"] = "select feed_id, cast(observed_at as date) as day, count(*) as sightings, count(distinct canonical_url) as addresses from parsed_items group by 1, 2"


# --- bodies ------------------------------------------------------------------------------------------------------


@query
def body_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters, paragraphs, links, link density and the verdict of every article body."""
    a = table(spark, sf_dir, "articles", "extraction_id", "body")
    b = a.select("extraction_id", texts.char_count(F.col("body")).cast("long").alias("chars"), texts.paragraph_count(F.col("body")).cast("long").alias("paragraphs"), F.size(texts.links(F.coalesce("body", F.lit("")))).cast("long").alias("links"), texts.link_density(F.col("body")).alias("density"))
    return b.select("*", texts.judge(F.col("chars"), F.col("paragraphs"))["note"].alias("note"))


SQL["body_measures"] = """with b as (select extraction_id, length(coalesce(body, '')) as chars,
      len(list_filter(string_split(coalesce(body, ''), chr(10) || chr(10)), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g')) <> '')) as paragraphs,
      regexp_extract_all(coalesce(body, ''), '\\[([^\\]\\n]*)\\]\\((https?://[^)\\s]+)\\)', 1) as anchors from articles)
    select extraction_id, chars, paragraphs, len(anchors) as links, case when chars = 0 then 0.0 else coalesce(round_even(cast(coalesce(list_sum(list_transform(anchors, lambda x: length(x))), 0) as double) / chars, 4), 0.0) end as density,
      case when chars = 0 then 'nothing extracted' when chars < 500 then 'too short' when paragraphs < 3 then 'too few paragraphs' else '' end as note from b"""


@query
def reading_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q18: the text that a reader of each version is shown."""
    r = table(spark, sf_dir, "articles", "extraction_id", "version_id", "source", "created_at", "body")
    return reading.fullest_reading(r, "version_id").select("version_id", "source", F.length("body").cast("long").alias("chars"))


_READ = """with n as (select *, row_number() over (partition by {0}, source order by created_at desc, extraction_id desc) as n from {1}),
    b as (select *, row_number() over (partition by {0} order by length(coalesce(body, '')) desc, case source when 'feed' then 0 when 'page' then 1 else 2 end, extraction_id desc) as m from n where n = 1)
    select {0}, source, length(coalesce(body, '')) as chars from b where m = 1"""
SQL["reading_bodies"] = _READ.format("version_id", "articles")


@query
def reading_bodies_of_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q19: the text that a reader of each item is shown, across its versions."""
    r = table(spark, sf_dir, "articles", "extraction_id", "version_id", "source", "created_at", "body").join(table(spark, sf_dir, "item_versions", "version_id", "item_id"), "version_id")
    return reading.fullest_reading(r, "item_id").select("item_id", "source", F.length("body").cast("long").alias("chars"))


SQL["reading_bodies_of_items"] = _READ.format("item_id", "(select a.*, v.item_id from articles a join item_versions v using (version_id))")


@query
def current_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q20: the newest reading of any version of each item."""
    return reading.current_extraction(table(spark, sf_dir, "articles", "extraction_id", "version_id", "created_at", "source"), table(spark, sf_dir, "item_versions", "version_id", "item_id")).select("item_id", "extraction_id", "version_id", "source")


SQL["current_extractions"] = """select item_id, extraction_id, version_id, source from (select v.item_id, a.*, row_number() over (partition by v.item_id order by a.created_at desc, a.extraction_id desc) as n
    from articles a join item_versions v using (version_id)) where n = 1"""


@query
def source_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page's text against the feed's, of items that have both (their newest readings)."""
    r = table(spark, sf_dir, "articles", "extraction_id", "version_id", "source", "created_at", "char_count").join(table(spark, sf_dir, "item_versions", "version_id", "item_id"), "version_id")
    return reading.source_ratio(r.drop("version_id").withColumnRenamed("item_id", "version_id")).withColumnRenamed("version_id", "item_id")


SQL["source_ratios"] = """with n as (select v.item_id, a.source, a.char_count, row_number() over (partition by v.item_id, a.source order by a.created_at desc, a.extraction_id desc) as n from articles a join item_versions v using (version_id))
    select f.item_id, f.char_count as feed_chars, p.char_count as page_chars, round(cast(p.char_count as double) / nullif(f.char_count, 0), 4) as ratio
    from n f join n p using (item_id) where f.n = 1 and p.n = 1 and f.source = 'feed' and p.source = 'page' and f.char_count is not null and p.char_count is not null"""


@query
def cut_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus question: versions whose text is a strict prefix of what they supersede."""
    return observe.cut_articles(table(spark, sf_dir, "item_versions"), table(spark, sf_dir, "articles", "extraction_id", "version_id", "source", "created_at", "body")).withColumn("chars_lost", F.col("chars_lost").cast("long"))


SQL["cut_articles"] = """with n as (select *, row_number() over (partition by version_id, source order by created_at desc, extraction_id desc) as n from articles),
    b as (select version_id, body from (select *, row_number() over (partition by version_id order by length(coalesce(body, '')) desc, case source when 'feed' then 0 when 'page' then 1 else 2 end, extraction_id desc) as m from n where n = 1) where m = 1 and body <> '')
    select v.version_id, v.supersedes_id, length(o.body) - length(b.body) as chars_lost from item_versions v join b using (version_id) join b o on o.version_id = v.supersedes_id where length(o.body) > length(b.body) and starts_with(o.body, b.body)"""


# --- due sweeps --------------------------------------------------------------------------------------------------


@query
def due_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1, O1: feeds to poll now."""
    return sweeps.due_polls(table(spark, sf_dir, "feeds"), views.subscriptions(spark, sf_dir), views.polls(spark, sf_dir), table(spark, sf_dir, "hosts"), at(NOW))


_RUNS = """r as (select feed_id, max(polled_at) as reset_at from polls where outcome <> 'failed' group by 1),
    run as (select p.feed_id, count(*) as failures from polls p left join r using (feed_id) where p.outcome = 'failed' and (r.reset_at is null or p.polled_at > r.reset_at) group by 1)"""
SQL["due_polls"] = (
    ctes("polls", "subscriptions")
    + f""", {_RUNS} select f.feed_id, f.url, h.host_name, f.next_poll_at, coalesce(run.failures, 0) as failures from feeds f join hosts h using (host_id) left join run using (feed_id)
    where exists (select 1 from subscriptions s where s.feed_id = f.feed_id and s.active) and not exists (select 1 from polls p where p.feed_id = f.feed_id and p.status = 410)
      and coalesce(run.failures, 0) < 10 and f.next_poll_at <= timestamp '2025-12-20 12:00:00' order by f.next_poll_at nulls last, f.feed_id limit 50"""
)


@query
def subscribed_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: hosts of subscribed feeds that are not gone."""
    return sweeps.subscribed_hosts(table(spark, sf_dir, "feeds"), views.subscriptions(spark, sf_dir), views.polls(spark, sf_dir), table(spark, sf_dir, "hosts"))


SQL["subscribed_hosts"] = (
    ctes("polls", "subscriptions")
    + """ select distinct h.host_name from feeds f join hosts h using (host_id) join subscriptions s using (feed_id) where s.active
    and not exists (select 1 from polls p where p.feed_id = f.feed_id and p.status = 410)"""
)


def _blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.versions(spark, sf_dir).select("version_id", "feed_id", "title", "url")
    return rules.blocked(v, views.rules(spark, sf_dir), "version_id", {"title_phrase": "title", "url_pattern": "url"})


@query
def blocked_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that a reader's rule excludes."""
    return _blocked(spark, sf_dir)


_BLOCKED = """select distinct v.version_id from versions v join rules r on r.blocks and (r.feed_id is null or r.feed_id = v.feed_id)
      and ((r.dimension = 'title_phrase' and contains(lower(v.title), lower(r.pattern))) or (r.dimension = 'url_pattern' and contains(lower(v.url), lower(r.pattern))))"""
SQL["blocked_versions"] = ctes("versions", "rules") + " " + _BLOCKED


@query
def due_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: versions whose page is to be fetched now."""
    return sweeps.due_captures(views.versions(spark, sf_dir), views.subscriptions(spark, sf_dir), views.captures(spark, sf_dir), views.robots(spark, sf_dir), table(spark, sf_dir, "hosts"), _blocked(spark, sf_dir), at(LOG_NOW)).select("version_id", "item_id", "feed_id", "target", "host_name")


SQL["due_captures"] = (
    ctes("captures", "robots", "subscriptions", "versions", "rules")
    + f""", b as ({_BLOCKED}), now2 as (select * from captures where capture_policy = '2'),
    r as (select host_id, max(fetched_at) as reset_at from now2 where outcome = 'ok' group by 1),
    t as (select c.host_id, count(*) as n, max(c.fetched_at) as last from now2 c left join r using (host_id) where c.outcome = 'failed' and (r.reset_at is null or c.fetched_at > r.reset_at) group by 1),
    ref as (select host_id from t where n >= 5 and last + to_seconds(cast(least(greatest(1800 * power(2, n - 5), 1800), 86400) as integer)) > timestamp '2024-01-31 00:00:00'),
    settled as (select c.version_id from captures c left join robots o using (host_id) where c.outcome = 'ok' or c.host_id in (select host_id from ref)
      or (c.outcome = 'disallowed' and c.fetched_at > o.fetched_at) or (c.outcome = 'unknown_rules' and o.host_id is null)),
    tried as (select version_id, count(*) as tries, max(fetched_at) as last_try from now2 where outcome = 'failed' group by 1),
    due as (select v.*, regexp_replace(regexp_extract(lower(v.target), '^https?://([^:/?#]+)', 1), '^www\\.', '') as host_name from versions v left join tried using (version_id)
      where exists (select 1 from subscriptions s where s.feed_id = v.feed_id and s.active) and not exists (select 1 from versions w where w.supersedes_id = v.version_id)
      and v.version_id not in (select version_id from settled) and (select count(*) from item_versions w where w.item_id = v.item_id) <= 5 and v.version_id not in (select version_id from b)
      and (v.supersedes_id is null or v.observed_at <= timestamp '2024-01-30 23:00:00')
      and (tries is null or (tries < 5 and last_try + to_seconds(cast(least(greatest(900 * power(3, tries), 900), 86400) as integer)) <= timestamp '2024-01-31 00:00:00'))
      order by v.observed_at nulls last, v.version_id limit 25)
    select version_id, item_id, feed_id, target, host_name from due where host_name in (select host_name from robots)"""
)


@query
def article_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: hosts of subscribed items' addresses."""
    return sweeps.article_hosts(views.versions(spark, sf_dir), views.subscriptions(spark, sf_dir))


SQL["article_hosts"] = (
    ctes("subscriptions", "versions")
    + """ select distinct h as host_name from (select regexp_replace(regexp_extract(lower(target), '^https?://([^:/?#]+)', 1), '^www\\.', '') as h
    from versions v join subscriptions s using (feed_id) where s.active) where h <> ''"""
)


@query
def due_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10: heads with a page that the current extractor has not read."""
    return sweeps.due_extractions(table(spark, sf_dir, "item_versions", "version_id", "supersedes_id"), views.page_captures(spark, sf_dir), table(spark, sf_dir, "articles", "version_id", "source", "extractor_version"), "2.1.0+2")


SQL["due_extractions"] = """select version_id from item_versions v where not exists (select 1 from item_versions w where w.supersedes_id = v.version_id)
    and exists (select 1 from pending_pages p where p.version_id = v.version_id and octet_length(p.body) > 0)
    and not exists (select 1 from articles a where a.version_id = v.version_id and a.source = 'page' and a.extractor_version = '2.1.0+2') order by 1 limit 25"""


@query
def due_feed_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads with feed text that the current extractor has not read, newest first."""
    v = table(spark, sf_dir, "item_versions", "version_id", "supersedes_id", "observed_at", "parsed_id")
    carvings = v.join(table(spark, sf_dir, "parsed_items", "parsed_id", "content", "stored_at"), "parsed_id").select("version_id", F.col("content").cast("binary").alias("body"), F.col("stored_at").alias("captured_at"), F.col("parsed_id").alias("capture_id"))
    return sweeps.due_feed_extractions(v, reading.has_feed_text(carvings), table(spark, sf_dir, "articles", "version_id", "source", "extractor_version"), "2.1.0+2")


SQL["due_feed_extractions"] = """select v.version_id, v.observed_at from item_versions v join parsed_items p using (parsed_id) where not exists (select 1 from item_versions w where w.supersedes_id = v.version_id)
    and length(coalesce(p.content, '')) > 0 and not exists (select 1 from articles a where a.version_id = v.version_id and a.source = 'feed' and a.extractor_version = '2.1.0+2')
    order by v.observed_at desc nulls last, v.version_id desc limit 25"""


@query
def due_feed_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12: documents behind heads that the current parser has not carved, newest first."""
    v = table(spark, sf_dir, "item_versions", "version_id", "supersedes_id", "parsed_id")
    carved = table(spark, sf_dir, "articles", "version_id", "extractor_version").withColumnRenamed("extractor_version", "parser_version")
    return sweeps.due_feed_captures(v, table(spark, sf_dir, "parsed_items", "parsed_id", "document_id"), carved, "2.1.0+2")


SQL["due_feed_captures"] = """select distinct p.document_id from item_versions v join parsed_items p using (parsed_id) where not exists (select 1 from item_versions w where w.supersedes_id = v.version_id)
    and not exists (select 1 from articles a where a.version_id = v.version_id and a.extractor_version = '2.1.0+2') order by 1 desc limit 50"""


@query
def carved_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q13: what each head is stored with, from its own document."""
    seen = changes.sightings(table(spark, sf_dir, "parsed_items"))
    heads = latest.heads(table(spark, sf_dir, "item_versions", "version_id", "supersedes_id", "parsed_id"))
    wanted = heads.join(seen.select("parsed_id", "document_id", "identity_key"), "parsed_id").select("version_id", "document_id", "identity_key")
    entries = seen.select("parsed_id", "document_id", "identity_key", "item_no").join(table(spark, sf_dir, "parsed_items", "parsed_id", "content", "summary"), "parsed_id")
    held = table(spark, sf_dir, "articles", "extraction_id", "version_id", "source", "created_at", "body").where("source = 'feed'").select("version_id", "body", F.col("created_at").alias("captured_at"), F.col("extraction_id").alias("capture_id"))
    return sweeps.carved(wanted, entries, held).select("version_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "kept")


SQL["carved_texts"] = f"""with s as ({_SIGHTINGS}), e as (select s.document_id, s.identity_key, p.content, p.summary, row_number() over (partition by s.document_id, s.identity_key order by s.item_no) as n from s join parsed_items p using (parsed_id)),
    h as (select version_id, body from (select *, row_number() over (partition by version_id order by created_at desc, extraction_id desc) as n from articles where source = 'feed') where n = 1)
    select v.version_id, md5(coalesce(nullif(e.content, ''), nullif(e.summary, ''), h.body, '')) as text_md5, coalesce(nullif(e.content, ''), nullif(e.summary, '')) is null as kept
    from item_versions v join s using (parsed_id) left join e on e.document_id = s.document_id and e.identity_key = s.identity_key and e.n = 1 left join h using (version_id)
    where not exists (select 1 from item_versions w where w.supersedes_id = v.version_id)"""


def _enclosure_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image slots: the enclosures of parsed items."""
    e = table(spark, sf_dir, "parsed_items", "parsed_id", "enclosures").select("parsed_id", F.posexplode("enclosures").alias("position", "e"))
    return e.select((F.col("parsed_id") * 100 + F.col("position")).alias("slot_id"), F.col("e.url").alias("url"), F.when(F.col("position") == 0, "lead").otherwise("body").alias("role"), F.lit(None).cast("long").alias("image_capture_id"), F.col("e.type").alias("type"))


_SLOTS = """slots as (select parsed_id * 100 + n - 1 as slot_id, e.url as url, case when n = 1 then 'lead' else 'body' end as role, e."type" as kind, parsed_id
      from (select parsed_id, unnest(enclosures) as e, generate_subscripts(enclosures, 1) as n from parsed_items))"""


@query
def due_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q14: lead image slots that have no capture."""
    return sweeps.due_images(_enclosure_slots(spark, sf_dir), "lead").select("slot_id", "url")


SQL["due_images"] = f"with {_SLOTS} select slot_id, url from slots where role = 'lead' order by slot_id limit 25"


def _image_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image answers: what feeds say of their typed enclosures."""
    s = _enclosure_slots(spark, sf_dir).where("type <> ''")
    return s.select(F.col("slot_id").alias("capture_id"), "url", F.col("type").alias("content_type"), F.lit(200).alias("status"), F.col("url").cast("binary").alias("body"), F.lit(None).cast("timestamp_ntz").alias("fetched_at"), F.lit(None).cast("string").alias("spec"), F.lit(None).cast("string").alias("encoder_version"), F.length("url").cast("long").alias("byte_size"))


@query
def linked_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q15, P5: slots with the newest usable capture of their address."""
    return sweeps.linked_images(_enclosure_slots(spark, sf_dir), _image_captures(spark, sf_dir).withColumn("fetched_at", at(NOW))).select("slot_id", "image_capture_id")


SQL["linked_images"] = f"with {_SLOTS}, u as (select url, max(slot_id) as found from slots where starts_with(kind, 'image/') and url <> '' group by 1) select slot_id, found as image_capture_id from slots left join u using (url)"


@query
def due_encodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that the current encoder has not seen, the largest first."""
    return sweeps.due_encodes(_image_captures(spark, sf_dir), "w1600q65", "1").select("capture_id", "byte_size")


SQL["due_encodes"] = f"with {_SLOTS} select slot_id as capture_id, length(url) as byte_size from slots where starts_with(kind, 'image/') and url <> '' order by 2 desc, 1 limit 25"


@query
def wanting_a_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q23: feeds with many bodies and no fresh dictionary."""
    bodies = table(spark, sf_dir, "parsed_items", "feed_id", "content").select("feed_id", F.coalesce("content", F.lit("")).cast("binary").alias("body"))
    trained = table(spark, sf_dir, "feeds", "feed_id", "created_at").withColumnRenamed("created_at", "trained_at")
    return sweeps.wanting_a_dictionary(bodies, trained, "feed_id", at("2024-01-25 00:00:00"))


SQL["wanting_a_dictionary"] = """select feed_id, count(*) as samples from parsed_items where length(content) > 0 and feed_id not in (select feed_id from feeds where created_at > timestamp '2023-12-26 00:00:00')
    group by 1 having count(*) >= 20 order by 2 desc, 1 limit 5"""


@query
def dictionary_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 newest bodies of every feed."""
    b = table(spark, sf_dir, "parsed_items", "parsed_id", "feed_id", "observed_at", "content").withColumn("body", F.coalesce("content", F.lit("")).cast("binary"))
    return sweeps.samples(b, "feed_id", [F.col("observed_at").desc(), F.col("parsed_id").desc()]).select("feed_id", "parsed_id")


SQL["dictionary_samples"] = "select feed_id, parsed_id from (select *, row_number() over (partition by feed_id order by observed_at desc, parsed_id desc) as n from parsed_items where length(content) > 0) where n <= 100"


@query
def stale_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts whose rules are unknown or expired."""
    return sweeps.stale_hosts(table(spark, sf_dir, "hosts", "host_name"), views.robots(spark, sf_dir), at("2024-01-20 00:00:00"))


SQL["stale_hosts"] = ctes("robots") + " select h.host_name from hosts h left join robots r using (host_name) where r.expires_at is null or r.expires_at <= timestamp '2024-01-20 00:00:00' order by 1 limit 50"


@query
def crawl_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q25: hosts that ask for a delay."""
    return sweeps.crawl_delays(table(spark, sf_dir, "hosts", "host_name"), views.robots(spark, sf_dir))


SQL["crawl_delays"] = ctes("robots") + " select host_name, cast(crawl_delay_seconds as double) as crawl_delay_seconds from robots where crawl_delay_seconds is not null"


@query
def staggered_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each feed's poll waits for those before it on its host."""
    f = table(spark, sf_dir, "feeds", "feed_id", "host_id", "next_poll_at").join(views.robots(spark, sf_dir).select("host_id", "crawl_delay_seconds"), "host_id", "left")
    return latest.staggered(f, "host_id", ["next_poll_at", "feed_id"], "crawl_delay_seconds").select("feed_id", "host_id", "delay")


SQL["staggered_polls"] = ctes("robots") + " select f.feed_id, f.host_id, (row_number() over (partition by f.host_id order by f.next_poll_at, f.feed_id) - 1) * greatest(5.0, coalesce(cast(r.crawl_delay_seconds as double), 0.0)) as delay from feeds f left join robots r using (host_id)"


# --- visits and schedules ----------------------------------------------------------------------------------------


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.polls(spark, sf_dir)
    f = table(spark, sf_dir, "feeds", "feed_id", "ttl_seconds", "last_polled_at", "next_poll_at")
    failures = runs.feed_failures(p).select("feed_id", F.col("run_length").alias("failures"))
    a = p.join(f, "feed_id").join(failures, "feed_id", "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
    return a.select("*", F.lit(None).cast("string").alias("error"), (F.col("outcome") != "disallowed").alias("allowed"), F.when(F.col("status") == 500, F.lit("120")).alias("retry_header"))


@query
def rescheduled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each poll's outcome and the seconds to the next."""
    return visits.rescheduled(_answers(spark, sf_dir).withColumn("status", F.when(F.col("status") == 500, 503).otherwise(F.col("status")))).select("log_id", "outcome", F.col("wait_seconds").cast("long").alias("wait_seconds"))


SQL["rescheduled"] = (
    ctes("polls")
    + f""", {_RUNS}, a as (select p.log_id, case when p.outcome = 'disallowed' then 'disallowed' when p.status is null then 'failed' when p.status = 304 then 'not_modified' when p.status = 200 then 'ok' else 'failed' end as outcome,
      case when p.status = 500 then 503 else p.status end as status, p.new_items, coalesce(run.failures, 0) as failures, coalesce(f.ttl_seconds, 0) as ttl, date_diff('second', f.last_polled_at, f.next_poll_at) as before
      from polls p join feeds f using (feed_id) left join run using (feed_id))
    select log_id, outcome, cast(case when outcome = 'disallowed' then 86400 when outcome = 'failed' and status = 503 then 300
      when outcome = 'failed' then greatest(floor(least(greatest(1800 * power(2.0, failures + 1), 300), 86400)), 0)
      else greatest(floor(least(greatest(coalesce(case when before <> 0 then before end, 1800) * case when new_items > 0 then 0.5 else 1.5 end, 300), 86400)), ttl) end as bigint) as wait_seconds from a"""
)


@query
def backoff_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each failing feed may be tried again, under each of the archive's policies."""
    f = runs.feed_failures(views.polls(spark, sf_dir))
    cols = [pace.due_at(F.col("run_latest"), F.col("run_length"), p).alias(n) for n, p in (("retry_at", pace.CAPTURE_RETRY), ("probe_at", pace.HOST_PROBE), ("poll_at", pace.INGEST))]
    return f.select("feed_id", "run_length", *cols)


SQL["backoff_table"] = (
    ctes("polls")
    + """, r as (select feed_id, max(polled_at) as reset_at from polls where outcome <> 'failed' group by 1),
    t as (select p.feed_id, count(*) as run_length, max(p.polled_at) as l from polls p left join r using (feed_id) where p.outcome = 'failed' and (r.reset_at is null or p.polled_at > r.reset_at) group by 1)
    select feed_id, run_length, l + to_seconds(cast(least(greatest(900 * power(3, run_length), 900), 86400) as integer)) as retry_at,
      l + to_seconds(cast(least(greatest(1800 * power(2, run_length), 1800), 86400) as integer)) as probe_at, l + to_seconds(cast(least(greatest(300 * power(2, run_length), 300), 86400) as integer)) as poll_at from t"""
)


@query
def clamped_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8 on the archive's own stamps: a next poll that lies before the last is brought to it; missing stays missing."""
    f = table(spark, sf_dir, "item_versions", "version_id", "observed_at", "parsed_id").join(table(spark, sf_dir, "parsed_items", "parsed_id", "stored_at"), "parsed_id")
    return f.select("version_id", pace.clamp_future(F.col("stored_at"), F.col("observed_at")).alias("clamped_at"))


SQL["clamped_dates"] = "select v.version_id, case when p.stored_at > v.observed_at then v.observed_at else p.stored_at end as clamped_at from item_versions v join parsed_items p using (parsed_id)"


@query
def capture_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every visit to a page is recorded as."""
    c = views.polls(spark, sf_dir).select("log_id", "status", "outcome", "feed_id", "new_items").join(table(spark, sf_dir, "feeds", "feed_id", "url", "site_url"), "feed_id")
    jobs = c.select("log_id", (F.col("outcome") != "not_modified").alias("rules_known"), (F.col("outcome") != "disallowed").alias("allowed"), (F.col("new_items") == 3).alias("host_refuses"), "status", F.lit(None).cast("string").alias("error"), F.col("url").alias("target"), F.col("site_url").alias("final_url"), F.lit(None).cast("boolean").alias("redirect_known"), F.lit(None).cast("boolean").alias("redirect_allowed"))
    return visits.capture_ladder(jobs).select("log_id", "outcome")


SQL["capture_outcomes"] = (
    ctes("polls")
    + """ select p.log_id, case when p.outcome = 'not_modified' then 'unknown_rules' when p.outcome = 'disallowed' then 'disallowed' when p.new_items = 3 then 'refused'
      when p.status between 200 and 299 and regexp_replace(regexp_extract(lower(f.url), '^https?://([^:/?#]+)', 1), '^www\\.', '') <> regexp_replace(regexp_extract(lower(f.site_url), '^https?://([^:/?#]+)', 1), '^www\\.', '') then 'unknown_rules'
      when p.status between 200 and 299 then 'ok' when p.status in (404, 410) then 'gone' else 'failed' end as outcome from polls p join feeds f using (feed_id)"""
)


@query
def held_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose bytes are stored by an earlier capture of the same address."""
    c = table(spark, sf_dir, "pending_pages", "capture_id", "final_url", "body").select("capture_id", F.col("final_url").alias("url"), texts.digest(F.col("body")).alias("body_hash"))
    return visits.held_once(c)


SQL["held_once"] = "select capture_id, final_url as url, min(capture_id) over (partition by final_url, sha256(body)) as holder_id from pending_pages where final_url is not null"


# --- writing -----------------------------------------------------------------------------------------------------


@query
def upserted_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings upserted by (version, source): a conflict moves the extractor's stamp only."""
    a = table(spark, sf_dir, "articles", "extraction_id", "version_id", "source", "extractor_version", "char_count")
    old, new = a.where("extractor_version <> '2.1.0+2'"), a.where("extractor_version = '2.1.0+2'")
    target = latest.latest_by(old, ["version_id", "source"], ["extraction_id"])
    return upsert.upsert(target, new, ["version_id", "source"], ["extractor_version"], ["extraction_id"]).select("version_id", "source", "extraction_id", "extractor_version", "disposition")


SQL["upserted_readings"] = """with n as (select *, row_number() over (partition by version_id, source, extractor_version = '2.1.0+2' order by extraction_id desc) as n from articles),
    t as (select * from n where n = 1 and extractor_version <> '2.1.0+2'), s as (select * from n where n = 1 and extractor_version = '2.1.0+2')
    select coalesce(t.version_id, s.version_id) as version_id, coalesce(t.source, s.source) as source, coalesce(t.extraction_id, s.extraction_id) as extraction_id, coalesce(s.extractor_version, t.extractor_version) as extractor_version,
      case when t.version_id is null then 'inserted' when s.version_id is not null then 'updated' else 'kept' end as disposition from t full join s on t.version_id = s.version_id and t.source = s.source"""


@query
def ensured_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of hosts with every host that an item's address names."""
    known = views.robots(spark, sf_dir).select("host_name")
    named = table(spark, sf_dir, "parsed_items", "url").select(urls.host_of(F.col("url")).alias("host_name")).where("host_name <> ''")
    return upsert.insert_missing(known, named, ["host_name"])


SQL["ensured_hosts"] = ctes("robots") + " select host_name from robots union select h from (select regexp_replace(regexp_extract(lower(url), '^https?://([^:/?#]+)', 1), '^www\\.', '') as h from parsed_items) where h <> ''"


@query
def subscribed_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q26: what subscribing to every address of feeds and sites would do."""
    f = table(spark, sf_dir, "feeds", "feed_id", "url", "site_url")
    asked = f.select("url").unionByName(f.select(F.col("site_url").alias("url")))
    return upsert.subscribed_again(f, views.subscriptions(spark, sf_dir), asked)


SQL["subscribed_again"] = """select distinct a.url, case when f.feed_id is null then 'added' when f.last_polled_at is not null then 'unchanged' else 'reactivated' end as disposition
    from (select url from feeds union select site_url from feeds) a left join feeds f on f.url = a.url"""


# --- observability -----------------------------------------------------------------------------------------------


@query
def silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row if no purchase was recorded in the last hour of the log."""
    return observe.silent(table(spark, sf_dir, "events", "ts", "event_type"), F.col("event_type") == "purchase", "ts", at(LOG_NOW), 1)


SQL["silence"] = "select count(*) as seen from events where event_type = 'purchase' and ts > timestamp '2024-01-30 23:00:00' and ts <= timestamp '2024-01-31 00:00:00' having count(*) = 0"


@query
def overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row if the latest purchase is more than a day old, a week after the log's end."""
    return observe.overdue(table(spark, sf_dir, "events", "ts", "event_type"), F.col("event_type") == "purchase", "ts", at("2024-02-07 00:00:00"), 26)


SQL["overdue"] = "select max(ts) as latest from events where event_type = 'purchase' having coalesce(max(ts), timestamp '1900-01-01') < timestamp '2024-02-05 22:00:00'"


@query
def all_failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of which no visit was answered with success."""
    return observe.all_failing(views.polls(spark, sf_dir), "feed_id", F.col("status").cast("string").like("2%"))


SQL["all_failing"] = ctes("polls") + " select feed_id, count(*) as records from polls group by 1 having count(*) > 0 and sum(case when cast(status as varchar) like '2%' then 1 else 0 end) = 0"


@query
def event_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour buckets by type; the current one is left out."""
    return observe.bucketed(table(spark, sf_dir, "events", "ts", "event_type", "value"), "ts", "event_type", "value", "6 hours", at("2024-01-30 14:00:00"))


SQL["event_buckets"] = """select time_bucket(interval '6 hours', ts, timestamp '1970-01-01') as bucket, event_type, count(*) as n, round(sum(value), 4) as total, round(avg(value), 6) as mean, max(value) as highest
    from events group by 1, 2 having time_bucket(interval '6 hours', max(ts), timestamp '1970-01-01') + interval '6 hours' <= timestamp '2024-01-30 14:00:00'"""


@query
def top_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent values of an attribute."""
    e = table(spark, sf_dir, "events", "props", "value")
    return observe.top_groups(e, observe.attribute("props", "k"), "k", "value")


SQL["top_attributes"] = "select props->>'k' as k, count(*) as n, round(avg(value), 6) as mean, max(value) as highest from events group by 1 order by 2 desc, 1 limit 20"


@query
def job_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits by outcome, with a row for outcomes that do not occur."""
    return observe.depths(views.polls(spark, sf_dir).select(F.col("outcome").alias("status")), ("ok", "failed", "not_modified", "disallowed", "stalled"))


SQL["job_depths"] = ctes("polls") + " select k as status, (select count(*) from polls where outcome = k) as jobs from (select unnest(['ok', 'failed', 'not_modified', 'disallowed', 'stalled']) as k)"

FEED_BROWSER = observe.Browser(("feed_id", "url", "title", "site_name", "next_poll_at"), ("url", "title"), ("title", "next_poll_at", "feed_id"), "title", "feed_id")


@query
def browse_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the admin's list of feeds."""
    return FEED_BROWSER.rows(table(spark, sf_dir, "feeds"), search="dispatch", sort="next_poll_at", descending=True)


SQL["browse_feeds"] = "select feed_id, url, title, site_name, next_poll_at from feeds where contains(lower(url), 'dispatch') or contains(lower(title), 'dispatch') order by next_poll_at desc nulls last, feed_id limit 50"


# --- plain analytics ---------------------------------------------------------------------------------------------


@query
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: one pass of partial aggregates."""
    li = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate").where(F.col("l_shipdate") <= at("1998-09-02 00:00:00"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.count("*").alias("count_order"))


SQL["pricing_summary"] = "select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, count(*) as count_order from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2"


@query
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of inner joins; the small sides are left to the optimiser's size checks."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey").join(table(spark, sf_dir, "region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    out = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("l_orderkey").alias("orders"))
    return out


SQL["revenue_by_nation"] = """select r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(distinct l_orderkey) as orders from lineitem
    join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2"""


@query
def largest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest orders of every customer segment."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice").join(table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return latest.top_k_per_key(o, ["c_mktsegment"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("c_mktsegment", "o_orderkey", "o_totalprice")


SQL["largest_orders"] = """select c_mktsegment, o_orderkey, o_totalprice from (select c_mktsegment, o_orderkey, o_totalprice, row_number() over (partition by c_mktsegment order by o_totalprice desc, o_orderkey) as n
    from orders join customer on o_custkey = c_custkey) where n <= 3"""


@query
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An anti join."""
    return table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").join(table(spark, sf_dir, "orders", "o_custkey").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left_anti")


SQL["customers_without_orders"] = "select c_custkey, c_mktsegment from customer where not exists (select 1 from orders where o_custkey = c_custkey)"


# --- sources -----------------------------------------------------------------------------------------------------


def _served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed documents as RSS bytes, written from the parsed tables: (document_id, url, body)."""
    items = table(spark, sf_dir, "parsed_items", "document_id", "item_no", "parsed_id", "guid", "url", "title", "summary", "content", "published_at")

    def tag(name: str, c: str):
        return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"<{name}><![CDATA["), F.replace(F.col(c), F.lit("]]>"), F.lit("]] >")), F.lit(f"]]></{name}>"))).otherwise("")

    one = F.concat(F.lit("<item>"), tag("guid", "guid"), tag("link", "url"), tag("title", "title"), tag("description", "summary"), tag("content:encoded", "content"), tag("pubDate", "published_at"), F.lit("</item>"))
    docs = items.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_no", "parsed_id", one.alias("x")))), lambda r: r["x"]), "").alias("items"))
    served = table(spark, sf_dir, "parsed_feeds", "document_id", "title", "site_url", "ok")
    head = F.concat(F.lit('<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><ttl>45</ttl>'), tag("title", "title"), tag("link", "site_url"))
    # documents that could not be read are served broken
    return docs.join(served, "document_id").select("document_id", F.coalesce("site_url", F.lit("")).alias("url"), F.concat(head, "items", F.when(F.col("ok"), "</channel></rss>").otherwise("</channel>")).cast("binary").alias("body"))


@query
def parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: served documents parsed: whether they could be read, and their items."""
    return feeds.parsed_feeds(_served(spark, sf_dir)).select("document_id", "title", "ok", (F.col("note") != "").alias("noted"), F.size("items").cast("long").alias("items"), pace.ttl_seconds(F.col("ttl_minutes"), F.col("update_period"), F.col("update_frequency")).alias("ttl_seconds"))


SQL["parsed_documents"] = """select f.document_id, trim(coalesce(f.title, '')) as title, true as ok, not f.ok as noted, i.n as items, 2700 as ttl_seconds from parsed_feeds f
    join (select document_id, count(*) as n from parsed_items group by 1) i using (document_id)"""


@query
def parsed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of served documents."""
    return feeds.items(feeds.parsed_feeds(_served(spark, sf_dir)), ["document_id"]).select("document_id", F.col("item_no").cast("long").alias("place"), "guid", "title", F.length("content").cast("long").alias("content_chars"))


SQL["parsed_entries"] = r"""select document_id, row_number() over (partition by document_id order by item_no, parsed_id) - 1 as place, trim(coalesce(guid, ''), E' \t\n\r') as guid, trim(coalesce(title, ''), E' \t\n\r') as title,
    length(trim(case when coalesce(content, '') <> '' then content else coalesce(summary, '') end, E' \t\n\r')) as content_chars from parsed_items where document_id in (select document_id from parsed_feeds)"""


@query
def page_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: pages as article texts; checked by what must hold, since no SQL says it."""
    return article.extracted(table(spark, sf_dir, "pending_pages", "capture_id", "body", "final_url"), "capture_id").select("capture_id", "title", "language", "site_name", F.length("body").alias("chars"), texts.paragraph_count(F.col("body")).alias("paragraphs"), F.size("links").alias("links"))


@query
def announced_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages announce; the archive's own announce nothing, so each is given the announcement of a feed."""
    p = table(spark, sf_dir, "pending_pages", "capture_id", "body", "final_url").where("final_url <> ''")
    p = p.withColumn("body", F.concat(F.lit('<link rel="alternate" type="application/rss+xml" href="/all.rss">').cast("binary"), "body"))
    return p.select("capture_id", F.explode(discovery.announced("body", "final_url")).alias("feed_url"))


SQL["announced_feeds"] = "select capture_id, regexp_extract(final_url, '^https?://[^/?#]+') || '/all.rss' as feed_url from pending_pages where final_url <> '' and body is not null"


@query
def opml_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subscriptions as one OPML document."""
    f = table(spark, sf_dir, "feeds", "title", "url", "site_url", "platform")
    return opml.rendered(f.withColumnRenamed("platform", "category"))


@query
def opml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subscriptions, written as OPML and read back."""
    made = opml_export(spark, sf_dir).select(F.col("opml").cast("binary").alias("opml"))
    return made.lateralJoin(opml.ParseOpml(F.col("opml").outer())).select("title", "url", "site_url", "category")


SQL["opml_round_trip"] = "select trim(title) as title, url, site_url, coalesce(platform, '') as category from feeds"


@query
def robots_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each feed's address may be visited, under rules that stand in for those of its host."""
    h = table(spark, sf_dir, "hosts", "host_name", "requires_www")
    rules_of = F.when(F.col("requires_www"), "User-agent: *\nDisallow: /\nAllow: /rss\nCrawl-delay: 500\n").otherwise("User-agent: *\nDisallow: /feed\n\nUser-agent: fernglass\nDisallow: /*.rdf$\n")
    u = table(spark, sf_dir, "feeds", "url").select(urls.host_of(F.col("url")).alias("host_name"), "url")
    return robots.verdicts(u, h.select("host_name", rules_of.cast("binary").alias("body"))).select("url", "known", "allowed", "blocks_everything", "crawl_delay")


SQL["robots_verdicts"] = """select f.url, h.host_name is not null as known, case when h.requires_www then regexp_matches(f.url, '^https?://[^/]*/rss') when h.host_name is not null then not regexp_matches(f.url, '\\.rdf$') end as allowed,
    case when h.host_name is not null then h.requires_www end as blocks_everything, case when h.requires_www then cast(120 as double) end as crawl_delay
    from feeds f left join hosts h on h.host_name = regexp_replace(regexp_extract(lower(f.url), '^https?://([^:/?#]+)', 1), '^www\\.', '')""".replace("\\\\\\\\", "\\\\")


def _rules_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host_name, body): robots rules that stand in for those of the hosts; some hosts have none."""
    h = table(spark, sf_dir, "hosts", "host_id", "host_name", "requires_www").where("host_id % 5 <> 0")
    body = F.when(F.col("requires_www"), "User-agent: *\nDisallow: /\nAllow: /rss\n").otherwise("User-agent: *\nDisallow: /*a\n")
    return h.select("host_name", body.cast("binary").alias("body"))


@query
def poll_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each feed may be polled: a rule about it is obeyed, a ban on everything is not."""
    u = table(spark, sf_dir, "feeds", "feed_id", "url").select(urls.host_of(F.col("url")).alias("host_name"), "url")
    return robots.poll_verdicts(u, _rules_of(spark, sf_dir))


_HOST = "regexp_replace(regexp_extract(lower({0}), '^https?://([^:/?#]+)', 1), '^www\\.', '')"
_PATH = "regexp_extract({0}, '^https?://[^/?#]*(/[^#]*)', 1)"
SQL["poll_verdicts"] = f"""select f.url, h.host_name is null or h.requires_www or not contains({_PATH.format("f.url")}, 'a') as may_poll
    from feeds f left join (select * from hosts where host_id % 5 <> 0) h on h.host_name = {_HOST.format("f.url")}"""


@query
def redirect_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page that a visit ended on may be kept, under the rules of the host it ended on."""
    p = table(spark, sf_dir, "pending_pages", "capture_id", "version_id", "final_url")
    v = table(spark, sf_dir, "item_versions", "version_id", "feed_id").join(table(spark, sf_dir, "feeds", "feed_id", "site_url"), "feed_id")
    visits_ = p.join(v, "version_id").select(F.col("capture_id").alias("visit_id"), urls.host_of(F.col("site_url")).alias("requested_host"), urls.host_of(F.col("final_url")).alias("host_name"), F.col("final_url").alias("url"))
    return robots.redirect_verdicts(visits_, _rules_of(spark, sf_dir))


SQL["redirect_verdicts"] = f"""with v as (select p.capture_id, p.final_url, coalesce({_HOST.format("p.final_url")}, '') as went, coalesce({_HOST.format("f.site_url")}, '') as asked
      from pending_pages p join item_versions i using (version_id) join feeds f using (feed_id))
    select v.capture_id as visit_id, went = asked or went = '' or (h.host_name is not null and case when h.requires_www then starts_with({_PATH.format("v.final_url")}, '/rss') else not contains({_PATH.format("v.final_url")}, 'a') end) as may_keep
    from v left join (select * from hosts where host_id % 5 <> 0) h on h.host_name = v.went"""


@query
def item_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the terms of every parsed item, and how many of its enclosures have an address."""
    i = table(spark, sf_dir, "parsed_items", "parsed_id", "tags", "enclosures")
    return i.select("parsed_id", F.array_join(texts.terms(F.col("tags")), "|").alias("terms"), F.coalesce(F.size(texts.usable_enclosures(F.col("enclosures"))), F.lit(0)).alias("files"))


SQL["item_terms"] = """select parsed_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(tags, lambda t: trim(t)), lambda t: t <> ''))), '|'), '') as terms,
    cast(coalesce(len(list_filter(enclosures, lambda e: coalesce(e.url, '') <> '')), 0) as integer) as files from parsed_items"""


@query
def compressed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as zstd frames; the sizes before are checked, those after depend on the library."""
    return codec.compressed(table(spark, sf_dir, "pending_pages", "capture_id", "body"), "capture_id").select("capture_id", "raw_bytes", (F.col("stored_bytes") < F.col("raw_bytes")).alias("smaller"))


SQL["compressed_bodies"] = "select capture_id, octet_length(body) as raw_bytes, true as smaller from pending_pages"


@query
def trained_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary for each feed that has samples enough and gains by one."""
    b = table(spark, sf_dir, "parsed_items", "parsed_id", "feed_id", "observed_at", "content").withColumn("body", F.coalesce("content", F.lit("")).cast("binary"))
    newest = sweeps.samples(b, "feed_id", [F.col("observed_at").desc(), F.col("parsed_id").desc()])
    return codec.trained(newest.select("feed_id", "parsed_id", "observed_at", "body"), "feed_id", ["observed_at", "parsed_id"]).select("feed_id", "dict_id", "sample_count", "sample_bytes", F.octet_length("dictionary").alias("bytes"))


# --- streams -----------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    held = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    path = f"{sf_dir}/{name}.parquet"
    # a table may be one file or a folder of files; a stream reads folders
    return spark.readStream.schema(held.schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if _is_file(spark, path) else spark.readStream.schema(held.schema).parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/fernglass-{uuid.uuid4().hex}"


@query
def stream_tail_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: runs of errors since each user's last purchase, from a stream of events, upserted as they change."""
    at_ = _place(spark)
    changes_ = logs.tail_run(_stream(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "error", F.col("event_type") == "purchase")
    held = upsert.Snapshots(spark, f"{at_}/table")
    logs.drain(changes_, f"{at_}/state", logs.upserting(held, ["user_id"], ["run_length", "run_latest"], ["run_latest"]), mode="update")
    return held.read().where("run_length > 0").select("user_id", "run_length", "run_latest")


SQL["stream_tail_run"] = SQL["tail_run_window"]


@query
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event, from a stream, in a snapshot table."""
    at_ = _place(spark)
    held = upsert.Snapshots(spark, f"{at_}/table")
    s = _stream(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    logs.drain(s, f"{at_}/state", logs.upserting(held, ["user_id"], ["event_id", "ts", "event_type"], ["ts", "event_id"]))
    return held.read().select("user_id", "event_id", "event_type")


SQL["stream_upsert"] = "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1"


@query
def stream_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8 as a stream: the six-hour buckets that the watermark has closed."""
    at_ = _place(spark)
    logs.drain(logs.buckets(_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value", "6 hours"), f"{at_}/state", path=f"{at_}/out")
    return spark.read.parquet(f"{at_}/out").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


SQL["stream_buckets"] = """select time_bucket(interval '6 hours', ts, timestamp '1970-01-01') as bucket, event_type, count(*) as n, round(sum(value), 4) as total, max(value) as highest from events
    group by 1, 2 having time_bucket(interval '6 hours', max(ts), timestamp '1970-01-01') + interval '6 hours' <= (select max(ts) - interval '1 hour' from events)"""
