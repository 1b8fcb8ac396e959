"""Change detection (W4, W7, Q3-Q6, G10): documents, versions, churn, refreshes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fernglass.functions.texts import identity, item_fingerprint


def changed_from_previous(docs: DataFrame, key: str, order: list[str], hashed: Column) -> DataFrame:
    """The documents that are to be stored: those that differ from the one before of their source.

    A first document is stored; A, B, A are three documents; a null hash before always differs."""
    w = Window.partitionBy(key).orderBy(*order)
    d = docs.withColumn("_h", hashed).withColumn("_before", F.lag("_h").over(w))
    return d.where(F.col("_before").isNull() | ~F.col("_h").eqNullSafe(F.col("_before"))).drop("_h", "_before")


def sightings(items: DataFrame) -> DataFrame:
    """Parsed items with identity (key, tier) and fingerprint."""
    return items.withColumn("_id", identity(F.col("guid"), F.col("canonical_url"), F.col("title"), F.col("published_at"), F.col("summary"))).select(
        "feed_id", "document_id", "parsed_id", "item_no", "observed_at", "canonical_url", F.col("_id.key").alias("identity_key"), F.col("_id.tier").alias("tier"), item_fingerprint().alias("fingerprint")
    )


def dispositions(seen: DataFrame) -> DataFrame:
    """Q5 over the whole history: what each sighting was, in order of its documents.

    duplicate: its document had the identity before (the first wins); new: the identity's first sighting; unchanged:
    as the version before; version: anything else. ``churn``: a new item whose canonical address is already on the
    head of another item of the feed, as the heads stood before its document."""
    place = Window.partitionBy("feed_id", "document_id", "identity_key").orderBy("item_no", "parsed_id")
    first = seen.withColumn("_n", F.row_number().over(place))
    story = Window.partitionBy("feed_id", "identity_key").orderBy("observed_at", "document_id", "parsed_id")
    kept = first.where("_n = 1").withColumn("_before", F.lag("fingerprint").over(story)).withColumn("_order", F.struct("observed_at", "document_id"))
    kept = kept.withColumn("disposition", F.when(F.col("_before").isNull(), "new").when(F.col("_before") == F.col("fingerprint"), "unchanged").otherwise("version"))
    versions = kept.where("disposition <> 'unchanged'")
    spans = versions.select("feed_id", "canonical_url", F.col("identity_key").alias("_other"), F.col("_order").alias("_from"), F.lead("_order").over(Window.partitionBy("feed_id", "identity_key").orderBy("_order")).alias("_to")).where("canonical_url <> ''")
    new = kept.where("disposition = 'new' and canonical_url <> ''").select("feed_id", "canonical_url", "parsed_id", "identity_key", "_order")
    churned = new.join(spans, ["feed_id", "canonical_url"]).where((F.col("_other") != F.col("identity_key")) & (F.col("_from") < F.col("_order")) & (F.col("_to").isNull() | (F.col("_to") >= F.col("_order")))).select("parsed_id", F.lit(True).alias("churn")).distinct()
    marked = kept.join(churned, "parsed_id", "left").select("feed_id", "document_id", "parsed_id", "identity_key", "tier", "disposition", F.coalesce("churn", F.lit(False)).alias("churn"))
    repeats = first.where("_n > 1").select("feed_id", "document_id", "parsed_id", "identity_key", "tier", F.lit("duplicate").alias("disposition"), F.lit(False).alias("churn"))
    return marked.unionByName(repeats)


def tally(marked: DataFrame, key: str) -> DataFrame:
    """How many of each disposition, in fixed columns."""
    kinds = [("new", "new_items"), ("version", "new_versions"), ("unchanged", "unchanged"), ("duplicate", "duplicate_identity")]
    return marked.groupBy(key).agg(*[F.count_if(F.col("disposition") == k).alias(n) for k, n in kinds], F.count_if(F.col("churn")).alias("guid_churn"))


def current_versions(versions: DataFrame, parsed: DataFrame) -> DataFrame:
    """Q4: (item_id, version_id, content_hash, canonical_url) of every item's head."""
    from fernglass.operators.latest import heads

    return heads(versions).join(parsed.select("parsed_id", "canonical_url"), "parsed_id", "left").select("feed_id", "item_id", "version_id", "content_hash", "canonical_url")


def refreshed(feeds: DataFrame, parsed: DataFrame) -> DataFrame:
    """Q6: feeds with what their newest readable document says: the title only where there is none, other fields only
    where the document has them."""
    from fernglass.operators.latest import latest_by

    last = latest_by(parsed.where("ok"), ["feed_id"], ["fetched_at", "document_id"]).select("feed_id", *[F.col(c).alias(f"_{c}") for c in ("title", "site_url", "platform", "hub_url", "ttl_seconds")])

    def newer(c: str) -> Column:
        return F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c)).alias(c)

    return feeds.join(last, "feed_id", "left").select("feed_id", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("_title")).alias("title"), newer("site_url"), newer("platform"), newer("hub_url"), F.coalesce("_ttl_seconds", "ttl_seconds").alias("ttl_seconds"))
