"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fernglass.llm import encode, language, maintext, mixing, neardup, residue, sitelines, subjects, truncation
from fernglass.session import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _articles_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "articles", "extraction_id", "site_name", "body", "created_at")


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that at least 8 articles of one site hold, each at every place."""
    places = sitelines.repeated_places(_articles_by_site(spark, sf_dir), "extraction_id", "site_name", "body", "created_at", min_clusters=1)
    return places.select(F.col("doc_id").alias("extraction_id"), F.col("line_no").cast("long").alias("line_no"))


@query
def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article without the lines that its site repeats in several texts."""
    return sitelines.without_repeated_lines(_articles_by_site(spark, sf_dir), "extraction_id", "site_name", "body", "created_at").select(F.col("doc_id").alias("extraction_id"), "n_removed", F.length("body").alias("chars_left"))


@query
def p7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By site: how many places and documents have lines that are repeated in several texts, and their largest counts."""
    found = sitelines.repeated_places(_articles_by_site(spark, sf_dir), "extraction_id", "site_name", "body", "created_at")
    return found.groupBy("site").agg(F.count("*").alias("places"), F.count_distinct("doc_id").alias("docs"), F.max("n_docs").alias("most_docs"), F.max("n_clusters").alias("most_clusters"), F.max("n_days").alias("most_days"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parsed_items", "parsed_id", "feed_id", "title", "summary", "content")


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries and contents that stop before their text does."""
    return truncation.truncated(_items(spark, sf_dir), "parsed_id", "feed_id", "title", ["summary", "content"]).select(F.col("record_id").alias("parsed_id"), "field")


@query
def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of truncated values of each feed and field."""
    items = _items(spark, sf_dir)
    cases = truncation.truncated(items, "parsed_id", "feed_id", "title", ["summary", "content"])
    return truncation.rates(items, cases, "feed_id", ["summary", "content"]).select(F.col("source").alias("feed_id"), "field", "n_values", "n_truncated", F.round("share", 6).alias("share"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of all feed descriptions and of the article bodies without residue."""
    model = language.fit_table(table(spark, sf_dir, "language_samples"))
    docs = table(spark, sf_dir, "articles", "extraction_id", "title", "body", "site_name", "language")
    crf = maintext.fit(docs.select("extraction_id", "body", "site_name"), None)
    shared = spark.sparkContext.broadcast(crf)
    bad = residue.residue(docs.withColumn("title", F.lit(None).cast("string")), "extraction_id", "title", "body", "site_name").select(F.col("doc_id").alias("record_id")).distinct()
    bodies = language.segments(docs, "extraction_id", "body", "language", model, lambda texts, sites: maintext.own_lines(shared.value, texts, sites), "site_name").join(bad, "record_id", "left_anti")
    feeds = language.segments(table(spark, sf_dir, "parsed_feeds", "document_id", "description", "language"), "document_id", "description", "language", model)
    return bodies.withColumn("tbl", F.lit("articles")).unionByName(feeds.withColumn("tbl", F.lit("parsed_feeds")))


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of articles and feed descriptions whose label is missing or wrong, or that are mixed."""
    return language.mislabelled(_segments(spark, sf_dir)).select("tbl", "record_id", "segment_no", "lang")


@query
def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of articles and feed descriptions, with its language and confidence."""
    return _segments(spark, sf_dir).select("tbl", "record_id", "segment_no", "lang", F.round("confidence", 3).alias("confidence"))


def _texts(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, str, list[str]]]:
    return [
        (table(spark, sf_dir, "parsed_items", "parsed_id", "summary", "content"), "parsed_id", ["summary", "content"]),
        (table(spark, sf_dir, "articles", "extraction_id", "body"), "extraction_id", ["body"]),
    ]


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records whose summaries, contents or bodies share half of their word triples."""
    return neardup.similar_pairs(_texts(spark, sf_dir), similarity=0.5).select("field", "id_a", "id_b")


@query
def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of 30 words or more, its class of equal texts, its group of classes alike by 0.5, and its links."""
    return neardup.groups(_texts(spark, sf_dir), similarity=0.5)


def _notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id) of the articles whose body is a notice: nothing there is around a text."""
    docs = table(spark, sf_dir, "articles", "extraction_id", "title", "body", "site_name")
    return residue.residue(docs, "extraction_id", "title", "body", "site_name").where("field = 'body' and notice").select(F.col("doc_id").alias("record_id"))


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of article bodies and pending pages that are not the article's own."""
    bodies = table(spark, sf_dir, "articles", "extraction_id", "body", "site_name")
    pages = table(spark, sf_dir, "pending_pages", "capture_id", "body", "charset")
    crf = maintext.fit(bodies, pages)
    own = maintext.boilerplate_lines(bodies, crf, False).join(_notices(spark, sf_dir), "record_id", "left_anti")
    web = maintext.boilerplate_lines(pages, crf, True)
    return own.select(F.lit("articles").alias("tbl"), "record_id", "line_no").unionByName(web.select(F.lit("pending_pages").alias("tbl"), "record_id", "line_no"))


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and bodies of articles that hold residue of a template, filler or a notice."""
    docs = table(spark, sf_dir, "articles", "extraction_id", "title", "body", "site_name")
    return residue.residue(docs, "extraction_id", "title", "body", "site_name").select(F.col("doc_id").alias("extraction_id"), "field")


@query
def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles without those that hold residue, by site: how many stay and how many go."""
    docs = table(spark, sf_dir, "articles", "extraction_id", "title", "body", "site_name")
    bad = residue.residue(docs, "extraction_id", "title", "body", "site_name").select(F.col("doc_id").alias("extraction_id"), F.lit(1).alias("bad")).distinct()
    return docs.join(bad, "extraction_id", "left").groupBy("site_name").agg(F.count_if(F.col("bad").isNull()).alias("kept"), F.count("bad").alias("excluded"))


@query
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document's text, by byte_bpe_50k."""
    return encode.ids(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def _sized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens) of the documents of the target sources, written once; and the targets."""
    targets = table(spark, sf_dir, "mix_targets", "source", "target_share", "max_repeats")
    names = [r[0] for r in targets.select("source").distinct().collect()]  # a configuration table
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text").where(F.col("source").isin(names))
    return written(encode.token_counts(docs, "doc_id", "text").join(docs.select("doc_id", "source"), "doc_id")), targets


@query
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a document in the mixture: its copy number, output shard and place there."""
    return mixing.mix(*_sized(spark, sf_dir))


@query
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the total tokens that each target source got."""
    sized, targets = _sized(spark, sf_dir)
    return mixing.shares(mixing.mix(sized, targets), sized, targets)


def _mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return subjects.mixtures(docs, subjects.fit(docs, table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects")))


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects that at least a quarter of a document's sentences are about."""
    return _mixtures(spark, sf_dir).where(F.col("share") >= subjects.MIN_SHARE).select("doc_id", "subject")


@query
def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject: documents, and sentences' worth of documents."""
    per_doc = _mixtures(spark, sf_dir)
    return per_doc.groupBy("subject").agg(F.count_if(F.col("share") >= subjects.MIN_SHARE).alias("documents"), F.round(F.sum("share"), 3).alias("weight"))


_LINES = r"""
with s as (select extraction_id, site_name, cast(created_at as date) as day, unnest(string_split(body, chr(10))) as line,
                  generate_subscripts(string_split(body, chr(10)), 1) - 1 as line_no
           from articles where site_name <> '' and body is not null),
l as (select *, trim(regexp_replace(lower(line), '[\s\x{a0}\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+', ' ', 'g')) as k from s),
c as (select extraction_id, site_name, min(day) as day, string_agg(k, chr(10) order by line_no) as cluster from l where k <> '' group by 1, 2),
d as (select site_name, cluster, min(day) as day from c group by 1, 2),
n as (select l.site_name, l.k, count(distinct l.extraction_id) as n_docs, count(distinct c.cluster) as n_clusters, count(distinct d.day) as n_days
      from l join c using (extraction_id, site_name) join d on d.site_name = c.site_name and d.cluster = c.cluster where l.k <> '' group by 1, 2),
f as (select l.*, n.n_docs, n.n_clusters, n.n_days from l join n using (site_name, k) where n.n_docs >= 8)
"""
SQL["p7_found"] = _LINES + "select extraction_id, cast(line_no as bigint) as line_no from f"
SQL["p7_lines"] = _LINES + "select site_name as site, count(*) as places, count(distinct extraction_id) as docs, max(n_docs) as most_docs, max(n_clusters) as most_clusters, max(n_days) as most_days from f where n_clusters >= 2 group by 1"
SQL["p7_clean"] = (
    _LINES
    + """select a.extraction_id, cast(coalesce(d.n, 0) as integer) as n_removed, cast(coalesce(length(a.body), 0)
    - coalesce(d.chars, 0) - least(coalesce(d.n, 0), greatest(len(string_split(a.body, chr(10))) - 1, 0)) as integer) as chars_left
    from articles a left join (select extraction_id, count(*) as n, sum(length(line)) as chars from f where n_clusters >= 2 group by 1) d using (extraction_id)"""
)
