"""Lines that a site repeats in many of its documents (problem 7).

Duplicate documents are collapsed first: documents of one site with the same non-blank lines are one
cluster, and only one document of a cluster is looked at further, with the cluster's number of documents and its first
date. Every line is then counted over distinct clusters and dates, and by documents. By default a line must
be in ``MIN_CLUSTERS`` clusters to be boilerplate, so that an article that was stored or republished a hundred times
keeps its lines. (``p7_found`` counts documents alone, as its definition asks.)

Lines are equal if they are so in lower case, without outer white space and with inner runs of
white space (no-break spaces too) as one space. Blank lines never count. Rows with a null body, or
a null or empty site, are left out. Repeated rows with one document id count as one document; a
line that a document holds twice counts once and is reported at both places. Very long bodies are
only split, never gathered. Extra columns are ignored.

Scale: texts are read once; lines travel as 128-bit hashes of site and line, written once a document. The counts are
partial aggregates, so that a site with a third of all rows costs map-side work, not one task; frequent lines are at
most 1/min_docs of all. Only clusters of several documents are joined back to be collapsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fernglass.session import written

MIN_DOCS, MIN_CLUSTERS = 8, 2

#: White space as Python and Unicode see it; Java's (?U)\s lacks the four separators.
BLANKS = r"(?U)[\s\x{1c}-\x{1f}]+"


def line_key(line: Column) -> Column:
    """The line in the form in which lines are compared."""
    return F.trim(F.regexp_replace(F.lower(line), BLANKS, " "))


def _hashed(*of: Column) -> Column:
    """128 bits: collisions need 2^64 distinct values."""
    return F.struct(F.xxhash64(*of).alias("h1"), F.xxhash64(F.lit("second"), *of).alias("h2"))


def hashed_documents(docs: DataFrame, doc_id: str, site: str, body: str, date: str | None = None) -> DataFrame:
    """(doc_id, site, day, cluster, hashes): the hash of each line of each document (null for a blank one), and of all; written once."""
    src = docs.where((F.col(site) != "") & F.col(body).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), F.col(site).alias("site"), (F.to_date(F.col(date)) if date else F.lit(None).cast("date")).alias("day"), F.transform(F.split(F.col(body), "\n", -1), line_key).alias("keys")
    )
    hashes = F.transform("keys", lambda k: F.when(k != "", _hashed(F.col("site"), k)))
    return written(src.select("doc_id", "site", "day", _hashed(F.col("site"), F.array_join(F.filter("keys", lambda k: k != ""), "\n")).alias("cluster"), hashes.alias("hashes")))


def line_counts(hashed: DataFrame) -> DataFrame:
    """(h, n_docs, n_clusters, n_days) of every line: documents and clusters that hold it, and first dates of these."""
    several = hashed.groupBy("cluster").agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("n_docs"), F.min("day").alias("first_day")).where("rows > 1")
    several = written(several.select("cluster", "n_docs", "first_day"))
    single = hashed.join(several, "cluster", "left_anti").select("day", F.lit(1).cast("long").alias("n_docs"), "hashes")
    one_each = hashed.select("cluster", "hashes").join(several, "cluster").groupBy("cluster").agg(F.first("first_day").alias("day"), F.first("n_docs").alias("n_docs"), F.first("hashes").alias("hashes"))
    lines = single.unionByName(one_each.drop("cluster")).select("day", "n_docs", F.explode(F.array_distinct(F.array_compact("hashes"))).alias("h"))
    by_day = lines.groupBy("h", "day").agg(F.sum("n_docs").alias("n_docs"), F.count("*").alias("n_clusters"))
    return by_day.groupBy("h").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_clusters").alias("n_clusters"), F.count("day").alias("n_days"))


def repeated_places(docs: DataFrame, doc_id: str, site: str, body: str, date: str | None = None, min_docs: int = MIN_DOCS, min_clusters: int = MIN_CLUSTERS) -> DataFrame:
    """(doc_id, site, line_no, n_docs, n_clusters, n_days): each line that at least ``min_docs`` documents of
    its site hold, in at least ``min_clusters`` clusters."""
    hashed = hashed_documents(docs, doc_id, site, body, date)
    often = written(line_counts(hashed).where((F.col("n_docs") >= min_docs) & (F.col("n_clusters") >= min_clusters)))
    places = hashed.select("doc_id", "site", F.posexplode("hashes").alias("line_no", "h")).where("h is not null")
    return places.join(often, "h").select("doc_id", "site", "line_no", "n_docs", "n_clusters", "n_days")


def repeated_lines(docs: DataFrame, doc_id: str, site: str, body: str, date: str | None = None, min_docs: int = MIN_DOCS, min_clusters: int = MIN_CLUSTERS) -> DataFrame:
    """The ``repeated_places`` with their lines. (A repeated row of one document repeats its places, with the row's own text.)"""
    places = repeated_places(docs, doc_id, site, body, date, min_docs, min_clusters)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(site).alias("site"), F.split(F.col(body), "\n", -1).alias("lines")).dropDuplicates(["doc_id"])
    return places.join(texts, ["doc_id", "site"]).select("doc_id", "site", "line_no", F.try_element_at("lines", F.col("line_no") + 1).alias("line"), "n_docs", "n_clusters", "n_days")


def without_repeated_lines(docs: DataFrame, doc_id: str, site: str, body: str, date: str | None = None, min_docs: int = MIN_DOCS, min_clusters: int = MIN_CLUSTERS) -> DataFrame:
    """(doc_id, n_removed, body): each document without its repeated lines; documents without any come as they are."""
    drop = repeated_places(docs, doc_id, site, body, date, min_docs, min_clusters).groupBy("doc_id").agg(F.collect_set("line_no").alias("drop"))
    kept = F.filter(F.split(F.col("body"), "\n", -1), lambda x, i: ~F.coalesce(F.array_contains(F.col("drop"), i), F.lit(False)))
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(body).alias("body"))
    return src.join(drop, "doc_id", "left").select("doc_id", F.coalesce(F.size("drop"), F.lit(0)).alias("n_removed"), F.concat_ws("\n", kept).alias("body"))
