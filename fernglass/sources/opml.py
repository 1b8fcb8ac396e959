"""Subscription lists (S4, S5): OPML bytes to rows and back, byte for byte the same for the same rows."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import udtf

MAX_BYTES = 8 * 1024 * 1024


def outlines(data: bytes | None) -> list[tuple[str, str, str, str, bool]]:
    """(title, url, site_url, category, needs_discovery) of every leaf. Folders flatten to the nearest named one; what
    lies below a feed is not read.

    Raises ValueError for documents that are too large, define entities, are not well-formed or have no body."""
    if not data:
        return []
    if len(data) > MAX_BYTES:
        raise ValueError("the list is too large")
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError("the list defines entities")
    try:
        root = ET.fromstring(data)
    except ET.ParseError as e:
        raise ValueError(f"the list is not well-formed: {e}") from e
    found: list[tuple[str, str, str, str, bool]] = []

    def walk(node: ET.Element, folder: str) -> None:
        for o in node.findall("outline"):
            a = o.attrib
            name = (a.get("title") or a.get("text") or "").strip()
            feed = (a.get("xmlUrl") or a.get("xmlurl") or "").strip()
            site = (a.get("htmlUrl") or "").strip()
            if feed:
                found.append((name, feed, site, folder, False))
            elif o.find("outline") is not None:
                walk(o, name or folder)
            elif site:
                found.append((name, site, site, folder, True))

    body = root.find("body")
    if body is None:
        raise ValueError("the list has no body")
    walk(body, "")
    return found


@udtf(returnType="title string, url string, site_url string, category string, needs_discovery boolean")
class ParseOpml:
    """S4 as a table function: no rows for a list that is refused."""

    def eval(self, data: bytes) -> Iterator[tuple[str, str, str, str, bool]]:
        try:
            yield from outlines(bytes(data) if data is not None else None)
        except ValueError:
            return


def rendered(subscriptions: DataFrame) -> DataFrame:
    """One row (opml): title, url, site_url, category as a list, grouped by category, sorted by (lower title, url).

    A list of subscriptions is one document by nature; its lines are made in parallel and joined once."""

    def attr(c: str):
        esc = F.col(c)
        for x, y in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            esc = F.replace(esc, F.lit(x), F.lit(y))
        return F.coalesce(esc, F.lit(""))

    s = subscriptions.withColumn("category", F.coalesce("category", F.lit("")))
    line = F.concat(F.lit('<outline type="rss" text="'), attr("title"), F.lit('" title="'), attr("title"), F.lit('" xmlUrl="'), attr("url"), F.lit('" htmlUrl="'), attr("site_url"), F.lit('"/>'))
    groups = s.groupBy("category").agg(F.array_sort(F.collect_list(F.struct(F.lower("title").alias("k"), "url", line.alias("line")))).alias("rows"))
    indent = F.when(F.col("category") == "", "    ").otherwise("      ")
    block = F.array_join(F.transform("rows", lambda r: F.concat(indent, r["line"])), "\n")
    named = F.when(F.col("category") == "", block).otherwise(F.concat(F.lit('    <outline text="'), attr("category"), F.lit('" title="'), attr("category"), F.lit('">\n'), block, F.lit("\n    </outline>")))
    whole = groups.agg(F.array_sort(F.collect_list(F.struct("category", named.alias("block")))).alias("blocks"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<opml version="2.0">\n  <head>\n    <title>Subscriptions</title>\n  </head>\n  <body>\n'
    return whole.select(F.concat(F.lit(head), F.array_join(F.transform("blocks", lambda b: F.concat(b["block"], F.lit("\n"))), ""), F.lit("  </body>\n</opml>\n")).alias("opml"))
