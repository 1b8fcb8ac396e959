"""Feeds that a page announces."""

from __future__ import annotations

import html
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

# The types of announced feeds.
FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/feed+json")

_LINK = re.compile(r"<link\b([^>]*)>", re.I)
_ATTR = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


def feeds_in(page: str, base: str) -> list[str]:
    """Addresses of <link rel~=alternate type=feed>, in document order, each once."""
    out: dict[str, None] = {}
    for m in _LINK.finditer(page):
        a = {k.lower(): html.unescape(x or y or z) for k, x, y, z in _ATTR.findall(m[1])}
        if "alternate" in a.get("rel", "").lower().split() and a.get("type", "").split(";")[0].strip().lower() in FEED_TYPES and a.get("href"):
            out.setdefault(urljoin(base, a["href"].strip()))
    return list(out)


def _announced(page: pd.Series, base: pd.Series) -> pd.Series:
    def one(body: bytes | None, url: str | None) -> list[str]:
        if not body:
            return []
        text = bytes(body).decode("utf-8", "replace")
        if re.match(r"\s*(?:<\?xml|<rss\b|<feed\b)", text, re.I):
            return [url or ""]
        return feeds_in(text, url or "")

    return pd.Series([one(p, b) for p, b in zip(page, base, strict=True)], dtype=object)


def announced(page: Column | str, base: Column | str) -> Column:
    """S6 over pages as bytes: what is XML already is its own feed."""
    return F.pandas_udf(_announced, ArrayType(StringType()))(page, base)
