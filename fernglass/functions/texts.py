"""Text functions (F3-F6, F11-F20, F24, P8): fingerprints, identities, measures of bodies, enclosures."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNIT = "\x1f"
RECORD = "\x1e"
# Links and images as Markdown writes them.
LINK = r"\[([^\]\n]*)\]\((https?://[^)\s]+)\)"
IMAGE = r"!\[([^\]\n]*)\]\((https?://[^)\s]+)\)"
MIN_CHARS, MIN_PARAGRAPHS = 500, 3
#: Unicode's white space, and the four separators that Java's (?U)\\s lacks.
BLANKS = r"(?U)[\s\x{1c}-\x{1f}]+"


def normalise_text(text: Column) -> Column:
    """without HTML comments, runs of white space (no-break spaces too) as one space, trimmed; null as ''."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<!--.*?-->", "")
    return F.trim(F.regexp_replace(bare, BLANKS, " "))


def fingerprint(*fields: Column) -> Column:
    """sha-256, in hex, of the normalised fields, each followed by a unit separator."""
    return F.sha2(F.concat(*[x for f in fields for x in (normalise_text(f), F.lit(UNIT))]).cast("binary"), 256)


def item_fingerprint() -> Column:
    """over an item's ten parsed fields, in order (the raw url and guid are not among them)."""
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), RECORD)
    files = F.transform(F.coalesce("enclosures", F.array().cast("array<struct<url:string,type:string,length:string>>")), lambda e: F.concat_ws(UNIT, F.coalesce(e["length"], F.lit("")), F.coalesce(e["type"], F.lit("")), F.coalesce(e["url"], F.lit(""))))
    return fingerprint(*[F.col(c) for c in ("title", "author", "canonical_url", "summary", "content", "comments_url", "published_at", "updated_at")], tags, F.array_join(F.array_sort(files), RECORD))


def identity(guid: Column, canonical: Column, title: Column, published: Column, summary: Column) -> Column:
    """struct(key, tier): the guid, else the canonical address, else a hash of what the item says."""
    blank = F.lit("")
    hashed = F.sha2(F.concat(*[x for f in (title, published, summary) for x in (F.coalesce(f, blank), F.lit(UNIT))]).cast("binary"), 256)
    has_guid, has_link = F.coalesce(guid, blank) != "", F.coalesce(canonical, blank) != ""
    return F.struct(F.when(has_guid, guid).when(has_link, canonical).otherwise(hashed).alias("key"), F.when(has_guid, "guid").when(has_link, "link").otherwise("hash").alias("tier"))


def contains_text(hay: Column, needle: Column) -> Column:
    """case-insensitive substring test without wildcards; an empty needle is in everything."""
    return F.instr(F.lower(hay), F.lower(needle)) > 0


def terms(raw: Column) -> Column:
    """trimmed, non-empty, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")))


def usable_enclosures(raw: Column) -> Column:
    """enclosures that have an address."""
    return F.filter(raw, lambda e: F.coalesce(e["url"], F.lit("")) != "")


def links(body: Column) -> Column:
    """array of struct(anchor, url), in order. An image's address counts as a link, as it does in the archive."""
    return F.arrays_zip(F.regexp_extract_all(body, F.lit(LINK), 1).alias("anchor"), F.regexp_extract_all(body, F.lit(LINK), 2).alias("url"))


def images(body: Column) -> Column:
    """array of struct(alt, url), in order."""
    return F.arrays_zip(F.regexp_extract_all(body, F.lit(IMAGE), 1).alias("alt"), F.regexp_extract_all(body, F.lit(IMAGE), 2).alias("url"))


def char_count(body: Column) -> Column:
    return F.length(F.coalesce(body, F.lit("")))


def paragraph_count(body: Column) -> Column:
    """non-blank blocks between blank lines."""
    return F.size(F.filter(F.split(F.coalesce(body, F.lit("")), "\n\n"), lambda p: F.trim(F.regexp_replace(p, r"[ \t\n\r\f\v]+", " ")) != ""))


def link_density(body: Column) -> Column:
    """the part of the body that is link text, to 4 places, half to even; 0 for an empty body."""
    anchors = F.aggregate(F.regexp_extract_all(body, F.lit(LINK), 1), F.lit(0), lambda n, a: n + F.length(a))
    return F.coalesce(F.when(F.length(body) > 0, F.bround(anchors / F.length(body), 4)), F.lit(0.0))


def judge(chars: Column, paragraphs: Column) -> Column:
    """struct(ok, note): whether an extraction holds an article."""
    note = F.when(chars == 0, "nothing extracted").when(chars < MIN_CHARS, "too short").when(paragraphs < MIN_PARAGRAPHS, "too few paragraphs").otherwise("")
    return F.struct((note == "").alias("ok"), note.alias("note"))


def digest(data: Column) -> Column:
    """the raw sha-256 of bytes."""
    return F.unhex(F.sha2(data, 256))


def picked_headers(headers: Column, names: tuple[str, ...] = ("content-type", "etag", "last-modified", "cache-control", "retry-after")) -> Column:
    """the named headers only, with names in lower case."""
    return F.map_filter(F.transform_keys(headers, lambda k, _: F.lower(k)), lambda k, _: k.isin(*names))


def not_one_of(value: Column, members: tuple[str, ...]) -> Column:
    """rows that an enumeration's check would refuse (null passes, as in a CHECK)."""
    return value.isNotNull() & ~value.isin(*members)
