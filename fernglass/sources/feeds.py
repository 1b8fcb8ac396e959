"""Feed documents (S3, F10, F12-F16): RSS and Atom bytes to rows, in Arrow batches.

A well-formed document is read by the standard library's parser, without external entities; what is
not well-formed is read leniently, tag by tag, so that its items survive: the fault is noted, and the
document still counts as read if it has any items. Null and empty bodies give a row that is not ok.
"""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, functions as F

PARSER_VERSION = "1"
NOTE_CHARS = 500

ITEM = "struct<guid:string,url:string,title:string,author:string,summary:string,content:string,comments_url:string,tags:array<string>,enclosures:array<struct<url:string,type:string,length:string>>,published_at:string,updated_at:string>"
SCHEMA = f"title string, description string, site_url string, language string, icon_url string, platform string, hub_url string, ttl_minutes string, update_period string, update_frequency string, categories array<string>, ok boolean, note string, items array<{ITEM}>"

_DOCTYPE = re.compile(rb"<!DOCTYPE[^>\[]*(?:\[.*?\])?[^>]*>", re.S)
_LENIENT = re.compile(r"<!\[CDATA\[(.*?)\]\]>|<!--.*?-->|<\?.*?\?>|<(/?)([A-Za-z][\w:.-]*)((?:\s[^<>]*)?)(/?)>|([^<]+)", re.S)
_ATTR = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


class _Node:
    __slots__ = ("attrs", "children", "name", "tail", "text")

    def __init__(self, name: str, attrs: dict[str, str]) -> None:
        self.name, self.attrs, self.children, self.text, self.tail = name, attrs, [], "", ""

    def all(self, *names: str) -> list[_Node]:
        return [c for c in self.children if c.name in names]

    def first(self, *names: str) -> str:
        """The first non-empty text among the named children, in the names' order."""
        for n in names:
            for c in self.all(n):
                if c.text.strip():
                    return c.text.strip()
        return ""

    def inner(self) -> str:
        """Text and markup inside, for content of type xhtml."""
        out = html.escape(self.text, quote=False) if self.children else self.text
        for c in self.children:
            tag = c.name.rpartition(":")[2]
            out += f"<{tag}>{c.inner()}</{tag}>{html.escape(c.tail, quote=False)}"
        return out


# The usual names of the namespaces in use.
_SPACES = {
    "http://www.w3.org/2005/Atom": "",
    "http://purl.org/rss/1.0/": "",
    "http://purl.org/rss/1.0/modules/content/": "content",
    "http://purl.org/rss/1.0/modules/syndication/": "sy",
    "http://purl.org/dc/elements/1.1/": "dc",
    "http://www.w3.org/1999/xhtml": "xhtml",
    "http://www.itunes.com/dtds/podcast-1.0.dtd": "itunes",
    "http://search.yahoo.com/mrss/": "media",
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf",
    "http://www.w3.org/XML/1998/namespace": "xml",
}


def _name(tag: str) -> str:
    if tag[:1] != "{":
        return tag
    space, _, local = tag[1:].partition("}")
    known = _SPACES.get(space, "x")
    return f"{known}:{local}" if known else local


def _strict(body: bytes) -> _Node:
    def turn(e: ET.Element) -> _Node:
        n = _Node(_name(e.tag), {_name(k): v for k, v in e.attrib.items()})
        n.text = e.text or ""
        for c in e:
            if isinstance(c.tag, str):
                n.children.append(turn(c))
                n.children[-1].tail = c.tail or ""
        return n

    return turn(ET.fromstring(body))


def _lenient(body: bytes) -> _Node:
    text = body.decode("utf-8", "replace")
    root = _Node("", {})
    stack = [root]
    for m in _LENIENT.finditer(text):
        if m[3]:
            name = m[3].removeprefix("atom:")
            if m[2]:
                if any(n.name == name for n in stack[1:]):
                    while stack.pop().name != name:
                        pass
            else:
                node = _Node(name, {a[0]: html.unescape(a[1] or a[2]) for a in _ATTR.findall(m[4])})
                stack[-1].children.append(node)
                if not m[5] and not m[4].endswith("/"):
                    stack.append(node)
        elif m[1] is not None:
            stack[-1].text += m[1]
        elif m[6]:
            stack[-1].text += html.unescape(m[6])
    return root


def _find(node: _Node, names: tuple[str, ...]) -> _Node | None:
    for c in node.children:
        if c.name in names:
            return c
        if (got := _find(c, names)) is not None:
            return got
    return None


def _link(node: _Node, base: str) -> str:
    for c in node.all("link"):
        href = c.attrs.get("href")
        if href and c.attrs.get("rel", "alternate") == "alternate":
            return urljoin(base, href.strip())
        if not href and c.text.strip():
            return urljoin(base, c.text.strip())
    return ""


def _body(entry: _Node) -> str:
    """the longest content of a markup type, else the longest content; the first of equals. Without any, the summary."""
    found = []
    for c in entry.all("content:encoded", "content", "xhtml:body"):
        kind = c.attrs.get("type", "html" if c.name == "content:encoded" else "text")
        text = c.inner() if c.children else c.text
        found.append((("html" in kind), len(text), text.strip()))
    marked = [x for x in found if x[0]] or found
    return max(marked, key=lambda x: x[1])[2] if marked else entry.first("description", "summary")


def _files(entry: _Node, base: str) -> list[dict]:
    out = []
    for c in [*entry.all("enclosure"), *[x for x in entry.all("link") if x.attrs.get("rel") == "enclosure"]]:
        href = c.attrs.get("url") or c.attrs.get("href")
        if href:
            out.append({"url": urljoin(base, href.strip()), "type": c.attrs.get("type", ""), "length": c.attrs.get("length", "")})
    return out


def _tags(entry: _Node) -> list[str]:
    """F13."""
    raw = [c.attrs.get("term") or c.text for c in entry.all("category", "dc:subject")]
    return sorted({t.strip() for t in raw if t and t.strip()})


def _author(entry: _Node) -> str:
    for c in entry.all("author", "dc:creator", "itunes:author"):
        if (name := c.first("name") or c.text.strip()) != "":
            return name
    return ""


def _item(entry: _Node, base: str) -> dict:
    link = _link(entry, base)
    guid = entry.first("guid", "id") or entry.attrs.get("rdf:about", "")
    if not link:
        link = next((c.text.strip() for c in entry.all("guid") if c.attrs.get("isPermaLink", "true") == "true" and c.text.strip().startswith("http")), "")
    comments = entry.first("comments")
    return {
        "guid": guid,
        "url": link,
        "title": entry.first("title", "media:title"),
        "author": _author(entry),
        "summary": entry.first("description", "summary"),
        "content": _body(entry),
        "comments_url": urljoin(base, comments) if comments else "",
        "tags": _tags(entry),
        "enclosures": _files(entry, base),
        # the date of an update is never taken for that of publication, nor the other way round
        "published_at": entry.first("pubDate", "published", "issued", "dc:date"),
        "updated_at": entry.first("updated", "modified"),
    }


def parse_feed(body: bytes | None, url: str = "") -> dict:
    """One document as a dict of ``SCHEMA``'s columns."""
    empty = {c.split()[0]: None for c in SCHEMA.split(", items")[0].replace("array<string>", "array").split(", ")}
    out: dict = {k: "" for k in empty} | {"ttl_minutes": None, "update_period": None, "update_frequency": None, "categories": [], "ok": False, "note": "", "items": []}
    if not body:
        return out | {"note": "empty document"}
    try:
        root = _strict(_DOCTYPE.sub(b"", body))
    except (ET.ParseError, ValueError, LookupError) as e:
        root = _lenient(body)
        out["note"] = str(e)[:NOTE_CHARS]
    channel = root if root.name == "feed" else _find(root, ("channel", "feed")) or root
    entries: list[_Node] = []

    def gather(n: _Node) -> None:
        for c in n.children:
            if c.name in ("item", "entry"):
                entries.append(c)
            gather(c)

    gather(root)
    base = _link(channel, url) or url
    image = next(iter(channel.all("image")), None)
    out |= {
        "title": channel.first("title"),
        "description": channel.first("description", "subtitle", "tagline"),
        "site_url": _link(channel, url),
        "language": channel.first("language", "dc:language") or root.attrs.get("xml:lang", ""),
        "icon_url": channel.first("icon", "logo") or (image.first("url") if image else ""),
        "platform": channel.first("generator"),
        "hub_url": next((c.attrs["href"] for c in channel.all("link", "x:link") if c.attrs.get("rel") == "hub" and c.attrs.get("href")), ""),
        "ttl_minutes": channel.first("ttl") or None,
        "update_period": channel.first("sy:updatePeriod") or None,
        "update_frequency": channel.first("sy:updateFrequency") or None,
        "categories": _tags(channel),
        "items": [_item(e, base) for e in entries],
    }
    out["ok"] = not out["note"] or bool(out["items"])
    return out


def parsed_feeds(documents: DataFrame, body: str = "body", url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """Each document with its columns of ``SCHEMA``: parsed once, whatever the number of its items."""
    keep = keep if keep is not None else [c for c in documents.columns if c != body]
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.select(*keep).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parsed = pd.DataFrame([parse_feed(bytes(x) if x is not None else None, u or "") for x, u in zip(b["_body"], b["_url"], strict=True)], index=b.index)
            yield pd.concat([b[keep], parsed], axis=1)

    return documents.select(*keep, F.col(body).alias("_body"), F.col(url).alias("_url")).mapInPandas(run, f"{kept}, {SCHEMA}")


def items(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each item, with its place in the document."""
    return parsed.select(*keys, F.posexplode("items").alias("item_no", "item")).select(*keys, "item_no", "item.*")
