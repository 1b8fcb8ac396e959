"""Pages to article texts (A1-A3): the main text as Markdown, with links, images and what the page says of itself.

This is the archive's own extractor, by structure alone (the trained one is an optional part): scripts, navigation and
forms go, an article or main element is preferred, blocks become paragraphs, headings, lists and quotations.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, functions as F

EXTRACTOR, EXTRACTOR_VERSION = "structure", "1"

_DROP = {"script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form", "svg", "iframe", "button"}
_BLOCK = {"p", "div", "section", "article", "main", "li", "ul", "ol", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "table", "tr", "figure", "figcaption", "dl", "dt", "dd", "br", "hr", "body"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr"}
_BLANKS = re.compile(r"[ \t\r\n\f\v]+")

SCHEMA = "body string, title string, byline string, language string, site_name string, page_type string, published_claim string, links array<struct<anchor:string,url:string>>, images array<struct<url:string,alt:string,role:string>>"


class _Reader(HTMLParser):
    def __init__(self, base: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.meta, self.lang, self.data = base, {}, "", ""
        self.stack: list[str] = []
        self.dropped = 0
        self.inside: list[str] = []  # of article or main, as they open
        self.blocks: list[tuple[str, str, bool]] = []  # (tag, text, inside main)
        self.now: list[str] = []
        self.anchor: str | None = None
        self.images: list[dict] = []
        self.in_title = self.in_data = False

    def _flush(self, tag: str) -> None:
        text = _BLANKS.sub(" ", "".join(self.now)).strip()
        if text:
            self.blocks.append((tag, text, bool(self.inside)))
        self.now = []

    def _leaf(self) -> str:
        for t in reversed(self.stack):
            if t in ("h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre"):
                return t
        return "p"

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = a.get("lang", "")
        elif tag == "meta" and (key := a.get("property") or a.get("name")):
            self.meta.setdefault(key.lower(), a.get("content", ""))
        elif tag == "title":
            self.in_title = True
        if tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self.in_data = True
        if tag in _BLOCK and not self.dropped:
            self._flush(self._leaf())
        if tag == "img" and not self.dropped and a.get("src"):
            self.images.append({"url": urljoin(self.base, a["src"].strip()), "alt": a.get("alt", "")[:2000], "role": "body"})
        if tag in _VOID:
            return
        self.stack.append(tag)
        if tag in _DROP:
            self.dropped += 1
        elif tag in ("article", "main"):
            self.inside.append(tag)
        elif tag == "a" and not self.dropped and a.get("href", "").strip():
            self.anchor = urljoin(self.base, a["href"].strip())
            self.now.append("[")

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if tag not in self.stack:
            return
        if tag in _BLOCK and not self.dropped:
            self._flush(self._leaf())
        while self.stack:
            t = self.stack.pop()
            if t in _DROP:
                self.dropped -= 1
                self.in_data = False
            elif t in ("article", "main") and self.inside:
                self.inside.pop()
            elif t == "a" and self.anchor is not None:
                self.now.append(f"]({self.anchor})" if self.anchor.startswith(("http://", "https://")) else "]")
                self.anchor = None
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.in_data:
            self.data += data
        elif self.in_title and not self.meta.get("_title"):
            self.meta["_title"] = data.strip()
        elif not self.dropped and ("body" in self.stack or self.stack[:1] != ["html"]):
            self.now.append(data)


def _json_ld(text: str) -> dict:
    try:
        found = json.loads(text) if text.strip() else {}
    except ValueError:
        return {}
    found = found[0] if isinstance(found, list) and found else found
    return found if isinstance(found, dict) else {}


def extract(page: str | None, url: str = "", fragment: bool = False) -> dict:
    """A1; A2 with ``fragment``: no metadata and no lead image. An empty page is an empty article."""
    r = _Reader(url)
    r.feed(page or "")
    r.close()
    r._flush(r._leaf())
    blocks = [b for b in r.blocks if b[2]] or r.blocks
    out: list[str] = []
    for tag, text, _ in blocks:
        text = re.sub(r"\[\s*\](?:\([^)]*\))?", "", text).strip()
        if not text:
            continue
        mark = "#" * int(tag[1]) + " " if tag[0] == "h" and tag[1:].isdigit() else "- " if tag == "li" else "> " if tag == "blockquote" else ""
        sep = "\n" if out and tag == "li" and out[-1].lstrip("\n").startswith("- ") else "\n\n" if out else ""
        out.append(sep + mark + text)
    body = "".join(out)
    links = [{"anchor": a, "url": u} for a, u in re.findall(r"\[([^\]\n]*)\]\((https?://[^)\s]+)\)", body)]
    if fragment:
        return {"body": body, "title": "", "byline": "", "language": "", "site_name": "", "page_type": "", "published_claim": "", "links": links, "images": r.images}
    ld = _json_ld(r.data)
    author = ld.get("author")
    author = author[0] if isinstance(author, list) and author else author
    lead = r.meta.get("og:image") or (ld.get("image") if isinstance(ld.get("image"), str) else "")
    lead = urljoin(url, lead) if lead else ""
    images = ([{"url": lead, "alt": "", "role": "lead"}] if lead else []) + [i for i in r.images if i["url"] != lead]
    return {
        "body": body,
        "title": r.meta.get("og:title") or str(ld.get("headline") or "") or r.meta.get("_title", ""),
        "byline": r.meta.get("author") or (str(author.get("name", "")) if isinstance(author, dict) else str(author or "")),
        "language": r.lang[:32],
        "site_name": r.meta.get("og:site_name", ""),
        "page_type": r.meta.get("og:type", "")[:32],
        "published_claim": (r.meta.get("article:published_time") or str(ld.get("datePublished") or ""))[:32],
        "links": links,
        "images": images,
    }


def extracted(pages: DataFrame, key: str, body: str = "body", url: str = "final_url", fragment: bool = False) -> DataFrame:
    """(key, *SCHEMA): one extraction for each page, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for data, u in zip(b["_body"], b["_url"], strict=True):
                raw = bytes(data) if data is not None else b""
                try:
                    text = raw.decode("utf-8")
                except UnicodeDecodeError:
                    text = raw.decode("cp1252", "replace")
                rows.append(extract(text, u or "", fragment))
            yield pd.concat([b[[key]], pd.DataFrame(rows, index=b.index)], axis=1)

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, F.col(body).alias("_body"), F.col(url).alias("_url")).mapInPandas(run, f"{key} {kind}, {SCHEMA}")
