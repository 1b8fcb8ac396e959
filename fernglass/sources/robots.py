"""robots.txt (A5, A6): rules by RFC 9309, parsed once for each host and applied to many addresses."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, functions as F

AGENT = "fernglass"
DELAY_CAP = 120.0


@dataclass
class Rules:
    """One agent's record: its own, else that for all; records of one agent are one, others never merge."""

    rules: list[tuple[bool, str]] = field(default_factory=list)  # (allow, pattern)
    delay: float | None = None

    def allows(self, url: str) -> bool:
        """The longest matching rule decides, Allow among equals; without one all is allowed, as is /robots.txt."""
        p = urlsplit(url)
        path = _plain(p.path or "/") + (f"?{_plain(p.query)}" if p.query else "")
        if path == "/robots.txt":
            return True
        best, verdict = -1, True
        for allow, pattern in self.rules:
            if len(pattern) >= best and _matches(pattern, path) and (len(pattern) > best or allow):
                best, verdict = len(pattern), allow
        return verdict

    def blocks_everything(self) -> bool:
        """Whether even the home page is banned; single addresses may be allowed beside it."""
        return not self.allows("http://any/")

    def crawl_delay(self) -> float | None:
        return None if self.delay is None else min(self.delay, DELAY_CAP)


def _plain(text: str) -> str:
    return unquote(text)


def _matches(pattern: str, path: str) -> bool:
    end = pattern.endswith("$")
    parts = [re.escape(x) for x in (pattern[:-1] if end else pattern).split("*")]
    return re.match(".*".join(parts) + ("$" if end else ""), path, re.S) is not None


def parse(body: bytes | str | None, agent: str = AGENT) -> Rules:
    text = body.decode("utf-8", "replace") if isinstance(body, bytes) else body or ""
    records: dict[str, Rules] = {}
    names: list[str] = []
    started = False
    for line in text.lstrip("﻿").splitlines():
        key, sep, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not sep:
            continue
        if key == "user-agent":
            if started:
                names, started = [], False
            names.append(value.lower())
            records.setdefault(value.lower(), Rules())
        elif key in ("allow", "disallow", "crawl-delay") and names:
            started = True
            for n in names:
                if key == "crawl-delay":
                    try:
                        seconds = float(value)
                    except ValueError:
                        continue
                    if seconds >= 0:
                        records[n].delay = seconds
                elif value:
                    records[n].rules.append((key == "allow", _plain(value)))
    return records.get(agent.lower()) or records.get("*") or Rules()


def _each_verdict(urls: DataFrame, bodies: DataFrame, agent: str) -> DataFrame:
    """(*urls, known, allowed, blocks_everything, crawl_delay): ``urls`` has host_name and url."""
    joined = urls.join(bodies.select("host_name", F.col("body").alias("_body")), "host_name", "left")
    kept = [c for c in joined.columns if c != "_body"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Rules] = {}
        for b in batches:
            out = []
            for host, url, body in zip(b["host_name"], b["url"], b["_body"], strict=True):
                if body is None:
                    out.append((False, None, None, None))
                    continue
                if host not in held:
                    if len(held) > 10_000:
                        held.clear()
                    held[host] = parse(bytes(body), agent)
                r = held[host]
                out.append((True, r.allows(url or ""), r.blocks_everything(), r.crawl_delay()))
            yield pd.concat([b[kept], pd.DataFrame(out, columns=["known", "allowed", "blocks_everything", "crawl_delay"], index=b.index)], axis=1)

    shape = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in kept)
    return joined.mapInPandas(run, f"{shape}, known boolean, allowed boolean, blocks_everything boolean, crawl_delay double")


def verdicts(urls: DataFrame, bodies: DataFrame, agent: str = AGENT) -> DataFrame:
    """Urls (host_name, url) and bodies (host_name, body) -> (url, known, allowed, blocks_everything, crawl_delay).

    A host's rules are parsed once in each batch that has its addresses; hosts without rules are not known."""
    return _each_verdict(urls.select("host_name", "url"), bodies, agent).select("url", "known", "allowed", "blocks_everything", "crawl_delay")


def poll_verdicts(urls: DataFrame, bodies: DataFrame, agent: str = AGENT) -> DataFrame:
    """(url, may_poll): a rule that names a feed is obeyed, a ban on everything is not; without rules or host it may be polled."""
    each = _each_verdict(urls.select("host_name", "url"), bodies, agent)
    return each.select("url", (~F.col("known") | F.col("allowed") | F.col("blocks_everything")).alias("may_poll"))


def redirect_verdicts(visits: DataFrame, bodies: DataFrame, agent: str = AGENT) -> DataFrame:
    """Visits (visit_id, requested_host, host_name, url: where it ended) -> (visit_id, may_keep): what ended on its own host,
    or on a host without a name, or whose rules are known and allow the address."""
    each = _each_verdict(visits.select("visit_id", "requested_host", "host_name", "url"), bodies, agent)
    host = F.coalesce("host_name", F.lit(""))
    return each.select("visit_id", ((host == F.coalesce("requested_host", F.lit(""))) | (host == "") | (F.col("known") & F.coalesce("allowed", F.lit(False)))).alias("may_keep"))


def may_poll(rules: Rules, url: str) -> bool:
    """Polling a feed ignores a ban on everything, which is meant for crawlers."""
    return rules.blocks_everything() or rules.allows(url)
