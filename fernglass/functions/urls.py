"""URL functions (F1, F2, F7-F10): native column expressions, no Python in the row path."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Query parameters that track and do not identify.
TRACKING_PREFIXES = ("utm_", "pk_", "mtm_", "matomo_", "piwik_", "hsa_")
TRACKING_NAMES = (
    "fbclid", "gclid", "dclid", "gbraid", "wbraid", "msclkid", "twclid", "igshid", "mc_cid", "mc_eid",
    "cmp", "smid", "at_medium", "at_campaign", "at_custom1", "at_custom2", "at_custom3", "at_custom4", "ncid", "sh",
)

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def is_tracking(key: Column) -> Column:
    """whether a parameter's name (in any case) is one that only tracks."""
    k = F.lower(key)
    out = k.isin(*TRACKING_NAMES)
    for p in TRACKING_PREFIXES:
        out = out | k.startswith(p)
    return out


def _plus_decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def _plus_encoded(x: Column) -> Column:
    """As a form encodes: space as +, all but letters, digits and _.-~ as percent escapes."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """one spelling for all addresses of a page. Null and blank give ''; without a host the trimmed input.

    Scheme and host in lower case without one leading www., a default port, user and fragment;
    no trailing slashes (a bare host has one); parameters without those that track, sorted."""
    u = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(u, _SPLIT, 1))
    netloc = F.lower(F.regexp_replace(F.regexp_extract(u, _SPLIT, 2), r"^.*@", ""))
    host = F.regexp_replace(F.regexp_replace(netloc, r":\d*$", ""), r"^www\.", "")
    port = F.regexp_extract(netloc, r":(\d+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    place = F.concat(host, F.when((port != "") & ~default, F.concat(F.lit(":"), port)).otherwise(""))
    path = F.regexp_replace(F.regexp_extract(u, _SPLIT, 3), r"/+$", "")
    raw = F.filter(F.split(F.regexp_extract(u, _SPLIT, 4), "&"), lambda p: p != "")
    pairs = F.transform(raw, lambda p: F.struct(_plus_decoded(F.substring_index(p, "=", 1)).alias("k"), _plus_decoded(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, r"^[^=]*=", "")).otherwise("")).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~is_tracking(p["k"])))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_plus_encoded(p["k"]), F.lit("="), _plus_encoded(p["v"]))), "&")
    whole = F.concat(F.when(scheme != "", F.concat(scheme, F.lit("://"))).otherwise("//"), place, F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(u == "", "").when(netloc == "", u).otherwise(whole)


def host_of(url: Column) -> Column:
    """the host that politeness counts by: lower case, names beyond ASCII in their ASCII form (IDNA), one leading www.
    off, '' unless a plain http(s) address."""
    u = F.trim(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(u, r"^(?i)https?://(?:[^@/?#\s]*@)?([^:/?#@\s\[\]]+)(?::\d*)?(?:[/?#].*)?$", 1)
    low = F.lower(host)
    plain = F.when(low.rlike(r"[^\x00-\x7f]"), F.coalesce(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), low), low)).otherwise(low)
    return F.regexp_replace(plain, r"^www\.", "")


def with_www(url: Column) -> Column:
    """F8: the same address on the www host; as it is if it has www already or is no http(s) address."""
    return F.when((host_of(url) != "") & ~F.lower(url).rlike(r"^https?://(?:[^@/?#]*@)?www\."), F.regexp_replace(url, r"^((?i)https?://)((?:[^@/?#]*@)?)", "$1$2www.")).otherwise(url)


def host_lock(host: Column) -> Column:
    """the name of a host's lock, or null."""
    return F.when(F.coalesce(host, F.lit("")) != "", F.concat(F.lit("host:"), host))


def _resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    def one(b: str | None, h: str | None) -> str | None:
        if h is None:
            return None
        try:
            return urljoin(b or "", h.strip())
        except ValueError:
            return h

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def resolved(base: Column | str, href: Column | str) -> Column:
    """a reference resolved against its base (RFC 3986); the reference itself where that fails."""
    return F.pandas_udf(_resolved, StringType())(base, href)
