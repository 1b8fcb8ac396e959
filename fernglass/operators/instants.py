"""Timestamps as publishers write them -> one instant in UTC microseconds, or none.

An ordered cascade of anchored patterns; the first that matches decides, and its fields must make
a real date and time (strict). The zone comes from the value, else from ``zone_col`` (the source's
default, looked up by the caller). Policy for local times: a time that occurs twice is the earlier
instant; one that is skipped moves forward by the gap; a date alone is the start of that local day
(which is moved likewise where midnight is skipped). Offsets and zone names in a value are taken as
written, even out of season; where it has an offset and a bracketed zone, the offset counts.

Null, empty and blank values, values without a full date, impossible dates, and local times whose
zone is missing or unknown give null. Whitespace around a value is ignored. Everything is JVM
expressions: one pass, no shuffle, no Python.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, functions as F

# Month names by language.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "nl": "januari februari maart april mei juni juli augustus september oktober november december",
    "en-short": "jan feb mar apr may jun jul aug sep oct nov dec",
    "other": "jänner feber mrz - - - - - sept okt - dez",
}

# Hours east of UTC of the zone names in use, as written, whatever the season.
ZONE_NAMES = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "MEZ": 1, "CEST": 2, "MESZ": 2,
    "EET": 2, "EEST": 3, "MSK": 3, "IST": 5.5, "JST": 9, "AWST": 8, "ACST": 9.5, "AEST": 10, "AEDT": 11,
    "NZST": 12, "NZDT": 13, "BRT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6,
    "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10,
}

#: Zones whose publishers put the month first in all-numeric dates with slashes.
MONTH_FIRST = ("America/New_York", "America/Los_Angeles")

# White space.
_BLANKS = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

_WEEKDAY = r"(?:\p{L}{2,10}\.?,?\s+)?"
_ZONE = r"(?<zone>Z|[A-Za-z]{2,5}|(?:GMT|UTC)?[+-]\d{1,2}(?::?\d{2})?)(?:\[[^\]]*\])?"
_TIME = r"(?<h>\d{1,2}):(?<mi>\d{2})(?::(?<s>\d{2})(?:[.,](?<f>\d{1,9}))?)?"

#: The cascade: (name, pattern, order of the groups y mo d h mi s f ap zone).
CASCADE = [
    ("iso", rf"^(?<y>\d{{4}})-(?<mo>\d{{2}})-(?<d>\d{{2}})(?:[Tt\s]\s*{_TIME}\s*(?:{_ZONE})?)?$"),
    ("rfc", rf"^{_WEEKDAY}(?<d>\d{{1,2}})[ -](?<mo>\p{{L}}{{3,9}})\.?[ -](?<y>\d{{4}}|\d{{2}})(?:\s+{_TIME}(?:\s+{_ZONE})?)?$"),
    ("compact", r"^(?<y>\d{4})(?<mo>\d{2})(?<d>\d{2})T(?<h>\d{2})(?<mi>\d{2})(?<s>\d{2})?(?<zone>Z|[+-]\d{2}:?\d{2})?$"),
    ("slash", rf"^(?<a>\d{{1,2}})/(?<b>\d{{1,2}})/(?<y>\d{{4}})(?:,?\s+{_TIME}(?:\s*(?<ap>[AaPp])\.?[Mm]\.?)?(?:\s+{_ZONE})?)?$"),
    ("dots", rf"^(?<d>\d{{1,2}})\.(?<mo>\d{{1,2}})\.(?<y>\d{{4}})(?:,?\s+{_TIME}(?:\s+Uhr)?(?:\s+{_ZONE})?)?$"),
    ("us", rf"^{_WEEKDAY}(?<mo>\p{{L}}{{3,9}})\.?\s+(?<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?<y>\d{{4}})(?:,?\s+(?:at\s+)?{_TIME}(?:\s*(?<ap>[AaPp])\.?[Mm]\.?)?(?:\s+{_ZONE})?)?$"),
    ("words", rf"^{_WEEKDAY}(?<d>\d{{1,2}})(?:er|\.|º)?\s+(?:de\s+)?(?<mo>\p{{L}}{{3,10}})\.?\s+(?:de\s+)?(?<y>\d{{4}})(?:,?\s+(?:à\s+|a\s+las\s+|às\s+|um\s+|om\s+)?(?<h>\d{{1,2}})[:h](?<mi>\d{{2}})(?::(?<s>\d{{2}}))?(?:\s+(?:Uhr|uur))?(?:\s+{_ZONE})?)?$"),
]
_FIELDS = ("y", "mo", "d", "a", "b", "h", "mi", "s", "f", "ap", "zone")


def _numbered(pattern: str) -> tuple[str, dict[str, int]]:
    """The pattern with plain groups, and the number of each named one."""
    at: dict[str, int] = {}
    out, i, n = [], 0, 0
    while i < len(pattern):
        if pattern[i] == "\\":
            out.append(pattern[i : i + 2])
            i += 2
        elif pattern[i] == "[":
            j = i + 1 + (pattern[i + 1] == "^")
            j = j + 1 if pattern[j] == "]" else j
            while pattern[j] != "]":
                j += 2 if pattern[j] == "\\" else 1
            out.append(pattern[i : j + 1])
            i = j + 1
        elif pattern.startswith("(?<", i) and pattern[i + 3] not in "=!":
            n += 1
            j = pattern.index(">", i)
            at[pattern[i + 3 : j]] = n
            out.append("(")
            i = j + 1
        else:
            n += pattern[i] == "(" and pattern[i + 1] != "?"
            out.append(pattern[i])
            i += 1
    return "".join(out), at


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def parse_instant(value: Column, zone: Column) -> Column:
    """Microseconds since 1970-01-01 UTC that ``value`` denotes, local to ``zone`` where it names none; else null."""
    v = F.btrim(value, F.lit(_BLANKS))
    months = _literal_map({n: i + 1 for names in MONTHS.values() for i, n in enumerate(names.split()) if n != "-"})
    offsets = _literal_map({k: int(h * 3600) for k, h in ZONE_NAMES.items()})

    kinds = F.lit(None).cast("struct<" + ",".join(f"{f}:string" for f in _FIELDS) + ">")
    for _, pattern in reversed(CASCADE):
        plain, at = _numbered(pattern)
        got = F.struct(*[(F.nullif(F.regexp_extract(v, plain, at[f]), F.lit("")) if f in at else F.lit(None).cast("string")).alias(f) for f in _FIELDS])
        kinds = F.when(v.rlike(plain), got).otherwise(kinds)
    num = v.rlike(r"^\d{10}$|^\d{13}$|^\d{16}$")
    epoch = F.when(num, F.rpad(v, 16, "0").cast("long"))

    def local(p: Column) -> Column:
        """Seconds east and local microseconds, from the struct of matched fields."""
        first = zone.isin(*MONTH_FIRST)
        month = F.coalesce(p["mo"], F.when(first, p["a"]).otherwise(p["b"]))
        day = F.coalesce(p["d"], F.when(first, p["b"]).otherwise(p["a"]))
        mo = F.when(month.rlike(r"^\d+$"), month.cast("int")).otherwise(F.try_element_at(months, F.lower(month)))
        y = F.when(F.length(p["y"]) == 2, p["y"].cast("int") + F.when(p["y"].cast("int") < 70, 2000).otherwise(1900)).otherwise(p["y"].cast("int"))
        h0 = F.coalesce(p["h"].cast("int"), F.lit(0))
        ap = F.lower(p["ap"])
        h = F.when(ap.isNull(), h0).when((h0 < 1) | (h0 > 12), F.lit(None)).otherwise(h0 % 12 + F.when(ap == "p", 12).otherwise(0))
        s = F.coalesce(p["s"].cast("int"), F.lit(0))
        ts = F.when((h < 24) & (s < 60), F.try_make_timestamp_ntz(y, mo, day.cast("int"), h, F.coalesce(p["mi"].cast("int"), F.lit(0)), s.cast("decimal(8,6)")))
        us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts) + F.coalesce(F.rpad(F.substring(p["f"], 1, 6), 6, "0").cast("long"), F.lit(0))
        z = F.upper(p["zone"])
        sign = F.when(z.contains("-"), -1).otherwise(1)
        digits = F.regexp_replace(z, r"[^0-9]", "")
        digits = F.when(F.length(digits) <= 2, F.concat(F.lpad(digits, 2, "0"), F.lit("00"))).otherwise(F.lpad(digits, 4, "0"))
        numeric = F.when((F.substring(digits, 1, 2).cast("int") <= 18) & (F.substring(digits, 3, 2).cast("int") < 60), sign * (F.substring(digits, 1, 2).cast("int") * 3600 + F.substring(digits, 3, 2).cast("int") * 60))
        east = F.when(z.rlike(r"[0-9]"), numeric).otherwise(F.try_element_at(offsets, z))
        known = F.when(zone.isin(*sorted(available_timezones())), zone)
        there = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(us), F.coalesce(known, F.lit("UTC"))))
        return F.when(z.isNotNull(), us - east.cast("long") * 1_000_000).otherwise(F.when(known.isNotNull(), there))

    # transform() over a one-element array binds the struct once, so that each pattern runs once a value
    return F.coalesce(epoch, F.element_at(F.transform(F.array(kinds), local), 1))


def instants(df: DataFrame, fields: list[str], record_id: str, zone_col: str) -> DataFrame:
    """(field, record_id, instant_us): a row for each value of ``fields`` that denotes an instant.

    ``df`` may have any further columns; rows come out once for each row of the input.
    """
    each = [df.select(F.lit(f).alias("field"), F.col(record_id).alias("record_id"), F.col(f).alias("v"), F.col(zone_col).alias("z")) for f in fields]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    # a publisher's stamps repeat: the cascade runs over non-empty values only
    return out.where(F.trim("v") != "").select("field", "record_id", parse_instant(F.col("v"), F.col("z")).alias("instant_us")).where(F.col("instant_us").isNotNull())
