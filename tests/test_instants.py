import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from fernglass.operators.instants import instants, parse_instant

CASES = [
    ("2024-01-18T22:09:42.690Z", "UTC", "2024-01-18 22:09:42.690"),
    ("2025-02-30T10:15:00Z", "UTC", None),
    ("2024-01-05T07:46:20", "Europe/Berlin", "2024-01-05 06:46:20"),
    ("2024-03-31T02:30:00", "Europe/Berlin", "2024-03-31 01:30:00"),  # skipped: moves forward by the gap
    ("2024-10-27 02:30:00", "Europe/Berlin", "2024-10-27 00:30:00"),  # twice: the earlier
    ("Thu, 15 Feb 2024 15:55:18 +1100", "UTC", "2024-02-15 04:55:18"),
    ("Sun, 14 Jul 2024 16:30:45 CET", "UTC", "2024-07-14 15:30:45"),  # as written, out of season
    ("12/01/2024 19:54", "America/New_York", "2024-12-02 00:54:00"),
    ("13/01/2024 07:59", "America/New_York", None),
    ("13/01/2024 07:59", "Europe/Paris", "2024-01-13 06:59:00"),
    ("06/02/2024 12:01 AM", "Asia/Kolkata", "2024-02-05 18:31:00"),
    ("06/02/2024 13:01 AM", "Asia/Kolkata", None),
    ("1705151511", "UTC", "2024-01-13 13:11:51"),
    ("1706067388351", "UTC", "2024-01-24 03:36:28.351"),
    ("20240202T182043Z", "UTC", "2024-02-02 18:20:43"),
    ("11 de febrero de 2024 09:40", "America/Mexico_City", "2024-02-11 15:40:00"),
    ("2 de março de 2024 09:40", "Europe/Lisbon", "2024-03-02 09:40:00"),
    ("20 Jan 24 09:27 GMT", "UTC", "2024-01-20 09:27:00"),
    ("January 10, 2024 8:07 pm", "America/New_York", "2024-01-11 01:07:00"),
    ("2024-01-09 20:47:51-08", "UTC", "2024-01-10 04:47:51"),
    ("25 janvier 2024 à 15h36", "Europe/Paris", "2024-01-25 14:36:00"),
    ("12. April 2024, 16:23 Uhr", "Europe/Berlin", "2024-04-12 14:23:00"),
    ("30.01.2024 08:31", "Europe/Berlin", "2024-01-30 07:31:00"),
    ("16 Feb 2024", "Europe/London", "2024-02-16 00:00:00"),
    ("2024-02-02", "Australia/Sydney", "2024-02-01 13:00:00"),
    ("2024-01-18T18:59:18-08:00[America/Los_Angeles]", "UTC", "2024-01-19 02:59:18"),
    ("12 december 2024 14:01", "Europe/Amsterdam", "2024-12-12 13:01:00"),
    (" 2024-03-07 06:01:32 UTC\n", None, "2024-03-07 06:01:32"),
    ("2024-01-16T13:58:19.830036", "UTC", "2024-01-16 13:58:19.830036"),
    ("2024-01-16T24:00:00", "UTC", None),
    ("2024-01-16T10:60:00", "UTC", None),
    ("2024-01-16T10:00:00+99:99", "UTC", None),
    ("2024-02-02", None, None),
    ("2024-02-02", "Nowhere/Land", None),
    ("just now", "UTC", None),
    ("n/a", "UTC", None),
    ("-", "UTC", None),
    ("", "UTC", None),
    (None, "UTC", None),
]


def us(text):
    return None if text is None else round((datetime.fromisoformat(text) - datetime(1970, 1, 1)) / timedelta(microseconds=1))


def test_cases(spark):
    df = spark.createDataFrame([(i, v, z) for i, (v, z, _) in enumerate(CASES)], "i int, v string, z string")
    got = {r.i: r.us for r in df.select("i", parse_instant(F.col("v"), F.col("z")).alias("us")).collect()}
    wrong = [(c, got[i]) for i, c in enumerate(CASES) if got[i] != us(c[2])]
    assert not wrong


def brute(d: datetime, zone: str) -> int:
    """The instant of a local time: the earlier of two, or moved forward by the gap."""
    first = d.replace(tzinfo=ZoneInfo(zone), fold=0)
    return round((first.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "America/Sao_Paulo"])
def test_local_times_against_brute_force(spark, zone):
    rnd = random.Random(zone)
    shapes = ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%d %b %Y %H:%M:%S", "%B %d, %Y %I:%M %p", "%d.%m.%Y %H:%M"]
    rows = []
    for i in range(400):
        day = rnd.choice([datetime(2024, 3, 9), datetime(2024, 3, 30), datetime(2024, 10, 26), datetime(2024, 11, 2), datetime(2024, 4, 6), datetime(2024, 7, 1)])
        d = day + timedelta(minutes=rnd.randint(0, 2880))
        rows.append((i, d.strftime(rnd.choice(shapes)), d))
    df = spark.createDataFrame([(i, v) for i, v, _ in rows], "i int, v string").withColumn("z", F.lit(zone))
    got = {r.i: r.us for r in df.select("i", parse_instant(F.col("v"), F.col("z")).alias("us")).collect()}
    assert [(v, got[i]) for i, v, d in rows if got[i] != brute(d, zone)] == []


def test_operator_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "2024-02-02", "UTC", "x", 0), (1, "2024-02-02", "UTC", "x", 0), (None, "2024-02-02T00:00:00Z", None, None, None), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "key long, published string, tz string, field string, instant_us long")
    got = sorted(instants(df, ["published"], "key", "tz").collect(), key=str)
    assert [tuple(r) for r in got] == sorted([("published", 1, 1706832000000000), ("published", 1, 1706832000000000), ("published", None, 1706832000000000)], key=str)
    assert instants(df.limit(0), ["published"], "key", "tz").collect() == []
    long = spark.createDataFrame([(1, "2024-02-02" + " " * 100_000 + "x" * 100_000, "UTC")], "key long, published string, tz string")
    assert instants(long, ["published"], "key", "tz").collect() == []
