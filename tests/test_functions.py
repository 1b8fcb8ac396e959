import random

from pyspark.sql import functions as F

from fernglass.functions import pace, texts, urls

URLS = [
    (None, ""),
    ("  ", ""),
    ("https://Example.com/a/", "https://example.com/a"),
    ("https://www.example.com", "https://example.com/"),
    ("https://www.www.example.com/", "https://www.example.com/"),
    ("http://example.com:80/x", "http://example.com/x"),
    ("https://example.com:8443/x//", "https://example.com:8443/x"),
    ("https://user:pw@example.com/x#top", "https://example.com/x"),
    ("https://example.com/x?utm_source=a&b=2&a=1&fbclid=z&UTM_X=1", "https://example.com/x?a=1&b=2"),
    ("https://example.com/x?q=a+b&empty=", "https://example.com/x?empty=&q=a+b"),
    ("https://example.com/x?flag", "https://example.com/x?flag="),
    ("https://example.com/x?p=%7Ea%2Ab", "https://example.com/x?p=~a%2Ab"),
    ("/relative/path", "/relative/path"),
    ("mailto:a@b.c", "mailto:a@b.c"),
]


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", fn(F.col("v"))).collect())]


def test_canonical_url(spark):
    assert column(spark, [u for u, _ in URLS], urls.canonical_url) == [c for _, c in URLS]


def test_canonical_url_is_idempotent(spark):
    rnd = random.Random(3)
    made = ["".join([rnd.choice(["http", "HTTPS"]), "://", rnd.choice(["", "u@"]), rnd.choice(["www.", ""]), "Ex.org", rnd.choice(["", ":80", ":443", ":9"]), "/" * rnd.randint(0, 3), rnd.choice(["a b", "p/q", "%zz", "é"]), rnd.choice(["", "?b=2&a=%20x&utm_a=1", "?&&=", "?a=b=c"]), rnd.choice(["", "#f"])]) for _ in range(200)]
    once = column(spark, made, urls.canonical_url)
    assert column(spark, once, urls.canonical_url) == once


def test_hosts(spark):
    cases = [("https://www.Example.com/x", "example.com"), ("http://a.b:80", "a.b"), ("ftp://a.b/", ""), ("nonsense", ""), (None, ""), ("https://u@h.io?x", "h.io")]
    assert column(spark, [u for u, _ in cases], urls.host_of) == [h for _, h in cases]
    assert column(spark, ["https://a.b/x", "https://u:p@a.b:81/", "https://www.a.b/", "mailto:x"], urls.with_www) == ["https://www.a.b/x", "https://u:p@www.a.b:81/", "https://www.a.b/", "mailto:x"]
    assert column(spark, ["a.b", "", None], urls.host_lock) == ["host:a.b", None, None]
    df = spark.createDataFrame([("https://a.b/c/d", "../e"), ("https://a.b/c", None), ("https://a.b/", " //x.y/z ")], "b string, h string")
    assert [r[0] for r in df.select(urls.resolved("b", "h")).collect()] == ["https://a.b/e", None, "https://x.y/z"]


def test_fingerprints_and_identity(spark):
    df = spark.createDataFrame([("a  b<!-- x -->", None), ("a b", ""), ("a", "b")], "x string, y string")
    a, b, c = [r[0] for r in df.select(texts.fingerprint(F.col("x"), F.col("y"))).collect()]
    assert a == b != c
    df = spark.createDataFrame([("g", "u", "t"), ("", "u", "t"), (None, "", "t"), (None, None, "t")], "g string, u string, t string")
    got = [tuple(r[0]) for r in df.select(texts.identity(F.col("g"), F.col("u"), F.col("t"), F.lit(None).cast("string"), F.lit(""))).collect()]
    assert [t for _, t in got] == ["guid", "link", "hash", "hash"] and got[2] == got[3] and got[0][0] == "g"


def test_measures(spark):
    body = "One [a link](https://x.y/z) here.\n\n \n\n![img](https://x.y/i.png)\n\nEnd"
    df = spark.createDataFrame([(body,), ("",), (None,)], "b string")
    got = df.select(texts.char_count(F.col("b")), texts.paragraph_count(F.col("b")), texts.link_density(F.col("b")), F.size(texts.links(F.coalesce("b", F.lit("")))), F.size(texts.images(F.coalesce("b", F.lit(""))))).collect()
    assert tuple(got[0]) == (len(body), 3, round(9 / len(body), 4), 2, 1)
    assert tuple(got[1])[:3] == (0, 0, 0.0) == tuple(got[2])[:3]
    df = spark.createDataFrame([(0, 0), (499, 9), (500, 2), (500, 3)], "c int, p int")
    assert [r[0] for r in df.select(texts.judge(F.col("c"), F.col("p"))["note"]).collect()] == ["nothing extracted", "too short", "too few paragraphs", ""]
    df = spark.createDataFrame([(["b", " a ", "", "a"],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(texts.terms(F.col("t"))).collect()] == [["a", "b"], []]
    assert column(spark, ["Ab%c", "x", None], lambda c: texts.contains_text(c, F.lit("B%"))) == [True, False, None]
    assert column(spark, ["Ab"], lambda c: texts.contains_text(c, F.lit(""))) == [True]


def test_backoff_equals_python(spark):
    for p in (pace.CAPTURE_RETRY, pace.HOST_PROBE, pace.INGEST):
        want = [int(min(max(p.minimum * p.factor**f, p.minimum), p.maximum)) for f in range(9)]
        assert column(spark, list(range(9)), lambda c, p=p: pace.interval(c, p), "int") == want


def test_schedule(spark):
    rows = [(1800, 3, 0, None), (1800, 0, 0, None), (1800, 0, 0, 3600), (1800, 0, 0, 172800), (0, 0, 0, None), (None, 1, 0, None), (1800, 0, 2, None), (86400, 0, 0, None)]
    df = spark.createDataFrame(rows, "c int, n int, f int, t int")
    assert [r[0] for r in df.select(pace.next_interval(F.col("c"), F.col("n"), F.col("f"), F.col("t"))).collect()] == [900, 2700, 3600, 172800, 2700, 900, 7200, 86400]
    rows = [(429, "120"), (503, "7200"), (503, "Wed, 21 Oct 2025 07:28:00 GMT"), (429, "999999"), (200, "120"), (429, None)]
    df = spark.createDataFrame(rows, "s int, h string")
    assert [r[0] for r in df.select(pace.retry_after(F.col("s"), F.col("h"))).collect()] == [300, 7200, 86400, 86400, None, None]
    df = spark.createDataFrame([("45", None, None), (None, "hourly", "2"), ("x", "Daily", None), (None, None, None), ("-5", None, None)], "t string, p string, f string")
    assert [r[0] for r in df.select(pace.ttl_seconds(F.col("t"), F.col("p"), F.col("f"))).collect()] == [2700, 1800, 86400, None, 0]


def test_unicode_space_is_space_and_hosts_have_one_spelling(spark):
    df = spark.createDataFrame([("a  b  c ", "https://www.Bücher.example/x"), ("a b c", "https://xn--bcher-kva.example/y")], "t string, u string")
    rows = df.select(texts.normalise_text(F.col("t")).alias("t"), urls.host_of(F.col("u")).alias("h")).collect()
    assert rows[0] == rows[1] and rows[0].h == "xn--bcher-kva.example"
