from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fernglass.operators import changes, latest, observe, reading, rules, runs, sweeps, upsert, visits

T0 = datetime(2024, 1, 1)


def hour(n):
    return T0 + timedelta(hours=n)


def log(spark, stories):
    """One log for each key: letters are outcomes, an hour apart. F failed, G failed with 410, o ok, n not modified, d disallowed."""
    names = {"F": ("failed", 500), "G": ("failed", 410), "o": ("ok", 200), "n": ("not_modified", 304), "d": ("disallowed", None)}
    rows, i = [], 0
    for key, story in stories.items():
        for h, c in enumerate(story):
            i += 1
            rows.append((key, hour(h), i, *names[c]))
    return spark.createDataFrame(rows, "feed_id long, polled_at timestamp_ntz, log_id long, outcome string, status int")


def test_poll_runs(spark):
    polls = log(spark, {1: "FFoFFF", 2: "FFn", 3: "Fd", 4: "G", 5: "Go", 6: "FFF"})
    run = {r.feed_id: r.run_length for r in runs.feed_failures(polls).collect()}
    assert run == {1: 3, 4: 1, 6: 3}
    assert {r.feed_id for r in runs.gone(polls).collect()} == {4, 5}
    counts, resets = F.col("outcome") == "failed", F.col("outcome") != "failed"
    one = sorted(runs.tail_run(polls, "feed_id", "polled_at", counts, resets).collect())
    assert one == sorted(runs.tail_run_two_step(polls, "feed_id", "polled_at", counts, resets).collect())
    entities = spark.createDataFrame([(1,), (9,)], "feed_id long")
    health = {r.feed_id: (r.run_length, r.gone, r.last_outcome, r.visits) for r in runs.health(entities, polls, "feed_id", "polled_at", counts, resets).collect()}
    assert health == {1: (3, False, "failed", 6), 9: (0, False, None, 0)}


def test_a_count_at_the_time_of_the_reset_is_past(spark):
    df = spark.createDataFrame([(1, T0, "F"), (1, T0, "o"), (2, T0, "F")], "k long, at timestamp_ntz, x string")
    assert {r.k: r.run_length for r in runs.tail_run(df, "k", "at", F.col("x") == "F", F.col("x") == "o").collect()} == {2: 1}
    assert runs.tail_run(df.limit(0), "k", "at", F.col("x") == "F", F.col("x") == "o").collect() == []


def test_latest_and_chains(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, T0), (1, 3, T0), (2, 4, None)], "k long, id long, at timestamp_ntz")
    assert sorted(r.id for r in latest.latest_by(df, ["k"], ["at", "id"]).collect()) == [3, 4]
    v = spark.createDataFrame([(1, 1, None), (2, 1, 1), (3, 1, 2), (4, 2, None)], "version_id long, item_id long, supersedes_id long")
    assert sorted(r.version_id for r in latest.heads(v).collect()) == [3, 4]
    assert {r.version_id: (r.revision, r.previous_id, r.version_count) for r in latest.revisions(v).collect()} == {1: (1, None, 3), 2: (2, 1, 3), 3: (3, 2, 3), 4: (1, None, 1)}
    assert latest.chain_violations(v).collect() == []
    bad = spark.createDataFrame([(1, 1, None), (2, 1, None), (3, 2, 1), (4, 2, None), (15, 3, 9), (6, 4, 6)], "version_id long, item_id long, supersedes_id long")
    assert {r.version_id: r.fault for r in latest.chain_violations(bad).collect()} == {1: "not one root", 2: "not one root", 3: "supersedes another item", 15: "supersedes no version", 6: "not after the version it supersedes"}
    j = spark.createDataFrame([("g", 1, 30.0), ("b", 2, None), ("g", 3, 30.0), ("b", 4, None)], "host string, n int, d double")
    assert {r.n: r.delay for r in latest.staggered(j, "host", ["n"], "d").collect()} == {1: 0.0, 2: 0.0, 3: 30.0, 4: 5.0}


def test_upsert(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "n", "z")], "k long, stamp string, body string")
    s = spark.createDataFrame([(2, "B", "new", 1), (2, "BB", "newer", 2), (3, "c", "w", 1), (None, "N", "q", 1)], "k long, stamp string, body string, o int")
    got = {r.k: (r.stamp, r.body, r.disposition) for r in upsert.upsert(t, s, ["k"], ["stamp"], ["o"]).collect()}
    assert got == {1: ("a", "x", "kept"), 2: ("BB", "y", "updated"), 3: ("c", "w", "inserted"), None: ("N", "z", "updated")}
    more = upsert.insert_missing(t.select("k"), s.select("k"), ["k"])
    assert sorted(r.k for r in more.collect() if r.k is not None) == [1, 2, 3]


def test_snapshots(spark, tmp_path):
    held = upsert.Snapshots(spark, f"file://{tmp_path}/t")
    assert held.read() is None
    assert held.commit(spark.range(3), 0) and held.read().count() == 3
    assert not held.commit(spark.range(9), 0) and held.read().count() == 3
    assert held.commit(held.read().union(spark.range(1)), 1) and held.read().count() == 4


def test_changed_documents(spark):
    d = spark.createDataFrame([(1, 1, "A"), (1, 2, "A"), (1, 3, "B"), (1, 4, "A"), (2, 5, None), (2, 6, None)], "feed_id long, n long, h string")
    got = changes.changed_from_previous(d, "feed_id", ["n"], F.col("h"))
    assert sorted(r.n for r in got.collect()) == [1, 3, 4, 5, 6]  # a null before always differs


def test_dispositions(spark):
    def row(feed, doc, pid, no, guid, url, title):
        return (feed, doc, pid, no, hour(doc), guid, url, title, None, None, None, None, None, None, None, None)

    rows = [
        row(1, 1, 1, 0, "a", "https://x/1", "t"),
        row(1, 1, 2, 1, "a", "https://x/1", "again"),  # duplicate in its document
        row(1, 2, 3, 0, "a", "https://x/1", "t"),  # unchanged
        row(1, 3, 4, 0, "a", "https://x/1", "edited"),  # version
        row(1, 4, 5, 0, "b", "https://x/1", "t"),  # new guid at a known address: churn
        row(2, 1, 6, 0, "b", "https://x/1", "t"),  # another feed: no churn
    ]
    schema = "feed_id long, document_id long, parsed_id long, item_no int, observed_at timestamp_ntz, guid string, canonical_url string, title string, author string, summary string, content string, comments_url string, tags array<string>, enclosures array<struct<url:string,type:string,length:string>>, published_at string, updated_at string"
    seen = changes.sightings(spark.createDataFrame(rows, schema))
    marked = changes.dispositions(seen)
    assert {r.parsed_id: (r.disposition, r.churn) for r in marked.collect()} == {1: ("new", False), 2: ("duplicate", False), 3: ("unchanged", False), 4: ("version", False), 5: ("new", True), 6: ("new", False)}
    t = {r.feed_id: r for r in changes.tally(marked, "feed_id").collect()}
    assert (t[1].new_items, t[1].new_versions, t[1].unchanged, t[1].duplicate_identity, t[1].guid_churn) == (2, 1, 1, 1, 1)


def test_reading(spark):
    rows = [(1, 10, "page", hour(0), "long old text of the page"), (2, 10, "page", hour(1), "page"), (3, 10, "feed", hour(0), "feed"), (4, 11, "feed", hour(0), "fuller feed"), (5, 11, "page", hour(0), "page"), (6, 12, "other", hour(0), None)]
    r = spark.createDataFrame(rows, "extraction_id long, version_id long, source string, created_at timestamp_ntz, body string")
    got = {x.version_id: (x.source, x.body) for x in reading.fullest_reading(r, "version_id", spark.createDataFrame([(10,), (11,), (12,), (13,)], "version_id long")).collect()}
    assert got == {10: ("feed", "feed"), 11: ("feed", "fuller feed"), 12: ("other", ""), 13: (None, "")}
    c = spark.createDataFrame([(1, hour(0), 1, b"x"), (1, hour(1), 2, b""), (2, hour(0), 3, b"x")], "version_id long, captured_at timestamp_ntz, capture_id long, body binary")
    assert [x.version_id for x in reading.has_feed_text(c).collect()] == [2]


def test_rules(spark):
    items = spark.createDataFrame([(1, 1, "Big SALE today", "https://a/x"), (2, 2, "sale", "https://b/y"), (3, 1, None, "https://a/100%_off"), (4, 3, "news", "https://c/z")], "version_id long, feed_id long, title string, url string")
    r = spark.createDataFrame([("title_phrase", "sale", True, 1), ("title_phrase", "NEWS", False, None), ("url_pattern", "100%_", True, None)], "dimension string, pattern string, blocks boolean, feed_id long")
    assert sorted(x.version_id for x in rules.blocked(items, r, "version_id", {"title_phrase": "title", "url_pattern": "url"}).collect()) == [1, 3]
    everything = spark.createDataFrame([("title_phrase", "", True, None)], "dimension string, pattern string, blocks boolean, feed_id long")
    assert sorted(x.version_id for x in rules.blocked(items, everything, "version_id", {"title_phrase": "title"}).collect()) == [1, 2, 4]


def test_due_captures(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    v = [(i, 100 + i, 1, None, hour(i), f"https://h{i}.io/x") for i in range(1, 9)]
    v += [(20, 200, 1, None, hour(1), "https://h1.io/old"), (21, 200, 1, 20, hour(23.5), "https://h1.io/new")]  # a fresh edit is not settled
    versions = spark.createDataFrame(v, "version_id long, item_id long, feed_id long, supersedes_id long, observed_at timestamp_ntz, target string")
    captures = [
        (1, 1, hour(2), "ok", "2"),  # captured
        (2, 2, hour(2), "gone", "2"),  # stays due, as in the archive
        (3, 3, hour(23.9), "failed", "2"),  # backing off
        (4, 4, hour(2), "failed", "1"),  # under an old policy: never tried
        (5, 5, hour(9), "disallowed", "2"),  # since the rules were read: settled
        (6, 6, hour(1), "disallowed", "2"),  # before they were read anew: due
    ]
    c = spark.createDataFrame(captures, "version_id long, host_id long, fetched_at timestamp_ntz, outcome string, capture_policy string")
    robots = spark.createDataFrame([(i, hour(5)) for i in range(1, 8)], "host_id long, fetched_at timestamp_ntz")
    hosts = spark.createDataFrame([(i, f"h{i}.io") for i in range(1, 9)], "host_id long, host_name string")
    subs = spark.createDataFrame([(1, True), (2, False)], "feed_id long, active boolean")
    blocked = spark.createDataFrame([(7,)], "version_id long")
    due = sweeps.due_captures(versions, subs, c, robots, hosts, blocked, now)
    assert [r.version_id for r in due.orderBy("observed_at").collect()] == [2, 4, 6]  # 8 has no known rules
    assert sweeps.due_captures(versions, subs.where("feed_id = 2"), c, robots, hosts, blocked, now).collect() == []
    two = sweeps.due_captures(versions, subs, c, robots, hosts, blocked, now, limit=2, rules_before_limit=True)
    assert sorted(r.version_id for r in two.collect()) == [2, 4]


def test_visits(spark):
    rows = [(False, True, False, 200, None, "https://a.b/", None, None), (True, False, False, 200, None, None, None, None), (True, True, True, 200, None, None, None, None), (True, True, False, None, "timeout", None, None, None), (True, True, False, 404, None, "https://a.b/", None, None), (True, True, False, 200, None, "https://www.a.b/", None, None), (True, True, False, 200, None, "https://c.d/", None, None), (True, True, False, 200, None, "https://c.d/", True, False), (True, True, False, 200, None, "https://c.d/", True, True)]
    jobs = spark.createDataFrame([(*r, "https://a.b/x") for r in rows], "rules_known boolean, allowed boolean, host_refuses boolean, status int, error string, final_url string, redirect_known boolean, redirect_allowed boolean, target string")
    assert [r.outcome for r in visits.capture_ladder(jobs).collect()] == ["unknown_rules", "disallowed", "refused", "failed", "gone", "ok", "unknown_rules", "disallowed", "ok"]
    a = spark.createDataFrame([("https://a.b/robots.txt", "https://a.b/robots.txt", b"x", 200, None, T0), ("https://a.b/robots.txt", "https://z.z/", b"x", 200, None, T0), ("https://a.b/robots.txt", None, None, None, "timeout", T0)], "url string, final_url string, body binary, status int, error string, fetched_at timestamp_ntz")
    got = visits.robots_read(a).collect()
    assert [bytes(r.body) for r in got] == [b"x", b"", b""] and [r.expires_at for r in got] == [hour(24), hour(1), hour(1)]
    p = spark.createDataFrame([(200, {"content-type": "text/html; charset=utf-8"}, b"x", None), (200, {"content-type": "image/png"}, b"x", None), (404, {}, b"x", None), (200, {"content-type": "TEXT/HTML"}, b"x" * 20, None)], "status int, headers map<string,string>, body binary, error string")
    assert [r.error for r in visits.accepted(p, cap_bytes=10).collect()] == [None, "wrong content type", None, "too large"]


def test_observe(spark):
    e = spark.createDataFrame([(hour(0), "ok", 1.0), (hour(7), "ok", 3.0), (hour(13), "bad", 2.0)], "ts timestamp_ntz, kind string, v double")
    now = F.lit(hour(13.5).isoformat(" ")).cast("timestamp_ntz")
    assert observe.silent(e, F.col("kind") == "ok", "ts", now, 3).count() == 1 and observe.silent(e, F.col("kind") == "bad", "ts", now, 3).count() == 0
    assert observe.overdue(e, F.col("kind") == "none", "ts", now, 1).count() == 1
    assert [(r.n, r.total) for r in observe.bucketed(e, "ts", "kind", "v", "6 hours", now).orderBy("bucket").collect()] == [(1, 1.0), (1, 3.0)]
    assert {r.status: r.jobs for r in observe.depths(e.select(F.col("kind").alias("status")), ("ok", "lost")).collect()} == {"ok": 2, "lost": 0}


def test_rules_in_passes(spark, monkeypatch):
    from fernglass.operators import rules

    items = spark.createDataFrame([(i, 1, f"word{i} and more") for i in range(30)] + [(99, 2, None)], "id long, feed_id long, title string")
    some = spark.createDataFrame([(f"WORD{i} ", "title", True, None) for i in range(0, 30, 3)] + [("more", "title", True, 2), ("zz", "title", False, None), (None, "title", True, None)], "pattern string, dimension string, blocks boolean, feed_id long")
    monkeypatch.setattr(rules, "RULES_A_PASS", 4)
    assert sorted(r.id for r in rules.blocked(items, some, "id", {"title": "title"}).collect()) == list(range(0, 30, 3))
