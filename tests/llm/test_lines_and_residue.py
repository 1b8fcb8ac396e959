import random

import pytest
from pyspark.sql import functions as F

from fernglass.llm import residue, sitelines


def articles(spark, rows):
    return spark.createDataFrame(rows, "id long, site string, body string, title string, line_no long, h string")


def brute_lines(rows, least):
    def key(s):
        return " ".join(s.lower().replace(" ", " ").split())

    held: dict = {}
    for i, site, body, *_ in rows:
        if site and body is not None:
            for ln in body.split("\n"):
                if key(ln):
                    held.setdefault((site, key(ln)), set()).add(i)
    out = []
    for i, site, body, *_ in rows:
        if site and body is not None:
            for n, ln in enumerate(body.split("\n")):
                if key(ln) and len(held[(site, key(ln))]) >= least:
                    out.append((i, n))
    return sorted(out)


def test_repeated_lines_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["a", "a", "a", "b", "", None]), "\n".join(rnd.choice(["Share this", "share  THIS ", "x y", "x y", "", " ", "line %d" % rnd.randint(0, 40)]) for _ in range(rnd.randint(0, 7))), None, 0, "clash") for i in range(60)]
    rows += [(100, "a", None, None, None, None), (101, "a", "", None, None, None), rows[0], rows[0]]
    df = articles(spark, rows)
    got = sorted((r.doc_id, r.line_no) for r in sitelines.repeated_lines(df, "id", "site", "body", min_docs=8, min_clusters=1).collect())
    assert got == brute_lines(rows, 8) and got


def test_copies_collapse(spark):
    rows = [(i, "a", "Long story\nFooter", None, 0, "") for i in range(10)] + [(50, "a", "Other\nFooter", None, 0, "")]
    counts = sitelines.repeated_lines(articles(spark, rows), "id", "site", "body", min_docs=8, min_clusters=1)
    assert {(r.line, r.n_docs, r.n_clusters) for r in counts.collect()} == {("Long story", 10, 1), ("Footer", 11, 2)}
    only = sitelines.repeated_lines(articles(spark, rows), "id", "site", "body", min_docs=8, min_clusters=2)
    assert {r.line for r in only.collect()} == {"Footer"}
    # at the defaults a republished article keeps its lines, also if its copies differ in white space and case
    rows += [(60 + i, "b", "A story  told\n\nagain" if i % 2 else "a story TOLD\nAgain ", None, 0, "") for i in range(20)]
    clean = {r.doc_id: (r.n_removed, r.body) for r in sitelines.without_repeated_lines(articles(spark, rows), "id", "site", "body").collect()}
    assert clean[61] == (0, "A story  told\n\nagain")
    assert clean[3] == (1, "Long story") and clean[50] == (1, "Other")
    assert sitelines.repeated_lines(articles(spark, rows).limit(0), "id", "site", "body").collect() == []


TEXTS = [
    ("title", "404 Not Found", True),
    ("title", "Page not found | Site One", True),
    ("title", "Page not found, says Ann of the diaries of Bob", False),
    ("title", "Access denied: how Ann lost the keys", False),
    ("title", "{{ page.title }}", True),
    ("title", "TITLE_CITY_NAME", True),
    ("title", "null | Site One", True),
    ("title", "Undefined at 355: the odd sums of Ann", False),
    ("title", "Untitled document 33", True),
    ("title", "[Video] Ann walks from here to there", False),
    ("title", "Seite nicht gefunden", True),
    ("title", "", False),
    ("title", None, False),
    ("body", "Please enable JavaScript and reload a.example/b/12ab34 to continue.", True),
    ("body", "Readers were asked to enable JavaScript, which Ann calls a poor habit.\n\nShe said so twice in the town hall on Monday, and then again in the evening.\n\nNobody answered.\n\nEnd.", False),
    ("body", "The clinics ${entry} overtaking the tables.", True),
    ("body", "A shell script by Ann expands `${city}` before it sends letters.", False),
    ("body", "Text\n\nLorem ipsum dolor sit amet, consectetur adipiscing elit sed do eiusmod.\n\nText", True),
    ("body", "Ann fills her drafts with lorem ipsum, 465 pages at a time.", False),
    ("body", "A [link](https://x.y/{z}) and a [CLAIMS THE](https://x.y) too.", False),
    ("body", "Notes from [your source here] Press.", True),
    ("body", "@@CITY_NAME@@ and __AUTHOR__ and {0} author", True),
    ("body", "x" * 200_000, False),
    ("body", "[" * 50_000, False),
]


def test_residue_cases(spark):
    rows = [(i, t if f == "title" else None, t if f == "body" else None, "Site One", "x") for i, (f, t, _) in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "id long, title string, body string, site string, template string")
    got = {(r.doc_id, r.field) for r in residue.residue(df, "id", "title", "body", "site").collect()}
    assert got == {(i, f) for i, (f, _, bad) in enumerate(TEXTS) if bad}
    assert residue.residue(df.limit(0), "id", "title", "body", "site").collect() == []


def test_templates(spark):
    keys = [f"Something went wrong while loading <RES> quote {w}" for w in ("aa", "bb", "cc")] + ["Quite another message of eight words here <NUM>"]
    got = {r.key: r.template for r in residue.mine_templates(spark.createDataFrame([(k,) for k in keys] * 2, "key string")).collect()}
    assert {got[k] for k in keys[:3]} == {"Something went wrong while loading <RES> quote <*>"} and got[keys[3]] == keys[3]


@pytest.mark.parametrize("text,want", [("/a/b1 on x.example/c", "<RES> on <RES>"), ("Ticket 7b87c9d3 12", "Ticket <HEX> <NUM>"), ("Hello Site One", "Hello <SITE>")])
def test_masks(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(residue.masked(F.col("t"), F.lit("Site One"))).collect()[0][0] == want


def test_residue_of_any_length(spark):
    notice = "Access denied. " + " ".join(f"You don't have permission to access /a/{i} on this server." for i in range(12)) + "\n\nPlease wait.\n\nOne moment please.\n\nReference 77"
    prose = "The council met on the long day in the old town hall and said so at length. " * 40 + "One of them had read that an error occurred on page 7 of the report. " + "Nobody asked about it. " * 40
    slot = "Dear {{ " + "customer.first_name | default('x') | " * 5 + "upper }}, welcome."
    rows = [
        (1, "S", notice, "A title", 0, ""), (2, "S", prose, "Lorem ipsum", 0, ""), (3, "S", slot, "Lorem Ipsum Dolor Sit Amet Consectetur Adipiscing Elit", 0, ""),
        (4, "S", "A text.\nSed magna dolor sit amet elit enim sint", "The Lorem ipsum of Ann", 0, ""), (5, "S", "[[" * 50_000 + "the " * 50_000, "x" * 200_000 + ".a" * 50_000, 0, ""),
    ]
    got = {(r.doc_id, r.field) for r in residue.residue(articles(spark, rows), "id", "title", "body", "site").collect()}
    assert got == {(1, "body"), (2, "title"), (3, "title"), (3, "body"), (4, "body")}
