import itertools
import random

from fernglass.llm import neardup, truncation


def words_of(rnd, n):
    return [f"w{rnd.randint(0, 4000)}" for _ in range(n)]


def test_pairs_against_brute_force(spark):
    rnd = random.Random(11)
    texts = []
    for _ in range(60):
        base = words_of(rnd, rnd.randint(40, 120))
        texts.append(base)
        for _ in range(rnd.randint(0, 4)):
            edited = list(base)
            for _ in range(rnd.randint(0, 6)):
                edited[rnd.randrange(len(edited))] = "edit%d" % rnd.randint(0, 99)
            texts.append(edited)
    rows = [(i, " ".join(t), "<p>" + " ".join(t).upper() + "</p>", i) for i, t in enumerate(texts)]
    rows += [(1000, None, "", 0), (1001, "too short", None, 0), (1002, rows[0][1], None, 0), (1003, rows[0][1] + " &amp; ", None, 0)]
    df = spark.createDataFrame(rows, "id long, a string, b string, cls long")

    def sets(v):
        w = neardup.words(v or "")
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 30 else None

    want = set()
    for k, f in ((1, "a"), (2, "b")):
        have = [(r[0], s) for r in rows if (s := sets(r[k])) is not None]
        for (i, x), (j, y) in itertools.combinations(have, 2):
            if len(x & y) / len(x | y) >= 0.5:
                want.add((f, i, j))
    got = {(r.field, r.id_a, r.id_b) for r in neardup.similar_pairs([(df, "id", ["a", "b"])], similarity=0.5).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and ("a", 0, 1002) in got and ("a", 1002, 1003) in got


def test_a_hot_group_of_near_copies(spark):
    """A third of all rows are near-copies of one text: more than any tree's reach."""
    rnd = random.Random(12)
    base = words_of(rnd, 100)
    rows = []
    for i in range(60):
        t = list(base)
        t[rnd.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, " ".join(words_of(rnd, 60))) for i in range(120)]
    got = {(r.id_a, r.id_b) for r in neardup.similar_pairs([(spark.createDataFrame(rows, "id long, a string"), "id", ["a"])], similarity=0.5).collect()}
    assert len(got) == 60 * 59 // 2


def test_thousands_of_near_copies(spark):
    """Many times more near-copies than any tree's reach, over several blocks, among unrelated texts."""
    rnd = random.Random(13)
    base = words_of(rnd, 100)
    rows = []
    for i in range(2200):
        t = list(base)
        t[rnd.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(t)))
    rows += [(10_000 + i, " ".join(words_of(rnd, 60))) for i in range(2000)]
    got = neardup.similar_pairs([(spark.createDataFrame(rows, "id long, a string"), "id", ["a"])], similarity=0.5).where("id_b < 10000")
    assert got.distinct().count() == got.count() == 2200 * 2199 // 2


def test_alike_pairs_under_a_crowded_prefix(spark):
    """Texts that share a long notice stand under the same prefixes and are not alike; a few pairs among them are."""
    rnd = random.Random(14)
    notice = words_of(rnd, 60)
    texts = [notice + words_of(rnd, 40) for _ in range(1500)]
    for i in range(0, 200, 2):
        own = texts[i][60:]
        own[20] = "edited"
        texts[i + 1] = notice + own
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, a string")
    got = [(r.id_a, r.id_b) for r in neardup.similar_pairs([(df, "id", ["a"])], similarity=0.8).collect()]
    assert sorted(got) == [(i, i + 1) for i in range(0, 200, 2)]


def test_no_pairs(spark):
    df = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(40))), (2, None)], "id long, a string")
    assert neardup.similar_pairs([(df, "id", ["a"])], 0.5).collect() == []
    assert neardup.similar_pairs([(df.limit(0), "id", ["a"])], 0.5).collect() == []
    g = neardup.groups([(df, "id", ["a"])]).collect()
    assert [(r.id, r.n_links) for r in g] == [(1, 0)]


ENDINGS = [
    ("A whole sentence. And one more.", "closed", False),
    ("A sentence that was cut somewh…", "open", True),
    ("A sentence that was cut [...]", "open", True),
    ("<p>A sentence that was cut&hellip;</p>", "open", True),
    ("Done. So much for Ann...", "rhetoric", True),
    ("Done. Mehr aus Bonn folgt…", "rhetoric", True),
    ("Text here. #one #two", "credit", False),
    ("Text here. https://a.b/c1", "credit", False),
    ("Text here. (Ann Bell)", "credit", False),
    ("Text here. — Ann Bell, Rome", "credit", False),
    ("<p>Text here. More</p><a hre", "broken", False),
    ("Text &hel", "broken", False),
    ("Text &amp; more text", "open", False),
    ("Sold for 5 & 6.", "closed", False),
]


def test_endings():
    got = [(v, *truncation.reading(v)[1:]) for v, _, _ in ENDINGS]
    assert got == ENDINGS


def test_truncated(spark):
    full = "The council met on Monday in the old town hall. Nobody expected the long debate about bridges. It ended late at night."
    rows = [(i, 1, f"Story number {i}", None, f"In the year of storm number {i} the council met on Monday in the old hall of {i} men. Nobody expected the long debate about bridges.") for i in range(30)]
    cut = [
        (100, 1, "T", full, None),
        (101, 1, "T", full[:60], None),  # inside a sentence, a longer copy exists
        (102, 2, "T", full[:47], None),  # at a sentence's end
        (103, 2, "T", "<b>" + full[:72] + "</b> …", "Nobody expected the long debate ab"),
        (104, 2, "A heading about bridges", "A heading about bridges", None),
        (105, 3, "T", "", None),
        (106, 3, None, None, "   "),
        (107, 3, "T", "word " * 50_000 + "end.", None),
        (101, 1, "T", full[:60], None),
    ]
    df = spark.createDataFrame(rows + cut, "parsed_id long, feed_id long, title string, summary string, content string")
    found = truncation.truncated(df, "parsed_id", "feed_id", "title", ["summary", "content"])
    assert sorted((r.record_id, r.field) for r in found.collect()) == [(101, "summary"), (101, "summary"), (103, "content"), (103, "summary")]
    shares = {(r.source, r.field): (r.n_values, r.n_truncated) for r in truncation.rates(df, found, "feed_id", ["summary", "content"]).collect()}
    assert shares[(1, "summary")] == (3, 2) and shares[(2, "content")] == (1, 1) and shares[(3, "summary")] == (1, 0)
    assert truncation.truncated(df.limit(0), "parsed_id", "feed_id", "title", ["summary", "content"]).collect() == []


def test_prefixes_against_brute_force(spark):
    rnd = random.Random(8)
    base = ["".join(rnd.choice("ab ") for _ in range(60)).strip() for _ in range(40)]
    texts = sorted({t[: rnd.randint(30, 60)] for t in base for _ in range(6)} | set(base))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {r.h for r in truncation.continuations(df).collect()}
    import xxhash

    want = {xxhash.xxh3_64_intdigest(t) - 2**63 for t in texts if any(u != t and u.startswith(t) for u in texts)}
    assert found == want


def test_short_prefixes_and_ampersands(spark):
    rows = [(i, 1, f"T{i}", f"The firm does R&D in town {i} and more of it. It sold < and > signs.", None) for i in range(8)]
    rows += [(50, 1, "T", "The bridge fell on M", None), (51, 1, "T", "The bridge fell on Monday. It was late.", None), (52, 1, "T", "A long story. Nobody does R&D", None), (53, 1, "T", "A long story about &am", None), (54, 1, "T", "It grew by 3.", None), (55, 1, "T", "It grew by 3.5 in all.", None)]
    df = spark.createDataFrame(rows, "parsed_id long, feed_id long, title string, summary string, content string")
    got = {r.record_id: r.reason for r in truncation.truncated(df, "parsed_id", "feed_id", "title", ["summary", "content"]).collect()}
    assert got[50] == got[54] == "prefix" and got[53] == "markup" and 52 not in got and 51 not in got and 55 not in got
