import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernglass.llm import crf, language, maintext, queries, subjects
from fernglass.session import table


def test_crf_learns_and_decodes():
    rnd = np.random.default_rng(1)
    docs, labels = [], []
    for _ in range(120):
        y = np.repeat(rnd.integers(0, 2, 6), 4)
        docs.append([[int(v), 2] if rnd.random() < 0.8 else [2] for v in y])  # a feature tells the label, or is missing
        labels += y.tolist()
    m = crf.train(*maintext._flat(docs), np.array(labels), 8, steps=60)
    got = m.decode(*maintext._flat(docs))
    assert (got == np.array(labels)).mean() > 0.88 and m.trans[0, 0] + m.trans[1, 1] > m.trans[0, 1] + m.trans[1, 0]


def test_viterbi_is_the_best_path():
    import itertools

    rnd = np.random.default_rng(2)
    m = crf.Crf(rnd.normal(size=5), rnd.normal(size=(2, 2)), rnd.normal(size=2), rnd.normal(size=2))
    docs = [[[int(rnd.integers(5))] for _ in range(n)] for n in (1, 4, 6)]
    got = m.decode(*maintext._flat(docs)).tolist()
    for d in docs:
        def score(y, d=d):
            return m.begin[y[0]] + m.end[y[-1]] + sum(m.weights[f[0]] * v for f, v in zip(d, y, strict=True)) + sum(m.trans[a, b] for a, b in zip(y, y[1:], strict=False))

        assert got[: len(d)] == list(max(itertools.product((0, 1), repeat=len(d)), key=score))
        del got[: len(d)]


PAGE = """<html><head><meta property="og:site_name" content="The Site"><title>no text</title></head><body>
<nav><a href="/x">Home</a></nav>
<div><div id="s">
<h1>A heading</h1>
<p>It was a long day in the town. Nobody knew why.</p>
<!-- <p>hidden</p> -->
<script>var x = "<p>no</p>";
</script>
</div></div>
<footer>All &amp; more of The Site</footer>
</body></html>"""


def test_page_blocks():
    blocks, site = maintext.page_blocks(PAGE)
    assert site == "The Site" and [(b.line_no, b.text, b.inside) for b in blocks] == [(1, "Home", False), (3, "A heading", True), (4, "It was a long day in the town. Nobody knew why.", True), (9, "All & more of The Site", False)]
    assert maintext.page_blocks("") == ([], "") and maintext.page_blocks("just text\r\nmore")[0][1].line_no == 1
    assert maintext.decode_page("caf\xe9".encode("latin-1"), None) == "café"


def test_boilerplate(spark):
    rnd = random.Random(3)
    rows = [(i, "\n".join(["Subscribe | Log in | Jobs", "", *["The council %d met on a day. It was a long one." % rnd.randint(0, 99) for _ in range(4)], "", "Share this story of Site", "Terms of use of Site, section %d" % i]), "Site") for i in range(60)]
    rows += [(100, None, "Site"), (101, "", None), (102, "x" * 100_000, None), (103, "One line.", None)]
    df = spark.createDataFrame(rows, "id long, body string, site string")
    m = maintext.fit(df, None, train_docs=40)
    got = {(r.record_id, r.line_no) for r in maintext.boilerplate_lines(df, m, False).collect() if r.record_id < 100}
    assert got == {(i, n) for i in range(60) for n in (0, 7, 8)}
    drop = maintext.boilerplate_lines(df, m, False)
    clean = {r.record_id: (r.n_removed, r.body) for r in maintext.without_lines(df, "id", "body", drop).collect()}
    assert clean[5][0] == 3 and clean[5][1].startswith("\nThe council") and clean[103] == (0, "One line.")
    assert maintext.boilerplate_lines(df.limit(0), m, False).collect() == []


@pytest.fixture(scope="module")
def samples():
    path = "/root/testdata/sf0.001/language_samples.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    import pyarrow.parquet as pq

    return [(r["lang"], r["text"]) for r in pq.read_table(path).to_pylist()]


def test_language_held_out(samples):
    train, held = samples[::2], samples[1::2]
    c = language.Classifier(language.fit(train))
    got = [x for x, _ in c.classify([t for _, t in held])]
    assert sum(g == lang for g, (lang, _) in zip(got, held, strict=True)) >= 0.97 * len(held)
    assert c.classify(["", "12 34", "xx", "Zq"]) == [(None, 0.0)] * 4


def test_segments(spark, samples):
    by = {lang: [t for g, t in samples if g == lang] for lang in ("en", "de", "fr")}
    mixed = "\n\n".join([by["en"][0], by["en"][1], "## " + by["de"][0], by["de"][1], by["fr"][2]])
    rows = [(1, by["en"][3], "en-GB", 0), (2, by["en"][3], "German", 0), (3, by["de"][3], None, 0), (4, mixed, "en", 0), (5, None, "en", 0), (6, "  ", "en", 0), (7, by["fr"][3], "FR_ca", 0), (8, by["fr"][4], "mul", 0)]
    df = spark.createDataFrame(rows, "id long, body string, label string, segment_no int")
    found = language.segments(df, "id", "body", "label", language.fit(samples))
    got = sorted((r.record_id, r.segment_no, r.lang) for r in language.mislabelled(found).collect())
    assert got == [(2, 0, "en"), (3, 0, "de"), (4, 0, "en"), (4, 1, "de"), (4, 2, "fr"), (8, 0, "fr")]
    assert all(0 < r.confidence <= 1 for r in found.collect())
    assert language.segments(df.limit(0), "id", "body", "label", language.fit(samples)).collect() == []


def test_labels(spark):
    cases = [("EN", "en"), ("en_us", "en"), ("es-419", "es"), ("Deutsch", "de"), ("por", "pt"), ("x-default", None), ("mul", None), ("zxx", None), ("", None), (None, None), ("en,fr", None)]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, v string")
    assert [r[1] for r in sorted(df.select("i", language.label_language(F.col("v"))).collect())] == [y for _, y in cases]


def test_subjects(spark):
    rnd = random.Random(9)
    nouns = {"law": "judge court statute appeal".split(), "food": "bread soup cheese baker".split(), "sport": "goal match referee sprint".split()}

    def text(*names):
        return " ".join(f"The {rnd.choice(nouns[rnd.choice(names)] if names else ['street', 'evening'])} was seen by the old people." for _ in range(8))

    docs, labels = [], []
    for i in range(150):
        s = rnd.choice(list(nouns))
        docs.append((i, text(s), None))
        labels.append((i, s if i % 12 else rnd.choice(list(nouns))))  # some are wrong
    docs += [(500, text("law", "food"), None), (501, None, None), (502, "", None), (503, text(), None), (504, text("sport") * 50, None)]
    labels += [(9999, "law"), (0, "nonsense"), (1, labels[1][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    f = subjects.fit(d, spark.createDataFrame(labels, "doc_id long, subject string"), spark.createDataFrame([(s,) for s in nouns], "subject string"))
    got: dict = {}
    for r in subjects.mixtures(d, f).where("share >= 0.25").collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i) == {labels[i][1]} for i in range(150) if i % 12)
    assert right >= 0.95 * 137 and got[500] == {"law", "food"} and got[504] == {"sport"} and not {501, 502, 503} & set(got)
    none = subjects.fit(d, spark.createDataFrame([], "doc_id long, subject string"), spark.createDataFrame([("law",)], "subject string"))
    assert subjects.mixtures(d, none).collect() == []


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_on_the_smallest_tables(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_found", "p8_ids", "p9_mix", "p10_found"])
def test_queries_run_on_empty_tables(spark, data, tmp_path, name):
    for t in ("articles", "documents", "parsed_feeds", "parsed_items", "pending_pages", "subject_labels"):
        table(spark, data, t).limit(0).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    for t in ("language_samples", "mix_targets", "subjects"):
        table(spark, data, t).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_leaf_blocks_of_one_line():
    page = '<body><nav><a href="/">Home</a></nav><div><h1>Title</h1><p>Body text <b>one</b>.</p></div><footer>Foot</footer></body>'
    blocks, _ = maintext.page_blocks(page)
    assert [(b.tag, b.text, b.lines) for b in blocks] == [("nav", "Home", [0]), ("h1", "Title", [0]), ("p", "Body text one.", [0]), ("footer", "Foot", [0])]
    blocks, _ = maintext.page_blocks("<body><div><p>A text that\ngoes over\nthree lines.</p></div><pre>a\nb</pre></body>")
    assert [(" ".join(b.text.split()), b.lines) for b in blocks] == [("A text that goes over three lines.", [0, 1, 2]), ("a", [2]), ("b", [3])]


def test_long_lines_have_their_features():
    short, long = (maintext.body_blocks("Subscribe to the letters of the Site, " + "word and more " * n + "today")[0] for n in (2, 300))
    of_short, of_long = (set(maintext.features([b], "Site", False)[0]) for b in (short, long))
    assert {maintext._code(f) for f in ("w subscribe", "w ownsite", "last today", "end open", "mark letter")} <= of_short & of_long
    assert maintext.weak_label(long, "Site", False) == maintext.weak_label(short, "Site", False) == 1
    assert maintext.features([maintext.body_blocks("[" * 200_000 + "x")[0]], "", False)


def test_training_takes_long_documents(spark):
    rows = [(1, "\n".join("Line %d of a long text. It goes on." % i for i in range(20_000)), "S"), (2, "a b\nLong text here. It ends.", "S"), (3, "z" * 2000, "S")]
    m = maintext.fit(spark.createDataFrame(rows, "id long, body string, site string"), None, train_chars=1_000_000)
    assert np.isfinite(m.weights).all() and np.abs(m.trans).sum() > 0


def test_language_by_true_cosine():
    m = language.fit([("aa", "alpha beta gamma delta"), ("bb", "uno dos tres cuatro"), ("aa", "alpha gamma"), ("bb", "dos cuatro")], k=1)
    c = language.Classifier(m)
    for text in ("alpha beta beta beta gamma", "uno dos tres cuatro cinco"):
        words = text.split()
        v = np.zeros(language.DIM)
        for w in words:
            np.add.at(v, language.grams(w), 1)
        assert abs(c._length(words) - np.linalg.norm(v * m.idf)) < 1e-3
    once, often = c.classify(["alpha beta gamma delta", "alpha beta gamma delta " * 6])
    assert once[0] == often[0] == "aa" and c.classify(["это русский текст тут"]) == [(None, 0.0)]
    assert c.classify(["alpha" * 50_000 + " beta gamma delta"])[0][0] == "aa"


def test_list_items_count_by_content():
    assert [language.counts(s) for s in ("- A sentence of a list.", "- Paris: 30", "* Ann Bell", "# Heading", "", "Plain text")] == [True, False, False, False, False, True]


def test_fold_in_is_the_update_with_h_fixed():
    docs = [({"goal": 3, "match": 2, "the": 4}, {"sport"}), ({"goal": 1, "team": 2, "the": 3}, {"sport"}), ({"court": 3, "judge": 2, "the": 5}, {"law"}), ({"judge": 1, "court": 1, "match": 1, "the": 2}, {"law"})]
    f = subjects.factor(docs, ["law", "sport"])
    assert np.allclose(f.h.sum(0), 1, atol=1e-4)
    folder = subjects.Folder(f)
    w = folder.weights(["goal court", "goal goal match", "nothing known"], folds=1)
    known = [f.terms[t] for t in ("goal", "court")]
    want = sum(f.trust[j] * f.h[j] / f.h[j].sum() for j in known)
    assert np.allclose(w[0], want, atol=1e-4) and (w[2] == 0).all()
    assert [folder.f.subjects[i] if i >= 0 else None for i in folder.about(["goal goal match team", "nothing known"])] == ["sport", None]
