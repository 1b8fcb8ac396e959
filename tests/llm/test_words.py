import re

import numpy as np
import pytest

from fernglass.llm import language, maintext, residue, words
from fernglass.llm.words import Words

ODD = ["a", "the", "straße", "été", "слово", "語", "𝔘𝔫𝔦", "aé語𝔘b", "aaaa", "x" * 5000, "é" * 300, "²", "ﬁn"]


def test_all_grams_are_the_grams_of_each_word():
    flat, many = language.all_grams(ODD)
    assert [g.tolist() for g in np.split(flat, np.cumsum(many)[:-1])] == [language.grams(w) for w in ODD]
    flat, many = language.all_grams([])
    assert len(flat) == len(many) == 0


def test_numbers_are_those_of_the_words():
    split = re.compile(r"[^\W\d_]+").findall
    w = Words(split)
    texts = ["one two,one", "", " \t ", "12 34", "don't stop\x1cnow two", *ODD, "one " * 1000]
    for _ in range(2):
        lens, ids = w.numbers(texts)
        assert lens.tolist() == [len(split(t)) for t in texts]
        assert [w.words[i] for i in ids] == [x for t in texts for x in split(t)]
    assert [x.tolist() for x in w.numbers([])] == [[], []] and not w.full()


def test_a_run_is_split_once():
    seen = []
    w = Words(lambda t: seen.append(t) or [t])
    for _ in range(3):
        w.numbers(["a b a", "b c"])
    assert sorted(seen) == ["a", "b", "c"]


def test_forgetting_changes_no_result(monkeypatch):
    m = language.fit([("en", "the house and the garden of the town"), ("de", "das haus und der garten der stadt")])
    c, lines = language.Classifier(m), ["the garden and the house", "der garten und das haus", "the town of", ""]
    once = c.classify(lines)
    docs = [(maintext.body_blocks("\n".join(lines)), "")]
    feats = maintext.flat_features(docs, False)
    monkeypatch.setattr("fernglass.llm.words.MOST", 1)
    assert c.words.full() and c.classify(lines) == once and c.classify(lines[:1]) + c.classify(lines[1:]) == once
    for together in (1, 30, 1000):
        monkeypatch.setattr("fernglass.llm.words.TOGETHER", together)
        assert c.classify(lines) == once
        for a, b in zip(feats, maintext.flat_features(docs, False), strict=True):
            assert np.array_equal(a, b)


def test_pieces():
    texts = ["", "ab", "c" * 9, "", "d"]
    for together in range(14):
        got = list(_pieces(texts, together))
        assert [t for p in got for t in p] == texts and all(len(p) == 1 or sum(map(len, p)) <= together for p in got)
    assert list(words.pieces([])) == []


def _pieces(texts, together):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(words, "TOGETHER", together)
        yield from words.pieces(texts)


def test_word_features_against_each_line():
    lines = ["The end, the END of 1984 and 2001.", "One", "...", "a  b [link](http://x.y/z) Own Site c", "# Über été " + "word " * 500, "_ _", "1 2 3"]
    got = maintext.features(maintext.body_blocks("\n".join(lines)), "Own Site", False)
    for line, feats in zip(lines, got, strict=True):
        low = maintext._LINK.sub(r"\1", " ".join(line.split())).lower().replace("own site", " ownsite ")
        ws = ["0" if x.isdigit() else x for x in maintext._WORD.findall(low)]
        own = {maintext._code("w " + x) for x in ws}
        ends = [maintext._code("first " + " ".join(ws[:2])), maintext._code("last " + ws[-1])] if ws else []
        n = len(own) + len(ends)
        assert sorted(feats[len(feats) - n :]) == sorted([*own, *ends])


@pytest.fixture(scope="module")
def notices():
    return ["403 FORBİDDEN: /private/x.html", "403 forbidden: /private/x.html", "Page not found: /a/b.html", "Síte: PÁGINA NO ENCONTRADA /a/b.html", "Erışim: FORBıDDEN /x/y.html"]


def test_residue_is_found_by_what_its_patterns_see(spark, notices):
    # a capital I with a dot is an i to the pattern, but two characters in lower case: the guard missed it
    rows = [(i, None, t) for i, t in enumerate(notices)]
    rows += [(100, "Hello {name}", "It was a day. " * 3), (101, None, None), (102, "  ", "Lorem ipsum dolor sit amet consectetur"), (103, "Lorem ipsum", "")]
    rows += [(200 + i, "A day", f"The council {i} met in the town and told of it at length.") for i in range(5)]
    df = spark.createDataFrame(rows, "id long, title string, body string")
    got = {(r.doc_id, r.field, r.slot, r.filler, r.notice) for r in residue.residue(df, "id", "title", "body").collect()}
    assert {d for d, *_ in got if d < 100} == {0, 1, 2, 3, 4}
    assert {x for x in got if x[0] >= 100} == {(100, "title", True, False, False), (102, "body", False, True, False), (103, "title", False, True, False)}


def test_every_cue_passes_the_sieve():
    import pyarrow as pa
    import pyarrow.compute as pc

    plain = [c for cues in residue.CUES.values() for c in re.split(r"\|(?![^(]*\))", cues) if re.fullmatch(r"[\w ,'-]+", c)]
    texts = [f"{a}{f(c)}{b}" for c in plain for a, b in (("", ""), ("x «", "»"), ("م", "."), ("\n", "\n")) for f in (str, str.upper, str.title)]
    assert len(plain) > 60 and pc.all(pc.match_substring_regex(pa.array(texts), residue._CUED)).as_py()
    assert not pc.any(pc.match_substring_regex(pa.array(["terrors of forbiddenness", "Lore, ips", ""]), residue._CUED)).as_py()
