import os
import random

import numpy as np
import pytest

from fernglass.llm import encode, lexicon, mixing

needs_files = pytest.mark.skipif(not os.path.exists(encode.tokenizer_file()), reason="no tokenizer files here")


def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=encode.read_ranks(encode.tokenizer_file()), special_tokens={})


def odd_texts():
    rnd = random.Random(2)
    out = ["", " ", "\n", "  a  b\n\n c \n d", " lead", "trail ", "x" * 3000, "don't <|endoftext|>   x　 y", "a\x1c b", "''''''", "aaaa " * 300, "é́  🙂🙂 ok\t\tz ", "日本語の文。", "\u0000nul"]
    return out + ["".join(rnd.choice(" \n\t ab'sé🙂1. \x1c\x85") for _ in range(rnd.randint(0, 30))) for _ in range(400)]


@needs_files
def test_ids_equal_the_public_tokenizer(spark):
    ref, texts = reference(), odd_texts()
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(9999, None, 0), (0, texts[0], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    for size in (0, 5, 1000):
        got = {}
        for r in encode.ids(df, "doc_id", "text", lexicon_size=size).collect():
            got[r.doc_id] = r.ids
        assert [t for i, t in enumerate(texts) if got[i] != (ref.encode_ordinary(t) if t else [])] == []
        assert got[9999] == []
    counts = {r.doc_id: r.n_tokens for r in encode.token_counts(df, "doc_id", "text").collect()}
    assert all(counts[i] == len(got[i]) for i in counts)
    assert encode.ids(df.limit(0), "doc_id", "text").collect() == []


@needs_files
def test_merge_is_exact():
    ranks, ref = encode.read_ranks(encode.tokenizer_file()), reference()
    rnd = random.Random(4)
    for _ in range(300):
        w = "".join(rnd.choice("abcdeé'st") for _ in range(rnd.randint(1, 60)))
        assert lexicon.merge(w.encode(), ranks) == ref.encode_single_piece(w) if hasattr(ref, "encode_single_piece") else ref._encode_single_piece(w)


def test_transducer(tmp_path):
    rnd = random.Random(3)
    words = {bytes(rnd.choice(b"abc\xff") for _ in range(rnd.randint(1, 7))) for _ in range(500)}
    path = f"{tmp_path}/x.bin"
    assert lexicon.compile_lexicon(words, lambda w: list(w), path) == len(words)
    lx = lexicon.Lexicon(path)
    ws = sorted(words)
    assert lx.find(ws).tolist() == list(range(len(ws))) and all(lx.get(i) == tuple(w) for i, w in enumerate(ws))
    others = [w + b"z" for w in ws] + [b"", b"zz"]
    assert (lx.find(others) == -1).all()
    assert len(lx.final) < sum(map(len, ws))  # suffixes are shared
    lexicon.compile_lexicon([], lambda w: [], path)
    assert lexicon.Lexicon(path).find([b"a"]).tolist() == [-1]


def test_split_is_exact():
    quotas = {"a": 1000, "b": 1, "c": 57, "d": 0}
    parts = mixing.split_quotas(quotas, 7, 5)
    assert {k: sum(p[k] for p in parts) for k in quotas} == quotas
    sizes = [sum(p.values()) for p in parts]
    assert max(sizes) - min(sizes) <= 2 and parts == mixing.split_quotas(quotas, 7, 5) != mixing.split_quotas(quotas, 7, 6)


def test_mix(spark):
    rnd = random.Random(6)
    rows = [(i, "big", rnd.randint(50, 150)) for i in range(3000)] + [(10_000 + i, "small", 100) for i in range(20)] + [(20_000, "other", 5), (20_001, None, 5), (20_002, "big", 0), (20_003, "big", None)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("none", 0.1, 2), ("small", None, None), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(sized, targets, shards=4, block_tokens=500)
    got = mixed.collect()
    used: dict = {}
    for r in got:
        used.setdefault((r.source, r.doc_id), []).append(r.copy_no)
    assert max(len(v) for v in used.values()) == 3 and all(len(v) == len(set(v)) for v in used.values())
    assert all(len(v) == 3 for (s, _), v in used.items() if s == "small")
    report = {r.source: r for r in mixing.shares(mixed, sized, targets.where("source is not null and target_share is not null")).collect()}
    assert report["none"].actual_share == 0 and abs(report["big"].actual_share - 2 / 3) < 0.01 and report["small"].most_repeats == 3
    by_shard: dict = {}
    for r in got:
        by_shard[r.shard] = by_shard.get(r.shard, 0) + r.n_tokens
    assert sorted(by_shard) == [0, 1, 2, 3] and max(by_shard.values()) < 1.4 * min(by_shard.values())
    assert mixing.mix(sized.limit(0), targets).collect() == []
    assert mixing.mix(sized, targets.limit(0)).collect() == []
    capped = mixing.mix(sized, targets, total_tokens=30_000, shards=2)
    assert sum(r.n_tokens for r in capped.collect() if r.source == "small") == 6000


def test_large_urns():
    rng = np.random.default_rng(3)
    for good, bad, drawn in ((6_000_000_000, 2_000_000_000, 4_000_000_000), (1_000_000_000, 10, 500_000_000), (5, 3_000_000_000, 1_000_000_000), (0, 2_000_000_000, 7), (2_000_000_000, 0, 7)):
        got = [mixing.hypergeometric(rng, good, bad, drawn) for _ in range(4)]
        assert all(max(0, drawn - bad) <= g <= min(good, drawn) for g in got)
        mean = drawn * good / (good + bad)
        assert all(abs(g - mean) <= 8 * (mean * bad / (good + bad)) ** 0.5 + 1 for g in got)
    # the large urn's law is that of the small one
    a = np.array([mixing.hypergeometric(rng, 400, 600, 300) for _ in range(4000)])
    b = np.array([mixing.hypergeometric(rng, 400, 600, 300, limit=1) for _ in range(4000)])
    assert abs(a.mean() - b.mean()) < 0.5 and abs(a.std() - b.std()) < 0.4
    quotas = {"a": 6_000_000_000, "b": 1_500_000_000, "c": 3}
    parts = mixing.split_quotas(quotas, 5, 1)
    assert {n: sum(p[n] for p in parts) for n in quotas} == quotas


@needs_files
def test_nul_at_a_chunk(spark):
    texts = ["a \x00b", "x \x00", "\x00a b", "\x00", " \x00 \x00 "]
    want = [reference().encode_ordinary(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.ids for r in encode.ids(df, "doc_id", "text").orderBy("doc_id").collect()] == want
