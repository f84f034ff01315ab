"""Operators on whole texts against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from skriva.llm import bpe, decontaminate, kernels, repetition, resample, simhash, toxicity

SCHEMA = "doc_id long, text string, n_words string, items int, t string"


def frame(spark, texts, schema=SCHEMA):
    """Documents with columns whose names clash with those that operators add."""
    return spark.createDataFrame([(i, t, None, None, "x") for i, t in texts], schema)


def random_text(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))


EDGE = [(1, None), (2, ""), (3, " \n\t"), (None, "some text"), (4, "a b c"), (4, "a b c"), (5, "Ünï cödé 漢字 😀 " * 40)]


# -- repetition


def brute_repetition(x):
    w = re.findall(r"[^\x20\x09-\x0D]+", x or "")
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines, dup = set(), 0
    for line in (x or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), dup, len(hit)]


def test_repetition_counts_match_brute_force(spark):
    rng = random.Random(3)
    texts = EDGE + [(i + 10, random_text(rng, ["a", "bé", " ", " ", "\n", "a b ", "the cat sat on\n", "#", "<x>", "\x0b"], 200)) for i in range(150)]
    got = repetition.repetition(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    assert sorted([list(r[1:6]) for r in got]) == sorted(brute_repetition(t) for _, t in texts)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_repetition_shares(monkeypatch):
    words = [f"w{i}" for i in range(400)]
    clean, twice = " ".join(words), " ".join(words + words[:300])
    c = repetition.coverage(*kernels.utf8(pa.array([clean, twice])))
    assert c["dup_10gram_chars"].tolist() == [0, sum(len(w) for w in words[:300])]
    assert repetition.verdict(c)[1].tolist() == [True, False]
    monkeypatch.setattr(kernels, "BLOCK", 64)  # many blocks: same counts
    assert {k: v.tolist() for k, v in repetition.coverage(*kernels.utf8(pa.array([clean, twice]))).items()} == {k: v.tolist() for k, v in c.items()}


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert repetition.repetition(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert bpe.encode(empty, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).count() == 0


# -- decontamination


def brute_contamination(text, items, window=13):
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w, hit, of = word.findall(low(text)), set(), set()
    for i, t in items:
        v = word.findall(low(t))
        for a in range(max(1, len(v) - window + 1) if v else 0):
            p = v[a : a + window]
            for b in range(len(w) - len(p) + 1):
                if w[b : b + len(p)] == p:
                    hit |= set(range(b, b + len(p)))
                    of.add(str(i))
    return len(w), len(hit), sorted(of)


@pytest.mark.parametrize("block_chars", [1 << 20, 40])
def test_decontamination_matches_brute_force(spark, block_chars):
    rng = random.Random(5)
    vocabulary = ["Alpha", "beta", "é", "1", "x"]
    join = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", " - "]) for _ in range(n))
    items = [(i, join(rng.randint(1, 18))) for i in range(12)] + [(50, None), (51, "..."), (None, "x"), (0, "beta beta")]
    texts = EDGE + [(i + 10, join(rng.randint(0, 60)) + (rng.choice(items[:12])[1] if i % 2 else "")) for i in range(60)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(frame(spark, texts), benchmark, block_chars=block_chars).collect()
    want = [(i, *brute_contamination(t, [x for x in items if x[0] is not None])) for i, t in texts]
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got))) == sorted(map(repr, want))
    by = {i: t for i, t in texts}
    for r in got:
        if r.doc_id and r.doc_id > 9:
            inside = " ".join(by[r.doc_id][s.start : s.end] for s in r.spans)
            assert len(decontaminate.normal_words(inside.encode())) == r.n_hit


def test_clean_keeps_columns(spark):
    docs = frame(spark, [(1, "one two three"), (2, "nothing here"), (3, None)])
    out = decontaminate.clean(docs, spark.createDataFrame([(9, "two three")], "item_id long, text string"))
    assert out.schema == docs.schema
    assert sorted(r.doc_id for r in out.collect()) == [2, 3]


# -- BPE

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coders():
    with open(RANKS, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return bpe.Bpe(ranks), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = ["a", "b", " ", "  ", "\n", "'s", "'re", "'ll", "'", "é", "ß", "12", ".", "!!", "　", "\xa0", "漢", "😀", "he", "the", "tion", "²", "\0", "'v", "\x1c", "ing"]


def test_bpe_matches_the_library(coders):
    own, library = coders
    rng = random.Random(1)
    texts = [random_text(rng, PARTS, 40) for _ in range(1500)]
    want = [library.encode_ordinary(t) for t in texts]
    assert [own.encode(t) for t in texts] == want
    assert list(own.encode_many(texts)) == want
    for t, w in zip(texts, want, strict=True):
        assert [x for p in own.tree(t, 3)[1] for x in p] == w  # deep trees
        assert own.decode(w) == t.encode()


def test_bpe_long_matches(coders):
    own, library = coders
    for t in ["a" * 5000, "ab" * 3000, " " * 3000 + "x", "the" * 2000, "aab" * 1777 + "b", "é" * 3001, "x" * 40_000 + " y"]:
        assert own.encode(t) == library.encode_ordinary(t)


def test_bpe_query_columns(spark, coders):
    own, library = coders
    got = bpe.encode(frame(spark, EDGE), RANKS, keep=("n_words",)).collect()
    want = sorted((str(i), *(lambda ids: (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))(library.encode_ordinary(t or ""))) for i, t in EDGE)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    back = bpe.decode(spark.createDataFrame([(r.doc_id, r.ids) for r in got], "doc_id long, ids array<int>"), RANKS).collect()
    assert sorted(bytes(r.data) for r in back) == sorted((t or "").encode() for _, t in EDGE)


# -- SimHash


def brute_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if s and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}
    find = lambda i: i if root[i] == i else find(root[i])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(120)] for _ in range(12)]
    texts = [(1, None), (2, ""), (3, "One"), (4, "one two"), (5, "é X")]
    for i in range(120):
        w = list(base[i % 12])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 99)}"
        texts.append((i + 10, " ".join(w).upper() if i % 5 == 0 else "  ".join(w)))
    prints = {i: brute_fingerprint(t) for i, t in texts}
    want = brute_components(prints)
    got = simhash.near_duplicates(frame(spark, texts)).collect()
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == want
    kept = simhash.one_of_each(frame(spark, texts + [(200, None), (13, texts[8][1])]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_links_find_every_pair_of_chains():
    rng = np.random.default_rng(2)
    x = [int(v) for v in rng.integers(0, 1 << 63, 5)]
    for v in list(x):
        for _ in range(60):
            v ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False))
            x.append(v)
    fp = np.unique(np.array(x, np.uint64)).view(np.int64)
    want = brute_components({int(v): int(v) & (1 << 64) - 1 for v in fp})
    edges = simhash.bucket_links(fp)
    root = {int(v): int(v) for v in fp}
    for a, b in edges:
        root[a] = b
    assert root == want
    assert len(edges) == len(fp) - len(set(want.values()))


def united(fp, edges):
    root = {int(v): int(v) for v in fp}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {v: find(v) for v in root}


def test_large_buckets_are_split_without_loss(monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 40)
    rng = np.random.default_rng(9)
    x = list(rng.integers(0, 1 << 38, 300, dtype=np.uint64))  # 26 bits in common
    for c in list(x)[:60]:
        v = int(c)
        for _ in range(rng.integers(1, 8)):
            v ^= sum(1 << int(b) for b in rng.choice(38, rng.integers(1, 4), replace=False))
            x.append(np.uint64(v))
    fp = np.unique(np.array(x, np.uint64)).view(np.int64)
    want = brute_components({int(v): int(v) & (1 << 64) - 1 for v in fp})
    assert united(fp, simhash.bucket_links(fp)) == want


def test_buckets_that_run_over_batches(spark):
    rng = np.random.default_rng(10)
    base = rng.integers(0, 1 << 63, 30, dtype=np.int64)
    rows = sorted({int(b) ^ (1 << int(k)) for b in base for k in rng.integers(0, 62, 12)})
    frame_ = spark.createDataFrame([(v,) for v in rows], "fp long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        edges = [(r.a, r.b) for r in simhash.links(frame_).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert united(rows, edges) == brute_components({v: v & (1 << 64) - 1 for v in rows})


def test_long_texts_are_fingerprinted_in_pieces(monkeypatch):
    rng = random.Random(12)
    texts = [" ".join(random_text(rng, "abcä ", 9) for _ in range(200)).encode() for _ in range(20)] + [b"x" * 500, b"x" * 300 + b" y", b" " * 300, b"a b" + b" " * 200 + b"c"]
    whole = [simhash.fingerprint(t) for t in texts]
    monkeypatch.setattr(kernels, "BLOCK", 40)
    assert [simhash.fingerprint(t) for t in texts] == whole


# -- toxicity


def test_nearest_is_exact():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts, y = [], []
    for i in range(600):
        bad = i % 3 == 0
        texts.append(" ".join(rng.choices(words, k=12) + (rng.choices(["vile", "nasty", "rude"], k=2) if bad else [])).encode())
        y.append(int(bad))
    index = toxicity.build(texts, y, list(range(600)))
    inside = [i for i in range(600) if i % 4]
    vectors = {i: dict(zip(*map(list, index.vector(*toxicity.bag(texts[i]))), strict=True)) for i in inside}
    by_id = dict(zip(index.ids, range(len(index.ids)), strict=True))
    for q in range(0, 600, 3):
        t, w = index.vector(*toxicity.bag(texts[q] + b" neverseen"))
        cos = sorted(((round(sum(a * vectors[i].get(x, 0.0) for x, a in zip(t, w, strict=True)), 9), -by_id[i]) for i in inside), reverse=True)[:10]
        e, s = index.nearest(t, w, 10)
        assert [round(float(c), 9) for c in s] == [c for c, _ in cos if c > 0]
    right = sum((index.probability(index.vote(toxicity.bag(x))[0]) >= 0.5) == bool(v) for x, v in zip(texts, y, strict=True))
    assert right > 570
    assert 0 <= index.probability(index.vote(toxicity.bag(b""))[0]) <= 1


def test_weights_are_those_of_the_formula():
    texts = [b"a a b", b"b c", b"c c c d", b"d a"]
    index = toxicity.build(texts, [1, 0, 0, 1], [0, 1, 2, 3])
    words, toxic = [t.split() for t in texts], [1, 0, 0, 1]
    for text in texts:
        w = {}
        for x in set(text.split()):
            df, bad = sum(x in t for t in words), sum(y for t, y in zip(words, toxic, strict=True) if x in t)
            w[x] = (1 + math.log(text.split().count(x))) * (math.log(5 / (1 + df)) + 1) * math.log2(2 + bad / max(1, df - bad))
        n = math.sqrt(sum(v * v for v in w.values()))
        assert np.allclose(sorted(index.vector(*toxicity.bag(text))[1]), sorted(v / n for v in w.values()))


def test_toxicity_on_tables(spark):
    rng = random.Random(8)
    said = lambda bad: " ".join(rng.choices([f"w{i}" for i in range(80)], k=20) + (["vile", "nasty"] if bad else []))
    rows = [(i, said(i % 3 == 0), "clash", 0.5) for i in range(400)] + [(900, None, "x", 0.0), (901, "", "x", 0.0), (902, "zzz", None, None), (None, said(True), "x", 0.0), (903, said(False) * 4000 + " vile nasty", "x", 0.0)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "clash") for i in range(0, 400, 2)] + [(0, 0, "again"), (900, 1, ""), (None, 1, ""), (1, None, "")], "doc_id long, toxic int, text string")
    index = toxicity.fit(docs, labels)
    out = toxicity.score(docs, index, evidence=2)
    got = [(r.doc_id, r.score, r.evidence) for r in out.collect()]
    assert len(got) == len(rows) + 3
    scores = {i: s for i, s, _ in got}
    assert sum((scores[i] >= 0.5) == (i % 3 == 0) for i in range(400)) >= 396
    assert scores[900] == scores[901] == scores[902] == index.rest
    assert all(len(e) == 2 and e[0].cosine >= e[1].cosine and e[0].label in (0, 1) for i, _, e in got if i is not None and i < 400)
    assert sorted(got[-3:], key=str) == sorted(got[:3], key=str)  # repeated rows alike
    assert toxicity.score(docs.limit(0), index).count() == 0
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.0}


# -- resampling


def test_kth_key_and_draw(spark):
    keys = spark.createDataFrame([(float(x),) for x in [5, 1, 3, 3, 3, -7, 1e9]], "key double")
    assert [resample.kth_key(keys, k) for k in (1, 2, 3, 4, 5, 6)] == [1e9, 5, 3, 3, 3, 1]
    assert resample.kth_key(keys, 7) == float("-inf")
    rng = random.Random(6)
    good = lambda: " ".join(rng.choices(["the", "cat", "sat", "on", "a", "mat"], k=60))
    junk = lambda: " ".join(rng.choices(["BUY", "!!!", "$$$", "NOW", "###"], k=60))
    texts = [(i, good() if i % 4 else junk()) for i in range(400)] + [(None, good()), (900, None), (901, "")]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), None) for i in range(0, 400, 3)], "doc_id long, quality int, key int")
    docs = frame(spark, texts)
    model = resample.fit(docs, labels)
    out = resample.draw(docs, model)
    assert out.schema == docs.schema
    assert abs(model.share - 100 / 134 - resample.SLACK) < 1e-9
    kept = {r.doc_id for r in out.collect()}
    assert sum(i in kept for i in range(400) if i % 4) >= 297
    assert sum(i in kept for i in range(0, 400, 4)) <= 6
    assert resample.draw(docs, resample.fit(docs, labels.limit(0))).count() == len(texts)
    assert resample.draw(docs, model, k=10).count() == 10
    twice = docs.unionByName(docs)
    assert resample.draw(twice, model, k=10).count() == 10  # five texts, each twice: one key for equal rows
    assert resample.draw(docs.limit(0), model).count() == 0
    clash = docs.withColumn("key", F.lit("x")).withColumn("log_weight", F.lit(1))
    assert resample.draw(clash, model).schema == clash.schema


def test_draws_follow_the_weights():
    w, k = np.log(np.array([5.0, 1.0, 2.0, 0.5, 1.5])), 2
    p = np.exp(w) / np.exp(w).sum()
    want = [p[i] + sum(p[j] * p[i] / (1 - p[j]) for j in range(5) if j != i) for i in range(5)]  # one after the other, without replacement
    seen = np.zeros(5)
    for seed in range(20_000):
        seen[np.argsort(-(w + resample.gumbel(list(range(5)), seed)))[:k]] += 1
    assert np.allclose(seen / 20_000, want, atol=0.015)


def test_weights_are_likelihood_ratios(spark):
    docs = frame(spark, [(1, "a b"), (2, "a c !"), (3, "b"), (4, None)])
    model = resample.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    texts = {1: "a b", 2: "a c !", 3: "b"}
    bag = lambda t: list(resample.grams(*kernels.utf8(pa.array([t])), 0, 1)[0])
    raw = np.ones(resample.BUCKETS) + np.bincount(sum(map(bag, texts.values()), []), minlength=resample.BUCKETS)
    target = np.bincount(bag("a b"), minlength=resample.BUCKETS)
    for r in resample.scored(docs, model).collect():
        want = sum(math.log((target[b] + resample.PRIOR * raw[b] / raw.sum()) / (target.sum() + resample.PRIOR) / (raw[b] / raw.sum())) for b in bag(texts.get(r.doc_id, "")))
        assert abs(r.log_weight - want) < 1e-9


def test_long_texts_are_weighed_whole(monkeypatch):
    text = " ".join(f"w{i % 97}," for i in range(5000))
    ratio = np.random.default_rng(0).normal(size=resample.BUCKETS)
    monkeypatch.setattr(kernels, "BLOCK", 300)
    whole = resample.Model(ratio).weights(*kernels.utf8(pa.array([text, "a"])))
    tokens = re.findall(r"\w+|[^\w\s]+", text)
    h = {t: kernels.hash_spans(np.frombuffer(t.encode(), np.uint8), np.array([0]), np.array([len(t)]))[0] for t in set(tokens)}
    one = np.array([h[t] for t in tokens], np.uint64)
    two = kernels.mix(one[:-1] * np.uint64(3) + one[1:])
    b = (np.concatenate((one, two)) >> np.uint64(49)).astype(int)
    assert abs(whole[0] - ratio[b].sum()) < 1e-6
