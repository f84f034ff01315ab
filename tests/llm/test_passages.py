"""Passages that stand in several places, are changed, or meet under keys that others head."""

import random

import numpy as np
import pytest

from skriva.llm import passages


def words(rng, n):
    return [f"w{rng.randint(0, 10**6)}" for _ in range(n)]


def shingles(text):
    return passages._shingles(" ".join(text).encode())


@pytest.mark.parametrize(("size", "earlier"), [(60, 20), (80, 40), (50, 25), (50, 49)])
def test_an_opening_that_stands_earlier_hides_no_copy(size, earlier):
    rng = random.Random(size)
    p = words(rng, size)
    one, two = words(rng, 30) + p + words(rng, 30), words(rng, 10) + p[:earlier] + words(rng, 30) + p + words(rng, 5)
    assert passages.similar_runs(shingles(one), shingles(two)) == [(30, 30 + size, 40 + earlier, 40 + earlier + size, 1.0)]
    (found,) = passages.similar_runs(shingles(two), shingles(one))
    assert found[:2] == (40 + earlier, 40 + earlier + size)


def test_every_window_of_a_passage_that_recurs_is_covered():
    rng = random.Random(3)
    for _ in range(60):
        parts = [words(rng, rng.randint(10, 70)) for _ in range(4)]
        one, two = ([w for _ in range(6) for w in rng.choice(parts)] for _ in range(2))
        held = {tuple(two[k : k + 50]) for k in range(len(two) - 49)}
        runs = passages.similar_runs(shingles(one), shingles(two))
        for k in range(len(one) - 49):
            if tuple(one[k : k + 50]) in held:
                assert any(s <= k and k + 50 <= e for s, e, *_ in runs)


def changed(rng, p, at):
    q = list(p)
    for k, how in at:
        q[k] = {"other": [rng.choice("xyz")], "more": [q[k][0], rng.choice("xyz")], "less": []}[how]
    return [w for x in q for w in (x if isinstance(x, list) else [x])]


def near_pairs(rng, n):
    """(text, text) with a passage of 50 words or more that has one or several words changed, anywhere."""
    for _ in range(n):
        size = rng.choice([50, 51, 53, 60, 70, 100, 150])
        p = words(rng, size)
        one = changed(rng, p, [(size // 2 if rng.random() < 0.3 else k, rng.choice(["other", "more", "less"])) for k in rng.sample(range(size), rng.randint(1, max(1, size // 45)))])
        yield words(rng, rng.randint(0, 40)) + p + words(rng, rng.randint(0, 40)), words(rng, rng.randint(0, 40)) + one + words(rng, rng.randint(0, 40))


def brute(one, two):
    """Whether some parts of 50 words or more, both ends in common, have a similarity of 0.8."""
    a, b = shingles(one), shingles(two)
    spots = [(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(b == a[i])]
    for i, j in spots:
        for k, m in spots:
            if k - i >= 45 and m >= j:
                s, t = set(a[i : k + 1].tolist()), set(b[j : m + 1].tolist())
                if len(s & t) >= 0.8 * len(s | t):
                    return True
    return False


def test_all_near_copies_are_found(spark):
    rng = random.Random(11)
    pairs = list(near_pairs(rng, 150))
    frame = spark.createDataFrame([(2 * k + n, " ".join(p[n])) for k, p in enumerate(pairs) for n in (0, 1)], "doc_id long, text string")
    got = {(r.partner, r.id) for r in passages.repeated_passages(frame).collect()}
    want = {(2 * k, 2 * k + 1) for k, (one, two) in enumerate(pairs) if brute(two, one)}
    assert len(want) > 50
    assert got == want


def found(spark, docs):
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    return {(r.id, r.partner): r.passages for r in passages.repeated_passages(frame).collect()}


def test_what_the_head_holds_in_part_is_found_whole(spark):
    rng = random.Random(4)
    docs, want = {}, set()
    for k in range(0, 300, 3):  # k and k+1 share 100 words, k+1 and k+2 share 50 of which 47 stand in k
        p, more = words(rng, 100), words(rng, 3)
        docs[k] = words(rng, 20) + p + words(rng, 20)
        docs[k + 1] = words(rng, 20) + p + more + words(rng, 20)
        docs[k + 2] = words(rng, 20) + p[53:] + more + words(rng, 20)
        want |= {(k + 1, k), (k + 2, k + 1)}
    assert set(found(spark, docs)) == want


def test_near_copies_under_a_phrase_of_others_are_found(spark):
    rng = random.Random(6)
    phrase = words(rng, 30)
    docs = {i: words(rng, 40) + phrase + words(rng, 40) for i in range(300)}
    want = set()
    for k in range(100, 300, 4):  # 30 words of the phrase, a changed one, 20 words that two documents share
        tail = words(rng, 20)
        for i in (k, k + 1):
            docs[i] = words(rng, 40) + phrase + words(rng, 1) + tail + words(rng, 20)
        want.add((k + 1, k))
    got = set(found(spark, docs))
    assert got <= want
    assert len(got) >= 0.95 * len(want)


def test_rows_that_repeat_an_id_keep_their_own_words(spark):
    rng = random.Random(9)
    p, mine, other = words(rng, 70), words(rng, 90), words(rng, 120)
    rows = [(1, " ".join(p)), (7, " ".join(mine + p)), (7, " ".join(other)), (8, " ".join(p)), (8, " ".join(p)), (None, " ".join(p)), (9, None), (10, "")]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, own int, w string, start int")
    found = passages.repeated_passages(docs)
    assert sorted((r.id, r.partner, len(r.passages)) for r in found.collect()) == [(7, 1, 1), (8, 1, 1)]
    kept = sorted((str(r.doc_id), r.text or "") for r in passages.cut_passages(docs, found).collect())
    assert kept == sorted([("1", " ".join(p)), ("7", " ".join(mine) + " "), ("7", " ".join(other)), ("None", " ".join(p)), ("9", ""), ("10", "")])
    assert passages.repeated_passages(docs.limit(0)).count() == 0
    with pytest.raises(TypeError):
        passages.repeated_passages(docs.selectExpr("text as doc_id", "text"))


def test_very_long_texts_and_repeated_lines(spark):
    rng = random.Random(10)
    line, long = words(rng, 12), words(rng, 30_000)
    rows = [(1, " ".join(long)), (2, " ".join(words(rng, 50) + long[10_000:10_300])), (3, " ".join(line * 2000)), (4, " ".join(words(rng, 5) + line * 30))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.id, r.partner): [(s.start, s.end) for s in r.passages] for r in passages.repeated_passages(frame).collect()}
    assert got == {(2, 1): [(50, 350)], (4, 3): [(5, 365)]}
