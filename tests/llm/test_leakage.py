import re

import numpy as np
import pytest

from relweave.llm import leakage


def words(t):
    return re.findall(r"[^\W_]+", t.lower()) if t else []


def brute(items, docs, n=12):
    runs = {i: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for i, w in ((i, words(t)) for i, t in items)}
    out = set()
    for d, t in docs:
        w = words(t)
        seen = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        out |= {(i, d) for i, r in runs.items() if r & seen}
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"word{k}" for k in range(300)] + ["ünï", "99"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(k, text(int(rng.integers(5, 60)))) for k in range(30)] + [(40, None), (41, ""), (42, "stock phrase " * 10)]
    docs = []
    for k in range(120):
        w = text(80).split()
        if k % 3 == 0:
            src = items[int(rng.integers(30))][1].split()
            take = int(rng.integers(8, 20))
            w[20:20] = src[:take]
        docs.append((1000 + k, ", ".join(w) if k % 2 else "\n".join(w).upper()))
    docs += [(2000, None), (2001, ""), (2002, "stock phrase " * 9), docs[0], (None, items[0][1]), (2003, "filler " * 200_000 + items[3][1])]
    return items, docs, spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, hash string"), spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, mask string")


def test_runs_equal_brute_force(spark, tables):
    items, docs, i, d = tables
    want = {p for p in brute(items, docs) if p[1] is not None}
    assert {tuple(r) for r in leakage.leaked_runs(i, d).collect()} == want and len(want) > 10


def test_substitutions_do_not_end_an_overlap(spark):
    source = [f"w{k}" for k in range(60)]
    changed = [("x" if k in (13, 27, 41) else w) for k, w in enumerate(source)]
    i = spark.createDataFrame([(1, " ".join(source))], "item_id bigint, text string")
    d = spark.createDataFrame([(2, "a b c " + " ".join(changed) + " d e")], "doc_id bigint, text string")
    r = leakage.leaks(i, d).first()
    assert (r.exact_run, r.overlap_words, r.substituted) == (18, 60, 3)


def test_bit_array_only_drops_what_cannot_match(spark, tables, monkeypatch):
    items, docs, i, d = tables
    want = {tuple(r) for r in leakage.leaked_runs(i, d).collect()}
    monkeypatch.setattr(leakage, "MIN_BITS", 1 << 6)
    monkeypatch.setattr(leakage, "MAX_BITS", 1 << 6)
    monkeypatch.setattr(leakage, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(leakage, "BROADCAST_WORDS", 0)
    monkeypatch.setattr(leakage, "HOT", 1)
    assert {tuple(r) for r in leakage.leaked_runs(i, d).collect()} == want


def test_empty(spark, tables):
    _, _, i, d = tables
    assert leakage.leaks(i.limit(0), d).count() == 0 and leakage.leaks(i, d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        leakage.leaked_runs(i, d, 8)


def test_masks_have_one_span():
    assert {len(m) for m in leakage.MASKS} == {leakage.SPAN} and all(m[0] == m[-1] == "1" for m in leakage.MASKS)


def test_overlap_is_followed_to_its_end(spark):
    """Every fifth word replaced, far beyond the last hit of a mask."""
    source = [f"w{k}" for k in range(400)]
    changed = [("x" if k >= 100 and k % 3 else w) for k, w in enumerate(source)]
    i = spark.createDataFrame([(1, " ".join(source))], "item_id bigint, text string")
    d = spark.createDataFrame([(2, " ".join(changed))], "doc_id bigint, text string")
    r = leakage.leaks(i, d).first()
    assert (r.exact_run, r.overlap_words, r.substituted) == (100, 400, 200)


def test_short_items(spark):
    i = spark.createDataFrame([(1, "Alpha beta, gamma"), (2, "one two three four five six seven"), (3, "lonely"), (4, "alpha gamma")], "item_id bigint, text string")
    d = spark.createDataFrame([(10, "so alpha beta gamma ends"), (11, "one two CHANGED four five six seven"), (12, "one two x y five six"), (13, "a lonely word"), (14, "")], "doc_id bigint, text string")
    got = {(r.item_id, r.doc_id): (r.exact_run, r.overlap_words, r.substituted) for r in leakage.leaks(i, d).collect()}
    assert got == {(1, 10): (3, 3, 0), (2, 11): (4, 7, 1), (3, 13): (1, 1, 0)}


def test_repeated_words_are_linear(spark):
    i = spark.createDataFrame([(1, "same " * 60), (2, "a b " * 40 + "c")], "item_id bigint, text string")
    d = spark.createDataFrame([(10, "same " * 200_000), (11, "a b " * 3000)], "doc_id bigint, text string")
    got = {(r.item_id, r.doc_id): (r.exact_run, r.overlap_words) for r in leakage.leaks(i, d).collect()}
    assert got == {(1, 10): (60, 60), (2, 11): (80, 80)}
