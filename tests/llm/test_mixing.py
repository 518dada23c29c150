import numpy as np
import pytest

from relweave.llm import mixing

DOCS = "doc_id bigint, source string, text string, u double"


def tables(spark, n=3000):
    rng = np.random.default_rng(2)
    names = ["big", "mid", "SMALL ", "tiny", "unwanted", None]
    rows = []
    for k in range(n):
        s = names[int(rng.choice(6, p=[0.5, 0.25, 0.1, 0.05, 0.05, 0.05]))]
        rows.append((k, s, None if k % 97 == 0 else "" if k % 89 == 0 else "some words of text " * int(rng.integers(1, 9)), 0.5))
    targets = [("big", 0.3, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("tiny", 0.15, 4), ("absent", 0.05, 2)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    docs, targets = tables(spark)
    mix, report = mixing.mix(docs, targets)
    rows = {r.source: r for r in report.collect()}
    assert rows["absent"].n_rows == 0 and set(rows) == {"big", "mid", "small", "tiny", "absent"}
    for s in ("big", "mid", "small", "tiny"):
        assert rows[s].reached_share == pytest.approx(rows[s].target_share / 0.95, abs=0.004)
        assert rows[s].most_repeats <= rows[s].max_repeats
    used = mix.groupBy("source", "doc_id").count().collect()
    assert {r.source for r in used} == {"big", "mid", "small", "tiny"}
    assert sum(r["count"] for r in used) == sum(r.n_rows for r in rows.values())
    assert all(r["count"] <= rows[r.source].max_repeats for r in used)
    assert mix.filter("text IS NULL OR text = ''").count() == 0
    # the source that limits the total is used nearly to its cap, and by a draw as well
    most = max((rows[s] for s in rows if rows[s].n_rows), key=lambda r: r.n_tokens / (r.max_repeats * r.source_tokens))
    assert most.n_tokens / (most.max_repeats * most.source_tokens) == pytest.approx(mixing.FILL, abs=0.02)
    assert len({r["count"] for r in used if r.source == most.source}) > 1 or most.max_repeats == 1


def test_wanted_total(spark):
    """Sources too small for their share of the total stand at their cap and fall short; the others meet their goal."""
    docs, targets = tables(spark)
    base = {r.source: r for r in mixing.mix(docs, targets)[1].collect()}
    total = int(sum(r.goal_tokens for r in base.values()) / mixing.FILL * 1.2)
    rows = {r.source: r for r in mixing.mix(docs, targets, total_tokens=total)[1].collect()}
    capped = [r for r in rows.values() if r.source_tokens and r.n_tokens == r.max_repeats * r.source_tokens]
    assert capped and all(r.goal_tokens > r.n_tokens and r.unused_share == 0 for r in capped)
    for r in rows.values():
        if r.source_tokens and r not in capped:
            assert r.n_tokens == pytest.approx(r.goal_tokens, rel=0.02)
    small = {r.source: r for r in mixing.mix(docs, targets, total_tokens=2000)[1].collect()}
    assert sum(r.n_tokens for r in small.values()) == pytest.approx(2000, rel=0.1) and small["big"].unused_share > 0.5


def test_many_sources_and_repeats(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('s', id % 400) AS source", "'some words of text' AS text")
    targets = spark.range(400).selectExpr("concat('s', id) AS source", "1 / 400D AS target_share", "50 AS max_repeats")
    report = mixing.mix(docs, targets, total_tokens=100_000)[1]
    assert report.agg({"n_tokens": "sum"}).first()[0] == pytest.approx(100_000, rel=0.15)


def test_same_seed_same_mix(spark):
    docs, targets = tables(spark, 400)
    a = {(r.doc_id, r.copy_no) for r in mixing.mix(docs, targets, seed=1)[0].collect()}
    assert a == {(r.doc_id, r.copy_no) for r in mixing.mix(docs.repartition(7), targets, seed=1)[0].collect()}
    assert a != {(r.doc_id, r.copy_no) for r in mixing.mix(docs, targets, seed=2)[0].collect()}


def test_empty(spark):
    docs, targets = tables(spark, 50)
    mix, report = mixing.mix(docs.limit(0), targets)
    assert mix.count() == 0 and all(r.n_rows == 0 and r.reached_share == 0 for r in report.collect())
    mix, report = mixing.mix(docs, targets.limit(0))
    assert mix.count() == 0 and report.count() == 0


def test_tokens_of_pieces(spark):
    docs = spark.createDataFrame([(1, "s", "word " * 100_000), (2, "s", "x" * 200_000), (3, "s", None)], "doc_id bigint, source string, text string")
    n = {r.doc_id: r.n_tokens for r in mixing.token_counts(docs).collect()}
    assert n[3] == 0 and n[2] > 0 and abs(n[1] - 100_001) < 5


def test_poisson_counts():
    """Thresholds are the distribution's cumulated probabilities, and the mean is found for the goal."""
    assert mixing.thresholds(1.0, 2) == pytest.approx([np.exp(-1), 2 * np.exp(-1)])
    h = np.full(mixing.BINS, 10.0)
    for goal, cap in ((5_000.0, 1), (60_000.0, 4), (100_000.0, 3)):
        mean = mixing.mean_for(h, goal, cap)
        assert mixing._yield(h, mean, cap) == pytest.approx(goal, rel=1e-6)
    assert mixing.mean_for(h, 2 * h.sum(), 2) is None
