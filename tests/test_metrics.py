"""Ranking metrics on hand-computed cases and invariants."""

import math

import pytest

from relweave.operators import indexing, metrics


def cells(spark, rows):
    return spark.createDataFrame(rows, "row_idx bigint, col_idx bigint, score double")


def values(df):
    return {(r.row_idx, r.metric, r.k): r.value for r in df.collect()}


def test_one_relevant_at_rank_three(spark):
    run, truth = cells(spark, [(0, 1, 0.9), (0, 2, 0.8), (0, 3, 0.7)]), cells(spark, [(0, 3, 1.0), (5, 1, 1.0)])
    v = values(metrics.per_query(run, truth, (1, 10)))
    assert v[0, "NDCG", 10] == pytest.approx(0.5) and v[0, "MRR", 10] == pytest.approx(1 / 3) and v[0, "MAP", 10] == pytest.approx(1 / 3)
    assert v[0, "P", 10] == pytest.approx(0.1) and v[0, "R", 10] == 1.0 and v[0, "Hits", 1] == 0.0
    assert all(v[5, m, 10] == 0 for m in ("NDCG", "MRR", "MAP", "P", "R", "Hits"))


def test_ideal_run_and_shuffled_truth(spark):
    truth = cells(spark, [(q, c, 1.0 + (c % 3)) for q in range(12) for c in range(q, q + 4)])
    assert all(x == pytest.approx(1) for (_, m, _), x in values(metrics.per_query(truth, truth, (4,))).items() if m in ("NDCG", "MAP", "P"))
    assert all(r.value == pytest.approx(1) for r in metrics.graded_ndcg(truth, truth, 4).collect())
    mixed = indexing.permuted_rows(truth, 3)
    mean = lambda t: metrics.mean_metrics(metrics.per_query(truth, t, (4,))).filter("metric = 'NDCG'").first().value
    assert mean(mixed) < mean(truth)


def test_graded_equals_binary_on_binary_truth(spark):
    run, truth = cells(spark, [(0, c, 1.0 / (c + 1)) for c in range(8)]), cells(spark, [(0, 2, 1.0), (0, 5, 1.0), (0, 9, 1.0)])
    a = values(metrics.per_query(run, truth, (10,)))[0, "NDCG", 10]
    assert metrics.graded_ndcg(run, truth, 10).first().value == pytest.approx(a)


def test_graded_without_ideal_has_no_value(spark):
    assert metrics.graded_ndcg(cells(spark, [(0, 1, 1.0)]), cells(spark, [(0, 1, 0.9)]), 10, whole_relevance=True).count() == 0


def test_by_label_equals_spelt_out_truth(spark):
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 1), (4, 2), (5, 3), (6, None)], "idx bigint, label int")
    run = cells(spark, [(a, b, float((a * 7 + b * 3) % 5)) for a in range(7) for b in range(7) if a != b])
    rows = [(r.idx, r.label) for r in labels.collect() if r.label is not None]
    truth = cells(spark, [(a, b, 1.0) for a, x in rows for b, y in rows if a != b and x == y])
    assert values(metrics.per_query_by_label(run, labels, (3,))) == values(metrics.per_query(run, truth, (3,)))


def test_t_test(spark):
    a = spark.createDataFrame([(i, x) for i, x in enumerate((0.5, 0.7, 0.2, 0.9))], "row_idx bigint, value double")
    b = spark.createDataFrame([(i, x) for i, x in enumerate((0.4, 0.5, 0.1, 0.9))], "row_idx bigint, value double")
    r = metrics.paired_t(metrics.compare(a, b)).first()
    assert r.n == 4 and r.t == pytest.approx(0.1 / (math.sqrt(2 / 300) / 2)) and r.p == pytest.approx(0.0917, abs=2e-4)
    assert metrics.two_sided_p(2.228, 10) == pytest.approx(0.05, abs=1e-4) and metrics.two_sided_p(0.0, 5) == 1.0
    assert metrics.paired_t(metrics.compare(a.limit(1), b.limit(1))).first().t is None


def test_empty(spark):
    none = cells(spark, [])
    assert metrics.per_query(none, none).count() == 0
    assert metrics.mean_metrics(metrics.per_query(none, none)).count() == 0
