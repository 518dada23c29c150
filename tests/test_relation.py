"""Relation algebra on hand-checked cells, with nulls, ties, repeated rows, empty tables and clashing columns."""

import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from relweave.operators import indexing, lookup
from relweave.operators import relation as rel


def cells(spark, rows):
    return spark.createDataFrame(rows, "row_idx bigint, col_idx bigint, score double")


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_relation_drops_what_is_no_cell_and_merges(spark):
    raw = spark.createDataFrame(
        [(1, 2, 0.5, "x", 1), (1, 2, 0.7, "y", 2), (None, 2, 1.0, "z", 3), (1, None, 1.0, "z", 3), (1, 3, None, "z", 3), (1, 4, math.nan, "z", 3)],
        "row_idx bigint, col_idx bigint, score double, rank string, n int",
    )
    assert got(rel.relation(raw)) == [(1, 2, 0.7)]
    assert got(rel.relation(raw, merge="sum")) == [(1, 2, 1.2)]


def test_top_k_ties_and_short_rows(spark):
    r = cells(spark, [(0, 1, 0.5), (0, 2, 0.5), (0, 3, 0.9), (1, 4, 0.1)])
    assert got(rel.top_k(r, 2)) == [(0, 1, 0.5), (0, 3, 0.9), (1, 4, 0.1)]
    assert set(got(rel.top_k(r, 1))) <= set(got(rel.top_k(r, 2)))


def test_minmax_loses_its_minimum_as_zero(spark):
    r = cells(spark, [(0, 1, 0.2), (0, 2, 0.6), (0, 3, 1.0), (1, 1, 0.7)])
    assert [(a, b, round(c, 9)) for a, b, c in got(rel.row_minmax(r, drop_zero=False))] == [(0, 1, 0.0), (0, 2, 0.5), (0, 3, 1.0), (1, 1, 1.0)]
    assert len(got(rel.row_minmax(r))) == 3


def test_product_and_transpose(spark):
    a, b = cells(spark, [(0, 0, 2.0), (0, 1, 1.0)]), cells(spark, [(0, 5, 3.0), (1, 5, 4.0)])
    assert got(rel.multiply(a, b)) == [(0, 5, 10.0)]
    assert got(rel.transpose(rel.transpose(a))) == got(a)
    assert got(rel.mean_product(a, b)) == [(0, 5, 5.0)]


def test_symmetrise(spark):
    r = cells(spark, [(0, 1, 2.0), (1, 0, 7.0), (0, 2, 3.0)])
    assert got(rel.symmetrise_missing(r)) == [(0, 1, 2.0), (0, 2, 3.0), (1, 0, 7.0), (2, 0, 3.0)]
    assert got(rel.symmetrise_sum(r)) == [(0, 1, 9.0), (0, 2, 3.0), (1, 0, 9.0), (2, 0, 3.0)]


def test_prune_counts_both_sides_before_pruning(spark):
    r = cells(spark, [(0, 0, 1.0), (0, 1, 1.0), (0, 2, 1.0), (1, 0, 1.0), (2, 0, 1.0), (2, 3, 1.0)])
    assert got(rel.prune_heads(r, 2, 2)) == [(2, 3, 1.0)]


def test_union_with_offsets(spark):
    r = spark.createDataFrame([("a", 0, 1, 1.0), ("b", 0, 0, 2.0), ("b", 1, 2, 3.0)], "part string, row_idx bigint, col_idx bigint, score double")
    sizes = spark.createDataFrame([("a", 4, 2), ("b", 2, 3)], "part string, n_rows bigint, n_cols bigint")
    assert got(rel.union_with_offsets(r, sizes, "part")) == [(0, 1, 1.0), (4, 2, 2.0), (5, 4, 3.0)]


def test_block_matrix(spark):
    r = cells(spark, [(0, 1, 1.0)])
    assert got(rel.block([[None, r], [rel.transpose(r), None]], [1, 2], [1, 2])) == [(0, 2, 1.0), (2, 0, 1.0)]


def test_empty_relations(spark):
    none = cells(spark, [])
    for out in (rel.top_k(none, 3), rel.multiply(none, none), rel.row_minmax(none), rel.row_normalise(none), rel.symmetrise_missing(none), rel.prune_heads(none, 1, 1), rel.add(none, none)):
        assert got(out) == []


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4), st.integers(1, 9)), max_size=12))
def test_product_equals_numpy(spark, rows):
    m = np.zeros((5, 5))
    for a, b, s in rows:
        m[a, b] += s
    r = rel.relation(cells(spark, [(a, b, float(s)) for a, b, s in rows]), merge="sum")
    want = sorted((i, j, (m @ m)[i, j]) for i in range(5) for j in range(5) if (m @ m)[i, j])
    assert got(rel.multiply(r, r)) == want


def test_dense_index_orders_all_partitions(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS v").repartition(5)
    assert all(r.v == r.idx for r in indexing.dense_index(df, ["v"]).collect())
    assert indexing.dense_index(df.filter("v < 0"), ["v"]).count() == 0


def test_samples_are_stable_and_complete(spark):
    df = spark.range(100).withColumnRenamed("id", "idx")
    a = {r.idx for r in indexing.sample_rows(df, "idx", 10, 1).collect()}
    assert len(a) == 10 and a == {r.idx for r in indexing.sample_rows(df.repartition(7), "idx", 10, 1).collect()}
    assert indexing.sample_rows(df, "idx", 1000, 1).count() == 100
    assert {r.part for r in indexing.split_rows(df, "idx", 20, 3).collect()} == {"test", "train"}
    r = cells(spark, [(k, k, 1.0) for k in range(20)])
    moved = got(indexing.permuted_rows(r, 2))
    assert sorted(a for a, _, _ in moved) == list(range(20)) and moved != got(r)


def test_encode_last_wins_and_misses(spark):
    info = spark.createDataFrame([(0, "a", "t"), (1, "b", "t"), (2, "a", "t"), (3, None, "t")], "idx bigint, identifier string, text string")
    df = spark.createDataFrame([("a",), ("c",), (None,)], "name string")
    assert got(lookup.encode(df, info, "name", missing="drop").select("name", "idx")) == [("a", 2)]
    assert got(lookup.missing_keys(df, info, "name").filter("name IS NOT NULL")) == [("c",)]
    with pytest.raises(Exception, match="no entry for"):
        lookup.encode(df, info, "name").collect()


def test_replace_by_text(spark):
    q = spark.createDataFrame([(0, "x"), (1, "y"), (2, None)], "idx bigint, text string")
    m = spark.createDataFrame([(0, "x", "first"), (1, "x", "last"), (2, None, "none")], "idx bigint, text string, new string")
    out = {r.idx: (r.found, r.replaced) for r in lookup.replace_by_text(q, m, "new").collect()}
    assert out == {0: (True, "last"), 1: (False, "y"), 2: (False, None)}


def test_audit(spark):
    a = spark.createDataFrame([(0, "a", "t"), (1, "b", "t"), (2, "c", None)], "idx bigint, identifier string, text string")
    b = spark.createDataFrame([(0, "a", "u"), (5, "b", "t"), (2, "d", None)], "idx bigint, identifier string, text string")
    assert tuple(lookup.audit_tables(a, b).first()) == (1, 1, 2, 1, 1)


@pytest.mark.parametrize("limits", [(500_000, 2_000_000, 2_000_000), (40, 60, 50), (3, 4, 7)])
def test_product_top_k_equals_product(spark, monkeypatch, limits):
    """In blocks of any size, with a heavy inner index, a heavy row and a heavy column, ties and scores of 0 and below."""
    for name, value in zip(("LEFT_CELLS", "RIGHT_CELLS", "SUMS"), limits):
        monkeypatch.setattr(rel, name, value)
    rng = np.random.default_rng(1)
    pick = lambda n, m, k: {(int(i), int(j)) for i, j in zip(rng.integers(0, n, k), rng.integers(0, m, k))}
    a = [(i, j, float(rng.integers(-1, 3))) for i, j in pick(30, 12, 120) | {(i, 0) for i in range(30)} | {(7, j) for j in range(12)}]
    b = [(i, j, float(rng.integers(-1, 3))) for i, j in pick(12, 25, 90) | {(0, j) for j in range(25)} | {(i, 4) for i in range(12)}]
    want = got(rel.top_k(rel.multiply(cells(spark, a), cells(spark, b)), 4))
    assert got(rel.multiply_top_k(cells(spark, a), cells(spark, b), 4)) == want
    assert got(rel.multiply_top_k(cells(spark, a).limit(0), cells(spark, b), 4)) == got(rel.multiply_top_k(cells(spark, a), cells(spark, b).limit(0), 4)) == []


def test_product_top_k_rounds_few_sums(monkeypatch):
    """Of a row's sums only those that may be among the best are looked at one by one."""
    rng = np.random.default_rng(2)
    cells_b = [(i, j, rng.random()) for i in range(6) for j in range(5000) if i < 2 or rng.random() < 0.1]
    left = pa.table({"row_idx": [r for r in range(40) for _ in range(3)], "inner": [i for _ in range(40) for i in rng.choice(6, 3, False).tolist()], "x": rng.random(120)})
    right = pa.table({n: v for n, v in zip(("inner", "col_idx", "y"), zip(*cells_b))})
    dense = np.zeros((6, 5000))
    for i, j, v in cells_b:
        dense[i, j] = v
    x = np.zeros((40, 6))
    for r, i, v in zip(*(left.column(c).to_pylist() for c in ("row_idx", "inner", "x"))):
        x[r, i] = v
    full, rounded, plain = np.round(x @ dense, 9), [], np.round
    monkeypatch.setattr(rel.np, "round", lambda a, digits: rounded.append(np.size(a)) or plain(a, digits))
    out = rel._best_of_block(10, 9)(None, left, right).to_pydict()
    want = [(r, c, full[r, c]) for r in range(40) for c in np.lexsort((np.arange(5000), -full[r]))[:10]]
    assert [(r, c) for r, c, _ in want] == list(zip(out["row_idx"], out["col_idx"])) and np.allclose([s for *_, s in want], out["score"], atol=1e-9)
    assert sum(rounded) < 0.1 * full.size


def test_running_sum_and_oversampling(spark):
    df = spark.createDataFrame([(k, k % 7) for k in range(500)], "k bigint, v int").repartition(9)
    rows = indexing.running_sum(df, ["k"], "v", "before").orderBy("k").collect()
    assert [r.before for r in rows] == [sum(j % 7 for j in range(k)) for k in range(500)]
    r = spark.createDataFrame([(0, c) for c in range(3)] + [(1, 5)], "g bigint, c bigint")
    out = indexing.sample_per_group(r, "g", "c", 7, 1, oversample=True).collect()
    assert sorted(x.g for x in out) == [0] * 7 + [1] * 7
    counts = sorted(sum(x.c == c for x in out if x.g == 0) for c in range(3))
    assert counts == [2, 2, 3]
    assert indexing.sample_per_group(r, "g", "c", 2, 1, oversample=True).filter("g = 0").distinct().count() == 2


def test_audits_of_order_and_triples(spark):
    info = lambda rows: spark.createDataFrame(rows, "idx bigint, identifier string")
    a = info([(0, "x"), (1, "y"), (2, None)])
    assert tuple(lookup.audit_order(a, a).first()) == (True, True)
    assert tuple(lookup.audit_order(a, info([(0, "y"), (1, "x"), (2, None)])).first()) == (False, True)
    assert tuple(lookup.audit_order(a, info([(0, "x")])).first()) == (False, False)
    t = lambda rows: spark.createDataFrame(rows, "qid string, did string, score double")
    one = lookup.audit_triples(t([("q", "d", 1.0), ("q", "d", 1.0), ("q", "e", 2.0)]), t([("q", "d", 1.0), ("q", "e", 3.0)])).first()
    assert one.asDict() == {"n_made": 2, "n_wanted": 2, "only_made": 1, "only_wanted": 1, "identical": False, "pairs_identical": True}
    assert lookup.audit_triples(t([]), t([])).first().identical
