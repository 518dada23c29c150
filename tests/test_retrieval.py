"""Search and set assembly."""

import math

import numpy as np
import pytest

from relweave.operators import retrieval as ret


def vectors(spark, m, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(m)], "idx bigint, vector array<double>")


def test_exact_search_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(ret, "QUERY_BLOCK", 20)
    monkeypatch.setattr(ret, "DOC_BLOCK", 30)
    rng = np.random.default_rng(1)
    m = rng.normal(size=(90, 8))
    m[10] = m[11] = m[12]  # ties
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    want = {(i, int(j)) for i in range(90) for j in sorted(range(90), key=lambda j: (-s[i, j], j))[:5]}
    v = vectors(spark, m)
    assert {(r.row_idx, r.col_idx) for r in ret.exact_search(v, v, 5, 8).collect()} == want


def test_search_leaves_unusable_vectors_out(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [math.nan, 1.0]), (4, [1.0]), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (6, [None, 1.0]), (None, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "idx bigint, vector array<double>")
    out = {(r.row_idx, r.col_idx) for r in ret.exact_search(v, v, 3, 2).collect()}
    assert out == {(0, 0), (0, 5), (5, 0), (5, 5)}
    assert ret.exact_search(v.limit(0), v, 3, 2).count() == 0 and ret.exact_search(v, v.limit(0), 3, 2).count() == 0


def test_lsh_recall(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    m = np.concatenate([base + 0.1 * rng.normal(size=base.shape) for _ in range(5)])
    v = vectors(spark, m)
    exact = {(r.row_idx, r.col_idx) for r in ret.exact_search(v, v, 5, 16).collect()}
    near = {(r.row_idx, r.col_idx) for r in ret.lsh_search(v, v, 5, 16).collect()}
    assert len(exact & near) / len(exact) > 0.9


def test_lsh_fills_up_sparse_regions(spark):
    rng = np.random.default_rng(3)
    v = vectors(spark, rng.normal(size=(300, 64)))  # few cosines above 0.28
    q = v.filter("idx < 40")
    exact = {(r.row_idx, r.col_idx) for r in ret.exact_search(q, v, 10, 64).collect()}
    near = {(r.row_idx, r.col_idx) for r in ret.lsh_search(q, v, 10, 64).collect()}
    assert len(near) == 400 and len(exact & near) / len(exact) > 0.9
    narrow = {(r.row_idx, r.col_idx) for r in ret.lsh_search(q, v, 10, 64, bucket=1e-6).collect()}
    assert narrow == exact  # nothing but the query shares a bucket


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_lsh_recall_of_the_embeddings(spark, size):
    v = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet").selectExpr("vec_id AS idx", "embedding AS vector")
    q = v.filter("idx % 50 = 0")
    exact = {(r.row_idx, r.col_idx) for r in ret.exact_search(q, v, 10, 64).collect()}
    near = {(r.row_idx, r.col_idx) for r in ret.lsh_search(q, v, 10, 64).collect()}
    print("recall", size, len(exact & near) / len(exact), len(near), len(exact))
    assert len(near) == len(exact) and len(exact & near) / len(exact) >= 0.9


def test_negatives_and_lists(spark):
    run = spark.createDataFrame([(0, c, 1.0 - c / 10) for c in range(8)], "row_idx bigint, col_idx bigint, score double")
    pos = spark.createDataFrame([(0, 1, 1.0)], "row_idx bigint, col_idx bigint, score double")
    assert [r.col_idx for r in ret.hard_negatives(run, pos, 2, 4, 3).orderBy("col_idx").collect()] == [3, 4, 5]
    q = spark.createDataFrame([(0, "i", "query")], "idx bigint, identifier string, text string")
    docs = spark.createDataFrame([(c, "i", None if c == 2 else f"d{c}") for c in range(8)], "idx bigint, identifier string, text string")
    one = ret.listwise(run, q, docs, 3).first()
    assert one.query == "query" and [d.doc for d in one.docs] == ["d0", "d1"]


def test_aligned_pairs_check_their_queries(spark):
    schema = "idx bigint, query string, docs array<string>, labels array<int>"
    a, b = spark.createDataFrame([(0, "q [SEP] a", ["x"], [1])], schema), spark.createDataFrame([(0, "q [SEP] b", ["y"], [0])], schema)
    r = ret.aligned_pairs(a, b).first()
    assert r.docs == ["x", "y"] and r.labels == [1, 0]
    with pytest.raises(Exception, match="queries differ"):
        ret.aligned_pairs(a, spark.createDataFrame([(0, "other", ["y"], [0])], schema)).collect()


def test_supervised_and_judgements(spark):
    pairs = spark.createDataFrame([("q", "d", ["n", "d"]), ("q", "d", None), (None, "d", [])], "query string, document string, negatives array<string>")
    queries, docs, pos, neg = ret.supervised_relations(pairs)
    assert [r.token for r in docs.orderBy("idx").collect()] == ["d", "n"] and queries.count() == 1
    assert pos.count() == 1 and neg.count() == 2
    info = lambda names: spark.createDataFrame(list(enumerate(names)), "idx bigint, identifier string")
    qrels = spark.createDataFrame([("a", "x", 1), ("b", "x", 1), ("a", "z", 1)], "qid string, did string, rel int")
    cells, missing = ret.judgements(qrels, info(["a"]), info(["x"]))
    assert [tuple(r) for r in cells.collect()] == [(0, 0, 1.0)] and tuple(missing.first()) == (1, 1)


def test_examples(spark):
    import json

    r = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.75), (0, 2, 0.1), (1, 0, 1.0)], "row_idx bigint, col_idx bigint, score double")
    table = lambda names: spark.createDataFrame([(k, "i", n) for k, n in enumerate(names)], "idx bigint, identifier string, text string")
    out = ret.examples(r, table(["q", "p"]), table(["a", "b", "c"]), r.filter("row_idx = 0"), 2).collect()
    assert [json.loads(x.example) for x in out] == [{"query": "q", "labels": [{"label": "b", "score": "0.7500"}, {"label": "a", "score": "0.5000"}]}]


def test_example_sets(spark):
    import json

    from relweave.operators import metrics

    run = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.8), (1, 2, 0.9), (1, 1, 0.5), (3, 1, 1.0)], "row_idx bigint, col_idx bigint, score double")
    truth = spark.createDataFrame([(0, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0)], "row_idx bigint, col_idx bigint, score double")
    point = metrics.pointwise_precision(run, truth, 1)
    assert sorted(map(tuple, point.collect())) == [(0, 1, 1.0), (1, 2, 0.0)]
    scores = point.groupBy("row_idx").sum("value").withColumnRenamed("sum(value)", "value")
    assert [r.row_idx for r in ret.choose_rows(scores, "good", 1).collect()] == [0] and [r.row_idx for r in ret.choose_rows(scores, "bad", 1).collect()] == [1]
    assert ret.choose_rows(scores, "random", 5).count() == 2
    info = spark.createDataFrame([(k, f"i{k}", f"text {k}") for k in range(4)], "idx bigint, identifier string, text string")
    out = ret.example_sets(scores, info, {"labels": (truth, info, 3), "run": (run, info, 1), "none": (run.limit(0), info, 3)}).orderBy("row_idx").collect()
    assert json.loads(out[0].example) == {"query": "text 0", "labels": [{"text": "text 1", "score": "1.0000"}], "run": [{"text": "text 1", "score": "0.9000"}], "none": [], "score": "1.0000"}


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_exact_search_either_way(spark, monkeypatch, limit):
    """With broadcast queries and in blocks: the same results, ties by the smaller index."""
    monkeypatch.setattr(ret, "QUERY_BYTES", limit)
    rng = np.random.default_rng(7)
    m = rng.integers(-1, 2, (400, 6)).astype(float)  # many equal similarities
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "idx bigint, vector array<double>").repartition(5)
    unit = {i: v / np.linalg.norm(v) for i, v in enumerate(m) if v.any()}
    got = {}
    for r in ret.exact_search(df.filter("idx % 3 = 0"), df, 7, 6).collect():
        got.setdefault(r.row_idx, []).append((-r.score, r.col_idx))
    for i in (i for i in unit if i % 3 == 0):
        want = sorted((-round(float(unit[i] @ v), 12), j) for j, v in unit.items())[:7]
        assert [(round(a, 9), b) for a, b in sorted(got[i])] == [(round(a, 9), b) for a, b in want]
    assert ret.exact_search(df.limit(0), df, 3, 6).count() == ret.exact_search(df, df.limit(0), 3, 6).count() == 0
