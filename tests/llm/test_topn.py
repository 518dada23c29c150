import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from relweave.llm.topn import top_n_per_group

SCHEMA = "q bigint, d bigint, s double, g string, i int"


def brute(rows, n):
    best = {}
    for q, d, s, *_ in rows:
        if None not in (q, d, s) and not math.isnan(s):
            best[q, d] = max(s, best.get((q, d), -math.inf))
    out = set()
    for q in {q for q, _ in best}:
        mine = sorted(((-s, d) for (a, d), s in best.items() if a == q))[:n]
        out |= {(q, d, -s) for s, d in mine}
    return out


def got(df, n):
    return {tuple(r) for r in top_n_per_group(df, "q", "d", "s", n).collect()}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-2, 3)), st.one_of(st.none(), st.integers(0, 6)), st.sampled_from([None, math.nan, 0.5, 0.5, -1.0, 2.0])), max_size=40), st.integers(1, 4))
def test_equals_brute_force(spark, rows, n):
    rows = [(*r, "x", 1) for r in rows]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(df, n) == brute(rows, n)


def test_hot_group_over_many_batches(spark):
    rng = np.random.default_rng(0)
    rows = [(7 if k % 3 == 0 else int(k), int(rng.integers(0, 4000)), float(rng.integers(0, 50)), "x", 1) for k in range(30_000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        assert got(spark.createDataFrame(rows, SCHEMA).repartition(5), 40) == brute(rows, 40)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA), 3) == set()
