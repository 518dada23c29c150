"""Ranking metrics over a run (row_idx, col_idx, score) and a truth (row_idx, col_idx, score).

A run is ranked by score, equal scores by smaller column. Every row of the truth counts; a row without a result
gets 0. Rows of the run without truth do not count. Metrics are long tables (row_idx, metric, k, value).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relweave.operators.relation import ranked


def judged(run: DataFrame, truth: DataFrame, depth: int) -> DataFrame:
    """(row_idx, rank, rel) of the hits among the first ``depth`` results, rel being the truth's score."""
    best = ranked(run).filter(F.col("rank") <= depth).select("row_idx", "col_idx", "rank")
    return best.join(truth.select("row_idx", "col_idx", F.col("score").alias("rel")), ["row_idx", "col_idx"]).select("row_idx", "rank", "rel")


def _ideal_binary(k: int):
    """The best DCG of n relevant results, as an expression of n."""
    sums, total = [], 0.0
    for r in range(1, k + 1):
        total += 1 / math.log2(r + 1)
        sums.append(total)
    return F.array(*(F.lit(x) for x in sums))


def per_query(run: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Binary metrics P, R, MRR, Hits, MAP and NDCG at each k, for each row of the truth.

    Every cell of the truth is relevant, whatever its score. One pass over the hits computes all.
    """
    hits = judged(run, truth, max(ks)).select("row_idx", "rank")
    return _from_hits(hits, truth.groupBy("row_idx").agg(F.count("*").alias("n_rel")), ks)


def per_query_by_label(run: DataFrame, labels: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """As ``per_query`` with the other items of the same label as truth; ``labels`` is (idx, label). The truth, which would
    have a cell for each pair of a label, is never spelt out. Items alone with their label do not count."""
    best = ranked(run).filter(F.col("rank") <= max(ks))
    of = labels.select("idx", "label").dropna().dropDuplicates(["idx"])
    hits = best.join(of.select(F.col("idx").alias("row_idx"), "label"), "row_idx").join(of.select(F.col("idx").alias("col_idx"), F.col("label").alias("other")), "col_idx")
    sizes = of.groupBy("label").agg((F.count("*") - 1).alias("n_rel")).filter("n_rel > 0")
    sizes = of.join(sizes, "label").select(F.col("idx").alias("row_idx"), "n_rel")
    return _from_hits(hits.filter("label = other").select("row_idx", "rank"), sizes, ks)


def _from_hits(hits: DataFrame, sizes: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("row_idx").orderBy("rank"))
    hits = hits.withColumn("nth", nth)
    sums = []
    for k in ks:
        in_k = F.col("rank") <= k
        sums += [
            F.count_if(in_k).alias(f"h{k}"),
            F.min(F.when(in_k, F.col("rank"))).alias(f"f{k}"),
            F.sum(F.when(in_k, F.col("nth") / F.col("rank")).otherwise(0.0)).alias(f"a{k}"),
            F.sum(F.when(in_k, 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"d{k}"),
        ]
    table = sizes.join(hits.groupBy("row_idx").agg(*sums), "row_idx", "left")
    values = []
    zero = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    for k in ks:
        n = F.col("n_rel").cast("double")
        ideal = F.element_at(_ideal_binary(k), F.least(F.col("n_rel"), F.lit(k)).cast("int"))
        for metric, value in (
            ("P", zero(f"h{k}") / k), ("R", zero(f"h{k}") / n), ("Hits", F.when(zero(f"h{k}") > 0, 1.0).otherwise(0.0)),
            ("MRR", F.coalesce(1.0 / F.col(f"f{k}"), F.lit(0.0))), ("MAP", zero(f"a{k}") / n), ("NDCG", zero(f"d{k}") / ideal),
        ):
            values.append(F.struct(F.lit(metric).alias("metric"), F.lit(k).alias("k"), value.alias("value")))
    return table.select("row_idx", F.explode(F.array(*values)).alias("m")).select("row_idx", "m.metric", "m.k", "m.value")


def pointwise_precision(run: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(row_idx, col_idx, value): for the first k results of each row of the truth 1 / k if relevant, else 0; summed by row this
    is the row's precision."""
    best = ranked(run).filter(F.col("rank") <= k).join(truth.select("row_idx").distinct(), "row_idx", "left_semi")
    relevant = truth.select("row_idx", "col_idx", F.lit(1.0 / k).alias("hit"))
    return best.join(relevant, ["row_idx", "col_idx"], "left").select("row_idx", "col_idx", F.coalesce("hit", F.lit(0.0)).alias("value"))


def mean_metrics(per: DataFrame) -> DataFrame:
    """(metric, k, value): the mean over rows."""
    return per.groupBy("metric", "k").agg(F.avg("value").alias("value"))


def graded_ndcg(run: DataFrame, truth: DataFrame, k: int, whole_relevance: bool = False) -> DataFrame:
    """(row_idx, value): NDCG@k with the truth's scores as linear gains. Rows whose ideal is 0 have no value.

    ``whole_relevance`` cuts relevance to whole numbers first, so that 0.9 becomes 0.
    """
    if whole_relevance:
        truth = truth.withColumn("score", F.col("score").cast("int").cast("double"))
    discount = 1.0 / F.log2(F.col("rank") + 1)
    gain = judged(run, truth, k).groupBy("row_idx").agg(F.sum(F.col("rel") * discount).alias("dcg"))
    ideal = ranked(truth).filter(F.col("rank") <= k).groupBy("row_idx").agg(F.sum(F.col("score") * discount).alias("idcg")).filter("idcg > 0")
    return ideal.join(gain, "row_idx", "left").select("row_idx", (F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias("value"))


def running_dcg(run: DataFrame, truth: DataFrame, depth: int) -> DataFrame:
    """(row_idx, rank, dcg): the gain of binary truth cumulated down the ranking."""
    w = Window.partitionBy("row_idx").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return judged(run, truth, depth).withColumn("dcg", F.sum(1.0 / F.log2(F.col("rank") + 1)).over(w)).select("row_idx", "rank", "dcg")


def propensity_precision(run: DataFrame, truth: DataFrame, k: int, a: float = 0.55, b: float = 1.5) -> DataFrame:
    """(value): mean precision@k with each hit weighted by the inverse propensity of its column.

    1 + c (n + b)^-a with c = (ln N - 1)(b + 1)^a, N being the rows of the truth and n those of the column.
    """
    total = truth.select("row_idx").distinct().agg(F.count("*").alias("rows"))
    frequency = truth.groupBy("col_idx").agg(F.count("*").alias("n"))
    weight = 1 + (F.log(F.col("rows").cast("double")) - 1) * F.pow(F.lit(b + 1), F.lit(a)) * F.pow(F.col("n") + b, F.lit(-a))
    weights = frequency.crossJoin(F.broadcast(total)).select("col_idx", weight.alias("w"))  # total has one row
    best = ranked(run).filter(F.col("rank") <= k).join(truth.select("row_idx", "col_idx"), ["row_idx", "col_idx"]).join(weights, "col_idx")
    return best.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("s")).crossJoin(total).select((F.col("s") / k / F.col("rows")).alias("value"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row_idx, a, b, difference) of two tables (row_idx, value); rows that one lacks are dropped."""
    return a.select("row_idx", F.col("value").alias("a")).join(b.select("row_idx", F.col("value").alias("b")), "row_idx").withColumn("difference", F.col("a") - F.col("b"))


def paired_t(compared: DataFrame) -> DataFrame:
    """One row (n, mean_difference, t, p) of the paired t-test. t and p are null for fewer than two rows or no spread."""
    one = compared.agg(F.count("*").alias("n"), F.avg("difference").alias("mean_difference"), F.stddev_samp("difference").alias("sd"))
    t = F.when(F.col("sd") > 0, F.col("mean_difference") / (F.col("sd") / F.sqrt(F.col("n").cast("double"))))
    p = F.pandas_udf(lambda ts, ns: ts.combine(ns, lambda x, n: None if x != x or n < 2 else two_sided_p(x, int(n) - 1)), "double")
    return one.select("n", "mean_difference", t.alias("t")).withColumn("p", p("t", "n"))


def two_sided_p(t: float, df: int) -> float:
    """The probability of |T| >= |t| under Student's distribution: the regularised incomplete beta function
    I_x(df / 2, 1 / 2) at x = df / (df + t^2), by its continued fraction."""
    a, b, x = df / 2, 0.5, df / (df + t * t)
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def _fraction(a: float, b: float, x: float) -> float:
    """Lentz's evaluation of the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return value


def relation_stats(r: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """One row: rows, columns and cells, and cells per row and per column with the empty ones."""
    n = rows.agg(F.count("*").alias("n_rows"))
    m = columns.agg(F.count("*").alias("n_cols"))
    return (
        r.agg(F.count("*").alias("n_cells")).crossJoin(n).crossJoin(m)
        .select("n_rows", "n_cols", "n_cells", (F.col("n_cells") / F.col("n_rows")).alias("per_row"), (F.col("n_cells") / F.col("n_cols")).alias("per_col"))
    )


def spread(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, median, 95th percentile (both interpolated) and population deviation; nulls and NaN do not count."""
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull() & ~F.isnan(v))
    return rows.groupBy(*by).agg(F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("p50"), F.percentile(v, 0.95).alias("p95"), F.stddev_pop(v).alias("std"))
