"""Queries of ranking metrics and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.operators import metrics
from relweave.operators import relation as rel
from relweave.operators.retrieval import exact_search
from relweave.plans.common import LBL, META, NEG, cells, r6
from relweave.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


KS = (1, 5, 10)


def run(spark, d):
    """A run in which some relevant labels rank among the others."""
    return rel.add(rel.scale(cells(spark, d, "data_lbl"), 0.5), cells(spark, d, "data_neg"))


def truth(spark, d):
    return rel.threshold(cells(spark, d, "data_lbl"), 0.6)


_RUN = f"(SELECT row_idx, col_idx, sum(score) AS score FROM (SELECT row_idx, col_idx, score * 0.5::DOUBLE AS score FROM {LBL} UNION ALL SELECT * FROM {NEG}) GROUP BY ALL)"
_TRUTH = f"(SELECT * FROM {LBL} WHERE score >= 0.6)"
_HITS = f"""truth AS MATERIALIZED {_TRUTH}, ranked AS (SELECT row_idx, col_idx, row_number() OVER (PARTITION BY row_idx ORDER BY score DESC, col_idx) AS rank FROM {_RUN}),
 hits AS MATERIALIZED (SELECT r.row_idx, r.rank, t.score AS rel, row_number() OVER (PARTITION BY r.row_idx ORDER BY r.rank) AS nth FROM ranked r JOIN truth t USING (row_idx, col_idx) WHERE rank <= 10),
 sizes AS (SELECT row_idx, count(*) AS n FROM truth GROUP BY row_idx), ks AS (SELECT unnest([1, 5, 10])::INTEGER AS k)"""


def _metric_sql(base: str) -> str:
    ideal = "list_sum(list_transform(range(1, least(s.n, k) + 1), lambda r: 1 / log2(r + 1)))"
    return f"""WITH {base}, raw AS (SELECT s.row_idx, k, s.n, count(h.rank) AS hits, min(h.rank) AS first, coalesce(sum(h.nth / h.rank::DOUBLE), 0) AS ap,
      coalesce(sum(1 / log2(h.rank + 1)), 0) / {ideal} AS ndcg
      FROM sizes s CROSS JOIN ks LEFT JOIN hits h ON h.row_idx = s.row_idx AND h.rank <= k GROUP BY s.row_idx, k, s.n),
    long AS (SELECT row_idx, k, unnest(['P', 'R', 'Hits', 'MRR', 'MAP', 'NDCG']) AS metric,
      unnest([hits / k::DOUBLE, hits / n::DOUBLE, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END::DOUBLE, coalesce(1 / first::DOUBLE, 0), ap / n, ndcg]) AS value FROM raw)
    """


@query(_metric_sql(_HITS) + "SELECT row_idx, metric, k, round(value + 1e-10, 6) AS value FROM long")
def metrics_per_query(spark, d):
    """P, R, Hits, MRR, MAP and binary NDCG at 1, 5 and 10 of each query with a truth."""
    return metrics.per_query(run(spark, d), truth(spark, d), KS).select("row_idx", "metric", "k", r6("value", "value"))


def _mean(name: str, metric: str):
    def f(spark, d):
        per = metrics.per_query(run(spark, d), truth(spark, d), KS).filter(F.col("metric") == metric)
        return metrics.mean_metrics(per).select("metric", "k", r6("value", "value"))

    f.__name__ = name
    return query(_metric_sql(_HITS) + f"SELECT metric, k, round(avg(value) + 1e-10, 6) AS value FROM long WHERE metric = '{metric}' GROUP BY metric, k")(f)


for _name, _metric in (("ndcg_binary", "NDCG"), ("precision_at_k", "P"), ("recall_at_k", "R"), ("mrr_at_k", "MRR"), ("hits_at_k", "Hits"), ("map_at_k", "MAP")):
    _mean(_name, _metric)


@query(
    _metric_sql(_HITS)
    + """SELECT dataset, metric, k, round(avg(value) + 1e-10, 6) AS value FROM long JOIN (SELECT DISTINCT idx, dataset FROM data_info) ON idx = row_idx GROUP BY dataset, metric, k
    UNION ALL SELECT 'macro', metric, k, round(avg(value) + 1e-10, 6) FROM (SELECT dataset, metric, k, avg(value) AS value FROM long JOIN (SELECT DISTINCT idx, dataset FROM data_info) ON idx = row_idx GROUP BY dataset, metric, k) GROUP BY metric, k"""
)
def macro_average(spark, d):
    """Means per dataset and, as dataset ``macro``, the mean of these."""
    per = metrics.per_query(run(spark, d), truth(spark, d), KS)
    of = table(spark, d, "data_info").select(F.col("idx").alias("row_idx"), "dataset").distinct()
    each = per.join(of, "row_idx").groupBy("dataset", "metric", "k").agg(F.avg("value").alias("value"))
    macro = each.groupBy("metric", "k").agg(F.avg("value").alias("value")).withColumn("dataset", F.lit("macro"))
    return each.unionByName(macro).select("dataset", "metric", "k", r6("value", "value"))


_GRADED = f"""WITH truth AS MATERIALIZED (SELECT row_idx, col_idx, {{rel}} AS score FROM {LBL}), ranked AS (SELECT row_idx, col_idx, row_number() OVER (PARTITION BY row_idx ORDER BY score DESC, col_idx) AS rank FROM {_RUN}),
 gain AS (SELECT r.row_idx, sum(t.score / log2(rank + 1)) AS dcg FROM ranked r JOIN truth t USING (row_idx, col_idx) WHERE rank <= 10 GROUP BY r.row_idx),
 ideal AS (SELECT row_idx, sum(score / log2(rank + 1)) AS idcg FROM (SELECT row_idx, score, row_number() OVER (PARTITION BY row_idx ORDER BY score DESC, col_idx) AS rank FROM truth) WHERE rank <= 10 GROUP BY row_idx)
 SELECT row_idx, round(coalesce(dcg, 0) / idcg + 1e-10, 6) AS value FROM ideal LEFT JOIN gain USING (row_idx) WHERE idcg > 0"""


@query(_GRADED.format(rel="score"))
def ndcg_graded(spark, d):
    return metrics.graded_ndcg(run(spark, d), cells(spark, d, "data_lbl"), 10).select("row_idx", r6("value", "value"))


@query(_GRADED.format(rel="trunc(score * 4)"))
def ndcg_whole_grades(spark, d):
    """Relevance cut to whole numbers, here quarters of the score."""
    return metrics.graded_ndcg(run(spark, d), rel.scale(cells(spark, d, "data_lbl"), 4.0), 10, whole_relevance=True).select("row_idx", r6("value", "value"))


@query(f"WITH {_HITS} SELECT row_idx, rank, round(sum(1 / log2(rank + 1)) OVER (PARTITION BY row_idx ORDER BY rank) + 1e-10, 6) AS dcg FROM hits")
def dcg_running(spark, d):
    return metrics.running_dcg(run(spark, d), truth(spark, d), 10).select("row_idx", F.col("rank").cast("bigint").alias("rank"), r6("dcg", "dcg"))


@query(
    f"""WITH {_HITS}, n AS (SELECT count(DISTINCT row_idx)::DOUBLE AS rows FROM truth), f AS (SELECT col_idx, count(*) AS c FROM truth GROUP BY col_idx),
    w AS (SELECT col_idx, 1 + (ln(rows) - 1) * pow(2.5, 0.55) * pow(c + 1.5, -0.55) AS w FROM f, n),
    h AS (SELECT r.col_idx FROM ranked r JOIN truth t USING (row_idx, col_idx) WHERE rank <= 5)
    SELECT round(coalesce(sum(w), 0) / 5 / any_value(rows) + 1e-10, 6) AS value FROM h JOIN w USING (col_idx), n"""
)
def propensity_precision(spark, d):
    return metrics.propensity_precision(run(spark, d), truth(spark, d), 5).select(r6("value", "value"))


def _compared(spark, d):
    a = metrics.per_query(run(spark, d), truth(spark, d), (10,)).filter("metric = 'NDCG'")
    b = metrics.per_query(cells(spark, d, "data_neg"), truth(spark, d), (10,)).filter("metric = 'NDCG'")
    return metrics.compare(a, b)


_COMPARED = (
    f"truth AS MATERIALIZED {_TRUTH}, sizes AS (SELECT row_idx, least(count(*), 10) AS n FROM truth GROUP BY row_idx),"
    + ", ".join(
        f"""{name} AS MATERIALIZED (SELECT s.row_idx, coalesce(g, 0) / list_sum(list_transform(range(1, n + 1), lambda r: 1 / log2(r + 1))) AS v FROM sizes s LEFT JOIN
      (SELECT r.row_idx, sum(1 / log2(rank + 1)) AS g FROM (SELECT row_idx, col_idx, row_number() OVER (PARTITION BY row_idx ORDER BY score DESC, col_idx) AS rank FROM {r}) r JOIN truth USING (row_idx, col_idx) WHERE rank <= 10 GROUP BY r.row_idx) x USING (row_idx))"""
        for name, r in (("a", _RUN), ("b", NEG))
    )
)


@query(f"WITH {_COMPARED} SELECT row_idx, round(a.v + 1e-10, 6) AS a, round(b.v + 1e-10, 6) AS b, round(a.v - b.v + 1e-10, 6) AS difference FROM a JOIN b USING (row_idx)")
def metric_difference(spark, d):
    return _compared(spark, d).select("row_idx", r6("a", "a"), r6("b", "b"), r6("difference", "difference"))


@query(f"WITH {_COMPARED} SELECT count(*) AS n, round(avg(a.v - b.v) + 1e-10, 6) AS mean_difference, round(avg(a.v - b.v) / (stddev_samp(a.v - b.v) / sqrt(count(*))) + 1e-10, 4) AS t FROM a JOIN b USING (row_idx)")
def paired_t(spark, d):
    return metrics.paired_t(_compared(spark, d)).select("n", r6("mean_difference", "mean_difference"), F.round(F.col("t") + 1e-10, 4).alias("t"))


@query("SELECT event_type, round(avg(value) + 1e-10, 6) AS mean, round(quantile_cont(value, 0.5) + 1e-10, 6) AS p50, round(quantile_cont(value, 0.95) + 1e-10, 6) AS p95, round(stddev_pop(value) + 1e-10, 6) AS std FROM events WHERE NOT isnan(value) GROUP BY event_type")
def latency_stats(spark, d):
    return metrics.spread(table(spark, d, "events"), "value", "event_type").select("event_type", *(r6(c, c) for c in ("mean", "p50", "p95", "std")))


@query(
    f"""SELECT n_rows, n_cols, n_cells, round(n_cells / n_rows::DOUBLE + 1e-10, 6) AS per_row, round(n_cells / n_cols::DOUBLE + 1e-10, 6) AS per_col
    FROM (SELECT count(*) AS n_cells FROM {META}), (SELECT count(DISTINCT idx) AS n_rows FROM data_info), (SELECT count(DISTINCT idx) AS n_cols FROM meta_info)"""
)
def metadata_stats(spark, d):
    rows, cols = table(spark, d, "data_info").select("idx").distinct(), table(spark, d, "meta_info").select("idx").distinct()
    return metrics.relation_stats(cells(spark, d, "data_meta"), rows, cols).select("n_rows", "n_cols", "n_cells", r6("per_row", "per_row"), r6("per_col", "per_col"))


_NEAR = """near AS MATERIALIZED (SELECT a.vec_id AS row_idx, b.vec_id AS col_idx, a.label = b.label AS same, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
 hits AS MATERIALIZED (SELECT row_idx, rank, row_number() OVER (PARTITION BY row_idx ORDER BY rank) AS nth FROM near WHERE rank <= 10 AND same),
 sizes AS (SELECT vec_id AS row_idx, n FROM embeddings JOIN (SELECT label, count(*) - 1 AS n FROM embeddings GROUP BY label) USING (label) WHERE n > 0), ks AS (SELECT unnest([1, 5, 10])::INTEGER AS k)"""


@query(_metric_sql(_NEAR) + "SELECT metric, k, round(avg(value) + 1e-10, 6) AS value FROM long GROUP BY metric, k")
def retrieval_quality(spark, d):
    """Exact dense retrieval over the embeddings, judged by equal labels."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"), "label")
    found = exact_search(rows, rows, 11, 64).filter("row_idx <> col_idx")
    return metrics.mean_metrics(metrics.per_query_by_label(found, rows, KS)).select("metric", "k", r6("value", "value"))
