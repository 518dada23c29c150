"""Queries of retrieval, mining and set assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.operators import lookup, metrics
from relweave.operators import relation as rel
from relweave.operators import retrieval as ret
from relweave.plans.common import LBL, META, NEG, cells, info, info_sql, r6, rounded, rounded_sql
from relweave.plans.rankings import _RUN, run
from relweave.session import cut, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_RANK = "row_number() OVER (PARTITION BY row_idx ORDER BY score DESC, col_idx)"
_GOOD = """(SELECT vec_id, min(embedding)::DOUBLE[] AS e FROM text_vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND vec_id IS NOT NULL GROUP BY vec_id)"""


def _vectors(spark, d, name="text_vectors"):
    return table(spark, d, name).select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"))


def _queries(v):
    """The stated query set: every vector whose id is divisible by 50."""
    return v.filter(F.col("idx") % 50 == 0)


@query(
    f"""WITH g AS MATERIALIZED {_GOOD}, s AS (SELECT q.vec_id AS row_idx, v.vec_id AS col_idx, round(list_cosine_similarity(q.e, v.e), 12) AS score FROM g q JOIN g v ON true WHERE q.vec_id % 50 = 0)
    SELECT row_idx, col_idx, round(score + 1e-10, 6) AS score FROM s QUALIFY {_RANK} <= 10"""
)
def cosine_topk(spark, d):
    """Exact search of the stated queries over all text vectors."""
    v = _vectors(spark, d)
    return rounded(ret.exact_search(_queries(v), v, 10, 64))


@query(
    f"""WITH g AS MATERIALIZED {_GOOD}, h AS (SELECT vec_id, e[1:32] AS e FROM g), s AS (SELECT q.vec_id AS row_idx, v.vec_id AS col_idx, round(list_cosine_similarity(q.e, v.e), 12) AS score FROM h q JOIN h v ON true WHERE q.vec_id % 50 = 0)
    SELECT row_idx, col_idx, round(score + 1e-10, 6) AS score FROM s QUALIFY {_RANK} <= 10"""
)
def two_tower_truncate(spark, d):
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0) & (F.size("vector") == 64)
    v = _vectors(spark, d).filter(F.col("vector").isNotNull() & good)
    return rounded(ret.two_tower_search(_queries(v), v, 10, 32))


@query("SELECT count(*) FILTER (vec_id % 50 = 0) AS n_queries, count(*) FILTER (vec_id % 50 = 0) * least(10, count(*)) AS n_neighbours, true AS enough FROM embeddings")
def lsh_recall(spark, d):
    """The stated queries, their neighbours by exact search, and whether approximate search finds 9 of 10 of them."""
    v = _vectors(spark, d, "embeddings")
    exact = ret.exact_search(_queries(v), v, 10, 64).select("row_idx", "col_idx")
    found = ret.lsh_search(_queries(v), v, 10, 64).select("row_idx", "col_idx", F.lit(True).alias("found"))
    both = exact.join(found, ["row_idx", "col_idx"], "left")
    return both.agg(F.count_distinct("row_idx").alias("n_queries"), F.count("*").alias("n_neighbours"), (F.count("found") >= 0.9 * F.count("*")).alias("enough"))


@query()
def lsh_topk(spark, d):
    """Approximate search of the stated queries over the embeddings; the tests measure its recall."""
    v = _vectors(spark, d, "embeddings")
    return ret.lsh_search(_queries(v), v, 10, 64)


_LM = f"(SELECT l.col_idx AS row_idx, m.col_idx, sum(l.score * m.score) AS score FROM {LBL} l JOIN {META} m ON l.row_idx = m.row_idx GROUP BY ALL)"


def _label_meta(spark, d):
    """The metadata of labels: those of the queries that they belong to."""
    return rel.multiply(rel.transpose(cells(spark, d, "data_lbl")), cells(spark, d, "data_meta"))


@query(
    f"""WITH lm AS MATERIALIZED (SELECT row_idx, col_idx, round(score, 9) AS score FROM {_LM}), m AS {META},
    p AS (SELECT m.row_idx, lm.row_idx AS col_idx, round(sum(m.score * lm.score), 9) AS score FROM m JOIN lm ON m.col_idx = lm.col_idx GROUP BY ALL) SELECT row_idx, col_idx, round(score + 1e-10, 6) AS score FROM p QUALIFY {_RANK} <= 10"""
)
def labels_through_metadata(spark, d):
    label_meta = _label_meta(spark, d).withColumn("score", F.round("score", 9))
    return rounded(ret.labels_through_metadata(cells(spark, d, "data_meta"), label_meta, 10))


@query(
    f"""WITH a AS (SELECT * FROM {LBL} QUALIFY {_RANK} <= 5), b AS (SELECT * FROM (SELECT row_idx, col_idx, round(score, 9) AS score FROM {_LM}) QUALIFY {_RANK} <= 1),
    p AS (SELECT a.row_idx, b.col_idx, round(sum(a.score * b.score), 9) AS score FROM a JOIN b ON a.col_idx = b.row_idx GROUP BY ALL) SELECT row_idx, col_idx FROM p QUALIFY {_RANK} <= 5"""
)
def map_vocabulary(spark, d):
    """Queries to metadata through their best labels and the best phrase of each."""
    label_meta = _label_meta(spark, d).withColumn("score", F.round("score", 9))
    return ret.map_vocabulary(cells(spark, d, "data_lbl"), label_meta).select("row_idx", "col_idx")


@query(f"SELECT row_idx, col_idx, score FROM (SELECT * FROM {_RUN} n WHERE NOT EXISTS (SELECT 1 FROM {LBL} l WHERE l.row_idx = n.row_idx AND l.col_idx = n.col_idx)) QUALIFY {_RANK} BETWEEN 4 AND 12")
def hard_negative_band(spark, d):
    return ret.hard_negatives(run(spark, d), cells(spark, d, "data_lbl"))


@query(
    f"""WITH n AS (SELECT * FROM {NEG} x WHERE NOT EXISTS (SELECT 1 FROM {LBL} l WHERE l.row_idx = x.row_idx AND l.col_idx = x.col_idx))
    SELECT DISTINCT row_idx, col_idx, 1.0::DOUBLE AS score FROM (SELECT row_idx, col_idx FROM n QUALIFY {_RANK} <= 25 UNION ALL
      SELECT row_idx, col_idx FROM (SELECT x.row_idx, x.col_idx, x.score / c.n AS score FROM n x JOIN (SELECT col_idx, count(*) AS n FROM {NEG} GROUP BY col_idx) c USING (col_idx)) QUALIFY {_RANK} <= 25)"""
)
def negatives_union(spark, d):
    """The negatives of two models: one ranks by score, the other favours rare labels."""
    r = cells(spark, d, "data_neg")
    return ret.combined_negatives([r, rel.column_scale_by_count(r)], cells(spark, d, "data_lbl"), 25)


@query(f"SELECT row_idx, least, count(*) AS n, min(score) AS worst FROM {NEG}, (SELECT unnest([0.7, 0.8, 0.9])::DOUBLE AS least) WHERE score >= least GROUP BY row_idx, least")
def threshold_columns(spark, d):
    out = ret.by_thresholds(cells(spark, d, "data_neg"), (0.7, 0.8, 0.9))
    return out.select("row_idx", "least", F.size("cells").cast("bigint").alias("n"), F.col("cells")[0]["score"].alias("worst"))


@query(f"SELECT n.row_idx, n.col_idx, l.score FROM {NEG} n JOIN {LBL} l USING (row_idx, col_idx)")
def rescore(spark, d):
    return ret.rescore(cells(spark, d, "data_neg"), cells(spark, d, "data_lbl"))


@query(
    f"""SELECT row_idx, q.text AS query, string_agg(l.text || '=' || printf('%.4f', score), ' || ' ORDER BY score DESC, col_idx) AS docs FROM (SELECT * FROM {LBL} QUALIFY {_RANK} <= 4 AND max(score) OVER (PARTITION BY row_idx) > 0)
    JOIN (SELECT * FROM {info_sql('data_info')} WHERE text IS NOT NULL) q ON row_idx = q.idx JOIN (SELECT * FROM {info_sql('label_raw')} WHERE text IS NOT NULL) l ON col_idx = l.idx GROUP BY ALL"""
)
def listwise(spark, d):
    sets = ret.listwise(cells(spark, d, "data_lbl"), info(spark, d, "data_info"), info(spark, d, "label_raw"), 4)
    docs = F.array_join(F.transform("docs", lambda x: F.concat(x["doc"], F.lit("="), F.format_string("%.4f", x["label"]))), " || ")
    return sets.select("row_idx", "query", docs.alias("docs"))


@query(
    f"""WITH p AS (SELECT row_idx AS idx, list(col_idx ORDER BY col_idx) AS d FROM {LBL} GROUP BY row_idx), n AS (SELECT row_idx AS idx, list(col_idx ORDER BY col_idx) AS d FROM {NEG} GROUP BY row_idx)
    SELECT idx, text AS query, array_to_string(list_concat(p.d, n.d), ',') AS docs, len(p.d) AS n_positive FROM p JOIN n USING (idx) JOIN {info_sql('data_info')} USING (idx)"""
)
def aligned_lists(spark, d):
    """Positive and negative labels of each query in one list, once the queries were found to agree."""

    def lists(name: str, label: float):
        docs = cells(spark, d, name).groupBy(F.col("row_idx").alias("idx")).agg(F.array_sort(F.collect_list("col_idx")).alias("docs"))
        texts = info(spark, d, "data_info").select("idx", F.concat("text", F.lit(" [SEP] "), F.lit(name)).alias("query"))
        return docs.join(texts, "idx").withColumn("labels", F.transform("docs", lambda _: F.lit(label)))

    both = ret.aligned_pairs(lists("data_lbl", 1.0), lists("data_neg", 0.0))
    return both.select("idx", F.substring_index("query", " [SEP] ", 1).alias("query"), F.array_join(F.transform("docs", lambda x: x.cast("string")), ",").alias("docs"), F.size(F.filter("labels", lambda x: x > 0)).cast("bigint").alias("n_positive"))


_P = f"SELECT DISTINCT q.text AS query, l.text AS doc FROM {{r}} JOIN {info_sql('data_info')} q ON row_idx = q.idx JOIN {info_sql('label_raw')} l ON col_idx = l.idx WHERE q.text IS NOT NULL AND l.text IS NOT NULL"
_KEPT = f"(SELECT * FROM {NEG} QUALIFY {_RANK} <= 5)"


@query(
    f"""WITH p AS ({_P.format(r=LBL)}), n AS ({_P.format(r=_KEPT)} AND row_idx IN (SELECT row_idx FROM {LBL} JOIN {info_sql('label_raw')} ON col_idx = idx WHERE text IS NOT NULL)),
    q AS (SELECT query, row_number() OVER (ORDER BY query) - 1 AS row_idx FROM (SELECT query FROM p UNION SELECT query FROM n)), d AS (SELECT doc, row_number() OVER (ORDER BY doc) - 1 AS col_idx FROM (SELECT doc FROM p UNION SELECT doc FROM n))
    SELECT 'positive' AS kind, row_idx, col_idx FROM p JOIN q USING (query) JOIN d USING (doc) UNION ALL SELECT 'negative', row_idx, col_idx FROM n JOIN q USING (query) JOIN d USING (doc)"""
)
def supervised_relations(spark, d):
    """Queries, documents and their negatives as vocabularies and relations."""
    q = info(spark, d, "data_info").select(F.col("idx").alias("row_idx"), F.col("text").alias("query"))
    l = info(spark, d, "label_raw").select(F.col("idx").alias("col_idx"), F.col("text").alias("document"))
    negatives = rel.top_k(cells(spark, d, "data_neg"), 5).join(l, "col_idx").groupBy("row_idx").agg(F.collect_set("document").alias("negatives"))
    pairs = cells(spark, d, "data_lbl").join(q, "row_idx").join(l, "col_idx").filter("document IS NOT NULL").join(negatives, "row_idx", "left").select("query", "document", "negatives")
    _, _, positive, negative = ret.supervised_relations(pairs)
    return positive.select(F.lit("positive").alias("kind"), "row_idx", "col_idx").unionByName(negative.select(F.lit("negative").alias("kind"), "row_idx", "col_idx"))


_QRELS = f"(SELECT 'trn-' || lpad(row_idx::VARCHAR, 9, '0') AS qid, 'lbl-' || lpad((col_idx * 2)::VARCHAR, 9, '0') AS did, score AS rel FROM {LBL})"


def _qrels(spark, d):
    name = lambda prefix, c: F.concat(F.lit(prefix), F.lpad(c.cast("string"), 9, "0"))
    return cells(spark, d, "data_lbl").select(name("trn-", F.col("row_idx")).alias("qid"), name("lbl-", F.col("col_idx") * 2).alias("did"), F.col("score").alias("rel"))


@query(f"SELECT q.idx AS row_idx, l.idx AS col_idx, rel AS score FROM {_QRELS} JOIN {info_sql('data_info')} q ON qid = q.identifier JOIN {info_sql('label_raw')} l ON did = l.identifier")
def qrels_relation(spark, d):
    return ret.judgements(_qrels(spark, d), info(spark, d, "data_info"), info(spark, d, "label_raw"))[0]


@query(f"SELECT count(*) FILTER (qid NOT IN (SELECT identifier FROM data_info)) AS missing_queries, count(*) FILTER (did NOT IN (SELECT identifier FROM label_raw)) AS missing_documents FROM {_QRELS}")
def qrels_missing(spark, d):
    return ret.judgements(_qrels(spark, d), info(spark, d, "data_info"), info(spark, d, "label_raw"))[1]


@query(f"SELECT row_idx, dense_rank() OVER (ORDER BY col_idx) - 1 AS col_idx, score FROM {LBL}")
def compact_columns(spark, d):
    return ret.compact_columns(cells(spark, d, "data_lbl"))[0]


_EX_TEXT = f"(SELECT DISTINCT idx, text FROM {info_sql('{t}')})"


def _section(r: str, k: int, name: str) -> str:
    return f"""{name} AS (SELECT row_idx, list({{{{'text': text, 'score': printf('%.4f', score)}}}} ORDER BY score DESC, col_idx) AS l FROM (SELECT * FROM {r} QUALIFY {_RANK} <= {k})
      JOIN {info_sql('{info}')} ON col_idx = idx GROUP BY row_idx)"""


def _chosen_sql(how: str, order: str) -> str:
    """Examples of 12 rows by the difference of the reciprocal ranks of two runs."""
    first = lambda r: f"(SELECT r.row_idx, 1.0 / min(r.rank) AS v FROM (SELECT row_idx, col_idx, {_RANK} AS rank FROM {r}) r JOIN {LBL} l USING (row_idx, col_idx) WHERE rank <= 10 GROUP BY r.row_idx)"
    sections = ", ".join((_section(LBL, 3, "lbl").replace("{info}", "label_raw"), _section(META, 5, "meta").replace("{info}", "meta_info"))).replace("{{", "{").replace("}}", "}")
    return f"""WITH t AS (SELECT DISTINCT row_idx FROM {LBL}), v AS (SELECT row_idx, round(coalesce(a.v, 0) - coalesce(b.v, 0), 9) AS value FROM t LEFT JOIN {first(_RUN)} a USING (row_idx) LEFT JOIN {first(NEG)} b USING (row_idx)),
    c AS (SELECT row_idx, value FROM v ORDER BY {order} LIMIT 12), {sections}
    SELECT '{how}' AS how, c.row_idx, to_json({{'query': q.text, 'labels': coalesce(lbl.l, []), 'metadata': coalesce(meta.l, []), 'score': printf('%.4f', value)}})::VARCHAR AS example
    FROM c JOIN {info_sql('data_info')} q ON c.row_idx = q.idx LEFT JOIN lbl ON c.row_idx = lbl.row_idx LEFT JOIN meta ON c.row_idx = meta.row_idx"""


@query(
    " UNION ALL ".join(
        f"SELECT * FROM ({_chosen_sql(how, order)})"
        for how, order in (("good", "value DESC, row_idx"), ("bad", "value, row_idx"), ("random", "md5(concat_ws('-', '1000', row_idx::VARCHAR)), row_idx"))
    )
)
def examples_chosen(spark, d):
    """Reports of 12 queries each: the most improved by a second run, the most harmed, and random ones, with their labels and
    metadata."""
    lbl = cells(spark, d, "data_lbl")
    rank = lambda r: metrics.per_query(r, lbl, (10,)).filter("metric = 'MRR'").select("row_idx", "value")
    scores = cut(metrics.compare(rank(run(spark, d)), rank(cells(spark, d, "data_neg"))).select("row_idx", F.round("difference", 9).alias("value")))
    sections = {"labels": (lbl, info(spark, d, "label_raw"), 3), "metadata": (cells(spark, d, "data_meta"), info(spark, d, "meta_info"), 5)}
    parts = [ret.example_sets(cut(ret.choose_rows(scores, how, 12)), info(spark, d, "data_info"), sections).select(F.lit(how).alias("how"), "row_idx", "example") for how in ("good", "bad", "random")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    f"""SELECT row_idx, to_json({{'query': any_value(q.text), 'labels': list({{'label': l.text, 'score': printf('%.4f', score)}} ORDER BY score DESC, col_idx)}})::VARCHAR AS example
    FROM (SELECT * FROM {LBL} QUALIFY {_RANK} <= 3) JOIN {info_sql('data_info')} q ON row_idx = q.idx JOIN {info_sql('label_raw')} l ON col_idx = l.idx WHERE q.text IS NOT NULL AND l.text IS NOT NULL GROUP BY row_idx"""
)
def examples(spark, d):
    """Queries with their three best labels, as JSON; all queries of the relation."""
    r = cells(spark, d, "data_lbl")
    named = info(spark, d, "data_info").filter("text IS NOT NULL"), info(spark, d, "label_raw").filter("text IS NOT NULL")
    return ret.examples(r, *named, rel.non_empty(r), 3)


@query(f"SELECT 'fact' AS corpus, row_idx, col_idx, {_RANK} AS rank FROM {META} UNION ALL SELECT 'label', row_idx, col_idx, {_RANK} FROM {LBL}")
def prediction_by_corpus(spark, d):
    """Results over two corpora, each with its own table, ranked and in one."""
    parts = [rel.ranked(cells(spark, d, t)).select(F.lit(c).alias("corpus"), "row_idx", "col_idx", F.col("rank").cast("bigint").alias("rank")) for c, t in (("fact", "data_meta"), ("label", "data_lbl"))]
    return parts[0].unionByName(parts[1])


@query(
    f"""SELECT p.row_idx, p.col_idx, CASE WHEN l.row_idx IS NULL THEN 0.0::DOUBLE ELSE 0.2::DOUBLE END AS value FROM (SELECT * FROM {_RUN} QUALIFY {_RANK} <= 5) p LEFT JOIN {LBL} l USING (row_idx, col_idx)
    WHERE p.row_idx IN (SELECT row_idx FROM {LBL})"""
)
def pointwise_precision(spark, d):
    """For each of the five best results whether it is relevant, as its part of the precision."""
    return metrics.pointwise_precision(run(spark, d), cells(spark, d, "data_lbl"), 5)


_TRIPLED = "(SELECT 'q' || row_idx AS qid, 'd' || col_idx AS did, round(score, 9) AS score FROM {r})"


@query(
    f"""WITH a AS {_TRIPLED.format(r=LBL)}, b AS (SELECT qid, did, CASE WHEN did LIKE '%7' THEN score + 1 ELSE score END AS score FROM {_TRIPLED.format(r=LBL)} WHERE did NOT LIKE '%5')
    SELECT (SELECT count(*) FROM a) AS n_made, (SELECT count(*) FROM b) AS n_wanted, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_made,
    (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_wanted, false AS identical, false AS pairs_identical
    UNION ALL SELECT count(*), count(*), 0, 0, true, true FROM a"""
)
def triple_audit(spark, d):
    """Judgements compared as triples of names and scores: with a changed copy, and with an equal one."""
    a = cells(spark, d, "data_lbl").select(F.concat(F.lit("q"), F.col("row_idx").cast("string")).alias("qid"), F.concat(F.lit("d"), F.col("col_idx").cast("string")).alias("did"), F.round("score", 9).alias("score"))
    b = a.filter(~F.col("did").endswith("5")).withColumn("score", F.when(F.col("did").endswith("7"), F.col("score") + 1).otherwise(F.col("score")))
    return lookup.audit_triples(a, b).unionByName(lookup.audit_triples(a, a.orderBy(F.desc("did"))))


@query("SELECT true AS same_order, true AS same_set UNION ALL SELECT false, true UNION ALL SELECT false, false")
def order_audit(spark, d):
    """Tables of entries compared by order and as sets: with itself, with two entries swapped, and with one left out."""
    a = info(spark, d, "data_info")
    ends = a.agg(F.min("idx"), F.max("idx")).first()
    swapped = a.withColumn("idx", F.when(F.col("idx") == ends[0], F.lit(ends[1])).when(F.col("idx") == ends[1], F.lit(ends[0])).otherwise(F.col("idx")))
    return lookup.audit_order(a, a).unionByName(lookup.audit_order(a, swapped)).unionByName(lookup.audit_order(a, a.filter(F.col("idx") != ends[0])))


@query(f"SELECT i.idx AS row_idx, count(*) AS n FROM {NEG} r JOIN {info_sql('label_raw')} l ON r.col_idx = l.idx JOIN {info_sql('data_info')} i ON r.row_idx = i.idx WHERE l.text <> '' GROUP BY i.idx")
def valid_run_sizes(spark, d):
    r = lookup.decode(cells(spark, d, "data_neg"), info(spark, d, "label_raw")).filter("text <> ''")
    return r.join(info(spark, d, "data_info").select(F.col("idx").alias("row_idx")), "row_idx").groupBy("row_idx").agg(F.count("*").alias("n"))
