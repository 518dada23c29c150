"""Named queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relweave.llm import knn, leakage, lookalike, mixing, mojibake, oracles, overlap
from relweave.llm.topn import top_n_per_group
from relweave.operators.retrieval import exact_search
from relweave.session import table

RELATIONS = ("data_lbl", "data_neg", "data_meta")
TOP_N = 5


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [top_n_per_group(table(spark, d, r), "row_idx", "col_idx", "score", TOP_N).select(F.lit(r).alias("rel"), "row_idx", "col_idx") for r in RELATIONS]
    return reduce(DataFrame.unionByName, parts)


def _p5_sql() -> str:
    part = """SELECT '{r}' AS rel, row_idx, col_idx FROM (
      SELECT row_idx, col_idx, row_number() OVER (PARTITION BY row_idx ORDER BY max(score) DESC, col_idx) AS rn
      FROM {r} WHERE row_idx IS NOT NULL AND col_idx IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
      GROUP BY row_idx, col_idx) WHERE rn <= 5"""
    return " UNION ALL ".join(part.format(r=r) for r in RELATIONS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, d, "data_info"), table(spark, d, "test_raw"), 0.65)


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "data_info"), table(spark, d, "test_raw"), 0.65)


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """The overlaps between classes of records with the same words, each named by its smallest identifier."""
    return overlap.cross_split_classes(table(spark, d, "data_info"), table(spark, d, "test_raw"), 0.65)[0]


def p2_members(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_classes(table(spark, d, "data_info"), table(spark, d, "test_raw"), 0.65)[1]


def p2_weighted_links(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_links(table(spark, d, "data_info"), table(spark, d, "test_raw"), 0.8, "idf").select("identifier", "n_links")


_P2_SQL = """
WITH a AS (SELECT DISTINCT identifier, list_sort(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS words FROM data_info WHERE regexp_matches(text, '[\\p{L}\\p{N}]')),
b AS (SELECT DISTINCT identifier, split, dataset, list_sort(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS words FROM test_raw WHERE regexp_matches(text, '[\\p{L}\\p{N}]')),
sa AS (SELECT words, count(*) AS size, row_number() OVER () AS l FROM a GROUP BY words),
sb AS (SELECT words, row_number() OVER () AS r FROM b GROUP BY words),
shared AS (SELECT x.l, y.r, count(*) AS n FROM (SELECT l, unnest(words) AS w FROM sa) x JOIN (SELECT r, unnest(words) AS w FROM sb) y ON x.w = y.w GROUP BY ALL),
close AS (SELECT sa.words AS lw, sb.words AS rw, sa.size FROM shared JOIN sa USING (l) JOIN sb USING (r) WHERE n * 100 >= 65 * (len(sa.words) + len(sb.words) - n))
"""

_P6_SQL = """
WITH iw AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda x: true) AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
ik AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 11], ' ') AS run FROM iw, unnest(range(1, greatest(len(w) - 10, 1))) AS t(k)),
dk AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 11], ' ') AS run FROM dw, unnest(range(1, greatest(len(w) - 10, 1))) AS t(k))
"""


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_looking_pairs(_label_and_test(spark, d))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.with_form(_label_and_test(spark, d), ["identifier"]).select("identifier", "form").distinct()


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_classes(_label_and_test(spark, d))


def _label_and_test(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "label_raw").select("identifier", "text").unionByName(table(spark, d, "test_raw").select("identifier", "text"))


def _p4_sql(rest: str) -> str:
    return oracles.look_sql("SELECT identifier, text FROM label_raw UNION SELECT identifier, text FROM test_raw", rest)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_runs(table(spark, d, "eval_items"), table(spark, d, "documents"), 12)


def p6_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "eval_items"), table(spark, d, "documents"))


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").select("item_id", "dataset", "split")
    found = p6_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return items.join(found, "item_id").select("item_id", "dataset", "split", "n_documents")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """Per wanted source: its documents, and whether its cap holds and its share is met."""
    report = p7_shares(spark, d)
    there = F.sum(F.when(F.col("n_rows") > 0, F.col("target_share")).otherwise(0.0)).over(Window.partitionBy())  # over the rows of mix_targets
    met = F.abs(F.col("reached_share") - F.col("target_share") / there) <= 0.01
    return report.select("source", "n_documents", (F.col("most_repeats") <= F.col("max_repeats")).alias("within_cap"), ((F.col("n_rows") == 0) | met).alias("share_met"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.found_documents(table(spark, d, "documents"))


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_documents(table(spark, d, "documents"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return knn.similar_pairs(table(spark, d, "text_vectors"), 0.85)


def p1_nearest(spark: SparkSession, d: str) -> DataFrame:
    return knn.nearest_vectors(table(spark, d, "text_vectors"))


def p1_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of the vectors whose id is divisible by 50: how many they are, how many neighbours they have by exact search, and
    whether ``p1_nearest`` has at least 95 of 100 of them."""
    rows = table(spark, d, "text_vectors").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"))
    exact = exact_search(rows.filter("idx % 50 = 0"), rows, 6, 64).filter("row_idx <> col_idx")
    first = F.row_number().over(Window.partitionBy("row_idx").orderBy(F.desc("score"), "col_idx"))
    exact = exact.withColumn("rank", first).filter("rank <= 5").select(F.col("row_idx").alias("vec_id"), F.col("col_idx").alias("neighbour"))
    both = exact.join(p1_nearest(spark, d).select("vec_id", "neighbour", F.lit(True).alias("found")), ["vec_id", "neighbour"], "left")
    return both.agg(F.count_distinct("vec_id").alias("n_queries"), F.count("*").alias("n_neighbours"), (F.count("found") >= 0.95 * F.count("*")).alias("enough"))


QUERIES = {
    "p1_found": p1_found, "p1_nearest": p1_nearest, "p1_recall": p1_recall,
    "p2_found": p2_found, "p2_report": p2_report, "p2_weighted_links": p2_weighted_links, "p2_classes": p2_classes, "p2_members": p2_members,
    "p4_found": p4_found, "p4_forms": p4_forms, "p4_classes": p4_classes,
    "p5_found": p5_found,
    "p6_found": p6_found, "p6_overlaps": p6_overlaps, "p6_items": p6_items,
    "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_check": p7_check,
    "p8_found": p8_found, "p8_restored": p8_restored,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {
        "p1_recall": """WITH g AS (SELECT vec_id FROM text_vectors WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id)
            SELECT count(*) AS n_queries, count(*) * least(5, (SELECT count(*) FROM g) - 1) AS n_neighbours, true AS enough FROM g WHERE vec_id % 50 = 0""",
        "p2_found": _P2_SQL + "SELECT DISTINCT a.identifier AS train_id, b.identifier AS test_id FROM close JOIN a ON a.words = lw JOIN b ON b.words = rw",
        "p2_report": _P2_SQL
        + """, per AS (SELECT rw, sum(size) AS pairs, sum(CASE WHEN lw = rw THEN size ELSE 0 END) AS equal FROM close GROUP BY rw)
            SELECT split, dataset, count(*) AS n_records, count(pairs) AS n_overlapping, coalesce(sum(pairs), 0)::BIGINT AS n_pairs, coalesce(sum(equal), 0)::BIGINT AS n_equal
            FROM b LEFT JOIN per ON b.words = rw GROUP BY split, dataset""",
        "p2_classes": _P2_SQL
        + """SELECT min(a.identifier) AS train_first, min(b.identifier) AS test_first, count(DISTINCT a.identifier) AS n_train, count(DISTINCT b.identifier) AS n_test
            FROM close JOIN a ON a.words = lw JOIN b ON b.words = rw GROUP BY lw, rw""",
        "p2_members": _P2_SQL
        + """SELECT DISTINCT 'train' AS side, identifier, min(identifier) OVER (PARTITION BY words) AS first FROM a
            UNION ALL SELECT DISTINCT 'test', identifier, min(identifier) OVER (PARTITION BY words) FROM b""",
        "p2_weighted_links": _P2_SQL
        + """, u AS (SELECT 0 AS side, l AS id, unnest(words) AS w FROM sa UNION ALL SELECT 1, r, unnest(words) FROM sb),
            weight AS (SELECT w, round(pow(ln(1 + (SELECT (SELECT count(*) FROM sa) + (SELECT count(*) FROM sb)) / count(*)::DOUBLE), 2) * 1000000)::BIGINT AS x FROM u GROUP BY w),
            norm AS (SELECT side, id, sqrt(sum(x)) AS n FROM u JOIN weight USING (w) GROUP BY side, id),
            dot AS (SELECT p.id AS l, q.id AS r, sum(x) AS d FROM u p JOIN u q ON p.w = q.w AND p.side = 0 AND q.side = 1 JOIN weight ON weight.w = p.w GROUP BY ALL),
            link AS (SELECT r, sum(size) AS n FROM dot JOIN norm x ON x.side = 0 AND x.id = l JOIN norm y ON y.side = 1 AND y.id = r JOIN sa USING (l) WHERE d / (x.n * y.n) >= 0.8 - 1e-9 GROUP BY r)
            SELECT b.identifier, coalesce(link.n, 0)::BIGINT AS n_links FROM b JOIN sb ON b.words = sb.words LEFT JOIN link USING (r)""",
        "p4_found": _p4_sql(
            """SELECT DISTINCT a.identifier AS id_a, b.identifier AS id_b FROM f a JOIN f b ON a.form = b.form
            WHERE a.text <> b.text AND a.identifier < b.identifier AND a.text <> '' AND b.text <> ''"""
        ),
        "p4_forms": _p4_sql("SELECT DISTINCT identifier, form FROM f"),
        "p4_classes": _p4_sql(", c AS (SELECT form, count(DISTINCT text) AS n_texts FROM f WHERE text <> '' GROUP BY form) SELECT DISTINCT identifier, md5(form) AS class_id, n_texts FROM f JOIN c USING (form) WHERE text <> ''"),
        "p5_found": _p5_sql(),
        "p6_found": _P6_SQL + "SELECT DISTINCT item_id, doc_id FROM ik JOIN dk USING (run)",
        "p6_overlaps": oracles.LEAK_SQL,
        "p7_check": """SELECT m.source, count(d.source) AS n_documents, true AS within_cap, true AS share_met FROM mix_targets m LEFT JOIN
            (SELECT lower(trim(source, ' ')) AS source FROM documents) d ON d.source = m.source GROUP BY m.source""",
        "p6_items": _P6_SQL + "SELECT item_id, dataset, split, count(DISTINCT doc_id) AS n_documents FROM ik JOIN dk USING (run) JOIN eval_items USING (item_id) GROUP BY ALL",
    }
