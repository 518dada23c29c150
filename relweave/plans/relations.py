"""Queries of relation algebra: slices, filters, products, unions, ranks, counts and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.operators import indexing, lookup
from relweave.operators import relation as rel
from relweave.plans.common import LBL, META, NEG, ORDER, SUPPLY, cells, info, info_sql, order_parts, r6, rounded, rounded_sql, supply
from relweave.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_RANKED = "row_number() OVER (PARTITION BY row_idx ORDER BY score DESC, col_idx)"
_MINMAX = "SELECT row_idx, col_idx, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS score FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM {r} WINDOW w AS (PARTITION BY row_idx))"
_NQ = "(SELECT DISTINCT idx FROM data_info WHERE dataset = 'nq')"


def _top_sql(r: str, k: int) -> str:
    return f"(SELECT row_idx, col_idx, score FROM {r} QUALIFY {_RANKED} <= {k})"


# --- slices and filters


@query(rounded_sql(f"SELECT n.new AS row_idx, col_idx, score FROM {LBL} r JOIN (SELECT idx, row_number() OVER (ORDER BY idx DESC) - 1 AS new FROM {_NQ}) n ON r.row_idx = n.idx"))
def slice_rows(spark, d):
    """Rows by a list (the queries of one dataset, last first), renumbered in its order."""
    listed = table(spark, d, "data_info").filter("dataset = 'nq'").select((-F.col("idx")).alias("minus")).distinct()
    index = indexing.dense_index(listed, ["minus"], "new_idx").select((-F.col("minus")).alias("old_idx"), "new_idx")
    return rounded(rel.slice_rows(cells(spark, d, "data_lbl"), index))


@query(rounded_sql(f"SELECT row_idx, n.new AS col_idx, score FROM {NEG} r JOIN (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS new FROM (SELECT DISTINCT idx FROM label_raw WHERE dataset = 'fever')) n ON r.col_idx = n.idx"))
def slice_cols(spark, d):
    listed = table(spark, d, "label_raw").filter("dataset = 'fever'").select(F.col("idx").alias("old_idx")).distinct()
    return rounded(rel.slice_cols(cells(spark, d, "data_neg"), indexing.dense_index(listed, ["old_idx"], "new_idx")))


@query(f"SELECT row_idx, col_idx - 1000 AS col_idx, score FROM {META} WHERE col_idx >= 1000")
def slice_cols_from(spark, d):
    return rel.cols_from(cells(spark, d, "data_meta"), 1000)


@query(f"SELECT a.row_idx, b.n_cols FROM (SELECT DISTINCT row_idx FROM {LBL}) a, (SELECT count(DISTINCT col_idx) AS n_cols FROM {LBL}) b")
def non_empty_rows(spark, d):
    r = cells(spark, d, "data_lbl")
    return rel.non_empty(r).crossJoin(F.broadcast(rel.non_empty(r, "col_idx").agg(F.count("*").alias("n_cols"))))  # one row


@query(f"SELECT row_idx, col_idx, score FROM {LBL} WHERE score >= 0.8")
def threshold(spark, d):
    return rel.threshold(cells(spark, d, "data_lbl"), 0.8)


@query(rounded_sql(f"SELECT * FROM ({_MINMAX.format(r=META)}) WHERE score <> 0"))
def drop_zeros(spark, d):
    return rounded(rel.drop_zeros(rel.row_minmax(cells(spark, d, "data_meta"), drop_zero=False)))


@query(rounded_sql(f"SELECT a.col_idx AS row_idx, b.col_idx, sum(a.score * b.score) AS score FROM {LBL} a JOIN {LBL} b ON a.row_idx = b.row_idx WHERE a.col_idx <> b.col_idx GROUP BY ALL"))
def cooccurrence_off_diagonal(spark, d):
    return rounded(rel.drop_diagonal(rel.cooccurrence(cells(spark, d, "data_lbl"))))


@query(
    f"""WITH r AS {META} SELECT row_idx, col_idx, score FROM r WHERE row_idx NOT IN (SELECT row_idx FROM r GROUP BY row_idx HAVING count(*) > 6)
    AND col_idx NOT IN (SELECT col_idx FROM r GROUP BY col_idx HAVING count(*) > 4)"""
)
def head_prune(spark, d):
    return rel.prune_heads(cells(spark, d, "data_meta"), 6, 4)


@query(f"SELECT row_idx, col_idx, 1.0::DOUBLE AS score FROM {NEG}")
def binarise(spark, d):
    return rel.binarise(cells(spark, d, "data_neg"))


@query(rounded_sql(f"SELECT row_idx, col_idx, score * 0.05 AS score FROM {LBL}"))
def scale(spark, d):
    return rounded(rel.scale(cells(spark, d, "data_lbl"), 0.05))


@query("SELECT dataset, count(DISTINCT idx) AS n FROM label_raw WHERE dataset NOT IN ('quora', 'arguana') GROUP BY dataset")
def exclude_datasets(spark, d):
    rows = table(spark, d, "label_raw").filter(~F.col("dataset").isin("quora", "arguana"))
    return rows.groupBy("dataset").agg(F.count_distinct("idx").alias("n"))


@query("SELECT dataset, count(*) AS n, min(identifier) AS first_id FROM (SELECT DISTINCT dataset, identifier FROM label_raw WHERE dataset IS NOT NULL AND identifier IS NOT NULL) GROUP BY dataset")
def prefix_partition(spark, d):
    from relweave.functions.text import namespaced, split_first

    ids = table(spark, d, "label_raw").dropna(subset=["dataset", "identifier"]).select(namespaced(F.col("dataset"), F.col("identifier")).alias("id")).distinct()
    parts = split_first(F.col("id"), "_")
    return ids.groupBy(parts[0].alias("dataset")).agg(F.count("*").alias("n"), F.min(parts[1]).alias("first_id"))


# --- products


@query(rounded_sql(f"SELECT m.col_idx AS row_idx, l.col_idx, sum(m.score * l.score) AS score FROM {META} m JOIN {LBL} l ON m.row_idx = l.row_idx GROUP BY ALL"))
def spgemm(spark, d):
    """Metadata by label, through the queries that they share."""
    return rounded(rel.multiply(rel.transpose(cells(spark, d, "data_meta")), cells(spark, d, "data_lbl")))


@query(rounded_sql(f"SELECT a.row_idx, b.row_idx AS col_idx, sum(a.score * b.score) AS score FROM {SUPPLY} a JOIN {SUPPLY} b ON a.col_idx = b.col_idx GROUP BY ALL"))
def spgemm_supplier_cooccurrence(spark, d):
    return rounded(rel.cooccurrence(rel.transpose(supply(spark, d))))


@query(f"SELECT col_idx AS row_idx, row_idx AS col_idx, score FROM {NEG}")
def transpose(spark, d):
    return rel.transpose(cells(spark, d, "data_neg"))


_PAIRS = f"(SELECT a.col_idx AS row_idx, b.col_idx, sum(a.score * b.score) AS score FROM {LBL} a JOIN {LBL} b ON a.row_idx = b.row_idx WHERE a.col_idx <= b.col_idx GROUP BY ALL)"


def _upper(spark, d):
    return rel.cooccurrence(cells(spark, d, "data_lbl")).filter("row_idx <= col_idx")


@query(rounded_sql(f"WITH e AS {_PAIRS} SELECT row_idx, col_idx, sum(score) AS score FROM (SELECT * FROM e UNION ALL SELECT col_idx, row_idx, score FROM e) GROUP BY ALL"))
def symmetrise_sum(spark, d):
    return rounded(rel.symmetrise_sum(_upper(spark, d)))


@query(rounded_sql(f"WITH e AS {_PAIRS} SELECT * FROM e UNION ALL SELECT col_idx, row_idx, score FROM e x WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.row_idx = x.col_idx AND y.col_idx = x.row_idx)"))
def symmetrise_missing(spark, d):
    return rounded(rel.symmetrise_missing(_upper(spark, d)))


@query(rounded_sql(f"SELECT m.col_idx AS row_idx, l.col_idx, sum(m.score * l.score) / count(*) AS score FROM {META} m JOIN {LBL} l ON m.row_idx = l.row_idx GROUP BY ALL"))
def mean_product(spark, d):
    return rounded(rel.mean_product(rel.transpose(cells(spark, d, "data_meta")), cells(spark, d, "data_lbl")))


@query(rounded_sql(f"SELECT row_idx, col_idx, score / count(*) OVER (PARTITION BY col_idx) AS score FROM {META}"))
def col_idf_scale(spark, d):
    return rounded(rel.column_scale_by_count(cells(spark, d, "data_meta")))


@query(rounded_sql(f"SELECT row_idx, col_idx, score / t AS score FROM (SELECT *, sum(score) OVER (PARTITION BY row_idx) AS t FROM {NEG}) WHERE t <> 0"))
def row_normalise(spark, d):
    return rounded(rel.row_normalise(cells(spark, d, "data_neg")))


@query(rounded_sql(f"SELECT * FROM ({_MINMAX.format(r=NEG)}) WHERE score <> 0"))
def row_minmax(spark, d):
    return rounded(rel.row_minmax(cells(spark, d, "data_neg")))


@query(rounded_sql(f"SELECT row_idx, col_idx, score FROM (SELECT * FROM ({_MINMAX.format(r=META)}) WHERE score <> 0) QUALIFY {_RANKED} <= 5"))
def topk_after_minmax(spark, d):
    return rounded(rel.top_k_normalised(cells(spark, d, "data_meta"), 5))


@query("SELECT o_custkey AS row_idx, l_partkey AS col_idx, count(*)::DOUBLE AS score FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def relation_from_lists(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))  # an order has a handful of lines
    lists = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "parts")
    return rel.from_lists(lists, "o_custkey", "parts")


@query(f"SELECT col_idx, round(avg(score) + 1e-10, 6) AS score FROM {META} GROUP BY col_idx")
def mean_by_column(spark, d):
    return rel.mean_by_column(cells(spark, d, "data_meta")).select("col_idx", r6("score"))


# --- unions


@query(
    """WITH s AS (SELECT dataset, count(DISTINCT idx) AS n FROM data_info WHERE dataset IS NOT NULL GROUP BY dataset),
    o AS (SELECT dataset, coalesce(sum(n) OVER (ORDER BY dataset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s),
    p AS (SELECT DISTINCT dataset, idx FROM data_info WHERE dataset IS NOT NULL)"""
    + f" SELECT (r.row_idx + off)::BIGINT AS row_idx, (r.col_idx + 10 * off)::BIGINT AS col_idx, score FROM {LBL} r JOIN p ON r.row_idx = p.idx JOIN o USING (dataset)"
)
def union_with_offset(spark, d):
    """The relations of all datasets, stacked by name; each moves by the sizes of those before."""
    of = table(spark, d, "data_info").filter("dataset IS NOT NULL").select("dataset", F.col("idx").alias("row_idx")).distinct()
    sizes = of.groupBy("dataset").agg(F.count("*").alias("n_rows")).withColumn("n_cols", F.col("n_rows") * 10)
    return rel.union_with_offsets(cells(spark, d, "data_lbl").join(of, "row_idx"), sizes, "dataset")


@query(rounded_sql(f"SELECT row_idx, col_idx, sum(score) AS score FROM (SELECT * FROM {LBL} UNION ALL SELECT * FROM {NEG}) GROUP BY ALL"))
def union_sum(spark, d):
    return rounded(rel.add(cells(spark, d, "data_lbl"), cells(spark, d, "data_neg")))


@query(f"SELECT DISTINCT row_idx, col_idx, 1.0::DOUBLE AS score FROM (SELECT * FROM {LBL} UNION ALL SELECT * FROM {NEG})")
def union_distinct(spark, d):
    return rel.union_distinct(cells(spark, d, "data_lbl"), cells(spark, d, "data_neg"))


@query(f"SELECT row_idx, col_idx FROM {LBL} INTERSECT SELECT row_idx, col_idx FROM {NEG}")
def intersect(spark, d):
    return rel.intersect_cells(cells(spark, d, "data_lbl"), cells(spark, d, "data_neg"))


@query("SELECT DISTINCT text FROM label_raw WHERE text IS NOT NULL")
def distinct_texts(spark, d):
    return table(spark, d, "label_raw").filter("text IS NOT NULL").select("text").distinct()


@query("SELECT 'label' AS part, count(*) AS n FROM label_raw UNION ALL SELECT 'test', count(*) FROM test_raw UNION ALL SELECT 'train', count(*) FROM data_info")
def concat_datasets(spark, d):
    parts = [table(spark, d, t).select(F.lit(p).alias("part")) for p, t in (("label", "label_raw"), ("test", "test_raw"), ("train", "data_info"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("part").agg(F.count("*").alias("n"))


@query(f"WITH r AS {SUPPLY}, n AS (SELECT max(s_suppkey) + 1 AS n FROM supplier) SELECT row_idx, (col_idx + n)::BIGINT AS col_idx, score FROM r, n UNION ALL SELECT (col_idx + n)::BIGINT, row_idx, score FROM r, n")
def block_matrix(spark, d):
    """[[0, R], [R', 0]] of suppliers and parts."""
    r = supply(spark, d)
    n = table(spark, d, "supplier").agg(F.max("s_suppkey") + 1).first()[0]
    m = table(spark, d, "part").agg(F.max("p_partkey") + 1).first()[0]
    return rel.block([[None, r], [rel.transpose(r), None]], [n, m], [n, m])


@query("SELECT DISTINCT concat_ws('_', replace(dataset, '/', '-'), identifier) AS identifier FROM label_raw")
def namespaced_ids(spark, d):
    from relweave.functions.text import namespaced

    return table(spark, d, "label_raw").select(namespaced(F.col("dataset"), F.col("identifier")).alias("identifier")).distinct()


# --- ranks and windows


@query(_top_sql(NEG, 10)[1:-1])
def retain_topk(spark, d):
    return rel.top_k(cells(spark, d, "data_neg"), 10)


@query(f"SELECT row_idx, col_idx, round(score + 1e-10, 6) AS score FROM {ORDER} QUALIFY {_RANKED} <= 3")
def retain_topk_orders(spark, d):
    return rounded(rel.top_k(order_parts(spark, d), 3))


@query(f"SELECT row_idx, col_idx, score FROM {NEG} ORDER BY score DESC, row_idx, col_idx LIMIT 25")
def topk_global(spark, d):
    """The report of the best cells of all."""
    return cells(spark, d, "data_neg").orderBy(F.desc("score"), "row_idx", "col_idx").limit(25)


@query(f"SELECT row_idx, string_agg(col_idx::VARCHAR, ',' ORDER BY score DESC, col_idx) AS cols FROM {LBL} GROUP BY row_idx")
def row_display(spark, d):
    return rel.row_lists(cells(spark, d, "data_lbl")).select("row_idx", F.array_join(F.transform("cells", lambda c: c["col_idx"].cast("string")), ",").alias("cols"))


@query(f"SELECT row_idx, col_idx, score FROM {NEG} QUALIFY {_RANKED} BETWEEN 4 AND 12")
def rank_band(spark, d):
    return rel.rank_band(cells(spark, d, "data_neg"), 3, 27, 9)


@query("SELECT max(identifier) AS latest FROM test_raw")
def latest_name(spark, d):
    return table(spark, d, "test_raw").agg(F.max("identifier").alias("latest"))


@query("SELECT dataset, n, (sum(n) OVER (ORDER BY dataset))::BIGINT AS running FROM (SELECT dataset, count(DISTINCT identifier) AS n FROM label_raw WHERE dataset IS NOT NULL GROUP BY dataset)")
def running_sizes(spark, d):
    from pyspark.sql import Window

    sizes = table(spark, d, "label_raw").filter("dataset IS NOT NULL").groupBy("dataset").agg(F.count_distinct("identifier").alias("n"))
    return sizes.withColumn("running", F.sum("n").over(Window.orderBy("dataset").rowsBetween(Window.unboundedPreceding, 0)))  # a row per dataset


# --- counts


@query(f"SELECT row_idx, count(*) AS n FROM {NEG} GROUP BY row_idx")
def row_counts(spark, d):
    return rel.counts(cells(spark, d, "data_neg"))


@query(f"SELECT col_idx, count(*) AS n FROM {META} GROUP BY col_idx")
def document_frequency(spark, d):
    return rel.counts(cells(spark, d, "data_meta"), "col_idx")


@query(f"SELECT col_idx, round(sum(score) + 1e-10, 6) AS total FROM {META} GROUP BY col_idx")
def column_sums(spark, d):
    return rel.sums(cells(spark, d, "data_meta"), "col_idx").select("col_idx", r6("total", "total"))


@query("SELECT row_idx, col_idx, round(sum(score) + 1e-10, 6) AS score FROM data_lbl WHERE row_idx IS NOT NULL AND col_idx IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY row_idx, col_idx")
def sum_duplicates(spark, d):
    return rounded(rel.relation(table(spark, d, "data_lbl"), merge="sum"))


@query(f"SELECT round((SELECT count(*) FROM {NEG}) / (SELECT count(DISTINCT idx) FROM data_info)::DOUBLE + 1e-10, 6) AS mean_cells")
def mean_row_count(spark, d):
    rows = table(spark, d, "data_info").select("idx").distinct().count()
    return rel.mean_count(cells(spark, d, "data_neg"), rows).select(r6("mean_cells", "mean_cells"))


@query("SELECT dataset, count(*) FILTER (text IS NULL OR text = '') AS n_empty, count(*) AS n FROM label_raw GROUP BY dataset")
def invalid_counts(spark, d):
    return table(spark, d, "label_raw").groupBy("dataset").agg(F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("n_empty"), F.count("*").alias("n"))


@query("SELECT dataset, string_agg(identifier, ' ' ORDER BY identifier) AS ids FROM (SELECT DISTINCT dataset, identifier FROM test_raw) GROUP BY dataset")
def group_to_list(spark, d):
    rows = table(spark, d, "test_raw").select("dataset", "identifier").distinct()
    return rows.groupBy("dataset").agg(F.array_join(F.array_sort(F.collect_list("identifier")), " ").alias("ids"))


# --- samples and artificial relations

_H = "md5(concat_ws('-', '{seed}', {cols}))"


@query(f"SELECT idx, identifier FROM (SELECT DISTINCT idx, identifier FROM label_raw) ORDER BY {_H.format(seed=100, cols='idx::VARCHAR')}, idx LIMIT 50")
def sample_permutation(spark, d):
    """A sampling operator: 50 rows in hash order."""
    return indexing.sample_rows(info(spark, d, "label_raw").select("idx", "identifier"), "idx", 50, 100)


@query(f"SELECT idx, identifier FROM (SELECT DISTINCT idx, identifier FROM label_raw) WHERE ('0x' || substr({_H.format(seed=7, cols='idx::VARCHAR')}, 1, 8))::BIGINT < {int(0.1 * 16**8)}")
def sample_fraction(spark, d):
    return indexing.sample_share(info(spark, d, "label_raw").select("idx", "identifier"), "idx", 0.1, 7)


@query(f"SELECT row_idx, col_idx, score FROM {META} QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY {_H.format(seed=3, cols='row_idx::VARCHAR, col_idx::VARCHAR')}, col_idx) <= 2")
def sample_per_row(spark, d):
    return indexing.sample_per_group(cells(spark, d, "data_meta"), "row_idx", "col_idx", 2, 3)


@query(
    f"""WITH s AS (SELECT row_idx, col_idx, row_number() OVER (PARTITION BY row_idx ORDER BY {_H.format(seed=3, cols='row_idx::VARCHAR, col_idx::VARCHAR')}, col_idx) AS r, least(6, count(*) OVER (PARTITION BY row_idx)) AS n
      FROM {META} QUALIFY r <= 6) SELECT row_idx, col_idx, count(*) AS n FROM s, unnest(range(0, 6)) AS t(k) WHERE r + k * n <= 6 GROUP BY ALL"""
)
def sample_oversampled(spark, d):
    """Six cells of every row; rows of fewer repeat theirs."""
    return indexing.sample_per_group(cells(spark, d, "data_meta"), "row_idx", "col_idx", 6, 3, oversample=True).groupBy("row_idx", "col_idx").agg(F.count("*").alias("n"))


@query(f"SELECT idx, dataset FROM (SELECT DISTINCT idx, dataset FROM label_raw WHERE dataset IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY {_H.format(seed=8, cols='dataset, idx::VARCHAR')}, idx) <= 10")
def sample_per_dataset(spark, d):
    """A sampling operator: ten passages of every dataset."""
    rows = table(spark, d, "label_raw").filter("dataset IS NOT NULL").select("idx", "dataset").distinct()
    return indexing.sample_per_group(rows, "dataset", "idx", 10, 8)


@query(f"SELECT idx, CASE WHEN row_number() OVER (ORDER BY {_H.format(seed=12, cols='idx::VARCHAR')}, idx) <= 200 THEN 'test' ELSE 'train' END AS part FROM (SELECT DISTINCT idx FROM data_info)")
def train_test_split(spark, d):
    return indexing.split_rows(table(spark, d, "data_info").select("idx").distinct(), "idx", 200, 12)


@query(
    f"""WITH r AS {LBL}, a AS (SELECT row_idx, row_number() OVER (ORDER BY {_H.format(seed=5, cols='row_idx::VARCHAR')}, row_idx) AS p FROM (SELECT DISTINCT row_idx FROM r)),
    b AS (SELECT row_idx AS new, row_number() OVER (ORDER BY row_idx) AS p FROM (SELECT DISTINCT row_idx FROM r))
    SELECT b.new AS row_idx, r.col_idx, r.score FROM r JOIN a USING (row_idx) JOIN b USING (p)"""
)
def shuffled_relation(spark, d):
    return indexing.permuted_rows(cells(spark, d, "data_lbl"), 5)


@query(
    f"""SELECT row_idx, ('0x' || substr(md5(concat_ws('-', '9', row_idx::VARCHAR, k::VARCHAR)), 1, 12))::BIGINT % 4000 AS col_idx, count(*)::DOUBLE AS score
    FROM (SELECT DISTINCT row_idx FROM {LBL}), unnest(range(1, 6)) AS t(k) GROUP BY ALL"""
)
def random_relation(spark, d):
    return indexing.random_relation(rel.non_empty(cells(spark, d, "data_lbl")), 4000, 5, 9)


@query(f"SELECT DISTINCT row_idx, 0::BIGINT AS col_idx, 1.0::DOUBLE AS score FROM {LBL}")
def constant_relation(spark, d):
    return indexing.constant_relation(cells(spark, d, "data_lbl"))


# --- joins


@query(f"SELECT r.row_idx, r.col_idx, r.score, i.identifier, i.text FROM {META} r JOIN {info_sql('meta_info')} i ON r.col_idx = i.idx")
def index_decode(spark, d):
    return lookup.decode(cells(spark, d, "data_meta"), info(spark, d, "meta_info"))


@query(f"SELECT a.idx, a.text AS left_text, b.text AS right_text FROM {info_sql('data_info')} a JOIN {info_sql('label_raw')} b USING (idx)")
def positional_zip(spark, d):
    return lookup.zip_tables(info(spark, d, "data_info"), info(spark, d, "label_raw"))


@query("SELECT v.vec_id, v.identifier, l.idx FROM (SELECT DISTINCT vec_id, identifier FROM text_vectors) v JOIN (SELECT identifier, max(idx) AS idx FROM label_raw GROUP BY identifier) l USING (identifier)")
def id_encode(spark, d):
    vectors = table(spark, d, "text_vectors").select("vec_id", "identifier").distinct()
    return lookup.encode(vectors, info(spark, d, "label_raw"), "identifier", missing="drop").select("vec_id", "identifier", "idx")


@query("SELECT DISTINCT vec_id, identifier FROM text_vectors v WHERE NOT EXISTS (SELECT 1 FROM label_raw l WHERE l.identifier = v.identifier)")
def missing_ids(spark, d):
    vectors = table(spark, d, "text_vectors").select("vec_id", "identifier").distinct()
    return lookup.missing_keys(vectors, info(spark, d, "label_raw"), "identifier").select("vec_id", "identifier")


@query(f"SELECT i.idx, i.identifier, coalesce(n, 0) AS n_labels FROM {info_sql('data_info')} i LEFT JOIN (SELECT row_idx, count(*) AS n FROM {LBL} GROUP BY row_idx) r ON i.idx = r.row_idx")
def lookup_with_default(spark, d):
    lists = rel.row_lists(cells(spark, d, "data_lbl")).select(F.col("row_idx").alias("idx"), "cells")
    return lookup.lookup_lists(info(spark, d, "data_info"), lists, "cells").select("idx", "identifier", F.size("cells").cast("bigint").alias("n_labels"))


@query(
    f"""SELECT t.identifier, m.new IS NOT NULL AS found, CASE WHEN m.new IS NOT NULL THEN m.new ELSE t.text END AS replaced
    FROM {info_sql('test_raw')} t LEFT JOIN (SELECT text, arg_max(identifier, idx) AS new FROM {info_sql('data_info')} WHERE text IS NOT NULL GROUP BY text) m ON t.text = m.text"""
)
def text_equality_join(spark, d):
    return lookup.replace_by_text(info(spark, d, "test_raw"), info(spark, d, "data_info"), "identifier").select("identifier", "found", "replaced")


@query(f"SELECT row_idx, col_idx, score FROM {NEG} n WHERE NOT EXISTS (SELECT 1 FROM {LBL} l WHERE l.row_idx = n.row_idx AND l.col_idx = n.col_idx)")
def anti_positives(spark, d):
    return rel.subtract_cells(cells(spark, d, "data_neg"), cells(spark, d, "data_lbl"))


@query(f"SELECT idx, identifier FROM {info_sql('label_raw')} WHERE idx NOT IN (SELECT col_idx FROM {LBL})")
def anti_unlabelled(spark, d):
    used = rel.non_empty(cells(spark, d, "data_lbl"), "col_idx").withColumnRenamed("col_idx", "idx")
    return info(spark, d, "label_raw").select("idx", "identifier").join(used, "idx", "left_anti")


@query(f"SELECT row_idx, col_idx, score FROM {NEG} WHERE row_idx IN (SELECT row_idx FROM {LBL}) AND col_idx IN (SELECT idx FROM label_raw WHERE text <> '')")
def semi_existing_nodes(spark, d):
    r = cells(spark, d, "data_neg").join(rel.non_empty(cells(spark, d, "data_lbl")), "row_idx", "left_semi")
    return r.join(info(spark, d, "label_raw").filter("text <> ''").select(F.col("idx").alias("col_idx")), "col_idx", "left_semi").select("row_idx", "col_idx", "score")


@query(
    f"""WITH r AS {LBL} SELECT a.row_idx, a.col_idx, b.row_idx AS other_row FROM r a JOIN r b ON a.col_idx = b.col_idx AND a.row_idx <> b.row_idx
    QUALIFY row_number() OVER (PARTITION BY a.row_idx, a.col_idx ORDER BY b.row_idx) <= 3"""
)
def self_join_by_item(spark, d):
    return lookup.neighbours_by_item(cells(spark, d, "data_lbl"), 3)


@query(
    """WITH a AS (SELECT identifier, max(row(idx, text)) AS v FROM (SELECT DISTINCT 'x' || idx AS identifier, idx, text FROM data_info) GROUP BY identifier),
    b AS (SELECT identifier, max(row(idx, text)) AS v FROM (SELECT DISTINCT 'x' || (idx * 2) AS identifier, idx * 2 AS idx, text FROM data_info) GROUP BY identifier)
    SELECT count(*) FILTER (b.v IS NULL) AS only_made, count(*) FILTER (a.v IS NULL) AS only_wanted, count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL) AS shared,
    count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL AND a.v[2] IS DISTINCT FROM b.v[2]) AS other_text, count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL AND a.v[1] IS DISTINCT FROM b.v[1]) AS other_idx
    FROM a FULL JOIN b USING (identifier)"""
)
def dataset_audit(spark, d):
    base = info(spark, d, "data_info")
    made = base.select(F.concat(F.lit("x"), F.col("idx").cast("string")).alias("identifier"), "idx", "text")
    wanted = base.select(F.concat(F.lit("x"), (F.col("idx") * 2).cast("string")).alias("identifier"), (F.col("idx") * 2).alias("idx"), "text")
    return lookup.audit_tables(made, wanted)
