"""Queries that write and read files: what comes back must be what was given."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.functions import text as tx
from relweave.functions import vectors
from relweave.operators import metrics
from relweave.operators import relation as rel
from relweave.plans.common import LBL, META, NEG, cells, info, info_sql, r6
from relweave.plans.rankings import _HITS, _metric_sql, run, truth
from relweave.session import scratch, table, write_text
from relweave.sources import readers, writers

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_NUMBER = "row_number() OVER (ORDER BY idx) - 1 AS idx"
_BLANKED = "regexp_replace(text, '[\\x00-\\x1F\\x7F]', ' ', 'g')"


@query(f"SELECT {_NUMBER}, identifier, {_BLANKED} || '->' || idx AS text FROM {info_sql('data_info')} WHERE text IS NOT NULL")
def scan_txt(spark, d):
    """Lines of identifier and text, split at the first separator only."""
    path = scratch(spark) + ".txt"
    rows = info(spark, d, "data_info").filter("text IS NOT NULL").repartitionByRange("idx").sortWithinPartitions("idx")
    rows.select(F.concat_ws("->", "identifier", tx.blank_controls(F.col("text")), F.col("idx").cast("string"))).write.text(path)
    return readers.read_info(spark, path)


@query(f"SELECT {_NUMBER}, identifier, coalesce(text, '') AS text FROM {info_sql('label_raw')}")
def scan_csv(spark, d):
    """Texts with separators, quotes and line breaks; a null text comes back empty."""
    path = scratch(spark) + ".csv"
    writers.write_info(info(spark, d, "label_raw"), path)
    return readers.read_info(spark, path)


@query("SELECT row_number() OVER (ORDER BY rec_no) - 1 AS idx, rec_no::VARCHAR AS identifier, replace(replace(rec, chr(13), ' '), chr(0), ' ') AS text FROM label_records")
def scan_csv_lines(spark, d):
    """Raw records as texts, quotes and line breaks and all, over files that may be split anywhere."""
    path = scratch(spark) + ".csv"
    plain = F.translate("rec", "\r\x00", "  ")
    writers.write_info(table(spark, d, "label_records").select(F.col("rec_no").alias("idx"), F.col("rec_no").cast("string").alias("identifier"), plain.alias("text")), path)
    return readers.read_csv(spark, path)


@query(f"SELECT {_NUMBER}, identifier, coalesce({_BLANKED}, '') AS text FROM {info_sql('label_raw')}")
def scan_tsv_clean(spark, d):
    """Tab-separated, with control characters blanked."""
    path = scratch(spark) + ".tsv"
    writers.write_info(info(spark, d, "label_raw"), path, "\t", clean=True)
    return readers.read_info(spark, path)


@query(f"SELECT row_idx, col_idx, score FROM {LBL}")
def scan_relation(spark, d):
    path = scratch(spark)
    writers.write_relation(cells(spark, d, "data_lbl"), path)
    return readers.read_relation(spark, path)


@query("SELECT coalesce(text, '') AS text, count(*) AS n FROM (SELECT DISTINCT identifier, text FROM test_raw) GROUP BY ALL")
def scan_queries(spark, d):
    """The text column is the first of the file that has one of the usual names, in any case, not the most usual name."""
    path = scratch(spark)
    rows = table(spark, d, "test_raw").select("identifier", "text").distinct()
    writers.write_table(rows.select("identifier", F.col("text").alias("Raw_Text"), F.lit("other").alias("query")), path)
    return readers.read_queries(spark, path).select(F.coalesce("text", F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("n"))


@query(f"SELECT row_idx::VARCHAR AS row_idx, col_idx::VARCHAR AS col_idx FROM {META}")
def scan_shards(spark, d):
    """A table in several files, of a folder that also has other files."""
    folder = scratch(spark)
    write_text(spark, f"{folder}/other.txt", "row_idx\tcol_idx\n1\t2\n")
    writers.write_table(cells(spark, d, "data_meta").select("row_idx", "col_idx").repartition(5), f"{folder}/shards")
    return readers.read_shards(spark, f"{folder}/shards", "part-")


@query(f"SELECT row_idx, col_idx, score FROM {LBL} UNION ALL SELECT row_idx, col_idx, score * 2 FROM {LBL}")
def scan_cached(spark, d):
    """A table that is made once for each configuration."""
    folder, r = scratch(spark), cells(spark, d, "data_lbl")
    make = lambda by: readers.cached(spark, "scaled", lambda: rel.scale(r, by), folder, {"by": by})
    once = make(1.0)
    again = readers.cached(spark, "scaled", lambda: r.limit(0), folder, {"by": 1.0})  # is there already
    return again.unionByName(make(2.0)) if once.count() == again.count() else once


@query("SELECT vec_id::VARCHAR AS id, len(embedding) AS dims FROM embeddings")
def scan_vectors(spark, d):
    path, rows = scratch(spark), table(spark, d, "embeddings")
    rows.select(F.col("vec_id").cast("string").alias("id"), "embedding").write.parquet(path)
    return readers.read_vectors(spark, path, rows.count()).select("id", F.size("embedding").cast("bigint").alias("dims"))


@query("SELECT 'labels.csv' AS labels, 3::BIGINT AS top")
def scan_config(spark, d):
    """A configuration whose labels stand with the training paths."""
    path = scratch(spark) + ".json"
    writers.write_config(spark, path, "data", {"train": {"lbl_info": "labels.csv"}, "test": {}}, {"top": 3})
    config = readers.read_config(spark, path, "data")
    return spark.createDataFrame([(readers.label_info_path(config), config["parameters"]["top"])], "labels string, top bigint")


@query("SELECT DISTINCT dataset, replace(dataset, '/', '-') AS tag FROM test_raw WHERE dataset IS NOT NULL AND dataset NOT IN (SELECT min(dataset) FROM test_raw)")
def scan_datasets(spark, d):
    """All datasets but the first, with their tags."""
    names = sorted(r.dataset for r in table(spark, d, "test_raw").filter("dataset IS NOT NULL").select("dataset").distinct().collect())  # a row per dataset
    return spark.createDataFrame(readers.expand_datasets("all", names, tuple(names[:1])), "dataset string, tag string")


_HASHED = "md5(concat_ws('-', '4', row_idx::VARCHAR, col_idx::VARCHAR))"


@query(
    f"""WITH top AS (SELECT row_idx, col_idx FROM {META} QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY score DESC, col_idx) <= 4),
    train AS (SELECT row_idx, col_idx, row_number() OVER (PARTITION BY row_idx ORDER BY {_HASHED}, col_idx) AS r, least(3, count(*) OVER (PARTITION BY row_idx)) AS n FROM top QUALIFY r <= 3)
    SELECT 'train' AS part, row_idx, col_idx, count(*) AS n FROM train, unnest(range(0, 3)) AS t(k) WHERE r + k * n <= 3 GROUP BY ALL
    UNION ALL SELECT 'test', row_idx, col_idx, 1 FROM {META} QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY {_HASHED}, col_idx) <= 2"""
)
def scan_blocks(spark, d):
    """Train and test blocks by parameters of their own; the train block fills rows of few cells up by repetition."""
    parts = {p: {"meta": cells(spark, d, "data_meta")} for p in ("train", "test")}
    blocks = readers.build_blocks(parts, {"train": {"top": {"meta": 4}, "samples": {"meta": 3}, "oversample": True}, "test": {"samples": {"meta": 2}}}, 4)
    counted = [b["meta"].groupBy("row_idx", "col_idx").agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "row_idx", "col_idx", "n") for p, b in blocks.items()]
    return counted[0].unionByName(counted[1])


@query(f"SELECT 'a/b' AS dataset, {_NUMBER}, identifier, coalesce(text, '') AS text FROM {info_sql('test_raw')}")
def early_fusion(spark, d):
    """Inputs of the datasets that have a file; one has none."""
    folder = scratch(spark)
    writers.write_info(info(spark, d, "test_raw"), f"{folder}/a-b.csv")
    return readers.early_fusion_inputs(spark, ["a/b", "c"], folder + "/{dataset}.csv")[0]


@query(f"SELECT row_idx, string_agg(col_idx::VARCHAR, ',' ORDER BY col_idx) AS example FROM {LBL} GROUP BY row_idx")
def sink_examples(spark, d):
    path = scratch(spark)
    writers.write_examples(cells(spark, d, "data_lbl").groupBy("row_idx").agg(F.array_sort(F.collect_list("col_idx")).alias("cells")), path)
    return spark.read.schema("row_idx bigint, cells array<bigint>").json(path).select("row_idx", F.array_join(F.transform("cells", lambda c: c.cast("string")), ",").alias("example"))


@query(_metric_sql(_HITS) + "SELECT 'one' AS dataset, metric || '@' || k AS metric, round(avg(value) + 1e-10, 5) AS value FROM long GROUP BY ALL")
def sink_metrics(spark, d):
    """Metrics written per dataset, rounded to 5 places, and collated; one dataset has no file."""
    folder = scratch(spark)
    per = metrics.mean_metrics(metrics.per_query(run(spark, d), truth(spark, d), (1, 5, 10)))
    writers.write_metrics(per.withColumn("value", F.col("value") + 1e-10), f"{folder}/one.json")
    return writers.metrics_table(spark, writers.collate_metrics(spark, {"one": f"{folder}/one.json", "two": f"{folder}/two.json"}))


_RUN_NAMES = f"(SELECT 'trn-' || lpad(row_idx::VARCHAR, 9, '0') AS qid, 'lbl-' || lpad((col_idx * 2)::VARCHAR, 9, '0') AS did, score FROM {LBL})"


def _named_run(spark, d):
    name = lambda prefix, c: F.concat(F.lit(prefix), F.lpad(c.cast("string"), 9, "0"))
    return cells(spark, d, "data_lbl").select(name("trn-", F.col("row_idx")).alias("qid"), name("lbl-", F.col("col_idx") * 2).alias("did"), "score")


@query(
    f"""SELECT 'known' AS kind, q.idx AS row_idx, l.idx AS col_idx FROM {_RUN_NAMES} JOIN {info_sql('data_info')} q ON qid = q.identifier JOIN {info_sql('label_raw')} l ON did = l.identifier
    UNION ALL SELECT 'invalid', -1, (substr(did, 5))::BIGINT FROM {_RUN_NAMES} WHERE did NOT IN (SELECT identifier FROM label_raw)"""
)
def sink_run(spark, d):
    """A run by names as a relation, and the results whose label does not exist."""
    known, invalid = writers.run_to_relation(_named_run(spark, d), info(spark, d, "data_info"), info(spark, d, "label_raw"))
    rest = invalid.select(F.lit("invalid").alias("kind"), F.lit(-1).cast("bigint").alias("row_idx"), F.substring("did", 5, 9).cast("bigint").alias("col_idx"))
    return known.select(F.lit("known").alias("kind"), "row_idx", "col_idx").unionByName(rest)


@query(f"SELECT qid, string_agg(did || '=' || printf('%.4f', score), ' ' ORDER BY did) AS docs FROM {_RUN_NAMES} GROUP BY qid")
def nested_run(spark, d):
    pairs = F.array_sort(F.map_entries("docs"))
    return writers.nested_run(_named_run(spark, d)).select("qid", F.array_join(F.transform(pairs, lambda x: F.concat(x["key"], F.lit("="), tx.four_decimals(x["value"]))), " ").alias("docs"))


@query("SELECT row_idx, col_idx, round(CASE WHEN score::VARCHAR = 'nan' THEN 0.0::DOUBLE WHEN score < 0.5 THEN 0.0::DOUBLE ELSE score - 0.5::DOUBLE END + 1e-10, 6) AS score FROM data_neg WHERE score IS NOT NULL AND row_idx IS NOT NULL AND col_idx IS NOT NULL")
def non_negative(spark, d):
    """NaN and negative scores as 0, on the cells as they come."""
    return table(spark, d, "data_neg").filter("score IS NOT NULL AND row_idx IS NOT NULL AND col_idx IS NOT NULL").select("row_idx", "col_idx", r6(vectors.non_negative(F.col("score") - 0.5)))


@query(f"SELECT row_idx, col_idx, round(score * 2 + 1e-10, 6) AS score FROM {NEG}")
def sink_table(spark, d):
    path = scratch(spark)
    writers.write_table(rel.scale(cells(spark, d, "data_neg"), 2.0), path)
    back = spark.read.csv(path, header=True, sep="\t", schema="row_idx bigint, col_idx bigint, score double")
    return back.select("row_idx", "col_idx", r6("score"))
