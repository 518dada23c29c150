"""Writers of info tables, relations, examples, metrics and configurations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.functions.text import blank_controls
from relweave.session import file_exists, read_text, write_text


#: Quotes are doubled, and blanks around a text stay.
_EXACT = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_relation(r: DataFrame, path: str) -> None:
    r.select("row_idx", "col_idx", "score").write.mode("overwrite").parquet(path)


def write_info(info: DataFrame, path: str, separator: str = ",", clean: bool = False) -> None:
    """(identifier, text) with a header, in the order of idx across the files; ``clean`` blanks control characters."""
    rows = info.repartitionByRange("idx").sortWithinPartitions("idx")
    text = blank_controls(F.col("text")) if clean else F.col("text")
    rows.select("identifier", text.alias("text")).write.mode("overwrite").csv(path, header=True, sep=separator, emptyValue="", **_EXACT)


def write_table(df: DataFrame, path: str, separator: str = "\t") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=separator, **_EXACT)


def write_examples(df: DataFrame, path: str) -> None:
    """One JSON object per line."""
    df.write.mode("overwrite").json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """(metric, k, value) as one JSON object {metric@k: value}, rounded to 5 places."""
    named = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("@", "metric", F.col("k").cast("string")), F.round("value", 5)))))
    text = metrics.agg(F.to_json(named).alias("m")).first()[0]  # a row per metric and cutoff
    write_text(metrics.sparkSession, path, json.dumps(json.loads(text), indent=4))


def collate_metrics(spark: SparkSession, paths: dict[str, str]) -> dict[str, dict[str, float]]:
    """The metric files of several datasets in one; files that are missing are left out."""
    return {dataset: json.loads(read_text(spark, path)) for dataset, path in paths.items() if file_exists(spark, path)}


def metrics_table(spark: SparkSession, collated: dict[str, dict[str, float]]) -> DataFrame:
    """(dataset, metric, value) of collated metrics, for printing side by side."""
    rows = [(d, m, float(v)) for d, values in sorted(collated.items()) for m, v in values.items()]
    return spark.createDataFrame(rows, "dataset string, metric string, value double")


def run_to_relation(run: DataFrame, queries: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The relation of a run (qid, did, score), and its rows of labels that do not exist."""
    q = queries.filter("identifier IS NOT NULL").groupBy(F.col("identifier").alias("qid")).agg(F.max("idx").alias("row_idx"))
    d = labels.filter("identifier IS NOT NULL").groupBy(F.col("identifier").alias("did")).agg(F.max("idx").alias("col_idx"))
    known = run.join(q, "qid").join(d, "did").select("row_idx", "col_idx", F.col("score").cast("double").alias("score"))
    return known, run.join(d, "did", "left_anti")


def nested_run(run: DataFrame) -> DataFrame:
    """(qid, docs): each query's results as a map from document to score."""
    return run.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("did", "score")))).alias("docs"))


def write_config(spark: SparkSession, path: str, key: str, paths: dict, parameters: dict) -> None:
    write_text(spark, path, json.dumps({key: {"path": paths, "parameters": parameters}}, indent=4))
