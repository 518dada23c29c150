"""Readers of info tables, relations, vectors, generations and configurations.

An info table is (idx, identifier, text). Files have no row order in Spark: where the order of lines is the index, a
reader takes it from the position in the file, which ``read_lines`` keeps by file name and byte order.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.functions.text import split_first
from relweave.operators.indexing import dense_index, running_sum
from relweave.session import cut, file_exists, list_files, read_text, shared_folder

INFO = T.StructType([T.StructField("idx", T.LongType()), T.StructField("identifier", T.StringType()), T.StructField("text", T.StringType())])
RELATION = T.StructType([T.StructField("row_idx", T.LongType()), T.StructField("col_idx", T.LongType()), T.StructField("score", T.DoubleType())])
VECTORS = T.StructType([T.StructField("id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
# Names of a text column, in any case.
TEXT_COLUMNS = ("query", "text", "query_text", "raw_data", "raw_text", "raw_query")


def _numbered(df: DataFrame) -> DataFrame:
    """``idx`` by file name and position: the ids that Spark gives grow along a file's splits and lines."""
    placed = df.withColumn("_file", F.input_file_name()).withColumn("_at", F.monotonically_increasing_id())
    return dense_index(cut(placed), ["_file", "_at"]).drop("_file", "_at")


def read_txt(spark: SparkSession, path: str, separator: str = "->", encoding: str = "utf-8") -> DataFrame:
    """Lines of identifier, separator and text, split at the first separator; a line without one has a null text."""
    lines = _numbered(spark.read.option("encoding", encoding).option("wholetext", False).text(path))
    parts = split_first(F.col("value"), separator)
    return lines.select("idx", parts[0].alias("identifier"), F.get(parts, F.lit(1)).alias("text"))


def read_records(spark: SparkSession, path: str | list[str], separator: str = ",") -> DataFrame:
    """A quoted table with a header, as texts with ``idx``; quoted fields may hold separators, doubled quotes and line breaks.

    Files are split however large they are. Where quoted fields hold line breaks, a line that begins inside quotes belongs
    to the record before: it has an odd number of quotes before it in its file. The quotes before a line are added up
    from the sums of the partitions, as indexes are, and the lines of a record joined again.
    """
    options = {"quote": '"', "escape": '"', "sep": separator}
    lines = spark.read.text(path).withColumn("_file", F.input_file_name())
    quotes = F.regexp_count("value", F.lit('"'))
    if lines.filter(quotes % 2 == 1).isEmpty():
        return _numbered(spark.read.csv(path, header=True, **options))
    placed = cut(lines.withColumn("_at", F.monotonically_increasing_id()))
    # all files in one order: a file that ends inside quotes would be broken in any reader
    counted = running_sum(placed.withColumn("_q", quotes), ["_file", "_at"], "_q", "_before")
    counted = counted.withColumn("_new", (F.pmod("_before", F.lit(2)) == 0).cast("int"))
    numbered = running_sum(counted, ["_file", "_at"], "_new", "_record").withColumn("_record", F.col("_record") + F.col("_new"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "value"))), lambda x: x["value"]), "\n")  # the lines of a record
    records = numbered.groupBy("_file", "_record").agg(whole.alias("value"))
    header = spark.read.csv(path, header=True, multiLine=True, **options).columns
    schema = ", ".join("`" + c.replace("`", "``") + "` string" for c in header)
    first = records.groupBy("_file").agg(F.min("_record").alias("_first"))  # the header of each file
    body = records.join(first, "_file").filter(F.col("_record") > F.col("_first"))
    parsed = body.withColumn("_row", F.from_csv("value", F.lit(schema), options))
    return dense_index(parsed.select("_record", "_row.*"), ["_record"]).drop("_record")


def read_csv(spark: SparkSession, path: str, id_name: str = "identifier", text_name: str = "text", separator: str = ",") -> DataFrame:
    """(idx, identifier, text) of a quoted table with a header. Missing texts are ''."""
    rows = read_records(spark, path, separator)
    return rows.select("idx", F.col(id_name).alias("identifier"), F.coalesce(F.col(text_name), F.lit("")).alias("text"))


def read_info(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """By the suffix: ``.txt``, ``.csv`` or ``.tsv``; any other is an error."""
    suffix = os.path.splitext(path)[1]
    if suffix == ".txt":
        return read_txt(spark, path, **options)
    if suffix == ".csv":
        return read_csv(spark, path, **options)
    if suffix == ".tsv":
        return read_csv(spark, path, separator="\t", **options)
    raise ValueError(f"no reader for {suffix!r} files")


def text_column(columns: list[str], wanted: str | None = None) -> str:
    """The column that holds the text: ``wanted``, or an error if there is none of that name; else the first column of the
    file whose name is one of ``TEXT_COLUMNS``, else the first column."""
    if wanted is not None:
        if wanted not in columns:
            raise KeyError(f"no column {wanted!r} among {columns}")
        return wanted
    return next((c for c in columns if c.lower() in TEXT_COLUMNS), columns[0])


def read_queries(spark: SparkSession, path: str, header: bool = True, column: str | None = None) -> DataFrame:
    """(idx, text) of a tab-separated table; its text column is named or found by its name, without a header the first."""
    rows = spark.read.csv(path, sep="\t", header=header, quote='"', escape='"')
    name = text_column(rows.columns, column) if header else rows.columns[0]
    return _numbered(rows.select(F.col(f"`{name}`").alias("text"))).select("idx", "text")


def read_shards(spark: SparkSession, folder: str, tag: str = "", separator: str = "\t") -> DataFrame:
    """All files of a folder, on any file system, whose name contains ``tag``, as one table; an error if there are none."""
    paths = [p for p in list_files(spark, folder) if tag in (name := p.rsplit("/", 1)[-1]) and not name.startswith((".", "_"))]
    if not paths:
        raise FileNotFoundError(f"no file with {tag!r} in {folder}")
    return read_records(spark, paths, separator).drop("idx")


def read_relation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RELATION).parquet(path)


def import_npz(spark: SparkSession, path: str) -> DataFrame:
    """A compressed sparse row matrix from a file of arrays data, indices, indptr; read by the driver once, for import."""
    with np.load(path) as z:
        data, indices, indptr = z["data"].astype("f8"), z["indices"].astype("i8"), z["indptr"].astype("i8")
    import pyarrow as pa

    rows = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    return spark.createDataFrame(pa.table({"row_idx": rows, "col_idx": indices, "score": data}))


def read_vectors(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """(id, embedding); an error if the number of rows is not the expected one, as of a stale cache."""
    df = spark.read.schema(VECTORS).parquet(path)
    if rows is not None and (n := df.count()) != rows:
        raise ValueError(f"{path} has {n} vectors, not {rows}")
    return df


def cached(spark: SparkSession, name: str, make, folder: str | None = None, config: dict | None = None) -> DataFrame:
    """The table ``name`` of a folder for ``config``, made and written by ``make()`` if it is not there in full.

    The parameters that a table depends on belong into ``config``: each different one has a table of its own.
    """
    key = hashlib.md5(json.dumps(config or {}, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{folder or shared_folder(spark)}/{name}-{key}"
    if not file_exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_config(spark: SparkSession, path: str, key: str) -> dict:
    """The ``path`` and ``parameters`` of one entry of a JSON configuration."""
    return json.loads(read_text(spark, path))[key]


def label_info_path(config: dict) -> str:
    """Where the labels of a configuration are: with the test paths if named there, else with the training paths."""
    paths = config["path"]
    return paths["test"]["lbl_info"] if "lbl_info" in paths.get("test", {}) else paths["train"]["lbl_info"]


def expand_datasets(name: str, registry: list[str], skip: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(dataset, tag) of ``all`` or one dataset; a tag has - for /."""
    chosen = registry if name == "all" else [name]
    return [(d, d.replace("/", "-")) for d in chosen if d not in skip]


def build_block(relations: dict[str, DataFrame], top: dict[str, int | None], samples: dict[str, int | None], seed: int = 1, oversample: bool = False) -> dict[str, DataFrame]:
    """The relations of one part of a dataset, each cut to its best cells per row and then to a sample of them; with
    ``oversample`` rows of fewer cells are filled up by repetition."""
    from relweave.operators.indexing import sample_per_group
    from relweave.operators.relation import top_k

    out = {}
    for name, r in relations.items():
        r = top_k(r, top[name]) if top.get(name) else r
        out[name] = sample_per_group(r, "row_idx", "col_idx", samples[name], seed, oversample) if samples.get(name) else r
    return out


def build_blocks(parts: dict[str, dict[str, DataFrame]], parameters: dict[str, dict], seed: int = 1) -> dict[str, dict[str, DataFrame]]:
    """The blocks of the parts of a dataset, such as ``train`` and ``test``, each by its own ``parameters``: ``top``, ``samples`` and
    ``oversample``. A part without parameters stays whole."""
    return {
        part: build_block(relations, (p := parameters.get(part, {})).get("top", {}), p.get("samples", {}), seed, p.get("oversample", False))
        for part, relations in parts.items()
    }


def early_fusion_inputs(spark: SparkSession, datasets: list[str], path_format: str, optional: tuple[str, ...] = ()) -> tuple[DataFrame | None, list[str]]:
    """The query texts with metadata of several datasets, (dataset, idx, identifier, text), and the datasets left out.

    ``path_format`` has ``{dataset}``. A dataset whose file is missing is left out; those of ``optional`` are
    left out without being listed.
    """
    found, missing = None, []
    for name, tag in expand_datasets("all", datasets):
        path = path_format.format(dataset=tag)
        if not file_exists(spark, path):
            missing += [] if name in optional else [name]
            continue
        rows = read_info(spark, path).select(F.lit(name).alias("dataset"), "idx", "identifier", "text")
        found = rows if found is None else found.unionByName(rows)
    return found, missing
