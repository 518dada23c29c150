"""Relations and events as streams. An extension: batch forms of the same operators are in ``operators``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.sources.readers import RELATION


def read_cells(spark: SparkSession, path: str, time: str = "scored_at") -> DataFrame:
    """Cells that arrive as Parquet files."""
    schema = T.StructType([*RELATION.fields, T.StructField(time, T.TimestampType())])
    return spark.readStream.schema(schema).parquet(path)


def best_cells(stream: DataFrame, time: str = "scored_at", late: str = "1 day") -> DataFrame:
    """The highest score of each cell and day; rows later than ``late`` behind the newest are dropped."""
    good = stream.filter("row_idx IS NOT NULL AND col_idx IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    return good.withWatermark(time, late).groupBy(F.window(time, "1 day"), "row_idx", "col_idx").agg(F.max("score").alias("score"))


def event_counts(stream: DataFrame, time: str = "ts", kind: str = "event_type", size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events per window and kind."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size, slide), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def upsert_relation(batch: DataFrame, path: str, version: int) -> None:
    """For ``foreachBatch``: the table of version n is that of n - 1 with the batch's cells, highest score per cell. A batch
    that is delivered again writes the same version again."""
    spark = batch.sparkSession
    cells = batch.select("row_idx", "col_idx", "score")
    if version > 0:
        cells = cells.unionByName(spark.read.parquet(f"{path}/version={version - 1}").select("row_idx", "col_idx", "score"))
    cells.groupBy("row_idx", "col_idx").agg(F.max("score").alias("score")).write.mode("overwrite").parquet(f"{path}/version={version}")
