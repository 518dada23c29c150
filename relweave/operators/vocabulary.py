"""Vocabularies in the order of first sight, and the relations that they encode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.operators.indexing import dense_index


def first_seen(df: DataFrame, row: str, items: str) -> DataFrame:
    """(idx, token): the tokens of the arrays ``items``, numbered from 0 in the order in which they first appear by row and
    position. Null tokens and arrays have no place."""
    seen = df.select(F.col(row).alias("_row"), F.posexplode(items).alias("_pos", "token")).filter(F.col("token").isNotNull())
    first = seen.groupBy("token").agg(F.min(F.struct("_row", "_pos")).alias("_at")).select("token", F.col("_at._row").alias("_row"), F.col("_at._pos").alias("_pos"))
    return dense_index(first, ["_row", "_pos"]).select("idx", "token")


def encoded(df: DataFrame, row: str, items: str, vocabulary: DataFrame) -> DataFrame:
    """The relation of rows and vocabulary entries; scores count repetitions."""
    cells = df.select(F.col(row).cast("bigint").alias("row_idx"), F.explode(items).alias("token"))
    return cells.join(vocabulary, "token").groupBy("row_idx", F.col("idx").alias("col_idx")).agg(F.count("*").cast("double").alias("score"))


def info_table(vocabulary: DataFrame, prefix: str) -> DataFrame:
    """The vocabulary as (idx, identifier, text)."""
    return vocabulary.select("idx", F.concat(F.lit(prefix + "-"), F.col("idx").cast("string")).alias("identifier"), F.col("token").alias("text"))
