"""Dense indexes and hash-ordered samples, without a global window in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relweave.session import cut


def dense_index(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in the order of ``order``, which should be unique.

    Rows are partitioned by range, numbered within their partition, and moved by the sizes of the partitions before. Only
    these sizes, one row per partition, are added up in one place. Nulls come first.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, (within - 1 + F.col("_before")).cast("bigint")).drop("_part", "_before")


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before, in the order of ``order``, which should be unique.

    As ``dense_index``: only the sums of the partitions are added up in one place.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.sum(value).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_sum"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, within + F.col("_sum")).drop("_part", "_sum")  # a row per partition


def hash_key(seed: int, *columns: str) -> Column:
    """A text whose order is random but the same everywhere: the md5 of the seed and the columns."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def sample_rows(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows in hash order (all, if there are fewer); as top-k per partition and one merge."""
    return df.withColumn("_h", hash_key(seed, key)).orderBy("_h", key).limit(k).drop("_h")


def sample_share(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """The rows whose hash falls into the first ``share`` of the range of hashes: about that share, without a sort."""
    bound = int(share * 16**8)
    return df.filter(F.conv(F.substring(hash_key(seed, key), 1, 8), 16, 10).cast("bigint") < bound)


def sample_per_group(df: DataFrame, group: str, key: str, k: int, seed: int, oversample: bool = False) -> DataFrame:
    """Up to k rows per group in hash order. ``oversample`` gives exactly k: a group of fewer is repeated in that order."""
    w = Window.partitionBy(group).orderBy(hash_key(seed, group, key), key)
    few = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    if not oversample:
        return few.drop("_r")
    sizes = few.groupBy(group).agg(F.count("*").alias("_n"))
    times = F.explode(F.sequence(F.lit(0), F.floor((F.lit(k) - F.col("_r")) / F.col("_n"))))
    return few.join(sizes, group).withColumn("_t", times).drop("_r", "_n", "_t")


def split_rows(df: DataFrame, key: str, test_rows: int, seed: int) -> DataFrame:
    """With ``part``: ``test`` for ``test_rows`` rows in hash order, ``train`` for the others."""
    test = sample_rows(df.select(key).distinct(), key, test_rows, seed).withColumn("part", F.lit("test"))
    return df.join(test, key, "left").withColumn("part", F.coalesce("part", F.lit("train")))


def permuted_rows(r: DataFrame, seed: int) -> DataFrame:
    """A relation whose rows changed places: row i takes the place of the row that follows it in hash order."""
    rows = r.select("row_idx").distinct()
    by_hash = dense_index(rows.withColumn("_h", hash_key(seed, "row_idx")), ["_h", "row_idx"], "place").select("row_idx", "place")
    by_index = dense_index(rows, ["row_idx"], "place").select(F.col("row_idx").alias("new_idx"), "place")
    moved = by_hash.join(by_index, "place").select("row_idx", "new_idx")
    return r.join(moved, "row_idx").select(F.col("new_idx").alias("row_idx"), "col_idx", "score")


def random_relation(rows: DataFrame, n_cols: int, per_row: int, seed: int) -> DataFrame:
    """``per_row`` random columns per row, drawn with repetition; a column drawn twice counts 2."""
    drawn = rows.select(F.col("row_idx").cast("bigint").alias("row_idx"), F.explode(F.sequence(F.lit(1), F.lit(per_row))).alias("draw"))
    number = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("row_idx").cast("string"), F.col("draw").cast("string"))), 1, 12), 16, 10).cast("bigint")
    return drawn.select("row_idx", F.pmod(number, F.lit(n_cols)).alias("col_idx")).groupBy("row_idx", "col_idx").agg(F.count("*").cast("double").alias("score"))


def constant_relation(rows: DataFrame) -> DataFrame:
    """Every row related to column 0."""
    return rows.select(F.col("row_idx").cast("bigint").alias("row_idx")).distinct().select("row_idx", F.lit(0).cast("bigint").alias("col_idx"), F.lit(1.0).alias("score"))
