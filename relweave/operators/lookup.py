"""Joins between relations and tables of (idx, identifier, text), and audits of such tables.

A null key matches nothing. Where a name or text belongs to several entries, the last index counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_index(info: DataFrame, key: str) -> DataFrame:
    """(key, idx): the last index of each value of ``key``."""
    return info.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("idx").alias("idx"))


def decode(r: DataFrame, info: DataFrame) -> DataFrame:
    """Cells with the ``identifier`` and ``text`` of their column; cells without an entry are dropped."""
    return r.join(info.select(F.col("idx").alias("col_idx"), "identifier", "text").dropDuplicates(["col_idx"]), "col_idx").select("row_idx", "col_idx", "score", "identifier", "text")


def zip_tables(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("left_text", "right_text")) -> DataFrame:
    """Two tables side by side, joined on idx; indexes that one lacks are dropped."""
    return a.select("idx", F.col("text").alias(names[0])).distinct().join(b.select("idx", F.col("text").alias(names[1])).distinct(), "idx")


def encode(df: DataFrame, info: DataFrame, key: str, info_key: str = "identifier", missing: str = "fail") -> DataFrame:
    """``df`` with ``idx`` of the entry that ``key`` names. ``missing``: ``fail`` raises when the rows are computed,
    ``drop`` drops them, ``keep`` leaves null."""
    looked = df.join(last_index(info, info_key).select(F.col(info_key).alias(key), "idx"), key, "inner" if missing == "drop" else "left")
    if missing == "fail":
        known = F.when(F.col("idx").isNull(), F.raise_error(F.concat(F.lit("no entry for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.col("idx"))
        looked = looked.withColumn("idx", known.cast("bigint"))
    return looked


def missing_keys(df: DataFrame, info: DataFrame, key: str, info_key: str = "identifier") -> DataFrame:
    """The rows whose key has no entry."""
    return df.join(info.select(F.col(info_key).alias(key)).distinct(), key, "left_anti")


def lookup_lists(info: DataFrame, lists: DataFrame, items: str) -> DataFrame:
    """Every entry with its list of ``lists`` (idx, items); an empty one where there is none."""
    return info.select("idx", "identifier").join(lists.select("idx", items), "idx", "left").withColumn(items, F.coalesce(items, F.array().cast(dict(lists.dtypes)[items])))


def replace_by_text(queries: DataFrame, metadata: DataFrame, replacement: str) -> DataFrame:
    """Queries whose text is that of an entry of ``metadata`` get its ``replacement``; others keep theirs, with
    ``found`` false."""
    best = metadata.filter(F.col("text").isNotNull()).groupBy("text").agg(F.max_by(replacement, "idx").alias("_new"), F.lit(True).alias("found"))
    out = queries.join(best, "text", "left")
    return out.withColumn("found", F.coalesce("found", F.lit(False))).withColumn("replaced", F.when(F.col("found"), F.col("_new")).otherwise(F.col("text"))).drop("_new")


def edges_between(edges: DataFrame, nodes: DataFrame, src: str, dst: str, node: str) -> DataFrame:
    """The edges of which both ends exist."""
    keep = nodes.select(node).distinct()
    return edges.join(keep.withColumnRenamed(node, src), src, "left_semi").join(keep.withColumnRenamed(node, dst), dst, "left_semi")


def neighbours_by_item(r: DataFrame, first: int) -> DataFrame:
    """(row_idx, col_idx, other_row): for each cell the first ``first`` other rows, by index, with the same column.

    The rows of a column are ranked once; a row itself may be among the first, so one more is kept.
    """
    from pyspark.sql import Window

    few = r.select("col_idx", F.col("row_idx").alias("other_row"), F.row_number().over(Window.partitionBy("col_idx").orderBy("row_idx")).alias("at")).filter(F.col("at") <= first + 1)
    pairs = r.select("row_idx", "col_idx").join(few, "col_idx").filter("row_idx <> other_row")
    rank = F.row_number().over(Window.partitionBy("row_idx", "col_idx").orderBy("at"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= first).select("row_idx", "col_idx", "other_row")


def audit_order(made: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row (same_order, same_set): whether both tables list the same identifiers in the same order of idx, and whether they
    have the same ones."""
    a, b = (t.select("idx", "identifier").distinct() for t in (made, wanted))
    order = a.withColumnRenamed("identifier", "x").join(b.withColumnRenamed("identifier", "y"), "idx", "full")
    named = lambda t, c: t.filter("identifier IS NOT NULL").select("identifier", F.lit(1).alias(c)).distinct()
    both = named(a, "x").join(named(b, "y"), "identifier", "full")
    one = order.agg((F.count_if(~F.col("x").eqNullSafe(F.col("y"))) == 0).alias("same_order"))
    return one.crossJoin(both.agg((F.count_if(F.col("x").isNull() | F.col("y").isNull()) == 0).alias("same_set")))  # one row each


def audit_triples(made: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row for two relations by name (qid, did, score): the triples of either, those only in one, whether they are identical
    and whether they are but for the scores. Triples count once."""
    a = made.select("qid", "did", F.col("score").cast("double").alias("score"), F.lit(1).alias("m")).distinct()
    b = wanted.select("qid", "did", F.col("score").cast("double").alias("score"), F.lit(1).alias("w")).distinct()
    both = a.join(b, ["qid", "did", "score"], "full")
    counts = both.agg(F.count("m").alias("n_made"), F.count("w").alias("n_wanted"), F.count_if(F.col("w").isNull()).alias("only_made"), F.count_if(F.col("m").isNull()).alias("only_wanted"))
    pairs = a.select("qid", "did", "m").distinct().join(b.select("qid", "did", "w").distinct(), ["qid", "did"], "full")
    same = pairs.agg((F.count_if(F.col("m").isNull() | F.col("w").isNull()) == 0).alias("pairs_identical"))
    return counts.withColumn("identical", (F.col("only_made") == 0) & (F.col("only_wanted") == 0)).crossJoin(same)  # one row each


def audit_tables(made: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: entries only in either table by identifier, shared ones, and shared ones of other text or index.

    Entries count once per identifier, with their last index.
    """
    a = made.filter(F.col("identifier").isNotNull()).groupBy("identifier").agg(F.max(F.struct("idx", "text")).alias("a"))
    b = wanted.filter(F.col("identifier").isNotNull()).groupBy("identifier").agg(F.max(F.struct("idx", "text")).alias("b"))
    both = a.join(b, "identifier", "full")
    shared = F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.agg(
        F.count_if(F.col("b").isNull()).alias("only_made"),
        F.count_if(F.col("a").isNull()).alias("only_wanted"),
        F.count_if(shared).alias("shared"),
        F.count_if(shared & ~F.col("a.text").eqNullSafe(F.col("b.text"))).alias("other_text"),
        F.count_if(shared & ~F.col("a.idx").eqNullSafe(F.col("b.idx"))).alias("other_idx"),
    )
