"""Shared inputs of the queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.operators import relation as rel
from relweave.session import table


def cells(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A clean relation; a repeated cell counts once, with its highest score."""
    return rel.relation(table(spark, d, name))


def cells_sql(name: str) -> str:
    return (
        f"(SELECT row_idx, col_idx, max(score) AS score FROM {name} WHERE row_idx IS NOT NULL AND col_idx IS NOT NULL"
        " AND score IS NOT NULL AND NOT isnan(score) GROUP BY row_idx, col_idx)"
    )


LBL, NEG, META = cells_sql("data_lbl"), cells_sql("data_neg"), cells_sql("data_meta")
#: Supplier and part, with the quantity.
SUPPLY = "(SELECT l_suppkey AS row_idx, l_partkey AS col_idx, sum(l_quantity) AS score FROM lineitem GROUP BY ALL)"
#: Order and part, with the price.
ORDER = "(SELECT l_orderkey AS row_idx, l_partkey AS col_idx, sum(l_extendedprice) AS score FROM lineitem GROUP BY ALL)"


def supply(spark: SparkSession, d: str) -> DataFrame:
    return rel.relation(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", "l_quantity", "sum")


def order_parts(spark: SparkSession, d: str) -> DataFrame:
    return rel.relation(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", "l_extendedprice", "sum")


def info(spark: SparkSession, d: str, name: str) -> DataFrame:
    """(idx, identifier, text), a row delivered twice once."""
    return table(spark, d, name).select("idx", "identifier", "text").distinct()


def info_sql(name: str) -> str:
    return f"(SELECT DISTINCT idx, identifier, text FROM {name})"


def r6(c: Column | str, name: str = "score") -> Column:
    """Rounded to 6 places; the tiny addend keeps halves from falling to either side by the order of a sum."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-10, 6).alias(name)


def rounded(r: DataFrame) -> DataFrame:
    return r.select("row_idx", "col_idx", r6("score"))


def rounded_sql(sql: str) -> str:
    return f"SELECT row_idx, col_idx, round(score + 1e-10, 6) AS score FROM ({sql})"
