"""Queries on raw records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.session import table
from relweave.sources.records import load_valid, parse_records, rejected


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return rejected(table(spark, d, "label_records")).select("rec_no", "reason").distinct()


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    return load_valid(table(spark, d, "label_records"))


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    parsed = parse_records(table(spark, d, "label_records"))
    return parsed.groupBy("shard", F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n_records"))


def p3_broken_fields(spark: SparkSession, d: str) -> DataFrame:
    return rejected(table(spark, d, "label_records")).select("rec_no", "reason", "broken_field").distinct()


_FIELD = r'("([^"]|"")*"|[^",]*)'
_SPLIT = rf"""
WITH line AS (SELECT rec_no, shard, CASE WHEN right(coalesce(rec, ''), 1) = chr(13) THEN left(rec, length(rec) - 1) ELSE coalesce(rec, '') END AS line
              FROM label_records),
shape AS (SELECT *, regexp_full_match(line, '{_FIELD}(,{_FIELD})*', 's') AS quoted_well, regexp_full_match(line, '{_FIELD},{_FIELD}', 's') AS two FROM line),
raw AS (SELECT *, regexp_extract(line, '^{_FIELD},', 1, 's') AS a FROM shape),
raw2 AS (SELECT *, substr(line, length(a) + 2) AS b FROM raw),
bare AS (SELECT *, CASE WHEN left(a, 1) = '"' THEN substr(a, 2, length(a) - 2) ELSE a END AS identifier,
                CASE WHEN left(b, 1) = '"' THEN replace(substr(b, 2, length(b) - 2), '""', '"') ELSE b END AS text FROM raw2),
judged AS (SELECT rec_no, shard, identifier, text,
  CASE WHEN NOT quoted_well THEN 'quoting' WHEN NOT two THEN 'columns'
       WHEN NOT regexp_full_match(identifier, 'lbl-[0-9]{{9}}') OR regexp_full_match(text, '[ \t\r\n]*')
            OR regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{{FFFD}}]') THEN 'value' END AS reason
  FROM bare)
"""

#: The fields before the longest well-formed prefix ends, and whether what is left is one field.
_WALKED = rf""", walked AS (SELECT *, regexp_extract(line, '^({_FIELD},)*', 0, 's') AS head FROM judged JOIN line USING (rec_no, shard)),
counted AS (SELECT rec_no, reason, identifier, len(regexp_extract_all(head, '{_FIELD},', 0, 's')) AS n FROM walked)
SELECT DISTINCT rec_no, reason, (CASE reason WHEN 'quoting' THEN least(n + 1, 3) WHEN 'columns' THEN CASE WHEN n = 0 THEN 2 ELSE 3 END
  ELSE CASE WHEN regexp_full_match(identifier, 'lbl-[0-9]{{9}}') THEN 2 ELSE 1 END END)::INTEGER AS broken_field FROM counted WHERE reason IS NOT NULL"""

QUERIES = {"p3_found": p3_found, "p3_loaded": p3_loaded, "p3_reasons": p3_reasons, "p3_broken_fields": p3_broken_fields}
SQL = {
    "p3_found": _SPLIT + "SELECT DISTINCT rec_no, reason FROM judged WHERE reason IS NOT NULL",
    "p3_loaded": _SPLIT + "SELECT identifier, text FROM judged WHERE reason IS NULL",
    "p3_broken_fields": _SPLIT + _WALKED,
    "p3_reasons": _SPLIT + "SELECT shard, coalesce(reason, 'valid') AS reason, count(*) AS n_records FROM judged GROUP BY ALL",
}
