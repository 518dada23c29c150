"""Parsing of generated facts: triples and query lists in JSON, in Python notation, or broken."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.functions.text import clean, strip_fences

TRIPLE = "struct<s:string,p:string,o:string>"


def _as_triples(parts: Column) -> Column:
    """Arrays of texts to triples: cleaned, empty parts dropped, arrays of another length than 3 dropped."""
    full = F.filter(F.transform(parts, lambda t: F.filter(F.transform(t, clean), lambda x: x != "")), lambda t: F.size(t) == 3)
    return F.transform(full, lambda t: F.struct(t[0].alias("s"), t[1].alias("p"), t[2].alias("o")))


def _text(part: object, join_nested: bool) -> str:
    return " ".join(map(str, part)) if join_nested and isinstance(part, (list, tuple)) else str(part)


def _mended(text: str) -> object:
    """What can be read of broken notation: all complete inner lists of quoted parts."""
    found = re.findall(r"\[((?:\s*(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')\s*,?)+)\]", text)
    return [[a or b for a, b in re.findall(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'", row)] for row in found]


def _read(text: str | None, join_nested: bool) -> list[list[str]]:
    if not text:
        return []
    value: object = None
    for reader in (json.loads, ast.literal_eval, _mended):
        try:
            value = reader(text)
            break
        except (ValueError, SyntaxError, RecursionError, MemoryError, TypeError):
            continue
    if isinstance(value, dict) and "triples" in value:
        value = value["triples"]
    if not isinstance(value, list) or not value or not isinstance(value[0], list):
        return []
    return [[_text(x, join_nested) for x in row] for row in value if isinstance(row, (list, tuple))]


def parse_triples(df: DataFrame, response: str, out: str = "triples", join_nested: bool = False) -> DataFrame:
    """``df`` with ``out``: the triples of a raw response, an empty array where nothing can be read.

    Valid JSON of texts, bare or under ``triples``, is read in the JVM. The rest (Python notation, numbers or lists as
    parts, broken text) goes through Python; ``join_nested`` joins nested parts with blanks instead of printing them.
    """
    bare = strip_fences(F.col(response))
    wrapped = F.from_json(bare, "triples array<array<string>>")["triples"]
    plain = F.from_json(bare, "array<array<string>>")
    easy = F.when(bare.startswith("{"), wrapped).when(bare.startswith("[["), plain)
    # JSON numbers and nested parts print differently in Python; only parts in quotes are easy
    quoted = bare.rlike(r'^\s*(?:\{\s*"triples"\s*:\s*)?\[\s*(?:\[\s*(?:"(?:[^"\\]|\\.)*+"\s*,?\s*)*+\]\s*,?\s*)++\]\s*\}?\s*$')

    @F.pandas_udf("array<array<string>>")
    def hard(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: _read(t, join_nested))

    parts = F.coalesce(F.when(quoted, easy), hard(F.when(quoted & easy.isNotNull(), F.lit(None).cast("string")).otherwise(bare)))
    return df.withColumn(out, F.coalesce(_as_triples(parts), F.array().cast(f"array<{TRIPLE}>")))


def json_list(text: Column, field: str = "queries") -> Column:
    """The texts under ``field`` of a JSON object, an empty array if there are none."""
    return F.coalesce(F.from_json(strip_fences(text), f"{field} array<string>")[field], F.array().cast("array<string>"))


def entities(triples: Column) -> Column:
    """Subject and object of each triple, in order, with repetitions."""
    return F.flatten(F.transform(triples, lambda t: F.array(t["s"], t["o"])))


def distinct_facts(df: DataFrame, triples: str) -> DataFrame:
    """(s, p, o): the different triples of all rows."""
    return df.select(F.explode(triples).alias("t")).select("t.s", "t.p", "t.o").distinct()
