"""Loading raw delimited records: valid rows apart from broken ones, each broken one with its reason.

A schema is a list of fields. From it come one anchored pattern that a whole valid record must match and, for the
records that do not match, incremental patterns of the first k fields: the first of them that fails gives both the reason
and the field. They run as JVM expressions inside whole-stage code; no row leaves the JVM, nothing is shuffled.

All repetitions are possessive, so that matching takes linear time and constant stack on texts of any length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTING, COLUMNS, VALUE = "quoting", "columns", "value"

#: Characters that make a value invalid: U+FFFD, U+007F and controls but tab, LF and CR.
BAD_CHARACTERS = r"\x00-\x08\x0B\x0C\x0E-\x1F\x7F�"
BLANK = r" \t\r\n"
#: A field of any content: quoted with doubled quotes inside, or without quotes and separators.
ANY_FIELD = r'(?:"(?:[^"]++|"")*+"|[^",]*+)'


@dataclass(frozen=True)
class Literal:
    """A field whose content matches ``pattern``; the pattern must allow neither quotes nor commas."""

    name: str
    pattern: str

    def valid(self) -> str:
        return f'(?:"{self.pattern}"|{self.pattern})'


@dataclass(frozen=True)
class FreeText:
    """A field with at least one character that is not blank and no bad character."""

    name: str

    def valid(self) -> str:
        quoted = rf'"(?=[{BLANK}]*+(?:""|[^{BLANK}"]))(?:[^"{BAD_CHARACTERS}]++|"")*+"'
        bare = rf'(?=[{BLANK}]*+[^{BLANK}",])[^",{BAD_CHARACTERS}]++'
        return f"(?:{quoted}|{bare})"


#: label.raw: an identifier of ``lbl-`` and nine ASCII digits, and a text.
LABEL_SCHEMA = (Literal("identifier", "lbl-[0-9]{9}"), FreeText("text"))


@dataclass(frozen=True)
class RecordPatterns:
    """The patterns generated for a schema.

    ``whole`` matches a valid record. The others are prefixes that grow by a field each: ``quoted[k]`` holds if the first
    k + 1 fields, as far as there are that many, are well formed, and ``quoted_rest`` if all fields are; ``present[k]`` if
    there are k + 1 fields, and ``no_more`` if there are no others; ``valid[k]`` if the first k + 1 fields are valid.
    """

    whole: str
    quoted: tuple[str, ...]
    quoted_rest: str
    present: tuple[str, ...]
    no_more: str
    valid: tuple[str, ...]

    @classmethod
    def of(cls, schema) -> RecordPatterns:
        n = len(schema)
        valid = [f.valid() for f in schema]
        quoted = []
        for _ in range(n):
            # one field more inside: what follows a field is the end, or a comma and the next field
            inner = r"(?:,|\z)"
            for _ in quoted:
                inner = rf"(?:\z|,{ANY_FIELD}{inner})"
            quoted.append(rf"\A{ANY_FIELD}{inner}")
        return cls(
            whole=r"\A" + ",".join(f"({v})" for v in valid) + r"\z",
            quoted=tuple(quoted),
            quoted_rest=rf"\A{ANY_FIELD}(?:,{ANY_FIELD})*+\z",
            present=tuple(rf"\A{ANY_FIELD}(?:,{ANY_FIELD}){{{k}}}(?:,|\z)" for k in range(n)),
            no_more=rf"\A{ANY_FIELD}(?:,{ANY_FIELD}){{{n - 1}}}\z",
            valid=tuple(r"\A" + ",".join(valid[: k + 1]) + (r"\z" if k == n - 1 else ",") for k in range(n)),
        )


def _first_failing(line: Column, p: RecordPatterns) -> Column:
    """struct(reason, field) of the first prefix pattern that fails, null if the whole record is valid."""
    steps = [(pattern, QUOTING, k + 1) for k, pattern in enumerate((*p.quoted, p.quoted_rest))]
    # a record has a first field in any case
    steps += [(pattern, COLUMNS, k + 1) for k, pattern in enumerate((*p.present, p.no_more)) if k]
    steps += [(pattern, VALUE, k + 1) for k, pattern in enumerate(p.valid)]
    out = F.when(line.rlike(p.whole), F.lit(None).cast("struct<reason:string,field:int>"))
    for pattern, reason, field in steps:
        out = out.when(~line.rlike(pattern), F.struct(F.lit(reason).alias("reason"), F.lit(field).alias("field")))
    return out


def _unquoted(field: Column) -> Column:
    quoted = field.startswith('"') & (F.length(field) >= 2)
    return F.when(quoted, F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))).otherwise(field)


def parse_records(records: DataFrame, schema=LABEL_SCHEMA, record: str = "rec") -> DataFrame:
    """Add each field of ``schema``, ``reason`` and ``broken_field`` to ``records``.

    A valid record gets its fields and null for ``reason``; a broken one null fields. Its ``reason`` and ``broken_field``
    are those of the first prefix pattern that fails: all on quoting stand before those on the number of fields, and these
    before those on values. ``broken_field`` counts from 1; it is the first missing field of a record with too few, and
    the first beyond the schema of one with too many. One trailing CR belongs to the line end. A null record counts as
    an empty one: one field, so ``columns``. Columns of the input with the name of a field, or named ``reason`` or
    ``broken_field``, are replaced.
    """
    p = RecordPatterns.of(schema)
    line = F.regexp_replace(F.coalesce(F.col(record), F.lit("")), r"\r\z", "")
    failing = _first_failing(line, p)
    fields = {f.name: F.when(line.rlike(p.whole), _unquoted(F.regexp_extract(line, p.whole, k + 1))) for k, f in enumerate(schema)}
    return records.withColumns({"reason": failing["reason"], "broken_field": failing["field"], **fields})


def load_valid(records: DataFrame, schema=LABEL_SCHEMA, record: str = "rec") -> DataFrame:
    """The fields of the valid records; other columns of the input are dropped."""
    return parse_records(records, schema, record).filter("reason IS NULL").select(*(f.name for f in schema))


def rejected(records: DataFrame, schema=LABEL_SCHEMA, record: str = "rec") -> DataFrame:
    """The broken records as they came, with ``reason`` and ``broken_field``."""
    return parse_records(records, schema, record).filter("reason IS NOT NULL").drop(*(f.name for f in schema))
