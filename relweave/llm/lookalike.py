"""One form for texts that look the same: compatibility forms, accents, invisible characters, blanks, look-alikes.

The work is done by DuckDB inside Arrow partitions, in one SQL expression of nfc_normalize, translate and regular
expressions. Its tables follow by rule from the Unicode data and from the confusables data that the session's ICU library
has; only the letters on which these two leave a choice are a fixed list.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.session import cut, spread

# Letters that have the shape of a basic Latin letter, most of them in Unicode TR39. The final sigma is
# the compatibility form of the lunate one, which has the shape of c.
LOOK_ALIKES = {
    "A": "ΑА", "B": "ΒВ", "C": "СϹ", "E": "ΕЕ", "H": "ΗН", "I": "ΙІӀ", "J": "ЈͿ", "K": "ΚКK", "M": "ΜМ", "N": "Ν",
    "O": "ΟОՕ", "P": "ΡР", "S": "ЅՏ", "T": "ΤТ", "U": "Ս", "W": "Ԝ", "X": "ΧХ", "Y": "ΥҮ", "Z": "Ζ", "Q": "Ԛ", "G": "Ԍ", "L": "Լ",
    "a": "αаɑ", "c": "сϲς", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "ιіı", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "οоօ",
    "p": "ρр", "q": "ԛզ", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝѡ", "x": "х", "y": "уү",
}

#: Characters without a mark of their own: format characters, joiners, fillers and variation selectors.
INVISIBLE = r"[\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180D}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}]"
BLANK = r"[\p{Zs}\p{Zl}\p{Zp}\t\n\x{0B}\x{0C}\r\x{85}]"


def _script(c: str) -> str:
    return unicodedata.name(c, "?").split()[0]


@cache
def letters() -> dict[str, str]:
    """Letters to the basic Latin letters of their shape: ``LOOK_ALIKES``, and what ICU's confusables data add to it.

    A letter of another script is added if it shares its skeleton with a basic letter of the same case, and for small
    letters if the capitals do so as well. Where a script has several letters of one shape, which its readers tell apart,
    none is added. Needs a running session, whose JVM has the data.
    """
    fixed = {c: latin for latin, others in LOOK_ALIKES.items() for c in others}
    skeleton = SparkContext._active_spark_context._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton
    basic = {(skeleton(c), c.isupper()): c for c in map(chr, range(128)) if c.isalpha()}
    shape = {}
    for c in map(chr, range(0x80, 0x20000)):
        if unicodedata.category(c) in ("Lu", "Ll") and _script(c) != "LATIN" and unicodedata.normalize("NFKD", c) == c:
            if to := basic.get((skeleton(c), c.isupper())):
                shape[c] = to
    sharing: dict[tuple[str, str], set[str]] = {}
    for c, to in [*shape.items(), *fixed.items()]:
        sharing.setdefault((_script(c), to), set()).add(c)
    alone = {c: to for c, to in shape.items() if len(sharing[_script(c), to]) == 1 and (c.isupper() or shape.get(c.upper()) == to.upper())}
    return alone | fixed


@cache
def _tables() -> tuple[dict[str, str], dict[str, str]]:
    """Mappings of one character to one, and of one to several, on texts in composed form."""
    one: dict[str, str] = {}
    several: dict[str, str] = {}

    def put(c: str, to: str) -> None:
        if to != c:
            (one if len(to) == 1 else several)[c] = to

    shapes = letters()
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.category(c) in ("Cn", "Co", "Cs", "Cf") or "가" <= c <= "힣":
            continue
        # a character's own shape comes before what it is a compatibility form of
        plain = shapes.get(c) or unicodedata.normalize("NFKD", c)
        shaped = unicodedata.normalize("NFC", "".join(shapes.get(x, x) for x in plain))
        if shaped != unicodedata.normalize("NFC", c):
            put(c, "".join(" " if unicodedata.category(x) in ("Zs", "Zl", "Zp") else x for x in shaped))
    return one, several


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _class(characters) -> str:
    """A character class of ranges."""
    codes, out = sorted(map(ord, characters)), []
    for k in codes:
        if out and k == out[-1][1] + 1:
            out[-1][1] = k
        else:
            out.append([k, k])
    return "[" + "".join(rf"\x{{{a:X}}}" if a == b else rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in out) + "]"


@cache
def form_sql(column: str = "text") -> str:
    """The SQL expression of the form of ``column``.

    Invisible characters go first, as they can stand between a letter and its accent. Texts of ASCII characters only
    need nothing but blanks made equal. As translate reads its tables for every row, they are split: letters of other
    scripts and full-width forms on their own, the many rare compatibility forms apart, each only for texts that have some.
    """
    one, several = _tables()
    table = f"MAP {{{', '.join(f'{_quoted(k)}: {_quoted(v)}' for k, v in several.items())}}}"
    some = _class(several)
    parts = f"list_transform(regexp_extract_all(s, '{some}|[^{some[1:-1]}]+', 0, 's'), lambda c: CASE WHEN length(c) = 1 THEN coalesce({table}[c], c) ELSE c END)"
    steps = [
        f"nfc_normalize(regexp_replace({column}, '{INVISIBLE}', '', 'g'))",
        f"CASE WHEN regexp_matches(s, '{some}') THEN array_to_string({parts}, '') ELSE s END",
    ]
    own = [c for c in one if c in letters()]
    wide = [c for c in one if "\uff00" <= c <= "\uffef"]
    rest = [c for c in one if c not in {*own, *wide}]
    for table in (own, wide, rest):
        steps.append(f"CASE WHEN regexp_matches(s, '{_class(table)}') THEN translate(s, {_quoted(''.join(table))}, {_quoted(''.join(one[c] for c in table))}) ELSE s END")
    steps.append("nfc_normalize(s)")
    mapped = steps[0]
    for step in steps[1:]:
        mapped = f"list_transform([{mapped}], lambda s: {step})[1]"
    return f"regexp_replace(CASE WHEN regexp_matches({column}, '[^\\x00-\\x7F]') THEN {mapped} ELSE {column} END, '{BLANK}', ' ', 'g')"


def _forms(keep: list[str], form: str):
    columns = ", ".join(f'"{c}"' for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        try:
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                con.register("rows", rows)
                yield from con.sql(f"SELECT {columns}, {form} AS form FROM rows").to_arrow_table().to_batches()
                con.unregister("rows")
        finally:
            con.close()

    return run


def with_form(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, ``text`` and its ``form``; a null text has a null form, an empty text an empty one.

    Equal forms mean that two texts look the same. Case, accents, digits and the number of blanks stay as they are.
    Other columns are dropped.
    """
    rows = df.select(*keys, F.col(text).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", text string, form string"
    return spread(rows).mapInArrow(_forms([*keys, "text"], form_sql("text")), schema)


def same_looking_pairs(df: DataFrame, key: str = "identifier", text: str = "text") -> DataFrame:
    """Distinct pairs (id_a, id_b), id_a < id_b, of rows whose texts differ but look the same.

    Null and empty texts never count. Texts are compared as classes first: equal texts form one class, classes of one
    form are paired, and only then the rows of either class. Copies of one text are never paired with each other.
    """
    rows = df.filter((F.length(text) > 0) & F.col(key).isNotNull()).select(key, text)
    formed = with_form(rows, [key], text).select(F.col(key).alias("id"), F.md5("text").alias("class"), F.md5("form").alias("look"))
    formed = cut(formed.distinct())
    classes = formed.select("look", "class").distinct()
    several = classes.groupBy("look").agg(F.count("*").alias("n")).filter("n > 1").select("look")
    classes = classes.join(several, "look", "left_semi")
    a, b = classes.alias("a"), classes.alias("b")
    pairs = a.join(b, (F.col("a.look") == F.col("b.look")) & (F.col("a.class") < F.col("b.class"))).select(F.col("a.class").alias("x"), F.col("b.class").alias("y"))
    members = formed.select("id", "class").distinct()
    out = pairs.join(members.select(F.col("class").alias("x"), F.col("id").alias("p")), "x").join(members.select(F.col("class").alias("y"), F.col("id").alias("q")), "y")
    return out.filter("p <> q").select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b")).distinct()


def look_classes(df: DataFrame, key: str = "identifier", text: str = "text") -> DataFrame:
    """One row per record with a text: its class of same-looking texts and the number of different texts in it."""
    formed = with_form(df.filter(F.length(text) > 0), [key], text).select(key, F.md5("form").alias("class_id"), F.md5("text").alias("t")).distinct()
    sizes = formed.select("class_id", "t").distinct().groupBy("class_id").agg(F.count("*").alias("n_texts"))
    return formed.select(key, "class_id").distinct().join(sizes, "class_id").select(key, "class_id", "n_texts")
