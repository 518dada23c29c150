"""Text expressions. A null input gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(text: Column) -> Column:
    """Lower case; every character but Latin letters, digits and blanks becomes one blank; blanks at the ends go.

    Runs of blanks inside stay.
    """
    return F.trim(F.regexp_replace(F.lower(text), "[^A-Za-z0-9 ]", " "))


def clean_all(texts: Column) -> Column:
    return F.transform(texts, clean)


def blank_controls(text: Column) -> Column:
    """Control characters U+0000 to U+001F and U+007F become blanks; the length stays."""
    return F.regexp_replace(text, r"[\x00-\x1F\x7F]", " ")


#: White space as Python's ``str.strip`` takes it.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip_fences(text: Column) -> Column:
    """Without code fences and the white space around."""
    for fence in ("```json", "```python", "```"):
        text = F.replace(text, F.lit(fence), F.lit(""))
    return F.btrim(text, F.lit(WHITE))


def joined(text: Column, items: Column, separator: str = " [SEP] ") -> Column:
    """The text, a separator, and the items with separators between; without items a separator ends it."""
    return F.concat(text, F.lit(separator), F.array_join(items, separator))


def with_categories(text: Column, items: Column) -> Column:
    return F.concat(text, F.lit(" <CATEGORIES> "), F.array_join(items, " || "))


def fact_text(triple: Column) -> Column:
    return F.concat_ws(" ", triple["s"], triple["p"], triple["o"])


def prompt(prefix: str, title: Column | None, text: Column) -> Column:
    """The prefix, then title and text with a blank between and none around; null parts are left out."""
    return F.concat(F.lit(prefix), F.trim(F.concat_ws(" ", title, text) if title is not None else F.coalesce(text, F.lit(""))))


def surrogate_id(prefix: str, index: Column, width: int = 0) -> Column:
    number = index.cast("string")
    return F.concat(F.lit(prefix + "-"), F.lpad(number, width, "0") if width else number)


def namespaced(dataset: Column, identifier: Column) -> Column:
    return F.concat_ws("_", F.replace(dataset, F.lit("/"), F.lit("-")), identifier)


def split_first(text: Column, separator: str) -> Column:
    """Two parts, split at the first separator only."""
    return F.split(text, "\\Q" + separator + "\\E", 2)


def four_decimals(x: Column) -> Column:
    return F.format_string("%.4f", x)


def model_kind(name: Column, kinds: dict[str, str], default: str) -> Column:
    """The kind of the first key that the name contains, in any case."""
    out = None
    for part, kind in kinds.items():
        hit = F.lower(name).contains(part)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def digest_id(text: Column, prefix: str) -> Column:
    """The prefix and the md5 of the text in UTF-8."""
    return F.concat(F.lit(prefix), F.md5(text))


def chunk_digest(texts: Column) -> Column:
    """Of a list of texts: 16 hex digits of the md5 of their number and the texts, U+001F between."""
    return F.substring(F.md5(F.concat_ws("\x1f", F.size(texts).cast("string"), F.array_join(texts, "\x1f", ""))), 1, 16)


def choose(items: Column, seed: int, *key: Column) -> Column:
    """One of the items by the md5 of the seed and the key; null for an empty array."""
    number = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), *(k.cast("string") for k in key))), 1, 8), 16, 10).cast("bigint")
    return F.when(F.size(items) > 0, F.get(items, F.pmod(number, F.size(items)).cast("int")))


def choose_alternatives(items: Column, seed: int, row: Column, rounds: int, separator: str = " [SEP] ") -> Column:
    """The items ``rounds`` times over, of an item with alternatives between separators each time one of these, drawn by the
    seed, the row, and the place: what ``fill_to_budget`` takes where items have alternatives."""
    places = F.sequence(F.lit(0), F.size(items) * rounds - 1)
    one = lambda k: choose(F.split(F.get(items, F.pmod(k, F.size(items))), "\\Q" + separator + "\\E"), seed, row, k)
    return F.when(F.size(items) > 0, F.transform(places, one)).otherwise(F.array().cast("array<string>"))


def fill_to_budget(text: Column, items: Column, budget: int, separator: str = " [SEP] ") -> Column:
    """The text and as many of the items, taken round and round, as bring it to ``budget`` words of white space.

    Items of no words do not fill; if there are none that do, the text stays alone.
    """
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    counted = F.filter(F.transform(items, lambda x: F.struct(x.alias("t"), words(x).alias("n"))), lambda e: e["n"] > 0)

    def grown(full: Column) -> Column:
        state = F.struct(text.alias("t"), words(text).alias("n"))
        rounds = F.sequence(F.lit(0), F.greatest(F.lit(0), F.lit(budget) - words(text)))

        def step(s: Column, k: Column) -> Column:
            item = F.get(full, F.pmod(k, F.size(full)))
            more = F.struct(F.concat(s["t"], F.lit(separator), item["t"]).alias("t"), (s["n"] + item["n"]).alias("n"))
            return F.when((s["n"] >= budget) | (F.size(full) == 0), s).otherwise(more)

        return F.aggregate(rounds, state, step)["t"]

    # the items are bound once, as the only element of an array, and not worked out again in every round
    return F.transform(F.array(counted), grown)[0]
