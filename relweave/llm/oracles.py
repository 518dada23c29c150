"""SQL counterparts that need tables of their own. They share no code with the operators they check."""

from __future__ import annotations

import unicodedata
from functools import cache

# Letters of the Greek, Cyrillic and Armenian alphabets, and a few of Latin extensions, and
# below each the basic Latin letter of its shape.
_SHAPED = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿαινορςυϲϳАВЕЅІЈКМНОРСТХҮӀԌԚԜаеѕіјорсухѡѵүһӏԁԛԝՍՏՕԼզհոսցօıɑɡ"
_LATIN = "ABEZHIKMNOPTYXCJaivopcucjABESIJKMHOPCTXYIGQWaesijopcyxwvyhldqwUSOLqhnugoiag"


@cache
def _forms() -> tuple[list[str], list[str]]:
    """Characters beyond ASCII, and what a reader sees in each: compatibility forms taken apart, letters by their shape."""
    table = str.maketrans(_SHAPED, _LATIN)
    seen, forms = [], []
    for code in range(0x80, 0x20000):
        c = chr(code)
        if 0xAC00 <= code <= 0xD7A3 or unicodedata.category(c) in ("Cs", "Co", "Cn"):
            continue
        form = c.translate(table)
        if form == c:
            form = unicodedata.normalize("NFC", unicodedata.normalize("NFKD", c).translate(table))
        form = "".join(" " if x.isspace() else x for x in form)
        if form != c:
            seen.append(c)
            forms.append(form)
    return seen, forms


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def look_sql(rows: str, rest: str) -> str:
    """``rest`` over f (identifier, text, form) of ``rows`` (identifier, text): texts are taken apart into characters, each is
    looked up, and they are put together again."""
    hidden = [chr(k) for k in range(0x80, 0xE01F0) if unicodedata.category(chr(k)) == "Cf"]
    hidden += [chr(k) for k in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))]
    seen, forms = _forms()
    blanks = ["\t", "\n", "\x0b", "\x0c", "\r"]
    return f"""WITH r AS ({rows}), m AS (SELECT unnest({_list([*seen, *blanks])}) AS c, unnest({_list([*forms, *([' '] * len(blanks))])}) AS shown),
    x AS (SELECT text, nfc_normalize(array_to_string(list_filter(regexp_extract_all(text, '(?s).'), lambda c: NOT list_contains({_list(hidden)}, c)), '')) AS seen
      FROM (SELECT DISTINCT text FROM r WHERE text IS NOT NULL)),
    p AS (SELECT text, unnest(regexp_extract_all(seen, '(?s).')) AS c, generate_subscripts(regexp_extract_all(seen, '(?s).'), 1) AS place FROM x),
    g AS (SELECT text, nfc_normalize(string_agg(coalesce(m.shown, p.c), '' ORDER BY place)) AS form FROM p LEFT JOIN m ON p.c = m.c GROUP BY text),
    f AS (SELECT identifier, r.text, CASE WHEN r.text IS NOT NULL THEN coalesce(form, '') END AS form FROM r LEFT JOIN g ON r.text = g.text) {rest}"""


#: Overlaps of items and documents on every diagonal, from all pairs of equal words. The masks are the operator's.
LEAK_SQL = """
WITH iw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS p
  FROM (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE item_id IS NOT NULL)),
dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p
  FROM (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL)),
eq AS (SELECT item_id, doc_id, n, CASE WHEN n >= 12 THEN 12 WHEN n >= 6 THEN 6 ELSE n END AS span, iw.p, dw.p - iw.p AS shift FROM iw JOIN dw USING (word)),
d AS MATERIALIZED (SELECT * FROM eq QUALIFY count(*) OVER (PARTITION BY item_id, doc_id, shift) >= CASE span WHEN 12 THEN 9 WHEN 6 THEN 5 ELSE span END),
masks AS (SELECT mask, len(mask) AS span, len(replace(mask, '0', '')) AS weight
  FROM (SELECT unnest(['111011010111', '110101101111', '101110111011', '110111', '111011', '11111', '1111', '111', '11', '1']) AS mask)),
places AS (SELECT *, unnest(range(span)) AS off FROM masks),
seeds AS (SELECT DISTINCT item_id, doc_id, shift, start FROM (
  SELECT item_id, doc_id, shift, mask, p - off AS start FROM d JOIN places USING (span) WHERE mask[off + 1] = '1'
  GROUP BY item_id, doc_id, shift, mask, p - off, weight HAVING count(*) = weight)),
isles AS (SELECT *, sum(fresh) OVER (PARTITION BY item_id, doc_id, shift ORDER BY p) AS isle FROM (
  SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY item_id, doc_id, shift ORDER BY p) > 3 THEN 1 ELSE 0 END AS fresh,
    p - row_number() OVER (PARTITION BY item_id, doc_id, shift ORDER BY p) AS run FROM d)),
runs AS (SELECT item_id, doc_id, shift, isle, run, count(*) AS len, min(p) AS low, max(p) AS high FROM isles GROUP BY ALL),
spans AS (SELECT item_id, doc_id, shift, isle, max(len) AS exact, min(low) AS low, max(high) AS high, sum(len) AS same FROM runs GROUP BY ALL),
seeded AS (SELECT DISTINCT s.* FROM spans s JOIN seeds h USING (item_id, doc_id, shift) WHERE h.start BETWEEN s.low AND s.high)
SELECT item_id, doc_id, max(exact)::INTEGER AS exact_run, (max(row(high - low + 1, same))[1])::INTEGER AS overlap_words,
  (max(row(high - low + 1, same))[1] - max(row(high - low + 1, same))[2])::INTEGER AS substituted FROM seeded GROUP BY item_id, doc_id
"""
