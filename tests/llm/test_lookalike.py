import unicodedata

import pytest

from relweave.llm import lookalike

SAME = [
    ("Café no. 5", "Café no. 5"), ("abc 123", "ａｂｃ　１２３"), ("a b", "a b"), ("a b", "a b"), ("word", "wo​rd"), ("word", "wo­rd"),
    ("scope", "ѕсоре"), ("file", "ﬁle"), ("Tel", "Ｔｅӏ"), ("é", "е́"), ("ë", "ё"), ("á", "а́"), ("wait", "w⁠a﻿i‍t"),
    ("ậ", "ậ"), ("ậ", "ậ"), ("é", "e‍́"), ("m²", "m2"), ("…", "..."), ("Ω", "Ω"), ("stone", "ﬆone"), ("goggle", "ɡoɡɡle"), ("tab x", "tab\tx"), ("cope", "ϲope"), ("ϲope", "ςope"), ("COPE", "ϹOPE"), ("Vote", "Ꮩоte"),
]
OTHER = [("Word", "word"), ("cafe", "café"), ("file 1", "file 2"), ("a b", "a  b"), ("a b", "ab"), ("ну", "нь"), ("l1", "l7"), ("ż", "z"), ("ο", "σ"), ("гad", "rad"), ("γ", "y")]


@pytest.fixture(scope="module")
def forms(spark):
    texts = sorted({t for p in SAME + OTHER for t in p} | {"", "plain ascii", "​", "x" * 300_000 + "é"})
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)] + [(-1, None, "clash")], "id bigint, text string, form string")
    return {r.text: r.form for r in lookalike.with_form(df, ["id"]).collect()}


def test_same(forms):
    assert [p for p in SAME if forms[p[0]] != forms[p[1]]] == []


def test_other(forms):
    assert [p for p in OTHER if forms[p[0]] == forms[p[1]]] == []


def test_null_and_empty(forms):
    assert forms[None] is None and forms[""] == "" and forms["​"] == "" and forms["plain ascii"] == "plain ascii"


def test_form_is_stable(spark, forms):
    again = spark.createDataFrame([(k, f) for k, f in enumerate(sorted(set(forms.values()) - {None}))], "id bigint, text string")
    assert [r for r in lookalike.with_form(again, ["id"]).collect() if r.text != r.form] == []


def test_tables_follow_compatibility_forms(spark):
    one, several = lookalike._tables()
    for c, to in {**one, **several}.items():
        plain = unicodedata.normalize("NFKC", c)
        if plain.isascii():
            assert to == plain or to.replace(" ", "") == plain.replace(" ", "")


def test_pairs(spark):
    rows = [("a", "scope"), ("b", "ѕсоре"), ("c", "scope"), ("d", None), ("e", ""), ("f", "​"), ("g", "Scope"), ("a", "scope"), (None, "ѕcope"), ("b2", "ѕсоре")]
    got = {tuple(r) for r in lookalike.same_looking_pairs(spark.createDataFrame(rows, "identifier string, text string")).collect()}
    assert got == {("a", "b"), ("b", "c"), ("a", "b2"), ("b2", "c")}
    assert lookalike.same_looking_pairs(spark.createDataFrame([], "identifier string, text string")).count() == 0


def test_letters_of_one_script_stay_apart(spark):
    letters = lookalike.letters()
    added = {c: to for c, to in letters.items() if c not in "".join(lookalike.LOOK_ALIKES.values())}
    assert len(added) > 40 and all(c.isupper() == to.isupper() for c, to in letters.items())
    keys = [(lookalike._script(c), to) for c, to in added.items()]
    assert len(set(keys)) == len(keys)
