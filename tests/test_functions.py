"""Text, vector and parsing functions."""

from pyspark.sql import functions as F

from relweave.functions import parse, text, vectors
from relweave.operators import vocabulary


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_clean_and_controls(spark):
    assert one(spark, text.clean(F.lit("İK Ab-c!\n"))) == "i k ab c"
    assert one(spark, text.clean(F.lit("a  b"))) == "a  b"
    assert one(spark, text.clean(F.lit(None).cast("string"))) is None
    assert one(spark, text.blank_controls(F.lit("a\tb\x7fc\x00"))) == "a b c "


def test_concatenations(spark):
    items = F.array(F.lit("m"), F.lit("n"))
    assert one(spark, text.joined(F.lit("q"), items)) == "q [SEP] m [SEP] n"
    assert one(spark, text.joined(F.lit("q"), F.array().cast("array<string>"))) == "q [SEP] "
    assert one(spark, text.with_categories(F.lit("q"), items)) == "q <CATEGORIES> m || n"
    assert one(spark, text.prompt("p: ", None, F.lit(None).cast("string"))) == "p: "
    assert one(spark, text.split_first(F.lit("a->b->c"), "->")) == ["a", "b->c"]


def test_fill_to_budget(spark):
    items = F.array(F.lit("a b"), F.lit(" "), F.lit("c"))
    assert one(spark, text.fill_to_budget(F.lit("q"), items, 6)) == "q [SEP] a b [SEP] c [SEP] a b"
    assert one(spark, text.fill_to_budget(F.lit("q"), F.array().cast("array<string>"), 6)) == "q"


def test_alternatives_are_drawn(spark):
    items = F.array(F.lit("a [SEP] b"), F.lit("c"))
    drawn = [one(spark, text.choose_alternatives(items, 6, F.lit(row), 3)) for row in range(12)]
    assert all(len(x) == 6 and x[1::2] == ["c"] * 3 and set(x[::2]) <= {"a", "b"} for x in drawn)
    assert {y for x in drawn for y in x} == {"a", "b", "c"} and len({tuple(x) for x in drawn}) > 1
    assert one(spark, text.choose_alternatives(F.array().cast("array<string>"), 6, F.lit(1), 3)) == []


def test_fences_with_line_breaks(spark):
    assert one(spark, text.strip_fences(F.lit('```json\n{"a": 1}\n``` \n'))) == '{"a": 1}'
    assert one(spark, text.strip_fences(F.lit("\u00a0\t a b \r\n"))) == "a b" and one(spark, text.strip_fences(F.lit(None).cast("string"))) is None


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert abs(one(spark, vectors.cosine(a, b)) - 0.96) < 1e-12
    assert one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, vectors.unit(F.array(F.lit(0.0)))) == [0.0]
    assert one(spark, vectors.squared_distance(a, b)) == 2.0


def test_triples(spark):
    rows = [
        ('```json\n{"triples": [["A-b", "is", "C"], ["x", "y"]]}\n```',),
        ('[["a", "b", "c"]]',),
        ("[['a', 'it''s', 3], ['d', \"e's\", 'f']]",),
        ('{"triples": []}',),
        ("nonsense",),
        (None,),
        ('[["a", "b", "c"], ["d", "e", "f"',),
        ('[["a", 1, "c"]]',),
        ("[" * 5000,),
    ]
    df = spark.createDataFrame(rows, "response string")
    out = [[tuple(t) for t in r.triples] for r in parse.parse_triples(df, "response").collect()]
    assert out[0] == [("a b", "is", "c")] and out[1] == [("a", "b", "c")]
    assert out[2][-1] == ("d", "e s", "f")
    assert out[3] == out[4] == out[5] == out[8] == []
    assert out[6] == [("a", "b", "c")] and out[7] == [("a", "1", "c")]


def test_json_list(spark):
    assert one(spark, parse.json_list(F.lit('```json{"queries": ["a", "b"]}```'))) == ["a", "b"]
    assert one(spark, parse.json_list(F.lit("oops"))) == []


def test_vocabulary(spark):
    df = spark.createDataFrame([(0, ["b", "a"]), (1, ["a", "c", "b", "a"]), (2, None), (3, [None])], "row bigint, items array<string>")
    v = vocabulary.first_seen(df, "row", "items")
    assert {r.token: r.idx for r in v.collect()} == {"b": 0, "a": 1, "c": 2}
    assert sorted(map(tuple, vocabulary.encoded(df, "row", "items", v).collect())) == [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 2.0), (1, 2, 1.0)]
