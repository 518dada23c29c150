"""Readers, writers, records and streams."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from relweave.sources import readers, writers
from relweave.sources.records import load_valid, parse_records, rejected


def test_txt_and_dispatch(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1->one->two\n2\n3->ü\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_info(spark, str(tmp_path / "a.txt")).orderBy("idx").collect()] == [(0, "1", "one->two"), (1, "2", None), (2, "3", "ü")]
    with pytest.raises(ValueError):
        readers.read_info(spark, "x.json")


def test_csv_round_trip(spark, tmp_path):
    rows = [(k, f"id{k}", t) for k, t in enumerate(['a,b "c"', "line\nbreak", None, "", "ü", "plain"])]
    info = spark.createDataFrame(rows, "idx bigint, identifier string, text string")
    writers.write_info(info, str(tmp_path / "o"))
    back = readers.read_csv(spark, str(tmp_path / "o"))
    assert {r.identifier: r.text for r in back.collect()} == {i: t or "" for _, i, t in rows}
    writers.write_info(info, str(tmp_path / "c"), clean=True)
    assert {r.text for r in readers.read_csv(spark, str(tmp_path / "c")).collect()} >= {"line break"}


def test_query_column(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("id\tText\n1\thello\n", encoding="utf-8")
    assert [r.text for r in readers.read_queries(spark, str(tmp_path / "q.tsv")).collect()] == ["hello"]
    assert readers.text_column(["a", "QUERY", "text"]) == "QUERY" and readers.text_column(["a", "b"]) == "a"
    assert readers.text_column(["text", "query"]) == "text" and readers.text_column(["text", "b"], "b") == "b"
    with pytest.raises(KeyError):
        readers.read_queries(spark, str(tmp_path / "q.tsv"), column="none")
    assert [r.text for r in readers.read_queries(spark, str(tmp_path / "q.tsv"), column="id").collect()] == ["1"]


def test_records_over_several_lines_and_splits(spark, tmp_path):
    """Files are split inside quoted fields, and yet every record comes out whole."""
    want = {}
    for part in range(3):
        lines = ["identifier,text"]
        for k in range(part * 400, part * 400 + 400):
            want[f"id{k}"] = t = f'a "{k}", b\n\nline {k}\n"' if k % 3 else f"plain {k}"
            lines.append(f'id{k},"{t.replace(chr(34), chr(34) * 2)}"' if k % 3 else f"id{k},{t}")
        (tmp_path / f"part-{part}.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = readers.read_csv(spark, str(tmp_path)).orderBy("idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.identifier: r.text for r in rows} == want
    assert [r.idx for r in rows] == list(range(1200)) and [r.identifier for r in rows] == [f"id{k}" for k in range(1200)]


def test_shards_npz_vectors_cache(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"part-{k}.tsv").write_text(f"id\tx\n{k}\ty\n")
    assert readers.read_shards(spark, str(tmp_path), "part").count() == 2
    with pytest.raises(FileNotFoundError):
        readers.read_shards(spark, str(tmp_path), "none")
    np.savez(tmp_path / "m.npz", data=np.array([1.0, 2.0]), indices=np.array([3, 0]), indptr=np.array([0, 1, 1, 2]))
    r = readers.import_npz(spark, str(tmp_path / "m.npz"))
    assert sorted(map(tuple, r.collect())) == [(0, 3, 1.0), (2, 0, 2.0)]
    writers.write_relation(r, str(tmp_path / "rel"))
    assert readers.read_relation(spark, str(tmp_path / "rel")).count() == 2
    v = spark.createDataFrame([("a", [1.0])], "id string, embedding array<float>")
    v.write.parquet(str(tmp_path / "v"))
    with pytest.raises(ValueError, match="1 vectors, not 2"):
        readers.read_vectors(spark, str(tmp_path / "v"), 2)
    calls = []
    make = lambda: calls.append(1) or v
    for _ in range(2):
        assert readers.cached(spark, "t", make, f"file://{tmp_path}").count() == 1
    assert len(calls) == 1
    readers.cached(spark, "t", make, f"file://{tmp_path}", {"top": 3})
    assert len(calls) == 2


def test_config_metrics_run(spark, tmp_path):
    writers.write_config(spark, str(tmp_path / "c.json"), "data", {"train": {"lbl_info": "a"}, "test": {}}, {"top": 3})
    assert readers.label_info_path(readers.read_config(spark, str(tmp_path / "c.json"), "data")) == "a"
    assert readers.expand_datasets("all", ["a/b", "c"], ("c",)) == [("a/b", "a-b")]
    m = spark.createDataFrame([("P", 1, 0.123456), ("P", 5, 0.5)], "metric string, k int, value double")
    writers.write_metrics(m, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"P@1": 0.12346, "P@5": 0.5}
    assert list(writers.collate_metrics(spark, {"x": str(tmp_path / "m.json"), "y": "none"})) == ["x"]
    run = spark.createDataFrame([("q", "d", 1.0), ("q", "ghost", 0.5)], "qid string, did string, score double")
    info = lambda n: spark.createDataFrame([(0, n)], "idx bigint, identifier string")
    known, unknown = writers.run_to_relation(run, info("q"), info("d"))
    assert known.count() == 1 and [r.did for r in unknown.collect()] == ["ghost"]
    assert writers.nested_run(run).first().docs == {"d": 1.0, "ghost": 0.5}
    r = spark.createDataFrame([(0, c, float(c)) for c in range(6)], "row_idx bigint, col_idx bigint, score double")
    block = readers.build_block({"lnk": r, "neg": r}, {"lnk": 3, "neg": None}, {"lnk": 2, "neg": 4})
    assert block["lnk"].count() == 2 and block["neg"].count() == 4
    blocks = readers.build_blocks({"train": {"lnk": r}, "test": {"lnk": r}}, {"train": {"top": {"lnk": 3}, "samples": {"lnk": 8}, "oversample": True}})
    assert blocks["train"]["lnk"].count() == 8 and blocks["train"]["lnk"].distinct().count() == 3 and blocks["test"]["lnk"].count() == 6


def test_early_fusion_skips_missing(spark, tmp_path):
    (tmp_path / "a-b.csv").write_text("identifier,text\n1,x\n2,y\n")
    rows, missing = readers.early_fusion_inputs(spark, ["a/b", "c", "d"], str(tmp_path) + "/{dataset}.csv", ("d",))
    assert rows.count() == 2 and missing == ["c"] and rows.first().dataset == "a/b"
    assert readers.early_fusion_inputs(spark, ["c"], str(tmp_path) + "/{dataset}.csv") == (None, ["c"])


ID = "lbl-000000001"
CASES = [
    (f"{ID},text", None), (f"{ID},text\r", None), (f'"{ID}","a ""b"" c, d"', None), (f'{ID},"a\nb\tc"', None), (f"{ID},NA", None), (f"{ID},a\\", None), (f'{ID}," x"', None),
    (f'{ID},a"b', "quoting"), (f'{ID},"ab', "quoting"), (f'{ID},"ab"c', "quoting"), (f'{ID}, "ab"', "quoting"), (f'{ID},"a"b"', "quoting"), ('"', "quoting"), (f'{ID},"""', "quoting"),
    ("", "columns"), (None, "columns"), (ID, "columns"), (f"{ID},a,b", "columns"), (",,", "columns"), (f'"{ID},a"', "columns"), ("\r", "columns"),
    (f"{ID},", "value"), (f'{ID},""', "value"), (f'{ID}," \t\n"', "value"), ("lbl-00000001,a", "value"), ("LBL-000000001,a", "value"), (" " + ID + ",a", "value"), ("lbl-00000000١,a", "value"),
    (f"{ID},a�", "value"), (f"{ID},a\x7f", "value"), (f'{ID},"a\x00"', "value"), (f"{ID},a\x1f", "value"), (",a", "value"), (f"{ID},\r\r", "value"), (f'{ID},""""', None),
]


def test_records(spark):
    df = spark.createDataFrame([(k, rec, "clash") for k, (rec, _) in enumerate(CASES)], "rec_no bigint, rec string, text string")
    rows = {r.rec_no: r for r in parse_records(df).collect()}
    assert [(CASES[k][0], rows[k].reason) for k in rows] == [(CASES[k][0], CASES[k][1]) for k in rows]
    assert (rows[2].identifier, rows[2].text) == (ID, 'a "b" c, d') and rows[0].broken_field is None
    assert all((rows[k].broken_field is None) == (CASES[k][1] is None) for k in rows)
    fields = {2: 2, 7: 2, 8: 2, 12: 1, 14: 2, 16: 2, 17: 3, 18: 3, 19: 2, 21: 2, 24: 1, 26: 1, 28: 2, 32: 1}
    assert {k: rows[k].broken_field for k in fields} == {k: None if CASES[k][1] is None else f for k, f in fields.items()}
    assert load_valid(df).count() + rejected(df).count() == len(CASES)
    assert parse_records(df.limit(0)).count() == 0


def test_long_records(spark):
    long = ID + ',"' + 'a""' * 300_000 + '"'
    df = spark.createDataFrame([(1, long), (2, long[:-1]), (3, ID + "," + "x" * 2_000_000)], "rec_no bigint, rec string")
    assert {r.rec_no: r.reason for r in parse_records(df).select("rec_no", "reason").collect()} == {1: None, 2: "quoting", 3: None}


def reference_reason(rec):
    """By a state machine, character by character."""
    rec = rec[:-1] if rec.endswith("\r") else rec
    fields, at = [], 0
    while True:
        if at < len(rec) and rec[at] == '"':
            out, at = "", at + 1
            while True:
                if at >= len(rec):
                    return "quoting"
                if rec[at] == '"':
                    if rec[at + 1 : at + 2] == '"':
                        out, at = out + '"', at + 2
                        continue
                    at += 1
                    break
                out, at = out + rec[at], at + 1
            if at < len(rec) and rec[at] != ",":
                return "quoting"
        else:
            end = rec.find(",", at)
            end = len(rec) if end < 0 else end
            out, at = rec[at:end], end
            if '"' in out:
                return "quoting"
        fields.append(out)
        if at >= len(rec):
            break
        at += 1
    if len(fields) != 2:
        return "columns"
    import re

    bad = re.search("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f�]", fields[1])
    return None if re.fullmatch("lbl-[0-9]{9}", fields[0]) and fields[1].strip(" \t\r\n") and not bad else "value"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet='",a \r\n\x01', max_size=8), min_size=1, max_size=40))
def test_records_equal_a_state_machine(spark, tails):
    recs = [t for t in tails] + [ID + t for t in tails] + [ID + "," + t for t in tails]

    df = spark.createDataFrame(list(enumerate(recs)), "rec_no bigint, rec string")
    for r in parse_records(df).select("rec_no", "reason").collect():
        assert r.reason == reference_reason(recs[r.rec_no]), repr(recs[r.rec_no])


def test_streams(spark, tmp_path):
    from relweave.streaming import relations as stream

    df = spark.createDataFrame([(0, 1, 0.5, "2025-01-01 00:00:00"), (0, 1, 0.7, "2025-01-01 01:00:00"), (None, 1, 0.7, "2025-01-01 01:00:00")], "row_idx bigint, col_idx bigint, score double, scored_at string")
    df.selectExpr("row_idx", "col_idx", "score", "to_timestamp(scored_at) AS scored_at").write.parquet(str(tmp_path / "in"))
    cells = stream.read_cells(spark, str(tmp_path / "in"))
    q = stream.best_cells(cells).writeStream.outputMode("update").format("memory").queryName("best").start()
    q.processAllAvailable()
    q.stop()
    assert [r.score for r in spark.table("best").collect()] == [0.7]
    target = str(tmp_path / "out")
    q = cells.filter("row_idx IS NOT NULL").writeStream.foreachBatch(lambda b, n: stream.upsert_relation(b, target, n)).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.read.parquet(target + "/version=0").select("row_idx", "col_idx", "score").collect()] == [(0, 1, 0.7)]
