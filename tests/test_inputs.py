"""File scans and sinks, digests, counters of streams and reruns."""

import csv
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from glyphmark.functions.digest import config_digest
from glyphmark.plans.report import markdown_table, sections
from glyphmark.sources import csvfiles, jsonfiles
from glyphmark.sources.paths import write_json
from glyphmark.streaming import counters

NAMES = ["id", "text"]


def codes(spark, tmp_path, data: bytes):
    (tmp_path / "x.csv").write_bytes(data)
    rows, problems = csvfiles.checked(csvfiles.scan(spark, str(tmp_path)), NAMES)
    return sorted(tuple(r)[1:] for r in rows.collect()), sorted((r.row_no, r.code, r.column or "") for r in problems.collect())


@pytest.mark.parametrize(
    ("data", "rows", "problems"),
    [
        (b"", [], [(0, "FILE_EMPTY", "")]),
        (b"id,text\n", [], []),
        (b"id,text\n1,\xff\n", [], [(0, "FILE_NOT_UTF8", "")]),
        (b"\xef\xbb\xbfid,text\n1,a\n", [(1, "1", "a")], [(0, "HEADER_BOM", "")]),
        (b"text,id\na,1\n", [(1, "1", "a")], [(0, "HEADER_ORDER", "")]),
        (b"id,id,more\n1,2,3\n", [], [(0, "HEADER_DUPLICATE_COLUMN", "id"), (0, "HEADER_EXTRA_COLUMN", "more"), (0, "HEADER_MISSING_COLUMN", "text")]),
        (b'id,text\n1,"a\nb"\n\n2\n3,""\n4,NA\n', [(1, "1", "a\nb"), (4, "3", ""), (5, "4", "NA")], [(2, "ROW_EMPTY", ""), (3, "ROW_FIELD_COUNT", "")]),
    ],
)
def test_strict_scan(spark, tmp_path, data, rows, problems):
    assert codes(spark, tmp_path, data) == (rows, problems)


def test_scan_gives_more_rows_than_a_batch_holds(spark, tmp_path):
    n = csvfiles.BATCH_ROWS * 2 + 7
    (tmp_path / "x.csv").write_text("id,text\n" + "".join(f"{i},t\n" for i in range(n)))
    assert csvfiles.scan(spark, str(tmp_path)).agg(F.count("*"), F.max("row_no")).first()[:] == (n + 1, n)


def test_csv_sink_is_exact_and_can_be_run_again(spark, tmp_path):
    rows = [(3, 'a "q", b'), (1, "plain"), (2, None), (4, "line\nend"), (5, "ü")]
    df, path = spark.createDataFrame(rows, "id int, text string").repartition(3), tmp_path / "out.csv"
    for _ in range(2):
        csvfiles.write(df, str(path), ["id"])
        with path.open(newline="", encoding="utf8") as f:
            assert list(csv.reader(f)) == [["id", "text"], *[[str(i), t or ""] for i, t in sorted(rows)]]
    assert path.read_bytes().startswith(b'id,text\n1,plain\n2,\n3,"a ""q"", b"\n')
    assert [p.name for p in tmp_path.iterdir() if p.name.endswith(".part")] == []
    csvfiles.write(df.where("false"), str(path), ["id"])
    assert path.read_text() == "id,text\n"


def test_records_are_known_by_the_id_inside(spark, tmp_path):
    for name, value in (("a.json", {"id": "a", "n": 1}), ("b copy.json", {"id": "a", "n": 1}), ("c d+e%.json", {"id": "c d+e%", "n": 2}), ("d.json.1.part", {"id": "d"})):
        (tmp_path / name).write_text(json.dumps(value, indent=1))
    (tmp_path / "e.json").write_text("{")
    good, bad = jsonfiles.records(spark, str(tmp_path), "id string, n long", "id")
    assert sorted(tuple(r) for r in good.collect()) == [("a", 1), ("c d+e%", 2)]
    assert sorted(r.file for r in bad.collect()) == ["b copy.json", "e.json"]
    found = {r.path.rsplit("/", 1)[1]: r.sha256 for r in jsonfiles.digests(spark, str(tmp_path), "a.json").collect()}
    assert found == {"a.json": hashlib.sha256((tmp_path / "a.json").read_bytes()).hexdigest()}


def test_json_sink_sorts_keys_and_replaces(spark, tmp_path):
    path = tmp_path / "r.json"
    for n in (1, 2):
        write_json(spark, {"b": n, "a": "é"}, str(path))
    assert path.read_text(encoding="utf8") == '{\n  "a": "é",\n  "b": 2\n}\n'


def test_digest_ignores_the_order_of_keys():
    assert config_digest({"a": 1, "b": [2]}) == config_digest({"b": [2], "a": 1}) == hashlib.sha256(b'{"a": 1, "b": [2]}').hexdigest()[:12]
    assert config_digest({"a": 1}) != config_digest({"a": "1"})


def test_counters_add_up_over_restarts(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    for part in ([("a", 1.0), ("b", None)], [("a", 2.0), (None, 5.0)]):
        spark.createDataFrame(part, "k string, v double").write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, v double").parquet(source)
        counters.append(stream, ["k"], ["v"], folder).awaitTermination()
    assert {r.k: (r.n, r.v) for r in counters.totals(spark, ["k"], ["v"], folder).collect()} == {"a": (2, 3.0), "b": (1, 0.0), None: (1, 5.0)}


def test_totals_before_anything_came(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("k string, v double").parquet(str(tmp_path / "in"))
    counters.append(stream, ["k"], ["v"], str(tmp_path / "state")).awaitTermination()
    assert counters.totals(spark, ["k"], ["v"], str(tmp_path / "state"), stream.schema).collect() == []


def test_pending_work(spark):
    wanted = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "i int, p string")
    done = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, None)], "i int, p string")
    assert [r.i for r in counters.pending(wanted, done, "i", "p").collect()] == []
    assert [r.i for r in counters.pending(wanted, done, "i", "p", True).collect()] == [2]


def test_report_pads_and_spells_missing_values(spark):
    df = spark.createDataFrame([("ALL", 0.5, None), ("a|b", None, 3)], "grp string, rate double, n int")
    assert markdown_table(["x", "long name"], [["1", "2"]]) == "| x | long name |\n| - | --------- |\n| 1 | 2         |"
    text = sections("Run", {"engine": "e"}, {"Rates": df})
    assert text.splitlines()[0] == "# Run" and "- engine: e" in text and "## Rates" in text
    assert text.endswith("| grp  | rate   | n |\n| ---- | ------ | - |\n| ALL  | 0.5000 | — |\n| a\\|b | —      | 3 |\n")
