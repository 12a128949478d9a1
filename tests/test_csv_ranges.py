"""The strict scan over many small byte ranges against the stdlib's reader over whole files."""

import csv
import io
import random

import pytest

from glyphmark.sources import csvfiles


def _whole(data: bytes):
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return [(0, None, "FILE_NOT_UTF8")]
    rows = list(csv.reader(io.StringIO(text, newline="")))
    return [(k, r, "ROW_EMPTY" if k and not r else None) for k, r in enumerate(rows)] or [(0, None, "FILE_EMPTY")]


def _random(rng):
    alphabet = rng.choice(['ab,"\n', 'a,"\r\n', 'a"\n', 'aé,\n', 'a,"\n\r'])
    return "".join(rng.choices(alphabet, k=rng.randint(0, 400))).encode()


@pytest.mark.parametrize("size", [24, 150])
def test_any_cut_gives_the_same_rows(spark, tmp_path, size):
    rng, files = random.Random(size), {}
    for k in range(24):
        data = _random(rng)
        files[f"f{k}.csv"] = [b"", b"\xef\xbb\xbf"][k % 3 == 0] + data + [b"", b"\n", b'\n"open ' + b"x\n" * 200][k % 3]
    files |= {"empty.csv": b"", "mark only.csv": b"\xef\xbb\xbf", "bad%20.csv": b"id\n" + b"a\n" * 300 + b"\xff\n", "marked.csv": b'\xef\xbb\xbf"a\nb",c\n"d\ne"\n' + b"1,2\n" * 100}
    files["long field.csv"] = b'x,"' + b'line, of ""quotes"" \r\n' * 300 + b'" and more,y\n1,2'
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = {}
        for r in csvfiles.scan(spark, str(tmp_path)).collect():
            got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.row_no, r.fields, r.code))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got.keys() == files.keys()
    for name, data in files.items():
        assert sorted(got[name], key=lambda r: r[0]) == _whole(data), name


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,text\n" + "".join(f'{k},"line\n{k}"\n' for k in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        scanned = csvfiles.scan(spark, str(tmp_path))
        assert scanned.rdd.getNumPartitions() > 10
        rows, problems = csvfiles.checked(scanned, ["id", "text"])
        assert problems.isEmpty() and {(r.row_no, r.id, r.text) for r in rows.collect()} == {(k + 1, str(k), f"line\n{k}") for k in range(20_000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
