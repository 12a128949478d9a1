"""CSV under the strict rules (stdlib dialect, UTF-8, nothing skipped or padded) and a deterministic writer.

`spark.read.csv` drops blank lines, pads short rows and reads "" as null, and with line ends in
quotes it doesn't split files.  Here Spark's text source cuts a file of any size into byte ranges at
line feeds.  A first pass over each range finds how it ends and how many rows begin in it, once for
a start outside quotes and once for one inside (and, at a file's start, behind a byte-order mark).
Windows over a file's ranges chain those answers: the true state and row number at the start of each.
A second pass parses.  A row that goes on in later ranges is put together from its pieces.  The driver
holds a few numbers for each range of spark.sql.files.maxPartitionBytes.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmark.sources.paths import Files, work_folder

SCAN = "path string, row_no long, fields array<string>, code string"
PIECES = SCAN + ", start long, piece string"
SUMMARY = "file long, start long, size long, bytes long, bad boolean, plain boolean, quoted boolean, marked boolean, plain_rows long, quoted_rows long, marked_rows long"
BATCH_ROWS = 10_000
MARK = "\ufeff"


def ends_quoted(line: str, quoted: bool) -> bool:
    """Whether a line without its end leaves a quoted field open; quotes count at the start of a field only."""
    at = 0
    while True:
        if not quoted and line.startswith('"', at):
            quoted, at = True, at + 1
        while quoted:
            at = line.find('"', at)
            if at < 0:
                return True
            quoted = line.startswith('"', at + 1)
            at += 2 if quoted else 1
        at = line.find(",", at) + 1
        if not at:
            return False


def _lines(value: str) -> list[str]:
    """What the dialect takes as lines between two line feeds: a carriage return ends one, too."""
    value += "\n"
    return [value] if "\r" not in value else io.StringIO(value, newline="").readlines()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.Array]]:
    """((file, start, size), values): neighbouring rows of one byte range."""
    for batch in batches:
        file, start, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "start", "size"))
        cuts = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo < hi:
                yield (int(file[lo]), int(start[lo]), int(size[lo])), batch.column("value").slice(lo, hi - lo)


def _texts(values: pa.Array) -> pa.Array | None:
    try:
        return values.cast(pa.string())
    except pa.ArrowInvalid:
        return None


def _plain(texts: pa.Array) -> bool:
    """No quote, and no carriage return but before the line feed."""
    return not (pc.any(pc.match_substring(texts, '"')).as_py() or pc.any(pc.match_substring_regex(texts, "\r[^\r]|\r\r")).as_py())


@dataclass
class _Range:
    """What a byte range comes to for each of the three starts: outside quotes, inside, outside behind a mark."""

    key: tuple[int, int, int]
    bytes: int = 0
    bad: bool = False
    quoted: list[bool] = field(default_factory=lambda: [False, True, False])
    rows: list[int] = field(default_factory=lambda: [0, 0, 0])

    def add(self, values: pa.Array) -> None:
        first = self.bytes == 0
        self.bytes += pc.sum(pc.binary_length(values)).as_py() + len(values)
        texts = None if self.bad else _texts(values)
        if texts is None:
            self.bad = True
            return
        if _plain(texts):
            self.rows = [n + len(texts) * (not inside) for n, inside in zip(self.rows, self.quoted, strict=True)]
            return
        for text in texts.to_pylist():
            for line in _lines(text):
                bare, known = line.rstrip("\r\n"), {}
                for k, inside in enumerate(self.quoted):
                    self.rows[k] += not inside
                    marked = first and k == 2
                    if '"' in bare:
                        if marked or inside not in known:
                            after = ends_quoted(MARK * marked + bare, inside)
                            self.quoted[k] = after if marked else known.setdefault(inside, after)
                        else:
                            self.quoted[k] = known[inside]
                first = False

    def batch(self) -> pa.RecordBatch:
        values = [*self.key, self.bytes, self.bad, *self.quoted, *self.rows]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=[c.split()[0] for c in SUMMARY.split(", ")])


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for key, values in _runs(batches):
        if held is None or held.key != key:
            if held is not None:
                yield held.batch()
            held = _Range(key)
        held.add(values)
    if held is not None:
        yield held.batch()


def _starts(summary: DataFrame) -> DataFrame:
    """file, start, quoted, row_no, bad, mark, cut, open: how each range really begins; cut: the file ends in it without a line feed; open: it ends within quotes."""
    whole, order = Window.partitionBy("file"), Window.partitionBy("file").orderBy("start")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    extra = F.col("size") - F.sum("bytes").over(whole)
    rows = summary.withColumn("extra", extra).withColumn("mark", extra >= 2).withColumn("cut", (F.col("start") == F.max("start").over(whole)) & ~extra.isin(0, 3))
    head, mark = F.col("start") == 0, F.col("mark")
    plain = F.when(head & mark, F.col("marked")).otherwise(F.col("plain"))
    rows = rows.select("file", "start", "mark", "cut", F.bool_or("bad").over(whole).alias("bad"), plain.alias("after"), F.when(head, plain).otherwise(F.col("quoted")).alias("after_quoted"), F.when(head & mark, F.col("marked_rows")).otherwise(F.col("plain_rows")).alias("n"), F.col("quoted_rows").alias("n_quoted"))
    # A range settles the state if both starts end alike; else it keeps it or, where quotes pair up otherwise, turns it.
    turns = F.sum(F.when((F.col("after") != F.col("after_quoted")) & F.col("after"), 1).otherwise(0)).over(upto)
    rows = rows.withColumn("turns", turns)
    settled = F.when(F.col("after") == F.col("after_quoted"), F.struct(F.col("after").alias("state"), "turns"))
    rows = rows.withColumn("last", F.last(settled, True).over(before)).withColumn("turned", F.lag("turns").over(order))
    state = F.coalesce(F.col("last.state") != ((F.col("turned") - F.col("last.turns")) % 2 == 1), F.lit(False))
    rows = rows.withColumn("quoted", state)
    begun = F.sum(F.when(F.col("quoted"), F.col("n_quoted")).otherwise(F.col("n"))).over(before)
    ends_open = F.when(F.col("quoted"), F.col("after_quoted")).otherwise(F.col("after"))
    return rows.select("file", "start", "quoted", F.coalesce(begun, F.lit(0)).cast("long").alias("row_no"), "bad", (head & mark).alias("mark"), "cut", ends_open.alias("open"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])


def _code(row_no: int, fields: list[str]) -> str | None:
    return "ROW_EMPTY" if row_no and not fields else None


def _parse(known_bc, pieces: bool):
    """Whole rows, or (pieces) what ranges hold of rows that more than one range holds."""

    def parsed(path: str, row_no: int, lines: list[str]) -> Iterator[tuple]:
        for k, fields in enumerate(csv.reader(lines)):
            yield path, row_no + k, fields, _code(row_no + k, fields), None, None

    def of_range(key: tuple[int, int, int], runs: Iterator[pa.Array]) -> Iterator[tuple]:
        path, quoted, row_no, bad, mark, cut = known_bc.value[key[:2]]
        if bad:
            if key[1] == 0 and not pieces:
                yield path, 0, None, "FILE_NOT_UTF8", None, None
            return
        # `tail` is of a row that began in an earlier range; `row` is the one that is open now.
        tail, row, first = ([] if quoted else None), [], row_no
        for values in runs:
            whole: list[str] = []
            texts = _texts(values)
            if tail is None and not row and not mark and _plain(texts):
                if not pieces:
                    yield from parsed(path, row_no, [t + "\n" for t in texts.to_pylist()])
                row_no += len(texts)
                first = row_no
                continue
            for text in texts.to_pylist():
                for line in _lines(MARK + text if mark else text):
                    mark = False
                    inside = tail is not None or bool(row)
                    open_after = ends_quoted(line.rstrip("\r\n"), inside) if '"' in line else inside
                    if tail is not None:
                        tail.append(line)
                        if not open_after:
                            if pieces:
                                yield path, first - 1, None, None, key[1], "".join(tail)
                            tail = None
                    elif open_after:
                        row.append(line)
                    else:
                        whole += [*row, line]
                        row = []
                        row_no += 1
            if not pieces and whole:
                yield from parsed(path, first, whole)
            first = row_no
        if pieces and (tail or row):
            text = "".join(tail or row)
            yield path, (first - 1 if tail else row_no), None, None, key[1], text[:-1] if cut else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        held, source = [], _runs(batches)
        ahead = next(source, None)
        while ahead is not None:
            key = ahead[0]

            def same(key=key):
                nonlocal ahead
                while ahead is not None and ahead[0] == key:
                    yield ahead[1]
                    ahead = next(source, None)

            for row in of_range(key, same()):
                held.append(row)
                if len(held) == BATCH_ROWS:
                    yield _batch(held)
                    held = []
            for _ in same():
                pass
        if held:
            yield _batch(held)

    return run


def _joined(group: pa.Table) -> pa.Table:
    """A row from its pieces, in order."""
    csv.field_size_limit(2**31 - 1)
    path, row_no = group.column("path")[0].as_py(), group.column("row_no")[0].as_py()
    text = "".join(group.sort_by("start").column("piece").to_pylist())
    fields = next(csv.reader(io.StringIO(text, newline="")))
    return pa.table({"path": [path], "row_no": pa.array([row_no], pa.int64()), "fields": pa.array([fields], pa.list_(pa.string())), "code": pa.array([_code(row_no, fields)], pa.string())})


def scan(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """path, row_no (0 is the header), fields, code.

    Codes: FILE_NOT_UTF8 and FILE_EMPTY (one row of the file, no fields), ROW_EMPTY.  A header keeps
    its byte-order mark, which `header_problems` reports.
    """
    text = spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    lines = text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))
    names = [p.replace("file:///", "file:/", 1) for p in text.inputFiles()]
    listed = {r.file: unquote(r.name) for r in spark.createDataFrame([(n,) for n in names], "name string").select("name", F.xxhash64("name").alias("file")).collect()}
    if len(listed) < len(names):
        raise ValueError("two paths share a digest; scan them apart")
    found = _starts(lines.mapInArrow(_summarise, SUMMARY)).collect()
    known = {(r["file"], r["start"]): (listed[r["file"]], r["quoted"], r["row_no"], r["bad"], r["mark"], r["cut"]) for r in found}
    seen = {file for file, _ in known}
    # Spark's listing knows files without a byte, or of a mark alone, but no task gets them.
    bare = [(listed[f], Files(spark, listed[f])) for f in listed if f not in seen]
    empty = [(p, 0, None, "FILE_EMPTY") if not files.fs.getFileStatus(files.path).getLen() else (p, 0, [MARK], None) for p, files in bare]
    shared = spark.sparkContext.broadcast(known)
    out = lines.mapInArrow(_parse(shared, False), PIECES).select("path", "row_no", "fields", "code").unionByName(spark.createDataFrame(empty, SCAN))
    unfinished = {r["file"] for r in found if r["open"] and not r["bad"]}
    if not unfinished:
        return out
    some = lines.where(F.col("file").isin(*unfinished)) if len(unfinished) < 1000 else lines
    return out.unionByName(some.mapInArrow(_parse(shared, True), PIECES).groupBy("path", "row_no").applyInArrow(_joined, SCAN))


def header_problems(header: Column, expected: list[str]) -> Column:
    """Array of (code, column): the mark, doubled, missing and extra names, or else only a wrong order."""
    want = F.array(*[F.lit(c) for c in expected])
    marked = F.coalesce(F.startswith(F.get(header, F.lit(0)), F.lit(MARK)), F.lit(False))
    names = F.transform(header, lambda c, i: F.when(i == 0, F.regexp_replace(c, f"^{MARK}+", "")).otherwise(c))
    problem = lambda code, c: F.struct(F.lit(code).alias("code"), c.cast("string").alias("column"))
    each = lambda code, cs: F.transform(cs, lambda c: problem(code, c))
    doubled = F.filter(names, lambda c, i: (i > 0) & F.array_contains(F.slice(names, F.lit(1), i), c))
    named = F.concat(each("HEADER_DUPLICATE_COLUMN", doubled), each("HEADER_MISSING_COLUMN", F.array_except(want, names)), each("HEADER_EXTRA_COLUMN", F.array_sort(F.array_except(names, want))))
    order = F.when((F.size(named) == 0) & (names != want), F.array(problem("HEADER_ORDER", F.lit(None)))).otherwise(F.array().cast("array<struct<code:string,column:string>>"))
    mark = F.when(marked, F.array(problem("HEADER_BOM", F.lit(None)))).otherwise(F.array().cast("array<struct<code:string,column:string>>"))
    return F.concat(mark, named, order)


def checked(scanned: DataFrame, expected: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, problems).  Rows: path, row_no and one string column per expected name, by the file's own
    column order.  Problems: path, row_no, code, column.  A file whose header lacks a name, has one too
    many or has one twice gives no rows; one with a mark or another order does, beside the problem."""
    heads = scanned.where("row_no = 0 AND fields IS NOT NULL").select("path", F.transform("fields", lambda c, i: F.when(i == 0, F.regexp_replace(c, f"^{MARK}+", "")).otherwise(c)).alias("names"), header_problems(F.col("fields"), expected).alias("found"))
    usable = heads.where(F.array_sort("names") == F.array_sort(F.array(*[F.lit(c) for c in expected]))).select("path", "names")
    body = scanned.where("row_no > 0").join(usable, "path")
    code = F.coalesce("code", F.when(F.size("fields") != len(expected), "ROW_FIELD_COUNT"))
    none = F.lit(None).cast("string").alias("column")
    problems = heads.select("path", F.lit(0).cast("long").alias("row_no"), F.inline("found")).unionByName(scanned.where("fields IS NULL").select("path", "row_no", "code", none)).unionByName(body.select("path", "row_no", code.alias("code"), none).where("code IS NOT NULL"))
    value = lambda c: F.get("fields", F.array_position("names", F.lit(c)).cast("int") - 1).alias(c)
    rows = body.where(code.isNull()).select("path", "row_no", *[value(c) for c in expected])
    return rows, problems


def line(columns: list[Column]) -> Column:
    """A CSV line with quotes only where they are needed; null is an empty field."""

    def field(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(text.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    if len(columns) == 1:
        return F.when(F.coalesce(columns[0].cast("string"), F.lit("")) == "", '""').otherwise(field(columns[0]))
    return F.concat_ws(",", *[field(c) for c in columns])


def write(df: DataFrame, path: str, order: list[str]) -> None:
    """One UTF-8 file with a header, LF, rows in `order`, replaced atomically.  Rows are sorted and
    written in the cluster; the driver only streams the sorted pieces together."""
    spark = df.sparkSession
    staged = work_folder(spark, "csv")
    head = spark.createDataFrame([tuple(df.columns)], ", ".join(f"c{i} string" for i in range(len(df.columns))))
    head.select(line([F.col(c) for c in head.columns]).alias("value")).coalesce(1).write.text(f"{staged}/head")
    df.orderBy(*order).select(line([F.col(f"`{c}`") for c in df.columns]).alias("value")).write.text(f"{staged}/body")
    try:
        Files(spark, f"{staged}/part-0").join(f"{staged}/head")
        Files(spark, f"{staged}/part-1").join(f"{staged}/body")
        Files(spark, path).join(staged)
    finally:
        work = Files(spark, staged)
        work.fs.delete(work.path, True)
