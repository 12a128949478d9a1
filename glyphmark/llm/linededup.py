"""Line dedup over levelled sorted runs of line hashes, in DataFrame functions only.

A run is a table (h1, h2, n_docs, last_doc) bucketed and sorted by its line hashes in the
shared folder, so runs are merged with each other and with a batch without dealing them out
again.  Batches are ranges of doc_id, the largest first.  So a line's keeper, its largest
document, is known from the batch that first holds it.  A line that a run knows to be in
MIN_DOCS documents is settled: each new batch is merge-anti-joined with the runs, and only
what is not settled enters the batch's own run at level 0.  FANOUT runs of a level are
merged into one run of the next, so a line is rewritten a logarithmic number of times.

A line's key is the line stripped of `[\\x20\\x09-\\x0D]` with A-Z lower-cased, held as two
64-bit hashes.  Keys of at least MIN_CHARS code points found in at least MIN_DOCS
documents lose all their lines but those of the largest doc_id.

A null text is one empty line.  A null doc_id counts as the smallest document.  Rows that
repeat a doc_id are one document for the counts; each row keeps or loses its own lines.
Only `doc_id` and `text` are read; other columns may have any name.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmark.llm.common import remove_path, stored, table, text_key, work_path

MIN_CHARS, MIN_DOCS = 40, 5
BATCHES, FANOUT = 4, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
LEAST = -(2**63)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Strips and lower-cases A-Z; of an ASCII line lower() does just that, and faster."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def counted(batch: DataFrame) -> DataFrame:
    """h1, h2, n_docs, last_doc of a batch (doc, h1, h2); a hot line is summed before it is dealt out."""
    once = batch.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
    return once.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc"))


def merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two runs as one; each has a line once."""
    a, b = left.hint("merge").alias("a"), right.alias("b")
    total = F.coalesce("a.n_docs", F.lit(0)) + F.coalesce("b.n_docs", F.lit(0))
    both = a.join(b, (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "full_outer")
    return both.select(F.coalesce("a.h1", "b.h1").alias("h1"), F.coalesce("a.h2", "b.h2").alias("h2"), total.alias("n_docs"), F.greatest("a.last_doc", "b.last_doc").alias("last_doc"))


@dataclass
class LineRuns:
    """The levelled runs; `levels[k]` lists the names of level k's tables."""

    spark: SparkSession
    root: str
    buckets: int
    min_docs: int = MIN_DOCS
    fanout: int = FANOUT
    levels: list[list[str]] = field(default_factory=lambda: [[]])

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.root}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove_path(self.spark, f"{self.root}/{name}")

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def unsettled(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch (h1, h2, ...) whose line no run has in min_docs documents: the merge-anti-join."""
        for run in self.tables():
            batch = batch.join(run.where(F.col("n_docs") >= self.min_docs).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return batch

    def ingest(self, batch: DataFrame) -> None:
        """batch: (doc, h1, h2) of documents smaller than all before.  Adds the run of what is not settled."""
        self._write(self.unsettled(counted(batch)), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(reduce(merged, [self.spark.table(name) for name in old]), level + 1)
            for name in old:
                self._remove(name)
            level += 1

    def folded(self) -> DataFrame:
        """All runs as one."""
        return reduce(merged, self.tables())

    def clear(self) -> None:
        for name in [name for level in self.levels for name in level]:
            self._remove(name)
        self.levels = [[]]


def _doc(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(LEAST))


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    keyed = docs.select(_doc(docs).alias("doc"), text_key(docs["text"]).alias("row"), F.posexplode(lines_of(docs["text"])).alias("pos", "line"))
    keyed = keyed.where(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    return keyed.select("doc", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped_positions(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """doc, row, gone: the positions of the lines that each document row loses.  Rows that lose none are missing."""
    spark = docs.sparkSession
    root = work_path(spark, "lines")
    edges = docs.select(_doc(docs).alias("doc")).stat.approxQuantile("doc", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    batch = sum([F.when(F.col("doc") <= int(e), 1).otherwise(0) for e in edges], F.lit(0))
    _occurrences(docs, min_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(f"{root}/occurrences")
    seen = spark.read.schema("doc long, row long, pos int, h1 long, h2 long, batch int").parquet(f"{root}/occurrences")
    runs = LineRuns(spark, root, int(spark.conf.get("spark.sql.shuffle.partitions")), min_docs)
    for b in range(len(edges) + 1):
        runs.ingest(seen.where(F.col("batch") == b).drop("batch"))
    frequent = runs.folded().where(F.col("n_docs") >= min_docs).select("h1", "h2", "last_doc")
    lost = seen.join(frequent.hint("merge"), ["h1", "h2"]).where("doc <> last_doc")
    out = stored(lost.groupBy("doc", "row").agg(F.collect_set("pos").alias("gone")), "lost-lines")
    runs.clear()
    remove_path(spark, root)
    return out


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """doc_id, text (the lines that stay), n_lines, n_dropped; one row for each row of docs."""
    lost = dropped_positions(docs, min_chars, min_docs, batches)
    left = docs.select("doc_id", "text", _doc(docs).alias("doc"), text_key(F.col("text")).alias("row"))
    out = left.join(lost.hint("merge"), ["doc", "row"], "left").withColumn("lines", lines_of(F.col("text")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda p: F.get("lines", p)), "\n"))
    return out.select("doc_id", kept.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """The documents with all their columns, the text cut to the lines that stay; a text without lines to drop is left as it is."""
    lost = dropped_positions(docs, min_chars, min_docs, batches).select(F.col("doc").alias("__doc"), F.col("row").alias("__row"), F.col("gone").alias("__gone"))
    mine = (_doc(docs) == F.col("__doc")) & (text_key(docs["text"]) == F.col("__row"))
    out = docs.join(lost.hint("merge"), mine, "left")
    lines = lines_of(docs["text"])
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__gone")
    kept = F.when(F.col("__gone").isNull(), docs["text"]).otherwise(F.array_join(F.transform(stay, lambda p: F.get(lines, p)), "\n"))
    return out.select(*[kept.alias("text") if c == "text" else docs[c] for c in docs.columns])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (SELECT doc_id, i, ls[i] AS line, len(ls) AS n FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, f.key IS NOT NULL AND doc_id <> last_doc AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
