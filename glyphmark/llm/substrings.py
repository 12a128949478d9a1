"""Substring dedup by factors against an index of reference blocks, after relative Lempel-Ziv.

A reference block is the run of consecutive WINDOW-word windows that share one minimizer
(the least of their GRAM-word hashes), so equal windows always lie in blocks of an equal
minimizer, wherever their documents put them.  The index keeps, for each distinct block,
the place where it occurs first.  Each block of a document is looked up, and neighbouring
hits whose first places adjoin are one factor.  This isn't the greedy longest match of a
true parse, so one long copy may be several factors; what is removed is the same.  A
block that first occurs here, but whose minimizer also lies in other blocks, is a factor
boundary: its windows are looked up one by one.  Every factor of at least WINDOW words is
a duplicate span.  Blocks whose minimizer occurs once in the corpus are never looked up.

The result is exact (two 64-bit hashes for each comparison): a word goes if a window that
holds it also starts earlier, in a smaller doc_id or earlier in the same document.

Null or short texts lose nothing.  Rows that repeat a doc_id with another text are ordered
by a hash of the text; such rows with the same text are one document.  A null doc_id is
the smallest.  Only `doc_id` and `text` are read; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmark.llm.common import stored, table
from glyphmark.llm.textcore import SPACE, _power_tables, chunks, mix, windows

WINDOW, GRAM = 20, 8
SPREAD = WINDOW - GRAM + 1


def _argmin(g: np.ndarray) -> np.ndarray:
    """For each window of SPREAD values the place of the least, the leftmost of equal ones."""
    at, width = np.arange(len(g)), 1
    while width < SPREAD:
        step = min(width, SPREAD - width)
        left, right = at[:-step], at[step:]
        at = np.where(g[left] <= g[right], left, right)
        width += step
    return at


def _blocks(h: np.ndarray, first: np.ndarray):
    """(row, start, n, minimizer hash, block hash) of all blocks of a chunk."""
    none = np.zeros(0, np.int64)
    n = len(h) - WINDOW + 1
    if n <= 0:
        return none, none, none, none, none
    g = windows(h, GRAM, 7)
    at = _argmin(g)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    p = np.arange(n)
    valid = p + WINDOW <= first[row[:n] + 1]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (at[1:n] != at[: n - 1])
    start = np.flatnonzero(new)
    if not len(start):
        return none, none, none, none, none
    count = np.add.reduceat(valid.astype(np.int64), start)
    powers, inverse = _power_tables(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers[: len(h)], out=sums[1:])
    block = mix((sums[start + count + WINDOW - 1] - sums[start]) * inverse[start] + count.astype(np.uint64))
    return row[start], start - first[row[start]], count, g[at[start]].view(np.int64), block.view(np.int64)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, tag = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc", "tag"))
        for c in chunks(batch.column("text"), False, SPACE):
            row, start, count, anchor, block = _blocks(c.hashes(), c.first)
            place = (tag[c.lo + row] << 32) | (start << 4) | count
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(block), pa.array(doc[c.lo + row]), pa.array(place)], names=["anchor", "block", "doc", "place"])


#: place: 31 bits of the text's hash, 28 of the first word, 4 of the number of windows.
START = "((place >> 4) & 268435455)"


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _factors(hits: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, windows, ref doc, ref start), joined while they go on in the same reference; lengths become words."""
    out: list[list[int]] = []
    for s, n, d, r in sorted(hits):
        if out and (out[-1][0] + out[-1][1], out[-1][2], out[-1][3] + out[-1][1]) == (s, d, r):
            out[-1][1] += n
        else:
            out.append([s, n, d, r])
    return [(s, n + WINDOW - 1, d, r) for s, n, d, r in out]


HIT = pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("ref_doc", pa.int64()), ("ref_start", pa.int64())])
PARSED = "doc_id long, doc long, tag long, n_words long, n_removed long, kept string, factors array<struct<start:long,n_words:long,ref_doc:long,ref_start:long>>, pending array<long>"


def _parse(keep_text: bool):
    """Removes what the factors cover.  Rows with open windows keep their text for the next step; others give the kept words or their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, pend = batch.column("hits").to_pylist(), batch.column("open").to_pylist()
            text = batch.column("text").to_pylist()
            total, removed, kept, factors = [], [], [], []
            for t, own, later in zip(text, hits, pend, strict=True):
                words = (t or "").encode("utf-8", "surrogatepass").split()
                found = _factors([(x["start"], x["n"], x["ref_doc"], x["ref_start"]) for x in own or ()])
                total.append(len(words))
                factors.append([dict(zip(("start", "n_words", "ref_doc", "ref_start"), f, strict=True)) for f in found])
                if later:
                    removed.append(0)
                    kept.append(t)
                    continue
                spans = _merge([(s, s + n) for s, n, _, _ in found])
                if spans:
                    mask = np.ones(len(words), bool)
                    for a, b in spans:
                        mask[a:b] = False
                    removed.append(len(words) - int(mask.sum()))
                    words = compress(words, mask)
                else:
                    removed.append(0)
                rest = b" ".join(words)
                kept.append(rest.decode("utf-8", "surrogatepass") if keep_text else hashlib.sha256(rest).hexdigest())
            ints = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("doc"), batch.column("tag"), ints(total), ints(removed), pa.array(kept, pa.string()), pa.array(factors, pa.list_(HIT)), batch.column("open")],
                names=["doc_id", "doc", "tag", "n_words", "n_removed", "kept", "factors", "pending"],
            )

    return run


def _open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, tag = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc", "tag"))
        pending = batch.column("pending").to_pylist()
        for c in chunks(batch.column("kept"), False, SPACE):
            h = c.hashes()
            one, two = windows(h, WINDOW, 21), windows(h, WINDOW, 22)
            rows = np.repeat(np.arange(c.lo, c.hi), [len(pending[r]) for r in range(c.lo, c.hi)])
            packed = np.concatenate([np.array(pending[r], np.int64) for r in range(c.lo, c.hi)])
            count = packed & 15
            at = np.repeat(packed >> 4, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            row = np.repeat(rows, count)
            k = at + c.first[row - c.lo]
            place = (tag[row] << 32) | (at << 4) | 1
            yield pa.RecordBatch.from_arrays([pa.array(one[k].view(np.int64)), pa.array(two[k].view(np.int64)), pa.array(doc[row]), pa.array(place)], names=["one", "two", "doc", "place"])


def _hits(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, doc, place) that occur more than once, with the first place of their key as `ref`."""
    first = stored(rows.groupBy(*keys).agg(F.min(F.struct("doc", "place")).alias("ref")), "reference")
    return rows.join(first.hint("merge"), keys)


def _collect(rows: DataFrame) -> DataFrame:
    """What each document row needs for its parse: hits, and open blocks as start << 4 | windows."""
    hit = F.when(F.col("known"), F.struct(F.expr(START).alias("start"), F.expr("place & 15").alias("n"), F.col("ref.doc").alias("ref_doc"), F.expr(START.replace("place", "ref.place")).alias("ref_start")))
    later = F.when(~F.col("known"), F.expr("place & 4294967295"))
    return rows.groupBy("doc", F.expr("place >> 32").alias("tag")).agg(F.collect_list(hit).alias("hits"), F.collect_list(later).alias("open"))


def find_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, or their sha256), factors; a row for each row of docs."""
    known = F.col("doc") != F.col("ref.doc")
    known = known | (F.col("place") != F.col("ref.place"))
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.expr("xxhash64(coalesce(text, '')) & 2147483647").alias("tag"), "text")
    index = base.dropDuplicates(["doc", "tag"]) if _has_repeats(base) else base
    blocks = index.select("doc", "tag", "text").mapInArrow(_index, "anchor long, block long, doc long, place long")
    shared = stored(blocks.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("block") != F.max("block")).alias("mixed")).where("n > 1").select("anchor", "mixed"), "anchors")
    common = stored(blocks.join(shared.hint("merge"), "anchor"), "blocks")
    looked = _hits(common, ["anchor", "block"]).withColumn("known", known).where("known OR mixed")
    schema = PARSED.replace("kept string", "kept string")
    ready = base.join(_collect(looked).hint("merge"), ["doc", "tag"], "left")
    parsed = stored(ready.mapInArrow(_parse(keep_text), schema), "parsed")
    waiting = parsed.where(F.size("pending") > 0)
    done = parsed.where(F.coalesce(F.size("pending"), F.lit(0)) <= 0)
    again = waiting.dropDuplicates(["doc", "tag"]).mapInArrow(_open_windows, "one long, two long, doc long, place long")
    extra = _collect(_hits(stored(again, "windows"), ["one", "two"]).withColumn("known", known).where("known"))
    before = F.transform("factors", lambda x: F.struct(x["start"].alias("start"), (x["n_words"] - (WINDOW - 1)).alias("n"), x["ref_doc"].alias("ref_doc"), x["ref_start"].alias("ref_start")))
    merged = waiting.join(extra.select("doc", "tag", F.col("hits").alias("more")).hint("merge"), ["doc", "tag"], "left")
    merged = merged.select("doc_id", "doc", "tag", F.col("kept").alias("text"), F.concat(before, F.coalesce("more", F.array().cast("array<struct<start:long,n:long,ref_doc:long,ref_start:long>>"))).alias("hits"), F.array().cast("array<long>").alias("open"))
    out = done.unionByName(merged.mapInArrow(_parse(keep_text), schema))
    return out.select("doc_id", "n_words", "n_removed", "kept", "factors")


def _has_repeats(base: DataFrame) -> bool:
    """Whether any row occurs twice; then copies of a row must not count as its earlier occurrence."""
    return bool(base.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").limit(1).count())


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(table(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM x),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM f WHERE again),
k AS (SELECT d.doc_id, p, w FROM (SELECT doc_id, w[p] AS w, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)) d),
r AS (SELECT k.doc_id, count(*) AS n_removed_not, string_agg(k.w, ' ' ORDER BY k.p) AS kept FROM k ANTI JOIN c ON k.doc_id = c.doc_id AND k.p = c.p GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(n_removed_not, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
