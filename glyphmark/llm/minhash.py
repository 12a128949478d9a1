"""MinHash near-duplicates from an LSH forest.

Each of TREES signature orders has DEPTH minima.  An order is sorted by its minima, dealt
over tasks by range; next to each document stand those with which it has the longest common
prefix.  Neighbours in an order are candidates.  A region (a maximal run with a common
prefix of TOP minima) of at most SMALL documents gives all its pairs.  In a denser region
every document goes as deep as it takes until SMALL or fewer share its prefix, and is also
compared with the region's density peak, which joins a large group of near copies at a
cost linear in its documents.

What is still apart in a dense region is then compared exactly, block against block:
documents of one component are not compared again, blocks whose set sizes rule out the
threshold are left out, and a bound on the overlap from bit sets of the shingles, which
never loses a pair at the threshold, leaves few pairs for the full sets.  Equal sets are one
class from the start, found by a 128-bit digest of the whole set.  Candidates become links
only after their classes' full shingle sets are compared.

The candidate search is a random one: two documents at the threshold 0.85 share no region
at all, and are missed, with (1 - 0.85 ** 3) ** 14, about 2 pairs in a million.

Null and empty texts have no shingles and are linked with nothing.  A null doc_id is
linked with nothing and its component_id is null.  Rows that repeat a doc_id are one
node with the links of all its texts.  Only `doc_id` and `text` are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmark.llm.common import cut, dropped, small_batches, stored, table
from glyphmark.llm.components import components
from glyphmark.llm.textcore import SPACE, Chunk, chunks, mix, odd_numbers, windows

SHINGLE = 5
TREES, DEPTH = 14, 12
#: Minima of the first FULL depths keep 32 bits, deeper ones 16.
FULL = 3
LABEL_BYTES = 4 * FULL + 2 * (DEPTH - FULL)
#: A region begins at TOP common minima; density peaks are looked for at LEVELS.
TOP, LEVELS = 3, (3, 5, 7, 9, 12)
SMALL = 8
#: Documents of a block; a component with as many in one region has blocks of its own.
BLOCK = 512
#: Kinds of the rows that a sorted order gives.
PAIR, MEMBER, DEEPER, EDGE = range(4)

_FACTORS = odd_numbers(TREES * DEPTH, 11)
_KEYS = odd_numbers(LABEL_BYTES + 1, 13)
#: Whole minima before the byte at which two labels part.
_DEPTH_AT = np.array([b // 4 if b < 4 * FULL else FULL + (b - 4 * FULL) // 2 for b in range(LABEL_BYTES + 1)])


def shingle_sets(c: Chunk) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    h = c.hashes()
    w = windows(h, SHINGLE, 5)
    for r in range(c.hi - c.lo):
        lo, hi = int(c.first[r]), int(c.first[r + 1])
        if hi - lo >= SHINGLE:
            yield np.unique(w[lo : hi - SHINGLE + 1])
        elif hi > lo:
            yield mix(np.array([np.sum(h[lo:hi] * odd_numbers(hi - lo, 100 + hi - lo))], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _print(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signature(s: np.ndarray) -> bytes:
    least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max)
    for i in range(0, len(s), 512):
        least = np.minimum(least, (_FACTORS[:, None] * s[None, i : i + 512]).min(axis=1))
    least = mix(least).reshape(TREES, DEPTH)
    head = (least[:, :FULL] >> np.uint64(32)).astype(">u4")
    tail = (least[:, FULL:] >> np.uint64(48)).astype(">u2")
    return np.hstack([np.ascontiguousarray(head).view(np.uint8), np.ascontiguousarray(tail).view(np.uint8)]).tobytes()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, prints, signs = [], [], []
        for c in chunks(batch.column("text"), True, SPACE):
            for s in shingle_sets(c):
                sizes.append(len(s))
                prints.append(_print(s) if len(s) else None)
                signs.append(_signature(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "print", "signature"])


def signatures(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sign, "doc_id long, n_shingles long, print binary, signature binary")


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _pairs_of(run: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within the runs of the taken rows; a run has SMALL rows at most."""
    left, right = [], []
    for gap in range(1, SMALL):
        i = np.flatnonzero(take[:-gap] & (run[:-gap] == run[gap:]))
        left.append(i)
        right.append(i + gap)
    return np.concatenate(left), np.concatenate(right)


def _order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted range of the orders: candidates, members of dense regions, and the runs that the range's ends may cut."""
    parts = [(b.column("tree").to_numpy(), _fixed(b.column("label"), LABEL_BYTES), b.column("cls").to_numpy(), b.column("n").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    tree, label, cls, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    rows = len(cls)
    same = (label[1:] == label[:-1]) & (tree[1:] == tree[:-1])[:, None]
    common = np.zeros(rows, np.int64)
    common[1:] = _DEPTH_AT[np.where(same.all(axis=1), LABEL_BYTES, same.argmin(axis=1))]
    common[1:][tree[1:] != tree[:-1]] = 0
    hashed = np.cumsum((label.astype(np.uint64) + np.uint64(1)) * _KEYS[:-1], axis=1, dtype=np.uint64)

    def key(depth: int, at: np.ndarray) -> np.ndarray:
        byte = 4 * depth if depth <= FULL else 4 * FULL + 2 * (depth - FULL)
        return mix(hashed[at, byte - 1] + (tree[at].astype(np.uint64) * np.uint64(64) + np.uint64(depth)) * _KEYS[-1]).view(np.int64)

    def give(kind: int, a, b, n, x=None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(n), pa.array(np.zeros(len(a)) if x is None else x)], names=["kind", "a", "b", "n", "x"])

    found, pending = [], np.zeros(rows, bool)
    for depth in range(TOP, DEPTH + 1):
        run = np.cumsum(common < depth)
        many = np.bincount(run)[run]
        if depth == TOP:
            cut_off = (run == run[0]) | (run == run[-1])
            edge = np.flatnonzero(cut_off & (many <= SMALL))
            yield give(EDGE, key(TOP, edge), cls[edge], size[edge])
            found.append(_pairs_of(run, (many <= SMALL) & ~cut_off))
            pending = many > SMALL
            next_to = np.flatnonzero(pending[1:] & (common[1:] >= TOP))
            found.append((next_to, next_to + 1))
        else:
            found.append(_pairs_of(run, pending & (many <= SMALL)))
            pending &= many > SMALL
        if depth in LEVELS:
            dense = np.flatnonzero(pending)
            if len(dense):
                yield give(MEMBER if depth == TOP else DEEPER, key(depth, dense), cls[dense], size[dense], np.log(many[dense]))
        if not pending.any():
            break
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    pairs = np.unique(np.sort(np.stack([cls[i], cls[j]], axis=1), axis=1), axis=0)
    yield give(PAIR, pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64))


def _within(buckets: DataFrame) -> DataFrame:
    """All pairs of each bucket (key, cls) of at most SMALL documents."""
    lists = buckets.groupBy("key").agg(F.sort_array(F.collect_set("cls")).alias("r"))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.size("r") - 2), lambda i: F.transform(F.slice("r", i + 2, F.size("r")), lambda y: F.struct(F.element_at("r", i + 1).alias("a"), y.alias("b")))))
    return lists.where(F.size("r") > 1).select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a < b) of classes (cls, n, signature), and the members (key, cls, n) of the dense regions."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    labels = classes.select("cls", "n", "signature", tree.alias("tree")).select("tree", F.expr(f"substring(signature, {LABEL_BYTES} * tree + 1, {LABEL_BYTES})").alias("label"), "cls", "n")
    orders = labels.repartitionByRange("tree", "label", "cls").sortWithinPartitions("tree", "label", "cls")
    rows = cut(orders.mapInArrow(_order, "kind int, a long, b long, n long, x double"))
    near = rows.where(F.col("kind") == PAIR).select("a", "b")
    named = rows.select("kind", F.col("a").alias("key"), F.col("b").alias("cls"), "n", "x")
    inside = named.where(F.col("kind") == MEMBER).select("key", "cls", "n")
    edges = named.where(F.col("kind") == EDGE).select("key", "cls", "n")
    crowded = inside.select("key").distinct().withColumn("full", F.lit(1))
    counts = edges.groupBy("key").agg(F.count("*").alias("here")).join(crowded, "key", "left").select("key", F.coalesce(F.col("full") == 1, F.col("here") > SMALL).alias("full"))
    edges = cut(edges.join(counts, "key"))
    members = inside.unionByName(edges.where("full").select("key", "cls", "n"))
    dense = named.where(F.col("kind").isin(MEMBER, DEEPER))
    density = dense.groupBy("cls").agg(F.round(F.sum("x"), 6).alias("density"))
    peaks = dense.select("key", "cls").join(density, "cls").groupBy("key").agg(F.max(F.struct("density", (-F.col("cls")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("peak"))
    stars = dense.select("key", "cls").join(peaks, "key").where("cls <> peak").select(F.least("cls", "peak").alias("a"), F.greatest("cls", "peak").alias("b"))
    return reduce(DataFrame.unionByName, [near, _within(edges.where("NOT full")), stars]).distinct(), members


def _hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of those rows whose digest is the class's."""
    for batch in batches:
        prints = batch.column("print").to_pylist()
        keep, sizes, sets = [], [], []
        for c in chunks(batch.column("text"), True, SPACE):
            for r, s in enumerate(shingle_sets(c), c.lo):
                if len(s) and _print(s) == prints[r]:
                    keep.append(r)
                    sizes.append(len(s))
                    sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("cls").take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())], names=["cls", "n", "hashes"])


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, n, hashes: the full shingle sets of the wanted classes, a row each."""
    ends = classes.join(wanted.distinct(), "cls").select(F.col("rep").alias("doc_id"), "cls", "print")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ends, "doc_id").select("cls", "print", "text")
    return stored(texts.mapInArrow(_hash_sets, "cls long, n long, hashes binary").dropDuplicates(["cls"]), "sets")


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles as a set of 4 to 8 bits for each shingle; halves of a set laid over each other are the set of half the width."""
    for batch in batches:
        sets = []
        for raw in batch.column("hashes").to_pylist():
            s = np.frombuffer(raw, np.uint64)
            width = 1 << max(6, (4 * len(s) - 1).bit_length())
            row = np.zeros(width, np.uint8)
            row[(s & np.uint64(width - 1)).astype(np.int64)] = 1
            sets.append(np.packbits(row, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(sets, pa.binary())], names=["cls", "bits"])


def _by_width(rows: np.ndarray, bits: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The rows of each width and their bit sets, one under the other."""
    widths = np.array([len(bits[r]) for r in rows])
    return {int(w): (rows[widths == w], np.frombuffer(b"".join(bits[r] for r in rows[widths == w]), np.uint64).reshape(-1, int(w) // 8)) for w in np.unique(widths)}


def _across(percent: int):
    """Pairs of two blocks, or within one, that may reach the threshold; bit sets of two widths are compared in the smaller."""

    def run(group: pa.Table) -> pa.Table:
        cls, label, n = (group.column(k).to_numpy() for k in ("cls", "label", "n"))
        block, x, y = (group.column(k).to_numpy() for k in ("block", "x", "y"))
        bits = group.column("bits").to_pylist()
        left, right = (_by_width(np.flatnonzero(block == side), bits) for side in (x, y))
        found = [np.zeros((0, 2), np.int64)]
        for w, (i, p) in left.items():
            for v, (j, q) in right.items():
                if max(w, v) > 2 * min(w, v):
                    continue
                p1 = p[:, : v // 8] | p[:, v // 8 :] if w > v else p
                q1 = q[:, : w // 8] | q[:, w // 8 :] if v > w else q
                for k in range(len(i)):
                    both = n[i[k]] + n[j]
                    most = np.minimum((both - np.bitwise_count(p1[k] ^ q1).sum(axis=1, dtype=np.int64)) // 2, np.minimum(n[i[k]], n[j]))
                    to = cls[j[(label[j] != label[i[k]]) & (100 * most >= percent * (both - most))]]
                    found.append(np.stack([np.minimum(cls[i[k]], to), np.maximum(cls[i[k]], to)], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _apart(dense: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of one dense region (key, cls, n), in different components (node, label), that may reach the threshold."""
    rows = dense.join(labels, F.col("cls") == F.col("node"), "left").select("key", "cls", "n", F.coalesce("label", "cls").alias("label"))
    groups = cut(rows.groupBy("key", "label").agg(F.count("*").alias("mine")))
    torn = groups.groupBy("key").agg(F.count("*").alias("labels")).where("labels > 1").select("key")
    owners = groups.join(torn, "key").select("key", "label", F.when(F.col("mine") >= BLOCK, F.col("label")).alias("own"))
    band = F.floor(F.log("n") / math.log(100 / percent) + 1e-9) if percent < 100 else F.col("n")
    rows = rows.join(owners, ["key", "label"]).withColumn("band", band.cast("long"))
    parts = rows.groupBy("key", "own", "band").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    spread = F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("label")).otherwise(F.col("cls"))), F.col("parts"))
    sized = rows.join(parts.select(*[F.col(c).alias(f"p_{c}") for c in ("key", "own", "band")], "parts"), (F.col("key") == F.col("p_key")) & F.col("own").eqNullSafe(F.col("p_own")) & (F.col("band") == F.col("p_band")))
    members = cut(sized.select("key", "cls", "n", "label", "own", "band", F.xxhash64("key", "own", "band", spread).alias("block")))
    blocks = members.select("key", "block", "own", "band").distinct()
    side = lambda s: blocks.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("block", "own", "band")])
    ends = side("x").join(side("y"), "key").where("block_x <= block_y AND abs(band_x - band_y) <= 1 AND NOT coalesce(own_x = own_y, false)")
    ends = ends.select(F.col("block_x").alias("x"), F.col("block_y").alias("y"), F.explode(F.array_distinct(F.array("block_x", "block_y"))).alias("block"))
    bits = sets.join(members.select("cls").distinct(), "cls").select("cls", "hashes").mapInArrow(_bits, "cls long, bits binary")
    sides = members.select("cls", "n", "label", "block").join(bits, "cls").join(ends, "block")
    return sides.groupBy("x", "y").applyInArrow(_across(percent), "a long, b long").where("a < b").distinct()


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in ("set_a", "set_b"))
                both = np.intersect1d(x, y, assume_unique=True).size
                keep[k] = both > 0 and 100 * both >= percent * (x.size + y.size - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach percent / 100; sizes that rule it out are left out before the sets travel."""
    sizes = sets.select("cls", "n")
    fit = pairs.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b")
    left, right = (sets.select(F.col("cls").alias(s), F.col("hashes").alias(f"set_{s}")) for s in "ab")
    return fit.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row for each row of docs."""
    signed = stored(signatures(docs), "signatures")
    able = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    # Numbered once, as the numbers are stored.
    classes = stored(able.groupBy("print", "signature").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n")).withColumn("cls", F.monotonically_increasing_id()), "classes")
    pairs, dense = candidates(classes.select("cls", "n", "signature"))
    pairs, dense = cut(pairs), cut(dense)
    sets = _sets(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(dense.select("cls")))
    rows = cut(signed.join(classes.select("print", "rep", "cls"), "print", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.struct("cls", "rep")).alias("c")).select("doc_id", "n_shingles", "c.cls", "c.rep"))
    links = cut(confirmed(pairs, sets, percent).unionByName(_repeated(rows)))
    labels = components(links)
    more = cut(confirmed(cut(_apart(dense, labels, sets, percent)), sets, percent))
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    least = labels.join(classes.select("cls", "rep"), F.col("node") == F.col("cls")).groupBy("label").agg(F.min("rep").alias("component"))
    known = cut(labels.join(least, "label").select(F.col("node").alias("cls"), "component"))
    dropped(signed, classes, sets)
    out = rows.join(known, "cls", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _repeated(rows: DataFrame) -> DataFrame:
    """Links the classes of rows that repeat a doc_id with other texts."""
    first = rows.where("doc_id IS NOT NULL AND cls IS NOT NULL").groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).where("a <> z").select("doc_id", "a")
    return rows.join(first, "doc_id").where("cls <> a").select("a", F.col("cls").alias("b")).distinct()


def keep_representatives(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents, all columns as they were, without those that another of their group stands for."""
    gone = near_duplicates(docs, percent).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def op2_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 85)


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN z zx ON zx.doc_id = x JOIN z zy ON zy.doc_id = y WHERE 100 * c >= 85 * (zx.n + zy.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT b.y, r.c FROM r JOIN both_ways b ON b.x = r.doc_id WHERE r.c < b.y),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN z USING (doc_id) JOIN m USING (doc_id)
"""
