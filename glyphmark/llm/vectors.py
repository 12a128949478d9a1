"""Embedding near-dedup: an exact metric range join over pivot cells.

On the unit sphere cosine >= c is a chord of at most r = sqrt(2 - 2c).  Each vector belongs
to the cell of its nearest pivot.  The triangle inequality sets which other cells it must
also visit: x can have a partner in cell j only if its distance to the bisecting plane of
its own pivot and j's is at most r, and its distance to pivot j at most r more than the
cell's radius.  It visits only cells after its own, so each pair meets once.  Cells are cut
into blocks of about CELL_ROWS.  The visitors of each cell are counted first; a block's
visitors are dealt into chunks of GUESTS times its rows, its own rows go to each chunk that
is there, and each (block, chunk) is one bounded task.  A task returns sums of links and a
spanning forest of them, never all pairs, so a group of thousands of near copies stays
linear in its output.

The bounds are exact for any data; how much they prune depends on it.  For vectors spread
evenly over many dimensions hardly any cell can be left out, and the work is that of all
blocks against all blocks.  There are at most about MAX_PIVOTS cells of at most PIVOT_BYTES
in all (their pivots are broadcast), so beyond about MAX_PIVOTS * CELL_ROWS vectors the
blocks of one cell add to that, too.

Vectors of all lengths go through the same jobs.  A length whose vectors fit one block is one
group, without pivots; the others have cells of their own.  The driver holds only what is
counted of those: at most one row for each CELL_BYTES of vectors.

Equal vectors are one class from the start.  Vectors that are null, empty, zero, or hold
null, NaN or infinite components link with nothing, nor do vectors of another length.  A
null vec_id links with nothing and has a null component_id.  Rows that repeat a vec_id are
one node.  Only `vec_id` and `embedding` are read; other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmark.llm.common import cut, stored, table
from glyphmark.llm.components import components
from glyphmark.llm.textcore import mix

CELL_ROWS, MAX_PIVOTS, GUESTS = 6000, 16_384, 4
#: Bytes of a block's vectors; long vectors make smaller blocks.
CELL_BYTES = 16 << 20
#: Bytes of all pivots at most; they are broadcast.
PIVOT_BYTES = 32 << 20
#: Rows whose distances to all pivots are held at once.
AT_ONCE = 256
SLACK = 1e-9


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of unit length; scaled first, so that no square overflows or vanishes."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ pivots.T)))


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def _assign(pivots_bc):
    """Cell and distance of each vector; cell -1 where its length fits one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, rows in _by_size(batch, pc.list_value_length(batch.column("v"))):
                for lo in range(0, rows.num_rows, AT_ONCE):
                    part = rows.slice(lo, AT_ONCE)
                    x, pivots = _matrix(part.column("v"), size), pivots_bc.value.get(size)
                    if pivots is None:
                        cell, distance = np.full(len(x), -1), np.zeros(len(x))
                    else:
                        d = _distances(x, pivots)
                        cell = d.argmin(axis=1)
                        distance = d[np.arange(len(x)), cell]
                    yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("n"), pa.array(np.full(len(x), size, np.int32)), pa.array(cell.astype(np.int32)), pa.array(distance), _bytes(x)], names=["rep", "n", "size", "cell", "distance", "unit_vector"])

    return run


def _by_size(batch: pa.RecordBatch, sizes: pa.Array) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = sizes.to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        yield int(size), batch.take(pa.array(np.flatnonzero(sizes == size)))


@dataclass
class One:
    """The layout of one length, as its own broadcast would hold it."""

    value: Any


def _each_size(step: Callable, layouts_bc):
    """Runs a step that knows one length on the rows of each length, and puts the length beside its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, rows in _by_size(batch, batch.column("size")):
                for out in step(One(layouts_bc.value.get(size)))(iter([rows])):
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(out.num_rows, size, np.int32))], names=[*out.schema.names, "size"])

    return run


def cell_rows(size: int) -> int:
    return max(500, min(CELL_ROWS, CELL_BYTES // (8 * size)))


class Layout:
    """Which blocks each cell has, in one order over all blocks, and how many chunks of visitors each block has."""

    def __init__(self, pivots: np.ndarray, counts: np.ndarray, radii: np.ndarray, reach: float):
        self.pivots, self.counts, self.radii, self.reach = pivots, counts, radii, reach
        self.rows = cell_rows(pivots.shape[1])
        self.blocks = np.maximum(1, -(-counts // self.rows)).astype(int)
        self.first = np.concatenate([[0], np.cumsum(self.blocks)])
        self.cell_of = np.repeat(np.arange(len(counts)), self.blocks)
        self.chunks = np.ones(len(self.cell_of), int)

    def expect(self, visitors: np.ndarray) -> None:
        """visitors: how many vectors of earlier cells visit each cell; a block is also visited by the earlier blocks of its cell."""
        earlier = (np.arange(len(self.cell_of)) - self.first[self.cell_of]) * (self.counts / self.blocks)[self.cell_of]
        self.chunks = np.maximum(1, np.ceil((visitors[self.cell_of] + earlier) / (GUESTS * self.rows))).astype(int)

    def visits(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all visits to later cells."""
        d = _distances(x, self.pivots)
        own = d[np.arange(len(x)), cell]
        between = np.maximum(_distances(self.pivots[cell], self.pivots), 1e-12)
        may = (d**2 - own[:, None] ** 2) / (2 * between) <= self.reach
        may &= d <= self.radii[None, :] + self.reach
        may &= (self.counts > 0)[None, :] & (np.arange(len(self.counts))[None, :] > cell[:, None])
        return np.nonzero(may)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for lo in range(0, batch.num_rows, AT_ONCE):
        part = batch.slice(lo, AT_ONCE)
        x = np.frombuffer(b"".join(part.column("unit_vector").to_pylist()), np.float64).reshape(part.num_rows, -1)
        yield part, x, part.column("cell").to_numpy(zero_copy_only=False)


def _count_visits(layout_bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lay: Layout = layout_bc.value
        total = np.zeros(len(lay.counts), np.int64)
        for batch in batches:
            for _, x, cell in _parts(batch):
                total += np.bincount(lay.visits(x, cell)[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["cell", "n"])

    return run


def _spread(values: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value so many times, and 0, 1, ... beside its repeats."""
    at = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(values, times), at


def _deal(layout_bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lay: Layout = layout_bc.value
        for batch in batches:
            if lay is None:
                alone = [pa.array(np.full(batch.num_rows, -1, np.int32)), pa.array(np.zeros(batch.num_rows, np.int32)), pa.array(np.ones(batch.num_rows, bool))]
                yield pa.RecordBatch.from_arrays([*alone, *(batch.column(c) for c in ("rep", "n", "unit_vector"))], names=["block", "chunk", "resident", "rep", "n", "unit_vector"])
                continue
            for part, x, cell in _parts(batch):
                draw = mix(part.column("rep").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                home = lay.first[cell] + (draw % lay.blocks[cell].astype(np.uint64)).astype(int)
                draw = mix(draw)
                mine, chunk = _spread(np.arange(len(x)), lay.chunks[home])
                row, to = lay.visits(x, cell)
                far, k = _spread(np.arange(len(row)), lay.blocks[to])
                far_block = lay.first[to[far]] + k
                near, k = _spread(np.arange(len(x)), lay.first[cell + 1] - home - 1)
                guest, block = np.concatenate([row[far], near]), np.concatenate([far_block, home[near] + 1 + k])
                guest_chunk = (draw[guest] % lay.chunks[block].astype(np.uint64)).astype(int)
                rows = np.concatenate([mine, guest])
                columns = [np.concatenate([home[mine], block]).astype(np.int32), np.concatenate([chunk, guest_chunk]).astype(np.int32), np.arange(len(rows)) < len(mine)]
                for lo in range(0, len(rows), 4096):
                    take = pa.array(rows[lo : lo + 4096])
                    yield pa.RecordBatch.from_arrays([*[pa.array(c[lo : lo + 4096]) for c in columns], *[part.column(c).take(take) for c in ("rep", "n", "unit_vector")]], names=["block", "chunk", "resident", "rep", "n", "unit_vector"])

    return run


def _forest(hit: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges that connect what the hits connect; rows and cols hold node ids."""
    r, c = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    hit, row_id, col_id = hit[np.ix_(r, c)], rows[r], cols[c]
    top = np.iinfo(np.int64).max
    row_label, col_label = row_id.copy(), col_id.copy()
    while True:
        new_col = np.minimum(col_label, np.where(hit, row_label[:, None], top).min(axis=0))
        new_row = np.minimum(row_label, np.where(hit, new_col[None, :], top).min(axis=1))
        if (new_col == col_label).all() and (new_row == row_label).all():
            break
        row_label, col_label = new_row, new_col
    ids, labels = np.concatenate([row_id, col_id]), np.concatenate([row_label, col_label])
    return ids[ids != labels], labels[ids != labels]


def _join(cosine: float):
    def run(group: pa.Table) -> pa.Table:
        rep, n = (group.column(k).to_numpy() for k in ("rep", "n"))
        x = np.frombuffer(b"".join(group.column("unit_vector").to_pylist()), np.float64).reshape(len(rep), -1)
        resident = group.column("resident").to_numpy(zero_copy_only=False).astype(bool)
        h, g = np.flatnonzero(resident), np.flatnonzero(~resident)
        links = np.zeros(len(rep), np.int64)
        a, b = [], []
        step = cell_rows(x.shape[1])
        parts = [(h, g[k : k + step]) for k in range(0, len(g), step)]
        if len(h) and group.column("chunk")[0].as_py() == 0:
            parts.append((h, h))
        for left, right in parts:
            if not len(left):
                continue
            hit = x[left] @ x[right].T >= cosine
            if left is right:
                np.fill_diagonal(hit, False)
                hit |= hit.T
            if hit.any():
                links[left] += hit @ n[right]
                if left is not right:
                    links[right] += n[left] @ hit
                p, q = _forest(hit, rep[left], rep[right])
                a.append(p)
                b.append(q)
        some = np.flatnonzero(links)
        a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
        return pa.table({"a": pa.array(np.concatenate([rep[some], a])), "b": pa.array([None] * len(some) + b.tolist(), pa.int64()), "n": pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)]))})

    return run


def _wanted(sizes: list[tuple[int, int]]) -> dict[int, float]:
    """(length, rows) of lengths beyond one block: the share of rows to take as pivots, which together keep to MAX_PIVOTS and PIVOT_BYTES."""
    pivots = {size: 4 * (rows // cell_rows(size)) for size, rows in sizes}
    total, weight = sum(pivots.values()), sum(8 * size * n for size, n in pivots.items())
    part = min(1.0, MAX_PIVOTS / max(1, total), PIVOT_BYTES / max(1, weight))
    return {size: part * pivots[size] / rows for size, rows in sizes}


def _pivots(classes: DataFrame) -> dict[int, np.ndarray]:
    """Pivots of each length beyond one block: rows of the smallest hashes; any one vector where the share gives none."""
    spark, size = classes.sparkSession, F.size("v").alias("size")
    room = F.greatest(F.lit(cell_rows(1 << 40)), F.least(F.lit(cell_rows(1)), F.floor(F.lit(CELL_BYTES) / (8 * F.col("size")))))
    big = classes.groupBy(size).agg(F.count("*").alias("rows")).where(F.col("rows") > room).collect()
    if not big:
        return {}
    shares = _wanted([(r["size"], r["rows"]) for r in big])
    of = F.broadcast(spark.createDataFrame(list(shares.items()), "size int, share double"))
    draw = (F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    picked = classes.select(size, "rep", "v").join(of, "size").where(draw < F.col("share")).select("size", "rep", "v").toArrow().sort_by("rep")
    out = {}
    for n in shares:
        mine = picked.filter(pc.equal(picked.column("size"), n)).column("v").combine_chunks()
        out[n] = _matrix(mine, n) if len(mine) else np.eye(1, n)
    return out


def _range_join(classes: DataFrame, cosine: float) -> DataFrame:
    """(a, b null, n): links of class a found by one task; (a, b, 0): an edge of the forest."""
    context, pivots = classes.sparkSession.sparkContext, _pivots(classes)
    placed = stored(classes.select("rep", "n", "v").mapInArrow(_assign(context.broadcast(pivots)), "rep long, n long, size int, cell int, distance double, unit_vector binary"), "cells")
    reach = math.sqrt(2 - 2 * cosine) + SLACK
    layouts = {}
    if pivots:
        counts, radii, visitors = ({size: np.zeros(len(p), kind) for size, p in pivots.items()} for kind in (np.int64, float, np.int64))
        for r in placed.where("cell >= 0").groupBy("size", "cell").agg(F.count("*").alias("n"), F.max("distance").alias("d")).collect():
            counts[r["size"]][r["cell"]], radii[r["size"]][r["cell"]] = r["n"], r["d"]
        layouts = {size: Layout(p, counts[size], radii[size], reach) for size, p in pivots.items()}
        counted = placed.where("cell >= 0").mapInArrow(_each_size(_count_visits, context.broadcast(layouts)), "cell int, n long, size int")
        for r in counted.groupBy("size", "cell").agg(F.sum("n").alias("n")).collect():
            visitors[r["size"]][r["cell"]] = r["n"]
        for size, layout in layouts.items():
            layout.expect(visitors[size])
    dealt = placed.mapInArrow(_each_size(_deal, context.broadcast(layouts)), "block int, chunk int, resident boolean, rep long, n long, unit_vector binary, size int")
    return dealt.groupBy("size", "block", "chunk").applyInArrow(_join(cosine), "a long, b long, n long")


def near_vectors(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row for each row of vectors."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.expr("vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    rows = rows.withColumn("v", F.when(sound, F.col("v")))
    classes = stored(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors")
    found = stored(_range_join(classes, cosine), "links")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("more"))
    labels = components(found.where("b IS NOT NULL").select("a", "b"))
    known = classes.join(links, "rep", "left").join(labels, F.col("rep") == F.col("node"), "left")
    known = cut(known.select("v", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("label", "rep").alias("component")))
    out = rows.join(known.hint("merge"), "v", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_embedding_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.vec_id WHERE r.c < l.y)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.x = v.vec_id) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id) m USING (vec_id)
"""
