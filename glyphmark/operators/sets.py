"""Digests of sets of ids, in memory that doesn't grow with the set."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_digest(rows: DataFrame, by: str, key: str = "image_id") -> DataFrame:
    """by, n, digest: the sha256 of a group's keys as text, sorted by code point, each ended by a line feed.

    Rows are sorted within partitions and stream through one running digest, so a group is never a
    list.  Keys that repeat count each; null keys are none, and a group of nothing else has no row.
    """
    kind = rows.schema[by].dataType.simpleString()
    texts = rows.select(F.col(by).alias("group"), F.col(key).cast("string").alias("id")).where("id IS NOT NULL")
    ordered = texts.repartition("group").sortWithinPartitions("group", "id")
    return ordered.mapInArrow(_digests, f"group {kind}, n long, digest string").withColumnRenamed("group", by)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group, n, running, kind = None, 0, None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([group], kind), pa.array([n]), pa.array([running.hexdigest()])], names=["group", "n", "digest"])
    for batch in batches:
        kind = batch.schema.field("group").type
        for now, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if running is None or now != group:
                if running is not None:
                    yield row()
                group, n, running = now, 0, hashlib.sha256()
            running.update(text.encode() + b"\n")
            n += 1
    if running is not None:
        yield row()
