"""The reading arm: readers over given crops, and what their reads are worth."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmark.functions.digest import config_digest
from glyphmark.functions.text import normalize
from glyphmark.operators.rollup import RATE


class Reader(Protocol):
    """A crop in, one string out; "" is an answer, an omission.  config() names every knob that changes a read."""

    model_name: str
    version: str
    config_id: str

    def read(self, crop: dict) -> str: ...

    def config(self) -> dict: ...


def identity(reader: Reader) -> dict[str, str]:
    """The fields that tell arms apart; a blank one is refused."""
    out = {"model_name": reader.model_name, "version": reader.version, "config_id": reader.config_id, "config_hash": config_digest(reader.config())}
    blank = [k for k, v in out.items() if not str(v or "").strip()]
    if blank:
        raise ValueError(f"a reader must name its {blank}")
    return out


def read_crops(crops: DataFrame, build: Callable[[], Reader], key: str = "crop_id") -> DataFrame:
    """key, read, and the reader's identity, a row a crop.  build() runs once a task, on the executor, so a transport or model can be injected by it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = build()
        arm = identity(reader)
        for batch in batches:
            reads = [reader.read(row) for row in batch.to_dict("records")]
            wrong = [type(r).__name__ for r in reads if not isinstance(r, str)]
            if wrong:
                raise TypeError(f"a reader must return a string, not {wrong[0]}")
            yield pd.DataFrame({key: batch[key], "read": reads, **arm})

    kind = crops.schema[key].dataType.simpleString()
    return crops.mapInPandas(run, f"{key} {kind}, read string, model_name string, version string, config_id string, config_hash string")


def axis_split(reads: DataFrame) -> DataFrame:
    """reads (image_id, is_gt, read).  image_id, found, omitted, invented: a ground-truth crop that reads blank is omitted, any read of a control crop is invented."""
    said = normalize(F.coalesce("read", F.lit(""))) != ""
    rows = reads.withColumn("__said", said)
    return rows.groupBy("image_id").agg(F.count_if(F.col("is_gt") & F.col("__said")).alias("found"), F.count_if(F.col("is_gt") & ~F.col("__said")).alias("omitted"), F.count_if(~F.col("is_gt") & F.col("__said")).alias("invented"))


def floor(control: DataFrame) -> DataFrame:
    """control (image_id, invented boolean).  crops, inventions, per_crop, per_image; no crop gives null rates, an absence and no zero."""
    out = control.agg(F.count("*").alias("crops"), F.count_if("invented").alias("inventions"), F.count_distinct("image_id").alias("n"))
    return out.select("crops", "inventions", RATE(F.col("inventions"), F.col("crops")).alias("per_crop"), RATE(F.col("inventions"), F.col("n")).alias("per_image"))


def bench(reads: DataFrame, size: int = 8) -> DataFrame:
    """reads (expected, read).  n, exact, empty, misread, and n8: crops whose expected text has `size` characters."""
    rows = reads.select(normalize(F.col("expected")).alias("e"), normalize(F.col("read")).alias("r"), F.length("expected").alias("size"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.expr("e = r")).alias("exact"), F.count_if(F.expr("r = ''")).alias("empty"), F.count_if(F.expr("r <> '' AND e <> r")).alias("misread"), F.count_if(F.col("size") == size).alias("n8"))


def usage(calls: DataFrame, by: str, input_price: float, output_price: float) -> DataFrame:
    """calls (by, input_tokens, output_tokens); prices in dollars a million tokens.  Sums and usd by group."""
    out = calls.groupBy(by).agg(F.sum("input_tokens").cast("long").alias("input_tokens"), F.sum("output_tokens").cast("long").alias("output_tokens"))
    return out.withColumn("usd", F.round(F.col("input_tokens") * input_price / 1_000_000 + F.col("output_tokens") * output_price / 1_000_000, 9))


def crop_digest(width: Column, height: Column, rgb: Column) -> Column:
    """The content address of a crop: its size and raw RGB bytes, so that one changed pixel changes it and the file format doesn't."""
    head = F.concat(width.cast("string"), F.lit("x"), height.cast("string"), F.lit("|")).cast("binary")
    return F.sha2(F.concat(head, rgb), 256)
