"""Box heights by stratum, with what stands in where a stratum has none, and percentiles that name a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmark.functions.text import rounded
from glyphmark.operators.rollup import quantiles


def median_heights(tokens: DataFrame, by: str = "stratum") -> DataFrame:
    """tokens (by, y0, y1).  total, group, height: the exact median of each group and, where total, of all."""
    rows = tokens.select(by, (F.col("y1") - F.col("y0")).alias("height"))
    return quantiles(rows, by, "height").select(F.col("__total").alias("total"), F.col("__key").alias("group"), F.col("median").alias("height"))


def control_heights(images: DataFrame, tokens: DataFrame, by: str = "stratum") -> DataFrame:
    """images with box_height: their group's median token height, else the median of all tokens, else null.

    A group without tokens, or whose median is 0, has none of its own.
    """
    found = median_heights(tokens, by)
    own = found.where("NOT total AND height <> 0").select(F.col("group").alias("__g"), F.col("height").alias("__own"))
    every = found.where("total").agg(F.max("height")).first()[0]
    joined = images.join(own, F.col(by).cast("string") == F.col("__g"), "left")
    return joined.withColumn("box_height", F.coalesce("__own", F.lit(every).cast("double"))).drop("__g", "__own")


def nearest_rank(rows: DataFrame, by: str, value: Column, shares: dict[str, float], places: int = 1) -> DataFrame:
    """by, and for each share the smallest value that at least so many of a group don't exceed, rounded half to even; 0 for no value."""
    picked = {name: F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY __v)") for name, share in shares.items()}
    out = rows.withColumn("__v", value.cast("double")).groupBy(by).agg(*[p.alias(name) for name, p in picked.items()])
    return out.select(by, *[F.coalesce(rounded(F.col(name), places), F.lit(0.0)).alias(name) for name in shares])
