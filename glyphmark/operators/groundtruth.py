"""Assembly and comparison of ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build_rows(tokens: DataFrame, backmap: DataFrame, manifest: DataFrame) -> DataFrame:
    """Tokens with the categories of their series; a token without a series raises when it is read."""
    out = tokens.join(backmap, "image_id", "left").join(manifest, "series_uid", "left")
    known = F.col("modality").isNotNull()
    return out.withColumn("modality", F.when(known, F.col("modality")).otherwise(F.raise_error(F.lit("a token's image is in no series of the manifest"))))


def summary(images: DataFrame, tokens: DataFrame, by: str = "stratum") -> DataFrame:
    """images (image_id, by), tokens (image_id, label).  Images, those with text, rows and labels by group and over all."""
    from glyphmark.operators.rollup import grouped, total

    per = tokens.groupBy("image_id").agg(F.count("*").alias("n"), F.count_if(F.expr("label = 'KEEP'")).alias("k"), F.count_if(F.expr("label = 'PHI'")).alias("p"))
    rows = images.join(per, "image_id", "left")
    return grouped(rows, by, F.count("*").alias("images"), F.count("n").alias("with_text"), total("n").alias("n_rows"), total("k").alias("keep"), total("p").alias("phi"), F.count_if(F.col("n").isNull()).alias("blank"))


def without_text(images: DataFrame, tokens: DataFrame, by: str = "stratum") -> DataFrame:
    """The groups none of whose images has a token: they say nothing about reading."""
    return summary(images, tokens, by).where("grp <> 'ALL' AND with_text = 0").select("grp", "images")
