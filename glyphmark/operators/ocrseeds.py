"""Seeds from OCR rows: which rows are tokens, their boxes and confidences, and statistics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmark.functions.text import strip

#: The level of a word row, the confidence of a word that has none, the histogram's buckets.
WORD_LEVEL, NO_CONFIDENCE = 5, -1.0
BUCKETS = ("-1", "0-9", "10-19", "20-29", "30-39", "40-49", "50-59", "60-69", "70-79", "80-89", "90-100")


def drop_blank_words(rows: DataFrame, column: str = "text") -> DataFrame:
    """Rows whose text is more than white space; a null text is none."""
    return rows.where(strip(F.col(column)) != "")


def seed_tokens(rows: DataFrame, upscale: float = 2.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """rows (level, conf as text, text, l, t, w, h in upscaled pixels).  Words with corners in image pixels, unrounded.

    A confidence that is no number becomes NO_CONFIDENCE; no row goes for its confidence.
    """
    words = drop_blank_words(rows.where(F.col("level") == WORD_LEVEL))
    corner = lambda c: c / float(upscale)
    confidence = F.coalesce(F.col("conf").cast("string").try_cast("double"), F.lit(NO_CONFIDENCE))
    return words.select(*keep, "text", confidence.alias("confidence"), corner(F.col("l")).alias("x0"), corner(F.col("t")).alias("y0"), corner(F.col("l") + F.col("w")).alias("x1"), corner(F.col("t") + F.col("h")).alias("y1"))


def degenerate(rows: DataFrame) -> DataFrame:
    """n, degenerate: boxes without width or height."""
    return rows.agg(F.count("*").alias("n"), F.count_if((F.col("x0") == F.col("x1")) | (F.col("y0") == F.col("y1"))).alias("degenerate"))


def bucket(confidence: Column) -> Column:
    low = (F.floor(confidence / 10) * 10).cast("int")
    return F.when(confidence < 0, BUCKETS[0]).when(confidence >= 90, BUCKETS[-1]).otherwise(F.concat(low.cast("string"), F.lit("-"), (low + 9).cast("string")))


def confidence_histogram(rows: DataFrame) -> DataFrame:
    """bucket, n: every bucket, also the empty ones."""
    counts = rows.groupBy(bucket(F.col("confidence")).alias("bucket")).agg(F.count("*").alias("n"))
    spine = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(b) for b in BUCKETS])).alias("bucket"))
    return spine.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def confidence_stats(rows: DataFrame, by: str | None = None) -> DataFrame:
    """n, lo, mid, hi of the confidences, by a column or over all; no rows give n = 0 and nulls.

    The median holds a count for each distinct value; confidences have few.
    """
    c = F.col("confidence")
    stats = (F.count(c).alias("n"), F.min(c).alias("lo"), F.median(c).alias("mid"), F.max(c).alias("hi"))
    return rows.groupBy(by).agg(*stats) if by else rows.agg(*stats)


def percentiles(rows: DataFrame, by: str, value: Column, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles of a value by group: the smallest value with at least that share of the rows at or below it."""
    named = rows.withColumn("__v", value)
    return named.groupBy(by).agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY __v)").alias(name) for name, q in shares.items()])
