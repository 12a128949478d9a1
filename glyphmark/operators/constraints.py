"""Validation: one column per rule, all violations of a row, codes and places but never cell values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmark.functions.text import strip

REQUIRED = ("image_id", "series_uid", "modality", "vendor", "stratum", "frame_idx", "token_text", "x0", "y0", "x1", "y1", "label")


def violation(code: str, column: str, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(column).alias("column")))


def frame_code(c: Column) -> Column:
    """Null if the text is a canonical non-negative whole number."""
    return F.when(c.rlike("^-[1-9][0-9]*$"), "FRAME_NEGATIVE").when(~c.rlike("^(0|[1-9][0-9]*)$"), "FRAME_NOT_INT")


def coordinate_code(c: Column) -> Column:
    """The first rule a coordinate breaks: a number, finite, not negative."""
    clean = F.regexp_replace(strip(c), "(?<=[0-9])_(?=[0-9])", "")
    v = F.when(~clean.rlike("[0-9.][dDfF]$"), clean.try_cast("double"))
    return F.when(v.isNull(), "COORD_NOT_NUMBER").when(F.isnan(v) | (F.abs(v) == float("inf")), "COORD_NOT_FINITE").when(v < 0, "COORD_NEGATIVE")


def coded(column: str, code: Column) -> Column:
    return F.when(code.isNotNull(), F.struct(code.alias("code"), F.lit(column).alias("column")))


def violations(rows: DataFrame, key: str) -> DataFrame:
    """key, code, column for every broken rule of string rows in the ground-truth layout."""
    filled = {c: F.coalesce(F.col(c), F.lit("")) != "" for c in REQUIRED}
    rules = [violation("FIELD_EMPTY", c, ~filled[c]) for c in REQUIRED]
    rules.append(violation("LABEL_INVALID", "label", filled["label"] & ~F.col("label").isin("PHI", "KEEP")))
    rules.append(F.when(filled["frame_idx"], coded("frame_idx", frame_code(F.col("frame_idx")))))
    box = ("x0", "y0", "x1", "y1")
    rules += [F.when(filled[c], coded(c, coordinate_code(F.col(c)))) for c in box]
    sound = F.lit(True)
    for c in box:
        sound = sound & filled[c] & coordinate_code(F.col(c)).isNull()
    v = {c: F.col(c).try_cast("double") for c in box}
    rules += [violation("BOX_ORDER_X", "x1", sound & ~(v["x0"] < v["x1"])), violation("BOX_ORDER_Y", "y1", sound & ~(v["y0"] < v["y1"]))]
    if "w" in rows.columns:
        rules += [violation("SIZE_UNKNOWN", "image_id", F.col("w").isNull()), violation("BOX_OUTSIDE_X", "x1", sound & (v["x1"] > F.col("w"))), violation("BOX_OUTSIDE_Y", "y1", sound & (v["y1"] > F.col("h")))]
    return rows.select(key, F.explode(F.array_compact(F.array(*rules))).alias("v")).select(key, "v.code", "v.column")


def by_code(found: DataFrame, key: str, shown: int = 10) -> DataFrame:
    """code, n, the first keys, how many more.  Each task hands on at most `shown` keys of a code (a window's group limit), so no task holds all."""
    place = F.row_number().over(Window.partitionBy("code").orderBy(key))
    first = found.select("code", key).distinct().withColumn("__place", place).where(F.col("__place") <= shown)
    first = first.groupBy("code").agg(F.array_sort(F.collect_list(key)).alias("first"))
    ranked = found.groupBy("code").agg(F.count("*").alias("n")).join(first, "code")
    return ranked.withColumn("more", F.greatest(F.lit(0).cast("long"), F.col("n") - shown))


def require_none(found: DataFrame, what: str) -> None:
    """Raises with counts by code if there is any violation."""
    counts = {r["code"]: r["count"] for r in found.groupBy("code").count().collect()}
    if counts:
        raise ValueError(f"{what}: " + ", ".join(f"{k} x {n}" for k, n in sorted(counts.items())))


IDENTITY = ("model_name", "version", "config_id", "config_hash")


def identity_violations(scores: DataFrame, run: str = "run_id") -> DataFrame:
    """Blank identity fields come first; only a run without blanks is asked whether it mixes identities."""
    blank = lambda c: strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    unsigned = F.col("verifier_elapsed").isNotNull() & (blank("verifier_model") | blank("verifier_version"))
    out = scores.groupBy(run).agg(*[F.count_if(blank(c)).alias(f"blank_{c}") for c in IDENTITY], F.count_if(unsigned).alias("blank_verifier"), F.count_distinct(F.struct(*IDENTITY, "verifier_model", "verifier_version")).alias("identities"))
    blanks = sum((F.col(f"blank_{c}") for c in IDENTITY), F.col("blank_verifier"))
    return out.select(run, blanks.alias("blanks"), "identities", F.when(blanks > 0, "BLANK_IDENTITY").when(F.col("identities") > 1, "MIXED_IDENTITY").alias("code")).where("code IS NOT NULL")
