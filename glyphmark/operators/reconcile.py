"""Reconciliation of what should be there with what is: completeness, files, provenance, sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmark.functions.text import strip


def completeness(scored: DataFrame, reviewed: DataFrame, key: str = "image_id") -> DataFrame:
    """scored (key), reviewed (key, state).  key, code: MISSING a review, ORPHAN review, or DEFERRED; complete images give no row."""
    a, b = scored.select(key).distinct().withColumn("__scored", F.lit(True)), reviewed.select(key, F.col("state").alias("__state"), F.lit(True).alias("__reviewed"))
    code = F.when(F.col("__reviewed").isNull(), "MISSING").when(F.col("__scored").isNull(), "ORPHAN").when(F.col("__state") == "deferred", "DEFERRED")
    return a.join(b, key, "full_outer").select(key, code.alias("code")).where("code IS NOT NULL")


def preflight(manifest: DataFrame, files: DataFrame, seeds: DataFrame | None = None, key: str = "image_id") -> DataFrame:
    """manifest and files (key, sha256), seeds (key).  key, code: FILE_MISSING, FILE_ORPHAN, HASH_DIFFERS, SEED_ORPHAN (a seed without a manifest row)."""
    a = manifest.select(key, F.col("sha256").alias("__a"), F.lit(True).alias("__listed"))
    b = files.select(key, F.col("sha256").alias("__b"), F.lit(True).alias("__there"))
    code = F.when(F.col("__there").isNull(), "FILE_MISSING").when(F.col("__listed").isNull(), "FILE_ORPHAN").when(~F.col("__a").eqNullSafe(F.col("__b")), "HASH_DIFFERS")
    out = a.join(b, key, "full_outer").select(key, code.alias("code")).where("code IS NOT NULL")
    if seeds is None:
        return out
    return out.unionByName(seeds.select(key).distinct().join(manifest.select(key), key, "left_anti").withColumn("code", F.lit("SEED_ORPHAN")))


def provenance_drift(existing: DataFrame, current: DataFrame, fields: tuple[str, ...], key: str = "image_id") -> DataFrame:
    """key, drifted: the fields in which an existing row isn't what the current run would write; a null is a value."""
    now = current.select(key, *[F.col(c).alias(f"__{c}") for c in fields])
    names = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in fields]))
    return existing.join(now, key).select(key, names.alias("drifted")).where(F.size("drifted") > 0)


def provenance_missing(rows: DataFrame, fields: tuple[str, ...], key: str = "image_id", column: str = "provenance") -> DataFrame:
    """rows (key, provenance map).  key, missing: the fields that are absent, null or blank, in the order asked for."""
    gone = lambda c: strip(F.coalesce(F.try_element_at(column, F.lit(c)).cast("string"), F.lit(""))) == ""
    names = F.array_compact(F.array(*[F.when(F.col(column).isNull() | gone(c), F.lit(c)) for c in fields]))
    return rows.select(key, names.alias("missing")).where(F.size("missing") > 0)


def union_of_sets(rows: DataFrame, provenance: tuple[str, ...] = ()) -> DataFrame:
    """rows (id, set_no, sha256, provenance ...).  id, set_no of the first set that holds it, and whether sets conflict: other bytes, or another provenance of a seed."""
    w = Window.partitionBy("id")
    differ = lambda c: (F.min(c).over(w) != F.max(c).over(w)) | ((F.count(c).over(w) > 0) & (F.count(c).over(w) < F.count("*").over(w)))
    conflict = reduce(Column.__or__, [F.coalesce(differ(c), F.lit(False)) for c in ("sha256", *provenance)])
    first = rows.withColumns({"__k": F.row_number().over(w.orderBy("set_no")), "conflict": conflict})
    return first.where("__k = 1").select("id", "set_no", "conflict")


def contradictions(blank: DataFrame, tokens: DataFrame, key: str = "image_id") -> DataFrame:
    """Images that are said to be blank, or hold control boxes, and yet have ground-truth tokens."""
    return blank.select(key).distinct().join(tokens.select(key), key, "left_semi")


def blank_images(presence: DataFrame, key: str = "image_id", column: str = "has_text") -> DataFrame:
    """Images whose flag is 0 after stripping; anything else, null included, isn't blank."""
    return presence.where(strip(F.col(column)) == "0").select(key)


def excluded(lists: list[DataFrame], key: str = "series_uid") -> DataFrame:
    """The distinct keys of several lists, stripped; blank ones are dropped."""
    return reduce(DataFrame.unionByName, [x.select(strip(F.col(key)).alias(key)) for x in lists]).where(F.col(key) != "").distinct()


def density(rows: DataFrame, by: str, key: str = "image_id") -> DataFrame:
    """rows (key, by), a row a token.  by, tokens, images, ratio: tokens an image against all groups' tokens an image."""
    per = rows.groupBy(by).agg(F.count("*").alias("tokens"), F.count_distinct(key).alias("images"))
    # A row a group: the total over them is a handful of rows.
    everything = Window.partitionBy(F.lit(0))
    mine = F.try_divide(F.col("tokens"), F.col("images"))
    return per.withColumn("ratio", mine / F.try_divide(F.sum("tokens").over(everything), F.sum("images").over(everything)))
