"""Series manifests and id maps: whitelisted views, guards, counts and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmark.functions.text import strip

CATEGORIES = ("modality", "stratum", "vendor")


def project(rows: DataFrame, renamed: dict[str, str]) -> DataFrame:
    """Only the named columns, under their new names; any other column is left out, a missing one is an error."""
    missing = [c for c in renamed if c not in rows.columns]
    if missing:
        raise ValueError(f"the manifest lacks the columns {missing}")
    return rows.select(*[F.col(f"`{old}`").alias(new) for old, new in renamed.items()])


def guard_view(rows: DataFrame, allowed: tuple[str, ...], key: str | None = None) -> DataFrame:
    """Refuses a view with a column outside the whitelist, or with a key that repeats."""
    extra = sorted(set(rows.columns) - set(allowed))
    if extra:
        raise ValueError(f"columns outside the whitelist: {extra}")
    if key and rows.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} repeats; a look-up by it would give several rows")
    return rows


def violations(rows: DataFrame, key: str = "series_uid", frame: str = "frame_idx", categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """code, column, n: blank and repeated keys, blank categories, frames that are no number or no whole number.

    A null counts as blank.  Every code is there, also with n = 0; an empty manifest has none.
    """
    blank = lambda c: strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    number = F.col(frame).cast("string").try_cast("double")
    rules = [("KEY_BLANK", key, blank(key)), *[("CATEGORY_BLANK", c, blank(c)) for c in categories], ("FRAME_NOT_NUMERIC", frame, number.isNull()), ("FRAME_NOT_INTEGRAL", frame, number.isNotNull() & (number != F.floor(number)))]
    one = rows.agg(*[F.count_if(F.coalesce(rule, F.lit(False))).alias(f"n{k}") for k, (_, _, rule) in enumerate(rules)])
    found = one.select(F.explode(F.array(*[F.struct(F.lit(code).alias("code"), F.lit(c).alias("column"), F.col(f"n{k}").alias("n")) for k, (code, c, _) in enumerate(rules)])).alias("x")).select("x.*")
    again = rows.where(~blank(key)).groupBy(key).count().where("count > 1").agg(F.lit("KEY_DUPLICATE").alias("code"), F.lit(key).alias("column"), F.count("*").alias("n"))
    return found.unionByName(again)


def counts(rows: DataFrame, fields: tuple[str, ...] = CATEGORIES, blank: Column | None = None) -> DataFrame:
    """field, value, n of each category, and under ('blank', 'candidate') the rows that may be blank controls."""
    if blank is not None:
        rows, fields = rows.withColumn("blank", F.when(blank, "candidate")), (*fields, "blank")
    return rows.unpivot([], list(fields), "field", "value").where("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("n"))


def frame_summary(rows: DataFrame, frame: str = "frame_idx") -> DataFrame:
    """lo, hi, mid, mean of the frame numbers; all 0 for no rows."""
    z = lambda c: F.coalesce(c, F.lit(0))
    return rows.agg(z(F.min(frame)).alias("lo"), z(F.max(frame)).alias("hi"), z(F.median(frame)).alias("mid"), F.round(z(F.avg(frame)), 9).alias("mean"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of their key; old ones of other keys stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last in order; a repeated render replaces what it repeats."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("__at", at).where("__at = 1").drop("__at")


def functional_violations(rows: DataFrame, key: str, depends: str) -> DataFrame:
    """key, n: keys with more than one value of what should depend on them."""
    return rows.groupBy(key).agg(F.count_distinct(depends).alias("n")).where("n > 1")


def id_collisions(rows: DataFrame) -> DataFrame:
    """rows (id, source).  code, value, n: an id of two sources, a source under two ids, id lengths that are mixed (n of each)."""
    ids = rows.groupBy(F.col("id").alias("value")).agg(F.count_distinct("source").alias("n")).where("n > 1").select(F.lit("ID_OF_TWO_SOURCES").alias("code"), F.col("value").cast("string"), "n")
    sources = rows.groupBy(F.col("source").alias("value")).agg(F.count_distinct("id").alias("n")).where("n > 1").select(F.lit("SOURCE_UNDER_TWO_IDS").alias("code"), F.col("value").cast("string"), "n")
    lengths = rows.groupBy(F.length("id").alias("value")).agg(F.count("*").alias("n"))
    # Lengths are a handful of rows.
    mixed = lengths.withColumn("kinds", F.count("*").over(Window.partitionBy(F.lit(0)))).where("kinds > 1").select(F.lit("ID_LENGTHS_MIXED").alias("code"), F.col("value").cast("string"), "n")
    return ids.unionByName(sources).unionByName(mixed)


def frame_disagreements(manifest: DataFrame, rendered: DataFrame, key: str, by: str) -> DataFrame:
    """manifest (key, by, frame_idx), rendered (key, rendered).  by, n: images whose rendered frame isn't the manifest's; unrendered ones don't count."""
    return manifest.join(rendered, key).groupBy(by).agg(F.count_if(F.col("frame_idx") != F.col("rendered")).alias("n"))


def middle_frames(instances: DataFrame) -> DataFrame:
    """instances (series, number or null, instance, tie, wanted).  series, chosen, fallback, instance.

    Instances stand by number, those without last, then by instance.  The wanted place is
    taken if the series has it, else the middle one, which `fallback` tells.
    """
    w = Window.partitionBy("series")
    rows = instances.withColumns({"idx": F.row_number().over(w.orderBy(F.asc_nulls_last("number"), "instance", "tie")) - 1, "n": F.count("*").over(w)})
    rows = rows.withColumn("chosen", F.expr("if(wanted < n, wanted, n div 2)"))
    return rows.where("idx = chosen").select("series", "chosen", F.expr("wanted >= n").alias("fallback"), "instance")
