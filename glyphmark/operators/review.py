"""Review records: their rules, the view gate, the diff against seeds and two rounds' agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmark.functions.text import strip
from glyphmark.operators.assignment import assign
from glyphmark.operators.overlaps import crowded, overlapping
from glyphmark.operators.rollup import grouped

#: States of a record, reasons to defer one, labels, group of an unlisted image.
STATES = ("accepted", "edited", "deferred")
DEFER_REASONS = ("unreadable", "ambiguous_token", "possible_non_blank_control", "needs_cal")
LABELS = ("PHI", "KEEP")
UNKNOWN = "(unknown)"
CHANGES = ("unchanged", "text_fixed", "box_fixed", "deleted", "added", "hidden")


def record_violations(records: DataFrame) -> DataFrame:
    """records (image_id, state, defer_reason, tokens array<struct<box array<double>, label, text, seed_index>>).

    image_id, code: every rule a record breaks, once.  A null state is invalid; null tokens are none.
    """
    state, reason, tokens = F.col("state"), F.col("defer_reason"), F.coalesce("tokens", F.array())
    known = F.coalesce(state.isin(*STATES), F.lit(False))
    deferred = known & (state == "deferred")
    numbered = F.filter(F.transform(tokens, lambda t: t["seed_index"]), lambda i: i.isNotNull())
    any_of = lambda rule: F.coalesce(F.exists(tokens, rule), F.lit(False))
    rules = [
        ("STATE_INVALID", ~known),
        ("DEFER_REASON_INVALID", deferred & ~F.coalesce(reason.isin(*DEFER_REASONS), F.lit(False))),
        ("REASON_WITHOUT_DEFER", known & ~deferred & reason.isNotNull()),
        ("DEFERRED_WITH_TOKENS", deferred & (F.size(tokens) > 0)),
        ("BOX_NOT_FOUR", any_of(lambda t: F.coalesce(F.size(t["box"]) != 4, F.lit(True)) | F.exists(t["box"], lambda v: v.isNull()))),
        ("LABEL_INVALID", any_of(lambda t: ~F.coalesce(t["label"].isin(*LABELS), F.lit(False)))),
        ("TEXT_BLANK", any_of(lambda t: strip(F.coalesce(t["text"], F.lit(""))) == "")),
        ("SEED_INDEX_NEGATIVE", F.coalesce(F.exists(numbered, lambda i: i < 0), F.lit(False))),
        ("SEED_INDEX_REPEATED", F.size(F.array_distinct(numbered)) < F.size(numbered)),
    ]
    return records.select("image_id", F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules]))).alias("code"))


def visible(confidence: Column, gate: Column) -> Column:
    """Whether a token is shown: one without a confidence always, else one at the gate or above."""
    return confidence.isNull() | (confidence < 0) | (confidence >= F.coalesce(gate, F.lit(0.0)))


def with_group(rows: DataFrame, groups: DataFrame, gates: DataFrame | None = None, key: str = "image_id") -> DataFrame:
    """Adds each image's group, UNKNOWN for an unlisted one, and its gate, 0 for an unlisted group.  gates (grp, gate) has a row a group."""
    out = rows.join(groups.select(key, F.col("group").alias("__g")), key, "left").withColumn("grp", F.coalesce("__g", F.lit(UNKNOWN))).drop("__g")
    return out if gates is None else out.join(gates, "grp", "left").withColumn("gate", F.coalesce("gate", F.lit(0.0)))


def seed_diff(seeds: DataFrame, records: DataFrame) -> DataFrame:
    """seeds (image_id, seed_index, text, box columns, confidence, gate), records the same without the last two.

    image_id, seed_index, change, shown.  A seed token below the gate was not shown: kept or
    not it is `hidden`, and never `deleted`; a record's token that no seed has is `added`.
    """
    a = seeds.withColumn("__seed", F.lit(True)).withColumn("__shown", visible(F.col("confidence"), F.col("gate"))).alias("a")
    both = a.join(records.withColumn("__record", F.lit(True)).alias("b"), ["image_id", "seed_index"], "full_outer")
    moved = F.lit(False)
    for c in ("x0", "y0", "x1", "y1"):
        moved = moved | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    gone = F.col("__record").isNull()
    change = F.when(F.col("__seed").isNull(), "added").when(gone & ~F.col("__shown"), "hidden").when(gone, "deleted").when(~F.col("a.text").eqNullSafe(F.col("b.text")), "text_fixed").when(moved, "box_fixed").otherwise("unchanged")
    return both.select("image_id", "seed_index", change.alias("change"), F.coalesce("__shown", F.lit(True)).alias("shown"))


def seed_quality(diff: DataFrame, by: str) -> DataFrame:
    """Counts of each change by group and over all."""
    return grouped(diff, by, *[F.count_if(F.col("change") == c).alias(c) for c in CHANGES])


def self_agreement(first: DataFrame, second: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Two rounds' tokens (image_id, g, text, label, x0, y0, x1, y1; the second also state).

    image_id, deferred, matched, text_disagree, label_disagree, r1_only, r2_only, for images of
    both rounds.  In list order (g) each first-round token takes the second-round token left
    with the best overlap of at least the threshold; of equal ones the later.  A deferred
    image of the second round is undecided: it is listed, and its counts are 0.  A round's
    image without tokens is a row with a null g.
    """
    decided = second.groupBy("image_id").agg(F.coalesce(F.bool_or(F.col("state") == "deferred"), F.lit(False)).alias("deferred"), F.count("g").alias("n2"))
    images = first.groupBy("image_id").agg(F.count("g").alias("n1")).join(decided, "image_id")
    open_images = images.where("NOT deferred").select("image_id")
    a, b = (rows.where("g IS NOT NULL").join(open_images, "image_id", "left_semi") for rows in (first, second))
    differ = lambda c: (~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(f"{c}_differs")
    g, w = F.col("a.g").cast("long"), F.col("b.g").cast("long")
    crowd = crowded(a, b)
    pairs = overlapping(a, b, threshold, crowd).select("image_id", g.alias("g"), w.alias("w"), differ("text"), differ("label"), F.struct(g.alias("first"), (-F.col("iou")).alias("best"), (-w).alias("later")).alias("rank"))
    found = assign(pairs, crowd).groupBy("image_id").agg(F.count("*").alias("matched"), F.count_if("text_differs").alias("text_disagree"), F.count_if("label_differs").alias("label_disagree"))
    out = images.join(found, "image_id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("int") for c in ("matched", "text_disagree", "label_disagree")})
    only = lambda n: F.when(F.col("deferred"), 0).otherwise(F.col(n) - F.col("matched")).cast("int")
    return out.select("image_id", "deferred", "matched", "text_disagree", "label_disagree", only("n1").alias("r1_only"), only("n2").alias("r2_only"))


def agreement_totals(agreement: DataFrame) -> DataFrame:
    """images (both rounds decided), deferred2, and the sums; no shared image gives nulls, which is no zero."""
    sums = [F.sum(c).alias(c) for c in ("matched", "text_disagree", "label_disagree", "r1_only", "r2_only")]
    return agreement.agg(F.count_if(~F.col("deferred")).alias("images"), F.count_if("deferred").alias("deferred2"), *sums)
