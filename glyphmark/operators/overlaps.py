"""Pairs of boxes of one image that overlap; crowded images are paired tile by tile.

Boxes whose intersection over union reaches a threshold t have sides of a ratio of t at
least, so each box has a level a side (its power of BASE) and meets partners on its own level or
on few above it.  On a level a box covers at most two tiles a side; a pair counts on the higher
of both levels only, in the tile that holds the corner of its intersection, so each pair comes
once.  Tiles are the join's key, so a crowded image is spread over tasks and the work follows the
neighbours a box has, not the boxes of its image.  Images of at most FEW boxes on the left and
MANY on the right are joined by image: that is at most FEW tries for each box on the right.

A box with a null, without a positive side or without bounds overlaps nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmark.functions.geometry import iou
from glyphmark.sources.paths import remove, work_folder

FEW, MANY, BASE, LOWEST = 64, 512, 4, -200
SIDES = (("x0", "x1"), ("y0", "y1"))


def crowded(left: DataFrame, right: DataFrame) -> DataFrame | None:
    """image_id of the images above FEW or MANY boxes, written once; None if there are none."""
    n, m = (rows.groupBy("image_id").agg(F.count("*").alias(c)) for rows, c in ((left, "n"), (right, "m")))
    return crowded_by(n.join(m, "image_id"))


def crowded_by(counts: DataFrame) -> DataFrame | None:
    """The same from image_id, n and m, the boxes of either side."""
    spark = counts.sparkSession
    path = work_folder(spark, "crowded")
    counts.where((F.col("n") > FEW) | (F.col("m") > MANY)).select("image_id").write.parquet(path)
    found = spark.read.schema(counts.select("image_id").schema).parquet(path)
    if not found.isEmpty():
        return found
    remove(spark, path)
    return None


def _level(lo: str, hi: str) -> Column:
    return F.greatest(F.floor(F.log(float(BASE), F.col(hi) - F.col(lo))), F.lit(LOWEST)).cast("int")


def _width(level: Column) -> Column:
    return F.pow(F.lit(float(BASE)), level + 1)


def _places(lo: str, hi: str, level: str, reach: int) -> Column:
    on = lambda k: F.sequence(F.floor(F.col(lo) / _width(k)), F.floor(F.col(hi) / _width(k)))
    return F.flatten(F.transform(F.sequence(F.col(level), F.col(level) + reach), lambda k: F.transform(on(k), lambda at: F.struct(k.alias("level"), at.alias("at")))))


def _sound(box: Column | None = None) -> Column:
    ok = F.lit(True)
    for lo, hi in SIDES:
        side = F.col(hi) - F.col(lo) if box is None else box[hi] - box[lo]
        ok = ok & (side > 0) & (side < float("inf"))
    return ok


def dealt(boxes: DataFrame, threshold: float) -> DataFrame:
    """own (the row), its levels lx and ly, and tile, once for each tile of the box."""
    reach = math.ceil(math.log(1 / min(threshold, 1.0), BASE) + 1e-9)
    rows = boxes.where(_sound()).withColumn("own", F.struct(*boxes.columns)).select("image_id", "own", *[c for s in SIDES for c in s])
    rows = rows.withColumn("lx", _level(*SIDES[0])).withColumn("ly", _level(*SIDES[1]))
    xs, ys = (_places(*side, level, reach) for side, level in zip(SIDES, ("lx", "ly"), strict=True))
    tiles = F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x["level"].alias("lx"), y["level"].alias("ly"), x["at"].alias("tx"), y["at"].alias("ty")))))
    return rows.select("image_id", "own", "lx", "ly", F.explode(tiles).alias("tile"))


def tile_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """image_id, a, b (the rows as structs) of all that meet in the tile that counts; some overlap less than the threshold."""
    a, b = (dealt(side, threshold).alias(name) for side, name in ((left, "a"), (right, "b")))
    met = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.tile") == F.col("b.tile")))
    here = F.lit(True)
    for (lo, _), level, at in zip(SIDES, ("lx", "ly"), ("tx", "ty"), strict=True):
        tile = F.col("a.tile")[level]
        here = here & (F.greatest(f"a.{level}", f"b.{level}") == tile) & (F.floor(F.greatest(f"a.own.{lo}", f"b.own.{lo}") / _width(tile)) == F.col("a.tile")[at])
    return met.where(here).select(F.col("a.image_id").alias("image_id"), F.col("a.own").alias("a"), F.col("b.own").alias("b"))


def overlaps_of(boxes: Column, others: Column, threshold: float, pair) -> Column:
    """pair(iou, a, b) for the elements of two arrays of boxes that `overlapping` would pair."""
    if threshold > 0:
        boxes = F.filter(boxes, _sound)

    def partners(a: Column) -> Column:
        near = others
        if threshold > 0:
            # Rows of words differ in y, so that side decides first.
            near = F.filter(others, lambda b: (a["y0"] < b["y1"]) & (b["y0"] < a["y1"]) & (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & _sound(b))
        return F.filter(F.transform(near, lambda b: pair(iou(a, b), a, b)), lambda p: p["iou"] >= threshold)

    return F.flatten(F.transform(boxes, partners))


def overlapping(left: DataFrame, right: DataFrame, threshold: float, crowd: DataFrame | None) -> DataFrame:
    """image_id, a, b, iou of the pairs of one image at or above the threshold; crowd as `crowded` gives it.

    At a threshold of 0 or less all pairs of an image are asked for, and so returned."""
    if threshold > 0:
        left, right = left.where(_sound()), right.where(_sound())
    few = left if crowd is None or threshold <= 0 else left.join(crowd, "image_id", "left_anti")
    on = (F.col("a.image_id") == F.col("b.image_id")) & (iou("a", "b") >= threshold)
    if threshold > 0:
        for lo, hi in SIDES:
            on = on & (F.col(f"a.{lo}") < F.col(f"b.{hi}")) & (F.col(f"b.{lo}") < F.col(f"a.{hi}"))
    row = lambda side, name: F.struct(*[F.col(f"{name}.{c}") for c in side.columns]).alias(name)
    pairs = few.alias("a").join(right.alias("b"), on).select(F.col("a.image_id").alias("image_id"), row(left, "a"), row(right, "b"), iou("a", "b").alias("iou"))
    if few is left:
        return pairs
    many = [side.join(crowd, "image_id", "left_semi") for side in (left, right)]
    return pairs.unionByName(tile_pairs(*many, threshold).withColumn("iou", iou("a", "b")).where(F.col("iou") >= threshold))
