"""Box arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Crops are padded by this share of the box height and scaled to this height.
CROP_PAD, CROP_HEIGHT = 0.10, 48
#: Centres of control boxes as shares of the frame, in order of use; shape and least height.
ANCHORS = ((0.02, 0.02), (0.98, 0.02), (0.02, 0.98), (0.98, 0.98), (0.50, 0.02), (0.50, 0.98), (0.02, 0.50), (0.98, 0.50), (0.50, 0.50))
CONTROL_ASPECT, CONTROL_FRACTION, CONTROL_MIN_HEIGHT = 6.0, 0.035, 16.0


def iou(a: str | Column, b: str | Column) -> Column:
    """Intersection over union of the boxes a.x0.. and b.x0.. (of a relation's name or a struct); 0 where the union is not positive, null for a null box."""
    c = lambda t, k: F.col(f"{t}.{k}") if isinstance(t, str) else t[k]
    span = lambda lo, hi: F.when(c(a, lo).isNotNull() & c(b, lo).isNotNull(), F.greatest(F.lit(0.0), F.least(c(a, hi), c(b, hi)) - F.greatest(c(a, lo), c(b, lo))))
    inter = span("x0", "x1") * span("y0", "y1")
    area = lambda t: (c(t, "x1") - c(t, "x0")) * (c(t, "y1") - c(t, "y0"))
    union = area(a) + area(b) - inter
    return F.when(union <= 0, 0.0).otherwise(F.try_divide(inter, union))


def crop(x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column) -> dict[str, Column]:
    """The padded crop in whole pixels inside the frame, at least one pixel, and its scaled width (half to even)."""
    pad = (y1 - y0) * CROP_PAD
    left = F.greatest(F.floor(x0 - pad), F.lit(0))
    top = F.greatest(F.floor(y0 - pad), F.lit(0))
    right = F.greatest(F.least(F.ceil(x1 + pad), w), left + 1)
    bottom = F.greatest(F.least(F.ceil(y1 + pad), h), top + 1)
    width = F.greatest(F.rint((right - left) * F.lit(float(CROP_HEIGHT)) / (bottom - top)), F.lit(1.0))
    return {"crop_x0": left.cast("long"), "crop_y0": top.cast("long"), "crop_x1": right.cast("long"), "crop_y1": bottom.cast("long"), "crop_width": width.cast("long")}


def quad_box(points: Column, w: Column, h: Column) -> Column:
    """array<struct<x, y>> to the struct of its bounds, clamped to the frame."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    fit = lambda v, top: F.greatest(F.lit(0.0), F.least(v, top.cast("double")))
    return F.struct(fit(F.array_min(xs), w).alias("x0"), fit(F.array_min(ys), h).alias("y0"), fit(F.array_max(xs), w).alias("x1"), fit(F.array_max(ys), h).alias("y1"))


def control_boxes(w: Column, h: Column, count: int, box_height: Column | None = None) -> Column:
    """The first `count` control boxes of a frame, an array of structs with box_no."""
    own = F.greatest(F.lit(CONTROL_MIN_HEIGHT), h * CONTROL_FRACTION)
    tall = own if box_height is None else F.when(box_height > 0, box_height).otherwise(own)
    tall = F.greatest(F.lit(CONTROL_MIN_HEIGHT), F.least(tall.cast("double"), h.cast("double")))
    wide = tall * CONTROL_ASPECT
    out = []
    for k, (fx, fy) in enumerate(ANCHORS[:count]):
        x0 = F.least(F.greatest(F.lit(0.0), w * fx - wide / 2), F.greatest(F.lit(0.0), w - wide))
        y0 = F.least(F.greatest(F.lit(0.0), h * fy - tall / 2), F.greatest(F.lit(0.0), h - tall))
        out.append(F.struct(F.lit(k).alias("box_no"), x0.alias("x0"), y0.alias("y0"), F.least(w.cast("double"), x0 + wide).alias("x1"), F.least(h.cast("double"), y0 + tall).alias("y1")))
    return F.array(*out)
