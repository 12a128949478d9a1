"""Names of images, arms and configurations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of an image id; thresholds of the engine whose configurations have names of their own.
ID_LENGTH = 8
SHIPPED, LIBRARY_TEXT, LIBRARY_LOW, LINK = 0.2, 0.7, 0.4, 0.4


def image_id(uid: Column, frame: Column, length: int = ID_LENGTH) -> Column:
    """The first digits of the sha256 of `uid|frame`, the frame a plain whole number; null if either is null."""
    return F.substring(F.sha2(F.concat(uid, F.lit("|"), frame.cast("long").cast("string")), 256), 1, length)


def arm_parts(arm: Column) -> tuple[Column, Column]:
    """Engine and variant of `engine:variant`: what stands before and after the first colon; without one the variant is empty."""
    engine = F.substring_index(arm, ":", 1)
    return engine, F.when(F.instr(arm, ":") > 0, F.substr(arm, F.length(engine) + 2)).when(arm.isNotNull(), "")


def config_label(text: Column, low: Column, link: Column) -> Column:
    """What a configuration of the three thresholds is called, whatever its arm says: thr0.2, stock or tuned."""
    same = lambda a, b: (text == a) & (low == b) & (link == LINK)
    return F.when(same(SHIPPED, SHIPPED), f"thr{SHIPPED}").when(same(LIBRARY_TEXT, LIBRARY_LOW), "stock").otherwise("tuned")
