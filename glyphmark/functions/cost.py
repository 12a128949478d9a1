"""Price rules over image dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dollars for one unit of each rule.
PRICES = {"claude": 5.00 / 1_000_000, "gpt4o": 2.50 / 1_000_000, "gemini": 1.25 / 1_000_000, "cloud": 0.0015, "self_hosted": 0.0}


def units(rule: Column, w: Column, h: Column) -> Column:
    """Billed units of one image; an unknown rule raises."""
    tiles = lambda edge: F.ceil(w / edge) * F.ceil(h / edge)
    small = (w <= 384) & (h <= 384)
    return (
        F.when(rule == "claude", F.ceil(w * h / 750))
        .when(rule == "gpt4o", 85 + 170 * tiles(512))
        .when(rule == "gemini", 45 + 258 * F.when(small, F.lit(1)).otherwise(tiles(768)))
        .when(rule == "cloud", F.lit(1))
        .when(F.coalesce(rule, F.lit("self_hosted")) == "self_hosted", F.lit(0))
        .otherwise(F.raise_error(F.concat(F.lit("unknown pricing rule "), rule)))
    ).cast("long")


def dollars(rule: Column, w: Column, h: Column) -> Column:
    price = F.create_map(*[F.lit(x) for kv in PRICES.items() for x in kv])
    return units(rule, w, h) * F.element_at(price, F.coalesce(rule, F.lit("self_hosted")))
