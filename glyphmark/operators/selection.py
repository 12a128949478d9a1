"""Configuration sweeps: regressions by stratum, the winner, what is frozen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def regressions(trials: DataFrame, strata: DataFrame, metric: str, tolerance: float) -> DataFrame:
    """Strata in which a candidate falls behind its engine's stock run (trial 0) by more than the tolerance; null metrics are skipped."""
    stock = strata.where("trial_no = 0").select("engine", "stratum", F.col(metric).alias("stock"))
    rows = strata.where("trial_no > 0").join(stock, ["engine", "stratum"])
    rows = rows.withColumn("delta", F.col(metric) - F.col("stock")).where(F.col("delta") < -tolerance)
    return rows.select("engine", "trial_no", "stratum", "delta")


def worst(found: DataFrame) -> DataFrame:
    return found.groupBy("engine", "trial_no").agg(F.min(F.struct("delta", "stratum")).alias("x")).select("engine", "trial_no", "x.stratum", "x.delta")


def winners(trials: DataFrame, regressed: DataFrame, metric: str, descending: bool) -> DataFrame:
    """The best candidate without a regression that strictly beats stock; ties keep the grid's order, nulls never win."""
    stock = trials.where("trial_no = 0").select("engine", F.col(metric).alias("stock"))
    able = trials.where("trial_no > 0").join(regressed.select("engine", "trial_no").distinct(), ["engine", "trial_no"], "left_anti")
    best = F.desc_nulls_last(metric) if descending else F.asc_nulls_last(metric)
    first = able.withColumn("rank", F.row_number().over(Window.partitionBy("engine").orderBy(best, "trial_no"))).where("rank = 1")
    beats = F.col(metric) > F.col("stock") if descending else F.col(metric) < F.col("stock")
    return first.join(stock, "engine").where(beats).select("engine", "trial_no", F.col(metric).alias("value"), "stock")


def freeze(frozen: DataFrame, swept: DataFrame, won: DataFrame, fixed_pair: str | None = None) -> DataFrame:
    """Winners replace, engines swept without a winner go, engines not swept stay.  The engine whose pair is given is never written nor removed."""
    if fixed_pair is not None:
        swept, won = (x.where(F.col("engine") != fixed_pair) for x in (swept, won))
    return frozen.join(swept.select("engine").distinct(), "engine", "left_anti").unionByName(won.select(*frozen.columns))
