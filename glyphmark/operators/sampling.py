"""Stratified draws: vendors in turn, candidates in the order of a seeded hash, until the quota."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def draw(candidates: DataFrame, quotas: DataFrame, seed: str, excluded: DataFrame | None = None) -> DataFrame:
    """candidates (uid, stratum, vendor), quotas (stratum, quota): the drawn rows with their round and turn."""
    rows = candidates if excluded is None else candidates.join(excluded.select("uid"), "uid", "left_anti")
    key = F.sha2(F.concat(F.lit(f"{seed}|"), F.col("uid")), 256)
    turn = Window.partitionBy("stratum", "vendor").orderBy(key, "uid")
    top = rows.join(F.broadcast(quotas), "stratum").withColumn("round", F.row_number().over(turn)).where("round <= quota")
    return top.withColumn("pick", F.row_number().over(Window.partitionBy("stratum").orderBy("round", "vendor"))).where("pick <= quota").drop("quota")


def report(candidates: DataFrame, quotas: DataFrame, drawn: DataFrame) -> DataFrame:
    have = candidates.groupBy("stratum").agg(F.count("*").alias("available"))
    got = drawn.groupBy("stratum").agg(F.count("*").alias("drawn"))
    out = quotas.join(have, "stratum", "left").join(got, "stratum", "left").fillna(0, ["available", "drawn"])
    return out.withColumn("short", F.col("drawn") < F.col("quota"))
