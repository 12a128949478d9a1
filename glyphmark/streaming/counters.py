"""Running counters over appended rows, and what a rerun has left to do.

An extension: counts and sums of scores add up, so each micro-batch writes its partial counters into
a folder named by its batch number.  A batch that is run again after a failure overwrites its own
folder, so nothing counts twice.  Percentiles don't add up and stay with the batch queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glyphmark.sources.paths import Files


def append(stream: DataFrame, keys: list[str], values: list[str], folder: str):
    """Starts a query that takes all that has come and stops; `folder` keeps counters and progress."""

    def each(batch: DataFrame, number: int) -> None:
        sums = [F.sum(F.coalesce(F.col(v).cast("double"), F.lit(0.0))).alias(v) for v in values]
        batch.groupBy(*keys).agg(F.count("*").alias("n"), *sums).write.mode("overwrite").parquet(f"{folder}/counters/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


def totals(spark: SparkSession, keys: list[str], values: list[str], folder: str, schema: StructType | None = None) -> DataFrame:
    """One row for each key; none, if no batch came yet and the stream's schema is given."""
    if schema is not None and not Files(spark, f"{folder}/counters").exists():
        kinds = [f"`{k}` {schema[k].dataType.simpleString()}" for k in keys] + ["n long"] + [f"`{v}` double" for v in values]
        return spark.createDataFrame([], ", ".join(kinds))
    return spark.read.parquet(f"{folder}/counters").groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(v).alias(v) for v in values])


def pending(wanted: DataFrame, done: DataFrame, key: str, provenance: str, overwrite: bool = False) -> DataFrame:
    """Items a rerun has to do: those not done (a failed one left nothing), and with `overwrite` also
    those done under another provenance."""
    have = done.select(F.col(key).alias("_k"), F.col(provenance).alias("_p")).distinct()
    same = wanted[key] == F.col("_k")
    return wanted.join(have, same & wanted[provenance].eqNullSafe(F.col("_p")) if overwrite else same, "left_anti")
