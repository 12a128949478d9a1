"""The work of a long run as a stream of attempts, with what is known of each item in state.

An attempt is (item, seq, provenance, error): a null error is a result.  State holds one short row
an item: how often it was tried and failed, the last failure, and under which provenance its
newest result was made.  A failure leaves an earlier result as it is, so an item is done if it has a result
and a rerun does what `pending` tells.  Attempts may come in any order and in any batches; seq settles which is newer.

Each micro-batch writes the items it changed into a folder named by its number, and a batch that
runs again after a failure reads the state before it and writes its own folder anew, so a run
stopped anywhere goes on as if it had not been.  State is in RocksDB, which keeps it on disk.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from glyphmark.sources.paths import Files
from glyphmark.streaming import counters

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STATE = "attempts long, failures long, provenance string, result_seq long, error string, error_seq long"
NAMES = [c.split()[0] for c in STATE.split(", ")]


class Tracker(StatefulProcessor):
    """Folds an item's attempts into its state; nothing of them is kept."""

    def __init__(self, item: str):
        self.item = item

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", STATE)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        attempts, failures, provenance, result_seq, error, error_seq = tuple(self.known.get()) if self.known.exists() else (0, 0, None, None, None, None)
        for row in rows:
            attempts += 1
            if row["error"] is not None:
                failures += 1
                if error_seq is None or (row["seq"], row["error"]) > (error_seq, error):
                    error, error_seq = row["error"], row["seq"]
            elif result_seq is None or (row["seq"], row["provenance"] or "") > (result_seq, provenance or ""):
                provenance, result_seq = row["provenance"], row["seq"]
        now = (attempts, failures, provenance, result_seq, error, error_seq)
        self.known.update(now)
        yield Row(**dict(zip((self.item, *NAMES), (*key, *now), strict=True)))

    def close(self) -> None:
        pass


def track(stream: DataFrame, folder: str, item: str = "item", before_commit=None):
    """Starts a query that takes all that has come and stops; `folder` keeps state, progress and the items' rows.

    before_commit(number), if given, is called when a batch's rows are written and before it counts as done."""
    spark, kind = stream.sparkSession, stream.schema[item].dataType.simpleString()
    if spark.conf.get(PROVIDER, "") != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)
    known = stream.select(item, "seq", "provenance", "error").groupBy(item).transformWithState(Tracker(item), f"`{item}` {kind}, {STATE}", "Update", "None")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/items/batch={number}")
        if before_commit:
            before_commit(number)

    return known.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str, item: str, kind: str) -> DataFrame:
    """Each item as the last batch that changed it left it; none before any batch."""
    schema = f"`{item}` {kind}, {STATE}"
    if not Files(spark, f"{folder}/items").exists():
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/items")
    newest = Window.partitionBy(item).orderBy(F.desc("batch"))
    return rows.withColumn("__k", F.row_number().over(newest)).where("__k = 1").select(item, *NAMES)


def pending(wanted: DataFrame, known: DataFrame, item: str = "item", overwrite: bool = False) -> DataFrame:
    """wanted (item, provenance) without a result, and with `overwrite` also those whose result has another provenance."""
    return counters.pending(wanted, known.where("result_seq IS NOT NULL").select(item, "provenance"), item, "provenance", overwrite)


def mixed(wanted: DataFrame, known: DataFrame, item: str = "item") -> DataFrame:
    """item, wanted and found provenance of results that a rerun without `overwrite` would mix with others: it has to stop on any."""
    found = known.where("result_seq IS NOT NULL").select(item, F.col("provenance").alias("found"))
    return wanted.join(found, item).where(~F.col("provenance").eqNullSafe(F.col("found"))).select(item, F.col("provenance").alias("wanted"), "found")
