"""Experiment runs: arms and grids, guards on what may be scored, shards, ledgers and version pins."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmark.functions.digest import config_digest
from glyphmark.sources import paths

#: The engines' grids, stock first; the engine whose pair is given and not swept; the arms.
GRIDS = {
    "doctr": ({}, {"bin_thresh": 0.3, "box_thresh": 0.1}, {"bin_thresh": 0.3, "box_thresh": 0.3}, {"bin_thresh": 0.1, "box_thresh": 0.05}, {"bin_thresh": 0.5, "box_thresh": 0.3}),
    "pp-ocrv6_medium": ({}, {"text_det_limit_side_len": 1280}, {"text_det_limit_side_len": 1920}, {"text_det_limit_side_len": 1280, "text_det_thresh": 0.2}, {"text_det_limit_side_len": 1280, "text_det_box_thresh": 0.3}, {"text_det_limit_side_len": 1280, "text_det_unclip_ratio": 2.0}),
    "easyocr": ({"text_threshold": 0.7, "low_text": 0.4}, {"text_threshold": 0.2, "low_text": 0.2}),
}
FIXED_PAIR = "easyocr"
VARIANTS = ("stock", "tuned")


def grid(spark, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """engine, trial_no, config, config_hash of all trials within the budget of each engine; and engine, kept, dropped."""
    rows = [(e, k, json.dumps(c, sort_keys=True), config_digest(c)) for e, configs in GRIDS.items() for k, c in enumerate(configs)]
    return truncated(spark.createDataFrame(rows, "engine string, trial_no long, config string, config_hash string"), budget)


def truncated(trials: DataFrame, budget: int | None) -> tuple[DataFrame, DataFrame]:
    """The first trials of each engine, and how many were kept and dropped; no budget keeps all."""
    numbered = trials.withColumn("__k", F.row_number().over(Window.partitionBy("engine").orderBy("trial_no")))
    fits = F.lit(True) if budget is None else F.col("__k") <= budget
    return numbered.where(fits).drop("__k"), numbered.groupBy("engine").agg(F.count_if(fits).alias("kept"), F.count_if(~fits).alias("dropped"))


def arm(name: str, frozen: dict[str, dict]) -> dict:
    """The configuration of `engine:variant`.  A tuned arm of a swept engine must have been frozen; it never falls back to stock."""
    engine, _, variant = name.partition(":")
    if engine not in GRIDS or variant not in VARIANTS:
        raise ValueError(f"unknown arm {name!r}; there are {[f'{e}:{v}' for e in GRIDS for v in VARIANTS]}")
    if variant == "stock":
        return dict(GRIDS[engine][0])
    if engine == FIXED_PAIR:
        return dict(GRIDS[engine][1])
    if not frozen.get(engine):
        raise LookupError(f"no frozen configuration of {engine}; run the sweep on the development set first")
    return dict(frozen[engine])


def scored_set_violations(inputs: DataFrame, scored: DataFrame) -> DataFrame:
    """inputs and scored (path, sha256).  path, code: an input that is the scored set by its path or by its content.  Nothing overrides it."""
    by_path = inputs.join(scored.select("path").distinct(), "path", "left_semi").select("path", F.lit("SAME_PATH").alias("code"))
    by_hash = inputs.join(scored.select("sha256").where("sha256 <> ''").distinct(), "sha256", "left_semi").select("path", F.lit("SAME_CONTENT").alias("code"))
    return by_path.unionByName(by_hash)


IDENTITY = ("gt_name", "gt_hash", "n_images")


def shard_violations(shards: DataFrame) -> DataFrame:
    """shards (shard, engine, gt_name, gt_hash, n_images), a row an engine a shard.

    code, value, n: ENGINE_REPEATED in n shards; DEV_SET_DIFFERS for each development set after the first by name, with its shards.
    """
    again = shards.groupBy(F.col("engine").alias("value")).agg(F.count_distinct("shard").alias("n")).where("n > 1").select(F.lit("ENGINE_REPEATED").alias("code"), "value", "n")
    sets = shards.groupBy(*IDENTITY).agg(F.count_distinct("shard").alias("n"))
    # A row a development set.
    sets = sets.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*IDENTITY))).where("k > 1")
    return again.unionByName(sets.select(F.lit("DEV_SET_DIFFERS").alias("code"), F.concat_ws("|", *[F.col(c).cast("string") for c in IDENTITY]).alias("value"), "n"))


def merge_shards(shards: DataFrame) -> DataFrame:
    """The shards as one; shards that disagree are refused."""
    found = shard_violations(shards).limit(20).collect()
    if found:
        raise ValueError("shards can't be merged: " + "; ".join(f"{r['code']} {r['value']}" for r in found))
    return shards


def version_pins(replies: DataFrame) -> DataFrame:
    """replies (run_id, seq, version).  run_id, pinned, n_other: the version that the first reply tells pins a run; later replies with another one are counted.

    A null version is another one, unless no reply has any.
    """
    first = F.min_by("version", "seq")
    pinned = replies.groupBy("run_id").agg(first.alias("pinned"))
    return replies.join(pinned, "run_id").groupBy("run_id", "pinned").agg(F.count_if(~F.col("version").eqNullSafe(F.col("pinned"))).alias("n_other"))


def floor_order(events: DataFrame) -> DataFrame:
    """events (run_id, seq, kind 'floor' or 'accuracy', crops).  run_id, code: OK, FLOOR_ABSENT (none, or of no crops), FLOOR_LATE."""
    sound = (F.col("kind") == "floor") & (F.col("crops") > 0)
    by = events.groupBy("run_id").agg(F.min(F.when(sound, F.col("seq"))).alias("floor"), F.min(F.when(F.col("kind") == "accuracy", F.col("seq"))).alias("accuracy"))
    return by.select("run_id", F.when(F.col("floor").isNull(), "FLOOR_ABSENT").when(F.col("accuracy") < F.col("floor"), "FLOOR_LATE").otherwise("OK").alias("code"))


class RunLedger:
    """A run's state in its output folder: RUNNING, then COMPLETE with all tables or INCOMPLETE with none.

    A folder that holds anything is refused.  Tables are written to a pending folder, which is renamed to
    `tables` as a whole when the run ends well and every expected table is there: readers see all or
    none, whatever stops the run.  A rename that fails leaves the run INCOMPLETE.  The state is one
    small JSON file; of a failed run it tells which tables were written and which not, and the failure's kind.
    """

    def __init__(self, spark, folder: str, expected: tuple[str, ...] = ()):
        self.spark, self.folder, self.expected = spark, folder.rstrip("/"), tuple(expected)
        if paths.listed(spark, self.folder):
            raise FileExistsError(f"{folder} is not empty")
        self.tables: list[str] = []
        self._say("RUNNING")

    def _say(self, status: str, **more) -> None:
        told = {"status": status, "tables": sorted(self.tables) if status == "COMPLETE" else [], "done": sorted(self.tables), "pending": sorted(set(self.expected) - set(self.tables)), **more}
        paths.write_text(self.spark, f"{self.folder}/run_status.json", json.dumps(told, sort_keys=True))

    def add(self, name: str, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.folder}/_pending/{name}")
        self.tables.append(name)
        self._say("RUNNING")

    def __enter__(self) -> RunLedger:
        return self

    def __exit__(self, kind, error, trace) -> None:
        try:
            if kind is None:
                absent = sorted(set(self.expected) - set(self.tables))
                if absent:
                    raise ValueError(f"tables without a result: {', '.join(absent)}")
                if self.tables:
                    paths.move(self.spark, f"{self.folder}/_pending", f"{self.folder}/tables")
        except Exception as failure:
            kind = type(failure)
            raise
        finally:
            if kind is None:
                self._say("COMPLETE")
            else:
                paths.remove(self.spark, f"{self.folder}/_pending")
                self._say("INCOMPLETE", failure=kind.__name__)


def collate(spark, folders: list[str]) -> DataFrame:
    """folder, status, tables: a row a run, EMPTY for one that never began and UNREADABLE for a broken ledger."""
    rows = []
    for folder in folders:
        text = paths.read_text(spark, f"{folder.rstrip('/')}/run_status.json")
        try:
            told = json.loads(text) if text is not None else {"status": "EMPTY"}
            rows.append((folder, str(told["status"]), sorted(told.get("tables", []))))
        except (ValueError, KeyError, TypeError):
            rows.append((folder, "UNREADABLE", []))
    return spark.createDataFrame(rows, "folder string, status string, tables array<string>")
