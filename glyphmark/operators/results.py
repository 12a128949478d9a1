"""Documents of results: what a number's reader has to know goes with the number."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmark.functions.geometry import CROP_HEIGHT, CROP_PAD
from glyphmark.sources import paths

#: What a result of the reading arm tells of itself.
READER_CAVEATS = {"arm": "reader", "oracle_detector": True, "detection_metrics": "undefined — GT boxes were supplied; no detector ran", "iou_thr": None}


def reader_document(summary: DataFrame, path: str, by: str = "grp") -> dict:
    """Writes the reading arm's roll-up (a row a group, the total named ALL) with its caveats as one JSON file, replaced as a whole."""
    rows = {r[by] if r[by] is not None else "(none)": {k: v for k, v in r.asDict().items() if k != by} for r in summary.collect()}
    total = rows.pop("ALL", {})
    told = {**READER_CAVEATS, "crop_preprocessing": {"pad_fraction": CROP_PAD, "height": CROP_HEIGHT}, **total, "groups": rows}
    paths.write_json(summary.sparkSession, told, path)
    return told


def frozen_document(winners: DataFrame, trials: DataFrame, dev_set: dict, metric: str, path: str, fixed_pair: str | None = None, regression: float | None = None, sources: Iterable[str] = ()) -> dict:
    """Merges a sweep's winners into the file of frozen configurations and writes it.

    winners (engine, trial_no), trials (engine, trial_no, config, config_hash, version): a row a trial.
    A winner's entry tells its configuration, digest, version, the size of the sweep, the metric and the bound of
    regressions; the document tells the development set and, if given, the reports it was selected from.  An engine that
    was swept without a winner loses its entry, one that wasn't swept keeps it, and the fixed pair is neither
    written nor removed.
    """
    spark = trials.sparkSession
    old = paths.read_text(spark, path)
    told = json.loads(old) if old is not None else {}
    engines = dict(told.get("engines", {}))
    sizes = trials.groupBy("engine").agg(F.count("*").alias("size"))
    chosen = sizes.join(winners.select("engine", "trial_no").join(trials, ["engine", "trial_no"]), "engine", "left")
    for r in chosen.collect():
        if r["engine"] == fixed_pair:
            continue
        engines.pop(r["engine"], None)
        if r["trial_no"] is not None:
            engines[r["engine"]] = {"config": json.loads(r["config"]), "config_hash": r["config_hash"], "engine_version": r["version"], "sweep_size": r["size"], "rank_metric": metric, "max_stratum_regression": regression}
    told = {**told, "engines": engines, "dev_set": dict(dev_set), "rank_metric": metric}
    told.pop("selected_offline_from", None)
    if sources := list(sources):
        told["selected_offline_from"] = sources
    paths.write_json(spark, told, path)
    return told


def ground_truth_banner(name: str, now: dict[str, str], before: dict[str, str]) -> list[str]:
    """The lines over a build's summary: both digests (contents and scope), and for each that changed that all earlier numbers are void."""
    changed = [k for k in now if before.get(k) not in (None, now[k])]
    lines = []
    if changed:
        lines += [f"VOID: every number reported against an earlier {name}"]
        lines += [f"  {k}: {before[k]} -> {now[k]}" for k in changed]
    return [*lines, *[f"{k} {v}" for k, v in now.items()]]


def scope_facts(name: str, contents: DataFrame, scope: DataFrame) -> DataFrame:
    """name, rows, images, text_images, blank_images: contents (image_id, a row a token) within scope (image_id, a row an image)."""
    seen = contents.groupBy("image_id").agg(F.count("*").alias("n"))
    both = scope.select("image_id").distinct().join(seen, "image_id", "left")
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"), F.count("*").alias("images"), F.count("n").alias("text_images"), F.count_if(F.col("n").isNull()).alias("blank_images")).select(F.lit(name).alias("name"), "*")


def collated_tables(spark, folders: list[str], name: str) -> DataFrame | None:
    """The table of that name of all complete runs as one, each row with its run's folder; None if no run has it."""
    found = []
    for folder in folders:
        text = paths.read_text(spark, f"{folder.rstrip('/')}/run_status.json")
        told = json.loads(text) if text else {}
        if told.get("status") == "COMPLETE" and name in told.get("tables", []):
            found.append(spark.read.parquet(f"{folder.rstrip('/')}/tables/{name}").withColumn("run", F.lit(folder)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else None


def footnotes(spark, reports: dict[str, str]) -> list[str]:
    """Each sweep's report (name to path) as a fenced footnote that says what it was tuned on; a missing one is left out."""
    out = []
    for name, path in reports.items():
        text = paths.read_text(spark, path)
        if text is not None:
            out += [f"# Tuning footnote (development set, not the scored set): {name}", "", "```", text.rstrip("\n"), "```", ""]
    return out
