"""Reports of runs, sweeps and ground truth: each block is a roll-up, its notes stand with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmark.functions.text import cost_text, float_text, int_text, percent
from glyphmark.plans.report import sections

HEADLINE = ("grp", "n_images", "keep_total", "false_redaction_count", "false_redaction", "keep_exact_match_count", "keep_exact")


def headline(summary: DataFrame) -> DataFrame:
    return summary.where("grp = 'ALL'").withColumns({"false_redaction": percent(F.col("false_redaction_rate")), "keep_exact": percent(F.col("keep_exact_rate"))}).select(*HEADLINE)


def found_and_added(summary: DataFrame) -> DataFrame:
    """The two axes side by side, never added up."""
    return summary.where("grp = 'ALL'").select("grp", "gt_total", F.col("found_count").alias("found"), F.col("omission_count").alias("omitted"), F.col("added_count").alias("added"))


def by_stratum(summary: DataFrame) -> DataFrame:
    return summary.where("grp <> 'ALL'").withColumns({"false_redaction": percent(F.col("false_redaction_rate")), "keep_exact": percent(F.col("keep_exact_rate"))}).select(*HEADLINE, "found_count", "omission_count", "added_count")


def latency_and_cost(summary: DataFrame) -> DataFrame:
    text = {c: float_text(F.col(c), 4) for c in ("latency_mean", "latency_median", "latency_p95")}
    return summary.select("grp", "n_images", *[v.alias(c) for c, v in text.items()], cost_text(F.col("cost_sum")).alias("cost_sum"), cost_text(F.col("cost_mean")).alias("cost_mean"))


def floor(summary: DataFrame) -> DataFrame:
    return summary.select("grp", "n_blank", int_text(F.when(F.col("n_blank") > 0, F.col("floor_count"))).alias("invented"), float_text(F.col("floor_per_image"), 4).alias("per_image"))


def detector(view: DataFrame) -> DataFrame:
    """A missing rate is n/a with its reason."""
    return view.select("grp", "n_text", "n_blank", "found", "tokens", "added", percent(F.col("recall"), "n/a").alias("recall"), percent(F.col("precision"), "n/a").alias("precision"), F.coalesce("recall_na", "precision_na", F.lit("")).alias("why"))


def diagnostic(summary: DataFrame) -> DataFrame:
    return summary.select("grp", "n_cer_images", float_text(F.col("cer_mean"), 4).alias("cer"), float_text(F.col("wer_mean"), 4).alias("wer"), "keep_chars_total", "keep_chars_censored", percent(F.col("char_censor_rate")).alias("char_censor"))


NOTES = {
    "Headline": "Rates count KEEP tokens only.",
    "Found vs Added": "Omissions and inventions are two axes; no figure blends them.",
    "Negative-control floor": "Blank images only; no blank image means no floor, not a floor of zero.",
    "Detector-only view": "Images without boxes or without a matcher are left out of the rates and counted.",
    "Diagnostic appendix": "Never a ranking signal.",
}


def run_blocks(summary: DataFrame, view: DataFrame) -> dict[str, DataFrame]:
    """The seven blocks of a run's report; they take only the aggregates, never rows of images."""
    return {"Headline": headline(summary), "Found vs Added": found_and_added(summary), "Per-stratum breakout": by_stratum(summary), "Latency & cost": latency_and_cost(summary), "Negative-control floor": floor(summary), "Detector-only view": detector(view), "Diagnostic appendix": diagnostic(summary)}


def run_report(title: str, facts: dict, summary: DataFrame, view: DataFrame) -> str:
    return sections(title, facts, run_blocks(summary, view), NOTES)


def chart_data(summary: DataFrame) -> DataFrame:
    """chart, grp, series, value: what the three charts draw (redaction by stratum, found and added, latency)."""
    pick = {"redaction": ("false_redaction_rate", "keep_exact_rate"), "found_added": ("found_count", "omission_count", "added_count"), "latency": ("latency_median", "latency_p95")}
    values = [F.struct(F.lit(chart).alias("chart"), F.lit(c).alias("series"), F.col(c).cast("double").alias("value")) for chart, columns in pick.items() for c in columns]
    return summary.select("grp", F.explode(F.array(*values)).alias("x")).select("x.chart", "grp", "x.series", "x.value")


def sweep_blocks(trials: DataFrame, regressed: DataFrame, won: DataFrame, metric: str) -> dict[str, DataFrame]:
    """Trials against stock with why a candidate is out, and each engine's winner, or none."""
    stock = trials.where("trial_no = 0").select("engine", F.col(metric).alias("stock"))
    worst = regressed.groupBy("engine", "trial_no").agg(F.min_by("stratum", F.struct("delta", "stratum")).alias("worst_stratum"), F.min("delta").alias("worst_delta"))
    rows = trials.join(stock, "engine", "left").join(worst, ["engine", "trial_no"], "left")
    rows = rows.select("engine", "trial_no", metric, (F.col(metric) - F.col("stock")).alias("against_stock"), "worst_stratum", "worst_delta")
    chosen = trials.select("engine").distinct().join(won.select("engine", "trial_no"), "engine", "left")
    return {"Trials": rows, "Winners": chosen.select("engine", F.coalesce(F.col("trial_no").cast("string"), F.lit("none")).alias("trial_no"))}


def ground_truth_facts(new_hash: str, old_hash: str | None) -> dict:
    """The file's digest; a changed one voids every number reported on the old one, and says so."""
    facts = {"sha256": new_hash}
    if old_hash and old_hash != new_hash:
        facts["VOID"] = f"the ground truth changed from {old_hash[:12]}: every number reported on it no longer holds"
    return facts
