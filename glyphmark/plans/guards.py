"""Queries of guards, pins, arms and report blocks."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from glyphmark.functions.text import cost_text, float_text, int_text
from glyphmark.operators import experiments, groundtruth, manifests, ocrseeds, reading, reconcile, rollup, selection
from glyphmark.plans import documents, evaluation
from glyphmark.plans import fixtures as fx
from glyphmark.plans.evaluation import DETECT, SCORES
from glyphmark.plans.registry import register
from glyphmark.plans.selection import TRIALS, WIN, _regressions, _trials

WITH = "WITH " + fx.SQL


@register("provenance_missing", "WITH p AS (SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE 'e' END END AS engine, CASE WHEN o_orderkey % 11 <> 0 THEN 'v1' END AS version FROM orders) SELECT image_id, concat_ws(',', CASE WHEN coalesce(trim(engine), '') = '' THEN 'engine' END, CASE WHEN version IS NULL THEN 'version' END) AS missing FROM p WHERE coalesce(trim(engine), '') = '' OR version IS NULL")
def provenance_missing(spark, d):
    k = F.col("o_orderkey")
    some = F.map_filter(F.create_map(F.lit("engine"), F.when(k % 7 == 0, "  ").otherwise("e"), F.lit("version"), F.when(k % 11 != 0, "v1")), lambda n, _: (n != "engine") | (k % 5 != 0))
    return reconcile.provenance_missing(fx.read(spark, d, "orders").select(k.alias("image_id"), some.alias("provenance")), ("engine", "version")).select("image_id", F.array_join("missing", ",").alias("missing"))


@register("scored_set_guard", "WITH f AS (SELECT 'p' || p_partkey AS path, sha256(CASE WHEN p_partkey % 40 = 3 THEN 's' || p_partkey ELSE p_partkey || '' END) AS h FROM part), s AS (SELECT 'p' || s_suppkey * 2 AS path, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE sha256('s' || s_suppkey) END AS h FROM supplier) SELECT path, 'SAME_PATH' AS code FROM f WHERE path IN (SELECT path FROM s) UNION ALL SELECT path, 'SAME_CONTENT' FROM f WHERE h IN (SELECT h FROM s)")
def scored_set_guard(spark, d):
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    name = lambda x: F.concat(F.lit("p"), x.cast("string"))
    said = lambda x: F.concat(F.lit("s"), x.cast("string"))
    inputs = fx.read(spark, d, "part").select(name(p).alias("path"), F.sha2(F.when(p % 40 == 3, said(p)).otherwise(p.cast("string")), 256).alias("sha256"))
    scored = fx.read(spark, d, "supplier").select(name(s * 2).alias("path"), F.when(s % 5 == 0, "").otherwise(F.sha2(said(s), 256)).alias("sha256"))
    return experiments.scored_set_violations(inputs, scored)


@register("version_pins", "WITH r AS (SELECT o_custkey % 200 AS run_id, o_orderkey AS seq, CASE WHEN o_custkey % 200 = 7 AND o_orderkey % 3 = 0 THEN 'v2' WHEN NOT (o_custkey % 200 = 9 AND o_orderkey % 5 = 0) THEN 'v1' END AS version FROM orders), p AS (SELECT run_id, arg_min(version, seq) AS pinned FROM (SELECT run_id, seq, version, min(seq) OVER (PARTITION BY run_id) AS m FROM r) WHERE seq = m GROUP BY run_id) SELECT run_id, pinned, count(*) FILTER (WHERE version IS DISTINCT FROM pinned) AS n_other FROM r JOIN p USING (run_id) GROUP BY run_id, pinned")
def version_pins(spark, d):
    c, k = F.col("o_custkey") % 200, F.col("o_orderkey")
    version = F.when((c == 7) & (k % 3 == 0), "v2").when(~((c == 9) & (k % 5 == 0)), "v1")
    return experiments.version_pins(fx.read(spark, d, "orders").select(c.alias("run_id"), k.alias("seq"), version.alias("version")))


@register("floor_order", "WITH e AS (SELECT o_custkey % 300 AS run_id, o_orderkey AS seq, CASE WHEN o_orderkey % 4 = 0 AND o_custkey % 300 <> 11 THEN 'floor' ELSE 'accuracy' END AS kind, CASE WHEN o_custkey % 300 = 12 THEN 0 ELSE o_orderkey % 3 END AS crops FROM orders), b AS (SELECT run_id, min(seq) FILTER (WHERE kind = 'floor' AND crops > 0) AS f, min(seq) FILTER (WHERE kind = 'accuracy') AS a FROM e GROUP BY run_id) SELECT run_id, CASE WHEN f IS NULL THEN 'FLOOR_ABSENT' WHEN a < f THEN 'FLOOR_LATE' ELSE 'OK' END AS code FROM b")
def floor_order(spark, d):
    c, k = F.col("o_custkey") % 300, F.col("o_orderkey")
    return experiments.floor_order(fx.read(spark, d, "orders").select(c.alias("run_id"), k.alias("seq"), F.when((k % 4 == 0) & (c != 11), "floor").otherwise("accuracy").alias("kind"), F.when(c == 12, 0).otherwise(k % 3).alias("crops")))


GRID_SQL = ", ".join(f"('{e}', {k}, '{json.dumps(c, sort_keys=True)}')" for e, g in experiments.GRIDS.items() for k, c in enumerate(g))


@register("sweep_grid", f"WITH g AS (SELECT engine, trial_no, config, row_number() OVER (PARTITION BY engine ORDER BY trial_no) - 1 AS k FROM (VALUES {GRID_SQL}) g(engine, trial_no, config)), e AS (SELECT engine, row_number() OVER (ORDER BY engine) - 1 AS k FROM (SELECT DISTINCT engine FROM g)) SELECT engine, trial_no, config, substr(sha256(config), 1, 12) AS config_hash, count(*) AS n_images FROM orders JOIN e ON o_custkey % 3 = e.k JOIN g USING (engine) WHERE g.k < 5 GROUP BY ALL")
def sweep_grid(spark, d):
    """The trials of each engine within a budget of five, with the images that a development set deals to it."""
    engines = F.array(*[F.lit(e) for e in sorted(experiments.GRIDS)])
    images = fx.read(spark, d, "orders").groupBy(F.get(engines, (F.col("o_custkey") % 3).cast("int")).alias("engine")).agg(F.count("*").alias("n_images"))
    return experiments.grid(spark, 5)[0].join(images, "engine").select("engine", "trial_no", "config", "config_hash", "n_images")


@register("render_last_wins", "SELECT o_custkey AS image_id, max(o_orderkey) AS at, arg_max(o_orderpriority, o_orderkey) AS sha256 FROM orders GROUP BY 1")
def render_last_wins(spark, d):
    rows = fx.read(spark, d, "orders").select(F.col("o_custkey").alias("image_id"), F.col("o_orderkey").alias("at"), F.col("o_orderpriority").alias("sha256"))
    return manifests.last_wins(rows, "image_id", "at")


@register("gt_rows_by_vendor", WITH + " SELECT coalesce(vendor, 'ALL') AS grp, count(DISTINCT i.image_id) AS images, count(DISTINCT gt.image_id) AS with_text, count(gt.image_id) AS n_rows, count(*) FILTER (WHERE label = 'KEEP') AS keep, count(*) FILTER (WHERE label = 'PHI') AS phi, count(DISTINCT i.image_id) - count(DISTINCT gt.image_id) AS blank FROM images i LEFT JOIN gt USING (image_id) GROUP BY GROUPING SETS ((vendor), ())")
def gt_rows_by_vendor(spark, d):
    return groundtruth.summary(fx.images(spark, d), fx.gt_tokens(spark, d), "vendor")


@register("zero_text_strata", WITH + " SELECT 'f' || frame_idx AS grp, count(DISTINCT i.image_id) AS images FROM images i LEFT JOIN gt USING (image_id) GROUP BY 1 HAVING count(gt.image_id) = 0")
def zero_text_strata(spark, d):
    frames = fx.images(spark, d).select("image_id", F.concat(F.lit("f"), F.col("frame_idx").cast("string")).alias("frame"))
    return groundtruth.without_text(frames, fx.gt_tokens(spark, d), "frame")


@register("crop_digests", "SELECT p_partkey, sha256((p_partkey % 9 + 1) || 'x2|' || p_name) AS digest FROM part")
def crop_digests(spark, d):
    return fx.read(spark, d, "part").select("p_partkey", reading.crop_digest(F.col("p_partkey") % 9 + 1, F.lit(2), F.col("p_name").cast("binary")).alias("digest"))


@register("fmt_numbers", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '—' ELSE CAST(p_partkey AS VARCHAR) END AS whole, CASE WHEN p_partkey % 10 = 0 THEN '—' ELSE format('{:.4f}', (p_partkey % 97) / 8.0) END AS decimal, CASE WHEN p_partkey % 10 = 0 THEN '—' ELSE '$' || format('{:.6f}', (p_partkey % 97) / 64.0) END AS cost FROM part")
def fmt_numbers(spark, d):
    k = F.col("p_partkey")
    some = lambda x: F.when(k % 10 != 0, x)
    return fx.read(spark, d, "part").select("p_partkey", int_text(some(k)).alias("whole"), float_text(some(k % 97 / 8.0)).alias("decimal"), cost_text(some(k % 97 / 64.0)).alias("cost"))


@register("confidence_by_level", "SELECT p_size % 7 AS level, count(c) AS n, min(c) AS lo, median(c) AS mid, max(c) AS hi FROM (SELECT p_size, CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_partkey % 101 AS DOUBLE) END AS c FROM part) GROUP BY 1")
def confidence_by_level(spark, d):
    rows = fx.read(spark, d, "part").select((F.col("p_size") % 7).alias("level"), F.when(F.col("p_partkey") % 9 != 0, (F.col("p_partkey") % 101).cast("double")).alias("confidence"))
    return ocrseeds.confidence_stats(rows, "level")


def _summary(spark, d):
    return rollup.run_summary(evaluation.scores(spark, d), evaluation.latencies(spark, d))


PCT = "CASE WHEN {1} = 0 THEN '—' ELSE format('{{:.2f}}%', 100 * {0} / {1}) END"
SUM_SQL = f"WITH RECURSIVE {SCORES}, s AS (SELECT coalesce(stratum, 'ALL') AS grp, count(*) AS n_images, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('keep_total', 'false_redaction_count', 'keep_exact_match_count', 'gt_total', 'found_count', 'omission_count', 'added_count', 'floor_count', 'keep_chars_total', 'keep_chars_censored'))}, count(*) FILTER (WHERE negative_control) AS n_blank, sum(cost) AS cost, avg(cer) AS cer, avg(wer) AS wer, count(cer) AS n_cer_images FROM scores GROUP BY GROUPING SETS ((stratum), ()))"


@register("report_headline", SUM_SQL + f" SELECT grp, n_images, keep_total, false_redaction_count, {PCT.format('false_redaction_count', 'keep_total')} AS false_redaction, keep_exact_match_count, {PCT.format('keep_exact_match_count', 'keep_total')} AS keep_exact FROM s WHERE grp = 'ALL'")
def report_headline(spark, d):
    return documents.headline(_summary(spark, d))


@register("report_found_added", SUM_SQL + " SELECT grp, gt_total, found_count AS found, omission_count AS omitted, added_count AS added FROM s WHERE grp = 'ALL'")
def report_found_added(spark, d):
    return documents.found_and_added(_summary(spark, d))


@register("report_by_stratum", SUM_SQL + f" SELECT grp, n_images, keep_total, false_redaction_count, {PCT.format('false_redaction_count', 'keep_total')} AS false_redaction, keep_exact_match_count, {PCT.format('keep_exact_match_count', 'keep_total')} AS keep_exact, found_count, omission_count, added_count FROM s WHERE grp <> 'ALL'")
def report_by_stratum(spark, d):
    return documents.by_stratum(_summary(spark, d))


@register("report_floor", SUM_SQL + " SELECT grp, n_blank, CASE WHEN n_blank = 0 THEN '—' ELSE CAST(floor_count AS VARCHAR) END AS invented, CASE WHEN n_blank = 0 THEN '—' ELSE format('{:.4f}', floor_count / n_blank) END AS per_image FROM s")
def report_floor(spark, d):
    return documents.floor(_summary(spark, d))


@register("report_diagnostic", SUM_SQL + f" SELECT grp, n_cer_images, format('{{:.4f}}', cer) AS cer, format('{{:.4f}}', wer) AS wer, keep_chars_total, keep_chars_censored, {PCT.format('keep_chars_censored', 'keep_chars_total')} AS char_censor FROM s")
def report_diagnostic(spark, d):
    return documents.diagnostic(_summary(spark, d))


@register("report_detector", f"WITH RECURSIVE {DETECT} SELECT grp, n_text, n_blank, found, tokens, added, CASE WHEN tokens = 0 THEN 'n/a' ELSE format('{{:.2f}}%', 100 * found / tokens) END AS recall, CASE WHEN found + added = 0 THEN 'n/a' ELSE format('{{:.2f}}%', 100 * found / (found + added)) END AS precision, '' AS why FROM dv")
def report_detector(spark, d):
    return documents.detector(rollup.detection_view(evaluation._detectable(spark, d)))


@register("report_latency_cost")
def report_latency_cost(spark, d):
    return documents.latency_and_cost(_summary(spark, d))


@register("report_charts", SUM_SQL + " SELECT 'redaction' AS chart, grp, 'false_redaction_rate' AS series, false_redaction_count / nullif(keep_total, 0) AS value FROM s UNION ALL SELECT 'redaction', grp, 'keep_exact_rate', keep_exact_match_count / nullif(keep_total, 0) FROM s UNION ALL SELECT 'found_added', grp, 'found_count', CAST(found_count AS DOUBLE) FROM s UNION ALL SELECT 'found_added', grp, 'omission_count', CAST(omission_count AS DOUBLE) FROM s UNION ALL SELECT 'found_added', grp, 'added_count', CAST(added_count AS DOUBLE) FROM s")
def report_charts(spark, d):
    """The counts and rates of the charts; latency_stats has what the third one draws."""
    return documents.chart_data(_summary(spark, d)).where("chart <> 'latency'")


@register("sweep_winner_block", f"WITH {TRIALS}, w AS ({WIN.format(m='fr', o='ASC', c='<')}) SELECT e.engine, coalesce(CAST(w.trial_no AS VARCHAR), 'none') AS trial_no FROM (SELECT DISTINCT engine FROM tr) e LEFT JOIN w USING (engine)")
def sweep_winner_block(spark, d):
    trials, out = _trials(spark, d), _regressions(spark, d)
    return documents.sweep_blocks(trials, out, selection.winners(trials, out, "fr", descending=False), "fr")["Winners"]


@register("sweep_trial_block", f"WITH {TRIALS}, x AS (SELECT engine, trial_no, arg_min(stratum, delta) AS worst_stratum, min(delta) AS worst_delta FROM rg GROUP BY 1, 2) SELECT c.engine, c.trial_no, c.fr, c.fr - s.fr AS against_stock, worst_stratum, worst_delta FROM tr c LEFT JOIN tr s ON s.engine = c.engine AND s.trial_no = 0 LEFT JOIN x ON x.engine = c.engine AND x.trial_no = c.trial_no")
def sweep_trial_block(spark, d):
    trials, out = _trials(spark, d), _regressions(spark, d)
    return documents.sweep_blocks(trials, out, selection.winners(trials, out, "fr", descending=False), "fr")["Trials"]
