"""Queries of sweeps, samples and ground-truth assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmark.operators import experiments, groundtruth, manifests, reconcile, review, sampling, selection
from glyphmark.plans import fixtures as fx
from glyphmark.plans.evaluation import PAIRS
from glyphmark.plans.registry import register

WITH = "WITH " + fx.SQL
TRIALS = "st AS (SELECT 'e' || o_custkey % 7 AS engine, o_custkey % 5 AS trial_no, o_orderpriority AS stratum, CAST(sum(o_orderkey % 97) AS DOUBLE) / count(*) AS exact, CAST(sum(o_orderkey % 89) AS DOUBLE) / count(*) AS fr FROM orders GROUP BY 1, 2, 3), tr AS (SELECT 'e' || o_custkey % 7 AS engine, o_custkey % 5 AS trial_no, CAST(sum(o_orderkey % 97) AS DOUBLE) / count(*) AS exact, CAST(sum(o_orderkey % 89) AS DOUBLE) / count(*) AS fr FROM orders GROUP BY 1, 2), rg AS (SELECT c.engine, c.trial_no, c.stratum, c.exact - s.exact AS delta FROM st c JOIN st s ON c.engine = s.engine AND c.stratum = s.stratum AND s.trial_no = 0 WHERE c.trial_no > 0 AND c.exact - s.exact < -2.5)"


def _trials(spark, d, *by):
    k = F.col("o_orderkey")
    rows = fx.read(spark, d, "orders").select(F.concat(F.lit("e"), (F.col("o_custkey") % 7).cast("string")).alias("engine"), (F.col("o_custkey") % 5).alias("trial_no"), F.col("o_orderpriority").alias("stratum"), (k % 97).alias("x"), (k % 89).alias("y"))
    return rows.groupBy("engine", "trial_no", *by).agg((F.sum("x").cast("double") / F.count("*")).alias("exact"), (F.sum("y").cast("double") / F.count("*")).alias("fr"))


def _regressions(spark, d):
    return selection.regressions(_trials(spark, d), _trials(spark, d, "stratum"), "exact", 2.5)


@register("stratum_regressions", f"WITH {TRIALS} SELECT * FROM rg")
def stratum_regressions(spark, d):
    return _regressions(spark, d)


@register("worst_regression", f"WITH {TRIALS} SELECT engine, trial_no, stratum, delta FROM rg QUALIFY row_number() OVER (PARTITION BY engine, trial_no ORDER BY delta, stratum) = 1")
def worst_regression(spark, d):
    return selection.worst(_regressions(spark, d))


WIN = "SELECT b.engine, b.trial_no, b.{m} AS value, s.{m} AS stock FROM (SELECT * FROM tr WHERE trial_no > 0 AND (engine, trial_no) NOT IN (SELECT engine, trial_no FROM rg) QUALIFY row_number() OVER (PARTITION BY engine ORDER BY {m} {o} NULLS LAST, trial_no) = 1) b JOIN tr s ON s.engine = b.engine AND s.trial_no = 0 WHERE b.{m} {c} s.{m}"


@register("select_winner", f"WITH {TRIALS} {WIN.format(m='fr', o='ASC', c='<')}")
def select_winner(spark, d):
    return selection.winners(_trials(spark, d), _regressions(spark, d), "fr", descending=False)


@register("select_winner_by_exact", f"WITH {TRIALS} {WIN.format(m='exact', o='DESC', c='>')}")
def select_winner_by_exact(spark, d):
    return selection.winners(_trials(spark, d), _regressions(spark, d), "exact", descending=True)


@register("freeze_winners", f"WITH {TRIALS}, w AS ({WIN.format(m='fr', o='ASC', c='<')}), f(engine, trial_no) AS (VALUES ('e0', 9), ('e1', 9), ('e2', 9), ('x', 9)) SELECT engine, trial_no FROM f WHERE engine = 'e2' OR engine NOT IN (SELECT engine FROM tr) UNION ALL SELECT engine, trial_no FROM w WHERE engine <> 'e2'")
def freeze_winners(spark, d):
    trials = _trials(spark, d)
    frozen = spark.createDataFrame([("e0", 9), ("e1", 9), ("e2", 9), ("x", 9)], "engine string, trial_no long")
    won = selection.winners(trials, _regressions(spark, d), "fr", descending=False).withColumn("trial_no", F.col("trial_no").cast("long"))
    return selection.freeze(frozen, trials, won, fixed_pair="e2")


@register("budget_grid", f"WITH {TRIALS} SELECT engine, count(*) FILTER (WHERE trial_no < 3) AS kept, count(*) FILTER (WHERE trial_no >= 3) AS dropped FROM tr GROUP BY engine")
def budget_grid(spark, d):
    return experiments.truncated(_trials(spark, d), 3)[1]


@register("merge_shards", "WITH s AS (SELECT DISTINCT 's' || o_custkey % 6 AS shard, 'e' || o_custkey % 4 AS engine, CASE WHEN o_custkey % 6 = 2 THEN 'dev_b' ELSE 'dev_a' END AS gt_name, CASE WHEN o_custkey % 6 = 5 THEN 'h2' ELSE 'h1' END AS gt_hash FROM orders) SELECT 'ENGINE_REPEATED' AS code, engine AS value, count(DISTINCT shard) AS n FROM s GROUP BY engine HAVING count(DISTINCT shard) > 1 UNION ALL SELECT 'DEV_SET_DIFFERS', gt_name || '|' || gt_hash || '|22', n FROM (SELECT gt_name, gt_hash, count(DISTINCT shard) AS n, row_number() OVER (ORDER BY gt_name, gt_hash) AS k FROM s GROUP BY gt_name, gt_hash) WHERE k > 1")
def merge_shards(spark, d):
    c = F.col("o_custkey")
    shards = fx.read(spark, d, "orders").select(F.concat(F.lit("s"), (c % 6).cast("string")).alias("shard"), F.concat(F.lit("e"), (c % 4).cast("string")).alias("engine"), F.when(c % 6 == 2, "dev_b").otherwise("dev_a").alias("gt_name"), F.when(c % 6 == 5, "h2").otherwise("h1").alias("gt_hash"), F.lit(22).alias("n_images")).distinct()
    return experiments.shard_violations(shards)


SERIES = "cd AS (SELECT 's' || o_orderkey AS uid, c_mktsegment AS stratum, n_name AS vendor FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), ex AS (SELECT DISTINCT 's' || o_orderkey AS uid FROM orders WHERE o_orderkey % 6 IN (1, 2)), q(stratum, quota) AS (VALUES ('BUILDING', 40), ('MACHINERY', 7), ('AUTOMOBILE', 1000000)), r AS (SELECT cd.*, quota, row_number() OVER (PARTITION BY stratum, vendor ORDER BY sha256('seed1|' || uid), uid) AS round FROM cd JOIN q USING (stratum) WHERE uid NOT IN (SELECT uid FROM ex)), dr AS (SELECT uid, stratum, vendor, round, row_number() OVER (PARTITION BY stratum ORDER BY round, vendor) AS pick, quota FROM r QUALIFY pick <= quota)"


def _series(spark, d):
    rows = fx.images(spark, d).select(F.concat(F.lit("s"), F.col("image_id").cast("string")).alias("uid"), "stratum", "vendor")
    quotas = spark.createDataFrame([("BUILDING", 40), ("MACHINERY", 7), ("AUTOMOBILE", 1000000)], "stratum string, quota int")
    return rows, quotas, _excluded(spark, d)


def _excluded(spark, d):
    o = fx.read(spark, d, "orders").select(F.concat(F.lit(" s"), F.col("o_orderkey").cast("string"), F.lit(" ")).alias("series_uid"), "o_orderkey")
    return reconcile.excluded([o.where("o_orderkey % 6 = 1"), o.where("o_orderkey % 6 IN (1, 2)")]).select(F.col("series_uid").alias("uid"))


@register("excluded_keys", f"WITH {SERIES} SELECT uid FROM ex")
def excluded_keys(spark, d):
    return _excluded(spark, d)


@register("draw_slice", f"WITH {SERIES} SELECT uid, stratum, vendor, round, pick FROM dr")
def draw_slice(spark, d):
    rows, quotas, gone = _series(spark, d)
    return sampling.draw(rows, quotas, "seed1", gone)


@register("draw_report", f"WITH {SERIES} SELECT q.stratum, q.quota, (SELECT count(*) FROM cd WHERE cd.stratum = q.stratum) AS available, (SELECT count(*) FROM dr WHERE dr.stratum = q.stratum) AS drawn, (SELECT count(*) FROM dr WHERE dr.stratum = q.stratum) < q.quota AS short FROM q")
def draw_report(spark, d):
    rows, quotas, gone = _series(spark, d)
    return sampling.report(rows, quotas, sampling.draw(rows, quotas, "seed1", gone))


@register("build_gt_rows", WITH + " SELECT sha256('s' || image_id) AS series_uid, modality, vendor, stratum, frame_idx, token_text, gt.x0, gt.y0, gt.x1, gt.y1, label FROM gt JOIN images USING (image_id)")
def build_gt_rows(spark, d):
    backmap = fx.images(spark, d).select("image_id", F.sha2(F.concat(F.lit("s"), F.col("image_id").cast("string")), 256).alias("series_uid"), "frame_idx")
    manifest = fx.images(spark, d).select(F.sha2(F.concat(F.lit("s"), F.col("image_id").cast("string")), 256).alias("series_uid"), "modality", "vendor", "stratum")
    return groundtruth.build_rows(fx.gt_tokens(spark, d), backmap, manifest).select("series_uid", "modality", "vendor", "stratum", "frame_idx", "token_text", "x0", "y0", "x1", "y1", "label")


@register("gt_summary", WITH + " SELECT coalesce(stratum, 'ALL') AS grp, count(DISTINCT i.image_id) AS images, count(DISTINCT gt.image_id) AS with_text, count(gt.image_id) AS n_rows, count(*) FILTER (WHERE label = 'KEEP') AS keep, count(*) FILTER (WHERE label = 'PHI') AS phi FROM images i LEFT JOIN gt USING (image_id) GROUP BY GROUPING SETS ((stratum), ())")
def gt_summary(spark, d):
    return groundtruth.summary(fx.images(spark, d), fx.gt_tokens(spark, d)).drop("blank")


DIFF = "df AS (SELECT image_id, g AS seed_index, CASE WHEN g % 7 = 0 AND confidence < 0.3 THEN 'hidden' WHEN g % 7 = 0 THEN 'deleted' WHEN g % 5 = 0 THEN 'text_fixed' WHEN g % 3 = 0 THEN 'box_fixed' ELSE 'unchanged' END AS change, coalesce(confidence >= 0.3, true) AS shown FROM gt UNION ALL SELECT image_id, g + 1000, 'added', true FROM gt WHERE g % 4 = 0)"


def _diff(spark, d):
    gt, g = fx.gt_tokens(spark, d), F.col("g")
    seed = gt.select("image_id", g.alias("seed_index"), F.col("token_text").alias("text"), "x0", "y0", "x1", "y1")
    kept = seed.where("seed_index % 7 <> 0").withColumns({"text": F.when(F.col("seed_index") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "x0": F.when(F.col("seed_index") % 3 == 0, F.col("x0") + 1).otherwise(F.col("x0"))})
    gated = gt.select("image_id", g.alias("seed_index"), F.col("token_text").alias("text"), "x0", "y0", "x1", "y1", "confidence", F.lit(0.3).alias("gate"))
    return review.seed_diff(gated, kept.unionByName(seed.where("seed_index % 4 = 0").withColumn("seed_index", F.col("seed_index") + 1000)))


@register("seed_diff", WITH + f", {DIFF} SELECT * FROM df")
def seed_diff(spark, d):
    return _diff(spark, d)


@register("seed_quality", WITH + f", {DIFF} SELECT coalesce(stratum, 'ALL') AS grp, {', '.join(f"count(*) FILTER (WHERE change = '{c}') AS {c}" for c in review.CHANGES)} FROM df JOIN images USING (image_id) GROUP BY GROUPING SETS ((stratum), ())")
def seed_quality(spark, d):
    return review.seed_quality(_diff(spark, d).join(fx.images(spark, d).select("image_id", "stratum"), "image_id"), "stratum")


AGREE = PAIRS + """, c2 AS (SELECT image_id, g, list(w ORDER BY i / (s - i) DESC, w DESC) AS ws FROM cand WHERE image_id % 13 <> 0 GROUP BY image_id, g),
r1 AS (SELECT gt.image_id, gt.g, coalesce(c2.ws, []) AS ws, row_number() OVER (PARTITION BY gt.image_id ORDER BY gt.g) AS k FROM gt LEFT JOIN c2 USING (image_id, g)),
f2 AS (SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gs, CAST([] AS BIGINT[]) AS used FROM r1
  UNION ALL SELECT image_id, k, CASE WHEN pick IS NULL THEN gs ELSE list_append(gs, g) END, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END FROM (SELECT r.image_id, r.k, r.g, f.gs, f.used, list_filter(r.ws, lambda x: NOT list_contains(f.used, x))[1] AS pick FROM f2 f JOIN r1 r ON r.image_id = f.image_id AND r.k = f.k + 1)),
mt AS (SELECT p.image_id, p.g, p.w, coalesce(b.text <> a.token_text, true) AS td, CASE WHEN b.confidence IS NULL THEN 'PHI' ELSE 'KEEP' END <> a.label AS ld FROM (SELECT image_id, unnest(gs) AS g, unnest(used) AS w FROM (SELECT image_id, gs, used FROM f2 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY k DESC) = 1)) p JOIN gt a USING (image_id, g) JOIN pred b USING (image_id, w)),
m2 AS (SELECT image_id, count(*) AS m, count(*) FILTER (WHERE td) AS td, count(*) FILTER (WHERE ld) AS ld FROM mt GROUP BY image_id),
ag AS (SELECT a.image_id, a.image_id % 13 = 0 AS deferred, coalesce(m, 0) AS matched, coalesce(td, 0) AS text_disagree, coalesce(ld, 0) AS label_disagree, CASE WHEN a.image_id % 13 = 0 THEN 0 ELSE n1 - coalesce(m, 0) END AS r1_only, CASE WHEN a.image_id % 13 = 0 THEN 0 ELSE n2 - coalesce(m, 0) END AS r2_only
  FROM (SELECT image_id, count(*) AS n1 FROM gt GROUP BY 1) a JOIN (SELECT image_id, count(*) AS n2 FROM pred GROUP BY 1) b USING (image_id) LEFT JOIN m2 USING (image_id))"""


def _agreement(spark, d):
    first = fx.gt_tokens(spark, d).select("image_id", "g", F.col("token_text").alias("text"), "label", "x0", "y0", "x1", "y1")
    label = F.when(F.col("confidence").isNull(), "PHI").otherwise("KEEP")
    second = fx.predictions(spark, d).select("image_id", F.col("w").alias("g"), "text", label.alias("label"), "x0", "y0", "x1", "y1", F.when(F.col("image_id") % 13 == 0, "deferred").otherwise("accepted").alias("state"))
    return review.self_agreement(first, second)


@register("self_agreement", f"WITH RECURSIVE {AGREE} SELECT * FROM ag")
def self_agreement(spark, d):
    return _agreement(spark, d)


@register("self_agreement_totals", f"WITH RECURSIVE {AGREE} SELECT count(*) FILTER (WHERE NOT deferred) AS images, count(*) FILTER (WHERE deferred) AS deferred2, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('matched', 'text_disagree', 'label_disagree', 'r1_only', 'r2_only'))} FROM ag")
def self_agreement_totals(spark, d):
    return review.agreement_totals(_agreement(spark, d))


@register("middle_frame", "WITH s AS (SELECT l_orderkey AS series, count(*) AS n, any_value(l_orderkey % 11) AS wanted FROM lineitem GROUP BY 1), k AS (SELECT series, n, CASE WHEN wanted < n THEN wanted ELSE n // 2 END AS chosen, wanted >= n AS fallback FROM s), o AS (SELECT l_orderkey AS series, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_linenumber END NULLS LAST, l_partkey, l_suppkey) - 1 AS idx FROM lineitem) SELECT series, chosen, fallback, l_partkey AS instance FROM k JOIN o USING (series) WHERE idx = chosen")
def middle_frame(spark, d):
    line = fx.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("series"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_linenumber")).alias("number"), F.col("l_partkey").alias("instance"), F.col("l_suppkey").alias("tie"), (F.col("l_orderkey") % 11).alias("wanted"))
    return manifests.middle_frames(line)