"""Queries of matching, scoring and roll-ups over the derived relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmark.operators import matching, overlaps, rollup, scoring
from glyphmark.plans import fixtures as fx
from glyphmark.plans.registry import register

PAIRS = fx.SQL + """,
cand AS (SELECT * FROM (SELECT a.image_id, a.g, b.w, a.token_text, a.label, b.text, b.confidence, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1,
  greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s
  FROM gt a JOIN pred b ON a.image_id = b.image_id) WHERE CASE WHEN s - i <= 0 THEN 0 ELSE i / (s - i) END >= 0.5)"""
MATCHES = PAIRS + """,
ranked AS (SELECT *, i / (s - i) AS iou, row_number() OVER (PARTITION BY image_id ORDER BY -(i / (s - i)), ax0, ay0, ax1, ay1, token_text, label, g, bx0, by0, bx1, by1, text, confidence IS NULL, coalesce(confidence, 0), w) AS k FROM cand),
fold AS (SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gs, CAST([] AS BIGINT[]) AS ws FROM ranked
  UNION ALL SELECT r.image_id, r.k, CASE WHEN list_contains(f.gs, r.g) OR list_contains(f.ws, r.w) THEN f.gs ELSE list_append(f.gs, r.g) END, CASE WHEN list_contains(f.gs, r.g) OR list_contains(f.ws, r.w) THEN f.ws ELSE list_append(f.ws, r.w) END
  FROM fold f JOIN ranked r ON r.image_id = f.image_id AND r.k = f.k + 1),
matches AS (SELECT p.image_id, p.g, p.w, r.iou, r.text, r.confidence AS word_confidence FROM (SELECT image_id, unnest(gs) AS g, unnest(ws) AS w FROM (SELECT image_id, gs, ws FROM fold QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY k DESC) = 1)) p JOIN ranked r USING (image_id, g, w))"""
TOKENS = MATCHES + """,
allowlist AS (SELECT DISTINCT token_text FROM gt WHERE label = 'KEEP' AND part % 19 <> 0),
tok AS (SELECT gt.*, m.w IS NOT NULL AS found, coalesce(m.text = gt.token_text, false) AS exact, m.text, m.word_confidence, gt.token_text IN (SELECT token_text FROM allowlist) AS allow_listed FROM gt LEFT JOIN matches m USING (image_id, g))"""
SCORES = TOKENS + """,
per AS (SELECT image_id, count(*) AS gt_total, count(*) FILTER (WHERE found) AS found_count, count(*) FILTER (WHERE NOT found) AS omission_count, count(*) FILTER (WHERE label = 'KEEP') AS keep_total,
  count(*) FILTER (WHERE label = 'KEEP' AND exact) AS keep_exact_match_count, count(*) FILTER (WHERE label = 'KEEP' AND NOT (exact AND allow_listed)) AS false_redaction_count,
  sum(length(token_text)) FILTER (WHERE label = 'KEEP') AS keep_chars_total, sum(length(token_text)) FILTER (WHERE label = 'KEEP' AND NOT (exact AND allow_listed)) AS keep_chars_censored FROM tok GROUP BY image_id),
wc AS (SELECT image_id, count(*) AS n FROM pred GROUP BY image_id),
texts AS (SELECT image_id, string_agg(token_text, ' ' ORDER BY x0, y0, x1, y1, token_text, label, g) AS ref, string_agg(text, ' ' ORDER BY x0, y0, x1, y1, token_text, label, g) AS hyp FROM tok WHERE found GROUP BY image_id),
coded AS (SELECT *, string_split(ref, ' ') AS r, string_split(hyp, ' ') AS h, list_distinct(string_split(ref || ' ' || hyp, ' ')) AS v FROM texts),
edits AS (SELECT image_id, levenshtein(ref, hyp) / length(ref) AS cer, levenshtein(array_to_string(list_transform(r, lambda x: chr(CAST(33 + list_position(v, x) AS INTEGER))), ''), array_to_string(list_transform(h, lambda x: chr(CAST(33 + list_position(v, x) AS INTEGER))), '')) / len(r) AS wer FROM coded),
sc AS (SELECT images.*, cer, wer, coalesce(gt_total, 0) AS gt_total, coalesce(found_count, 0) AS found_count, coalesce(omission_count, 0) AS omission_count, coalesce(keep_total, 0) AS keep_total, coalesce(keep_exact_match_count, 0) AS keep_exact_match_count,
  coalesce(false_redaction_count, 0) AS false_redaction_count, coalesce(keep_chars_total, 0) AS keep_chars_total, coalesce(keep_chars_censored, 0) AS keep_chars_censored, coalesce(n, 0) - coalesce(found_count, 0) AS added_count, gt_total IS NULL AS negative_control
  FROM images LEFT JOIN per USING (image_id) LEFT JOIN wc USING (image_id) LEFT JOIN edits USING (image_id)),
scores AS (SELECT *, CASE WHEN negative_control THEN added_count ELSE 0 END AS floor_count, keep_total > 0 AND keep_exact_match_count = keep_total AS keep_exact_match_all FROM sc)"""
P95 = "(CASE WHEN len(e) = 1 THEN e[1] WHEN len(e) > 1 THEN (e[j] * (100 - (95 * (len(e) + 1) - 100 * j)) + e[j + 1] * (95 * (len(e) + 1) - 100 * j)) / 100 END)"


def allowlist(gt: DataFrame) -> DataFrame:
    return gt.where("label = 'KEEP' AND part % 19 <> 0").select("token_text").distinct()


def tokens(spark: SparkSession, d: str) -> DataFrame:
    gt = fx.gt_tokens(spark, d)
    return scoring.matched_tokens(gt, fx.predictions(spark, d), allowlist(gt))


def scores(spark: SparkSession, d: str) -> DataFrame:
    crowd = overlaps.crowded_by(fx.board_sizes(spark, d))
    gt = fx.gt_tokens(spark, d)
    few = gt if crowd is None else gt.join(crowd, "image_id", "left_anti")
    counts = scoring.board_counts(fx.boards(spark, d, crowd), scoring.unlisted(few, allowlist(gt)))
    if crowd is not None:
        many, words = (rows.join(crowd, "image_id", "left_semi") for rows in (gt, fx.predictions(spark, d)))
        counts = counts.unionByName(scoring.image_counts(scoring.matched_tokens(many, words, allowlist(gt)), words))
    return scoring.scored(fx.images(spark, d, extra=True), counts)


def latencies(spark: SparkSession, d: str) -> DataFrame:
    return fx.images(spark, d, extra=True).select("image_id", "stratum", "elapsed", "verifier_elapsed")


@register("iou_candidates", f"WITH {PAIRS} SELECT image_id, g, w, i / (s - i) AS iou FROM cand")
def iou_candidates(spark, d):
    return matching.candidates(fx.gt_tokens(spark, d), fx.predictions(spark, d)).select("image_id", "g", "w", "iou")


@register("greedy_match", f"WITH RECURSIVE {MATCHES} SELECT image_id, g, w, iou FROM matches")
def greedy_match(spark, d):
    return matching.match(fx.gt_tokens(spark, d), fx.predictions(spark, d))


@register("omissions", f"WITH RECURSIVE {MATCHES} SELECT image_id, g, token_text, label FROM gt ANTI JOIN matches USING (image_id, g)")
def omissions(spark, d):
    gt = fx.gt_tokens(spark, d)
    return matching.omissions(gt, matching.match(gt, fx.predictions(spark, d))).select("image_id", "g", "token_text", "label")


@register("hallucinations", f"WITH RECURSIVE {MATCHES} SELECT image_id, w, text, confidence FROM pred ANTI JOIN matches USING (image_id, w)")
def hallucinations(spark, d):
    pred = fx.predictions(spark, d)
    return matching.hallucinations(pred, matching.match(fx.gt_tokens(spark, d), pred)).select("image_id", "w", "text", "confidence")


@register("boxfree_match", f"WITH {fx.SQL}, blobs AS (SELECT image_id, string_agg(text, ' ' ORDER BY text, coalesce(confidence, 0), w) AS blob FROM pred GROUP BY image_id) SELECT image_id, g, coalesce(contains(blob, token_text), false) AS found, blob FROM gt LEFT JOIN blobs USING (image_id)")
def boxfree_match(spark, d):
    pred = fx.predictions(spark, d)
    return matching.boxfree(fx.gt_tokens(spark, d), pred).join(matching.blobs(pred), "image_id", "left")


COUNTS = ("gt_total", "found_count", "omission_count", "keep_total", "keep_exact_match_count", "false_redaction_count", "added_count", "floor_count")


@register("score_images", f"WITH RECURSIVE {SCORES} SELECT image_id, stratum, modality, vendor, frame_idx, negative_control, keep_exact_match_all, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in COUNTS)} FROM scores")
def score_images(spark, d):
    return scores(spark, d).select("image_id", "stratum", "modality", "vendor", "frame_idx", "negative_control", "keep_exact_match_all", *COUNTS)


@register("keep_exact", f"WITH RECURSIVE {TOKENS} SELECT image_id, count(*) AS keep_total, count(*) FILTER (WHERE exact) AS keep_exact FROM tok WHERE label = 'KEEP' GROUP BY image_id")
def keep_exact(spark, d):
    return tokens(spark, d).where("label = 'KEEP'").groupBy("image_id").agg(F.count("*").alias("keep_total"), F.count_if("exact").alias("keep_exact"))


@register("false_redaction", f"WITH RECURSIVE {TOKENS} SELECT image_id, g, token_text FROM tok WHERE label = 'KEEP' AND NOT (exact AND allow_listed)")
def false_redaction(spark, d):
    return tokens(spark, d).where("label = 'KEEP' AND NOT (exact AND allow_listed)").select("image_id", "g", "token_text")


@register("char_censor", f"WITH RECURSIVE {SCORES} SELECT image_id, CAST(keep_chars_total AS BIGINT) AS keep_chars_total, CAST(keep_chars_censored AS BIGINT) AS keep_chars_censored FROM scores")
def char_censor(spark, d):
    return scores(spark, d).select("image_id", "keep_chars_total", "keep_chars_censored")


@register("allowlist_gate", f"WITH RECURSIVE {TOKENS} SELECT allow_listed, exact, count(*) AS n FROM tok WHERE label = 'KEEP' GROUP BY 1, 2")
def allowlist_gate(spark, d):
    return tokens(spark, d).where("label = 'KEEP'").groupBy("allow_listed", "exact").agg(F.count("*").alias("n"))


@register("negative_control", f"WITH RECURSIVE {SCORES} SELECT coalesce(stratum, 'ALL') AS grp, count(*) AS n_blank, CAST(sum(floor_count) AS BIGINT) AS floor_count, count(*) FILTER (WHERE floor_count > 0) AS n_with_added FROM scores WHERE negative_control GROUP BY GROUPING SETS ((stratum), ())")
def negative_control(spark, d):
    blank = scores(spark, d).where("negative_control")
    return rollup.grouped(blank, "stratum", F.count("*").alias("n_blank"), rollup.total("floor_count").alias("floor_count"), F.count_if(F.col("floor_count") > 0).alias("n_with_added"))


SUMS = ("keep_total", "false_redaction_count", "keep_exact_match_count", "found_count", "omission_count", "gt_total", "added_count")


@register("aggregate_run", f"""WITH RECURSIVE {SCORES}, a AS (SELECT coalesce(stratum, 'ALL') AS grp, count(*) AS n_images, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in SUMS)}, count(*) FILTER (WHERE negative_control) AS n_blank, CAST(sum(floor_count) AS BIGINT) AS floor_count,
  round(avg(elapsed), 6) AS latency_mean, median(elapsed) AS latency_median, list(elapsed ORDER BY elapsed) AS e, count(*) FILTER (WHERE keep_exact_match_all) AS images_all_exact, sum(cost) AS cost_sum, sum(cost) / count(*) AS cost_mean, avg(cer) AS cer_mean, avg(wer) AS wer_mean, count(cer) AS n_cer_images, CAST(sum(keep_chars_total) AS BIGINT) AS keep_chars_total, CAST(sum(keep_chars_censored) AS BIGINT) AS keep_chars_censored FROM scores GROUP BY GROUPING SETS ((stratum), ())),
 b AS (SELECT *, greatest(1, least(95 * (len(e) + 1) // 100, len(e) - 1)) AS j FROM a)
 SELECT * EXCLUDE (e, j), false_redaction_count / nullif(keep_total, 0) AS false_redaction_rate, keep_exact_match_count / nullif(keep_total, 0) AS keep_exact_rate, floor_count / nullif(n_blank, 0) AS floor_per_image, keep_chars_censored / nullif(keep_chars_total, 0) AS char_censor_rate, {P95} AS latency_p95 FROM b""")
def aggregate_run(spark, d):
    return rollup.run_summary(scores(spark, d), latencies(spark, d))


@register("latency_stats", f"""WITH {fx.SQL}, a AS (SELECT stratum, count(*) AS n, round(avg(verifier_elapsed), 6) AS verifier_mean, count(verifier_elapsed) AS n_verified, median(verifier_elapsed) AS verifier_median, list(elapsed ORDER BY elapsed) AS e FROM images GROUP BY stratum),
 b AS (SELECT *, greatest(1, least(95 * (len(e) + 1) // 100, len(e) - 1)) AS j FROM a) SELECT stratum, n, verifier_mean, n_verified, verifier_median, {P95} AS latency_p95 FROM b""")
def latency_stats(spark, d):
    rows = latencies(spark, d)
    out = rows.groupBy("stratum").agg(F.count("*").alias("n"), F.round(F.avg("verifier_elapsed"), 6).alias("verifier_mean"), F.count("verifier_elapsed").alias("n_verified"))
    for value, pick, name in (("verifier_elapsed", "median", "verifier_median"), ("elapsed", "p95", "latency_p95")):
        q = rollup.quantiles(rows, "stratum", value).where("NOT __total").select("__key", F.col(pick).alias(name))
        out = out.join(q, F.col("stratum").eqNullSafe(F.col("__key")), "left").drop("__key")
    return out


DETECT = SCORES + ", det AS (SELECT *, image_id % 10 = 1 AS box_free, CASE WHEN image_id % 7 <> 0 OR stratum = 'BUILDING' THEN CAST(0.5 AS DOUBLE) END AS iou_thr FROM scores), dv AS (SELECT coalesce(stratum, 'ALL') AS grp, count(*) FILTER (WHERE NOT box_free AND iou_thr IS NOT NULL AND NOT negative_control) AS n_text, count(*) FILTER (WHERE NOT box_free AND iou_thr IS NOT NULL AND negative_control) AS n_blank, count(*) FILTER (WHERE box_free) AS n_box_free, count(*) FILTER (WHERE NOT box_free AND iou_thr IS NULL) AS n_no_matcher, CAST(sum(found_count) FILTER (WHERE NOT box_free AND iou_thr IS NOT NULL AND NOT negative_control) AS BIGINT) AS found, CAST(sum(gt_total) FILTER (WHERE NOT box_free AND iou_thr IS NOT NULL AND NOT negative_control) AS BIGINT) AS tokens, CAST(sum(added_count) FILTER (WHERE NOT box_free AND iou_thr IS NOT NULL AND NOT negative_control) AS BIGINT) AS added, CAST(sum(floor_count) FILTER (WHERE NOT box_free AND iou_thr IS NOT NULL AND negative_control) AS BIGINT) AS floor, CASE WHEN count(DISTINCT coalesce(iou_thr, -1)) = 1 THEN max(iou_thr) END AS common_iou_thr FROM det GROUP BY GROUPING SETS ((stratum), ()))"


def _detectable(spark, d):
    return scores(spark, d).withColumns({"box_free": F.col("image_id") % 10 == 1, "iou_thr": F.when((F.col("image_id") % 7 != 0) | (F.col("stratum") == "BUILDING"), F.lit(0.5))})


@register("detection_view", f"WITH RECURSIVE {DETECT} SELECT *, found / tokens AS recall, found / (found + added) AS precision, floor / n_blank AS floor_per_image FROM dv")
def detection_view(spark, d):
    return rollup.detection_view(_detectable(spark, d)).drop("recall_na", "precision_na")


#: A group of every kind of zero: its rows by the remainder of the order's key.
NA = """nr AS (SELECT 'g' || k AS grp, k IN (1, 5) AND j OR k = 3 AND half AS box_free, CASE WHEN NOT (k = 2 OR k = 3 AND NOT half OR k = 8 AND half) THEN 0.5 END AS iou_thr, k IN (4, 5) AS negative_control, CASE WHEN k IN (6, 7) THEN 0 ELSE 5 END AS gt_total, CASE WHEN k IN (0, 9) THEN 2 ELSE 0 END AS found_count, CASE WHEN k IN (0, 7) THEN 1 ELSE 0 END AS added_count
 FROM (SELECT o_orderkey % 10 AS k, o_orderkey % 10 = 1 OR o_orderkey // 10 % 3 = 0 AS j, o_orderkey // 10 % 2 = 0 AS half FROM orders))"""


@register("detection_na_reason", f"""WITH {NA}, c AS (SELECT grp, count(*) FILTER (WHERE box_free) AS bf, count(*) FILTER (WHERE NOT box_free AND iou_thr IS NULL) AS nm, count(*) FILTER (WHERE NOT box_free AND iou_thr IS NOT NULL AND NOT negative_control) AS tx, count(*) FILTER (WHERE NOT box_free AND iou_thr IS NOT NULL AND negative_control) AS bl,
 coalesce(sum(gt_total) FILTER (WHERE NOT box_free AND iou_thr IS NOT NULL AND NOT negative_control), 0) AS t, coalesce(sum(found_count + added_count) FILTER (WHERE NOT box_free AND iou_thr IS NOT NULL AND NOT negative_control), 0) AS p FROM (SELECT * FROM nr UNION ALL SELECT * REPLACE ('ALL' AS grp) FROM nr) GROUP BY grp),
 w AS (SELECT *, CASE WHEN bf + nm > 0 THEN '; ' || (bf + nm) || ' left out' ELSE '' END AS x, CASE WHEN nm = 0 THEN 'box-free output' WHEN bf = 0 THEN 'no matcher ran' ELSE bf || ' box-free, ' || nm || ' without a matcher' END AS why FROM c)
 SELECT grp, CASE WHEN t > 0 THEN NULL WHEN tx + bl = 0 THEN why WHEN tx > 0 THEN 'no ground-truth tokens' || x ELSE 'all ' || bl || ' boxed images are blank' || x END AS recall_na, CASE WHEN p > 0 THEN NULL WHEN tx + bl = 0 THEN why WHEN tx > 0 THEN 'nothing predicted' || x ELSE 'all ' || bl || ' boxed images are blank' || x END AS precision_na FROM w""")
def detection_na_reason(spark, d):
    o = fx.read(spark, d, "orders").select((F.col("o_orderkey") % 10).alias("k"), F.expr("o_orderkey div 10").alias("q"))
    k, half = F.col("k"), F.col("q") % 2 == 0
    count = lambda when, n: F.when(when, n).otherwise(0)
    rows = o.select(
        F.concat(F.lit("g"), k.cast("string")).alias("stratum"), (k.isin(1, 5) & ((k == 1) | (F.col("q") % 3 == 0)) | (k == 3) & half).alias("box_free"), F.when(~((k == 2) | (k == 3) & ~half | (k == 8) & half), F.lit(0.5)).alias("iou_thr"), k.isin(4, 5).alias("negative_control"),
        count(~k.isin(6, 7), 5).alias("gt_total"), count(k.isin(0, 9), 2).alias("found_count"), count(k.isin(0, 7), 1).alias("added_count"), F.lit(0).alias("floor_count"),
    )
    return rollup.detection_view(rows).select("grp", "recall_na", "precision_na")


@register("report_table_a", f"WITH RECURSIVE {SCORES} SELECT coalesce(stratum, 'ALL') AS grp, format('{{:.2f}}%', 100 * sum(false_redaction_count) / sum(keep_total)) AS false_redaction, format('{{:.2f}}%', 100 * sum(keep_exact_match_count) / sum(keep_total)) AS keep_exact, CAST(sum(found_count) AS BIGINT) AS found, CAST(sum(omission_count) AS BIGINT) AS omitted, CAST(sum(added_count) AS BIGINT) AS added FROM scores GROUP BY GROUPING SETS ((stratum), ())")
def report_table_a(spark, d):
    from glyphmark.functions.text import percent

    a = rollup.run_summary(scores(spark, d), latencies(spark, d))
    return a.select("grp", percent(F.col("false_redaction_rate")).alias("false_redaction"), percent(F.col("keep_exact_rate")).alias("keep_exact"), F.col("found_count").alias("found"), F.col("omission_count").alias("omitted"), F.col("added_count").alias("added"))


@register("report_table_b", f"WITH RECURSIVE {DETECT} SELECT grp, format('{{:.2f}}%', 100 * found / tokens) AS recall, format('{{:.2f}}%', 100 * found / (found + added)) AS precision, n_text, n_blank FROM dv")
def report_table_b(spark, d):
    from glyphmark.functions.text import percent

    v = rollup.detection_view(_detectable(spark, d))
    return v.select("grp", percent(F.col("recall"), "n/a").alias("recall"), percent(F.col("precision"), "n/a").alias("precision"), "n_text", "n_blank")
