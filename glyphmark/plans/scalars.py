"""Queries of scalar functions, reading arm, manifests and seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmark.functions import cost, geometry, ids, text
from glyphmark.operators import heights, manifests, ocrseeds, reading, reconcile, review, rollup, sets
from glyphmark.plans import fixtures as fx
from glyphmark.plans.registry import register

WITH = "WITH " + fx.SQL


@register("normalize_text", r"SELECT doc_id, regexp_replace(nfc_normalize(text), '^[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g') AS norm FROM documents")
def normalize_text(spark, d):
    return fx.read(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("norm"))


@register("iou_scalar", WITH + ", p AS (SELECT a.image_id, a.g AS g1, b.g AS g2, greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s FROM gt a JOIN gt b ON a.image_id = b.image_id AND a.g < b.g) SELECT image_id, g1, g2, CASE WHEN s - i <= 0 THEN 0 ELSE i / (s - i) END AS iou FROM p")
def iou_scalar(spark, d):
    gt = fx.gt_tokens(spark, d)
    return gt.alias("a").join(gt.alias("b"), F.expr("a.image_id = b.image_id AND a.g < b.g")).select("a.image_id", F.col("a.g").alias("g1"), F.col("b.g").alias("g2"), geometry.iou("a", "b").alias("iou"))


def _reads(spark, d):
    """Whole benchmark texts with their characters as they are: faults fall on the first, the last quarter, all or every e."""
    t, k = F.col("text"), F.col("item_id") % 5
    hyp = F.when(t.isNull(), None).when(k == 0, t).when(k == 1, F.expr("concat('x', substring(text, 2))")).when(k == 2, F.expr("substring(text, 1, length(text) * 3 div 4)")).when(k == 3, "").otherwise(F.replace(t, F.lit("e"), F.lit("o")))
    return fx.read(spark, d, "benchmark").select("item_id", text.strip(t).alias("expected"), text.strip(hyp).alias("hyp"))


#: SQL's levenshtein counts bytes, so each different character or word of a pair is written as one of 93 ASCII characters; tests/test_engine.py holds longer texts against brute force.
EDITS_SQL = r"""reads AS (SELECT item_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS e, regexp_replace(CASE item_id % 5 WHEN 0 THEN text WHEN 1 THEN 'x' || substr(text, 2) WHEN 2 THEN substr(text, 1, length(text) * 3 // 4) WHEN 3 THEN '' ELSE replace(text, 'e', 'o') END, '^\s+|\s+$', '', 'g') AS h FROM benchmark),
split AS (SELECT item_id, e, h, list_filter(string_split(e, ''), lambda x: x <> '') AS ec, list_filter(string_split(h, ''), lambda x: x <> '') AS hc, list_filter(regexp_split_to_array(e, '\s+'), lambda x: x <> '') AS ew, list_filter(regexp_split_to_array(h, '\s+'), lambda x: x <> '') AS hw FROM reads),
known AS (SELECT *, list_distinct(list_concat(ec, hc)) AS c, list_distinct(list_concat(ew, hw)) AS w FROM split),
coded AS (SELECT item_id, h, len(ec) AS nc, len(ew) AS nw, """ + ", ".join(f"array_to_string(list_transform({side}{kind}, lambda x: chr(CAST(32 + list_position({kind}, x) AS INTEGER))), '') AS {side}{kind}" for side in "eh" for kind in "cw") + """ FROM known),
edits AS (SELECT item_id, h, CASE WHEN nc > 0 THEN levenshtein(ec, hc) / nc END AS cer, CASE WHEN nw > 0 THEN levenshtein(ew, hw) / nw END AS wer FROM coded)"""


@register("cer", f"WITH {EDITS_SQL} SELECT item_id, cer FROM edits")
def cer(spark, d):
    return _reads(spark, d).select("item_id", text.cer(F.col("expected"), F.col("hyp")).alias("cer"))


@register("wer", f"WITH {EDITS_SQL} SELECT item_id, wer FROM edits")
def wer(spark, d):
    return _reads(spark, d).select("item_id", text.wer(F.col("expected"), F.col("hyp")).alias("wer"))


@register("diagnostic_rollup", f"WITH {EDITS_SQL}, r AS (SELECT item_id, CASE WHEN h <> '' THEN cer END AS c FROM edits) SELECT item_id % 2 AS half, count(*) AS n, count(c) AS n_read, round(avg(c), 9) AS cer_macro FROM r GROUP BY 1")
def diagnostic_rollup(spark, d):
    c = F.when(F.col("hyp") != "", text.cer(F.col("expected"), F.col("hyp")))
    return _reads(spark, d).groupBy((F.col("item_id") % 2).alias("half")).agg(F.count("*").alias("n"), F.count(c).alias("n_read"), F.round(F.avg(c), 9).alias("cer_macro"))


@register("bench_reader", "WITH b AS (SELECT item_id, substr(text, 1, 8) AS e, CASE item_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'x' || substr(text, 2, 7) ELSE substr(text, 1, 8) END AS r FROM benchmark) SELECT count(*) AS n, count(*) FILTER (WHERE trim(e) = trim(r)) AS exact, count(*) FILTER (WHERE trim(r) = '') AS empty, count(*) FILTER (WHERE trim(r) <> '' AND trim(e) <> trim(r)) AS misread, count(*) FILTER (WHERE length(e) = 8) AS n8 FROM b")
def bench_reader(spark, d):
    e, k = F.substring("text", 1, 8), F.col("item_id") % 5
    return reading.bench(fx.read(spark, d, "benchmark").select(e.alias("expected"), F.when(k == 0, "").when(k == 1, F.concat(F.lit("x"), F.substring("text", 2, 7))).otherwise(e).alias("read")))


@register("image_id_hash", "SELECT o_orderkey, substr(sha256('s' || o_orderkey || '|' || o_orderkey % 60), 1, 8) AS hashed FROM orders")
def image_id_hash(spark, d):
    k = F.col("o_orderkey")
    return fx.read(spark, d, "orders").select("o_orderkey", ids.image_id(F.concat(F.lit("s"), k.cast("string")), k % 60).alias("hashed"))


SIZES = "z AS (SELECT p_partkey, 100 + p_partkey % 1500 AS w, 100 + p_partkey * 7 % 1100 AS h FROM part)"


@register("cost_estimate", f"WITH {SIZES}, x AS (SELECT *, unnest(['claude', 'gpt4o', 'gemini', 'cloud', 'self_hosted']) AS rule FROM z) SELECT p_partkey, rule, CAST(CASE rule WHEN 'claude' THEN ceil(w * h / 750.0) WHEN 'gpt4o' THEN 85 + 170 * ceil(w / 512.0) * ceil(h / 512.0) WHEN 'gemini' THEN 45 + 258 * CASE WHEN w <= 384 AND h <= 384 THEN 1 ELSE ceil(w / 768.0) * ceil(h / 768.0) END WHEN 'cloud' THEN 1 ELSE 0 END AS BIGINT) AS units FROM x")
def cost_estimate(spark, d):
    z = fx.read(spark, d, "part").select("p_partkey", (100 + F.col("p_partkey") % 1500).alias("w"), (100 + F.col("p_partkey") * 7 % 1100).alias("h"), F.explode(F.array(*[F.lit(r) for r in cost.PRICES])).alias("rule"))
    return z.select("p_partkey", "rule", cost.units(F.col("rule"), F.col("w"), F.col("h")).alias("units"))


@register("cost_rollup", WITH + " SELECT stratum, count(*) AS n, CAST(round(sum(ceil(w * h / 750.0) * (5.0 / 1000000)), 6) AS DOUBLE) AS cost_total FROM images GROUP BY stratum")
def cost_rollup(spark, d):
    return fx.images(spark, d).groupBy("stratum").agg(F.count("*").alias("n"), F.round(F.sum(cost.dollars(F.lit("claude"), F.col("w"), F.col("h"))), 6).alias("cost_total"))


@register("usage_cost", "SELECT c_mktsegment AS grp, CAST(sum(c_custkey) AS BIGINT) AS input_tokens, CAST(sum(c_nationkey) AS BIGINT) AS output_tokens, round(sum(c_custkey) * 1.25 / 1000000 + sum(c_nationkey) * 10.0 / 1000000, 9) AS usd FROM customer GROUP BY 1")
def usage_cost(spark, d):
    calls = fx.read(spark, d, "customer").select(F.col("c_mktsegment").alias("grp"), F.col("c_custkey").alias("input_tokens"), F.col("c_nationkey").alias("output_tokens"))
    return reading.usage(calls, "grp", 1.25, 10.0)


CROP = "cp AS (SELECT *, CAST(greatest(floor(x0 - (y1 - y0) * 0.1), 0) AS BIGINT) AS cx0, CAST(greatest(floor(y0 - (y1 - y0) * 0.1), 0) AS BIGINT) AS cy0 FROM gt), cr AS (SELECT *, greatest(CAST(least(ceil(x1 + (y1 - y0) * 0.1), 1024) AS BIGINT), cx0 + 1) AS cx1, greatest(CAST(least(ceil(y1 + (y1 - y0) * 0.1), 768) AS BIGINT), cy0 + 1) AS cy1 FROM cp), crop AS (SELECT *, greatest(1, CAST(round_even((cx1 - cx0) * 48.0 / (cy1 - cy0), 0) AS BIGINT)) AS cw FROM cr)"


def _crops(spark, d):
    gt = fx.gt_tokens(spark, d)
    return gt.withColumns(geometry.crop(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], F.lit(1024), F.lit(768)))


@register("crop_geometry", WITH + f", {CROP} SELECT image_id, g, cx0 AS crop_x0, cy0 AS crop_y0, cx1 AS crop_x1, cy1 AS crop_y1, cw AS crop_width FROM crop")
def crop_geometry(spark, d):
    return _crops(spark, d).select("image_id", "g", "crop_x0", "crop_y0", "crop_x1", "crop_y1", "crop_width")


@register("crop_cost", WITH + f", {CROP} SELECT image_id, CAST(sum(ceil(cw * 48 / 750.0)) AS BIGINT) AS tokens FROM crop GROUP BY image_id")
def crop_cost(spark, d):
    return _crops(spark, d).groupBy("image_id").agg(F.sum(cost.units(F.lit("claude"), F.col("crop_width"), F.lit(48))).alias("tokens"))


@register("quad_to_bbox", WITH + " SELECT image_id, g, greatest(0, least(x0 - 30, 1024)) AS x0, greatest(0, least(y0, 768)) AS y0, greatest(0, least(x1 + 5, 1024)) AS x1, greatest(0, least(y1 + 3, 768)) AS y1 FROM gt")
def quad_to_bbox(spark, d):
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    quad = F.array(corner(x0 - 30, y0 + 2), corner(x1, y0), corner(x1 + 5, y1), corner(x0, y1 + 3))
    return fx.gt_tokens(spark, d).select("image_id", "g", geometry.quad_box(quad, F.lit(1024), F.lit(768)).alias("b")).select("image_id", "g", "b.*")


@register("abstention_flag", "SELECT item_id, item_id % 5 IN (0, 1, 2) AS abstains FROM benchmark")
def abstention_flag(spark, d):
    k = F.col("item_id") % 5
    said = F.when(k == 0, "<<NOTEXT>>").when(k == 1, " << notext >>. ").when(k == 2, "`<<NoText>>`").when(k == 3, F.concat(F.lit("<<NOTEXT>> "), F.col("text"))).otherwise(F.col("text"))
    return fx.read(spark, d, "benchmark").select("item_id", text.abstains(said).alias("abstains"))


@register("fmt_rate", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '—' ELSE format('{:.2f}%', 100 * ((p_partkey % 64) / 64.0)) END AS rate FROM part")
def fmt_rate(spark, d):
    k = F.col("p_partkey")
    return fx.read(spark, d, "part").select("p_partkey", text.percent(F.when(k % 10 != 0, k % 64 / 64.0)).alias("rate"))


@register("config_label", "SELECT p_partkey, split_part(a, ':', 1) AS engine, split_part(a, ':', 2) AS variant, CASE WHEN p_partkey % 3 = 0 THEN 'stock' WHEN p_partkey % 3 = 1 THEN 'thr0.2' ELSE 'tuned' END AS config_id FROM (SELECT p_partkey, 'e' || p_partkey % 4 || ':' || CASE WHEN p_partkey % 2 = 0 THEN 'stock' ELSE 'tuned' END AS a FROM part)")
def config_label(spark, d):
    k = F.col("p_partkey")
    arm = F.concat(F.lit("e"), (k % 4).cast("string"), F.when(k % 2 == 0, ":stock").otherwise(":tuned"))
    knob = lambda stock: F.when(k % 3 == 0, stock).when(k % 3 == 1, ids.SHIPPED).otherwise(0.5)
    engine, variant = ids.arm_parts(arm)
    label = ids.config_label(knob(ids.LIBRARY_TEXT), knob(ids.LIBRARY_LOW), F.lit(ids.LINK))
    return fx.read(spark, d, "part").select("p_partkey", engine.alias("engine"), variant.alias("variant"), label.alias("config_id"))


@register("manifest_project", "SELECT sha256('s' || o_orderkey) AS series_uid, o_orderpriority AS modality, c_mktsegment AS stratum, n_name AS vendor, CAST(o_orderkey % 60 AS INTEGER) AS frame_idx FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def manifest_project(spark, d):
    raw = fx.images(spark, d).select(F.sha2(F.concat(F.lit("s"), F.col("image_id").cast("string")), 256).alias("series_uid"), "modality", F.col("stratum").alias("strata"), F.col("vendor").alias("manufacturer"), F.col("frame_idx").alias("middle_frame_index"), F.lit("private").alias("institution_name"))
    return manifests.project(raw, {"series_uid": "series_uid", "modality": "modality", "strata": "stratum", "manufacturer": "vendor", "middle_frame_index": "frame_idx"})


@register("manifest_counts", WITH + " SELECT 'modality' AS field, modality AS value, count(*) AS n FROM images GROUP BY 2 UNION ALL SELECT 'stratum', stratum, count(*) FROM images GROUP BY 2 UNION ALL SELECT 'vendor', vendor, count(*) FROM images GROUP BY 2 UNION ALL SELECT 'blank', 'candidate', count(*) FROM images WHERE image_id % 5 = 0")
def manifest_counts(spark, d):
    return manifests.counts(fx.images(spark, d), blank=F.col("image_id") % 5 == 0)


@register("frame_idx_summary", WITH + " SELECT coalesce(min(frame_idx), 0) AS lo, coalesce(max(frame_idx), 0) AS hi, coalesce(median(frame_idx), 0) AS mid, round(coalesce(avg(frame_idx), 0), 9) AS mean FROM images")
def frame_idx_summary(spark, d):
    return manifests.frame_summary(fx.images(spark, d))


@register("blank_ids", WITH + " SELECT image_id FROM images WHERE image_id % 5 = 0")
def blank_ids(spark, d):
    presence = fx.images(spark, d).select("image_id", F.when(F.col("image_id") % 5 == 0, " 0 ").when(F.col("image_id") % 7 == 0, "00").when(F.col("image_id") % 11 != 0, "1").alias("has_text"))
    return reconcile.blank_images(presence)


@register("gt_geometry", WITH + " SELECT coalesce(stratum, 'ALL') AS grp, median(q + 4) AS median_height, count(*) AS n FROM (SELECT stratum, gt.part % 20 AS q FROM gt JOIN images USING (image_id)) GROUP BY GROUPING SETS ((stratum), ())")
def gt_geometry(spark, d):
    rows = fx.gt_tokens(spark, d).select("image_id", (F.col("part") % 20 + 4).alias("height")).join(fx.images(spark, d).select("image_id", "stratum"), "image_id")
    return rollup.grouped(rows, "stratum", F.median("height").alias("median_height"), F.count("*").alias("n"))


@register("control_heights", WITH + ", m AS (SELECT stratum, median(y1 - y0 + part % 7) AS own FROM gt JOIN images USING (image_id) WHERE stratum <> 'MACHINERY' GROUP BY stratum) SELECT image_id, coalesce(own, (SELECT median(y1 - y0 + part % 7) FROM gt JOIN images USING (image_id) WHERE stratum <> 'MACHINERY')) AS box_height FROM images LEFT JOIN m USING (stratum) WHERE image_id % 5 = 0")
def control_heights(spark, d):
    """Blank images with the height of their control boxes; a stratum without tokens takes the height of all."""
    images = fx.images(spark, d).select("image_id", "stratum")
    tokens = fx.gt_tokens(spark, d).join(images.where("stratum <> 'MACHINERY'"), "image_id").select("stratum", "y0", (F.col("y1") + F.col("part") % 7).alias("y1"))
    return heights.control_heights(images.where("image_id % 5 = 0"), tokens).select("image_id", "box_height")


@register("rounded_geometry", WITH + ", h AS (SELECT stratum, x1 - x0 + part % 9 / 16.0 AS v FROM gt JOIN images USING (image_id)) SELECT stratum, CAST(round_even(CAST(quantile_disc(v, 0.5) AS DECIMAL(38, 18)), 1) AS DOUBLE) AS p50, CAST(round_even(CAST(quantile_disc(v, 0.9) AS DECIMAL(38, 18)), 1) AS DOUBLE) AS p90 FROM h GROUP BY stratum")
def rounded_geometry(spark, d):
    rows = fx.gt_tokens(spark, d).join(fx.images(spark, d).select("image_id", "stratum"), "image_id")
    return heights.nearest_rank(rows, "stratum", F.col("x1") - F.col("x0") + F.col("part") % 9 / 16.0, {"p50": 0.5, "p90": 0.9})


ANCHOR_SQL = "(VALUES " + ", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(geometry.ANCHORS[:4])) + ") AS a(box_no, fx, fy)"


@register("control_boxes", WITH + f", s AS (SELECT image_id, greatest(16.0, least(greatest(16.0, 768 * 0.035), 768.0)) AS bh FROM images WHERE image_id % 5 = 0) SELECT image_id, box_no, round(greatest(0.0, least(greatest(0.0, fx * 1024 - bh * 3), 1024 - bh * 6)), 6) AS x0, round(greatest(0.0, least(greatest(0.0, fy * 768 - bh / 2), 768 - bh)), 6) AS y0 FROM s, {ANCHOR_SQL}")
def control_boxes(spark, d):
    blank = fx.images(spark, d).where("image_id % 5 = 0")
    b = blank.select("image_id", F.explode(geometry.control_boxes(F.col("w"), F.col("h"), 4)).alias("b")).select("image_id", "b.*")
    return b.select("image_id", "box_no", F.round("x0", 6).alias("x0"), F.round("y0", 6).alias("y0"))


@register("read_axis_split", WITH + " SELECT image_id, count(*) FILTER (WHERE is_gt AND r <> '') AS found, count(*) FILTER (WHERE is_gt AND r = '') AS omitted, count(*) FILTER (WHERE NOT is_gt AND r <> '') AS invented FROM (SELECT image_id, true AS is_gt, CASE WHEN part % 9 = 0 THEN '' ELSE token_text END AS r FROM gt UNION ALL SELECT image_id, false, CASE WHEN part % 4 = 0 THEN 'z' ELSE '' END FROM boxed WHERE image_id % 5 = 0) GROUP BY image_id")
def read_axis_split(spark, d):
    gt = fx.gt_tokens(spark, d).select("image_id", F.lit(True).alias("is_gt"), F.when(F.col("part") % 9 == 0, " \t").otherwise(F.col("token_text")).alias("read"))
    control = fx.read(spark, d, "lineitem").where("l_orderkey % 5 = 0").select(F.col("l_orderkey").alias("image_id"), F.lit(False).alias("is_gt"), F.when(F.col("l_partkey") % 4 == 0, "z").otherwise("").alias("read"))
    return reading.axis_split(gt.unionByName(control))


@register("reader_floor", WITH + " SELECT count(*) AS crops, count(*) FILTER (WHERE part % 4 = 0) AS inventions, count(*) FILTER (WHERE part % 4 = 0) / count(*) AS per_crop, count(*) FILTER (WHERE part % 4 = 0) / count(DISTINCT image_id) AS per_image FROM boxed WHERE image_id % 5 = 0")
def reader_floor(spark, d):
    c = fx.read(spark, d, "lineitem").where("l_orderkey % 5 = 0")
    return reading.floor(c.select(F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") % 4 == 0).alias("invented")))


@register("verifier_reread", WITH + " SELECT image_id, w, CASE WHEN confidence IS NOT NULL AND confidence < 0.3 THEN upper(text) || '!' ELSE text END AS text, confidence FROM pred")
def verifier_reread(spark, d):
    from glyphmark.operators.adapters import reread

    return reread(fx.predictions(spark, d), 0.3, lambda t: F.concat(F.upper(t), F.lit("!"))).select("image_id", "w", "text", "confidence")


@register("verifier_latency", WITH + " SELECT modality, count(verifier_elapsed) AS n_verified, round(avg(verifier_elapsed), 9) AS mean, max(verifier_elapsed) AS top FROM images GROUP BY modality")
def verifier_latency(spark, d):
    rows = fx.images(spark, d).join(fx.score_extra(spark, d), "image_id")
    return rows.groupBy("modality").agg(F.count("verifier_elapsed").alias("n_verified"), F.round(F.avg("verifier_elapsed"), 9).alias("mean"), F.max("verifier_elapsed").alias("top"))


@register("filter_blank_words", WITH + ", p AS (SELECT image_id, w, CASE WHEN w % 7 = 0 THEN '  ' WHEN w % 11 <> 0 THEN text END AS text FROM pred) SELECT * FROM p WHERE trim(text) <> ''")
def filter_blank_words(spark, d):
    p = fx.predictions(spark, d).withColumn("text", F.when(F.col("w") % 7 == 0, " \t ").when(F.col("w") % 11 != 0, F.col("text")))
    return ocrseeds.drop_blank_words(p).select("image_id", "w", "text")


OCR = "SELECT event_id, CAST(event_id % 5 + 1 AS INTEGER) AS level, CASE WHEN event_id % 13 = 0 THEN 'bad' WHEN event_id % 11 = 0 THEN '-1' ELSE CAST(event_id % 101 AS VARCHAR) END AS conf, CASE WHEN event_id % 17 = 0 THEN '  ' ELSE 'T' || event_id END AS text, event_id % 300 AS l, event_id % 200 AS t, event_id % 50 AS w, event_id % 20 AS h FROM events"


def _ocr(spark, d):
    k = F.col("event_id")
    conf = F.when(k % 13 == 0, "bad").when(k % 11 == 0, "-1").otherwise((k % 101).cast("string"))
    return fx.read(spark, d, "events").select("event_id", (k % 5 + 1).cast("int").alias("level"), conf.alias("conf"), F.when(k % 17 == 0, "  ").otherwise(F.concat(F.lit("T"), k.cast("string"))).alias("text"), *[(k % n).alias(c) for c, n in (("l", 300), ("t", 200), ("w", 50), ("h", 20))])


def _seeds(spark, d):
    return ocrseeds.seed_tokens(_ocr(spark, d), 2.0, ("event_id",))


SEEDS = f"seeds AS (SELECT event_id, text, coalesce(TRY_CAST(conf AS DOUBLE), -1) AS confidence, l / 2.0 AS x0, t / 2.0 AS y0, (l + w) / 2.0 AS x1, (t + h) / 2.0 AS y1 FROM ({OCR}) WHERE level = 5 AND trim(text) <> '')"


@register("seed_tokens", f"WITH {SEEDS} SELECT * FROM seeds")
def seed_tokens(spark, d):
    return _seeds(spark, d)


@register("degenerate_boxes", f"WITH {SEEDS} SELECT count(*) AS n, count(*) FILTER (WHERE x0 = x1 OR y0 = y1) AS degenerate FROM seeds")
def degenerate_boxes(spark, d):
    return ocrseeds.degenerate(_seeds(spark, d))


BUCKETS = list(ocrseeds.BUCKETS)
BUCKET_SQL = "CASE WHEN confidence < 0 THEN '-1' WHEN confidence >= 90 THEN '90-100' ELSE CAST(CAST(floor(confidence / 10) * 10 AS INTEGER) AS VARCHAR) || '-' || CAST(CAST(floor(confidence / 10) * 10 AS INTEGER) + 9 AS VARCHAR) END"


@register("confidence_hist", f"WITH {SEEDS} SELECT b AS bucket, count(event_id) AS n FROM (SELECT unnest({BUCKETS}) AS b) LEFT JOIN (SELECT event_id, {BUCKET_SQL} AS k FROM seeds) ON b = k GROUP BY b")
def confidence_hist(spark, d):
    return ocrseeds.confidence_histogram(_seeds(spark, d))


@register("confidence_stats", f"WITH {SEEDS} SELECT count(*) AS n, min(confidence) AS lo, median(confidence) AS mid, max(confidence) AS hi FROM seeds")
def confidence_stats(spark, d):
    return ocrseeds.confidence_stats(_seeds(spark, d))


@register("confidence_gate", WITH + ", g(grp, gate) AS (VALUES ('BUILDING', 0.5), ('MACHINERY', 0.8), ('(unknown)', 0.6)), v AS (SELECT p.image_id, p.w, confidence, CASE WHEN image_id % 9 = 0 THEN '(unknown)' ELSE stratum END AS grp FROM pred p JOIN images i USING (image_id)) SELECT image_id, w, grp FROM v LEFT JOIN g USING (grp) WHERE confidence IS NULL OR confidence < 0 OR confidence >= coalesce(gate, 0)")
def confidence_gate(spark, d):
    gates = spark.createDataFrame([("BUILDING", 0.5), ("MACHINERY", 0.8), (review.UNKNOWN, 0.6)], "grp string, gate double")
    groups = fx.images(spark, d).where("image_id % 9 <> 0").select("image_id", F.col("stratum").alias("group"))
    rows = review.with_group(fx.predictions(spark, d), groups, F.broadcast(gates))
    return rows.where(review.visible(F.col("confidence"), F.col("gate"))).select("image_id", "w", "grp")


@register("box_geometry", WITH + " SELECT stratum, quantile_disc(x1 - x0, 0.1) AS p10, quantile_disc(x1 - x0, 0.5) AS p50, quantile_disc(x1 - x0, 0.9) AS p90 FROM gt JOIN images USING (image_id) GROUP BY stratum")
def box_geometry(spark, d):
    rows = fx.gt_tokens(spark, d).join(fx.images(spark, d).select("image_id", "stratum"), "image_id")
    return ocrseeds.percentiles(rows, "stratum", F.col("x1") - F.col("x0"), {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@register("set_hash", WITH + " SELECT stratum, sha256(string_agg(image_id || chr(10), '' ORDER BY CAST(image_id AS VARCHAR))) AS digest FROM images GROUP BY stratum")
def set_hash(spark, d):
    return sets.set_digest(fx.images(spark, d), "stratum").drop("n")


@register("linear_window", "SELECT p_partkey, array_to_string(list_transform([p_partkey % 300, p_partkey % 700, p_partkey % 50], lambda x: CAST(round_even(greatest(0, least(255, (x - 40) / 400.0 * 255)), 0) AS INTEGER)), ',') AS pixels FROM part")
def linear_window(spark, d):
    k = F.col("p_partkey")
    return fx.read(spark, d, "part").select("p_partkey", F.array_join(F.transform(F.array(k % 300, k % 700, k % 50), lambda x: F.rint(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (x - 40) / 400.0 * 255))).cast("int").cast("string")), ",").alias("pixels"))
