"""Queries of validation, reconciliation and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmark.operators import constraints, manifests, reconcile, review
from glyphmark.plans import fixtures as fx
from glyphmark.plans.registry import register

WITH = "WITH " + fx.SQL
RAW_SQL = """raw AS (SELECT ps || '' AS row_key, CASE WHEN p % 31 = 0 THEN '' ELSE 'i' || p END AS image_id, 's' AS series_uid, 'CT' AS modality, CASE WHEN p % 37 = 0 THEN '' ELSE 'v' END AS vendor, 'a' AS stratum,
 CASE p % 7 WHEN 0 THEN '03' WHEN 1 THEN '-4' WHEN 2 THEN '+3' ELSE CAST(p AS VARCHAR) END AS frame_idx, 't' AS token_text,
 CASE p % 11 WHEN 0 THEN 'x' WHEN 1 THEN 'inf' WHEN 2 THEN '-2' ELSE '10' END AS x0, '5' AS y0, CASE p % 5 WHEN 0 THEN '7' WHEN 1 THEN '900' ELSE '50' END AS x1, '20.5' AS y1, CASE WHEN p % 13 = 0 THEN 'phi' ELSE 'KEEP' END AS label,
 CASE WHEN p % 17 <> 0 THEN 800 END AS w, CASE WHEN p % 17 <> 0 THEN 600 END AS h FROM (SELECT p_partkey AS ps, p_partkey AS p FROM part)),
cc AS (SELECT *, x0 IN ('x') AS bad, x0 = 'inf' AS inf, x0 = '-2' AS neg FROM raw),
viol AS (SELECT row_key, 'FIELD_EMPTY' AS code, 'image_id' AS "column" FROM cc WHERE image_id = '' UNION ALL SELECT row_key, 'FIELD_EMPTY', 'vendor' FROM cc WHERE vendor = ''
 UNION ALL SELECT row_key, 'LABEL_INVALID', 'label' FROM cc WHERE label = 'phi' UNION ALL SELECT row_key, CASE WHEN frame_idx = '-4' THEN 'FRAME_NEGATIVE' ELSE 'FRAME_NOT_INT' END, 'frame_idx' FROM cc WHERE frame_idx IN ('03', '-4', '+3')
 UNION ALL SELECT row_key, CASE WHEN bad THEN 'COORD_NOT_NUMBER' WHEN inf THEN 'COORD_NOT_FINITE' ELSE 'COORD_NEGATIVE' END, 'x0' FROM cc WHERE bad OR inf OR neg
 UNION ALL SELECT row_key, 'BOX_ORDER_X', 'x1' FROM cc WHERE x0 = '10' AND x1 = '7' UNION ALL SELECT row_key, 'SIZE_UNKNOWN', 'image_id' FROM cc WHERE w IS NULL UNION ALL SELECT row_key, 'BOX_OUTSIDE_X', 'x1' FROM cc WHERE x0 = '10' AND x1 = '900' AND w IS NOT NULL)"""


def _violations(spark, d):
    p = F.col("p_partkey")
    pick = lambda n, other, *some: F.coalesce(F.get(F.array(*[F.lit(s) for s in some]), (p % n).cast("int")), other)
    size = lambda v: F.when(p % 17 != 0, v)
    rows = fx.read(spark, d, "part").select(
        p.cast("string").alias("row_key"), F.when(p % 31 == 0, "").otherwise(F.concat(F.lit("i"), p.cast("string"))).alias("image_id"), F.lit("s").alias("series_uid"), F.lit("CT").alias("modality"), F.when(p % 37 == 0, "").otherwise("v").alias("vendor"), F.lit("a").alias("stratum"),
        pick(7, p.cast("string"), "03", "-4", "+3").alias("frame_idx"), F.lit("t").alias("token_text"), pick(11, F.lit("10"), "x", "inf", "-2").alias("x0"), F.lit("5").alias("y0"), pick(5, F.lit("50"), "7", "900").alias("x1"), F.lit("20.5").alias("y1"),
        F.when(p % 13 == 0, "phi").otherwise("KEEP").alias("label"), size(800).alias("w"), size(600).alias("h"),
    )
    return constraints.violations(rows, "row_key")


@register("validate_rows", f"WITH {RAW_SQL} SELECT * FROM viol")
def validate_rows(spark, d):
    return _violations(spark, d)


@register("validate_frame_idx", f"WITH {RAW_SQL} SELECT row_key, code FROM viol WHERE \"column\" = 'frame_idx'")
def validate_frame_idx(spark, d):
    return _violations(spark, d).where("column = 'frame_idx'").select("row_key", "code")


@register("validate_coords", f"WITH {RAW_SQL} SELECT row_key, code FROM viol WHERE code LIKE 'COORD%'")
def validate_coords(spark, d):
    return _violations(spark, d).where("code LIKE 'COORD%'").select("row_key", "code")


@register("validate_bounds", f"WITH {RAW_SQL} SELECT row_key, code FROM viol WHERE code LIKE 'BOX%' OR code = 'SIZE_UNKNOWN'")
def validate_bounds(spark, d):
    return _violations(spark, d).where("code LIKE 'BOX%' OR code = 'SIZE_UNKNOWN'").select("row_key", "code")


@register("violations_by_code", f"WITH {RAW_SQL} SELECT code, count(*) AS n, array_to_string(list_sort(list(DISTINCT row_key))[1:10], ',') AS first, greatest(0, count(*) - 10) AS more FROM viol GROUP BY code")
def violations_by_code(spark, d):
    return constraints.by_code(_violations(spark, d), "row_key").withColumn("first", F.array_join("first", ","))


@register("manifest_violations", "WITH m AS (SELECT CASE WHEN o_orderkey % 19 = 0 THEN ' ' ELSE 'u' || o_orderkey // 2 END AS uid, CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE 'CT' END AS modality, CASE WHEN o_orderkey % 7 <> 0 THEN 'a' END AS stratum, CASE WHEN o_orderkey % 29 = 0 THEN '1.5' WHEN o_orderkey % 31 = 0 THEN 'x' ELSE '3' END AS frame FROM orders), v AS (SELECT *, TRY_CAST(frame AS DOUBLE) AS f FROM m) SELECT 'KEY_BLANK' AS code, 'series_uid' AS \"column\", count(*) FILTER (WHERE trim(uid) = '') AS n FROM v UNION ALL SELECT 'CATEGORY_BLANK', 'modality', count(*) FILTER (WHERE modality = '') FROM v UNION ALL SELECT 'CATEGORY_BLANK', 'stratum', count(*) FILTER (WHERE stratum IS NULL) FROM v UNION ALL SELECT 'CATEGORY_BLANK', 'vendor', 0 UNION ALL SELECT 'FRAME_NOT_NUMERIC', 'frame_idx', count(*) FILTER (WHERE f IS NULL) FROM v UNION ALL SELECT 'FRAME_NOT_INTEGRAL', 'frame_idx', count(*) FILTER (WHERE f <> floor(f)) FROM v UNION ALL SELECT 'KEY_DUPLICATE', 'series_uid', count(*) FROM (SELECT uid FROM m WHERE trim(uid) <> '' GROUP BY uid HAVING count(*) > 1)")
def manifest_violations(spark, d):
    k = F.col("o_orderkey")
    frame = F.when(k % 29 == 0, "1.5").when(k % 31 == 0, "x").otherwise("3")
    m = fx.read(spark, d, "orders").select(F.when(k % 19 == 0, " ").otherwise(F.concat(F.lit("u"), F.expr("cast(o_orderkey div 2 as string)"))).alias("series_uid"), F.when(k % 23 == 0, "").otherwise("CT").alias("modality"), F.when(k % 7 != 0, "a").alias("stratum"), F.lit("v").alias("vendor"), frame.alias("frame_idx"))
    return manifests.violations(m)


@register("identity_violations", "WITH s AS (SELECT o_custkey % 100 AS run_id, CASE WHEN o_custkey % 100 = 7 AND o_orderkey % 3 = 0 THEN '  ' ELSE 'm' END AS model_name, CASE WHEN o_custkey % 100 = 9 AND o_orderkey % 2 = 0 THEN 'v2' ELSE 'v1' END AS version FROM orders) SELECT run_id, count(*) FILTER (WHERE trim(model_name) = '') AS blanks, count(DISTINCT (model_name, version)) AS identities, CASE WHEN count(*) FILTER (WHERE trim(model_name) = '') > 0 THEN 'BLANK_IDENTITY' ELSE 'MIXED_IDENTITY' END AS code FROM s GROUP BY run_id HAVING count(*) FILTER (WHERE trim(model_name) = '') > 0 OR count(DISTINCT (model_name, version)) > 1")
def identity_violations(spark, d):
    run = F.col("o_custkey") % 100
    s = fx.read(spark, d, "orders").select(run.alias("run_id"), F.when((run == 7) & (F.col("o_orderkey") % 3 == 0), "  ").otherwise("m").alias("model_name"), F.when((run == 9) & (F.col("o_orderkey") % 2 == 0), "v2").otherwise("v1").alias("version"), F.lit("c").alias("config_id"), F.lit("h").alias("config_hash"), F.lit(None).cast("double").alias("verifier_elapsed"), F.lit(None).cast("string").alias("verifier_model"), F.lit(None).cast("string").alias("verifier_version"))
    return constraints.identity_violations(s)


@register("completeness_gate", WITH + ", s AS (SELECT image_id FROM images WHERE image_id % 8 <> 0), r AS (SELECT image_id, CASE WHEN image_id % 9 = 0 THEN 'deferred' ELSE 'accepted' END AS state FROM images WHERE image_id % 12 <> 5) SELECT coalesce(s.image_id, r.image_id) AS image_id, CASE WHEN r.image_id IS NULL THEN 'MISSING' WHEN s.image_id IS NULL THEN 'ORPHAN' ELSE 'DEFERRED' END AS code FROM s FULL JOIN r ON s.image_id = r.image_id WHERE r.image_id IS NULL OR s.image_id IS NULL OR state = 'deferred'")
def completeness_gate(spark, d):
    im = fx.images(spark, d).select("image_id")
    reviewed = im.where("image_id % 12 <> 5").withColumn("state", F.when(F.col("image_id") % 9 == 0, "deferred").otherwise("accepted"))
    return reconcile.completeness(im.where("image_id % 8 <> 0"), reviewed)


@register("preflight_sweep", WITH + ", m AS (SELECT image_id, sha256(image_id || '') AS s FROM images WHERE image_id % 11 <> 0), f AS (SELECT image_id, sha256(CASE WHEN image_id % 10 = 0 THEN 'x' ELSE image_id || '' END) AS s FROM images WHERE image_id % 14 <> 0) SELECT coalesce(m.image_id, f.image_id) AS image_id, CASE WHEN f.image_id IS NULL THEN 'FILE_MISSING' WHEN m.image_id IS NULL THEN 'FILE_ORPHAN' ELSE 'HASH_DIFFERS' END AS code FROM m FULL JOIN f USING (image_id) WHERE f.image_id IS NULL OR m.image_id IS NULL OR m.s <> f.s UNION ALL SELECT image_id, 'SEED_ORPHAN' FROM images WHERE image_id % 22 < 3 AND image_id NOT IN (SELECT image_id FROM m)")
def preflight_sweep(spark, d):
    im, k = fx.images(spark, d).select("image_id"), F.col("image_id").cast("string")
    listed = im.where("image_id % 11 <> 0").withColumn("sha256", F.sha2(k, 256))
    files = im.where("image_id % 14 <> 0").withColumn("sha256", F.sha2(F.when(F.col("image_id") % 10 == 0, "x").otherwise(k), 256))
    return reconcile.preflight(listed, files, im.where("image_id % 22 < 3"))


@register("provenance_drift", WITH + ", o AS (SELECT image_id, CASE WHEN image_id % 10 <> 1 THEN 'engine-1' END AS e, CASE WHEN image_id % 4 = 0 THEN 'h0' ELSE 'h1' END AS h FROM images), n AS (SELECT image_id, CASE WHEN image_id % 6 = 0 THEN 'engine-2' ELSE 'engine-1' END AS e, CASE WHEN image_id % 8 = 0 THEN 'h0' WHEN image_id % 4 <> 0 THEN 'h1' END AS h FROM images) SELECT image_id, concat_ws(',', CASE WHEN o.e IS DISTINCT FROM n.e THEN 'engine' END, CASE WHEN o.h IS DISTINCT FROM n.h THEN 'config_hash' END) AS drifted FROM o JOIN n USING (image_id) WHERE o.e IS DISTINCT FROM n.e OR o.h IS DISTINCT FROM n.h")
def provenance_drift(spark, d):
    im, k = fx.images(spark, d).select("image_id"), F.col("image_id")
    old = im.select(k, F.when(k % 10 != 1, F.lit("engine-1")).alias("engine"), F.when(k % 4 == 0, "h0").otherwise("h1").alias("config_hash"))
    now = im.select(k, F.when(k % 6 == 0, "engine-2").otherwise("engine-1").alias("engine"), F.when(k % 8 == 0, "h0").when(k % 4 == 0, None).otherwise("h1").alias("config_hash"))
    return reconcile.provenance_drift(old, now, ("engine", "config_hash")).select("image_id", F.array_join("drifted", ",").alias("drifted"))


@register("dedupe_sets", "WITH u AS (SELECT o_orderkey // 2 AS id, o_orderkey % 2 AS set_no, CASE WHEN o_orderkey % 14 = 1 THEN 'b' ELSE 'a' END AS sha, CASE WHEN o_orderkey % 30 <> 4 THEN 'engine-1' ELSE '?' END AS e FROM orders) SELECT id, min(set_no) AS set_no, count(DISTINCT sha) > 1 OR count(DISTINCT e) > 1 AS conflict FROM u GROUP BY id")
def dedupe_sets(spark, d):
    k = F.col("o_orderkey")
    u = fx.read(spark, d, "orders").select(F.expr("o_orderkey div 2").alias("id"), (k % 2).alias("set_no"), F.when(k % 14 == 1, "b").otherwise("a").alias("sha256"), F.when(k % 30 != 4, "engine-1").alias("engine"))
    return reconcile.union_of_sets(u, ("engine",))


@register("id_collisions", "WITH m AS (SELECT substr(md5(CASE WHEN o_orderkey % 50 = 3 THEN 'twice' ELSE o_orderkey || '' END), 1, CASE WHEN o_orderkey % 1000 = 9 THEN 6 ELSE 4 END) AS id, o_orderkey // 3 AS src FROM orders) SELECT 'ID_OF_TWO_SOURCES' AS code, id AS value, count(DISTINCT src) AS n FROM m GROUP BY id HAVING count(DISTINCT src) > 1 UNION ALL SELECT 'SOURCE_UNDER_TWO_IDS', src || '', count(DISTINCT id) FROM m GROUP BY src HAVING count(DISTINCT id) > 1 UNION ALL SELECT 'ID_LENGTHS_MIXED', length(id) || '', count(*) FROM m WHERE (SELECT count(DISTINCT length(id)) FROM m) > 1 GROUP BY length(id)")
def id_collisions(spark, d):
    k = F.col("o_orderkey")
    name = F.md5(F.when(k % 50 == 3, F.lit("twice")).otherwise(k.cast("string")))
    rows = fx.read(spark, d, "orders").select(F.when(k % 1000 == 9, F.substring(name, 1, 6)).otherwise(F.substring(name, 1, 4)).alias("id"), F.expr("o_orderkey div 3").alias("source"))
    return manifests.id_collisions(rows)


@register("backmap_fd_violations", "SELECT o_custkey AS image_id, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def backmap_fd_violations(spark, d):
    rows = fx.read(spark, d, "orders").select(F.col("o_custkey").alias("image_id"), "o_orderpriority")
    return manifests.functional_violations(rows, "image_id", "o_orderpriority")


@register("blank_contradictions", WITH + " SELECT image_id FROM images WHERE image_id % 10 < 2 AND image_id IN (SELECT image_id FROM gt)")
def blank_contradictions(spark, d):
    return reconcile.contradictions(fx.images(spark, d).where("image_id % 10 < 2"), fx.gt_tokens(spark, d))


@register("control_box_violations", WITH + " SELECT DISTINCT image_id FROM gt WHERE image_id % 15 = 1")
def control_box_violations(spark, d):
    return reconcile.contradictions(fx.images(spark, d).where("image_id % 15 = 1"), fx.gt_tokens(spark, d))


@register("review_record_violations", "WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 'open' WHEN o_orderkey % 4 = 0 THEN 'deferred' ELSE 'accepted' END AS state, CASE WHEN o_orderkey % 6 = 0 THEN 'unreadable' WHEN o_orderkey % 20 = 0 THEN 'other' END AS reason, o_orderkey % 4 <> 0 OR o_orderkey % 10 = 0 AS has FROM orders) SELECT k AS image_id, 'STATE_INVALID' AS code FROM r WHERE state = 'open' UNION ALL SELECT k, 'DEFER_REASON_INVALID' FROM r WHERE state = 'deferred' AND coalesce(reason, '') <> 'unreadable' UNION ALL SELECT k, 'REASON_WITHOUT_DEFER' FROM r WHERE state = 'accepted' AND reason IS NOT NULL UNION ALL SELECT k, 'DEFERRED_WITH_TOKENS' FROM r WHERE state = 'deferred' AND has UNION ALL SELECT k, 'BOX_NOT_FOUR' FROM r WHERE has AND k % 16 = 1 UNION ALL SELECT k, 'LABEL_INVALID' FROM r WHERE has AND k % 18 = 1 UNION ALL SELECT k, 'TEXT_BLANK' FROM r WHERE has AND k % 22 = 1 UNION ALL SELECT k, 'SEED_INDEX_NEGATIVE' FROM r WHERE has AND k % 25 = 0 UNION ALL SELECT k, 'SEED_INDEX_REPEATED' FROM r WHERE has AND (k % 25 = 0 OR k % 21 = 0)")
def review_record_violations(spark, d):
    k = F.col("o_orderkey")
    state = F.when(k % 9 == 0, "open").when(k % 4 == 0, "deferred").otherwise("accepted")
    reason = F.when(k % 6 == 0, "unreadable").when(k % 20 == 0, "other")
    index = lambda i: F.when(k % 25 == 0, -1).when(k % 21 == 0, 7).otherwise(i)
    box = F.when(k % 16 == 1, F.array(F.lit(0.0))).otherwise(F.array(*[F.lit(float(v)) for v in (0, 0, 5, 5)]))
    token = lambda i: F.struct(box.alias("box"), F.when(k % 18 == 1, "X").otherwise("KEEP").alias("label"), F.when(k % 22 == 1, "  ").otherwise("a").alias("text"), index(F.lit(i)).alias("seed_index"))
    tokens = F.when((k % 4 != 0) | (k % 10 == 0), F.array(token(0), token(1)))
    return review.record_violations(fx.read(spark, d, "orders").select(k.alias("image_id"), state.alias("state"), reason.alias("defer_reason"), tokens.alias("tokens")))


@register("frame_disagreements", WITH + " SELECT stratum, count(*) FILTER (WHERE frame_idx <> CASE WHEN image_id % 8 = 0 THEN 0 ELSE frame_idx END) AS n FROM images GROUP BY stratum")
def frame_disagreements(spark, d):
    m = fx.images(spark, d)
    rendered = m.select("image_id", F.when(F.col("image_id") % 8 == 0, 0).otherwise(F.col("frame_idx")).alias("rendered"))
    return manifests.frame_disagreements(m.select("image_id", "stratum", "frame_idx"), rendered, "image_id", "stratum")


@register("upsert_manifest", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM part UNION ALL SELECT -s_suppkey, 'new' FROM supplier")
def upsert_manifest(spark, d):
    old = fx.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("old").alias("version"))
    new = old.where("id % 3 = 0").select("id", F.lit("new").alias("version")).unionByName(fx.read(spark, d, "supplier").select((-F.col("s_suppkey")).alias("id"), F.lit("new").alias("version")))
    return manifests.upsert(old, new, "id")


@register("density_outliers", WITH + ", t AS (SELECT stratum, count(*) / count(DISTINCT image_id) AS a FROM gt JOIN images USING (image_id) GROUP BY stratum), o AS (SELECT count(*) / count(DISTINCT image_id) AS b FROM gt) SELECT stratum, round(a / b, 9) AS ratio FROM t, o")
def density_outliers(spark, d):
    rows = fx.gt_tokens(spark, d).select("image_id").join(fx.images(spark, d).select("image_id", "stratum"), "image_id")
    return reconcile.density(rows, "stratum").select("stratum", F.round("ratio", 9).alias("ratio"))