"""Queries of file scans, configuration identities, the reader's report and incremental work."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmark.functions.digest import json_digest
from glyphmark.functions.text import percent
from glyphmark.plans import fixtures as fx
from glyphmark.plans.registry import QUERIES, register
from glyphmark.sources import csvfiles
from glyphmark.sources.paths import work_folder
from glyphmark.streaming import attempts, counters

COLUMNS = ["part_key", "label", "note"]
#: Lines of a file by p_partkey % 10: 0 blank, 1 short, 2 quotes and a line end, 3 an empty quoted field, else plain.
LINES_SQL = """SELECT p_partkey % 4 AS file, row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY p_partkey) AS row_no, p_partkey % 10 AS k, p_partkey || '' AS part_key,
 CASE WHEN p_partkey % 10 <> 3 THEN p_type ELSE '' END AS label, CASE WHEN p_partkey % 10 = 2 THEN 'a "b"' || chr(10) || p_brand ELSE p_brand END AS note FROM part"""


def _csv_files(spark, d):
    """Four CSV files of the part table, with the defects that a strict scan has to tell apart."""
    folder, k = work_folder(spark, "strict-csv"), F.col("p_partkey")
    note = F.when(k % 10 == 2, F.concat(F.lit('a "b"\n'), "p_brand")).otherwise(F.col("p_brand"))
    label = F.when(k % 10 == 3, "").otherwise(F.col("p_type"))
    text = F.when(k % 10 == 0, "").when(k % 10 == 1, csvfiles.line([k.cast("string"), label])).otherwise(csvfiles.line([k, label, note]))
    rows = fx.read(spark, d, "part").select((k % 4).alias("file"), k.alias("at"), text.alias("value"))
    heads = rows.select("file").distinct().select("file", F.lit(-1).cast("long").alias("at"), F.lit(",".join(COLUMNS)).alias("value"))
    rows.unionByName(heads).repartition("file").sortWithinPartitions("file", "at").select("file", "value").write.partitionBy("file").text(folder)
    return csvfiles.scan(spark, folder, "part-*")


def _file(path):
    return F.regexp_extract(path, "file=([0-9]+)", 1).cast("long").alias("file")


@register("scan_strict_csv", f"WITH l AS ({LINES_SQL}) SELECT file, row_no, part_key, label, note FROM l WHERE k NOT IN (0, 1)")
def scan_strict_csv(spark, d):
    rows, _ = csvfiles.checked(_csv_files(spark, d), COLUMNS)
    return rows.select(_file("path"), "row_no", *COLUMNS)


@register("strict_csv_problems", f"WITH l AS ({LINES_SQL}) SELECT file, row_no, CASE k WHEN 0 THEN 'ROW_EMPTY' ELSE 'ROW_FIELD_COUNT' END AS code FROM l WHERE k IN (0, 1)")
def strict_csv_problems(spark, d):
    _, problems = csvfiles.checked(_csv_files(spark, d), COLUMNS)
    return problems.select(_file("path"), "row_no", "code")


@register("config_digest", """SELECT p_partkey, substr(sha256('{"engine": "' || p_brand || '", "name": ' || CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE '"' || p_type || '"' END || ', "size": ' || p_size || '}'), 1, 12) AS config_hash FROM part""")
def config_digests(spark, d):
    """Configurations as a table tells them, their keys in another order than the digest's."""
    name = F.when(F.col("p_partkey") % 3 != 0, F.col("p_type"))
    told = F.to_json(F.struct(F.col("p_size").alias("size"), name.alias("name"), F.col("p_brand").alias("engine")), {"ignoreNullFields": "false"})
    return fx.read(spark, d, "part").select("p_partkey", json_digest(told).alias("config_hash"))


@register("report_table_c", "WITH " + fx.SQL + """, b AS (SELECT image_id, true AS is_gt, part % 9 <> 0 AS seen, false AS made FROM gt UNION ALL SELECT image_id, false, false, part % 4 = 0 FROM boxed WHERE image_id % 5 = 0)
SELECT coalesce(stratum, 'ALL') AS grp, count(*) FILTER (WHERE is_gt) AS crops, count(*) FILTER (WHERE seen) AS "read", count(*) FILTER (WHERE is_gt AND NOT seen) AS "empty", count(*) FILTER (WHERE made) AS invented,
 CASE WHEN count(*) FILTER (WHERE NOT is_gt) = 0 THEN 'n/a' ELSE format('{:.2f}%', 100 * count(*) FILTER (WHERE made) / count(*) FILTER (WHERE NOT is_gt)) END AS per_control_crop FROM b JOIN images USING (image_id) GROUP BY GROUPING SETS ((stratum), ())""")
def report_table_c(spark, d):
    """The reader alone: crops read and left empty, and inventions on control crops of blank images."""
    reads = QUERIES["read_axis_split"](spark, d)
    control = fx.read(spark, d, "lineitem").where("l_orderkey % 5 = 0").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.count("*").alias("control"))
    rows = reads.join(control, "image_id", "left").join(fx.images(spark, d).select("image_id", "stratum"), "image_id")
    by = rows.groupingSets([["stratum"], []], "stratum").agg(F.grouping("stratum").alias("all"), F.sum("found").alias("read"), F.sum("omitted").alias("empty"), F.sum("invented").alias("invented"), F.coalesce(F.sum("control"), F.lit(0)).alias("control"))
    rate = F.try_divide(F.col("invented"), F.col("control"))
    return by.select(F.when(F.col("all") == 1, "ALL").otherwise(F.col("stratum")).alias("grp"), (F.col("read") + F.col("empty")).alias("crops"), "read", "empty", "invented", percent(rate, "n/a").alias("per_control_crop"))


@register("stream_counters", "SELECT event_type, count(*) AS n, round(sum(coalesce(value, 0)), 3) AS value FROM events GROUP BY event_type")
def stream_counters(spark, d):
    """Events taken as a stream until none is left, then the counters' totals."""
    path, folder = f"{d}/events.parquet", work_folder(spark, "counters")
    # A file source takes a single file only by a pattern; this one fits the table's own name alone.
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/events.parque[t]")
    counters.append(stream, ["event_type"], ["value"], folder).awaitTermination()
    return counters.totals(spark, ["event_type"], ["value"], folder).withColumn("value", F.round("value", 3))


@register("pending_work", "SELECT o_orderkey AS image_id FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 7 = 0")
def pending_work(spark, d):
    """What a rerun that overwrites has to do: images never done, and those done by another engine."""
    k = F.col("o_orderkey")
    wanted = fx.read(spark, d, "orders").select(k.alias("image_id"), F.lit("engine-2").alias("engine"))
    done = fx.read(spark, d, "orders").where(k % 3 != 0).select(k.alias("image_id"), F.when(k % 7 == 0, "engine-1").otherwise("engine-2").alias("engine"))
    return counters.pending(wanted, done, "image_id", "engine", True).select("image_id")


#: An attempt fails where its event has no value or is an error; its provenance is the kind of event.
ATTEMPTS_SQL = """a AS (SELECT user_id, event_id AS seq, event_type AS provenance, CASE WHEN event_type = 'error' OR event_id % 3 = 0 THEN 'E' || event_id % 5 END AS error FROM events),
k AS (SELECT user_id, count(*) AS attempts, count(error) AS failures, arg_max(provenance, seq) FILTER (WHERE error IS NULL) AS provenance, max(seq) FILTER (WHERE error IS NULL) AS result_seq, arg_max(error, seq) FILTER (WHERE error IS NOT NULL) AS error, max(seq) FILTER (WHERE error IS NOT NULL) AS error_seq FROM a GROUP BY user_id)"""


def _tracked(spark, d):
    """The events as a stream of attempts, tracked until none is left."""
    folder, seq = work_folder(spark, "attempts"), F.col("event_id")
    stream = spark.readStream.schema(fx.read(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    error = F.when((F.col("event_type") == "error") | (seq % 3 == 0), F.concat(F.lit("E"), (seq % 5).cast("string")))
    attempts.track(stream.select("user_id", seq.cast("long").alias("seq"), F.col("event_type").alias("provenance"), error.alias("error")), folder, "user_id").awaitTermination()
    return attempts.latest(spark, folder, "user_id", stream.schema["user_id"].dataType.simpleString())


@register("attempt_status", f"WITH {ATTEMPTS_SQL} SELECT * FROM k")
def attempt_status(spark, d):
    return _tracked(spark, d)


@register("attempt_pending", f"WITH {ATTEMPTS_SQL} SELECT user_id FROM k WHERE provenance IS NULL OR provenance <> 'purchase'")
def attempt_pending(spark, d):
    """What a rerun under one provenance that overwrites has to do: items without a result, and those made under another."""
    wanted = fx.read(spark, d, "events").select("user_id", F.lit("purchase").alias("provenance")).distinct()
    return attempts.pending(wanted, _tracked(spark, d), "user_id", True).select("user_id")
