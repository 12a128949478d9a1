"""Scans of the evaluation's CSV inputs: headers are exact, columns named, values text until they are checked."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmark.operators import manifests, reconcile

#: The columns of the files.
RENDER_COLUMNS = ("image_id", "frame_idx", "w", "h", "sha256", "fallback_used")
BACKMAP_COLUMNS = ("image_id", "series_uid", "sop_instance_uid", "src_frame_idx", "id_len")
GEOMETRY_COLUMNS = ("image_id", "stratum", "x0", "y0", "x1", "y1")
MANIFEST_COLUMNS = {"series_uid": "series_uid", "modality": "modality", "strata": "stratum", "manufacturer": "vendor", "middle_frame_index": "frame_idx"}


def _csv(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """Text columns by the header; quotes are doubled inside quotes and fields may hold line ends."""
    paths = [paths] if isinstance(paths, str) else paths
    return spark.read.options(header=True, inferSchema=False, multiLine=True, escape='"', encoding="UTF-8", **options).csv(paths)


def _exactly(rows: DataFrame, columns: Iterable[str], what: str) -> DataFrame:
    if tuple(rows.columns) != tuple(columns):
        raise ValueError(f"{what}: the header is {rows.columns}, not {list(columns)}")
    return rows


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Only the whitelisted columns, renamed; every other column is denied by default and never read."""
    return manifests.project(_csv(spark, path), MANIFEST_COLUMNS)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with whole frame numbers; raises with counts by rule, never values, if it breaks any."""
    rows = manifest(spark, path)
    found = [r for r in manifests.violations(rows).collect() if r["n"]]
    if found:
        raise ValueError("the manifest breaks rules: " + ", ".join(f"{r['code']} {r['column']} x {r['n']}" for r in found))
    return rows.withColumn("frame_idx", F.col("frame_idx").cast("double").cast("int"))


def render_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row an image: of rows that repeat an image_id the last in file order."""
    rows = _exactly(_csv(spark, path), RENDER_COLUMNS, "render manifest")
    # One file, so ids that grow with the partition and the row in it are in file order.
    return manifests.last_wins(rows.withColumn("__line", F.monotonically_increasing_id()), "image_id", "__line").drop("__line")


def backmap(spark: SparkSession, path: str) -> DataFrame:
    """image_id to series; raises if an image stands for two series."""
    rows = _exactly(_csv(spark, path), BACKMAP_COLUMNS, "back-map")
    n = manifests.functional_violations(rows, "image_id", "series_uid").count()
    if n:
        raise ValueError(f"{n} image ids of the back-map stand for more than one series")
    return rows


def blank_images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Images whose has_text is 0; lines that begin with # are comments."""
    return reconcile.blank_images(_csv(spark, paths, comment="#").select("image_id", "has_text"))


def exclusions(spark: SparkSession, paths: list[str], key: str = "series_uid") -> DataFrame:
    """The distinct keys of any CSV files that have the column; other columns may differ from file to file."""
    lists = [_csv(spark, p) for p in paths]
    without = [p for p, x in zip(paths, lists, strict=True) if key not in x.columns]
    if without:
        raise ValueError(f"{len(without)} of the lists have no column {key}")
    return reconcile.excluded([x.select(key) for x in lists], key)


def geometry(spark: SparkSession, path: str) -> DataFrame:
    """Boxes and strata of the ground truth; the column of texts is never selected, so the scan prunes it."""
    rows = _csv(spark, path).select(*GEOMETRY_COLUMNS)
    return rows.select("image_id", "stratum", *[F.col(c).cast("double").alias(c) for c in GEOMETRY_COLUMNS[2:]])
