"""Folders of JSON documents, one a file, and file digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def records(spark: SparkSession, path: str, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(records, misnamed).  Only `*.json` is read, so an unfinished `.part` file is not.  A document's
    identity is the key inside it; those whose file has another name, or that can't be parsed, come as
    misnamed (file, key) and are in no other result."""
    parsed = spark.read.schema(f"{schema}, _broken string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_broken").option("pathGlobFilter", "*.json").json(path)
    # Spark gives the name with percent escapes, in which a plus is only a plus.
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    named = parsed.select("*", F.regexp_replace(name, r"\.json$", "").alias("_stem"))
    fits = F.col("_broken").isNull() & F.col(key).cast("string").eqNullSafe(F.col("_stem"))
    return named.where(fits).drop("_broken", "_stem"), named.where(~fits).select(F.concat("_stem", F.lit(".json")).alias("file"), F.col(key).cast("string").alias("key"))


def digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size and sha256 of every file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
