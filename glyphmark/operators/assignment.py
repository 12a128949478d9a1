"""One-to-one assignment: the best edge first, then the best of those whose ends are both free.

An image that isn't crowded is one short array of edges, folded in its task.  In a crowded one an
edge that is the best of both its ends is final, whatever else is chosen; its ends leave with all
their edges, and what is left is looked at again.  Since no two edges rank alike this gives what
taking edges one by one gives.  Every step is keyed by an image and an end, minima are
combined before the shuffle, and each round is a table in the shared folder, so no image is held by one
task.  There are as many rounds as the longest chain of ever better edges: a few for boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmark.sources.paths import remove, work_folder

#: Images of more edges are crowded, where nothing else is known of them.
FOLD = 256
ENDS = ("image_id", "g", "w")


def folded(edges: DataFrame) -> DataFrame:
    """The same by a fold over each image's edges, quadratic in those."""
    more = [c for c in edges.columns if c not in (*ENDS, "rank")]
    row = F.struct(*[F.col(c).alias(c) for c in ("g", "w", *more)])
    listed = edges.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("rank", row.alias("row")))).alias("items"))
    kind = listed.schema["items"].dataType.elementType["row"].dataType.simpleString()

    return listed.select("image_id", F.explode(taken("items", kind, lambda item: item["row"])).alias("m")).select("image_id", "m.*")


def taken(items, kind: str, row) -> Column:
    """row(item), of type `kind` with g and w, of the items of a sorted array whose ends are free when it is their turn."""

    def take(done, item):
        busy = F.exists(done, lambda m: (m["g"] == row(item)["g"]) | (m["w"] == row(item)["w"]))
        return F.when(busy, done).otherwise(F.concat(done, F.array(row(item))))

    return F.aggregate(items, F.array().cast(f"array<{kind}>"), take)


def in_rounds(edges: DataFrame) -> DataFrame:
    """The same by rounds of edges that are the best of both ends."""
    spark = edges.sparkSession
    more = [c for c in edges.columns if c not in (*ENDS, "rank")]
    final, held = work_folder(spark, "assigned"), None
    while True:
        path = work_folder(spark, "edges")
        edges.write.parquet(path)
        edges = spark.read.schema(edges.schema).parquet(path)
        if held:
            remove(spark, held)
        held = path
        best = lambda end, other, rows=edges: rows.groupBy("image_id", end).agg(F.min(F.struct("rank", other, *more)).alias("best")).select("image_id", end, f"best.{other}", *[f"best.{c}" for c in more])
        chosen = best("g", "w").join(best("w", "g").select(*ENDS), list(ENDS)).select(*ENDS, *more)
        chosen.write.mode("append").parquet(final)
        taken = spark.read.schema(chosen.schema).parquet(final)
        if edges.isEmpty():
            remove(spark, held)
            return taken
        edges = edges.join(taken.select("image_id", "g"), ["image_id", "g"], "left_anti").join(taken.select("image_id", "w"), ["image_id", "w"], "left_anti")


def assign(edges: DataFrame, crowd: DataFrame | None) -> DataFrame:
    """edges (image_id, g, w, rank, more), each pair once, no two of an image with one rank: the chosen ones without their rank.

    The smallest rank is the best.  crowd holds the image_id of the images to do in rounds."""
    if crowd is None:
        return folded(edges)
    return folded(edges.join(crowd, "image_id", "left_anti")).unionByName(in_rounds(edges.join(crowd, "image_id", "left_semi")))


def many_edged(edges: DataFrame) -> DataFrame | None:
    """image_id of the images of more than FOLD edges; None if there are none."""
    crowd = edges.groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n") > FOLD).select("image_id")
    return None if crowd.isEmpty() else crowd
