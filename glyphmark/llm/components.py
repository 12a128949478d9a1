"""Connected components by minimum labels with pointer jumping, all in joins.

Labels and edges stay distributed; each round is cut by a reliable checkpoint.  A hub's
edges are dealt by join exchanges, which AQE splits, and are reduced by partial minima.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmark.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), in any direction, a != b.  Returns (node, label): the smallest reachable node.

    Nodes without edges do not appear.  Null ends are ignored; no edges give no rows.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = cut(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")))
    total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    while total is not None:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        stepped = labels.join(near, F.col("node") == F.col("u")).select("node", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), "label")
        labels = cut(stepped.join(jump, "to").select("node", "label"))
        before, total = total, labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == before:
            break
    return labels
