"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws the exponential key -ln(u) / w, where u is a keyed hash of its id
and w its quality weight.  Within a source documents are taken in key order.  A source's
target is met by complete epochs of all its documents, then by the documents whose prefix
sum of words fits the rest.  The document across the budget is taken if that comes nearer.

Prefix sums are in levels: slices are summed by SLICES_TOGETHER, then one by one, and only
within a slice are rows ordered.  A slice is the share of a source's documents with a smaller
key, by the law 1 - (1 - key) ** weight of the keys of each weight; so it holds about
SLICE_ROWS documents whatever the weights, and a source with a third of all rows is no
single task.

Targets: sources in code-point order, null last, weigh `cycle` in turn and share
`total_share` of all words; none is above `max_epochs` times its own words, and what is
above is shared again by weight.

Rows with one doc_id, source and text are counted first and are one entry of so many rows: how many
of them fit is worked out, not tried one by one, so no number of copies is a task's.  Only where the budget ends
among such rows are they told apart, by where they lie.  Rows of one doc_id with different texts draw apart.

Null and empty texts have size 0 and are taken 0 times.  A null doc_id draws by its text.
Other columns are kept in `mix` and not read in `mixed_counts`.  The table of sources (a row each, never a row per document) is summed
in the cluster and its targets are set on the driver; it may have MAX_SOURCES rows at most,
beyond which the operator refuses.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmark.llm.common import cut, stored, table, text_key

CYCLE, MAX_EPOCHS, TOTAL_SHARE = (1, 2, 3), 3, 1.0
SLICE_ROWS, SLICES_TOGETHER, MAX_SOURCES, SEED = 2_000, 1_000, 1_000_000, "mix-1"
#: Rows that are made from one entry at once.
BLOCK = 10_000
#: What quality_weight can give.
WEIGHTS = (1.0, 0.5, 0.25)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(size: Column, chars: Column) -> Column:
    """0.25 to 1: long enough texts with words of a usual length weigh most."""
    usual = F.when((chars >= 3 * size) & (chars <= 13 * size), 1.0).otherwise(0.5)
    return usual * F.when(size >= 50, 1.0).otherwise(0.5)


def unit_draw(drawn: Column, seed: str) -> Column:
    """A uniform number in (0, 1) from 52 bits of md5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), drawn.cast("string"))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(2**52)


def source_targets(sizes: list[tuple[str | None, int]], cycle=CYCLE, max_epochs: int = MAX_EPOCHS, total_share: float = TOTAL_SHARE) -> list[tuple[str | None, int, float]]:
    """(source, size, target) in order.  Water filling: a capped source leaves, the rest share again."""
    rows = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = [cycle[i % len(cycle)] for i in range(len(rows))]
    target = [0.0] * len(rows)
    rest, free = total_share * sum(s for _, s in rows), list(range(len(rows)))
    while free:
        unit = rest / sum(weight[i] for i in free)
        capped = [i for i in free if weight[i] * unit > max_epochs * rows[i][1]]
        for i in capped or free:
            target[i] = float(max_epochs * rows[i][1]) if capped else weight[i] * unit
        if not capped:
            break
        rest -= sum(target[i] for i in capped)
        gone = set(capped)
        free = [i for i in free if i not in gone]
    return [(s, n, t) for (s, n), t in zip(rows, target, strict=True)]


def _rank_share(weights: tuple[float, ...]) -> Column:
    """About which share of a source's documents have a smaller key: the keys' law, weighed by the source's documents of each weight."""
    left = 1 - F.col("__key")
    below = [F.col(f"__of_{k}") * (1 - F.pow(left, F.lit(w))) for k, w in enumerate(weights)]
    return reduce(add, below) / F.greatest(reduce(add, [F.col(f"__of_{k}") for k in range(len(weights))]), F.lit(1))


def _taken(entries: DataFrame, cycle, max_epochs: int, total_share: float) -> DataFrame:
    """entries: __id, __source, __row, __rows, __size, __weight, __key in [0, 1).  Adds __source_size, __target, __epochs, and __more: how many of the rows are taken once more."""
    spark = entries.sparkSession
    entries = cut(entries)
    of = [F.count(F.when(F.col("__weight") == w, 1)).alias(f"of_{k}") for k, w in enumerate(WEIGHTS)]
    per_source = entries.groupBy("__source").agg(F.sum(F.col("__size") * F.col("__rows")).alias("size"), *of).limit(MAX_SOURCES + 1).collect()
    if len(per_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    weighed = {r["__source"]: [r[f"of_{k}"] for k in range(len(WEIGHTS))] for r in per_source}
    targets = [(s, n, t, max(1, -(-sum(weighed[s]) // SLICE_ROWS)), *weighed[s]) for s, n, t in source_targets([(r["__source"], r["size"]) for r in per_source], cycle, max_epochs, total_share)]
    plan = spark.createDataFrame(targets, "__s string, __source_size long, __target double, __slices long, " + ", ".join(f"__of_{k} long" for k in range(len(WEIGHTS))))
    if len(targets) <= 10_000:
        plan = F.broadcast(plan)
    sliced = entries.join(plan, F.col("__source").eqNullSafe(F.col("__s")), "inner").drop("__s")
    sliced = sliced.withColumn("__slice", F.least(F.floor(_rank_share(WEIGHTS) * F.col("__slices")), F.col("__slices") - 1)).drop(*[f"__of_{k}" for k in range(len(WEIGHTS))])
    sliced = sliced.withColumn("__words", F.col("__size") * F.col("__rows"))
    ahead = _words_ahead(sliced)
    within = Window.partitionBy("__source", "__slice").orderBy("__key", "__id", "__size", "__row").rowsBetween(Window.unboundedPreceding, -1)
    running = sliced.withColumn("__before", F.coalesce(F.sum("__words").over(within), F.lit(0)))
    running = running.join(ahead, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__slice") == F.col("__k")))
    epochs = F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(F.lit(0))
    rest = F.col("__target") - epochs * F.col("__source_size")
    # A row is taken if the words up to its middle fit.
    begun = F.col("__ahead") + F.col("__before") + F.col("__size") / 2
    fits = F.floor((rest - begun) / F.nullif(F.col("__size"), F.lit(0))) + 1
    more = F.when(begun > rest, 0).otherwise(F.least(F.col("__rows"), F.coalesce(F.greatest(fits, F.lit(1)), F.col("__rows"))))
    return running.withColumn("__epochs", epochs.cast("int")).withColumn("__more", more.cast("long"))


def _words_ahead(sliced: DataFrame) -> DataFrame:
    """__s, __k, __ahead: the words of a source's earlier slices, summed by hundreds of slices and then by slice."""
    sums = cut(sliced.groupBy("__source", "__slice").agg(F.sum("__words").alias("words")).withColumn("far", F.floor(F.col("__slice") / SLICES_TOGETHER)))
    before = lambda by, at: Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    far = sums.groupBy("__source", "far").agg(F.sum("words").alias("words"))
    far = far.select(F.col("__source").alias("s"), F.col("far").alias("f"), F.coalesce(F.sum("words").over(before(["__source"], "far")), F.lit(0)).alias("earlier"))
    near = sums.withColumn("ahead", F.coalesce(F.sum("words").over(before(["__source", "far"], "__slice")), F.lit(0)))
    both = near.join(far, F.col("__source").eqNullSafe(F.col("s")) & (F.col("far") == F.col("f")))
    return cut(both.select(F.col("__source").alias("__s"), F.col("__slice").alias("__k"), (F.col("ahead") + F.col("earlier")).alias("__ahead")))


def _entries(docs: DataFrame, seed: str) -> DataFrame:
    """Rows with one doc_id, source and text as one entry, with the key it draws."""
    size = word_count(F.col("text"))
    rows = docs.select(F.col("doc_id").alias("__id"), F.col("source").cast("string").alias("__source"), text_key(F.col("text")).alias("__row"), size.alias("__size"), F.coalesce(F.length("text"), F.lit(0)).alias("__chars"))
    rows = rows.withColumn("__weight", quality_weight(F.col("__size"), F.col("__chars"))).drop("__chars")
    entries = cut(rows.groupBy("__id", "__source", "__row", "__size", "__weight").agg(F.count("*").alias("__rows")))
    again = entries.where("__id IS NOT NULL").groupBy(F.col("__id").alias("__again")).agg(F.count("*").alias("__n")).where("__n > 1").select("__again")
    drawn = entries.join(again, F.col("__id") == F.col("__again"), "left")
    own = F.col("__id").cast("string")
    apart = F.concat(F.coalesce(own, F.lit("null")), F.lit(":"), F.col("__row").cast("string"))
    key = -F.log(unit_draw(F.when(F.col("__id").isNull() | F.col("__again").isNotNull(), apart).otherwise(own), seed)) / F.col("__weight")
    return drawn.withColumn("__key", 1 - F.exp(-key)).drop("__again")


def mixed_counts(docs: DataFrame, cycle=CYCLE, max_epochs: int = MAX_EPOCHS, total_share: float = TOTAL_SHARE, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies; one row for each row of docs."""
    out = cut(_taken(_entries(docs, seed), cycle, max_epochs, total_share).select("__id", "__rows", "__size", "__source_size", "__target", "__epochs", "__more"))
    # An entry's rows are made again; of one with very many, blocks of them are dealt out first.
    few = out.where(F.col("__rows") <= BLOCK).withColumn("__first", F.lit(0).cast("long"))
    many = out.where(F.col("__rows") > BLOCK)
    many = many.withColumn("__first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__rows") - 1, F.lit(BLOCK).cast("long")))).repartition("__id", "__first")
    rows = few.unionByName(many).withColumn("__at", F.explode(F.sequence(F.col("__first") + 1, F.least(F.col("__rows"), F.col("__first") + BLOCK))))
    copies = F.col("__epochs") + F.when(F.col("__at") <= F.col("__more"), 1).otherwise(0)
    return rows.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (copies * F.col("__size")).cast("long").alias("taken"), copies.cast("int").alias("copies"))


def _told_apart(rows: DataFrame) -> DataFrame:
    """__at: numbers from 1 on within __entry, by where the rows lie; they are stored first, and only a partition's rows are put in order together."""
    laid = stored(rows.withColumn("__place", F.monotonically_increasing_id()), "mix-edges").withColumn("__part", F.shiftright("__place", 33))
    counts = laid.groupBy("__entry", "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__entry").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("__entry", "__part", F.coalesce(before, F.lit(0)).alias("__earlier"))
    within = F.row_number().over(Window.partitionBy("__entry", "__part").orderBy("__place"))
    return laid.withColumn("__k", within).join(counts, ["__entry", "__part"]).withColumn("__at", F.col("__k") + F.col("__earlier")).drop("__k", "__earlier", "__part", "__place")


def mix(docs: DataFrame, cycle=CYCLE, max_epochs: int = MAX_EPOCHS, total_share: float = TOTAL_SHARE, seed: str = SEED) -> DataFrame:
    """The documents the mix takes, with all their columns and `mix_copies`, how often each is used."""
    taken = _taken(_entries(docs, seed), cycle, max_epochs, total_share).where("__epochs + __more > 0 AND __size > 0")
    taken = cut(taken.select("__id", "__source", "__row", "__epochs", "__more", F.when((F.col("__more") > 0) & (F.col("__more") < F.col("__rows")), F.xxhash64("__id", "__source", "__row")).alias("__entry")))
    names = [c for c in docs.columns if c != "mix_copies"]
    # Numbered while they are joined: a column of docs may have any name, also one of those above.
    at = {c: F.col(f"c{i}") for i, c in enumerate(names)}
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    mine = at["doc_id"].eqNullSafe(F.col("__id")) & at["source"].eqNullSafe(F.col("__source")) & (text_key(at["text"]) == F.col("__row"))

    def out(kept: DataFrame, once_more: Column) -> DataFrame:
        copies = (F.col("__epochs") + F.when(once_more, 1).otherwise(0)).cast("int")
        return kept.where(copies > 0).select(*[at[c].alias(c) for c in names], copies.alias("mix_copies"))

    alike = out(rows.join(taken.where("__entry IS NULL"), mine), F.col("__more") > 0)
    edges = taken.where("__entry IS NOT NULL")
    if edges.isEmpty():
        return alike
    return alike.unionByName(out(_told_apart(rows.join(edges, mine)), F.col("__at") <= F.col("__more")))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_counts(table(spark, sf_dir, "documents")).drop("copies")


def targets_sql(measured: str) -> str:
    """CTEs from `measured` (doc_id, source, size, chars) to the mix; water filling by the sources' order of saturation."""
    return f"""
m AS ({measured}),
k AS (SELECT *, -ln((CAST(('0x' || substr(md5('{SEED}:' || doc_id), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)
        / ((CASE WHEN chars >= 3 * size AND chars <= 13 * size THEN 1.0 ELSE 0.5 END) * (CASE WHEN size >= 50 THEN 1.0 ELSE 0.5 END)) AS raw FROM m),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM m GROUP BY source),
r AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s),
c AS (SELECT *, 3 * source_size / w AS level FROM r),
lv AS (SELECT c.level AS lam, (SELECT sum(source_size) FROM c) AS total,
              (SELECT sum(least(3 * x.source_size, x.w * c.level)) FROM c x) AS filled FROM c),
lo AS (SELECT coalesce(max(lam), 0.0) AS lam FROM lv WHERE filled <= total),
u AS (SELECT ((SELECT sum(source_size) FROM c) - coalesce((SELECT sum(3 * source_size) FROM c, lo WHERE level <= lo.lam), 0))
             / (SELECT sum(w) FROM c, lo WHERE level > lo.lam) AS unit),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, CASE WHEN level <= (SELECT lam FROM lo) THEN 3 * source_size ELSE w * (SELECT unit FROM u) END AS target FROM c),
o AS (SELECT k.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY 1 - exp(-raw), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)"""


OP7_SQL = (
    "WITH"
    + targets_sql(r"SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, coalesce(length(text), 0) AS chars FROM documents")
    + """
SELECT doc_id, size, source_size, target,
       CAST((floor(target / source_size) + CASE WHEN before + size / 2.0 <= target - floor(target / source_size) * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM o"""
)
