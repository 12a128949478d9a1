"""Spelling variants: a symmetric-delete join, forms of neighbours, roots by joining again.

Every word emits itself and its single deletions, each with the place it was cut at.  Rows that
share a key meet.  A word that is another's deletion lacks one code point of it.  Two words with
the same deletion at the same place differ in that code point and in no other; the same deletion
from other places (letters that changed order) is farther, so the place is what verifies the
distance.  A deletion that several places give counts once where words of different length meet,
and at each place where words of one length do, so each pair of neighbours meets exactly once.

A key and place are shared by at most one word for each letter there is, 90 after lower-casing,
so what meets there is bounded by the alphabet; counts and the best neighbour are taken in a window and no
pairs are made.  Ids follow the order of words by code point, so ties are settled by id.
A form has at least `times` the word's count: following forms ends, and doubling the
steps finds the root of a chain of d forms in log2(d) joins.

Null and empty texts have no words.  A null doc_id counts as an empty one when runs are damaged.
Repeated rows count again.  Words of any length take part: keys above LONG code points are
digests, so a row stays short.  An empty table gives an empty one.  Only `doc_id` and `text` are
read; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmark.llm.common import cut, stored, table

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT, TIMES, DAMAGE, LONG = 5, 3, 2, 97, 64


def without(word: Column, at: Column) -> Column:
    """The word without its code point `at`, counted from 0."""
    return F.concat(word.substr(F.lit(1), at), word.substr(at + 2, F.length(word)))


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int | None = DAMAGE) -> DataFrame:
    """word, n.  One run in `damage` loses a code point, chosen by the digest of doc_id and run; None changes none."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("word"))
    if damage:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        runs = runs.withColumn("h", h).withColumn("word", F.when(F.col("h") % damage == 0, without(F.col("word"), (F.col("h") % F.length("word")).cast("int"))).otherwise(F.col("word")))
    return runs.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _short(word: Column) -> Column:
    return F.when(F.length(word) <= LONG, word).otherwise(F.concat(F.lit("#"), F.sha2(word, 256)))


def _rank(n: str, node: str) -> Column:
    """Smallest for the largest count, of ties for the first word."""
    return F.struct((-F.col(n)).alias("less"), F.col(node).alias("near"))


def neighbours(words: DataFrame) -> DataFrame:
    """words (node, word, n) -> node, n_near, best (less, near) of the words at distance exactly one."""
    at, word = F.col("at"), F.col("word")
    places = words.select("node", "n", "word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("at"))
    first = (at == 0) | (word.substr(at + 1, F.lit(1)) != word.substr(at, F.lit(1)))
    deletions = places.select("node", "n", _short(without(word, at)).alias("key"), "at", first.alias("first"))
    own = words.select(F.col("node").alias("short"), F.col("n").alias("short_n"), _short(word).alias("key"))
    pairs = own.join(deletions.where("first"), "key")
    ends = F.array(F.struct(F.col("short").alias("node"), _rank("n", "node").alias("best")), F.struct(F.col("node").alias("node"), _rank("short_n", "short").alias("best")))
    inserted = pairs.select(F.explode(ends).alias("end")).select("end.node", F.lit(1).cast("long").alias("n_near"), "end.best")
    place = Window.partitionBy("key", "at")
    order = place.orderBy(F.desc("n"), "node")
    rank = _rank("n", "node")
    group = deletions.select("node", F.count("*").over(place).alias("size"), F.row_number().over(order).alias("row"), F.first(rank).over(order).alias("top"), F.lead(rank).over(order).alias("next"))
    replaced = group.where("size > 1").select("node", (F.col("size") - 1).alias("n_near"), F.when(F.col("row") == 1, F.col("next")).otherwise(F.col("top")).alias("best"))
    return inserted.unionByName(replaced).groupBy("node").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """forms (node, form), without cycles -> node, root: the last form that following reaches."""
    known = cut(forms.select("node", F.col("form").alias("root")))
    while True:
        step = known.select(F.col("node").alias("root"), F.col("root").alias("further"))
        known = cut(known.join(step, "root", "left").select("node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not known.agg(F.bool_or("moved")).first()[0]:
            return known.drop("moved")
        known = known.drop("moved")


def group_variants(counts: DataFrame, times: int = TIMES) -> DataFrame:
    """counts (word, n), each word once -> word, form, root, n, n_near, form_n."""
    words = stored(counts.select("word", "n").repartitionByRange("word").sortWithinPartitions("word").withColumn("node", F.monotonically_increasing_id()), "spelling-words")
    near = words.join(neighbours(words), "node", "left")
    strong = -F.col("best.less") >= times * F.col("n")
    known = stored(near.select("node", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")), "spelling-near")
    ends = roots(known.where("form IS NOT NULL").select("node", "form"))
    named = lambda as_node, as_word: words.select(F.col("node").alias(as_node), F.col("word").alias(as_word))
    out = known.withColumnRenamed("form", "form_node").join(ends.withColumnRenamed("root", "root_node"), "node", "left")
    out = out.join(named("form_node", "form"), "form_node", "left").join(named("root_node", "root"), "root_node", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(word_counts(table(spark, sf_dir, "documents")))


OP12_SQL = r"""
WITH RECURSIVE steps AS (SELECT i, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
e AS (SELECT id, run, count(*) AS n, hex(encode(id || run)) AS x FROM d GROUP BY id, run),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(CAST(length(x) // 2 AS BIGINT)), lambda i: CAST(CAST('0x' || substr(x, 2 * i + 1, 2) AS INTEGER) AS BIGINT))), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]))) AS h FROM e, crc),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n) AS n FROM h GROUP BY 1),
v AS MATERIALIZED (SELECT word, CAST(n AS BIGINT) AS n FROM w WHERE length(word) >= 5 AND n >= 3),
del AS MATERIALIZED (SELECT word, n, i AS at, substr(word, 1, i) || substr(word, i + 2) AS key FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
links AS (SELECT a.word, b.word AS near, b.n AS near_n FROM del a JOIN del b ON a.key = b.key AND a.at = b.at AND a.word <> b.word
 UNION SELECT v.word, del.word, del.n FROM v JOIN del ON v.word = del.key UNION SELECT del.word, v.word, v.n FROM v JOIN del ON v.word = del.key),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM links GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
r AS (SELECT word, word AS root, form AS next, 0 AS k FROM f UNION ALL SELECT r.word, f.word, f.form, k + 1 FROM r JOIN f ON f.word = r.next)
SELECT word, form, (SELECT max_by(root, k) FROM r WHERE r.word = f.word) AS root, n, n_near, form_n FROM f
"""
