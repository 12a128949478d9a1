"""Slices of the mix hold about as many documents each, whatever the documents' weights."""

from pyspark.sql import functions as F

from glyphmark.llm import mixing


def test_slices_are_even_at_every_weight(spark):
    rows = spark.range(0, 300_000, 1, 4)
    for shares in ((0, 0, 1), (0, 1, 0), (1, 1, 8), (1, 0, 0)):
        total = sum(shares)
        weight = F.when(F.col("id") % total < shares[0], 1.0).when(F.col("id") % total < shares[0] + shares[1], 0.5).otherwise(0.25)
        keyed = rows.withColumn("__key", 1 - F.exp(F.log(mixing.unit_draw(F.col("id"), "t")) / weight)).withColumn("w", weight)
        counts = keyed.agg(*[F.count(F.when(F.col("w") == w, 1)).alias(f"__of_{k}") for k, w in enumerate(mixing.WEIGHTS)])
        slices = keyed.join(F.broadcast(counts)).groupBy(F.floor(mixing._rank_share(mixing.WEIGHTS) * 150)).count()
        assert slices.agg(F.max("count")).first()[0] < 2 * mixing.SLICE_ROWS


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, copies int, size string")


def test_many_alike_rows_meet_the_target(spark, monkeypatch):
    """100 rows of one document: the mix uses its words to within half a document, however the rows lie, and so do the counts."""
    monkeypatch.setattr(mixing, "BLOCK", 7)
    other = [(100 + k, "word " * 40 + str(k), "b", "en", 0, "x") for k in range(73)]
    df = _docs(spark, [(1, "ten words " * 5, "a", f"l{k % 3}", 0, "x") for k in range(100)] + other).repartition(9)
    for seed in ("s", "t"):
        counts = mixing.mixed_counts(df, seed=seed).where("doc_id = 1")
        target = counts.first().target
        assert counts.count() == 100 and 1000 < target < 2000
        used = mixing.mix(df, seed=seed).where("doc_id = 1")
        assert used.columns == [*df.columns, "mix_copies"]
        for words in (counts.agg(F.sum("taken")).first()[0], used.agg(F.sum(F.col("mix_copies") * 10)).first()[0]):
            assert abs(words - target) <= 5
        assert {r.copies for r in counts.collect()} == {1, 2} == {r.mix_copies for r in used.collect()}


def test_null_and_repeated_ids_are_spread(spark):
    rows = spark.range(0, 30_000, 1, 4)
    for doc_id in (None, 5):
        docs = rows.select(F.lit(doc_id).cast("long").alias("doc_id"), F.concat(F.lit("some text "), "id").alias("text"), F.lit("a").alias("source"))
        entries = mixing._entries(docs, "s")
        assert entries.select("__key").distinct().count() == 30_000
        sliced = entries.groupBy(F.floor(F.col("__key") * 15)).count()
        assert mixing.mixed_counts(docs).agg(F.sum("taken")).first()[0] == 90_000 and sliced.count() > 10


def test_rows_of_one_id_and_size_are_taken_by_their_text(spark):
    """Ties of id and size: the same rows whatever their order."""
    rows = [(1, f"a b {k}", "a", "en", 0, "x") for k in range(40)] + [(2, "word " * 400, "b", "en", 0, "x")]
    found = set()
    for parts in (1, 7):
        found.add(frozenset((r.text, r.mix_copies) for r in mixing.mix(_docs(spark, rows).repartition(parts)).where("source = 'a'").collect()))
    assert len(found) == 1
