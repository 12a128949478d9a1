"""Operators that stream sorted rows: box-free finding, set digests, engines built once a worker."""

import hashlib
import os
import random
import unicodedata

from pyspark.sql import functions as F

from glyphmark.functions import text
from glyphmark.operators import adapters, matching, sets

GT = "image_id long, g long, token_text string"
PRED = "image_id long, w long, text string, confidence double"


def test_boxfree_equals_search_in_the_joined_words(spark):
    rng = random.Random(4)
    piece = lambda: "".join(rng.choice(["a", "b", " ", "é", "é", "　"]) for _ in range(rng.randint(0, 4)))
    gt = [(i, g, piece()) for i in range(30) for g in range(8)] + [(99, 1, "a"), (98, 1, "")]
    pred = [(i, w, piece(), rng.choice([None, 0.2, 0.9])) for i in range(28) for w in range(rng.randint(1, 6))] + [(97, 1, "a", 0.5), (96, 1, None, 0.5)]
    norm = lambda t: unicodedata.normalize("NFC", t).strip()
    want = set()
    for i, g, t in gt:
        words = sorted((w[2], w[3] or 0.0, w[1]) for w in pred if w[0] == i)
        want.add((i, g, bool(words) and norm(t) in norm(" ".join(w[0] for w in words))))
    got = matching.boxfree(spark.createDataFrame(gt, GT).repartition(3), spark.createDataFrame(pred, PRED).repartition(5))
    assert {tuple(r) for r in got.collect()} == want and len({w[2] for w in want}) == 2
    one = spark.createDataFrame([(1, 1, "a")], GT)
    assert [tuple(r) for r in matching.boxfree(one, spark.createDataFrame([(1, 1, None, 0.5)], PRED)).collect()] == [(1, 1, False)]


def test_set_digest_streams_sorted_keys(spark):
    rows = [("a", 10), ("a", 9), ("a", None), ("b", 1), (None, 7), ("b", 1), ("c", None)]
    got = {r.s: (r.n, r.digest) for r in sets.set_digest(spark.createDataFrame(rows, "s string, image_id long"), "s").collect()}
    want = {"a": "10\n9\n", "b": "1\n1\n", None: "7\n"}
    assert got == {k: (v.count("\n"), hashlib.sha256(v.encode()).hexdigest()) for k, v in want.items()}
    assert sets.set_digest(spark.createDataFrame([], "s string, image_id long"), "s").count() == 0


def test_an_engine_is_built_once_in_a_worker(spark, tmp_path):
    marks = str(tmp_path)

    def build():
        with open(f"{marks}/{os.getpid()}", "a") as f:
            f.write("x")
        return lambda image: [{"text": f"{image['image_id']}", "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "confidence": None}] * (image["image_id"] % 3)

    images = spark.range(60).withColumnRenamed("id", "image_id").repartition(20, "image_id")
    for _ in range(2):
        assert adapters.run_engine(images, build, f"engine-{marks}").count() == 60
    builds = [len((tmp_path / f).read_text()) for f in os.listdir(marks)]
    assert set(builds) == {1} and len(builds) < 40


def test_nfc_of_repeated_and_null_texts(spark):
    rows = [("é",), (None,), ("é",), ("é",), ("plain ",), ("가",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(text.normalize(F.col("t"))).collect()] == ["é", None, "é", "é", "plain", "가"]
