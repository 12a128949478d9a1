"""The grid join and the assignment against all pairs and one-by-one choice; edit distances against the whole table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmark.functions import edits
from glyphmark.operators import assignment, matching, overlaps, review

GT = "image_id long, g long, token_text string, x0 double, y0 double, x1 double, y1 double, label string"
PRED = "image_id long, w long, text string, x0 double, y0 double, x1 double, y1 double, confidence double"


def _iou(a, b):
    inter = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return 0.0 if union <= 0 else inter / union


def _scene(rng, images, n, spread):
    """Boxes of very different sizes and shapes, on both sides of zero, many repeated or nearly so."""
    gt, pred = [], []
    for image in range(images):
        for k in range(n):
            w, h = 2.0 ** int(rng.integers(-6, 9)), 2.0 ** int(rng.integers(-3, 6))
            x, y = float(rng.integers(-spread, spread)) / 2, float(rng.integers(-spread, spread)) / 2
            gt.append((image, k, f"T{k % 5}", x, y, x + w, y + h, "KEEP"))
            for copy in range(2):
                d = rng.choice([0.0, 0.125, 0.25], 4).tolist()
                pred.append((image, 2 * k + copy, f"T{k % 3}", x + d[0] * w, y + d[1] * h, x + w + d[2] * w, y + h + d[3] * h, [None, 0.5][copy]))
        bad = [(0.0, 0.0, 0.0, 5.0), (5.0, 5.0, 1.0, 1.0), (0.0, 0.0, float("inf"), 1.0), (None, 0.0, 1.0, 1.0), (0.0, 0.0, 1e-300, 1e-300)]
        pred += [(image, 10**6 + k, "bad", *b, 0.1) for k, b in enumerate(bad)]
        gt += [(image, 10**6 + k, "bad", *b, "KEEP") for k, b in enumerate(bad[:4])]
    return gt, pred


def _one_by_one(gt, pred, threshold):
    out = set()
    for image in {r[0] for r in gt}:
        edges = []
        for a in (r for r in gt if r[0] == image and None not in r[3:7]):
            for b in (r for r in pred if r[0] == image and None not in r[3:7]):
                v = _iou(a[3:7], b[3:7])
                if v >= threshold:
                    edges.append((-v, a[3:7], a[2], a[7], a[1], b[3:7], b[2], b[7] is None, b[7] or 0.0, b[1]))
        gs, ws = set(), set()
        for e in sorted(edges):
            if e[4] not in gs and e[9] not in ws:
                gs.add(e[4])
                ws.add(e[9])
                out.add((image, e[4], e[9], -e[0]))
    return out


@pytest.mark.parametrize(("threshold", "few", "fold"), [(0.5, 0, 0), (0.5, 0, 10**6), (0.5, 100, 10**6), (0.1, 0, 5), (0.9, 0, 0), (1.0, 0, 5)])
def test_grid_and_rounds_equal_one_by_one(spark, monkeypatch, threshold, few, fold):
    monkeypatch.setattr(overlaps, "FEW", few)
    monkeypatch.setattr(assignment, "FOLD", fold)
    gt, pred = _scene(np.random.default_rng(5), 3, 70, 40)
    a, b, want = spark.createDataFrame(gt, GT), spark.createDataFrame(pred, PRED), _one_by_one(gt, pred, threshold)
    for got in (matching.greedy(matching.candidates(a, b, threshold)), matching.match(a, b, threshold)):
        assert {tuple(r) for r in got.select("image_id", "g", "w", "iou").collect()} == want


def test_work_of_a_crowded_image_follows_its_neighbours(spark):
    """20,000 boxes of one image, each near two words: not 800 million pairs, and no task with all of them."""
    k = F.col("id")
    box = lambda dx: [(k % 200 * 30 + dx).cast("double").alias("x0"), (k / 200).cast("int").cast("double").alias("y0") * 14, (k % 200 * 30 + dx + 24).cast("double").alias("x1")]
    rows = lambda dx: spark.range(20_000).select(F.lit(1).cast("long").alias("image_id"), k, *(c.alias(n) for c, n in zip(box(dx), ("x0", "y0", "x1"), strict=True))).withColumn("y1", F.col("y0") + 10)
    gt = rows(0).select("image_id", F.col("id").alias("g"), F.lit("T").alias("token_text"), "x0", "y0", "x1", "y1", F.lit("KEEP").alias("label"))
    pred = rows(1).unionByName(rows(3)).select("image_id", F.expr("id * 2 + int(x0 % 30 = 3)").alias("w"), F.lit("T").alias("text"), "x0", "y0", "x1", "y1", F.lit(0.5).alias("confidence"))
    met = overlaps.tile_pairs(gt, pred, 0.5)
    assert met.count() < 60 * 20_000
    largest = overlaps.dealt(gt, 0.5).groupBy("tile").count().agg(F.max("count"), F.count("*")).first()
    assert largest[0] <= 100 and largest[1] > 1000
    got = matching.match(gt, pred)
    assert got.count() == 20_000 and got.where("w <> g * 2").count() == 0


def test_self_agreement_equals_list_order(spark, monkeypatch):
    rng = np.random.default_rng(9)
    gt, pred = _scene(rng, 2, 40, 25)
    first = [(i, g, t, "KEEP", *box) for i, g, t, *box, _ in gt]
    second = [(i, w, t, ["KEEP", "PHI"][w % 2], *box, "accepted") for i, w, t, *box, _ in pred]
    first += [(7, None, None, None, None, None, None, None), (8, 1, "a", "PHI", 0.0, 0.0, 4.0, 4.0)]
    second += [(7, 3, "a", "PHI", 0.0, 0.0, 4.0, 4.0, None), (8, 1, "a", "PHI", 0.0, 0.0, 4.0, 4.0, "deferred"), (9, 1, "a", "PHI", 0.0, 0.0, 4.0, 4.0, "accepted")]
    want = {(7, False, 0, 0, 0, 0, 1), (8, True, 0, 0, 0, 0, 0)}
    for image in (0, 1):
        left = [r for r in second if r[0] == image]
        n, texts, labels = 0, 0, 0
        for a in sorted(r for r in first if r[0] == image):
            best = max(((_iou(a[4:8], b[4:8]), b[1], b) for b in left if None not in (*a[4:8], *b[4:8]) and _iou(a[4:8], b[4:8]) >= 0.5), default=None)
            if best:
                left.remove(best[2])
                n, texts, labels = n + 1, texts + (best[2][2] != a[2]), labels + (best[2][3] != a[3])
        want.add((image, False, n, texts, labels, sum(r[0] == image for r in first) - n, sum(r[0] == image for r in second) - n))
    columns = "image_id long, g long, text string, label string, x0 double, y0 double, x1 double, y1 double"
    for few in (0, 64):
        monkeypatch.setattr(overlaps, "FEW", few)
        got = review.self_agreement(spark.createDataFrame(first, columns), spark.createDataFrame(second, columns + ", state string"))
        assert {tuple(r) for r in got.collect()} == want


def _table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_both_distances_equal_the_whole_table():
    rng = random.Random(3)
    for _ in range(400):
        a = "".join(rng.choice("abé𝒳"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 25)):
            b[(k := rng.randint(0, len(b))) : k + rng.randint(0, 2)] = rng.choices("abé𝒳", k=rng.randint(0, 2))
        b, want = "".join(b), _table(a, b)
        x, y = edits._code_points(a), edits._code_points(b)
        assert edits.near_distance(x, y, 70) == want and edits.far_distance(a, b) == want and edits.distance(x, y) == want
        assert want == 0 or edits.near_distance(x, y, want - 1) is None


def test_long_texts_and_many_words(spark):
    words = [f"w{k}" for k in range(40_000)]
    other = [w for k, w in enumerate(words) if k % 4_000] + ["end"]
    long = "ab" * 200_000
    df = spark.createDataFrame([(words, other, long, "x" + long[:-3] + "yy"), (["a"], ["b", "a"], "größe", "grösse"), (None, ["a"], None, "a")], "r array<string>, h array<string>, a string, b string")
    assert [tuple(r) for r in df.select(edits.word_edits(F.col("r"), F.col("h")), edits.text_edits(F.col("a"), F.col("b"))).collect()] == [(11, 4), (1, 2), (None, None)]
    far = random.Random(1)
    a, b = ("".join(far.choices("abcdefgh", k=3_000)) for _ in range(2))
    assert edits.distance(edits._code_points(a), edits._code_points(b)) == _table(a, b)
