"""Scores from boards: the same as from matched tokens, in the crowd and outside, with the lines dealt by image once."""

import random

from glyphmark.operators import overlaps, scoring
from glyphmark.plans import registry  # noqa: F401  isort: skip
from glyphmark.plans import evaluation

SF = "/root/testdata/sf0.001"
GT = "image_id long, g long, token_text string, x0 double, y0 double, x1 double, y1 double, label string"
PRED = "image_id long, w long, text string, x0 double, y0 double, x1 double, y1 double, confidence double"


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: r["image_id"])


def test_boards_count_as_matched_tokens_do(spark):
    draw = random.Random(5)
    texts = ["A", "B b", "é", "é", " A ", "", None, "long text " * 50]

    def box():
        x, y = draw.randrange(2) * 5.0, draw.randrange(3) * 10.0
        return (x, y, x + draw.choice([0.0, 8.0, 9.0]), y + 9.0) if draw.random() < 0.9 else (None,) * 4

    gt = spark.createDataFrame([(k, g, draw.choice(texts), *box(), draw.choice(["KEEP", "KEEP", "PHI", None])) for k in range(80) if k % 5 for g in range(draw.randrange(4, 12))], GT)
    pred = spark.createDataFrame([(k, w, draw.choice(texts), *box(), draw.choice([0.5, None])) for k in range(80) if k % 7 for w in range(draw.randrange(4, 12))], PRED)
    allowed = spark.createDataFrame([("A",), ("é",), ("B b ",)], "token_text string")
    for listed in (None, allowed):
        want = rows_of(scoring.image_counts(scoring.matched_tokens(gt, pred, listed), pred).na.fill(0, scoring.COUNTS))
        got = rows_of(scoring.board_counts(scoring.boards(gt, pred), None if listed is None else scoring.unlisted(gt, listed)))
        assert got == want and sum(r["found_count"] for r in got) > 30 and any(r["wer"] for r in got)


def test_crowded_images_score_alike(spark, monkeypatch):
    want = rows_of(evaluation.scores(spark, SF))
    monkeypatch.setattr(overlaps, "FEW", 4)
    assert rows_of(evaluation.scores(spark, SF)) == want


def test_lines_are_dealt_by_image_once(spark):
    """Each window over the lines was a shuffle of them, and so was the join by image and token."""
    plan = evaluation.scores(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [row_number()") == 1
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1
    assert ", g#" not in "".join(line for line in plan.split("\n") if "Exchange hashpartitioning(image_id" in line)
