"""Hand-computed cases, order independence and empty input for the evaluation engine."""

import statistics

import pytest
from pyspark.sql import functions as F

from glyphmark.functions import cost, text
from glyphmark.operators import constraints, matching, rollup, scoring, selection

GT = "image_id long, g long, token_text string, x0 double, y0 double, x1 double, y1 double, label string, part long"
PRED = "image_id long, w long, text string, x0 double, y0 double, x1 double, y1 double, confidence double"


def scene(spark):
    gt = [(1, 1, "A", 0.0, 0.0, 10.0, 10.0, "KEEP", 1), (1, 2, "B", 20.0, 0.0, 30.0, 10.0, "KEEP", 1), (1, 3, "C", 40.0, 0.0, 50.0, 10.0, "PHI", 1)]
    pred = [(1, 1, "A", 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, "A", 1.0, 0.0, 11.0, 10.0, None), (1, 3, "X", 20.0, 0.0, 30.0, 10.0, 0.5), (1, 4, "none", None, None, None, None, 0.5), (2, 1, "Z", 0.0, 0.0, 5.0, 5.0, 0.1)]
    return spark.createDataFrame(gt, GT), spark.createDataFrame(pred, PRED)


def test_greedy_takes_best_and_anti_joins_follow(spark):
    gt, pred = scene(spark)
    m = matching.greedy(matching.candidates(gt, pred))
    assert sorted((r.g, r.w, r.iou) for r in m.collect()) == [(1, 1, 1.0), (2, 3, 1.0)]
    assert [r.g for r in matching.omissions(gt, m).collect()] == [3]
    assert sorted((r.image_id, r.w) for r in matching.hallucinations(pred, m).collect()) == [(1, 2), (1, 4), (2, 1)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_order_of_rows_does_not_matter(spark, seed):
    gt, pred = scene(spark)
    m = matching.greedy(matching.candidates(gt.orderBy(F.rand(seed)).repartition(seed), pred.orderBy(F.rand(seed))))
    assert sorted((r.g, r.w) for r in m.collect()) == [(1, 1), (2, 3)]


def test_scores_and_blank_control(spark):
    gt, pred = scene(spark)
    images = spark.createDataFrame([(1, "s"), (2, "s"), (3, None)], "image_id long, stratum string")
    rows = {r.image_id: r for r in scoring.image_scores(images, scoring.matched_tokens(gt, pred), pred).collect()}
    assert (rows[1].keep_total, rows[1].keep_exact_match_count, rows[1].false_redaction_count, rows[1].added_count) == (2, 1, 1, 2)
    assert rows[2].negative_control and rows[2].floor_count == 1
    assert rows[3].negative_control and rows[3].floor_count == 0


def test_empty_input_gives_zero_counts_and_null_rates(spark):
    gt, pred = scene(spark)
    images = spark.createDataFrame([], "image_id long, stratum string, elapsed double")
    s = scoring.image_scores(images, scoring.matched_tokens(gt.limit(0), pred.limit(0)), pred.limit(0))
    assert rollup.run_summary(s).where("grp = 'ALL'").select("n_images", "false_redaction_rate").collect()[0][:] == (0, None)


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0, 10.0], [float(k) for k in range(1, 31)]])
def test_p95_is_exclusive(spark, values):
    df = spark.createDataFrame([(values,)], "v array<double>")
    want = values[0] if len(values) == 1 else statistics.quantiles(values, n=100, method="exclusive")[94]
    assert df.select(rollup.p95_exclusive(F.col("v"))).first()[0] == want


@pytest.mark.parametrize("size", [1, 2, 7, 40, 2000, 2001, 30000])
def test_quantiles_are_exact_at_every_size(spark, size):
    """Ties, outliers, nulls, a null group and a group called ALL; sizes on both sides of the sketched bounds."""
    rows = [(["a", None, "ALL"][k % 3], None if k % 11 == 5 else 1e9 if k % 13 == 0 else float((k * 7919) % 997) if k % 2 else k / 64) for k in range(size)]
    got = {(r["__total"], r["__key"]): (r["median"], r["p95"]) for r in rollup.quantiles(spark.createDataFrame(rows, "s string, v double"), "s", "v").collect()}
    want = {}
    for total, key in [(True, None), (False, "a"), (False, None), (False, "ALL")]:
        v = [x for s, x in rows if x is not None and (total or s == key)]
        if v:
            want[total, key] = (statistics.median(v), v[0] if len(v) == 1 else statistics.quantiles(v, n=100, method="exclusive")[94])
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_text_functions(spark):
    df = spark.createDataFrame([("  éa ", "a b c", "a x c d")], "n string, r string, h string")
    row = df.select(text.normalize(F.col("n")), text.wer(F.col("r"), F.col("h")), text.cer(F.col("r"), F.col("h"))).first()
    assert row[0] == "éa" and row[1] == pytest.approx(2 / 3) and row[2] == pytest.approx(3 / 5)


def test_whole_texts_are_scored(spark, tmp_path):
    import __spark_entry__ as entry

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    texts = {k: f"{k} " + " ".join(["größe", "Ελένη", "été", "plain", "日本語", "е𝒳e"][(k + j) % 6] for j in range(60)) for k in range(10)} | {10: None, 11: ""}
    spark.createDataFrame(list(texts.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    hyps = {k: [t, "x" + t[1:], t[: len(t) * 3 // 4], "", t.replace("e", "o")][k % 5].strip() for k, t in texts.items() if t}
    cer = {k: edits(texts[k], h) / len(texts[k]) for k, h in hyps.items()}
    wer = {k: edits(texts[k].split(), h.split()) / len(texts[k].split()) for k, h in hyps.items()}
    q = entry.queries()
    assert {r.item_id: r.cer for r in q["cer"](spark, str(tmp_path)).collect()} == pytest.approx(cer | {10: None, 11: None})
    assert {r.item_id: r.wer for r in q["wer"](spark, str(tmp_path)).collect()} == pytest.approx(wer | {10: None, 11: None})
    got = {r.half: (r.n, r.n_read, r.cer_macro) for r in q["diagnostic_rollup"](spark, str(tmp_path)).collect()}
    for half in (0, 1):
        read = [cer[k] for k, h in hyps.items() if h and k % 2 == half]
        assert got[half] == (sum(k % 2 == half for k in texts), len(read), pytest.approx(statistics.mean(read), abs=1e-8))


def test_costs(spark):
    df = spark.createDataFrame([("claude", 1000, 800), ("gpt4o", 1024, 1024), ("gemini", 384, 384), ("gemini", 769, 10), ("cloud", 5, 5), (None, 5, 5)], "rule string, w int, h int")
    assert [r[0] for r in df.select(cost.units(F.col("rule"), F.col("w"), F.col("h"))).collect()] == [1067, 765, 303, 561, 1, 0]


@pytest.mark.parametrize(("raw", "code"), [("3", None), ("0", None), ("03", "FRAME_NOT_INT"), ("+3", "FRAME_NOT_INT"), (" 3", "FRAME_NOT_INT"), ("-3", "FRAME_NEGATIVE")])
def test_frame_codes(spark, raw, code):
    assert spark.createDataFrame([(raw,)], "c string").select(constraints.frame_code(F.col("c"))).first()[0] == code


@pytest.mark.parametrize(("raw", "code"), [("1.5", None), ("1_0", None), (" 1 ", None), ("inf", "COORD_NOT_FINITE"), ("nan", "COORD_NOT_FINITE"), ("x", "COORD_NOT_NUMBER"), ("-1", "COORD_NEGATIVE")])
def test_coordinate_codes(spark, raw, code):
    assert spark.createDataFrame([(raw,)], "c string").select(constraints.coordinate_code(F.col("c"))).first()[0] == code


def test_winner_must_beat_stock_and_ties_keep_grid_order(spark):
    t = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.4), ("a", 2, 0.4), ("b", 0, 0.5), ("b", 1, 0.5), ("c", 0, None), ("c", 1, 0.1)], "engine string, trial_no int, fr double")
    none = spark.createDataFrame([], "engine string, trial_no int")
    assert [(r.engine, r.trial_no) for r in selection.winners(t, none, "fr", False).collect()] == [("a", 1)]


def test_registry_names_and_columns(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
