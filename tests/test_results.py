"""Names, fallbacks of heights, and documents that carry their caveats."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from glyphmark.functions import ids, text
from glyphmark.operators import experiments, heights, results


def test_names(spark):
    df = spark.createDataFrame([("UID1", 23, "e:tuned", 0.2, 0.2, 0.4), ("UID12", 3, "plain", 0.7, 0.4, 0.4), (None, 3, "a:b:c", 0.7, 0.4, 0.3), ("u", None, None, None, 0.4, 0.4)], "uid string, frame int, arm string, a double, b double, c double")
    engine, variant = ids.arm_parts(F.col("arm"))
    rows = df.select(ids.image_id(F.col("uid"), F.col("frame")), engine, variant, ids.config_label(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert [r[0] for r in rows] == [hashlib.sha256(b"UID1|23").hexdigest()[:8], hashlib.sha256(b"UID12|3").hexdigest()[:8], None, None]
    assert [r[1:3] for r in rows] == [("e", "tuned"), ("plain", ""), ("a", "b:c"), (None, None)]
    assert [r[3] for r in rows] == ["thr0.2", "stock", "tuned", "tuned"]


def test_heights_fall_back(spark):
    tokens = spark.createDataFrame([("a", 0.0, 4.0), ("a", 0.0, 6.0), ("z", 1.0, 1.0), ("b", 0.0, 20.0), (None, 0.0, 9.0)], "stratum string, y0 double, y1 double")
    images = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z"), (4, "new"), (5, None)], "image_id long, stratum string")
    assert {r.image_id: r.box_height for r in heights.control_heights(images, tokens).collect()} == {1: 5.0, 2: 20.0, 3: 6.0, 4: 6.0, 5: 6.0}
    assert {r.box_height for r in heights.control_heights(images, tokens.limit(0)).collect()} == {None}


def test_nearest_rank(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in range(1, 11)] + [("b", 0.25), ("b", 0.35), ("c", None)], "s string, v double")
    got = {r.s: tuple(r)[1:] for r in heights.nearest_rank(rows, "s", F.col("v"), {"p50": 0.5, "p90": 0.9}).collect()}
    assert got == {"a": (5.0, 9.0), "b": (0.2, 0.3), "c": (0.0, 0.0)}


def test_rounding_is_of_the_binary_value(spark):
    rng = random.Random(6)
    values = [0.35, 0.25, 0.75, 2.675, -0.25, -0.35, 1e15 + 0.5, 0.0] + [rng.randint(-4000, 4000) / rng.choice([8, 16, 20, 200]) for _ in range(500)] + [rng.uniform(-100, 100) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    assert [tuple(r) for r in df.select(text.rounded(F.col("v"), 1), text.rounded(F.col("v"), 2)).collect()] == [(round(v, 1), round(v, 2)) for v in values]


def test_reader_document_carries_its_caveats(spark, tmp_path):
    path = tmp_path / "reader.json"
    summary = spark.createDataFrame([("ALL", 10, 0.5), ("ct", 4, None), (None, 1, None)], "grp string, found_count long, rate double")
    told = results.reader_document(summary, str(path))
    assert json.loads(path.read_text()) == told and told["oracle_detector"] is True and told["iou_thr"] is None
    assert told["found_count"] == 10 and told["groups"] == {"ct": {"found_count": 4, "rate": None}, "(none)": {"found_count": 1, "rate": None}}
    assert "no detector ran" in told["detection_metrics"] and told["crop_preprocessing"]["height"] == 48


def test_frozen_document_merges(spark, tmp_path):
    path = tmp_path / "frozen.json"
    path.write_text(json.dumps({"engines": {"lost": {"config": {}}, "other": {"config": {"k": 1}}, "pair": {"config": {"p": 2}}}, "selected_offline_from": ["old"]}))
    trials = spark.createDataFrame([(e, k, json.dumps({"t": k}), f"h{k}", "1.0") for e in ("won", "lost", "pair") for k in range(3)], "engine string, trial_no long, config string, config_hash string, version string")
    winners = spark.createDataFrame([("won", 2), ("pair", 1)], "engine string, trial_no long")
    told = results.frozen_document(winners, trials, {"csv": "dev.csv", "n_images": 22}, "rate", str(path), "pair", 0.01)
    assert json.loads(path.read_text()) == told and set(told["engines"]) == {"won", "other", "pair"} and "selected_offline_from" not in told
    assert told["engines"]["won"] == {"config": {"t": 2}, "config_hash": "h2", "engine_version": "1.0", "sweep_size": 3, "rank_metric": "rate", "max_stratum_regression": 0.01}
    assert told["engines"]["pair"] == {"config": {"p": 2}} and told["dev_set"]["n_images"] == 22
    assert results.frozen_document(winners, trials, {}, "rate", str(path), sources=["s1"])["selected_offline_from"] == ["s1"]


def test_banner_and_scope(spark):
    now = {"gt sha256": "a", "set sha256": "b"}
    assert results.ground_truth_banner("gt", now, {}) == results.ground_truth_banner("gt", now, now) == ["gt sha256 a", "set sha256 b"]
    assert results.ground_truth_banner("gt", now, {"gt sha256": "a", "set sha256": "c"}) == ["VOID: every number reported against an earlier gt", "  set sha256: c -> b", "gt sha256 a", "set sha256 b"]
    tokens, scope = spark.createDataFrame([(1,), (1,), (9,)], "image_id long"), spark.createDataFrame([(1,), (2,), (2,)], "image_id long")
    assert results.scope_facts("gt", tokens, scope).first()[:] == ("gt", 2, 2, 1, 1)


def test_collated_tables_and_footnotes(spark, tmp_path):
    for name, columns in (("a", "x int"), ("b", "x int, y string")):
        with experiments.RunLedger(spark, str(tmp_path / name)) as run:
            run.add("t", spark.createDataFrame([(1,) if name == "a" else (2, "q")], columns))
    folders = [str(tmp_path / n) for n in ("a", "b", "none")]
    assert sorted((r.x, r.y, r.run.rsplit("/", 1)[1]) for r in results.collated_tables(spark, folders, "t").collect()) == [(1, None, "a"), (2, "q", "b")]
    assert results.collated_tables(spark, folders, "other") is None
    (tmp_path / "sweep.txt").write_text("best: 3\n")
    assert results.footnotes(spark, {"s": str(tmp_path / "sweep.txt"), "gone": str(tmp_path / "no.txt")})[2:5] == ["```", "best: 3", "```"]
