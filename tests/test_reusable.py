"""Operators of manifests, reconciliation, review, experiments, reading and scans on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from glyphmark.operators import constraints, experiments, manifests, ocrseeds, reading, reconcile, review, rollup, selection
from glyphmark.plans import documents
from glyphmark.sources import refscans


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_views_are_whitelisted(spark):
    df = spark.createDataFrame([("a", "x", "secret")], "series_uid string, strata string, name string")
    out = manifests.project(df, {"series_uid": "series_uid", "strata": "stratum"})
    assert out.columns == ["series_uid", "stratum"]
    with pytest.raises(ValueError, match="lacks"):
        manifests.project(df, {"modality": "modality"})
    with pytest.raises(ValueError, match="whitelist"):
        manifests.guard_view(df, ("series_uid",))
    with pytest.raises(ValueError, match="repeats"):
        manifests.guard_view(out.unionByName(out), ("series_uid", "stratum"), "series_uid")
    assert manifests.guard_view(out, ("series_uid", "stratum"), "series_uid") is out


def test_empty_manifest_breaks_no_rule(spark):
    df = spark.createDataFrame([], "series_uid string, modality string, stratum string, vendor string, frame_idx string")
    assert all(r.n == 0 for r in manifests.violations(df).collect())
    assert rows_of(manifests.frame_summary(df.select(F.col("frame_idx").cast("int").alias("frame_idx")))) == [(0, 0, 0.0, 0.0)]
    assert manifests.id_collisions(spark.createDataFrame([], "id string, source long")).count() == 0


def test_provenance_and_sets(spark):
    df = spark.createDataFrame([(1, {"engine": "e", "version": " "}), (2, {"engine": "e", "version": "v"}), (3, None)], "image_id long, provenance map<string,string>")
    assert rows_of(reconcile.provenance_missing(df, ("engine", "version"))) == [(1, ["version"]), (3, ["engine", "version"])]
    sets = spark.createDataFrame([(1, 0, "a", "e"), (1, 1, "a", "e"), (2, 1, "a", "e"), (3, 0, "a", "e"), (3, 1, "a", None), (4, 0, None, None), (4, 1, None, None)], "id long, set_no int, sha256 string, engine string")
    assert rows_of(reconcile.union_of_sets(sets, ("engine",))) == [(1, 0, False), (2, 1, False), (3, 0, True), (4, 0, False)]


def test_seed_diff_tells_hidden_from_deleted(spark):
    box = (0.0, 0.0, 1.0, 1.0)
    seeds = spark.createDataFrame([(1, k, f"t{k}", *box, c, 0.5) for k, c in enumerate([0.9, 0.1, -1.0, None, 0.4])], "image_id long, seed_index long, text string, x0 double, y0 double, x1 double, y1 double, confidence double, gate double")
    record = spark.createDataFrame([(1, 2, "t2", *box), (1, 4, "other", *box), (1, 9, "new", *box)], "image_id long, seed_index long, text string, x0 double, y0 double, x1 double, y1 double")
    got = {r.seed_index: r.change for r in review.seed_diff(seeds, record).collect()}
    assert got == {0: "deleted", 1: "hidden", 2: "unchanged", 3: "deleted", 4: "text_fixed", 9: "added"}


def test_self_agreement_takes_the_later_of_equal_overlaps(spark):
    schema = "image_id long, g long, text string, label string, x0 double, y0 double, x1 double, y1 double"
    first = spark.createDataFrame([(1, 1, "a", "KEEP", 0.0, 0.0, 10.0, 10.0), (1, 2, "b", "PHI", 50.0, 0.0, 60.0, 10.0), (2, 1, "c", "KEEP", 0.0, 0.0, 1.0, 1.0), (3, 1, "d", "KEEP", 0.0, 0.0, 1.0, 1.0)], schema)
    second = spark.createDataFrame([(1, 1, "a", "KEEP", 0.0, 0.0, 10.0, 10.0, "accepted"), (1, 2, "x", "PHI", 0.0, 0.0, 10.0, 10.0, "accepted"), (2, None, None, None, None, None, None, None, "deferred")], schema + ", state string")
    assert rows_of(review.self_agreement(first, second)) == [(1, False, 1, 1, 1, 1, 1), (2, True, 0, 0, 0, 0, 0)]
    assert rows_of(review.agreement_totals(review.self_agreement(first, second))) == [(1, 1, 1, 1, 1, 1, 1)]
    assert rows_of(review.agreement_totals(review.self_agreement(first.limit(0), second)))[0][2] is None


def test_top_keys_by_code(spark):
    found = spark.range(0, 5000).select((F.col("id") % 2).cast("string").alias("code"), F.format_string("k%05d", F.col("id") % 3000).alias("key"))
    got = {r.code: (r.n, r.first, r.more) for r in constraints.by_code(found, "key", 3).collect()}
    assert got["0"] == (2500, ["k00000", "k00002", "k00004"], 2497) and got["1"][1] == ["k00001", "k00003", "k00005"]
    plan = constraints.by_code(found, "key")._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_arms_and_grids(spark):
    kept, counts = experiments.grid(spark, 4)
    assert rows_of(counts) == [("doctr", 4, 1), ("easyocr", 2, 0), ("pp-ocrv6_medium", 4, 2)]
    assert kept.where("trial_no = 0 AND engine = 'doctr'").first().config == "{}"
    assert experiments.arm("doctr:stock", {}) == {} and experiments.arm("easyocr:tuned", {})["low_text"] == 0.2
    assert experiments.arm("doctr:tuned", {"doctr": {"bin_thresh": 0.3}}) == {"bin_thresh": 0.3}
    with pytest.raises(LookupError, match="no frozen"):
        experiments.arm("doctr:tuned", {})
    with pytest.raises(ValueError, match="unknown arm"):
        experiments.arm("doctr:other", {})


def test_shards_that_disagree_are_refused(spark):
    schema = "shard string, engine string, gt_name string, gt_hash string, n_images int"
    sound = spark.createDataFrame([("s1", "a", "dev", "h", 22), ("s2", "b", "dev", "h", 22)], schema)
    assert experiments.merge_shards(sound).count() == 2
    for bad in (("s3", "a", "dev", "h", 22), ("s3", "c", "dev", "h", 23)):
        with pytest.raises(ValueError, match="can't be merged"):
            experiments.merge_shards(sound.unionByName(spark.createDataFrame([bad], schema)))


def test_run_ledger(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "a int")
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    with experiments.RunLedger(spark, good) as run:
        run.add("t", rows)
        assert json.loads((tmp_path / "good/run_status.json").read_text())["status"] == "RUNNING"
        assert not (tmp_path / "good/tables").exists()
    assert spark.read.parquet(f"{good}/tables/t").count() == 1
    with pytest.raises(RuntimeError), experiments.RunLedger(spark, bad) as run:
        run.add("t", rows)
        raise RuntimeError("stop")
    assert not (tmp_path / "bad/tables").exists() and not (tmp_path / "bad/_pending").exists()
    told = json.loads((tmp_path / "bad/run_status.json").read_text())
    assert (told["done"], told["failure"]) == (["t"], "RuntimeError")
    with pytest.raises(ValueError, match="without a result: u"), experiments.RunLedger(spark, str(tmp_path / "short"), ("t", "u")) as run:
        run.add("t", rows)
    told = json.loads((tmp_path / "short/run_status.json").read_text())
    assert (told["status"], told["tables"], told["done"], told["pending"]) == ("INCOMPLETE", [], ["t"], ["u"]) and not (tmp_path / "short/tables").exists()
    with pytest.raises(FileExistsError):
        experiments.RunLedger(spark, good)
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd/run_status.json").write_text("{")
    got = {r.folder.rsplit("/", 1)[1]: (r.status, r.tables) for r in experiments.collate(spark, [good, bad, str(tmp_path / "odd"), str(tmp_path / "none")]).collect()}
    assert got == {"good": ("COMPLETE", ["t"]), "bad": ("INCOMPLETE", []), "odd": ("UNREADABLE", []), "none": ("EMPTY", [])}


def test_readers(spark):
    class Upper:
        model_name, version, config_id = "m", "1", "stock"

        def __init__(self, say=str.upper):
            self.say = say

        def read(self, crop):
            return self.say(crop["pixels"])

        def config(self):
            return {"a": 1}

    crops = spark.createDataFrame([(1, "ab"), (2, "")], "crop_id long, pixels string")
    got = reading.read_crops(crops, Upper).collect()
    assert sorted((r.crop_id, r.read, r.model_name) for r in got) == [(1, "AB", "m"), (2, "", "m")] and len(got[0].config_hash) == 12
    with pytest.raises(Exception, match="must return a string"):
        reading.read_crops(crops, lambda: Upper(len)).collect()
    nameless = Upper()
    nameless.version = " "
    with pytest.raises(ValueError, match="version"):
        reading.identity(nameless)
    assert rows_of(reading.floor(spark.createDataFrame([], "image_id long, invented boolean"))) == [(0, 0, None, None)]


def test_confidence_statistics_of_nothing(spark):
    none = spark.createDataFrame([], "confidence double")
    assert rows_of(ocrseeds.confidence_stats(none)) == [(0, None, None, None)]
    assert {r.n for r in ocrseeds.confidence_histogram(none).collect()} == {0}


def test_freeze_keeps_the_fixed_pair(spark):
    trials = spark.createDataFrame([("a", 0), ("e", 0)], "engine string, trial_no long")
    frozen = spark.createDataFrame([("a", 3), ("e", 1), ("z", 2)], "engine string, trial_no long")
    assert rows_of(selection.freeze(frozen, trials, trials.where("engine = 'e'"), "e")) == [("e", 1), ("z", 2)]


def test_scans(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    good = file("m.csv", 'series_uid,modality,strata,manufacturer,middle_frame_index,institution_name\ns1,CT,a,"v, w",3,private\ns2,CT,b,v,4,private\n')
    assert rows_of(refscans.load_manifest(spark, good)) == [("s1", "CT", "a", "v, w", 3), ("s2", "CT", "b", "v", 4)]
    bad = file("b.csv", "series_uid,modality,strata,manufacturer,middle_frame_index\ns1,CT,a,v,1.5\ns1, ,a,v,2\n")
    with pytest.raises(ValueError, match="CATEGORY_BLANK modality x 1, FRAME_NOT_INTEGRAL frame_idx x 1, KEY_DUPLICATE series_uid x 1"):
        refscans.load_manifest(spark, bad)
    render = file("r.csv", "image_id,frame_idx,w,h,sha256,fallback_used\ni1,0,5,5,old,0\ni2,0,5,5,x,0\ni1,0,5,5,new,0\n")
    assert [r.sha256 for r in refscans.render_manifest(spark, render).orderBy("image_id").collect()] == ["new", "x"]
    with pytest.raises(ValueError, match="header"):
        refscans.render_manifest(spark, good)
    back = file("k.csv", "image_id,series_uid,sop_instance_uid,src_frame_idx,id_len\ni1,s1,p,0,8\ni1,s2,p,0,8\n")
    with pytest.raises(ValueError, match="more than one series"):
        refscans.backmap(spark, back)
    seen = file("t.csv", "# who saw it\nimage_id,has_text\ni1, 0 \n# note\ni2,1\ni3,\n")
    assert rows_of(refscans.blank_images(spark, seen)) == [("i1",)]
    one, two = file("x1.csv", "series_uid\n s1 \n\n"), file("x2.csv", "note,series_uid\nn,s1\nn,s2\n")
    assert rows_of(refscans.exclusions(spark, [one, two])) == [("s1",), ("s2",)]
    boxes = file("g.csv", "image_id,token_text,stratum,x0,y0,x1,y1\ni1,secret,a,1,2,3,4\n")
    out = refscans.geometry(spark, boxes)
    assert rows_of(out) == [("i1", "a", 1.0, 2.0, 3.0, 4.0)]


def test_run_report_has_its_blocks_and_notes(spark):
    scores = spark.createDataFrame([(1, "s", 1, 0, 1, 1, 0, 1, 0, 0, False, True, 0.5, 0.25, 0.5, None, 3, 0, False, 0.5)], "image_id long, stratum string, keep_total long, false_redaction_count long, keep_exact_match_count long, found_count long, omission_count long, gt_total long, added_count long, floor_count long, negative_control boolean, keep_exact_match_all boolean, elapsed double, cost double, cer double, wer double, keep_chars_total long, keep_chars_censored long, box_free boolean, iou_thr double")
    summary = rollup.run_summary(scores)
    text = documents.run_report("Run", {"engine": "e"}, summary, rollup.detection_view(scores))
    for part in ("## Headline", "## Found vs Added", "## Per-stratum breakout", "## Latency & cost", "## Negative-control floor", "## Detector-only view", "## Diagnostic appendix", "Never a ranking signal.", "100.00%", "$0.250000"):
        assert part in text
    row = summary.where("grp = 'ALL'").first()
    assert (row.cost_sum, row.cer_mean, row.wer_mean, row.n_cer_images, row.char_censor_rate) == (0.25, 0.5, None, 1, 0.0)
    assert "VOID" in documents.ground_truth_facts("b", "a") and "VOID" not in documents.ground_truth_facts("a", "a")


def test_a_failed_rename_leaves_an_incomplete_run(spark, tmp_path, monkeypatch):
    def fail(*_):
        raise OSError("no rename")

    folder = tmp_path / "run"
    with pytest.raises(OSError, match="no rename"), experiments.RunLedger(spark, str(folder)) as run:
        run.add("t", spark.range(1))
        monkeypatch.setattr(experiments.paths, "move", fail)
    assert json.loads((folder / "run_status.json").read_text())["status"] == "INCOMPLETE" and not (folder / "_pending").exists()
