"""The runs of line dedup: settled lines stay out of later runs, and compaction keeps counts and keepers."""

import random

from glyphmark.llm import linededup


def test_settled_lines_enter_no_later_run(spark, tmp_path):
    rng = random.Random(2)
    runs = linededup.LineRuns(spark, str(tmp_path), 4, 5)
    want: dict = {}
    for b in range(7):
        rows = [(1000 - 100 * b - k, rng.choice([1, 1, 1, 2, 3, rng.randrange(4, 60)]), 7) for k in range(80)]
        for doc, h, _ in rows:
            want.setdefault(h, set()).add(doc)
        runs.ingest(spark.createDataFrame(rows, "doc long, h1 long, h2 long"))
        if b and runs.levels[0]:
            assert spark.table(runs.levels[0][-1]).where("h1 = 1").count() == 0
    got = {r.h1: r for r in runs.folded().collect()}
    assert {h: r.last_doc for h, r in got.items()} == {h: max(d) for h, d in want.items()}
    assert all((got[h].n_docs >= 5) == (len(d) >= 5) for h, d in want.items())
    assert got[1].n_docs < len(want[1]), "a settled line is counted no further"
    assert len(runs.levels) > 1 and len(runs.levels[0]) == 1
    runs.clear()
    assert not list(tmp_path.glob("line_run_*"))


def test_a_run_is_read_back_without_an_exchange(spark, tmp_path):
    runs = linededup.LineRuns(spark, str(tmp_path), 4, 1)
    for b in range(2):
        runs.ingest(spark.createDataFrame([(100 - 10 * b - k, k, 0) for k in range(9)], "doc long, h1 long, h2 long"))
    plan = runs.folded()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    runs.clear()
