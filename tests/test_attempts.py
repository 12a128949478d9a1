"""Attempts as a stream against a fold over all of them, in batches, in any order and after a stop in mid-batch."""

import random

import pytest

from glyphmark.streaming import attempts

SCHEMA = "item string, seq long, provenance string, error string"


def _fold(rows):
    known = {}
    for item, seq, provenance, error in sorted(rows, key=lambda r: r[1]):
        k = known.setdefault(item, [0, 0, None, None, None, None])
        k[0] += 1
        if error is None:
            k[2:4] = provenance, seq
        else:
            k[1] += 1
            k[4:6] = error, seq
    return {(i, *k) for i, k in known.items()}


def _rows(n, seed):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.4 else f"i{rng.randint(0, 20)}", k, rng.choice(["v1", "v2", None]), rng.choice([None, None, "late", "lost"])) for k in range(n)]
    rng.shuffle(rows)
    return [*rows, (None, n, "v1", None)]


def _known(spark, folder):
    return {tuple(r) for r in attempts.latest(spark, folder, "item", "string").collect()}


def test_batches_in_any_order_and_a_stop_in_mid_batch(spark, tmp_path):
    source, folder, rows = str(tmp_path / "in"), str(tmp_path / "state"), _rows(300, 1)
    assert _known(spark, folder) == set()

    def stop(number):
        if number == 1 and not stopped:
            stopped.append(number)
            raise RuntimeError("stopped in mid-batch")

    stopped = []
    for k, part in enumerate((rows[:100], rows[100:180], rows[180:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = lambda: spark.readStream.schema(SCHEMA).parquet(source)
        if k == 1:
            with pytest.raises(Exception, match="stopped in mid-batch"):
                attempts.track(stream(), folder, before_commit=stop).awaitTermination()
            assert stopped == [1]
        attempts.track(stream(), folder, before_commit=stop).awaitTermination()
    assert _known(spark, folder) == _fold(rows)


def test_pending_and_mixed(spark):
    known = spark.createDataFrame([("a", 1, 0, "v1", 1, None, None), ("b", 2, 2, None, None, "E", 3), ("c", 1, 0, "v2", 4, None, None), ("d", 1, 0, None, 5, None, None)], f"item string, {attempts.STATE}")
    wanted = spark.createDataFrame([(i, "v1") for i in "abcde"], "item string, provenance string")
    assert sorted(r.item for r in attempts.pending(wanted, known).collect()) == ["b", "e"]
    assert sorted(r.item for r in attempts.pending(wanted, known, overwrite=True).collect()) == ["b", "c", "d", "e"]
    assert sorted((r.item, r.wanted, r.found) for r in attempts.mixed(wanted, known).collect()) == [("c", "v1", "v2"), ("d", "v1", None)]
