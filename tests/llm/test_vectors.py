"""The range join against brute force over many small cells, and how many copies clustered vectors make."""

import numpy as np

from glyphmark.llm import vectors


def _brute(x, cosine):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = y @ y.T >= cosine
    np.fill_diagonal(hit, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(hit, label[None, :], len(x)).min(axis=1))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return hit.sum(axis=1), label
        label = new


def test_many_cells_blocks_and_chunks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "cell_rows", lambda size: 20)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(25, 6))
    x = np.concatenate([centres[rng.integers(0, 25, 700)] + rng.normal(size=(700, 6)) * rng.choice([0.05, 0.4], (700, 1)), np.repeat(rng.normal(size=(1, 6)), 60, 0) + rng.normal(size=(60, 6)) * 0.01])
    x[10] = x[20]
    df = spark.createDataFrame([(k, [float(c) for c in v], "clash", 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, rep string, cell int")
    got = {r.vec_id: r for r in vectors.near_vectors(df, 0.9).collect()}
    links, label = _brute(x, 0.9)
    assert [got[k].n_links for k in range(len(x))] == links.tolist()
    assert [got[k].component_id for k in range(len(x))] == label.tolist()


def test_clustered_vectors_are_copied_linearly():
    """Far apart clusters have no visitors: each vector goes to its own block only."""
    import pyarrow as pa

    class Held:
        def __init__(self, value):
            self.value = value

    for n in (10, 40):
        pivots = np.eye(n)
        layout = vectors.Layout(pivots, np.full(n, 6000), np.full(n, 0.1), 0.45)
        rows = pivots[np.arange(1000) % n]
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(1000)), pa.array(np.ones(1000, np.int64)), pa.array((np.arange(1000) % n).astype(np.int32)), vectors._bytes(rows)], names=["rep", "n", "cell", "unit_vector"])
        visits = [b.num_rows for b in vectors._count_visits(Held(layout))(iter([batch]))]
        layout.expect(np.zeros(n))
        assert sum(visits) == 0 and sum(b.num_rows for b in vectors._deal(Held(layout))(iter([batch]))) == 1000


def test_nulls_only(spark):
    df = spark.createDataFrame([(None, None, 1), (None, None, 1), (3, None, 1)], "vec_id long, embedding array<float>, n_links int")
    assert sorted((r.vec_id is None, r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()) == [(False, 0, 3), (True, 0, None), (True, 0, None)]


def test_many_lengths_take_the_jobs_of_one(spark, monkeypatch):
    monkeypatch.setattr(vectors, "cell_rows", lambda size: 25)
    rng = np.random.default_rng(6)
    rows = []
    for size in [*range(1, 60), 300]:
        n = 120 if size in (3, 8) else 4
        centres = rng.normal(size=(6, size))
        rows += [c for c in centres[rng.integers(0, 6, n)] + rng.normal(size=(n, size)) * 0.1]
    jobs = []

    def counted(some):
        df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in some], "vec_id long, embedding array<double>")
        tracker, group = spark.sparkContext.statusTracker(), f"lengths-{len(jobs)}"
        spark.sparkContext.setJobGroup(group, group)
        got = {r.vec_id: r for r in vectors.near_vectors(df, 0.9).collect()}
        jobs.append(len(tracker.getJobIdsForGroup(group)))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return got

    got = counted(enumerate(rows))
    counted([(k, v) for k, v in enumerate(rows) if len(v) == 8])
    for size in {len(v) for v in rows}:
        ids = [k for k, v in enumerate(rows) if len(v) == size]
        links, label = _brute(np.array([rows[k] for k in ids]), 0.9)
        assert [got[k].n_links for k in ids] == links.tolist()
        assert [got[k].component_id for k in ids] == [ids[c] for c in label]
    assert jobs[0] < jobs[1] + 30, jobs  # less than a job for every two lengths more


def test_pivots_are_bounded_by_bytes():
    shares = vectors._wanted([(4096, 10**9), (64, 10**9), (7, 10**6)])
    taken = {size: share * rows for (size, rows), share in zip([(4096, 10**9), (64, 10**9), (7, 10**6)], shares.values(), strict=True)}
    assert sum(taken.values()) <= vectors.MAX_PIVOTS + 1 and sum(8 * size * n for size, n in taken.items()) <= vectors.PIVOT_BYTES * 1.01
