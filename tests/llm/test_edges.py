"""Empty tables, tables of nulls, and extra columns with clashing names, through every operator and stage."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from glyphmark.llm import decontaminate, linededup, minhash, mixing, substrings, surrogates, toxicity

#: Names that the operators use themselves.
CLASHING = "n_lines int, n_words int, n_hit int, n_shingles int, component_id int, kept int, key int, line int, term int, target int, taken int, score double, entities int, __id int, __k int, __source int, __size int, __taken int"
DOCS = f"doc_id long, text string, source string, n_chars long, {CLASHING}"
EXTRA = (1,) * 11 + (0.5,) + (1,) * 6

OPERATORS = {
    "op1": lambda d: decontaminate.digest(decontaminate.find_matches(d, d.selectExpr("doc_id AS item_id", "text"))),
    "op2": lambda d: minhash.near_duplicates(d, 85),
    "op3": linededup.dedup_lines,
    "op4": substrings.find_repeats,
    "op6": lambda d: toxicity.score(d, toxicity.train(d, d.selectExpr("doc_id", "1 AS toxic"))),
    "op7": mixing.mixed_counts,
    "op10": lambda d: surrogates.pseudonymize(d, "k"),
}


def table(spark, texts):
    return spark.createDataFrame([(i, t, s, len(t or ""), *EXTRA) for i, t, s in texts], DOCS)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_nothing_and_on_nulls(spark, name):
    assert OPERATORS[name](table(spark, [])).count() == 0
    nulls = [(None, None, None), (None, None, None), (1, None, "a"), (2, "", None), (3, " \t\n\x0b ", "a"), (3, " \t\n\x0b ", "a")]
    assert OPERATORS[name](table(spark, nulls)).count() == len(nulls)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage_keeps_columns_and_clean_documents(spark, tables, name, stage):
    rng = random.Random(3)
    clean = [(k, " ".join(f"w{rng.randrange(9000)}" for _ in range(60)), "a") for k in range(1, 6)]
    out = stage(spark, table(spark, [*clean, (None, None, None), (9, "", None)]), tables)
    assert out.columns[: len(DOCS.split(","))] == [c.split()[0] for c in DOCS.split(", ")]
    kept = {r.doc_id: r.text for r in out.collect()}
    if name == "mixing":
        assert set(kept) <= {k for k, _, _ in clean}
    else:
        assert {k: kept[k] for k, _, _ in clean} == {k: t for k, t, _ in clean}
    assert stage(spark, table(spark, []), tables).count() == 0


def test_decontamination_stage_takes_the_passage_only(spark, tables):
    rows = [(1, "before Alpha beta, gamma delta epsilon zeta eta theta iota kappa after", "a"), (2, "alpha beta gamma delta epsilon zeta eta theta iota", "a")]
    stage = dict(corpus_pipeline.STAGES)["decontamination"]
    assert [r.doc_id for r in stage(spark, table(spark, rows), tables).collect()] == [2]


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(4)
    pool = [f"  Line {k} " + "x" * rng.choice([20, 31, 32, 60]) + rng.choice(["", "\r", " \x0b"]) for k in range(12)]
    texts = [(k, "\n".join(rng.choice([rng.choice(pool), rng.choice(pool).upper(), "", f"own {k}", "é" * 40]) for _ in range(rng.randrange(9))), "a") for k in range(40)]
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders: dict = {}
    for k, t, _ in texts:
        for line in t.split("\n"):
            holders.setdefault(key(line), set()).add(k)
    gone = lambda line, k: len(key(line)) >= 40 and len(holders[key(line)]) >= 5 and k != max(holders[key(line)])
    got = {r.doc_id: r for r in linededup.dedup_lines(table(spark, texts)).collect()}
    dropped = 0
    for k, t, _ in texts:
        lines = t.split("\n")
        left = [x for x in lines if not gone(x, k)]
        dropped += len(lines) - len(left)
        assert (got[k].n_lines, got[k].n_dropped, got[k].text) == (len(lines), len(lines) - len(left), "\n".join(left))
    assert dropped > 20


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_brute_force(spark, seed):
    """Copies changed at random on both sides of the threshold, with chains of them."""
    rng, texts = random.Random(seed), []
    for _ in range(12):
        words = [f"v{rng.randrange(800)}" for _ in range(rng.choice([5, 40, 150, 300]))]
        for _ in range(rng.randrange(1, 9)):
            texts.append(" ".join(words))
            for _ in range(rng.choice([0, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    top = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = top[i], top[j]
                top = [min(a, b) if x in (a, b) else x for x in top]
    got = {r.doc_id: r for r in minhash.near_duplicates(table(spark, [(k, t, "a") for k, t in enumerate(texts)]), 85).collect()}
    assert [got[k].component_id for k in range(len(texts))] == top
    assert [got[k].n_shingles for k in range(len(texts))] == [len(s) for s in sets]
    assert len(set(top)) < len(texts)


def test_pairs_inside_a_crowded_family_match_brute_force(spark):
    rng, texts = random.Random(5), []
    for d in range(3000):
        words = [f"w{k}" for k in range(100)]
        for k in rng.sample(range(4, 96), 2):
            words[k] = f"x{d}_{k}"
        texts.append(words)
    for d in range(0, 3000, 50):
        words = list(texts[d])
        words[1], words[rng.randrange(4, 96)] = f"y{d}", f"z{d}"
        texts.append(words)
    sets = [{tuple(w[k : k + 5]) for k in range(96)} for w in texts]
    number: dict[tuple, int] = {}
    for s in sets:
        for x in s:
            number.setdefault(x, len(number))
    times = np.bincount([number[x] for s in sets for x in s])
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)
    held = np.zeros((len(sets), int(column.max()) + 1), np.float32)
    for d, s in enumerate(sets):
        held[d, [c for x in s if (c := column[number[x]]) >= 0]] = 1
    both, n = held @ held.T, np.array([len(s) for s in sets])
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in np.argwhere(np.triu(100 * both >= 85 * (n[:, None] + n[None, :] - both), 1)):
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 85).collect()}
    assert got == {k: root(k) for k in got}
    assert sum(k != c for k, c in got.items()) >= 50


def test_mixing_follows_the_keys_to_the_target(spark):
    """Taken words against a plain loop over the sources."""
    rng = random.Random(5)
    texts = [(k, "w " * rng.randrange(0, 40), rng.choice(["a", "b", "b", "b", None])) for k in range(200)]
    got = mixing.mixed_counts(table(spark, texts)).collect()
    sizes = {k: len((t or "").split()) for k, t, _ in texts}
    for source in ("a", "b", None):
        mine = [r for r in got if {k: s for k, _, s in texts}[r.doc_id] == source]
        total, target = sum(sizes[r.doc_id] for r in mine), mine[0].target
        assert all(r.source_size == total and r["size"] == sizes[r.doc_id] for r in mine)
        epochs = int(target // total)
        assert all(r.taken in (epochs * r["size"], (epochs + 1) * r["size"]) for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= 40
    assert hashlib.sha256(repr(sorted((r.doc_id, r.taken) for r in got)).encode()).hexdigest() == hashlib.sha256(repr(sorted((r.doc_id, r.taken) for r in mixing.mixed_counts(table(spark, texts[::-1])).collect())).encode()).hexdigest()
