"""Near duplicates where regions are crowded and doc_ids repeat, against brute force."""

import random

from glyphmark.llm import minhash


def _components(texts, percent):
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    top = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = top[i], top[j]
                top = [min(a, b) if x in (a, b) else x for x in top]
    return top


def test_pairs_that_share_a_boilerplate(spark):
    """1,000 true pairs among 2,000 documents that are all alike, but below the threshold."""
    shared = [f"s{k}" for k in range(220)]
    rows = []
    for p in range(1000):
        own = [f"p{p}_{k}" for k in range(30)]
        for side in "ab":
            words = shared[:100] + own + shared[100:] + [f"{side}{p}_{k}" for k in range(5)]
            rows.append((len(rows), " ".join(words)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert all(got[2 * p] == got[2 * p + 1] == 2 * p for p in range(1000))


def test_repeated_doc_id_has_the_links_of_all_its_texts(spark):
    first, second = " ".join(f"k{j}" for j in range(60)), " ".join(f"q{j}" for j in range(60))
    rows = [(1, f"zz {first}"), (1, f"aa {second}"), (2, second), (3, f"{first} end"), (4, "something else that stands alone here")]
    got = [(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()]
    assert sorted(got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_ranges_that_cut_a_region(spark):
    """Many small groups over many sorted ranges."""
    rng, texts = random.Random(8), []
    for g in range(60):
        base = [f"g{g}_{k}" for k in range(60)]
        for _ in range(rng.choice([2, 3, 12])):
            words = list(base)
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            texts.append(words)
    rng.shuffle(texts)
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string"), 80).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    assert [got[k] for k in range(len(texts))] == _components(texts, 80)
