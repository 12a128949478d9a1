"""Spelling variants against all pairs of a small vocabulary, and words from damaged runs against a loop."""

import re
import zlib
from collections import Counter

import numpy as np

from glyphmark.llm import spelling


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _brute(counts, times=2):
    near = {w: [v for v in counts if _near(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= times * counts[w] else None
    root = {}
    for w in counts:
        root[w] = w
        while form[root[w]]:
            root[w] = form[root[w]]
    return {(w, form[w], root[w], counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def test_matches_all_pairs(spark):
    rng = np.random.default_rng(8)
    words = {"".join(rng.choice(list("abé"), rng.integers(1, 7))) for _ in range(500)} | {"a" * 200, "a" * 199, "a" * 199 + "b", "b" + "a" * 199, "aaaa", "ÿ", "÷×"}
    counts = {w: int(rng.choice([1, 2, 3, 5, 8, 20, 50, 200])) for w in sorted(words)}
    got = spelling.group_variants(spark.createDataFrame([(w, n, 1, "clash") for w, n in counts.items()], "word string, n long, node int, key string").repartition(7))
    assert {tuple(r) for r in got.collect()} == _brute(counts)


def test_long_chain_of_forms(spark):
    counts = {"abcdefgh" + "x" * k: 3**k for k in range(20)}
    assert {tuple(r) for r in spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()} == _brute(counts)


def test_words_of_damaged_runs(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["Größe", "straße", "ABCDEÉ", "word1words", "l'année", "tiny", "x\U0001f600yzabcd"], 60)) for _ in range(40)] + [None, "", "größe" * 3000]
    rows = [(k if k != 5 else None, t, 1, "c", 2) for k, t in enumerate(texts)] + [(7, texts[7], 1, "c", 2)]
    want = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    got = spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string, n int, word string, h int"))
    assert {(r.word, r.n) for r in got.collect()} == {(w, n) for w, n in want.items() if len(w) >= 5 and n >= 3}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_variants(spelling.word_counts(docs)).count() == 0
