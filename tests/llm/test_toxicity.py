"""The automata against a plain edit distance in four scripts, and the model on labelled rows it has not seen."""

import random

import numpy as np
import pyarrow as pa

from glyphmark.llm import toxicity
from glyphmark.llm.textcore import ALNUM, chunks
from pyspark.sql import functions as F

SCRIPTS = ("abcdefg", "äöüßéñç", "абвгдеж", "山川田中村木本")


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _changed(rng, word, letters):
    w = list(word)
    for _ in range(rng.randrange(4)):
        k, what = rng.randrange(len(w) + 1), rng.randrange(3)
        if what == 0:
            w.insert(k, rng.choice(letters))
        elif what == 1 and len(w) > 1:
            del w[k % len(w)]
        else:
            w[k % len(w)] = rng.choice(letters)
    return "".join(w)


def test_automata_match_the_edit_distance(monkeypatch):
    monkeypatch.setattr(toxicity, "TOGETHER", 5)
    rng = random.Random(3)
    terms = sorted({"".join(rng.choice(s) for _ in range(rng.choice([3, 4, 5, 7, 9, 11]))) for s in SCRIPTS for _ in range(6)})
    lexicon = toxicity.Lexicon(terms, [], [1.0] * len(terms))
    tried = [_changed(rng, t, next(s for s in SCRIPTS if t[0] in s)) for t in terms for _ in range(40)]
    hits = {}
    for c in chunks(pa.array([" ".join(tried)]), True, ALNUM):
        hits = {int(w): (int(t), int(e)) for w, t, e in zip(*lexicon.hits(c), strict=True)}
    some = 0
    for k, word in enumerate(tried):
        near = [(d, t) for t, term in enumerate(terms) if (d := _distance(word, term)) <= toxicity.edits_allowed(len(term))]
        assert (k in hits) == bool(near), (word, near)
        if near:
            assert hits[k][1] == min(near)[0] and (hits[k][1], hits[k][0]) in near
            some += hits[k][1] > 0
    assert some > 100


def test_stems_and_long_words():
    lexicon = toxicity.Lexicon(["дураковатый"], ["idiot"], [1.0, 1.0])
    for c in chunks(pa.array(["idiotic дурковатый Idiots idio " + "x" * 100_000]), True, ALNUM):
        word, term, edits = lexicon.hits(c)
        assert word.tolist() == [0, 1, 2] and term.tolist() == [1, 0, 1] and edits.tolist() == [-1, 1, -1]


def test_scores_of_ties_repeats_and_long_texts(spark):
    model = toxicity.ToxicityModel(toxicity.Lexicon(["worthless"], [], [2.0]), np.full(toxicity.N_FEATURES, 0.5), -1.0)
    long = "fine words " * 200_000
    rows = [(1, long), (2, long + "worthless"), (3, "worthless"), (3, "worthless"), (4, None), (5, "")]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[4] == got[5] and got[2] > got[1] and got[3] > got[5] and all(0 <= x <= 1 for x in got.values())


def test_held_out_accuracy(spark):
    """The figures in the README: rows that training does not see, at sf0.1."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, toxicity.train(docs, labels)).where(toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id").select("score", "toxic").collect()
    good, bad = ([r.score for r in rows if r.toxic == y] for y in (0, 1))
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    recall, false = np.mean([b >= 0.5 for b in bad]), np.mean([g >= 0.5 for g in good])
    print(len(bad), len(good), auc, recall, false)
    assert len(bad) > 50 and auc > 0.95 and recall > 0.92 and false < 0.01
