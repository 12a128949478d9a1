"""The longest verbatim matches against brute force, and their time where words repeat."""

import random
import time

import numpy as np
import pyarrow as pa

from glyphmark.llm import decontaminate


def _matches(items, text, width=3):
    block = decontaminate.BenchmarkBlock([i for i, _ in items], [t for _, t in items], width)
    ((_, _, pos, win, origin),) = decontaminate._search_batch(pa.array([text]), block)
    return decontaminate._longest(pos, win, block, origin, {}) if len(pos) else []


def _brute(items, text, width=3):
    w, best = text.split(), {}
    for item, t in items:
        b = t.split()
        for p in range(len(w)):
            for k in range(len(b)):
                n = 0
                while p + n < len(w) and k + n < len(b) and w[p + n] == b[k + n]:
                    n += 1
                if n >= min(width, len(b)):
                    best[item] = max(best.get(item, 0), n)
    return best


def test_longest_matches_equal_a_plain_search():
    rng = random.Random(2)
    for _ in range(150):
        text = " ".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))
        items = [(rng.randint(1, 4), " ".join(rng.choice("abc") for _ in range(rng.randint(1, 15)))) for _ in range(4)]
        got, words = _matches(items, text), text.split()
        assert {m["item_id"]: m["n_words"] for m in got} == _brute(items, text)
        for m in got:
            part = words[m["doc_start"] : m["doc_start"] + m["n_words"]]
            assert any(part == t.split()[m["item_start"] : m["item_start"] + m["n_words"]] for i, t in items if i == m["item_id"])


def test_repeated_words_take_linear_time():
    def took(n):
        began = time.process_time()
        assert _matches([(1, "a " * n)], "a " * 4 * n, 10)[0]["n_words"] == n
        return time.process_time() - began

    took(100)
    assert took(16_000) < 12 * max(took(4_000), 0.02)


def test_two_rows_of_one_item_and_no_hits():
    assert _matches([(7, "x y z q"), (7, "q r s t u")], "q r s t u v") == [{"item_id": 7, "doc_start": 0, "item_start": 0, "n_words": 5}]
    assert _matches([(1, "")], "a b c") == [] and np.zeros(0).size == 0
