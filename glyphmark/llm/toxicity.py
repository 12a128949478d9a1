"""Toxicity: a Levenshtein automaton intersected with a trie of a learned lexicon.

The lexicon is mined from labelled rows: words, and word beginnings where a stem with its
endings tells more than any one word.  Words of at least 5 letters also match with one edit,
of at least 9 with two; beginnings match exactly.  An edit is one of a code point, in any
script.  Trie and automata are intersected once on the driver into deterministic tables over
code points, TOGETHER words to a table, which run over all words of a batch side by side;
most words die in them after two or three letters.

Each hit is looked at in its context window: quotation marks on both sides or a reporting
word near it make it a quotation.  A logistic regression over counts of plain, misspelled,
stem and quoted hits, their weights and density gives the score.

Labels, lang, source and doc_id are never inputs of a score.  Training uses labelled rows
only where crc32(doc_id) mod 5 is not 0, at most about MAX_TRAIN of them, picked by a hash
of doc_id.  Near copies (an equal least shingle in one of COPIES orders) are one training row, so that the words of a
text that was copied often are no evidence.  Without both labels in the training rows every
score is the prior, or 0.

Null and empty texts get the score of a text without hits.  Rows that repeat a doc_id are
scored row by row.  Only `doc_id` and `text` are read; other columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmark.llm.common import table
from glyphmark.llm.textcore import ALNUM, Chunk, chunks, odd_numbers, windows

MAX_TRAIN = 20_000
#: Words of one table; more words make more tables.
TOGETHER = 64
#: A term is in at least so many toxic documents, with such log odds, log-likelihood ratio and precision.
MIN_DOCS, MIN_ODDS, MIN_GAIN, MIN_PRECISION = 6, 2.0, 20.0, 0.6
#: A beginning counts only if it is in so many times the toxic documents of its commonest word.
STEM_GAIN = 1.5
STEM_SIZES, WORD_SIZES = range(3, 11), range(3, 25)
#: Near copies among the training rows share a least GRAM words in one of so many orders.
GRAM, COPIES = 5, 4
CONTEXT_BYTES, CONTEXT_WORDS = 48, 4
#: Words that report speech.
REPORTING = ("said", "says", "wrote", "quote", "quoted", "called", "sagte", "schrieb", "dijo", "dit", "disait")
#: Quotation marks.
QUOTES = ('"', "“", "”", "«", "»", "„")
N_FEATURES = 9


def edits_allowed(size: int) -> int:
    return 2 if size >= 9 else 1 if size >= 5 else 0


def code_points(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of a chunk's bytes, and the first and the end of each word among them."""
    lead = (c.data & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(lead)])
    at = np.flatnonzero(lead)
    more = np.concatenate([c.data, np.zeros(3, np.uint8)]).astype(np.int32)
    one = more[at]
    tail = [more[at + k] & 0x3F for k in (1, 2, 3)]
    two, three, four = (one & 0x1F) << 6 | tail[0], (one & 0x0F) << 12 | tail[0] << 6 | tail[1], (one & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
    return np.select([one < 0x80, one < 0xE0, one < 0xF0], [one, two, three], four), before[c.starts], before[c.ends]


class Automaton:
    """The deterministic product of the lexicon trie and the Levenshtein automata of its words.

    table[state, symbol] is the next state, 0 is dead, 1 the start; a symbol is the place of a
    code point in `alphabet` and one, 0 is any other.  word_term and word_edits have what a
    word that ends in a state matches; stem_term what any word that reaches it does.
    """

    def __init__(self, words: list[str], stems: list[str]):
        children: list[dict[int, int]] = [{}]
        limit, word_at, stem_at = [0], {}, {}
        for k, (term, stem) in enumerate([(w, False) for w in words] + [(s, True) for s in stems]):
            node, most = 0, 0 if stem else edits_allowed(len(term))
            limit[0] = max(limit[0], most)
            for b in term:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    limit.append(0)
                node = children[node][b]
                limit[node] = max(limit[node], most)
            (stem_at if stem else word_at)[node] = k
        below = self._below(children, word_at, words)

        def close(nodes: dict[int, int]) -> frozenset:
            todo = list(nodes.items())
            while todo:
                n, e = todo.pop()
                if nodes.get(n, 99) < e:
                    continue
                for c in children[n].values():
                    if e + 1 <= below[c] and nodes.get(c, 99) > e + 1:
                        nodes[c] = e + 1
                        todo.append((c, e + 1))
            return frozenset(nodes.items())

        alphabet = sorted({b for c in children for b in c})
        self.alphabet = np.array([ord(b) for b in alphabet], np.int32)
        start = close({0: 0})
        number, queue = {frozenset(): 0, start: 1}, [start]
        rows: dict[int, np.ndarray] = {0: np.zeros(len(alphabet) + 1, np.int32)}
        while queue:
            state = queue.pop()

            def step(b: str | None, state=state) -> int:
                out: dict[int, int] = {}
                for n, e in state:
                    moves = [(n, e + 1)] + [(c, e if x == b else e + 1) for x, c in children[n].items()]
                    for m, f in moves:
                        if (f <= below[m] or f == 0) and out.get(m, 99) > f:
                            out[m] = f
                new = close(out)
                if new not in number:
                    number[new] = len(number)
                    queue.append(new)
                return number[new]

            rows[number[state]] = np.array([step(b) for b in (None, *alphabet)], np.int32)
        size = len(number)
        self.table = np.stack([rows[k] for k in range(size)])
        self.word_term, self.word_edits, self.stem_term = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.full(size, -1, np.int32)
        for state, k in number.items():
            best = min(((e, word_at[n]) for n, e in state if n in word_at and e <= edits_allowed(len(words[word_at[n]]))), default=None)
            if best:
                self.word_edits[k], self.word_term[k] = best
            self.stem_term[k] = min((stem_at[n] for n, e in state if n in stem_at and e == 0), default=-1)

    @staticmethod
    def _below(children, word_at, words) -> list[int]:
        """The most edits that any word in a node's subtree allows."""
        out = [0] * len(children)
        for n in range(len(children) - 1, -1, -1):
            out[n] = max([edits_allowed(len(words[word_at[n]])) if n in word_at else 0, *(out[c] for c in children[n].values())])
        return out

    def run(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, term, edits) of all hits among the words of code_points; edits is -1 for a stem."""
        symbol = np.zeros(self.alphabet.max(initial=0) + 2, np.int32)
        symbol[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        symbols = symbol[np.minimum(points, len(symbol) - 1)]
        alive = np.arange(len(starts))
        state = np.ones(len(alive), np.int32)
        at = starts.copy()
        found: list[tuple] = []
        while len(alive):
            state = self.table[state, symbols[at]]
            at = at + 1
            stem = self.stem_term[state]
            done = stem >= 0
            if done.any():
                found.append((alive[done], stem[done], np.full(int(done.sum()), -1)))
            ended = ~done & (at == ends[alive])
            if ended.any():
                term = self.word_term[state[ended]]
                hit = term >= 0
                found.append((alive[ended][hit], term[hit], self.word_edits[state[ended]][hit]))
            go = (state > 0) & ~done & ~ended
            alive, state, at = alive[go], state[go], at[go]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


_QUOTE_BYTES = tuple(q.encode() for q in QUOTES)
_REPORTING = frozenset(w.encode() for w in REPORTING)


def _quoted(c: Chunk, k: int, row: int) -> bool:
    lo, hi = int(c.bounds[row]), int(c.bounds[row + 1])
    s, e = int(c.starts[k]), int(c.ends[k])
    left, right = c.data[max(lo, s - CONTEXT_BYTES) : s].tobytes(), c.data[e : min(hi, e + CONTEXT_BYTES)].tobytes()
    if any(q in left for q in _QUOTE_BYTES) and any(q in right for q in _QUOTE_BYTES):
        return True
    near = range(max(int(c.first[row]), k - CONTEXT_WORDS), k)
    return any(c.word(j) in _REPORTING for j in near)


class Lexicon:
    """Words, then stems, and the weight of each."""

    def __init__(self, words: list[str], stems: list[str], weights: list[float]):
        self.words, self.stems, self.weights = words, stems, np.array(weights or [0.0])
        self.tables = [(Automaton(words[k : k + TOGETHER], []), k) for k in range(0, len(words), TOGETHER)] + [(Automaton([], stems), len(words))] * bool(stems)

    def hits(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, term, edits) by word; a word that several tables match counts once, for the fewest edits."""
        points, starts, ends = code_points(c)
        found = [(w, t + k, e) for a, k in self.tables for w, t, e in [a.run(points, starts, ends)]]
        word, term, edits = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3))
        order = np.lexsort((term, edits, word))
        word, term, edits = word[order], term[order], edits[order]
        first = np.concatenate([[True], word[1:] != word[:-1]])[: len(word)]
        return word[first], term[first], edits[first]

    def features(self, column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), N_FEATURES))
        for c in chunks(column, True, ALNUM):
            word, term, edits = self.hits(c)
            row = np.searchsorted(c.first, word, "right") - 1
            counts = np.diff(c.first)
            out[c.lo : c.hi, 0] = np.log1p(counts) / 5
            cuts = np.searchsorted(row, np.arange(len(counts) + 1))
            for r in np.unique(row):
                part = slice(cuts[r], cuts[r + 1])
                quoted = np.array([_quoted(c, int(k), int(r)) for k in word[part]])
                t, e = term[part][~quoted], edits[part][~quoted]
                w = self.weights[t]
                exact, fuzzy, stem = e == 0, e > 0, e < 0
                out[c.lo + r, 1:] = (
                    np.log1p(exact.sum()), np.log1p(fuzzy.sum()), np.log1p(stem.sum()), np.log1p(quoted.sum()),
                    np.log1p(len(np.unique(t[~fuzzy]))), w[~fuzzy].max(initial=0) / 5, np.log1p(w[~fuzzy].sum()),
                    min(5.0, 100 * (~fuzzy).sum() / counts[r]),
                )
        return out


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, coefficients: np.ndarray, bias: float):
        self.lexicon, self.coefficients, self.bias = lexicon, coefficients, bias

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.lexicon.features(column) @ self.coefficients + self.bias, -30, 30)))


def _terms(column: pa.Array) -> Iterator[set]:
    """Each row's distinct words ("w" before them) and beginnings ("s" before them)."""
    for c in chunks(column, True, ALNUM):
        for r in range(c.hi - c.lo):
            out = set()
            for w in {c.word(k) for k in range(c.first[r], c.first[r + 1])}:
                w = w.decode("utf-8", "replace")
                if len(w) in WORD_SIZES:
                    out.add("w" + w)
                out.update("s" + w[:n] for n in STEM_SIZES if n < len(w))
            yield out


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each text's least hashes, in COPIES orders, of GRAM words in a row, or of all its words if it has fewer."""
    for batch in batches:
        least = []
        for c in chunks(batch.column("text"), True, ALNUM):
            h = c.hashes()
            for r in range(c.hi - c.lo):
                own = h[c.first[r] : c.first[r + 1]]
                grams = windows(own, min(GRAM, len(own)), 5) if len(own) else np.zeros(1, np.uint64)
                least.append([int((grams * f).min().view(np.int64)) for f in odd_numbers(COPIES, 29)])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.list_(pa.int64()))], names=[*batch.schema.names, "least"])


def _without_copies(rows: DataFrame) -> DataFrame:
    """The rows (doc_id, text, toxic) without those that share a least shingle with a smaller doc_id's."""
    rows = rows.mapInArrow(_least, "doc_id long, text string, toxic int, least array<long>")
    for k in range(COPIES):
        rows = rows.groupBy("toxic", F.get("least", F.lit(k))).agg(F.min(F.struct("doc_id", "text", "least")).alias("x")).select("x.doc_id", "x.text", "toxic", "x.least")
    return rows.select("text", "toxic")


def _count_terms(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, total = wanted.value if wanted else None, Counter()
        for batch in batches:
            for t in _terms(batch.column("text")):
                total.update(t if only is None else t & only)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    return run


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method with a small ridge."""
    a = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(a.shape[1])
    ridge = np.diag([0.5] * x.shape[1] + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b[:-1], float(b[-1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features(lexicon_bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = lexicon_bc.value.features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> ToxicityModel:
    """Learns lexicon and weights from the labelled rows of the training folds."""
    context = docs.sparkSession.sparkContext
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id")))
    share = min(1.0, max_train / max(1, usable.count()))
    picked = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id"))).where(picked)
    rows = texts.join(usable.where(picked).dropDuplicates(["doc_id"]), "doc_id").select("doc_id", "text", "toxic")
    rows = _without_copies(rows).persist()
    try:
        sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
        if not toxic or not clean:
            prior = 30.0 if toxic else -30.0
            return ToxicityModel(Lexicon([], [], []), np.zeros(N_FEATURES), prior)

        def count(label: int, wanted=None) -> DataFrame:
            return rows.where(F.col("toxic") == label).select("text").mapInArrow(_count_terms(wanted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))

        # Both are bounded by the sample of max_train documents.
        positive = {r["term"]: r["n"] for r in count(1).where(F.col("n") >= MIN_DOCS).collect()}
        negative = {r["term"]: r["n"] for r in count(0, context.broadcast(frozenset(positive))).collect()}
        lexicon = _choose(positive, negative, toxic, clean)
        got = rows.mapInArrow(_features(context.broadcast(lexicon)), "toxic int, x array<double>").collect()
    finally:
        rows.unpersist()
    got.sort(key=lambda r: (r["toxic"], r["x"]))
    return ToxicityModel(lexicon, *_fit(np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float)))


def _choose(positive: dict, negative: dict, toxic: int, clean: int) -> Lexicon:
    """The terms with the surest odds; a beginning stands for the words and longer beginnings under it unless they are much surer."""
    scored = []
    for term, p in positive.items():
        n = negative.get(term, 0)
        odds = np.log((p + 0.5) / (toxic - p + 0.5)) - np.log((n + 0.5) / (clean - n + 0.5))
        share = (p + n) / (toxic + clean)
        gain = 2 * (p * np.log(p / (toxic * share)) + (n * np.log(n / (clean * share)) if n else 0))
        if odds >= MIN_ODDS and gain >= MIN_GAIN and p >= MIN_PRECISION * (p + n):
            scored.append((float(gain), float(odds), term))
    fullest: Counter = Counter()
    for term, p in positive.items():
        if term[:1] == "w":
            for n in STEM_SIZES:
                fullest[term[1 : n + 1]] = max(fullest[term[1 : n + 1]], p)
    scored = [x for x in scored if x[2][:1] == "w" or positive[x[2]] > STEM_GAIN * fullest[x[2][1:]]]
    scored.sort(key=lambda x: (-x[0], x[2][:1] == "s", len(x[2]), x[2]))
    words, stems = {}, {}
    for _, odds, term in scored:
        body = term[1:]
        if any(body.startswith(s) for s in stems):
            continue
        if term[:1] == "s" and (any(s.startswith(body) for s in stems) or any(w.startswith(body) for w in words)):
            continue
        (words if term[:1] == "w" else stems)[body] = odds
    return Lexicon(list(words), list(stems), [*words.values(), *stems.values()])


def _score(model_bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model_bc.value.score(batch.column("text")))], names=["doc_id", "score"])

    return run


def _pass(model_bc, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model_bc.value.score(batch.column("text")) < threshold))

    return run


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score; one row for each row of docs."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, all columns as they were."""
    return docs.mapInArrow(_pass(docs.sparkSession.sparkContext.broadcast(model), threshold), docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
