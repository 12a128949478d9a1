"""Benchmark decontamination with suffix arrays over shards of the training text.

Each Arrow batch of documents is a shard.  Its words become codes of the benchmark
vocabulary (a word the benchmark lacks is a terminator, since no match can hold it),
the suffixes long enough to hold a benchmark window are sorted, and every benchmark
suffix is binary-searched in that array.  The range found has all its occurrences
and their places.  The longest verbatim match with an item is the longest run of a
document's windows that is also one of the item's: a suffix automaton of the item's windows
finds it in one pass, however often words repeat in either.

The benchmark is a stated query set.  It is read in blocks of at most `block_words`
words, each broadcast by itself, so a broadcast never grows with the data; several
blocks cost several narrow passes and no shuffle.

Null or empty texts have no words and are never contaminated.  Items without words, or
with a null item_id, are no items.  Rows that repeat a doc_id are judged row by row.
Only the columns `doc_id` and `text` are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmark.llm.common import cut, table
from glyphmark.llm.textcore import ALNUM, chunks

WIDTH = 10
BLOCK_WORDS = 2_000_000
#: Words of a batch that are sorted together at most, apart from one longer document.
SHARD_WORDS = 4_000_000
#: States of the items' automata that a task keeps for the next documents.
AUTOMATON_STATES = 500_000


class BenchmarkBlock:
    """Vocabulary, distinct windows and their items, of at most about BLOCK_WORDS words."""

    def __init__(self, ids: list, texts: list, width: int):
        self.width, self.ids = width, ids
        parts, item_of = [], []
        for c in chunks(pa.array(texts, pa.large_string()), True, ALNUM):
            h = c.hashes()
            for r in range(c.hi - c.lo):
                if c.first[r + 1] > c.first[r]:
                    parts.append(h[c.first[r] : c.first[r + 1]])
                    item_of.append(c.lo + r)
        self.vocabulary = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.vocabulary >> np.uint64(44)] = True
        keys, lengths, owners, places = [], [], [], []
        for item, h in zip(item_of, parts, strict=True):
            codes = np.searchsorted(self.vocabulary, h) + 1
            size = min(width, len(codes))
            m = np.zeros((len(codes) - size + 1, width), ">u4")
            m[:, :size] = np.lib.stride_tricks.sliding_window_view(codes, size)
            keys.append(m)
            lengths.append(np.full(len(m), size))
            owners.append(np.full(len(m), item))
            places.append(np.arange(len(m)))
        self.shortest = min((int(x[0]) for x in lengths), default=width)
        if not keys:
            self.keys = self.lengths = self.items = self.rows = self.sequence = np.zeros(0, int)
            self.first = self.begins = np.zeros(1, int)
            return
        flat = np.ascontiguousarray(np.concatenate(keys).astype(">u4")).view(f"S{4 * width}").ravel()
        lengths, owners, places = np.concatenate(lengths), np.concatenate(owners), np.concatenate(places)
        order = np.lexsort((places, owners, lengths, flat))
        flat, lengths = flat[order], lengths[order]
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (lengths[1:] != lengths[:-1])
        at = np.flatnonzero(new)
        self.keys, self.lengths = flat[at], lengths[at]
        # Each window's item rows, each once; each row's windows in order of their places.
        window = np.cumsum(new) - 1
        owners, places = owners[order], places[order]
        once = np.ones(len(flat), bool)
        once[1:] = new[1:] | (owners[1:] != owners[:-1])
        self.rows = owners[once]
        self.first = np.searchsorted(window[once], np.arange(len(at) + 1))
        self.items = np.array(ids, np.int64)[self.rows]
        by_row = np.lexsort((places, owners))
        self.sequence, self.begins = window[by_row], np.searchsorted(owners[by_row], np.arange(len(ids) + 1))
        after = np.full((len(at), width), 0xFFFFFFFF, ">u4")
        head = np.arange(width)[None, :] < self.lengths[:, None]
        after[head] = np.ascontiguousarray(np.frombuffer(b"".join(k.ljust(4 * width, b"\0") for k in self.keys), ">u4").reshape(-1, width))[head]
        self.after = np.ascontiguousarray(after).view(f"S{4 * width}").ravel()

    def codes(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.uint32)
        maybe = np.flatnonzero(self.seen[h >> np.uint64(44)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == h[maybe]
            out[maybe[hit]] = at[hit] + 1
        return out


class SuffixShard:
    """The sorted suffixes of one shard, each cut at its document's end and its first foreign word."""

    def __init__(self, codes: np.ndarray, limits: np.ndarray, block: BenchmarkBlock):
        """limits: the word index at which each word's document ends."""
        n, width = len(codes), block.width
        stop = np.where(codes == 0, np.arange(n), n)
        stop = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], limits) if n else stop
        room = stop - np.arange(n)
        at = np.flatnonzero(room >= block.shortest)
        matrix = np.zeros((len(at), width), ">u4")
        padded = np.concatenate([codes, np.zeros(width, np.uint32)])
        for j in range(width):
            matrix[:, j] = np.where(room[at] > j, padded[at + j], 0)
        keys = np.ascontiguousarray(matrix).view(f"S{4 * width}").ravel()
        order = np.argsort(keys, kind="stable")
        self.suffixes, self.keys = at[order], keys[order]

    def search(self, block: BenchmarkBlock) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all occurrences of the block's windows, and the window of each."""
        if not len(self.keys) or not len(block.keys):
            return np.zeros(0, int), np.zeros(0, int)
        lo = np.searchsorted(self.keys, block.keys, "left")
        hi = np.searchsorted(self.keys, block.after, "right")
        found = np.flatnonzero(hi > lo)
        counts = (hi - lo)[found]
        start = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) if len(found) else np.zeros(0, int)
        return self.suffixes[start + np.arange(int(counts.sum()))], np.repeat(found, counts)


def _merged(start: np.ndarray, end: np.ndarray) -> list[int]:
    """Union of intervals, flat: start, end, start, end."""
    out: list[int] = []
    for a, b in sorted(set(zip(start.tolist(), end.tolist(), strict=True))):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


class Automaton:
    """The suffix automaton of a sequence: all its runs, and where each first ends."""

    def __init__(self, sequence: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.end = [-1], [0], [-1]
        last = 0
        for k, w in enumerate(sequence):
            new = self._state({}, self.size[last] + 1, k)
            p, last = last, new
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
                continue
            q = self.next[p][w]
            if self.size[q] != self.size[p] + 1:
                twin = self._state(dict(self.next[q]), self.size[p] + 1, self.end[q])
                self.link[twin] = self.link[q]
                self.link[q] = twin
                while p >= 0 and self.next[p].get(w) == q:
                    self.next[p][w] = twin
                    p = self.link[p]
                q = twin
            self.link[new] = q

    def _state(self, following: dict[int, int], size: int, end: int) -> int:
        self.next.append(following)
        self.link.append(-1)
        self.size.append(size)
        self.end.append(end)
        return len(self.next) - 1

    def longest(self, pos: list[int], win: list[int]) -> tuple[int, int, int]:
        """(windows, first position, place in the sequence) of the longest run of win on adjacent positions; the first of equal ones."""
        best, state, size, last = (0, 0, 0), 0, 0, -2
        for p, w in zip(pos, win, strict=True):
            if p != last + 1:
                state = size = 0
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            if w in self.next[state]:
                state, size = self.next[state][w], size + 1
            if size > best[0]:
                best = (size, p - size + 1, self.end[state] - size + 1)
            last = p
        return best


def _longest(pos: np.ndarray, win: np.ndarray, block: BenchmarkBlock, origin: int, automata: dict[int, Automaton]) -> list[dict]:
    """For each item its longest verbatim match in one document, and the place; pos is in order."""
    best: dict[int, tuple[int, int, int]] = {}
    used, which = np.unique(win, return_inverse=True)
    counts = block.first[used + 1] - block.first[used]
    rows = np.concatenate([block.rows[block.first[w] : block.first[w + 1]] for w in used])
    order = np.argsort(rows, kind="stable")
    rows, holds = rows[order], np.repeat(np.arange(len(used)), counts)[order]
    by_window = np.argsort(which, kind="stable")
    edges = np.searchsorted(which[by_window], np.arange(len(used) + 1))
    for mine in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows)) + 1):
        row = int(rows[mine[0]])
        at = np.sort(np.concatenate([by_window[edges[u] : edges[u + 1]] for u in holds[mine]]))
        if row not in automata:
            if sum(len(x.end) for x in automata.values()) > AUTOMATON_STATES:
                automata.clear()
            automata[row] = Automaton(block.sequence[block.begins[row] : block.begins[row + 1]].tolist())
        n, begun, place = automata[row].longest(pos[at].tolist(), win[at].tolist())
        found = (n - 1 + int(block.lengths[used[holds[mine[0]]]]), begun - origin, place)
        item = int(block.ids[row])
        if found[0] > best.get(item, (0,))[0]:
            best[item] = found
    return [{"item_id": i, "doc_start": d, "item_start": s, "n_words": n} for i, (n, d, s) in sorted(best.items())]


def _shards(column: pa.Array):
    """Chunks joined until they hold SHARD_WORDS words."""
    group, words = [], 0
    for c in chunks(column, True, ALNUM):
        group.append(c)
        words += len(c.starts)
        if words >= SHARD_WORDS:
            yield group
            group, words = [], 0
    if group:
        yield group


def _search_batch(column: pa.Array, block: BenchmarkBlock):
    """Yields (row, n_words, positions, windows, first word) of each row with the row's occurrences."""
    for group in _shards(column):
        codes = np.concatenate([block.codes(c.hashes()) for c in group])
        counts = np.concatenate([np.diff(c.first) for c in group])
        first = np.concatenate([[0], np.cumsum(counts)])
        pos, win = SuffixShard(codes, np.repeat(first[1:], counts), block).search(block)
        order = np.argsort(pos, kind="stable")
        pos, win = pos[order], win[order]
        cuts = np.searchsorted(pos, first)
        for r in range(len(counts)):
            yield group[0].lo + r, int(counts[r]), pos[cuts[r] : cuts[r + 1]], win[cuts[r] : cuts[r + 1]], int(first[r])


SPAN = pa.struct([("item_id", pa.int64()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("n_words", pa.int64())])
FOUND = "n_words long, hit_intervals array<long>, items array<long>, matches array<struct<item_id:long,doc_start:long,item_start:long,n_words:long>>"


def _annotate(block_bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, automata = block_bc.value, {}
        for batch in batches:
            n = batch.num_rows
            words, hits, items, spans = [0] * n, [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
            for r, count, pos, win, origin in _search_batch(batch.column("text"), block):
                words[r] = count
                if len(pos):
                    hits[r] = _merged(pos - origin, pos - origin + block.lengths[win])
                    w = np.unique(win)
                    items[r] = np.unique(np.concatenate([block.items[block.first[k] : block.first[k + 1]] for k in w])).tolist()
                    spans[r] = _longest(pos, win, block, origin, automata)
            before = dict(zip(batch.schema.names, batch.columns, strict=True))
            if "hit_intervals" in before:
                for name, new in (("hit_intervals", hits), ("items", items), ("matches", spans)):
                    for r, old in enumerate(before[name].to_pylist()):
                        new[r] = old + new[r]
                hits = [_merged(np.array(x[::2], int), np.array(x[1::2], int)) if x else [] for x in hits]
                items = [sorted(set(x)) for x in items]
            yield pa.RecordBatch.from_arrays(
                [before["doc_id"], before["text"], pa.array(words, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.int64())), pa.array(spans, pa.list_(SPAN))],
                names=["doc_id", "text", "n_words", "hit_intervals", "items", "matches"],
            )

    return run


def _clean(block_bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = block_bc.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for r, _, pos, _, _ in _search_batch(batch.column("text"), block):
                keep[r] = not len(pos)
            yield batch.filter(pa.array(keep))

    return run


def benchmark_blocks(benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> Iterator[BenchmarkBlock]:
    """Reads the query set one partition at a time and gives it out in blocks."""
    ids, texts, words, given = [], [], 0, False
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text")
    for item, text in rows.toLocalIterator():
        size = len(text) // 2 + 1
        if ids and words + size > block_words:
            yield BenchmarkBlock(ids, texts, width)
            ids, texts, words, given = [], [], 0, True
        ids.append(item)
        texts.append(text)
        words += size
    if ids or not given:
        yield BenchmarkBlock(ids, texts, width)


def find_matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text, n_words, hit_intervals (flat start, end), items, matches (longest by item); a row for each row."""
    context = docs.sparkSession.sparkContext
    out = docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, text string, " + FOUND
    for k, block in enumerate(benchmark_blocks(benchmark, width, block_words)):
        out = cut(out) if k else out
        out = out.mapInArrow(_annotate(context.broadcast(block)), schema)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, all columns as they were, in which no benchmark window occurs."""
    context, out = docs.sparkSession.sparkContext, docs
    for k, block in enumerate(benchmark_blocks(benchmark, width, block_words)):
        out = cut(out) if k else out
        out = out.mapInArrow(_clean(context.broadcast(block)), docs.schema)
    return out


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return digest(found)


def digest(found: DataFrame) -> DataFrame:
    hit = F.expr("aggregate(sequence(0, size(hit_intervals) div 2), 0L, (s, k) -> s + if(2 * k + 1 < size(hit_intervals), hit_intervals[2 * k + 1] - hit_intervals[2 * k], 0L))")
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


OP1_SQL = r"""
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents, letters),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark, letters),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
owners AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN owners USING (doc_id)
"""
