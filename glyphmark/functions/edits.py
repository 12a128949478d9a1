"""Edit distances of texts of any length, by code points or by words, in memory that grows with the text.

Short pairs stay in the JVM.  Longer ones go through Arrow to one of two exact methods.  Texts that
differ little: the farthest place each diagonal reaches with 0, 1, 2, ... edits, in time of the
length plus the square of the distance.  Texts that differ much: the columns of the edit table as bit
vectors, whose differences are all of a column's state; a column costs a few operations on one
long integer.  Words are numbered in a table of their pair, so any number of them is told apart.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Pairs whose longer side has at most so many code points or words stay in the JVM.
SHORT, SHORT_WORDS = 400, 60
UNIT, FREQUENT = 4, 256


def _same_ahead(a: bytes, i: int, b: bytes, j: int) -> int:
    """How many units agree from the i-th of a and the j-th of b on."""
    most = min(len(a) // UNIT - i, len(b) // UNIT - j)
    done, step = 0, 8
    while done < most:
        step = min(step, most - done)
        x, y = (i + done) * UNIT, (j + done) * UNIT
        if a[x : x + step * UNIT] == b[y : y + step * UNIT]:
            done, step = done + step, 2 * step
        elif step == 1:
            break
        else:
            most, step = done + step, step // 2
    return done


def near_distance(a: bytes, b: bytes, limit: int) -> int | None:
    """The distance if it is at most limit, by farthest places on diagonals."""
    n, m = len(a) // UNIT, len(b) // UNIT
    if abs(n - m) > limit:
        return None
    before: dict[int, int] = {}
    for edits in range(limit + 1):
        now: dict[int, int] = {}
        for d in range(-edits, edits + 1):
            if not -n <= d <= m:
                continue
            if edits:
                # d = place in b - place in a: a step in a, in b or in both is one edit.
                i = max(before.get(d, -2) + 1, before.get(d + 1, -2) + 1, before.get(d - 1, -2))
                i = min(i, n, m - d)
            else:
                i = 0
            if i < 0 or i + d < 0:
                continue
            i += _same_ahead(a, i, b, i + d)
            if i == n and i + d == m:
                return edits
            now[d] = i
        before = now
    return None


def far_distance(a: Sequence, b: Sequence) -> int:
    """The distance by bit vectors of the differences down each column; a's units are bits."""
    if not a:
        return len(b)
    places: dict = defaultdict(list)
    for k, unit in enumerate(a):
        places[unit].append(k)

    def mask(at: Sequence[int]) -> int:
        bits = bytearray(len(a) // 8 + 1)
        for k in at:
            bits[k >> 3] |= 1 << (k & 7)
        return int.from_bytes(bits, "little")

    # Kept for frequent units only, FREQUENT of them at most: their masks take memory in proportion to a.
    masks = {unit: mask(at) for unit, at in places.items() if len(at) * FREQUENT >= len(a)}
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for unit in b:
        equal = masks.get(unit)
        if equal is None:
            equal = mask(places[unit]) if unit in places else 0
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        up = (up << 1 | 1) & full
        down = down << 1 & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
    return score


def distance(a: bytes, b: bytes) -> int:
    """Of two runs of units of four bytes."""
    ahead = _same_ahead(a, 0, b, 0) * UNIT
    a, b = a[ahead:], b[ahead:]
    if not a or not b:
        return max(len(a), len(b)) // UNIT
    # As many edits as cost about what the bit vectors would.
    limit = 32 + int((len(b) // UNIT * (1 + len(a) // UNIT / 4096)) ** 0.5)
    found = near_distance(a, b, limit)
    if found is not None:
        return found
    short, long = sorted((memoryview(a).cast("I"), memoryview(b).cast("I")), key=len)
    return far_distance(short.tolist(), long.tolist())


def _code_points(text: str) -> bytes:
    return text.encode("utf-32-le", "surrogatepass")


def _numbered(a: list[str], b: list[str]) -> tuple[bytes, bytes]:
    table: dict[str, int] = {}
    code = lambda words: b"".join(table.setdefault(w, len(table)).to_bytes(UNIT, "little") for w in words)
    return code(a), code(b)


def _pairwise(measure):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else measure(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int64())

    return run


_text_edits = F.arrow_udf(_pairwise(lambda x, y: distance(_code_points(x), _code_points(y))), LongType())
_word_edits = F.arrow_udf(_pairwise(lambda x, y: distance(*_numbered(x, y))), LongType())


def text_edits(a: Column, b: Column) -> Column:
    """Inserted, deleted and replaced code points; null for a null."""
    short = F.greatest(F.length(a), F.length(b)) <= SHORT
    return F.when(short, F.levenshtein(a, b).cast("long")).otherwise(_text_edits(F.when(~short, a), F.when(~short, b)))


def word_edits(a: Column, b: Column) -> Column:
    """The same of two arrays of words; few words are numbered by one code point each in the JVM."""
    short = F.greatest(F.size(a), F.size(b)) <= SHORT_WORDS
    both = F.array_distinct(F.concat(a, b))
    coded = lambda words: F.array_join(F.transform(words, lambda w: F.char(F.lit(33) + F.array_position(both, w))), "")
    return F.when(short, F.levenshtein(coded(a), coded(b)).cast("long")).otherwise(_word_edits(F.when(~short, a), F.when(~short, b)))
