"""Periodic runs of words by online dyadic square catching.

Words are appended to a growing sequence.  For every power of two B, each aligned block of B words gets a catcher when it
is complete; it waits for the block's return at a distance q from 2B - 1 to 4B - 2, the distances at which the first
half of a square must hold a whole aligned block.  An appended word thus closes one window a level and is held against
exactly two catchers there.  A return is stretched both ways by suffix comparisons; a stretch of at least 2q words
is a family of squares of period q, and such squares merge into one run.  Stretches that reach the last word stay open and are
carried on by the next append, so after each append all squares of the words so far are known.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightsieve.llm.bytes_hash import BASE, INVERSE, U, mix
from nightsieve.llm.common import map_batches

CHUNK_WORDS = 1 << 17


class SquareCatcher:
    """Runs of a sequence of integers that arrives in pieces of any size.

    `append` takes the next words; `runs` returns (start, end, period) of every maximal stretch that is at least twice as long as
    its smallest period, of the words so far, in order of start, then period.  `longest` bounds the periods looked for.
    """

    def __init__(self, longest: int | None = None) -> None:
        self.longest = longest
        self.size = 0
        self.words = np.empty(1024, np.int64)
        self.sums = np.zeros(1025, U)
        self.up, self.down = np.ones(1, U), np.ones(1, U)
        self.found = np.empty((0, 3), np.int64)  # start, end, period; one that ends at `size` is still open, and may be no square yet

    def _grow(self, extra: int) -> None:
        need = self.size + extra
        if need > len(self.words):
            room = max(need, 2 * len(self.words))
            self.words = np.concatenate((self.words[:self.size], np.empty(room - self.size, np.int64)))
            self.sums = np.concatenate((self.sums[:self.size + 1], np.empty(room - self.size, U)))
        if len(self.up) <= len(self.words):
            for name, base in (("up", BASE), ("down", INVERSE)):
                steps = np.full(len(self.words) + 1, U(base))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def _hash(self, start: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + width] - self.sums[start]) * self.down[start]

    def _windows(self, first: int, last: int, width: int) -> np.ndarray:
        """Hashes of the windows that start at `first` to `last` - 1."""
        return (self.sums[first + width:last + width] - self.sums[first:last]) * self.down[first:last]

    def _common(self, left: np.ndarray, right: np.ndarray, room: np.ndarray, forward: bool) -> np.ndarray:
        """How many words agree from two places on, or before them, at most `room`: one comparison a power of two."""
        same = np.zeros(len(left), np.int64)
        step = 1
        live = np.arange(len(left))
        reach = {}
        while len(live):  # double until the stretches differ
            live = live[same[live] + step <= room[live]]
            a, b = left[live], right[live]
            if forward:
                hit = self._hash(a + same[live], step) == self._hash(b + same[live], step)
            else:
                hit = self._hash(a - same[live] - step, step) == self._hash(b - same[live] - step, step)
            live = live[hit]
            same[live] += step
            reach[step] = live
            step *= 2
        while step > 1:  # then halve
            step //= 2
            live = np.flatnonzero(same + step <= room)
            a, b = left[live], right[live]
            if forward:
                hit = self._hash(a + same[live], step) == self._hash(b + same[live], step)
            else:
                hit = self._hash(a - same[live] - step, step) == self._hash(b - same[live] - step, step)
            same[live[hit]] += step
        return same

    def append(self, words: np.ndarray) -> None:
        if not len(words):
            return
        old = self.size
        self._grow(len(words))
        self.size = new = old + len(words)
        self.words[old:new] = words
        value = mix(words.astype(U) + U(BASE))
        self.sums[old + 1:new + 1] = self.sums[old] + np.cumsum(value * self.up[old:new])
        if len(self.found):  # open stretches go on
            live = np.flatnonzero(self.found[:, 1] == old)
            period = self.found[live, 2]
            self.found[live, 1] += self._common(np.full(len(live), old) - period, np.full(len(live), old), np.full(len(live), new - old), True)
        longest = self.longest or new
        near = np.zeros(new + 1, np.int64)  # by place: where runs of two levels below end
        levels: list[np.ndarray] = []
        block = 1
        while 2 * block - 1 <= min(longest, new - block):
            if len(levels) >= 2:
                small = np.concatenate((levels[-2], self.found[self.found[:, 2] <= block - 2]))
                small = small[small[:, 1] - small[:, 0] >= 2 * small[:, 2]]
                np.maximum.at(near, small[:, 0], small[:, 1])
                reach = np.maximum.accumulate(near)
            else:
                reach = near
            levels.append(self._level(block, old, new, reach))
            block *= 2
        self._merge(levels)

    def _level(self, block: int, old: int, new: int, reach: np.ndarray) -> np.ndarray:
        """Stretches of the windows that the new words close, against the two catchers of each."""
        nothing = np.empty((0, 3), np.int64)
        first, last = max(old - block + 1, 2 * block - 1, 0), new - block + 1
        if last <= first:
            return nothing
        place = np.arange(first, last)
        now = self._windows(first, last, block)
        near = (place - (2 * block - 1)) // block  # number of the nearer catcher's block
        low = max(int(near[0]) - 1, 0)
        marks = np.arange(low, int(near[-1]) + 1) * block
        held = self._hash(marks, block)
        starts, ends = [], []
        for back in (0, 1):
            at = near - back
            good = np.flatnonzero(at >= 0) if back and near[0] < 1 else slice(None)
            hit = np.flatnonzero(now[good] == held[at[good] - low])
            hit = hit if isinstance(good, slice) else good[hit]
            c, p = at[hit] * block, place[hit]
            fresh = reach[c] < p + block  # inside a run of smaller period there is nothing new
            starts.append(c[fresh])
            ends.append(p[fresh])
        c, p = np.concatenate(starts), np.concatenate(ends)
        if not len(c):
            return nothing
        order = np.lexsort((c, p - c))  # a return of the block just before at the same distance is the same stretch
        c, p = c[order], p[order]
        fresh = np.ones(len(c), bool)
        fresh[1:] = (c[1:] != c[:-1] + block) | (p[1:] != p[:-1] + block)
        c, p = c[fresh], p[fresh]
        before = self._common(c, p, c, False)
        after = self._common(c + block, p + block, new - p - block, True)
        start, end, period = c - before, p + block + after, p - c
        keep = ((end - start >= 2 * period) | (end == new)) & (period <= (self.longest or new))
        return np.unique(np.stack((start[keep], end[keep], period[keep]), 1), axis=0)

    def _merge(self, levels: list[np.ndarray]) -> None:
        """One row for each stretch of a square or more, with its smallest period, and all shorter ones that are still open."""
        rows = np.concatenate((self.found, *levels))
        square = rows[:, 1] - rows[:, 0] >= 2 * rows[:, 2]
        rows, square = rows[square | (rows[:, 1] == self.size)], square[square | (rows[:, 1] == self.size)]
        order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
        rows, square = rows[order], square[order]
        if len(rows):
            fresh = np.ones(len(rows), bool)
            same = (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] == rows[:-1, 1])
            fresh[1:] = ~(same & (square[1:] | (rows[1:, 2] == rows[:-1, 2])))
            rows = rows[fresh]
        self.found = rows

    def runs(self) -> np.ndarray:
        """Rows (start, end, period), each held against the words themselves."""
        rows = self.found[self.found[:, 1] - self.found[:, 0] >= 2 * self.found[:, 2]]
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
        good = [np.array_equal(self.words[s:e - q], self.words[s + q:e]) for s, e, q in rows.tolist()]
        return rows[np.array(good, bool)] if len(rows) else rows


def _described(words: list[bytes], runs: np.ndarray, collapse: bool):
    """Digest columns of one text from its runs (start, end, period)."""
    listed = runs.tolist()
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in listed)
    best = max(listed, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    kept = words
    if listed:
        gone = np.zeros(len(words) + 1, np.int64)
        for s, e, q in listed:
            gone[s + q] += 1
            gone[e] -= 1
        kept = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
    text = b" ".join(kept)
    head = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    told = [{"start": s, "length": e - s, "period": q} for s, e, q in listed]
    return (len(words), told, *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest(),
            text.decode() if collapse else None)


FIELDS = ["n_words", "runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed"]
RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _texts_of(column: pa.Array) -> Iterator[list[bytes]]:
    for text in column:
        yield text.as_py().encode().split() if text.is_valid else []


def _in_chunks(column: pa.Array) -> Iterator[list[list[bytes]]]:
    """Texts' words, some texts at a time; a longer text comes alone."""
    held: list[list[bytes]] = []
    size = 0
    for words in _texts_of(column):
        if held and size + len(words) > CHUNK_WORDS:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words) + 1
    if held:
        yield held


def runs_of(texts: list[list[bytes]], least: int, twice: int) -> list[np.ndarray]:
    """The runs of each text.  Texts are appended to one sequence, each closed by a word of its own, which no run can hold."""
    number: defaultdict[bytes, int] = defaultdict(count(1).__next__)
    catcher = SquareCatcher(max((len(w) // twice for w in texts), default=0) or None)
    if not any(len(w) >= least for w in texts):
        return [np.empty((0, 3), np.int64) for _ in texts]
    flat: list[int] = []
    edge = [0]
    for k, words in enumerate(texts):
        flat.extend(map(number.__getitem__, words))
        flat.append(-k - 1)
        edge.append(len(flat))
    for at in range(0, len(flat), CHUNK_WORDS):
        catcher.append(np.array(flat[at:at + CHUNK_WORDS], np.int64))
    rows = catcher.runs()
    length = rows[:, 1] - rows[:, 0]
    rows = rows[length >= np.maximum(least, twice * rows[:, 2])]
    cut = np.searchsorted(rows[:, 0], edge)
    return [rows[a:b] - np.array([e, e, 0]) for a, b, e in zip(cut[:-1], cut[1:], edge)]


def _found(batch: pa.RecordBatch, least: int, twice: int, collapse: bool):
    at = 0
    for texts in _in_chunks(batch.column(1)):
        rows = [_described(words, runs, collapse) for words, runs in zip(texts, runs_of(texts, least, twice))]
        cols = list(zip(*rows))
        kinds = [pa.int64(), RUN, *[pa.int64()] * 4, *[pa.string()] * 3]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).slice(at, len(rows)), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["id", *FIELDS])
        at += len(rows)


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12, twice: int = 2, collapse: bool = False
) -> DataFrame:
    """(id, n_words, runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, collapsed) per row.

    Words are runs of bytes outside space and 09-0D, case kept; null is a text without words.  A run is a stretch of words
    with smallest period q that is at least `least` and `twice` * q words long and that no neighbour extends.  `runs` lists all, by
    start, then period; the four figures are those of the longest (ties: least start, then period), null without a run.
    `collapsed`, given on demand, is the text without the words that some run holds after its first q words.  Each row is
    judged alone, so repeated rows, null ids and extra columns do no harm; an empty table gives no row.
    """
    if twice < 2:
        raise ValueError("a run repeats its period at least twice")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = ("id long, n_words long, runs array<struct<start:long,length:long,period:long>>, start long, length long, period long, "
              "exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string")
    return map_batches(source, partial(_found, least=least, twice=twice, collapse=collapse), schema).withColumnRenamed("id", id_col)
