"""Packing of token sequences by non-negative least squares over length patterns."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nightsieve.llm.common import map_batches, map_partitions, staged
from nightsieve.llm.tokens import encoder

Run = tuple[tuple[int, ...], int]  # lengths, repeats


def patterns(lengths: np.ndarray, size: int, each: int = 6, turn: int = 0) -> np.ndarray:
    """Multisets of two or three of `lengths` that fill `size` exactly, as rows in falling order, 0 for none.

    All pairs, and for each longest length up to `each` triples, evenly spaced over all there are, others at another `turn`: with few
    patterns the fitted repeats are large and lose little when rounded.
    """
    has = np.zeros(size + 1, bool)
    has[lengths] = True
    out = []
    for a in lengths[::-1]:
        rest = size - a
        if 0 < rest <= a and has[rest]:
            out.append((a, rest, 0))
        b = np.arange(max(1, (rest + 1) // 2), min(a, rest - 1) + 1)
        b = b[has[b] & has[rest - b]] if len(b) else b
        if len(b) > each:
            b = b[((np.arange(each) + (turn * 0.37 + 0.5) % 1) * len(b) / each).astype(int)]
        out.extend((int(a), int(x), int(rest - x)) for x in b)
    return np.array(out, np.int64).reshape(-1, 3)


def nonnegative_fit(rows: np.ndarray, target: np.ndarray, rounds: int = 1500) -> np.ndarray:
    """Repeat counts x >= 0 that bring the lengths used by patterns near `target` in the least-squares sense.

    Accelerated projected gradient steps; the step comes from a few power iterations.
    """
    if not len(rows):
        return np.zeros(0)
    n = len(target)
    care = (np.arange(n) > 0).astype(float)
    use = lambda x: np.bincount(rows.reshape(-1), np.repeat(x, rows.shape[1]), n) * care
    back = lambda y: (y * care)[rows].sum(axis=1)
    v = np.ones(len(rows))
    for _ in range(20):
        v = back(use(v / np.linalg.norm(v)))
    step = 1 / (1.05 * np.linalg.norm(v))
    scale = max(1.0, float(target.max()))
    goal = target * care / scale
    x = y = np.zeros(len(rows))
    pace = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(use(y) - goal))
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        y = new + (pace - 1) / faster * (new - x)
        x, pace = new, faster
    return x * scale


def best_fit(left: np.ndarray, size: int) -> list[Run]:
    """Pack what is left, longest first, each into the fullest open sequences with room; equal sequences go together."""
    open_: dict[int, list[Run]] = {}
    done: list[Run] = []
    for length in range(size, 0, -1):
        count = int(left[length])
        while count:
            room = next((r for r in range(length, size) if open_.get(r)), 0)
            if not room:
                fit = min(size // length, count)
                repeats = count // fit
                spare = size - fit * length
                (open_.setdefault(spare, []) if spare else done).append(((length,) * fit, repeats))
                count -= fit * repeats
                continue
            lengths, repeats = open_[room].pop()
            used = min(repeats, count)
            if repeats > used:
                open_[room].append((lengths, repeats - used))
            spare = room - length
            (open_.setdefault(spare, []) if spare else done).append(((*lengths, length), used))
            count -= used
    return done + [run for runs in open_.values() for run in runs]


def plan(counts: np.ndarray, size: int) -> list[Run]:
    """Runs of equal sequences that hold `counts[length]` pieces of each length; its size depends on `size` alone.

    The fit's repeats are rounded down where pieces run out; best fit packs the residue.
    """
    left = counts.astype(np.int64).copy()
    out: list[Run] = []
    for turn in range(4):  # what rounding leaves is fitted again
        lengths = np.flatnonzero(left[:size])
        rows = patterns(lengths[lengths > 0], size, turn=turn)
        repeats = nonnegative_fit(rows, left[:size].astype(float))
        for k in np.argsort(-repeats, kind="stable"):
            if repeats[k] < 0.5:
                break
            used = [int(x) for x in rows[k] if x]
            times = min([int(round(repeats[k])), *(int(left[x]) // used.count(x) for x in set(used))])
            if times > 0:
                for x in used:
                    left[x] -= times
                out.append((tuple(used), times))
    return out + best_fit(left, size)


class Places:
    """Where the n-th piece of a length goes: one sorted table of the first pieces of each stretch."""

    def __init__(self, runs: list[Run]) -> None:
        key, sequence, offset = [], [], []
        met: dict[int, int] = {}
        base = 0
        for lengths, times in runs:
            at = 0
            for x in lengths:
                key.append((x << 44) + met.get(x, 0))
                sequence.append(base)
                offset.append(at)
                met[x] = met.get(x, 0) + times
                at += x
            base += times
        order = np.argsort(np.array(key, np.int64), kind="stable")
        self.key, self.sequence, self.offset = (np.array(v, np.int64)[order] for v in (key, sequence, offset))

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spot = np.searchsorted(self.key, (length << 44) + number, "right") - 1
        return self.sequence[spot] + (length << 44) + number - self.key[spot], self.offset[spot]


FIELDS = ["id", "piece", "start", "length", "ids_crc32", "chunk", "number"]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, size: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of each text, numbered within this partition for each length."""
    chunk = TaskContext.get().partitionId()
    met = np.zeros(size + 1, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            ids, bounds = encoder(path).encode(part.column(1).to_pylist())
            rows: list[tuple] = []
            raw: list[bytes] = []
            for row, name in enumerate(part.column(0).to_pylist()):
                own = np.append(ids[bounds[row]:bounds[row + 1]], end_id).astype("<u4")
                first = len(own) % size or min(size, len(own))
                start, piece = 0, 0
                while start < len(own):
                    length = first if piece == 0 else size
                    body = own[start:start + length].tobytes()
                    rows.append((name, piece, start, length, zlib.crc32(body), chunk, int(met[length])))
                    if keep_ids:
                        raw.append(body)
                    met[length] += 1
                    start, piece = start + length, piece + 1
            columns = [pa.array(v, pa.int32() if k == 1 else pa.int64()) for k, v in enumerate(zip(*rows))]
            if keep_ids:
                columns.append(pa.array(raw, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [*FIELDS, *["ids"] * keep_ids])


def _placed(batch: pa.RecordBatch, places: Places):
    sequence, offset = places.find(batch.column("length").to_numpy(), batch.column("number").to_numpy())
    names = [n for n in batch.schema.names if n != "number"]
    yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, keep_ids: bool = False
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and `ids`, little-endian 32-bit).

    A text is its ids and `end_id`; null and empty texts are the end id alone.  Only texts above `size` ids are cut, with
    the first piece the shorter one.  Only the histogram of piece lengths, at most `size` numbers, meets the driver: patterns
    of two or three lengths that fill a sequence are enumerated, repeats fitted to the histogram by non-negative least squares
    and rounded, residues packed by best fit.  The n-th piece of a length then looks its place up in the runs of the plan.
    Ids are integers and may repeat, then each row is packed.  An empty table gives no row.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kind = "id long, piece int, start long, length long, ids_crc32 long, chunk long, number long" + ", ids binary" * keep_ids
    rows = staged(map_partitions(source, partial(_pieces, path=tokenizer, end_id=end_id, size=size, keep_ids=keep_ids), kind), "pieces")
    full = rows.where(F.col("length") == size)
    short = rows.where(F.col("length") < size)
    counts = short.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    places = docs.sparkSession.sparkContext.broadcast(Places(plan(histogram, size)))
    before = F.sum("n").over(W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("length", "chunk", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = short.join(counts, ["length", "chunk"]).withColumn("number", F.col("number") + F.col("before"))
    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    kinds = "id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    placed = map_batches(numbered.select(*names, "number"), lambda b: _placed(b, places.value), kinds + ", sequence_id long, offset long")
    # a whole piece is a sequence of its own; its number is below zero
    alone = full.select(*names, (-1 - F.shiftleft("chunk", 36) - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone).withColumnRenamed("id", id_col)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences, from pieces with their ids."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("h")))).alias("p"))
    return parts.select("sequence_id", F.unhex(F.concat_ws("", F.col("p.h"))).alias("ids"))
