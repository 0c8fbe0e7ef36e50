"""Repeated-passage removal by merging Burrows-Wheeler transforms of shards.

Every `length`-byte string has an anchor: the least of its 64-byte window hashes.  Equal strings have equal anchors, so
strings are dealt out by anchor; the starts that share an anchor form a short context.  Equal contexts are one class.  Only contexts
whose anchor has several classes need sorting: each group of anchors forms shards, each shard gets the Burrows-Wheeler
transform of its contexts over symbols of `length / depth` bytes (one string for each phase), and the transforms are merged
by interleave refinement: one symbol a round, each round a stable distribution of the interleave by preceding symbol.
Where neighbours first differ gives the common prefix; runs with a prefix of `depth` symbols are the repeated intervals.

An anchor with very many different contexts, as in a passage that many texts share, is split before: windows that are common among
its contexts no longer serve, and the nearest of the others beside the anchor is the second anchor of a string (none, where all are common).  This
too hangs on the string alone, so equal strings stay together, and what surrounds the passage spreads the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightsieve.llm.bytes_hash import BASE, U, RangeHash, chunks, mix, texts
from nightsieve.llm.common import map_batches, map_partitions, small_side, staged

WINDOW = 64
PLACES = U((1 << 28) - 1)
SHARDS = 4
GROUP_BYTES = 1 << 19
#: Ids of texts, of 8 bytes, that are broadcast to choose the texts before a shuffle.
SHORT_LIST = 500_000
#: Starts of a text that are handled at a time.
STRETCH = 1 << 22
#: Different contexts from which an anchor is split, contexts looked at to find its common windows, and rounds of splitting.
CROWD, LOOKED_AT, SPLITS = 2000, 48, 3


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values: running minima from both ends of blocks of `width`."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, values.dtype)
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int):
    """(text number, first start, count of starts, anchor hash, context hash) of each context.

    A context is a run of starts whose strings have the same anchor at the same place; it ends `length` after the last.
    """
    ranges = RangeHash(data)
    reach = length - WINDOW + 1
    hashes = ranges.windows(WINDOW)
    empty = np.empty(0, np.int64)
    if len(hashes) < reach:
        return empty, empty, empty, np.empty(0, U), np.empty(0, U)
    # of equal leading bits the last place wins, so the choice hangs on the string alone
    packed = (hashes & ~PLACES) | (PLACES - np.arange(len(hashes), dtype=np.uint64))
    pick = (PLACES - (_sliding_least(packed, reach) & PLACES)).astype(np.int64)
    last = np.repeat(bounds[1:], np.diff(bounds)) - length
    start = np.arange(len(pick), dtype=np.int64)
    good = start <= last[:len(pick)]
    text = np.repeat(np.arange(len(bounds) - 1, dtype=np.int64), np.diff(bounds))[:len(pick)]
    new = np.ones(len(pick), bool)
    new[1:] = (pick[1:] != pick[:-1]) | ~good[:-1] | (text[1:] != text[:-1])
    first = np.flatnonzero(new & good)
    if not len(first):
        return empty, empty, empty, np.empty(0, U), np.empty(0, U)
    run = np.cumsum(new & good)[good] - 1
    count = np.bincount(run, minlength=len(first))
    end = first + count - 1 + length
    return text[first], first - bounds[text[first]], count, hashes[pick[first]], ranges(first, end) ^ (pick[first] - first).astype(U)


def _anchor_rows(batch: pa.RecordBatch, length: int):
    data, bounds = texts(batch.column(1))
    ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
    for i, j in chunks(bounds):
        for at in range(0, max(1, int(bounds[j] - bounds[i])), STRETCH) if j == i + 1 else (0,):  # long texts in stretches that overlap
            first, last = bounds[i] + at, min(bounds[j], bounds[i] + at + STRETCH + length - 1) if j == i + 1 else bounds[j]
            edges = bounds[i:j + 1] - bounds[i] if j > i + 1 else np.array([0, last - first])
            who, start, count, anchor, context = anchors(data[first:last], edges, length)
            if len(who):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i + who]), pa.array(start + at), pa.array(count.astype(np.int64)), pa.array(anchor.view(np.int64)),
                     pa.array(context.view(np.int64))],
                    ["id", "start", "count", "anchor", "context"],
                )


def second_anchors(data: np.ndarray, count: int, length: int, common: np.ndarray):
    """(start, count, second anchor, context hash) of the parts of a context.

    A string's second anchor is the last window before its anchor that is not in `common`, else the first such one
    behind it, else 0: at most three parts.
    """
    ranges = RangeHash(data)
    hashes = ranges.windows(WINDOW)
    head = hashes[:length - WINDOW + 1]
    spot = int(np.argmin((head & ~PLACES) | (PLACES - np.arange(len(head), dtype=np.uint64))))  # the anchor of all these strings
    rare = np.flatnonzero(~np.isin(hashes, common))
    left, right = rare[rare < spot][-1:], rare[rare > spot][:1]
    edges = {0, *(left + 1).tolist(), *(right - (length - WINDOW)).tolist()}
    first = np.array(sorted(e for e in edges if 0 <= e < count), np.int64)
    size = np.diff(np.append(first, count))
    second, place = np.zeros(len(first), U), np.full(len(first), -1)
    for k, at in enumerate(first.tolist()):
        near = left[left >= at][:1] if len(left) else left
        near = near if len(near) else right[right <= at + length - WINDOW][:1]
        if len(near):
            second[k], place[k] = hashes[near[0]], near[0] - at
    return first, size, second, ranges(first, first + size - 1 + length) ^ (place + 1).astype(U) ^ (U(spot) - first.astype(U) << U(32))


def _split(batch: pa.RecordBatch, length: int):
    """The parts of the contexts of crowded anchors, under their second anchors."""
    data, bounds = texts(batch.column("text"))
    for row, (name, parts) in enumerate(zip(batch.column("id").to_pylist(), batch.column("parts").to_pylist())):
        for part in parts:
            at, anchor = bounds[row] + part["start"], np.array([part["anchor"]]).view(U)
            raw = data[at:at + part["count"] - 1 + length]
            first, size, second, context = second_anchors(raw, part["count"], length, np.array(part["common"], np.int64).view(U))
            n = len(first)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part["anchor"]] * n, pa.int64()), pa.array([part["context"]] * n, pa.int64()), pa.array([part["copies"]] * n, pa.int64()),
                 pa.array(first), pa.array([name] * n, pa.int64()), pa.array(first + part["start"]), pa.array(size.astype(np.int64)),
                 pa.array(mix(second * U(BASE) + mix(anchor + U(1))).view(np.int64)), pa.array(context.view(np.int64))],
                ["anchor", "context", "copies", "off", "id", "start", "count", "part_anchor", "part_context"])


def _windows_of(batch: pa.RecordBatch, length: int):
    """The different windows of each sampled context."""
    data, bounds = texts(batch.column("text"))
    for row, parts in enumerate(batch.column("parts").to_pylist()):
        for part in parts:
            at = bounds[row] + part["start"]
            found = np.unique(RangeHash(data[at:at + part["count"] - 1 + length]).windows(WINDOW))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), part["anchor"])), pa.array(found.view(np.int64))], ["anchor", "window"])


class Transform:
    """A shard's Burrows-Wheeler transform: the symbol before each suffix, in suffix order, 0 at a string's start."""

    def __init__(self, before: np.ndarray, origin: np.ndarray, strings: int) -> None:
        self.before, self.origin, self.strings = before, origin, strings


def build(symbol: np.ndarray, follow: np.ndarray, lead: np.ndarray, strings: int, longest: int) -> Transform:
    """The transform of one shard.

    Suffixes 0 to strings - 1 are the strings' ends, symbol 0, in string order before all others; `follow` is the
    suffix one symbol shorter (of an end: itself), `lead` the one that is longer, -1 for a whole string.
    """
    n = len(symbol)
    rank = symbol + strings - 1
    rank[:strings] = np.arange(strings)
    for _ in range(longest):
        key = symbol * np.int64(n) + rank[follow]
        key[:strings] = np.arange(strings)
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
    origin = np.argsort(rank)
    return Transform(np.where(lead >= 0, symbol[lead], 0)[origin], origin, strings)


def merge(parts: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each row of the merged order, common prefix with the row before, at most `depth` symbols).

    The interleave begins with one shard after another.  A round walks it and deals each row, by the symbol before
    it, to that symbol's bucket: the interleave of the longer suffixes, right by one more symbol.  The strings' ends keep the
    places at the top.  A bucket's new border, where rows come from different blocks, shows where prefixes first differ.
    """
    ends = sum(p.strings for p in parts)
    total = sum(len(p.before) for p in parts)
    top = np.repeat(np.arange(len(parts)), [p.strings for p in parts])
    inter = np.repeat(np.arange(len(parts)), [len(p.before) for p in parts])
    prefix = np.full(total, depth, np.int64)
    prefix[:ends + 1] = 0
    block = np.zeros(total, np.int64)
    before = np.empty(total, np.int64)
    for turn in range(depth):
        for shard, part in enumerate(parts):
            before[inter == shard] = part.before
        live = np.flatnonzero(before)
        order = live[np.argsort(before[live] * np.int64(total) + live)]
        inter = np.concatenate((top, inter[order]))
        came, bucket = block[order], before[order]
        border = np.flatnonzero((came[1:] != came[:-1]) | (bucket[1:] != bucket[:-1])) + ends + 1
        fresh = border[prefix[border] == depth]
        prefix[fresh] = turn
        opens = prefix < depth
        block = np.cumsum(opens)
    return inter, prefix


def repeated_starts(data: np.ndarray, bounds: np.ndarray, counts: np.ndarray, shard: np.ndarray, length: int, depth: int) -> np.ndarray:
    """Of each context's `counts` first places, one after another: does the string there also start elsewhere?"""
    step = length // depth
    size = np.diff(bounds)
    hashes = RangeHash(data).windows(step)
    phases = np.minimum(counts, step)
    owner = np.repeat(np.arange(len(counts)), phases)
    phase = np.arange(len(owner)) - np.repeat(np.cumsum(phases) - phases, phases)
    links = (size[owner] - phase) // step  # symbols of each string
    _, symbol_of = np.unique(hashes, return_inverse=True)
    base = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(int(base[-1]), bool)
    parts, places = [], []
    for s in range(SHARDS):
        mine = np.flatnonzero(shard[owner] == s)
        if not len(mine):
            continue
        n, strings = links[mine], len(mine)
        string = np.repeat(np.arange(strings), n)
        nth = np.arange(len(string)) - np.repeat(np.cumsum(n) - n, n)
        where = bounds[owner[mine]][string] + phase[mine][string] + nth * step
        row = strings + np.arange(len(string))
        symbol = np.concatenate((np.zeros(strings, np.int64), symbol_of[where] + 1))
        last = nth == n[string] - 1
        follow = np.concatenate((np.arange(strings), np.where(last, string, row + 1)))
        lead = np.concatenate((strings + np.cumsum(n) - 1, np.where(nth == 0, -1, row - 1)))
        parts.append(build(symbol, follow, lead, strings, int(n.max())))
        place = where - bounds[owner[mine]][string]
        start = np.where(place < counts[owner[mine]][string], base[owner[mine]][string] + place, -1)
        places.append(np.concatenate((np.full(strings, -1), start)))
    inter, prefix = merge(parts, depth)
    place = np.empty(len(inter), np.int64)
    for s, part in enumerate(parts):
        place[inter == s] = places[s][part.origin]
    same = prefix >= depth
    same |= np.append(prefix[1:] >= depth, False)
    hit = place[same]
    out[hit[hit >= 0]] = True
    return out


def _extract(batch: pa.RecordBatch):
    """The bytes of the wanted contexts of each text."""
    data, bounds = texts(batch.column("text"))
    for row, wanted in enumerate(batch.column("wanted").to_pylist()):
        if not wanted:
            continue
        at = bounds[row]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w["anchor"] for w in wanted], pa.int64()), pa.array([w["context"] for w in wanted], pa.int64()),
             pa.array([w["count"] for w in wanted], pa.int64()),
             pa.array([data[at + w["start"]:at + w["end"]].tobytes() for w in wanted], pa.binary())],
            ["anchor", "context", "count", "content"],
        )


def _runs(flags: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [{"first": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]


RUNS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _groups(batches: Iterator[pa.RecordBatch], length: int, depth: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: judge whole anchors, about `GROUP_BYTES` at a time."""
    held: list[pa.RecordBatch] = []
    kept = 0

    def judge(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        data, bounds = texts(rows.column("content"))
        counts = rows.column("count").to_numpy()
        context = rows.column("context").to_numpy()
        flags = repeated_starts(data, bounds, counts, np.abs(context) % SHARDS, length, depth)
        at = np.concatenate(([0], np.cumsum(counts)))
        runs = [_runs(flags[a:b]) for a, b in zip(at[:-1], at[1:])]
        one = lambda name: rows.column(name).combine_chunks()
        return pa.RecordBatch.from_arrays([one("anchor"), one("context"), pa.array(runs, RUNS)], ["anchor", "context", "runs"])

    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            held.append(part)
            kept += part.column("content").nbytes
            if kept < GROUP_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            anchor = rows.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1], "left"))
            if cut:
                yield judge(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                kept = sum(b.column("content").nbytes for b in held)
    if held:
        rows = pa.Table.from_batches(held)
        if rows.num_rows:
            yield judge(rows)


def _kept(raw: bytes, spans: list[dict[str, int]] | None, length: int) -> tuple[bytes, int]:
    """The bytes outside all strings that start in `spans`, and the number of maximal removed runs."""
    merged: list[list[int]] = []
    for span in sorted((s["first"], s["end"] - 1 + length) for s in spans or []):
        if merged and span[0] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], span[1])
        else:
            merged.append([*span])
    left, at = [], 0
    for a, b in merged:
        left.append(raw[at:a])
        at = b
    return b"".join([*left, raw[at:]]), len(merged)


def _cut_text(batch: pa.RecordBatch, length: int, place: int):
    """The batch with cut texts, without its last column, the spans."""
    out = []
    for text, spans in zip(batch.column(place), batch.columns[-1].to_pylist()):
        cut = spans and _kept(text.as_buffer().to_pybytes(), spans, length)[0].decode(errors="ignore")
        out.append(cut if spans else text.as_py())
    columns = batch.columns[:-1]
    columns[place] = pa.array(out, pa.string())
    yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])


def with_cut_text(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """All columns of `docs`, with the repeated strings of `repeated_spans` cut from the texts."""
    spans = spans.select(F.col(id_col).alias("__id"), F.col("spans").alias("__spans"))
    rows = docs.join(spans.hint("shuffle_hash"), F.col(id_col) == F.col("__id"), "left").select(*docs.columns, "__spans")
    return map_batches(rows, partial(_cut_text, length=length, place=docs.columns.index(text_col)), docs.schema)


def _cut(batch: pa.RecordBatch, length: int):
    data, bounds = texts(batch.column("text"))
    n_bytes, n_removed, n_spans, digest, rest = [], [], [], [], []
    for row, spans in enumerate(batch.column("spans").to_pylist()):
        raw = data[bounds[row]:bounds[row + 1]].tobytes()
        kept, runs = _kept(raw, spans, length)
        n_bytes.append(len(raw))
        n_removed.append(len(raw) - len(kept))
        n_spans.append(runs)
        digest.append(hashlib.sha256(kept).hexdigest())
        rest.append(kept)
    yield pa.RecordBatch.from_arrays(
        [batch.column("id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
         pa.array(digest, pa.string()), pa.array(rest, pa.binary())],
        ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"],
    )


ROWS = "id long, start long, count long, anchor long, context long"
PARTS = "anchor long, context long, copies long, off long, id long, start long, count long, part_anchor long, part_context long"


def _classes(rows: DataFrame, copies) -> DataFrame:
    """Equal contexts as one row; anchors with a single context in all are left out."""
    classes = rows.groupBy("anchor", "context").agg(copies.alias("copies"), F.min(F.struct("id", "start", "count")).alias("first"))
    kinds = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("copies").alias("all")).where("all > 1").drop("all")
    return staged(classes.join(kinds, "anchor"), "classes")


def _per_text(source: DataFrame, parts: DataFrame, fields: list[str]) -> DataFrame:
    """(id, text, parts) of the texts that have some."""
    lists = parts.groupBy("id").agg(F.collect_list(F.struct(*fields)).alias("parts"))
    ids, local = small_side(parts.select("id").distinct(), SHORT_LIST)
    if local:  # then only the texts that are wanted are shuffled
        source = source.join(ids, "id", "left_semi")
    return source.join(lists.hint("shuffle_hash"), "id").select("id", "text", "parts")


def _spread(source: DataFrame, classes: DataFrame, length: int, crowd: int) -> DataFrame | None:
    """The parts of the contexts of anchors with more than `crowd` different ones; None without such."""
    crowded = classes.where(F.col("kinds") > crowd)
    if crowded.isEmpty():
        return None
    looked = crowded.where(F.pmod(F.xxhash64("context"), F.ceil(F.col("kinds") / LOOKED_AT)) == 0)
    looked = staged(looked.select("anchor", "first.id", "first.start", "first.count"), "looked-at")
    seen = map_batches(_per_text(source, looked, ["start", "count", "anchor"]), partial(_windows_of, length=length), "anchor long, window long")
    sizes = looked.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    common = seen.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("c")).join(sizes, "anchor").where("c > 1 and 4 * c >= n")
    common = common.groupBy("anchor").agg(F.collect_list("window").alias("common"))
    common = crowded.select("anchor").distinct().join(common, "anchor", "left")
    common = staged(common.select("anchor", F.coalesce("common", F.expr("cast(array() as array<bigint>)")).alias("common")), "common")
    parts = crowded.select("anchor", "context", "copies", "first.id", "first.start", "first.count").join(common, "anchor")
    fields = ["start", "count", "anchor", "context", "copies", "common"]
    return staged(map_batches(_per_text(source, parts, fields), partial(_split, length=length), PARTS), "split")


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, depth: int = 4, crowd: int = CROWD
) -> DataFrame:
    """(id, spans): the runs of starts of `length`-byte strings that also start elsewhere, of texts that have some."""
    if length % depth or length <= WINDOW:
        raise ValueError("length must be a multiple of depth and above the anchor's window")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    long_enough = source.where(F.col("id").isNotNull() & (F.octet_length("text") >= length))
    rows = staged(map_batches(long_enough, partial(_anchor_rows, length=length), ROWS), "anchors")
    classes = _classes(rows, F.count(F.lit(1)))
    splits = []
    for _ in range(SPLITS):
        split = _spread(long_enough, classes, length, crowd)
        if split is None:
            break
        splits.append(split)
        parts = split.select(F.col("part_anchor").alias("anchor"), F.col("part_context").alias("context"), "copies", "id", "start", "count")
        classes = classes.where(F.col("kinds") <= crowd).unionByName(_classes(parts, F.sum("copies")))

    wanted = classes.where("kinds > 1").select(
        F.col("first.id").alias("id"),
        F.struct(F.col("first.start").alias("start"), (F.col("first.start") + F.col("first.count") - 1 + length).alias("end"),
                 F.col("first.count").alias("count"), "anchor", "context").alias("w"))
    held = _per_text(long_enough, wanted.select("id", "w.*"), ["start", "end", "count", "anchor", "context"])
    held = held.select("text", F.col("parts").alias("wanted"))
    held = map_batches(held, _extract, "anchor long, context long, count long, content binary")
    dealt = held.repartition("anchor").sortWithinPartitions("anchor")
    judged = map_partitions(dealt, partial(_groups, length=length, depth=depth), "anchor long, context long, runs array<struct<first:long,end:long>>")
    ones = classes.where("copies = 1").select("anchor", "context")
    found = judged.where(F.size("runs") > 0).join(ones, ["anchor", "context"], "left_semi")
    whole = classes.where("copies > 1").select(
        "anchor", "context", F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("first.count").alias("end"))).alias("runs"))
    found = found.unionByName(whole)
    for split in reversed(splits):  # what holds for a part holds for the context that it was cut from
        below = found.select(F.col("anchor").alias("part_anchor"), F.col("context").alias("part_context"), "runs")
        moved = F.transform("runs", lambda r: F.struct((r.first + F.col("off")).alias("first"), (r.end + F.col("off")).alias("end")))
        found = found.unionByName(split.join(below, ["part_anchor", "part_context"]).select("anchor", "context", moved.alias("runs")))
    spans = rows.join(found, ["anchor", "context"]).select("id", "start", F.explode("runs").alias("run"))
    spans = spans.select("id", F.struct((F.col("start") + F.col("run.first")).alias("first"), (F.col("start") + F.col("run.end")).alias("end")).alias("s"))
    return spans.groupBy("id").agg(F.collect_list("s").alias("spans")).withColumnRenamed("id", id_col)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, depth: int = 4, crowd: int = CROWD) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes) per row.

    Removed is each byte that a `length`-byte string covers which also starts anywhere else, same text included, in
    the UTF-8 bytes of the input; null is empty.  Texts below `length` bytes lose nothing.  `kept_bytes` may be
    cut inside a character.  Ids must be distinct; rows without an id lose
    nothing and take no part; equal texts lose all their bytes; an empty table gives no row.
    """
    spans = repeated_spans(docs, id_col, text_col, length, depth, crowd).withColumnRenamed(id_col, "id")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = source.join(spans.hint("shuffle_hash"), "id", "left").select("id", "text", "spans")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary"
    return map_batches(rows, partial(_cut, length=length), schema).withColumnRenamed("id", id_col)
