"""SimHash near-dedup by anchor-point covering.

A fingerprint has 64 bits, and two are linked when at most three of them differ; then one of the two halves differs in at most one
bit (three shared out over two halves).  The anchors of a half are the words of a covering code of length 32: the Hamming code
of length 31 with one free bit, covering radius 1.  Every half has a home anchor within 1, and a half that
differs from it in one bit lies within 1 + 1 = 2 of that anchor.  So each fingerprint goes to all anchors within 2 of each of its
halves, 33 on average of 2**28, and every link is seen at the home anchor of either end.  An anchor with many homes gets a
second covering, of the other half: its 16-bit quarters, of which one differs in at most one bit, under the Hamming code of
length 15 with one free bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightsieve.llm.bytes_hash import U
from nightsieve.llm.common import map_batches, map_partitions, staged
from nightsieve.llm.components import components

SEED = 42
BITS = 3
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Hashes whose bits are counted at a time.
COUNTED = 1 << 16
#: Homes and visitors of an anchor from which it gets a second covering; cells of a block of comparisons.
BUSY = 2048
CELLS = 1 << 20


def shingle_hashes(raw: bytes, width: int) -> list[int]:
    """XXH64 of each shingle of `width` words, repeats included; fewer words: of the whole sequence."""
    words = raw.translate(_LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = (np.concatenate(([0], ends[:-1] + 1))[:len(words) - width + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1:].tolist())]


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        counts += np.unpackbits(hashes[at:at + COUNTED].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def _fingerprints(batch: pa.RecordBatch, width: int):
    found = []
    for text in batch.column(1):
        hashes = shingle_hashes(text.as_py().encode(), width) if text.is_valid else []
        found.append(fingerprint(np.array(hashes, U)))
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, U).view(np.int64))], ["id", "bits"])


def cover(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) of all code words within 2 of each word of `length` = 2**r bits.

    Bit 0 is free; bit i > 0 is column i of the parity check, so the syndrome is the sum of the numbers of the bits that are set.
    Flipping the bit that the syndrome names gives the home; the others within 2 flip that bit and bit 0, or two bits
    whose numbers sum to the syndrome.
    """
    syndrome = np.zeros(len(words), np.int64)
    for i in range(1, length):
        syndrome ^= ((words >> U(i)) & U(1)).astype(np.int64) * i
    flip = np.where(syndrome > 0, U(1) << syndrome.astype(U), U(0))
    home = words ^ flip
    every = np.arange(len(words))
    rows, anchors, homes = [every, every], [home, home ^ U(1)], [np.ones(len(words), bool), np.zeros(len(words), bool)]
    for i in range(1, length):
        other = syndrome ^ i
        live = np.flatnonzero((syndrome > 0) & (other > i))
        rows.append(live)
        anchors.append(words[live] ^ (U(1) << U(i)) ^ (U(1) << other[live].astype(U)))
        homes.append(np.zeros(len(live), bool))
    return np.concatenate(rows), np.concatenate(anchors), np.concatenate(homes)


def _to_anchors(batch: pa.RecordBatch):
    bits = batch.column("bits").to_numpy().view(U)
    for half in (0, 1):
        words = (bits >> U(32 * half)) & U(0xFFFFFFFF)
        row, anchor, home = cover(words, 32)
        key = (anchor | U(half << 32)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(np.zeros(len(key), np.int64)), pa.array(home), pa.array(bits[row].view(np.int64))], ["key", "sub", "home", "bits"])


def _to_second(batch: pa.RecordBatch):
    """The rows of busy anchors, dealt again by the quarters of the other half; homes stay homes at their own second anchor only."""
    key, home, bits = batch.column("key").to_numpy(), batch.column("home").to_numpy(zero_copy_only=False), batch.column("bits").to_numpy().view(U)
    shift = np.where(key >> 32 == 0, 32, 0).astype(U)
    for quarter in (0, 1):
        row, anchor, own = cover((bits >> (shift + U(16 * quarter))) & U(0xFFFF), 16)
        sub = (anchor | U(quarter << 16)).astype(np.int64) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[row]), pa.array(sub), pa.array(home[row] & own), pa.array(bits[row].view(np.int64))], ["key", "sub", "home", "bits"])


def _least_linked(homes: np.ndarray, others: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the links between the homes of an anchor and all its fingerprints: (fingerprint, its tree's root)."""
    every = np.unique(np.concatenate((homes, others)))
    root = np.arange(len(every))
    place = np.searchsorted(every, homes)
    step = max(1, CELLS // len(every))
    changed = True
    while changed:
        changed = False
        for at in range(0, len(homes), step):
            part = place[at:at + step]
            near = np.bitwise_count(every[part][:, None] ^ every[None, :]) <= bits
            least = np.where(near, root[None, :], len(every)).min(1)  # the smallest label near each home
            root[part] = least
            held = np.where(near, least[:, None], len(every)).min(0)  # and on to all that are near it
            low = held < root
            if low.any():
                root[low] = held[low]
                changed = True
    moved = np.flatnonzero(root != np.arange(len(every)))
    return every[moved], every[root[moved]]


def _judged(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: links inside each anchor.  Anchors of two rows, by far the most, are judged together."""
    held: list[pa.RecordBatch] = []
    size = 0

    def judge(rows: pa.Table) -> pa.RecordBatch:
        key, sub = rows.column("key").to_numpy(), rows.column("sub").to_numpy()
        home, value = rows.column("home").to_numpy(), rows.column("bits").to_numpy().view(U)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(key)))
        two = first[count == 2]
        two = two[(home[two] | home[two + 1]) & (value[two] != value[two + 1]) & (np.bitwise_count(value[two] ^ value[two + 1]) <= bits)]
        left, right = [value[two]], [value[two + 1]]
        for a, n in zip(first[count > 2].tolist(), count[count > 2].tolist()):
            own = home[a:a + n]
            if own.any():
                x, y = _least_linked(np.unique(value[a:a + n][own]), value[a:a + n], bits)
                left.append(x)
                right.append(y)
        x, y = np.concatenate(left), np.concatenate(right)
        pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), 1), axis=0) if len(x) else np.empty((0, 2), U)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], ["x", "y"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < 1 << 17:
            continue
        rows = pa.Table.from_batches(held)
        key, sub = rows.column("key").to_numpy(), rows.column("sub").to_numpy()
        cut = int(np.flatnonzero((key == key[-1]) & (sub == sub[-1]))[0])
        if cut:
            yield judge(rows.slice(0, cut))
            held = rows.slice(cut).combine_chunks().to_batches()
            size = sum(b.num_rows for b in held)
    if size:
        yield judge(pa.Table.from_batches(held))


ROWS = "key long, sub long, home boolean, bits long"


def _links(prints: DataFrame, bits: int, busy: int) -> DataFrame:
    """(x, y): pairs of distinct fingerprints that join each other's component; every link lies inside a component of them."""
    dealt = map_batches(prints, _to_anchors, ROWS)
    # an anchor without a home sees no link; one with many is split
    size = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("home").alias("has_home")).where("has_home and size > 1")
    # Spark takes the dealt rows for as many as there are fingerprints; without the hint it would send all of them through the driver
    kept = dealt.join(staged(size.select("key", "size"), "sizes").hint("shuffle_hash"), "key")
    kept = staged(kept.withColumn("busy", F.col("size") > busy).drop("size"), "anchors")
    second = map_batches(kept.where("busy").select("key", "sub", "home", "bits"), _to_second, ROWS)
    rows = kept.where("not busy").select("key", "sub", "home", "bits").unionByName(second)
    rows = rows.repartition("key", "sub").sortWithinPartitions("key", "sub")
    return map_partitions(rows, partial(_judged, bits=bits), "x long, y long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, bits: int = BITS, busy: int = BUSY
) -> DataFrame:
    """(id, fingerprint, component_id, kept) per row: components of texts whose fingerprints differ in at most `bits` bits.

    Words are runs outside space and 09-0D, A-Z lowered; a bit is set if more than half of the XXH64 hashes of the shingles of
    `width` words, repeats included, have it (fewer words: the whole sequence is the shingle).  Texts without words and nulls
    have fingerprint zero, which is linked like any other.  Equal fingerprints are one from the start.  `bits` is at most 3, what the
    anchors cover.  Ids must be distinct integers; rows without one are left out; extra columns do no harm; an empty table
    gives no row.
    """
    if not 0 <= bits <= BITS:
        raise ValueError("the anchors cover at most 3 differing bits")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    prints = staged(map_batches(source, partial(_fingerprints, width=width), "id long, bits long"), "fingerprints")
    classes = staged(prints.groupBy("bits").agg(F.min("id").alias("rep")), "classes")
    links = staged(_links(classes.select("bits"), bits, busy), "links")
    # packed files of numbers look small too, so no table that grows with the texts is left to Spark's guess
    ends = links.join(classes.select(F.col("bits").alias("x"), F.col("rep").alias("a")).hint("shuffle_hash"), "x")
    ends = ends.join(classes.select(F.col("bits").alias("y"), F.col("rep").alias("b")).hint("shuffle_hash"), "y").select("a", "b")
    found = components(ends, "a", "b").withColumnRenamed("node", "rep")
    classes = classes.join(found.hint("shuffle_hash"), "rep", "left").select("bits", F.coalesce("component", "rep").alias("component_id"))
    rows = prints.join(classes.hint("shuffle_hash"), "bits")
    return rows.select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id",
        (F.col("id") == F.col("component_id")).alias("kept"))
