"""MinHash near-dedup by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightsieve.llm.bytes_hash import BASE, U, chunks, mix, shingles, texts
from nightsieve.llm.common import map_batches, staged
from nightsieve.llm.components import components
from nightsieve.shipping import ship

SMALL = 64
TILE = 512
EMPTY = U((1 << 64) - 1)


def sketches(values: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """One row of `size` coordinates for each set of 64-bit values.

    Round r < size throws every value into a bin of its own choice with the value (r, hash); the least stays.  Round
    size + i throws all values into bin i.  A set leaves when its bins are full, so round 2 * size - 1 is the last at
    which an emptier set can.  An empty set keeps empty coordinates.
    """
    sets = len(bounds) - 1
    out = np.full((sets, size), EMPTY)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(sets, dtype=np.int64), np.diff(bounds))
    for turn in range(2 * size):
        if not len(values):
            break
        hashed = mix(values + U((2 * turn + 1) * BASE & (1 << 64) - 1))
        spot = (hashed % U(size)).astype(np.int64) if turn < size else turn - size
        np.minimum.at(flat, owner * size + spot, U(turn << 54) | (hashed >> U(10)))
        open_ = (out == EMPTY).any(axis=1)[owner]
        values, owner = values[open_], owner[open_]
    return out


def band_hashes(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(sketch), bands), U)
    for band in range(bands):
        value = np.full(len(sketch), U(band + 1))
        for j in range(rows):
            value = mix(value * U(BASE) + sketch[:, band * rows + j])
        out[:, band] = value
    return out


def _describe(batch: pa.RecordBatch, width: int, bands: int, rows: int):
    data, bounds = texts(batch.column(1))
    for i, j in chunks(bounds):
        part = bounds[i:j + 1] - bounds[i]
        values, edges = shingles(data[bounds[i]:bounds[j]], part, width)
        keys = band_hashes(sketches(values, edges, bands * rows), bands, rows).view(np.int64)
        size = np.diff(edges)
        twins = [int(mix(np.array([np.bitwise_xor.reduce(mix(values[a:b] + U(7)))], U))[0].view(np.int64)) if b > a else 0
                 for a, b in zip(edges[:-1], edges[1:])]
        sums = [int(np.add.reduce(values[a:b]).view(np.int64)) if b > a else 0 for a, b in zip(edges[:-1], edges[1:])]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * bands, bands, dtype=np.int32)), pa.array(keys.reshape(-1)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).slice(i, j - i), pa.array(size), pa.array(twins, pa.int64()), pa.array(sums, pa.int64()), lists],
            ["id", "n", "twin", "total", "bands"],
        )


def _sets(batch: pa.RecordBatch, width: int):
    data, bounds = texts(batch.column(1))
    for i, j in chunks(bounds):
        values, edges = shingles(data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i], width)
        raw = pa.Array.from_buffers(
            pa.large_binary(), j - i, [None, pa.py_buffer(np.ascontiguousarray(edges * 8)), pa.py_buffer(values.tobytes())]
        ).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), raw], ["id", "members"])


def _linked(batch: pa.RecordBatch, percent: int):
    left, right = batch.column("left"), batch.column("right")
    keep = []
    for row in range(batch.num_rows):
        a = np.frombuffer(left[row].as_buffer(), U)
        b = np.frombuffer(right[row].as_buffer(), U)
        spot = np.searchsorted(a, b)
        spot[spot == len(a)] = 0
        both = int((a[spot] == b).sum())
        if 100 * both >= percent * (len(a) + len(b) - both):
            keep.append(row)
    yield batch.select(["x", "y"]).take(pa.array(keep, pa.int64()))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets are similar enough."""
    rows = pairs.join(sets.select(F.col("id").alias("x"), F.col("members").alias("left")), "x")
    rows = rows.join(sets.select(F.col("id").alias("y"), F.col("members").alias("right")), "y")
    return map_batches(rows.select("x", "y", "left", "right"), partial(_linked, percent=percent), "x long, y long")


def _cross(batch: pa.RecordBatch, percent: int):
    """Pairs of one bucket that lie in different components and whose sizes and lone shingles allow a link."""
    for row in batch.column("members"):
        ids, part, size, room = (np.array([m[k] for m in row.as_py()], np.int64) for k in ("id", "component", "n", "room"))
        order = np.argsort(-room, kind="stable")
        ids, part, size, room = ids[order], part[order], size[order], room[order]
        for at in range(1, len(ids)):  # everyone before has at least as much room
            hit = (part[:at] != part[at]) & ((100 + percent) * room[at] >= percent * (size[:at] + size[at]))
            hit &= (100 * size[:at] >= percent * size[at]) & (100 * size[at] >= percent * size[:at])
            if hit.any():
                other = ids[:at][hit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(other, ids[at])), pa.array(np.maximum(other, ids[at]))], ["x", "y"]
                )


def _tile(rows: pa.Table, percent: int) -> pa.Table:
    """Exact links between a tile's probes and its members, one for each probe and other component."""
    rows = rows.combine_chunks()
    ids, part, size = (rows.column(c).to_numpy() for c in ("rep", "component", "n"))
    probe = rows.column("probe").to_numpy(zero_copy_only=False)
    data, bounds = texts(rows.column("members"))
    values, bounds = np.frombuffer(data.tobytes(), U), bounds // 8
    mine, other = np.flatnonzero(probe), np.flatnonzero(~probe)
    x, y = [], []
    if len(mine) and len(other):
        pool = np.concatenate([values[bounds[i]:bounds[i + 1]] for i in other])
        owner = np.repeat(np.arange(len(other)), size[other])
        order = np.argsort(pool)
        pool, owner = pool[order], owner[order]
        for i in mine:
            own = values[bounds[i]:bounds[i + 1]]
            first, last = np.searchsorted(pool, own, "left"), np.searchsorted(pool, own, "right")
            run = last - first
            at = np.arange(run.sum()) + np.repeat(first - np.cumsum(run) + run, run)
            both = np.bincount(owner[at], minlength=len(other))
            hit = np.flatnonzero((part[other] != part[i]) & (100 * both >= percent * (size[i] + size[other] - both)))
            for k in np.unique(part[other][hit], return_index=True)[1]:
                x.append(ids[i])
                y.append(ids[other[hit[k]]])
    return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})


def _wide_links(room: DataFrame, wide: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across the components of buckets with many members, from tiles of a bounded size.

    Members outside a bucket's largest component are probes.  Blocks of probes meet blocks of members in tiles, where
    an index from shingles to members gives the exact intersections of a probe with all of them; only links leave.
    """
    parts = room.join(wide, "key").groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    main = parts.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("size"), F.max("c").alias("largest"))
    blocks = main.select("key", "main", F.ceil(F.col("size") / TILE).cast("int").alias("down"),
                         F.ceil((F.col("size") - F.col("largest")) / TILE).cast("int").alias("across"))
    rows = room.select("key", "rep", "component", "n").join(blocks, "key")
    spot = F.xxhash64("rep")
    members = rows.select("key", "rep", "component", "n", F.lit(False).alias("probe"), F.pmod(spot, "down").cast("int").alias("down"),
                          F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("across"))
    probes = rows.where("component <> main").select(
        "key", "rep", "component", "n", F.lit(True).alias("probe"),
        F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("down"), F.pmod(spot, "across").cast("int").alias("across"))
    tiles = members.unionByName(probes).join(sets.withColumnRenamed("id", "rep"), "rep")
    work = partial(_tile, percent=percent)
    ship(room.sparkSession)
    return staged(tiles.groupBy("key", "down", "across").applyInArrow(lambda t: work(t), "x long, y long").distinct(), "links")


def _labelled(member: DataFrame, found: DataFrame) -> DataFrame:
    out = member.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return out.withColumn("component", F.coalesce("component", "rep"))


def _mixed(member: DataFrame) -> DataFrame:
    """The buckets that hold more than one component."""
    ends = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    return member.join(ends.where("lo < hi").select("key"), "key")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80,
    bands: int | None = None, rows: int = 5,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row: components of texts with similar shingle sets.

    Two texts are linked when 100 * |intersection| >= percent * |union| of their sets of distinct `width`-word shingles
    (words are runs outside space and 09-0D, A-Z lowered; fewer words: the whole sequence; none or null: no links).
    Equal sets are one class from the start.  Classes that share a band are candidates: each is verified against its
    bucket's first class; in the buckets that still hold several components, against the class with the fewest shingles
    of its own; in those that remain, all pairs across components are judged, but for those that sizes or shingles found in no
    other candidate rule out: as pairs in small buckets, by tiles with an index of shingles in wide ones.  So all links that banding can see are
    judged on full sets; at the threshold a pair shares no band with probability (1 - (percent/100)**rows)**bands.

    Ids must be distinct integers; rows without one are left out; repeated texts, ties and extra columns are fine; an empty table gives no row.
    """
    bands = bands or (25 if percent >= 85 else 40)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    described = staged(
        map_batches(source, partial(_describe, width=width, bands=bands, rows=rows),
                    "id long, n long, twin long, total long, bands array<long>"), "sketch")
    same = ["n", "twin", "total"]
    classes = staged(described.where("n > 0").groupBy(*same).agg(F.min("id").alias("rep"), F.first("bands").alias("bands")), "classes")
    member = classes.select("rep", "n", F.explode("bands").alias("key"))
    heads = member.groupBy("key").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    member = staged(member.join(heads.select("key", "head"), "key"), "buckets")
    wanted = member.select(F.col("rep").alias("id")).distinct()
    sets = source.join(wanted.hint("shuffle_hash"), "id", "left_semi")
    sets = staged(map_batches(sets, partial(_sets, width=width), "id long, members binary"), "sets")

    sizes = classes.select(F.col("rep").alias("head"), F.col("n").alias("head_n"))
    stars = member.where("rep <> head").select("head", "rep", "n").distinct().join(sizes, "head")
    stars = stars.where((100 * F.col("n") >= percent * F.col("head_n")) & (100 * F.col("head_n") >= percent * F.col("n")))
    edges = staged(_verified(stars.select(F.col("head").alias("x"), F.col("rep").alias("y")), sets, percent), "links")
    found = staged(components(edges, "x", "y"), "components")

    mixed = staged(_mixed(_labelled(member, found)), "mixed")
    # a shingle that no other candidate has cannot be shared
    ids = sets.join(mixed.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    single = map_batches(ids, _exploded, "id long, value long").groupBy("value").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("c"))
    single = single.where("c = 1").groupBy("id").agg(F.count(F.lit(1)).alias("lone"))
    room = mixed.join(single.withColumnRenamed("id", "rep"), "rep", "left")
    room = room.withColumn("room", F.col("n") - F.coalesce("lone", F.lit(0))).where(100 * F.col("room") >= percent * F.col("n"))
    room = staged(room, "room")
    for turn in range(2):
        if turn == 0:  # the class with the fewest lone shingles is the likeliest centre of its bucket
            best = F.max_by(F.struct("rep", "component", "n", "room"), F.struct(F.col("room") / F.col("n"), -F.col("rep"))).alias("c")
            pairs = room.join(room.groupBy("key").agg(best), "key").where("component <> c.component")
            pairs = pairs.where((100 + percent) * F.least("room", "c.room") >= percent * (F.col("n") + F.col("c.n")))
            pairs = pairs.select(F.least("rep", "c.rep").alias("x"), F.greatest("rep", "c.rep").alias("y"))
        else:
            size = F.count(F.lit(1)).alias("size")
            wide = staged(room.groupBy("key").agg(size).where(F.col("size") > SMALL), "wide")
            edges = edges.unionByName(_wide_links(room, wide, sets, percent))
            room = room.join(wide, "key", "left_anti")
            bags = room.groupBy("key").agg(F.collect_list(F.struct(F.col("rep").alias("id"), "component", "n", "room")).alias("members"))
            pairs = map_batches(bags.where(F.size("members") > 1).select("members"), partial(_cross, percent=percent), "x long, y long")
        more = staged(_verified(staged(pairs.distinct(), "pairs"), sets, percent), "links")
        edges = edges.unionByName(more)
        if turn or not more.isEmpty():
            found = staged(components(edges, "x", "y"), "components")
        if turn == 0:
            room = staged(_mixed(_labelled(room.drop("component"), found)), "room")

    reps = classes.select(*same, "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    reps = reps.select(*same, F.coalesce("component", "rep").alias("component"))
    out = described.select("id", *same).join(reps, same, "left")
    where = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), where.alias("component_id"), (where == F.col("id")).alias("kept"))


def _exploded(batch: pa.RecordBatch):
    for row in range(batch.num_rows):
        values = np.frombuffer(batch.column("members")[row].as_buffer(), np.int64)
        owner = np.full(len(values), batch.column("id")[row].as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(values)], ["id", "value"])
