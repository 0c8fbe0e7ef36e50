"""Merkle manifest of a dataset by concatenated-level strings.

Leaves get their place in their group's order from ranges of that order.  Each aligned block of `arity ** depth` places keeps a
level as one string of 64-digit digests; the level above is the digests of its fixed-width substrings, and the substrings
that flank a node's own place in its run are its siblings.  A block ends in one digest; the blocks' digests are the leaves of
the next round, until each group has one.  Those are the leaves of the tree over groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightsieve.llm.common import staged

DIGEST = 64
ARITY = 3
#: Levels inside a block: 729 leaves of three to a run, or 46 kB of digests.
DEPTH = 6


def field(column: Column) -> Column:
    """A value as `-` for null, else its UTF-8 byte count, `:` and the value."""
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*(field(c) for c in columns)), 256)


@dataclass(frozen=True)
class Manifest:
    """`leaves`: one row per input row with its path; `groups`: (key, subroot, path) per group; `root`: one row, none for an empty table."""

    leaves: DataFrame
    groups: DataFrame
    root: DataFrame


def _order(names: Sequence[str]) -> list[Column]:
    return [F.col(n).asc_nulls_first() for n in names]


def _placed(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`rows` with `place`, from 0, in the order of each key, and `total`, the number of rows of the key.

    Rows are sorted in ranges of the whole (key, order) order and written; a range's rows are numbered alone and start after
    the rows of their key in the ranges before, so a key with most of the rows is spread over many tasks.
    """
    ranged = rows.repartitionByRange(*_order([*keys, *order])).withColumn("part", F.spark_partition_id())
    ranged = staged(ranged, "ranges")
    counts = ranged.groupBy("part", *keys).agg(F.count(F.lit(1)).alias("here"))
    every = Window.partitionBy(*keys)
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", *keys, F.coalesce(F.sum("here").over(before), F.lit(0)).alias("start"), F.sum("here").over(every).alias("total"))
    inner = Window.partitionBy("part", *keys).orderBy(*_order(order))
    numbered = ranged.withColumn("nth", F.row_number().over(inner) - 1)
    match = [numbered["part"] == counts["part"], *(numbered[k].eqNullSafe(counts[k]) for k in keys)]
    return numbered.join(counts, match).select(*(numbered[c] for c in rows.columns), (F.col("start") + F.col("nth")).alias("place"), "total")


def _above(level: Column, arity: int) -> Column:
    """The level over a level: the digests of its substrings of `arity` digests."""
    width = DIGEST * arity
    runs = F.ceil(F.length(level) / width).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(level.substr(i * width + 1, F.lit(width)), 256)), "").cast("binary")


def _levels(leaves: Column, whole: Column, depth: int, arity: int) -> Column:
    """All levels of a block from the leaves up: until one node is left where the block is `whole`, else `depth` above."""
    def rise(levels: Column, _: Column) -> Column:
        top = F.element_at(levels, -1)
        return F.when(whole & (F.length(top) <= DIGEST), levels).otherwise(F.concat(levels, F.array(_above(top, arity))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.array(leaves), rise)


def _flanks(levels: Column, place: Column, arity: int) -> Column:
    """[(left, right)]: the siblings before and after the node over `place`, level by level below the block's top."""
    width = DIGEST * arity

    def beside(level: Column, i: Column) -> Column:
        node = F.floor(place / F.pow(F.lit(float(arity)), i)).cast("int")
        first = F.floor(node / arity).cast("int") * arity
        return F.struct(
            level.substr(first * DIGEST + 1, (node - first) * DIGEST).cast("string").alias("left"),
            level.substr((node + 1) * DIGEST + 1, F.lit(width) - (node + 1 - first) * DIGEST).cast("string").alias("right"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), beside)


NO_PATH = "cast(array() as array<struct<left: string, right: string>>)"


def _tree(nodes: DataFrame, keys: Sequence[str], carried: Sequence[str], depth: int, arity: int) -> tuple[DataFrame, DataFrame]:
    """((keys, carried, path) per node, (keys, top) per key) of `nodes` (keys, place, total, node, carried)."""
    span = arity ** depth
    items = F.struct(F.col("place"), F.col("node"), F.struct(*carried).alias("carried"))
    blocks = nodes.groupBy(*keys, F.floor(F.col("place") / span).alias("block")).agg(
        F.max("total").alias("total"), F.sort_array(F.collect_list(items)).alias("items"))
    leaves = F.array_join(F.transform("items", lambda x: x.node), "").cast("binary")
    blocks = blocks.withColumn("levels", _levels(leaves, F.col("total") <= span, depth, arity))
    blocks = staged(blocks.withColumn("node", F.element_at("levels", -1).cast("string")), "blocks")
    tops = blocks.where(F.col("total") <= span).select(*keys, F.col("node").alias("top"))
    more = blocks.where(F.col("total") > span).select(
        *keys, F.col("block").alias("place"), F.ceil(F.col("total") / span).alias("total"), "node")
    rows = blocks.withColumn("upper", F.expr(NO_PATH))
    if not more.isEmpty():
        upper, high = _tree(more, keys, ["place"], depth, arity)
        tops = tops.unionByName(high)
        upper = upper.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("place").alias("__block"), F.col("path").alias("__path"))
        match = [F.col("block") == F.col("__block"), *(F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)]
        rows = rows.join(upper, match, "left").withColumn("upper", F.coalesce("__path", "upper"))

    def entry(item: Column) -> Column:
        path = F.concat(_flanks(F.col("levels"), (item.place % span).cast("int"), arity), F.col("upper"))
        return F.struct(item.carried.alias("carried"), path.alias("path"))

    rows = rows.select(*keys, F.explode(F.transform("items", entry)).alias("e"))
    return rows.select(*keys, *(F.col(f"e.carried.{c}").alias(c) for c in carried), "e.path"), tops


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s.left, node, s.right), 256))


def proof(path: Column) -> Column:
    """All siblings of a path as one string, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s.left, s.right)), "")


def manifest(leaves: DataFrame, group: str, order: Sequence[str], leaf: str = "leaf", depth: int = DEPTH, arity: int = ARITY) -> Manifest:
    """The tree over the rows of `leaves` in `order` within `group`, and over the groups in their bytewise order, null first.

    Each run of `arity` nodes becomes the digest of their joined digests, the last run also with fewer, until one node is left; a
    lone leaf is its group's subroot as it is.  The columns of `leaves` other than `group` are carried along; `path` holds
    the siblings up to the root.  Rows equal in `order` are placed by their digest, so repeated rows do no harm; null
    order values come first.  An empty table gives empty tables.
    """
    carried = [c for c in leaves.columns if c != group]
    rows = leaves.select(F.col(group).alias("key"), F.struct(*carried).alias("row"), *(F.col(o).alias(f"o{i}") for i, o in enumerate(order)),
                         F.col(leaf).alias("node")).withColumn("tie", F.monotonically_increasing_id())
    ranks = [f"o{i}" for i in range(len(order))]
    placed = _placed(rows, ["key"], [*ranks, "node", "tie"]).select("key", "place", "total", "node", "row")
    paths, tops = _tree(placed, ["key"], ["row"], depth, arity)
    tops = staged(tops.withColumnRenamed("top", "node"), "subroots")
    high, root = _tree(_placed(tops, [], ["key"]), [], ["key", "node"], depth, arity)
    groups = staged(high.select("key", F.col("node").alias("subroot"), F.col("path").alias("upper")), "groups")
    rows = paths.join(groups.withColumnRenamed("key", "__key"), F.col("key").eqNullSafe(F.col("__key")))
    rows = rows.select(F.col("key").alias(group), *(F.col(f"row.{c}").alias(c) for c in carried), "subroot", F.concat("path", "upper").alias("path"))
    return Manifest(rows, groups.select(F.col("key").alias(group), "subroot", F.col("upper").alias("path")), root.withColumnRenamed("top", "root"))


def verified(leaves: DataFrame, root: DataFrame, leaf: str) -> DataFrame:
    """`leaves` of a manifest with `root`, `folded_root` of the digest in column `leaf`, and whether the two are equal."""
    top = root.first()
    rows = leaves.withColumn("root", F.lit(top["root"] if top else None).cast("string")).withColumn("folded_root", folded(F.col("path"), F.col(leaf)))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
