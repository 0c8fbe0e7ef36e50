"""Order statistics over groups of any size.

A window partitioned by a group key puts the whole group into one task, so one
group holding a third of all rows would decide the run time.  The helpers here
first collapse equal values, then cut the (group, value) order into ranges of
similar size and run the window inside one range of one group.  What lies below
a range is added from a table with one row per group and range.

The cut points are a sample chosen by hash of the content, so every evaluation
of the plan, also after an executor is lost, finds the same cut points.  Inputs
must be deterministic; checkpoint them first where they are not.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_RANGES = 1024


@dataclass(frozen=True)
class SortKey:
    """A column in an order. Nulls are last in both directions."""

    name: str
    ascending: bool = True

    def order(self) -> Column:
        column = F.col(self.name)
        return column.asc_nulls_last() if self.ascending else column.desc_nulls_last()


def sort_keys(keys: Sequence[SortKey | str | tuple[str, str]]) -> list[SortKey]:
    out = []
    for key in keys:
        if isinstance(key, SortKey):
            out.append(key)
        elif isinstance(key, str):
            out.append(SortKey(key))
        else:
            out.append(SortKey(key[0], key[1] != "desc"))
    return out


def range_count(df: DataFrame) -> int:
    """A few ranges per shuffle partition, so the cluster's own setting scales them."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(MAX_RANGES, 4 * partitions))


def _not_after(order: Sequence[SortKey]) -> Callable[[Column], Column]:
    """bound -> bound is at or before the current row, as one boolean expression."""

    def build(bound: Column) -> Column:
        result = F.lit(True)
        for key in reversed(order):
            b, r = bound[key.name], F.col(key.name)
            before = (b < r) if key.ascending else (b > r)
            before = F.coalesce(before, b.isNotNull() & r.isNull())
            result = before | (b.eqNullSafe(r) & result)
        return result

    return build


def _pair_order(order: Sequence[SortKey]) -> Callable[[Column, Column], Column]:
    def compare(a: Column, b: Column) -> Column:
        result = F.lit(0)
        for key in reversed(order):
            x, y = a[key.name], b[key.name]
            lower = (x < y) if key.ascending else (x > y)
            lower = F.coalesce(lower, x.isNotNull() & y.isNull())
            result = F.when(x.eqNullSafe(y), result).when(lower, -1).otherwise(1)
        return result

    return compare


def add_range(
    df: DataFrame,
    order: Sequence[SortKey],
    out: str = "_range",
    ranges: int | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Number the rows' ranges in the given order, 0 first.

    At most `ranges - 1` sampled cut points reach each task as a literal.  They
    are looked up in two steps (block, then within the block), so the cost per
    row grows with the square root of their number.  `carry` names columns kept in
    the sample only so that its shuffle equals, and reuses, the caller's own.
    """
    ranges = ranges or range_count(df)
    if ranges <= 1:
        return df.withColumn(out, F.lit(0))
    names = [key.name for key in order]
    block = max(1, math.isqrt(ranges))
    picked = df.select(*names, *carry).orderBy(F.xxhash64(*names)).limit(ranges - 1)
    ordered = F.array_sort(F.collect_list(F.struct(*names, *carry)), _pair_order(order))
    bounds = picked.agg(ordered.alias("b")).select(
        F.transform(
            F.sequence(F.lit(0), F.floor((F.size("b") - 1) / block).cast("int")),
            lambda i: F.slice(F.col("b"), i * block + 1, block),
        ).alias("blocks")
    )
    not_after = _not_after(order)
    blocks = F.col("_blocks")
    block_no = F.size(F.filter(blocks, lambda chunk: not_after(F.get(chunk, F.lit(0)))))
    within = F.size(F.filter(F.get(blocks, F.col("_block") - 1), not_after))
    # coalesce keeps the column non-nullable, so a join on it adds no null filter below the shuffle
    number = F.coalesce(F.when(F.col("_block") > 0, (F.col("_block") - 1) * block + within), F.lit(0))
    return (
        df.withColumn("_blocks", bounds.scalar())
        .withColumn("_block", block_no)
        .withColumn(out, number)
        .drop("_blocks", "_block")
    )


def value_prefix(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str | None = None,
    bounded: bool = False,
) -> DataFrame:
    """One row per distinct (keys, value): `w`, `below`, `valid` and `total`.

    `w` counts rows (or sums `weight`), `below` sums w over smaller values of the
    group, `valid` sums w over non-null values and `total` over all.  A null value
    is the last of its group.  `bounded` says that every group is known to be
    small (a star's aperture, say), which allows one plain window.
    """
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.groupBy(*keys, value).agg(amount.alias("w"))
    ok = F.when(F.col(value).isNotNull(), F.col("w"))
    zero = F.lit(0).cast("bigint") if weight is None else F.lit(0.0)
    if bounded:
        whole = Window.partitionBy(*keys)
        before = whole.orderBy(F.col(value).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
        return counts.select(
            *keys, value, "w",
            F.coalesce(F.sum("w").over(before), zero).alias("below"),
            F.coalesce(F.sum(ok).over(whole), zero).alias("valid"),
            F.sum("w").over(whole).alias("total"),
        )
    ranged = add_range(counts, sort_keys([*keys, value]), carry=["w"])
    per_range = ranged.groupBy(*keys, "_range").agg(F.sum("w").alias("_w"), F.sum(ok).alias("_ok"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    lower = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_range.select(
        *keys, "_range",
        F.coalesce(F.sum("_w").over(lower), zero).alias("_base"),
        F.coalesce(F.sum("_ok").over(whole), zero).alias("valid"),
        F.sum("_w").over(whole).alias("total"),
    )
    inside = (
        Window.partitionBy(*keys, "_range")
        .orderBy(F.col(value).asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    running = ranged.withColumn("_run", F.coalesce(F.sum("w").over(inside), zero))
    return _join_bases(running, bases, keys).select(
        *keys, value, "w", (F.col("_base") + F.col("_run")).alias("below"), "valid", "total"
    )


def _join_bases(rows: DataFrame, bases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-safe join on (keys, range); null-safe also keeps both branches' scans identical."""
    renamed = bases.withColumnsRenamed({k: f"_k_{k}" for k in keys} | {"_range": "_r"})
    same = F.col("_range").eqNullSafe(F.col("_r"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(renamed, same).drop("_r", *[f"_k_{k}" for k in keys])


def row_index(
    df: DataFrame,
    order: Sequence[SortKey | str | tuple[str, str]],
    keys: Sequence[str] = (),
    out: str = "idx",
    size: str | None = None,
) -> DataFrame:
    """Exact 0-based position of each row in its group's order (end it with a unique column)."""
    order = sort_keys(order)
    ranged = add_range(df, [*sort_keys(keys), *order])
    per_range = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    lower = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_range.select(
        *keys, "_range",
        F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_base"),
        F.sum("_n").over(whole).alias(size or "_size"),
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(*[key.order() for key in order])
    numbered = ranged.withColumn("_rn", F.row_number().over(inside) - 1)
    joined = _join_bases(numbered, bases, keys).withColumn(out, (F.col("_base") + F.col("_rn")).cast("bigint"))
    return joined.drop("_range", "_rn", "_base", *([] if size else ["_size"]))


def with_halo(indexed: DataFrame, back: int, ahead: int, idx: str = "idx", chunk: int = 65536) -> DataFrame:
    """Copy each row into the chunks whose windows can see it; `_own` marks its home chunk.

    A window partitioned by `_chunk` and ordered by the index then reaches `back`
    rows before and `ahead` rows after each home row without a global sort.
    """
    position = F.col(idx)
    chunks = F.sequence(
        F.floor((position - ahead) / chunk).cast("bigint"), F.floor((position + back) / chunk).cast("bigint")
    )
    return (
        indexed.withColumn("_chunk", F.explode(chunks))
        .withColumn("_own", F.floor(position / chunk) == F.col("_chunk"))
    )
