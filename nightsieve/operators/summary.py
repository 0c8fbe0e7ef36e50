"""Counts, ratios and exposure time of a session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightsieve.functions.display import format_integration
from nightsieve.functions.keys import (
    filter_display,
    filter_group,
    filter_order,
    group_key,
    labelled_key,
    normalize_key,
)
from nightsieve.operators.thresholds import clauses_for, violation, with_thresholds
from nightsieve.plans.ranges import row_index
from nightsieve.schema import finite


def _totals(rejected: str, exposure: str) -> list[Column]:
    seconds = F.coalesce(F.col(exposure).cast("double"), F.lit(0.0))
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(rejected)).alias("rejected"),
        F.coalesce(F.sum(seconds), F.lit(0.0)).alias("total_s"),
        F.coalesce(F.sum(F.when(~F.col(rejected), seconds)), F.lit(0.0)).alias("accepted_s"),
    ]


def _derived(df: DataFrame) -> DataFrame:
    accepted = F.greatest(F.lit(0), F.col("total") - F.col("rejected")).cast("bigint")
    ratio = F.when(F.col("total") > 0, accepted / F.col("total").cast("double")).otherwise(F.lit(0.0))
    return df.withColumn("accepted", accepted).withColumn("accepted_ratio", ratio)


def _time(column: str) -> Column:
    return F.when(F.col(column) > 0, format_integration(column)).otherwise(F.lit(""))


def session_summary(df: DataFrame, rejected: str = "is_rejected", exposure: str = "exposure_s") -> DataFrame:
    """One row of totals."""
    return _derived(df.agg(*_totals(rejected, exposure))).withColumns(
        {"total_text": _time("total_s"), "accepted_text": _time("accepted_s")}
    )


def group_summary(
    df: DataFrame, filter_col: str = "filter_name", rejected: str = "is_rejected", exposure: str = "exposure_s"
) -> DataFrame:
    """The same per group, case-sensitive, blanks as '(none)'. The time is the accepted one, else the total."""
    keyed = df.withColumn("filter_key", labelled_key(filter_col, "(none)", trimmed=True))
    per_group = _derived(keyed.groupBy("filter_key").agg(*_totals(rejected, exposure)))
    text = F.when(F.col("accepted_s") > 0, format_integration("accepted_s")).otherwise(_time("total_s"))
    return per_group.withColumn("time_text", text)


def summary_rollup(
    df: DataFrame, filter_col: str = "filter_name", rejected: str = "is_rejected", exposure: str = "exposure_s"
) -> DataFrame:
    """Session and group totals from one pass; `filter_key` is null on the session row."""
    keyed = df.withColumn("filter_key", labelled_key(filter_col, "(none)", trimmed=True))
    rolled = keyed.rollup("filter_key").agg(*_totals(rejected, exposure), F.grouping_id().alias("level"))
    return _derived(rolled).drop("level")


def reject_counters(
    df: DataFrame, thresholds: DataFrame | None, scope_key: str | None = None, group: Column | None = None
) -> DataFrame:
    """Rows that break each rule, counted rule by rule.

    Each row is held against its own group's limits; `scope_key` holds all rows
    against that one group's instead.
    """
    group = group_key("filter_name") if group is None else group
    limits = with_thresholds(df, thresholds, F.lit(scope_key.strip().lower()) if scope_key is not None else group)
    return limits.agg(*[F.count_if(violation(c)).alias(f"{c.name}_rejected") for c in clauses_for(df)])


def threshold_sweep(
    df: DataFrame, metric: str, limits: Sequence[float], group: Column | None = None, above: bool = True
) -> DataFrame:
    """How many rows of each group every candidate limit would reject.

    A row is only counted in the bin of the last limit it breaks; sums over the
    bins give all counts, so no row is paired with every limit.
    """
    group = group_key("filter_name") if group is None else group
    order = sorted(set(float(v) for v in limits), reverse=not above)
    grid = F.array(*[F.lit(v) for v in order])
    value = finite(metric)
    broken = F.size(F.filter(grid, lambda limit: (value > limit) if above else (value < limit)))
    bins = (
        df.select(group.alias("group_key"), F.when(value.isNotNull(), broken).otherwise(F.lit(0)).alias("bin"))
        .groupBy("group_key", "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    # one row per group and limit: each bin adds to all limits up to its own
    spread = bins.select("group_key", F.explode(F.sequence(F.lit(0), F.lit(len(order) - 1))).alias("i"), "bin", "n")
    return spread.groupBy("group_key", "i").agg(
        F.sum(F.when(F.col("bin") > F.col("i"), F.col("n")).otherwise(F.lit(0))).alias("rejected")
    ).select("group_key", F.element_at(grid, F.col("i") + 1).alias("limit"), "rejected")


def rejected_by_group(df: DataFrame, filter_col: str = "filter_name", rejected: str = "is_rejected") -> DataFrame:
    """Rejected rows per group, blanks as '(no filter)', groups without rejects left out."""
    return (
        df.filter(F.col(rejected))
        .groupBy(labelled_key(filter_col, "(no filter)", trimmed=False).alias("filter_key"))
        .agg(F.count(F.lit(1)).alias("rejected"))
    )


def rejected_in_selection(counts: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Total rejected rows of the chosen groups, and whether a choice is offered at all."""
    chosen = F.lit(True) if keys is None else F.col("filter_key").isin(list(keys))
    return counts.agg(
        F.coalesce(F.sum(F.when(chosen, F.col("rejected"))), F.lit(0)).cast("bigint").alias("rejected"),
        (F.count(F.lit(1)) >= 2).alias("offers_choice"),
    )


def distinct_keys(
    df: DataFrame, filter_col: str = "filter_name", order: str = "frame_id", include_blank: bool = False
) -> DataFrame:
    """Distinct groups, ignoring case, in their first spelling, with display name and sort order."""
    keyed = df.select(normalize_key(filter_col).alias("key"), order)
    if not include_blank:
        keyed = keyed.filter(F.col("key") != "")
    first = keyed.groupBy(F.lower("key").alias("group_key")).agg(F.min_by("key", order).alias("key"))
    return first.select(
        "group_key", "key", filter_display("key").alias("display"), filter_order("key").alias("sort_order"),
        filter_group("key").alias("filter_group"),
    )


def ordered_keys(keys: DataFrame) -> DataFrame:
    return keys.orderBy("sort_order", F.lower("display"), "group_key")


def keys_by_group(keys: DataFrame) -> DataFrame:
    """Groups nested under Narrowband, LRGB and Other; one row per key with both positions."""
    firsts = keys.groupBy("filter_group").agg(F.min("sort_order").alias("_first"))
    # three category groups at most
    order = Window.partitionBy(F.lit(1)).orderBy("_first")
    ranked = firsts.withColumn("group_position", F.row_number().over(order)).drop("_first")
    named = keys.withColumn("_name", F.lower("key"))
    placed = row_index(named, ["sort_order", "_name", "group_key"], ["filter_group"], out="_i")
    return placed.join(F.broadcast(ranked), "filter_group").select(
        "filter_group", "group_position", (F.col("_i") + 1).alias("position"), "key", "display"
    )


def first_non_null(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """First value in load order of each column that has one."""
    return df.agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])
