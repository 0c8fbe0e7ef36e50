"""Unions, differences and first-wins duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightsieve.functions.keys import normalize_key
from nightsieve.plans.lookup import checked


def dedupe_keep_first(df: DataFrame, name: Column, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """First row per name, ignoring case. Tasks keep one row per name before the shuffle."""
    columns = df.columns
    best = F.min_by(F.struct(*columns), F.struct(*order)).alias("_row")
    return df.groupBy(*keys, F.lower(name).alias("_name")).agg(best).select("_row.*").select(*columns)


def union_sources(sources: Sequence[DataFrame], path: str = "path") -> DataFrame:
    """Listings of several roots in turn; a path seen before, ignoring case, is dropped."""
    merged = None
    for position, source in enumerate(sources):
        numbered = source.withColumn("source", F.lit(position))
        merged = numbered if merged is None else merged.unionByName(numbered)
    return dedupe_keep_first(merged, F.col(path), ["source", path])


def new_files(listing: DataFrame, session: DataFrame, path: str = "path") -> DataFrame:
    """Files that the saved session does not have."""
    return listing.join(
        session.select(F.lower(path).alias("_p")).distinct(), F.lower(listing[path]) == F.col("_p"), "left_anti"
    )


def remove_frames(frames: DataFrame, removed: DataFrame, id_col: str = "frame_id") -> DataFrame:
    """Frames that were not moved or deleted."""
    return frames.join(removed.select(id_col), id_col, "left_anti")


def resume_union(restored: DataFrame, measured: DataFrame) -> DataFrame:
    """Restored rows and newly measured ones; columns one side lacks are null."""
    return restored.withColumn("restored", F.lit(True)).unionByName(
        measured.withColumn("restored", F.lit(False)), allowMissingColumns=True
    )


def obsolete_keys(old: DataFrame, new: DataFrame, key: str = "filter_key") -> DataFrame:
    """(key, status): summary rows to drop and to add, keys compared ignoring case."""
    before = old.groupBy(F.lower(key).alias("_k")).agg(F.min(key).alias(key))
    after = new.groupBy(F.lower(key).alias("_k")).agg(F.min(key).alias(key))
    dropped = before.join(after, "_k", "left_anti").select(key, F.lit("dropped").alias("status"))
    added = after.join(before, "_k", "left_anti").select(key, F.lit("added").alias("status"))
    return dropped.unionByName(added)


def restore_selection(keys: DataFrame, saved: DataFrame, keys_on: Sequence[str] = ()) -> DataFrame:
    """Saved choice of each group; groups the session did not know stay selected.

    `keys` has group_key, `saved` has (key, selected).
    """
    first = saved.groupBy(*keys_on, F.lower(normalize_key("key")).alias("group_key")).agg(
        F.max("selected").alias("_saved")
    )
    side, fits = checked(first)
    joined = keys.join(F.broadcast(side) if fits else side, [*keys_on, "group_key"], "left")
    return joined.withColumn("selected", F.coalesce(F.col("_saved"), F.lit(True))).drop("_saved")


def reference_join(df: DataFrame, order: str, columns: Sequence[str], ok: Column | None = None) -> DataFrame:
    """Every row with the values of the first usable row, attached as one struct `reference`."""
    usable = df if ok is None else df.filter(ok)
    first = usable.agg(F.min_by(F.struct(*columns), F.col(order)).alias("r"))
    return df.withColumn("reference", first.scalar())
