"""Overrides and visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightsieve.functions.keys import group_key
from nightsieve.plans.lookup import checked


def override_state(df: DataFrame, auto: str = "auto_rejected", manual: str = "manual_override") -> DataFrame:
    """is_rejected (the manual verdict wins), override_active and the state's label."""
    rejected = F.coalesce(F.col(manual), F.col(auto))
    active = F.col(manual).isNotNull()
    label = F.concat(
        F.when(active, F.lit("✋ ")).otherwise(F.lit("")), F.when(rejected, F.lit("Rejected")).otherwise(F.lit("Keep"))
    )
    return df.withColumns({"is_rejected": rejected, "override_active": active, "state_label": label})


def toggle_override(
    df: DataFrame, edits: DataFrame, id_col: str = "frame_id", auto: str = "auto_rejected", manual: str = "manual_override"
) -> DataFrame:
    """Flip the verdict of every row in `edits`; a flip back to the automatic verdict clears the override."""
    marks = edits.select(id_col).distinct().withColumn("_edit", F.lit(True))
    flipped = ~F.coalesce(F.col(manual), F.col(auto))
    new = F.when(flipped == F.col(auto), F.lit(None).cast("boolean")).otherwise(flipped)
    return df.join(marks, id_col, "left").withColumn(
        manual, F.when(F.col("_edit"), new).otherwise(F.col(manual))
    ).drop("_edit")


def selected_rows(
    df: DataFrame, chips: DataFrame | None, group: Column | None = None, include_blank: bool = False
) -> DataFrame:
    """Rows whose group is selected. With any chip present, blank groups are left out unless asked for.

    `chips` has (group_key, selected).
    """
    if chips is None:
        return df
    group = group_key("filter_name") if group is None else group
    table, fits = checked(chips.groupBy("group_key").agg(F.max("selected").alias("_selected")))
    any_chip = table.agg(F.count(F.lit(1)) > 0).scalar()
    side = table.withColumnRenamed("group_key", "_k")
    joined = df.withColumn("_g", group).join(F.broadcast(side) if fits else side, F.col("_g") == F.col("_k"), "left")
    chosen = F.coalesce(F.col("_selected"), F.lit(False)) & (F.col("_g") != "")
    if include_blank:
        chosen = chosen | (F.col("_g") == "")
    return joined.filter(~any_chip | chosen).drop("_g", "_k", "_selected")


def visible(
    df: DataFrame,
    chips: DataFrame | None = None,
    show_accepted: bool = True,
    show_rejected: bool = True,
    rejected: str = "is_rejected",
    **kwargs,
) -> DataFrame:
    """Rows the list shows: by verdict and by selected groups."""
    shown = df.filter((F.col(rejected) & F.lit(show_rejected)) | (~F.col(rejected) & F.lit(show_accepted)))
    return selected_rows(shown, chips, **kwargs)
