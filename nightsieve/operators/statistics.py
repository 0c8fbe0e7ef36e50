"""Robust statistics per group, exact at any group size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightsieve.functions.geometry import radial_weight
from nightsieve.functions.tone import curve_from_statistics
from nightsieve.plans.lookup import checked, lookup_join
from nightsieve.plans.ranges import row_index, value_prefix, with_halo
from nightsieve.schema import finite


def _holding(index: Column) -> Column:
    """The distinct value whose rows cover a 0-based position."""
    return (F.col("below") <= index) & (index < F.col("below") + F.col("w"))


def nearest_rank_percentile(
    df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], bounded: bool = False, weight: str | None = None
) -> DataFrame:
    """(keys…, one column per share): the value at position rint(share * (n - 1)); 0 without values.

    `weight` names a column of row counts where equal values are already collapsed.
    """
    clean = df.select(*keys, finite(value).alias(value), *([weight] if weight else []))
    prefix = value_prefix(clean, keys, value, weight, bounded)
    picks = []
    for name, share in shares.items():
        index = F.rint(F.lit(float(share)) * (F.col("valid") - 1).cast("double"))
        picks.append(F.coalesce(F.max(F.when(_holding(index), F.col(value))), F.lit(0.0)).alias(name))
    return prefix.groupBy(*keys).agg(*picks)


def mad(
    df: DataFrame, keys: Sequence[str], value: str, bounded: bool = False, weight: str | None = None
) -> DataFrame:
    """(keys…, median, mad): nearest-rank median and median absolute deviation."""
    medians = nearest_rank_percentile(df, keys, value, {"median": 0.5}, bounded, weight)
    small, _ = checked(medians)
    deviations = with_group_values(df, keys, small).select(
        *keys, F.abs(F.col(value) - F.col("median")).alias("_dev"), *([weight] if weight else [])
    )
    spread = nearest_rank_percentile(deviations, keys, "_dev", {"mad": 0.5}, bounded, weight)
    return small.join(spread, list(keys))


def with_group_values(df: DataFrame, keys: Sequence[str], values: DataFrame) -> DataFrame:
    """Rows with their group's values. Small value tables are broadcast after a size check."""
    return lookup_join(df, values, keys, "inner")


def rms_about(df: DataFrame, keys: Sequence[str], value: Column | str, center: Column | str, out: str = "rms") -> DataFrame:
    """Root mean square distance from a given centre; 1 without values."""
    v = F.col(value) if isinstance(value, str) else value
    c = F.col(center) if isinstance(center, str) else center
    delta = v - c
    return df.groupBy(*keys).agg(F.coalesce(F.sqrt(F.avg(delta * delta)), F.lit(1.0)).alias(out))


def extrema_with_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """min, its count, max, its count over finite values; zeros without any."""
    counts = df.select(*keys, finite(value).alias("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    real = F.when(F.col("_v").isNotNull(), F.col("_n"))
    zero = F.lit(0.0)
    return counts.groupBy(*keys).agg(
        F.coalesce(F.min("_v"), zero).alias("min"),
        F.coalesce(F.min_by(real, "_v"), F.lit(0)).alias("min_count"),
        F.coalesce(F.max("_v"), zero).alias("max"),
        F.coalesce(F.max_by(real, "_v"), F.lit(0)).alias("max_count"),
    )


def weighted_median(
    df: DataFrame, keys: Sequence[str], value: Column | str, weight: Column | str, out: str = "weighted_median",
    bounded: bool = False,
) -> DataFrame:
    """First value at which the running weight reaches half; non-finite values and weights <= 0 are skipped."""
    w = F.col(weight) if isinstance(weight, str) else weight
    rows = df.select(*keys, finite(value).alias("_v"), w.alias("_w"))
    usable = (F.col("_w") > 0) & F.col("_v").isNotNull()
    # unusable rows stay with a null value and no weight, so that their group is still reported
    rows = rows.select(
        *keys, F.when(usable, F.col("_v")).alias("_v"), F.when(usable, F.col("_w").cast("double")).otherwise(0.0).alias("_w")
    )
    prefix = value_prefix(rows, keys, "_v", "_w", bounded)
    reached = F.col("below") + F.col("w") >= F.col("valid") * F.lit(0.5)
    first = F.min(F.when(reached, F.col("_v")))
    return prefix.groupBy(*keys).agg(F.coalesce(first, F.max("_v"), F.lit(0.0)).alias(out))


def half_flux_radius(
    df: DataFrame, keys: Sequence[str], radius: Column | str, flux: Column | str, bounded: bool = False
) -> DataFrame:
    """Radius at which the flux summed from the centre reaches half."""
    return weighted_median(df, keys, radius, flux, "hfr", bounded)


def center_weighted_medians(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], width: Column | float, height: Column | float,
    x: str = "x", y: str = "y", bounded: bool = False,
) -> DataFrame:
    """Weighted median of several columns under the radial weight, in one pass over (column, value)."""
    entries = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(*keys, radial_weight(x, y, width, height).alias("_rw"), F.explode(entries).alias("e")).select(
        *keys, "_rw", "e.*"
    )
    medians = weighted_median(long, [*keys, "metric"], "value", "_rw", bounded=bounded)
    return medians.groupBy(*keys).agg(
        *[F.max(F.when(F.col("metric") == c, F.col("weighted_median"))).alias(c) for c in columns]
    )


def _middle(n: Column, start: Column) -> tuple[Column, Column]:
    """The two middle positions of n values from `start` on (the same one when n is odd)."""
    return start + F.floor((n - 1) / 2), start + F.floor(n / 2)


def averaged_median(
    df: DataFrame, keys: Sequence[str], value: Column | str, out: str = "median", positive: bool = False,
    bounded: bool = False,
) -> DataFrame:
    """Median with the two middle values averaged; 0 without values."""
    v = finite(value)
    rows = df.select(*keys, (F.when(v > 0, v) if positive else v).alias("_v"))
    prefix = value_prefix(rows, keys, "_v", bounded=bounded)
    low, high = _middle(F.col("valid"), F.lit(0))
    return prefix.groupBy(*keys).agg(
        F.coalesce(
            (F.max(F.when(_holding(low), F.col("_v"))) + F.max(F.when(_holding(high), F.col("_v")))) * F.lit(0.5),
            F.lit(0.0),
        ).alias(out)
    )


def median_metric(df: DataFrame, keys: Sequence[str], value: str = "fwhm") -> DataFrame:
    """Median of positive values, the scale of a frame's stars."""
    return averaged_median(df, keys, value, "median", positive=True)


def scale_ratio(reference: Column, candidate: Column) -> Column:
    ratio = F.least(F.greatest(reference / candidate, F.lit(0.75)), F.lit(1.25))
    return F.when((reference > 0) & (candidate > 0), ratio).otherwise(F.lit(1.0))


def trimmed_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "trimmed_median") -> DataFrame:
    """Averaged-middle median without the outer tenths; below 10 values the median of the positive ones."""
    v = finite(value)
    rows = df.select(*keys, v.alias("_v"))
    prefix = value_prefix(rows, keys, "_v").withColumn("_cut", F.floor(F.col("valid") / 10))
    low, high = _middle(F.col("valid") - 2 * F.col("_cut"), F.col("_cut"))
    large = (F.max(F.when(_holding(low), F.col("_v"))) + F.max(F.when(_holding(high), F.col("_v")))) * F.lit(0.5)
    # below 10 values every position is at hand in one small array
    few = F.sort_array(
        F.flatten(
            F.collect_list(
                F.when((F.col("valid") < 10) & (F.col("_v") > 0), F.array_repeat("_v", F.col("w").cast("int")))
            )
        )
    )
    n = F.size(few)
    small = F.when(
        n > 0, (F.get(few, F.floor((n - 1) / 2).cast("int")) + F.get(few, F.floor(n / 2).cast("int"))) / F.lit(2.0)
    )
    return prefix.groupBy(*keys).agg(
        F.when(F.max("valid") >= 10, large).otherwise(F.coalesce(small, F.lit(0.0))).alias(out)
    )


def stride_sample(df: DataFrame, position: Column | str, size: Column | int, cap: int | None = None) -> DataFrame:
    """Rows at positions floor(i * size / cap), all rows when there are no more than `cap` or it is None.

    The position of a raster sample follows from its coordinates, so this is a filter.
    """
    if cap is None:
        return df
    p = (F.col(position) if isinstance(position, str) else position).cast("double")
    n = (F.lit(size) if isinstance(size, int) else size).cast("double")
    stride = n / F.lit(float(cap))
    near = F.floor(p / stride)
    hit = F.lit(False)
    for step in (0, 1):  # rounding of p / stride can land one step low
        i = (near + step).cast("double")
        hit = hit | ((F.floor(i * stride) == p) & (i < cap))
    return df.filter((n <= cap) | hit)


def sample_size(size: Column, cap: int | None = None) -> Column:
    return size if cap is None else F.least(size, F.lit(cap))


def correlation(df: DataFrame, keys: Sequence[str], a: str, b: str, out: str = "correlation") -> DataFrame:
    """Pearson correlation; -1 when a side does not vary."""
    n = F.count(F.lit(1))
    flat = (n * F.var_pop(a) <= 1e-20) | (n * F.var_pop(b) <= 1e-20)
    return df.groupBy(*keys).agg(F.when(flat, F.lit(-1.0)).otherwise(F.coalesce(F.corr(a, b), F.lit(-1.0))).alias(out))


def max_gap(df: DataFrame, keys: Sequence[str], value: str, out: str = "max_gap", bounded: bool = False) -> DataFrame:
    """Largest gap between neighbouring values. `bounded` groups (a trail's pixels) use one window."""
    distinct = df.select(*keys, F.col(value).alias("_v")).distinct()
    if bounded:
        order = Window.partitionBy(*keys).orderBy("_v")
        gaps = distinct.withColumn("_gap", F.col("_v") - F.lag("_v").over(order))
    else:
        indexed = row_index(distinct, ["_v"], keys)
        order = Window.partitionBy(*keys, "_chunk").orderBy("idx")
        gaps = with_halo(indexed, 1, 0).withColumn("_gap", F.col("_v") - F.lag("_v").over(order)).filter("_own")
    return gaps.groupBy(*keys).agg(F.coalesce(F.max("_gap"), F.lit(0.0)).alias(out))


def auto_stretch(
    df: DataFrame, keys: Sequence[str], value: str, data_max: Column | float = 1.0, target: float = 0.25,
    position: Column | str | None = None, size: Column | int | None = None, cap: int | None = None,
) -> DataFrame:
    """(keys…, shadows, midtones, highlights) per group from its median and MAD.

    Pass `position`, `size` and `cap` to use the strided sample of large rasters; add the
    channel to `keys` for one curve per colour plane.
    """
    top = F.greatest(F.lit(1.0), F.lit(float(data_max)) if isinstance(data_max, (int, float)) else data_max)
    rows = df if position is None else stride_sample(df, position, size, cap)
    rows = rows.withColumn("_n", F.col(value) / top)
    stats = mad(rows, keys, "_n")
    shadows, midtones, highlights = curve_from_statistics("median", "mad", target)
    return stats.select(
        *keys, shadows.alias("shadows"), midtones.alias("midtones"), highlights.alias("highlights")
    )


def default_stretch() -> dict[str, float]:
    """The curve of a raster without samples."""
    return {"shadows": 0.0, "midtones": 0.5, "highlights": 1.0}


def normalize_background(df: DataFrame, keys: Sequence[str], value: str, target: float) -> DataFrame:
    """Shift byte samples so that each group's 35 % point lands on the target, clamped to 0..255."""
    points = nearest_rank_percentile(df, keys, value, {"_p": 0.35})
    goal = F.rint(F.lit(float(target)) * F.lit(255.0))
    shifted = F.col(value) + (goal - F.col("_p"))
    return with_group_values(df, keys, points).withColumn(
        value, F.least(F.greatest(shifted, F.lit(0.0)), F.lit(255.0))
    ).drop("_p")
