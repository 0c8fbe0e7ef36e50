"""From rasters to star measurements and one metrics row per frame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightsieve.functions.geometry import to_arcsec
from nightsieve.operators import stars, trail
from nightsieve.operators.ordering import top_k_per_group
from nightsieve.operators.profile import SUMS, tile_sums
from nightsieve.operators.raster import analysis_size, local_maxima, resample_nearest
from nightsieve.operators.statistics import (
    center_weighted_medians,
    extrema_with_counts,
    mad,
    stride_sample,
    with_group_values,
)
from nightsieve.plans.lookup import checked
from nightsieve.session import cut

# Aperture and background ring of a star, in pixels.
APERTURE, RING_INNER, RING_OUTER = 7, 9, 13
RING_SAMPLES = 16
# Side of the raster tiles that a task measures stars in.
TILE = 128


def aperture_join(
    pixels: DataFrame, points: DataFrame, keys: Sequence[str], id_col: str, radius: int = APERTURE,
    inner: float = RING_INNER, outer: int = RING_OUTER,
) -> DataFrame:
    """(keys…, id, dx, dy, v, in_box, in_ring, point columns): samples of each point's box and ring.

    A point names the positions it needs and meets the raster on (keys, y, x), which
    spreads evenly however stars are placed.
    """
    span = F.sequence(F.lit(-outer), F.lit(outer))
    squared = F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")
    in_box = (F.abs("dy") <= radius) & (F.abs("dx") <= radius)
    in_ring = squared.between(inner**2, outer**2)
    asked = (
        points.withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span))
        .withColumns({"in_box": in_box, "in_ring": in_ring}).filter(F.col("in_box") | F.col("in_ring"))
        .withColumns({"y": F.col("cy") + F.col("dy"), "x": F.col("cx") + F.col("dx")})
    )
    return asked.join(pixels.select(*keys, "y", "x", "v"), [*keys, "y", "x"]).drop("y", "x")


def measure_stars(
    pixels: DataFrame, points: DataFrame, keys: Sequence[str], id_col: str = "star_id", radius: int = APERTURE,
    inner: float = RING_INNER, outer: int = RING_OUTER, ring_samples: int = RING_SAMPLES,
) -> DataFrame:
    """(keys…, id, x, y, fwhm, hfr, ecc, peak) of points (keys…, id, cx, cy, peak, background).

    The ring's median is the local background when it has enough samples.  Radii are
    taken from the flux centroid.  Points whose profile fits no star are dropped.
    Points and samples meet once, by tiles of the raster with a halo, so a task sorts samples and
    never holds a row per point and sample.
    """
    keys, reach = list(keys), max(radius, outer)
    tile = [*keys, "_ty", "_tx"]

    def tiles(at: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(at) / TILE), F.floor((F.col(at) + 2 * reach) / TILE)))

    sent = pixels.select(*keys, "y", "x", F.col("v").cast("double").alias("v")).withColumn("_ty", tiles("y")).withColumn("_tx", tiles("x"))
    asked = points.dropna(subset=[*keys, "cy", "cx"]).select(
        *keys, id_col, "cx", "cy", "peak", F.col("background").cast("double").alias("background"),
        F.floor((F.col("cy") + reach) / TILE).alias("_ty"), F.floor((F.col("cx") + reach) / TILE).alias("_tx"),
    )
    kept = [*keys, id_col, "cx", "cy", "peak"]
    schema = ", ".join([*[f"`{n}` {t}" for n, t in asked.select(*kept).dtypes], *[f"{n} double" for n in SUMS]])
    measure = partial(_tile_profiles, kept=kept, radius=radius, inner=inner, outer=outer, ring_samples=ring_samples)
    # a lambda of two arguments: Spark counts them
    sums = asked.groupBy(*tile).cogroup(sent.groupBy(*tile)).applyInArrow(lambda a, b: measure(a, b), schema)
    per_star = sums.filter("_f > 0").withColumns({"x": F.col("cx") + F.col("_mx"), "y": F.col("cy") + F.col("_my"), "hfr": F.col("_hfr")})
    measured = per_star.select(
        *keys, id_col, "x", "y", stars.fit_fwhm(F.col("_n"), F.col("_core")).alias("fwhm"), "hfr",
        stars.moment_shape()["ecc"].alias("ecc"), "peak",
    )
    return measured.filter((F.col("fwhm") > 0) & (F.col("hfr") > 0))


def _tile_profiles(
    points: pa.Table, samples: pa.Table, kept: Sequence[str], radius: int, inner: float, outer: int, ring_samples: int
) -> pa.Table:
    """The points of one tile with the sums of their samples."""
    found = points.select(kept)
    if not points.num_rows or not samples.num_rows:
        return pa.table({**{n: found.column(n).slice(0, 0) for n in kept}, **{n: pa.array([], pa.float64()) for n in SUMS}})
    whole = lambda t, n: t.column(n).to_numpy().astype(np.int64)
    sums = tile_sums(
        whole(points, "cy"), whole(points, "cx"), points.column("background").to_numpy().astype(float), whole(samples, "y"), whole(samples, "x"),
        samples.column("v").to_numpy().astype(float), samples.column("v").is_null().to_numpy(), radius, inner, outer, ring_samples)
    return pa.table({**{n: found.column(n) for n in kept}, **{n: pa.array(c) for n, c in zip(SUMS, sums.T)}})


def star_points(pixels: DataFrame, levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, star_id, y, x, peak): peaks that survive brightest-first suppression.

    `levels` has (keys…, background, sigma, width, height); star_id is y * width + x.
    """
    carrying = with_group_values(pixels.select(*keys, "y", "x", "v"), keys, levels)
    sized = carrying.filter((F.col("width") >= 5) & (F.col("height") >= 5))
    level = F.col("background") + F.col("sigma") * 3.0
    support = F.col("background") + F.col("sigma") * 1.5
    peaks = local_maxima(sized, keys, level, support, F.col("width"), F.col("height"))
    peaks = cut(peaks.withColumn("star_id", F.col("y").cast("bigint") * F.col("width") + F.col("x")).select(
        *keys, "star_id", "y", "x", F.col("v").alias("peak"), "background", "width", "height"
    ))
    kept = stars.thin_by_distance(peaks, keys, "star_id")
    return peaks.join(kept, [*keys, "star_id"], "left_semi")


def detect_stars(
    pixels: DataFrame, levels: DataFrame, keys: Sequence[str], limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Measurements of all stars, or of the `limit` brightest, and (keys…, star_count) of all found."""
    points = cut(star_points(pixels, levels, keys))
    counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("star_count"))
    order = [F.col("peak").desc(), F.col("y"), F.col("x")]
    top = points if limit is None else top_k_per_group(points, keys, order, limit, "_rn")

    def inside(at: str, size: str) -> Column:
        return F.least(F.greatest(F.col(at), F.lit(3)), F.col(size) - 4)

    centers = top.select(
        *keys, "star_id", inside("x", "width").alias("cx"), inside("y", "height").alias("cy"), "peak", "background"
    )
    return measure_stars(pixels, centers, keys), counts


def frame_levels(pixels: DataFrame, frames: DataFrame, keys: Sequence[str], cap: int | None = None) -> DataFrame:
    """(keys…, width, height, median, mad, background, sigma) from all samples of each raster, or a strided `cap` of them."""
    sized = with_group_values(pixels.select(*keys, "y", "x", "v"), keys, frames.select(*keys, "width", "height"))
    size = F.col("width").cast("bigint") * F.col("height")
    position = F.col("y").cast("bigint") * F.col("width") + F.col("x")
    sample = stride_sample(sized, position, size, cap)
    # the statistics follow from the value counts
    counts = cut(sample.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n")))
    centers, _ = checked(mad(counts, keys, "v", weight="n", bounded=cap is not None))
    delta = F.col("v") - F.col("median")
    spread = with_group_values(counts, keys, centers).groupBy(*keys).agg(
        F.sqrt(F.sum(F.col("n") * delta * delta) / F.sum("n")).alias("sigma")
    )
    return (
        frames.select(*keys, "width", "height").join(centers, list(keys)).join(spread, list(keys))
        .withColumn("background", F.col("median"))
    )


def trail_raster(pixels: DataFrame, frames: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rasters reduced to 1536 and then 768 on the longest side, and their sizes."""
    w1, h1 = analysis_size(F.col("width"), F.col("height"), 1536)
    w2, h2 = analysis_size(F.col("_w1"), F.col("_h1"), 768)
    sizes, _ = checked(
        frames.select(*keys, "width", "height").withColumns({"_w1": w1, "_h1": h1}).withColumns({"_w2": w2, "_h2": h2})
    )
    rows = with_group_values(pixels.select(*keys, "y", "x", "v"), keys, sizes)
    for start, end in ((("width", "height"), ("_w1", "_h1")), (("_w1", "_h1"), ("_w2", "_h2"))):
        rows = resample_nearest(rows, keys, *[F.col(c) for c in (*start, *end)])
    final = sizes.select(*keys, F.col("_w2").alias("width"), F.col("_h2").alias("height"))
    return rows.select(*keys, "y", "x", "v"), final


def frame_metrics(pixels: DataFrame, frames: DataFrame, keys: Sequence[str] = ("frame_id",)) -> DataFrame:
    """One row per frame: level statistics, star metrics, trail, arcsecond scale.

    `pixels` has (keys…, y, x, v); `frames` has (keys…, width, height) and, where known,
    pixel_um and focal_mm; all its columns are kept.
    """
    keys = list(keys)
    levels = cut(frame_levels(pixels, frames, keys))
    extrema = cut(extrema_with_counts(pixels, keys, "v"))
    measured, counts = detect_stars(pixels, levels.select(*keys, "background", "sigma", "width", "height"), keys)
    measured = cut(measured)
    bright = with_group_values(measured, keys, extrema.select(*keys, F.col("max").alias("_top")))
    good = stars.star_quality_filter(bright, keys, F.col("_top"))
    placed = with_group_values(good, keys, levels.select(*keys, "width", "height"))
    shape = center_weighted_medians(placed, keys, ["fwhm", "hfr", "ecc"], F.col("width"), F.col("height"))
    small, sizes = trail_raster(pixels, frames, keys)
    trails = trail.detect_trail(small, sizes, keys)
    zero = F.lit(0.0)
    rows = (
        frames.join(levels.select(*keys, "median", "mad", "background"), keys, "left")
        .join(extrema, keys, "left").join(counts, keys, "left").join(shape, keys, "left")
        .join(trails.withColumnsRenamed({"confidence": "trail_confidence"} | {n: f"trail_{n}" for n in ("x1", "y1", "x2", "y2")}), keys, "left")
        .withColumns({
            "fwhm": F.coalesce("fwhm", zero), "hfr": F.coalesce("hfr", zero),
            "eccentricity": F.coalesce("ecc", zero), "star_count": F.coalesce("star_count", F.lit(0)),
        })
        .withColumnRenamed("background", "mean_background").drop("ecc")
    )
    if {"pixel_um", "focal_mm"} <= set(frames.columns):
        rows = rows.withColumn("fwhm_arcsec", to_arcsec("fwhm", "pixel_um", "focal_mm"))
    return rows
