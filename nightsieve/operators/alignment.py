"""Frame alignment and the region worth looking at."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightsieve.functions.geometry import arcsec_per_pixel, edge_margin
from nightsieve.operators import detection, stars
from nightsieve.operators.ordering import argmax
from nightsieve.operators.raster import box_blur, local_variance, resample_bilinear, resample_nearest
from nightsieve.operators.statistics import correlation, nearest_rank_percentile, with_group_values
from nightsieve.plans.groups import per_group, split_large
from nightsieve.plans.lookup import lookup_join
from nightsieve.session import cut

# Fixed values of the alignment search.
COARSE, FINE, COARSE_SHIFT, FINE_SHIFT = 64, 256, 8, 4
ROTATE_GAIN = 0.02
PATCH, STRIDE = 192, 4


def density_map(
    df: DataFrame, keys: Sequence[str], width: Column | float, height: Column | float, size: int, peak: str = "peak",
    sizes: DataFrame | None = None,
) -> DataFrame:
    """(keys…, y, x, v): every cell of a star-density map, mean 0.

    A star adds a Gaussian blob of bounded radius weighted by ln(1 + peak), so it
    reaches a fixed number of cells.  A frame's map is added up in one kernel call; the cells of frames
    with very many stars (`sizes`: see `split_large`) are shuffled and summed instead.
    """
    small, large = split_large(df, keys, sizes)
    sigma, last = max(1.5, size * 0.015), size - 1
    radius = math.ceil(sigma * 2.5)
    w, h = [F.lit(float(c)) if isinstance(c, (int, float)) else c for c in (width, height)]
    sized = (w > 1) & (h > 1)
    weight = F.when(sized & (F.col(peak) > 0), F.ln(F.lit(1.0) + F.col(peak)))
    placed = small.select(
        *keys, weight.alias("wt"), F.when(sized, F.col("x") * (F.lit(float(last)) / (w - 1))).alias("cx"),
        F.when(sized, F.col("y") * (F.lit(float(last)) / (h - 1))).alias("cy"),
    )
    ys, xs = np.divmod(np.arange(size * size, dtype=np.int32), np.int32(size))

    def add_up(stars: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        grid = density_grid(*[stars[c].astype(float) for c in ("wt", "cy", "cx")], size, sigma, radius)
        return {"y": ys, "x": xs, "v": grid - grid.sum() / (size * size)}

    maps = per_group(placed, keys, add_up, "y int, x int, v double")
    return maps if large is None else maps.unionByName(_density_cells(large, keys, width, height, size, peak))


def density_grid(weight: np.ndarray, cy: np.ndarray, cx: np.ndarray, size: int, sigma: float, radius: int) -> np.ndarray:
    """The sums of a size x size map, row by row."""
    usable = np.isfinite(weight) & np.isfinite(cy) & np.isfinite(cx)
    usable &= (np.abs(cy) < 4 * size + radius) & (np.abs(cx) < 4 * size + radius)  # others reach no cell
    weight, cy, cx = weight[usable], cy[usable], cx[usable]
    steps, grid = np.arange(-radius, radius + 2), np.zeros(size * size)
    for at in range(0, len(weight), 4096):
        wt, y, x = weight[at:at + 4096], cy[at:at + 4096], cx[at:at + 4096]
        rows, columns = (np.floor(c).astype(np.int64)[:, None] + steps for c in (y, x))
        squared = ((rows - y[:, None]) ** 2)[:, :, None] + ((columns - x[:, None]) ** 2)[:, None, :]
        inside = ((rows >= 0) & (rows < size))[:, :, None] & ((columns >= 0) & (columns < size))[:, None, :]
        star, row, column = np.nonzero((squared <= radius * radius) & inside)
        cell = rows[star, row] * size + columns[star, column]
        grid += np.bincount(cell, wt[star] * np.exp(-squared[star, row, column] / (2.0 * sigma * sigma)), size * size)
    return grid


def _density_cells(df: DataFrame, keys: Sequence[str], width: Column | float, height: Column | float, size: int, peak: str) -> DataFrame:
    """`density_map` with a row per star and cell."""
    w, h = [F.lit(float(c)) if isinstance(c, (int, float)) else c for c in (width, height)]
    sigma = max(1.5, size * 0.015)
    radius = math.ceil(sigma * 2.5)
    last = size - 1
    weight = F.ln(F.lit(1.0) + F.greatest(F.lit(0.0), F.col(peak)))
    placed = df.filter((w > 1) & (h > 1) & F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        *keys, weight.alias("_wt"), (F.col("x") * (F.lit(float(last)) / (w - 1))).alias("_cx"),
        (F.col("y") * (F.lit(float(last)) / (h - 1))).alias("_cy"),
    ).filter(F.col("_wt") > 0)

    def cells(c: str) -> Column:
        low = F.greatest(F.lit(0), F.floor(c).cast("int") - radius)
        high = F.least(F.lit(last), F.ceil(c).cast("int") + radius)
        return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

    spread = placed.withColumn("y", F.explode(cells("_cy"))).withColumn("x", F.explode(cells("_cx")))
    squared = (F.col("y") - F.col("_cy")) ** 2 + (F.col("x") - F.col("_cx")) ** 2
    blobs = spread.withColumn("_d", squared).filter(F.col("_d") <= radius * radius).select(
        *keys, "y", "x", (F.col("_wt") * F.exp(-F.col("_d") / F.lit(2.0 * sigma * sigma))).alias("v")
    )
    # every frame's full grid, so that empty cells weigh in at minus the mean
    line = F.sequence(F.lit(0), F.lit(last))
    empty = df.select(*keys).distinct().select(*keys, F.explode(line).alias("y")).select(
        *keys, "y", F.explode(line).alias("x"), F.lit(0.0).alias("v")
    )
    cells_sum = blobs.unionByName(empty).groupBy(*keys, "y", "x").agg(F.sum("v").alias("v"))
    means = blobs.groupBy(*keys).agg((F.sum("v") / F.lit(float(size * size))).alias("_mean"))
    return lookup_join(cells_sum, means, keys, "left").select(
        *keys, "y", "x", (F.col("v") - F.coalesce("_mean", F.lit(0.0))).alias("v")
    )


def map_array(maps: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """One array per frame, row by row; a map has a fixed number of cells."""
    listed = F.sort_array(F.collect_list(F.struct("y", "x", "v")))
    return maps.groupBy(*keys).agg(F.transform(listed, lambda c: c["v"]).alias(out))


def _shifted_correlation(ref: np.ndarray, cand: np.ndarray, dx: int, dy: int) -> float:
    """Pearson correlation over the overlap of two square maps; -1 below half overlap."""
    size = ref.shape[0]
    w, h = size - abs(dx), size - abs(dy)
    if w < size // 2 or h < size // 2:
        return -1.0
    a = ref[max(0, dy):size + min(0, dy), max(0, dx):size + min(0, dx)].astype(float)
    b = cand[max(0, -dy):size + min(0, -dy), max(0, -dx):size + min(0, -dx)].astype(float)
    a, b = a - a.mean(), b - b.mean()
    na, nb = float((a * a).sum()), float((b * b).sum())
    return -1.0 if na <= 1e-20 or nb <= 1e-20 else float((a * b).sum() / math.sqrt(na * nb))


def _best_shift(ref: np.ndarray, cand: np.ndarray, center: tuple[int, int], radius: int) -> tuple[float, int, int]:
    best = (-1.0, center[0], center[1])
    for dy in range(center[1] - radius, center[1] + radius + 1):
        for dx in range(center[0] - radius, center[0] + radius + 1):
            score = _shifted_correlation(ref, cand, dx, dy)
            if score > best[0]:
                best = (score, dx, dy)
    return best


SHIFT = "score double, dx int, dy int"


def shift_correlation(df: DataFrame, reference: str, candidate: str, max_shift: int, out: str = "shift") -> DataFrame:
    """Adds (score, dx, dy) of the best shift between two square maps held as arrays.

    A row holds one frame's map, a few thousand cells; all shifts are tried in one
    vectorised call per batch of rows.
    """

    @F.pandas_udf(SHIFT)
    def search(ref: pd.Series, cand: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(ref, cand):
            side = math.isqrt(len(a))
            rows.append(_best_shift(np.reshape(a, (side, side)), np.reshape(b, (side, side)), (0, 0), max_shift))
        return pd.DataFrame(rows, columns=["score", "dx", "dy"])

    return df.withColumn(out, search(reference, candidate))


def pyramid_shift(df: DataFrame, out: str = "shift") -> DataFrame:
    """Best shift in fine cells: a wide search on coarse maps, refined on fine ones.

    Columns: ref_coarse, ref_fine, coarse, fine.
    """
    ratio = FINE // COARSE

    @F.pandas_udf(SHIFT)
    def search(rc: pd.Series, rf: pd.Series, cc: pd.Series, cf: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b, c, d in zip(rc, rf, cc, cf):
            small, large = (COARSE, COARSE), (FINE, FINE)
            _, dx, dy = _best_shift(np.reshape(a, small), np.reshape(c, small), (0, 0), COARSE_SHIFT)
            rows.append(_best_shift(np.reshape(b, large), np.reshape(d, large), (dx * ratio, dy * ratio), FINE_SHIFT))
        return pd.DataFrame(rows, columns=["score", "dx", "dy"])

    return df.withColumn(out, search("ref_coarse", "ref_fine", "coarse", "fine"))


def orientation_stars(pixels: DataFrame, frames: DataFrame, keys: Sequence[str], k: int = 160) -> tuple[DataFrame, DataFrame]:
    """The stars alignment compares, in sample pixels, and the sample sizes.

    Frames finer than one arcsecond per pixel are reduced to that scale.
    """
    scale = F.lit(None).cast("double")
    if {"pixel_um", "focal_mm"} <= set(frames.columns):
        scale = arcsec_per_pixel("pixel_um", "focal_mm")
    factor = F.when((scale > 0) & (scale < 1.0), scale).otherwise(F.lit(1.0))
    sizes = cut(frames.select(
        *keys, F.col("width").alias("_fw"), F.col("height").alias("_fh"),
        F.greatest(F.lit(1), F.rint(F.col("width") * factor).cast("int")).alias("width"),
        F.greatest(F.lit(1), F.rint(F.col("height") * factor).cast("int")).alias("height"),
    ))
    sized = with_group_values(pixels.select(*keys, "y", "x", "v"), keys, sizes)
    same = (F.col("_fw") == F.col("width")) & (F.col("_fh") == F.col("height"))
    kept = sized.filter(same).select(*keys, "y", "x", "v")
    reduced = resample_bilinear(
        sized.filter(~same), keys, F.col("_fw"), F.col("_fh"), F.col("width"), F.col("height")
    ).select(*keys, "y", "x", "v")
    sample = cut(kept.unionByName(reduced))
    levels = cut(detection.frame_levels(sample, sizes, keys))
    measured, _ = detection.detect_stars(sample, levels.select(*keys, "background", "sigma", "width", "height"), keys)
    placed = with_group_values(cut(measured), keys, sizes.select(*keys, "width", "height"))
    inner = placed.filter((F.col("peak") > 0) & edge_margin("x", "y", F.col("width"), F.col("height"), 0.10))
    separation = F.greatest(F.lit(16.0), F.least("width", "height") * 0.01)
    # the separation follows the frame's size; positions in units of it need one radius for all
    scaled = inner.withColumns({"_x": F.col("x"), "_y": F.col("y"), "x": F.col("x") / separation, "y": F.col("y") / separation})
    picked = stars.top_k_separated(scaled, keys, "star_id", k, 1.0)
    return picked.withColumns({"x": F.col("_x"), "y": F.col("_y")}).drop("_x", "_y"), sizes


def align_frames(
    pixels: DataFrame, frames: DataFrame, order: str, key: str = "frame_id", ok: Column | None = None
) -> DataFrame:
    """(key, rotate180, shift_x, shift_y, score) of each frame against the first usable one.

    Density maps of the frame as it is and turned by 180 degrees are correlated with
    the reference's; a turn must gain more than 0.02.  The winning shift is refined on
    a strided patch of the full-size rasters where they are large enough, and kept
    within a quarter of the frame.
    """
    picked, sizes = orientation_stars(pixels, frames, [key])
    picked, sizes = cut(picked), sizes.select(key, "width", "height", "_fw", "_fh")
    counts = picked.groupBy(key).agg(F.count(F.lit(1)).alias("_stars"))
    mapped = None
    for side, name in ((COARSE, "coarse"), (FINE, "fine")):
        one = map_array(density_map(picked, [key], F.col("width"), F.col("height"), side), [key], name)
        mapped = one if mapped is None else mapped.join(one, key)
    usable = frames if ok is None else frames.filter(ok)
    first = usable.agg(F.min_by(key, order).alias("r"))
    base = cut(mapped.join(counts, key))
    ref = base.join(first.withColumnRenamed("r", key), key, "left_semi").agg(
        F.first(F.struct("coarse", "fine", "_stars")).alias("r")
    )
    paired = base.withColumn("_ref", ref.scalar()).withColumns(
        {"ref_coarse": F.col("_ref.coarse"), "ref_fine": F.col("_ref.fine"), "_ref_stars": F.col("_ref._stars")}
    ).filter((F.col("_stars") >= 5) & (F.col("_ref_stars") >= 5)).drop("_ref")
    straight = pyramid_shift(paired, "s").select(key, F.col("s").alias("_straight"))
    turned = paired.withColumns({"coarse": F.reverse("coarse"), "fine": F.reverse("fine")})
    rotated = pyramid_shift(turned, "s").select(key, F.col("s").alias("_turned"))
    both = frames.select(key).join(straight, key, "left").join(rotated, key, "left").join(sizes, key, "left")
    score0, score1 = F.coalesce("_straight.score", F.lit(-1.0)), F.coalesce("_turned.score", F.lit(-1.0))
    chosen = both.withColumn("rotate180", score1 > score0 + F.lit(ROTATE_GAIN)).withColumn(
        "_s", F.when(F.col("rotate180"), F.col("_turned")).otherwise(F.col("_straight"))
    )

    def to_image(cells: str, sample: str, full: str) -> Column:
        per_cell = F.when(F.col(sample) > 1, (F.col(sample) - 1) / F.lit(float(FINE - 1))).otherwise(1.0)
        per_sample = F.when(F.col(sample) > 1, (F.col(full) - 1) / (F.col(sample) - 1)).otherwise(1.0)
        return F.rint(F.coalesce(F.col(cells), F.lit(0)) * per_cell * per_sample).cast("int")

    def reach(sample: str, full: str) -> Column:
        return F.ceil(F.when(F.col(sample) > 1, (F.col(full) - 1) / (F.col(sample) - 1)).otherwise(1.0)).cast("int") + 1

    seeds = cut(chosen.select(
        key, "rotate180", F.coalesce("_s.score", F.lit(-1.0)).alias("score"), F.col("_fw").alias("width"), F.col("_fh").alias("height"),
        to_image("_s.dx", "width", "_fw").alias("dx"), to_image("_s.dy", "height", "_fh").alias("dy"),
        reach("width", "_fw").alias("rx"), reach("height", "_fh").alias("ry"),
    ))
    refined = refine_shift(pixels, seeds, first, key)

    def limit(c: str, size: str) -> Column:
        bound = F.greatest(F.lit(1), F.floor(F.col(size) / 4).cast("int"))
        return F.least(F.greatest(F.col(c), -bound), bound)

    return seeds.drop("dx", "dy").join(refined, key).select(
        key, "rotate180", limit("dx", "width").alias("shift_x"), limit("dy", "height").alias("shift_y"), "score"
    )


def refine_shift(pixels: DataFrame, seeds: DataFrame, first: DataFrame, key: str) -> DataFrame:
    """(key, dx, dy): best shift around each seed by correlating strided centre patches.

    A sample takes part in the few shifts whose patch grid it lies on; sums for the
    correlation add up per (frame, shift), so nothing but sums is shuffled after the
    patches have met.
    """
    span = PATCH * STRIDE
    fits = F.least("width", "height") >= span + 2 * F.greatest("rx", "ry") + 4
    start = lambda size: F.floor(F.col(size) / 2).cast("int") - span // 2
    large = seeds.filter(fits)
    if large.isEmpty():
        return seeds.select(key, "dx", "dy")
    reference = pixels.join(first.withColumnRenamed("r", key), key, "left_semi")
    ref_size = seeds.join(first.withColumnRenamed("r", key), key, "left_semi")
    at = with_group_values(reference, [key], ref_size.select(key, "width", "height"))
    ry, rx = F.col("y") - start("height"), F.col("x") - start("width")
    on_grid = ry.between(0, span - 1) & rx.between(0, span - 1) & (ry % STRIDE == 0) & (rx % STRIDE == 0)
    patch = at.filter(on_grid).select(
        F.floor(ry / STRIDE).cast("int").alias("py"), F.floor(rx / STRIDE).cast("int").alias("px"), F.col("v").alias("a")
    )
    shifts = large.withColumn("_ddy", F.explode(F.sequence(-F.col("ry"), F.col("ry")))).withColumn(
        "_ddx", F.explode(F.sequence(-F.col("rx"), F.col("rx")))
    )
    origin = ref_size.agg(F.first(F.struct(start("height").alias("y"), start("width").alias("x")))).scalar()
    shifts = shifts.withColumn("_o", origin).select(
        key, "rotate180", "width", "height", (F.col("dx") + F.col("_ddx")).alias("sx"), (F.col("dy") + F.col("_ddy")).alias("sy"),
        (F.col("_o.x") - F.col("dx") - F.col("_ddx")).alias("_x0"), (F.col("_o.y") - F.col("dy") - F.col("_ddy")).alias("_y0"),
    ).filter(
        (F.col("_x0") >= 0) & (F.col("_y0") >= 0) & (F.col("_x0") + span <= F.col("width")) & (F.col("_y0") + span <= F.col("height"))
    )
    listed = shifts.groupBy(key, "rotate180", "width", "height").agg(
        F.collect_list(F.struct("sx", "sy", "_x0", "_y0")).alias("_shifts")  # (2r+1)^2 entries
    )
    rows = with_group_values(pixels, [key], listed)
    ux = F.when(F.col("rotate180"), F.col("width") - 1 - F.col("x")).otherwise(F.col("x"))
    uy = F.when(F.col("rotate180"), F.col("height") - 1 - F.col("y")).otherwise(F.col("y"))
    rows = rows.withColumns({"_ux": ux, "_uy": uy})

    def touches(s: Column) -> Column:
        qx, qy = F.col("_ux") - s["_x0"], F.col("_uy") - s["_y0"]
        return qx.between(0, span - 1) & qy.between(0, span - 1) & (qx % STRIDE == 0) & (qy % STRIDE == 0)

    cand = rows.select(key, "v", "_ux", "_uy", F.explode(F.filter("_shifts", touches)).alias("s")).select(
        key, F.col("s.sx").alias("sx"), F.col("s.sy").alias("sy"), F.col("v").alias("b"),
        F.floor((F.col("_uy") - F.col("s._y0")) / STRIDE).cast("int").alias("py"),
        F.floor((F.col("_ux") - F.col("s._x0")) / STRIDE).cast("int").alias("px"),
    )
    met = cand.join(F.broadcast(patch), ["py", "px"])  # the patch has 192 x 192 samples
    scores = correlation(met, [key, "sx", "sy"], "a", "b", "score")
    best = scores.groupBy(key).agg(
        F.max_by(F.struct("sx", "sy"), F.struct(F.col("score"), -F.col("sy"), -F.col("sx"))).alias("b")
    )
    return seeds.join(best, key, "left").select(
        key, F.coalesce("b.sx", "dx").alias("dx"), F.coalesce("b.sy", "dy").alias("dy")
    )


def roi_center(pixels: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, cx, cy) of the most structured region, biased to the centre.

    Works on a raster reduced to 192 samples on the longest side: extended brightness
    times local contrast times a central weight, best cell first in row order.
    """
    keys = list(keys)
    longest = F.greatest("width", "height")
    scale = F.when(longest > 192, F.lit(192.0) / longest).otherwise(F.lit(1.0))
    sizes = frames.select(
        *keys, "width", "height", F.greatest(F.lit(32), F.rint(F.col("width") * scale).cast("int")).alias("_sw"),
        F.greatest(F.lit(32), F.rint(F.col("height") * scale).cast("int")).alias("_sh"),
    )
    sized = with_group_values(pixels.select(*keys, "y", "x", "v"), keys, sizes)
    small = resample_nearest(sized, keys, F.col("width"), F.col("height"), F.col("_sw"), F.col("_sh"))
    small = cut(small.select(*keys, "y", "x", "v", "width", "height", "_sw", "_sh"))
    levels = nearest_rank_percentile(small, keys, "v", {"_bg": 0.5, "_hi": 0.98})
    base = with_group_values(small, keys, levels)
    ceiling = F.greatest(F.col("_bg") + 1e-6, F.col("_hi"))
    base = cut(base.withColumn("v", F.least(F.greatest(F.col("v") - F.col("_bg"), F.lit(0.0)), ceiling)).drop("_bg", "_hi"))
    # both radii follow the reduced short side (32..192 samples), so few pairs of radii exist
    short = F.least("_sw", "_sh")
    base = base.withColumns({
        "_wide": F.greatest(F.lit(3), F.rint(short * 0.06).cast("int")),
        "_narrow": F.greatest(F.lit(1), F.rint(short * 0.015).cast("int")),
    })
    scored = None
    for wide, narrow in sorted(tuple(r) for r in base.select("_wide", "_narrow").distinct().collect()):
        part = base.filter((F.col("_wide") == wide) & (F.col("_narrow") == narrow))
        one = _roi_scores(part, keys, wide, narrow)
        scored = one if scored is None else scored.unionByName(one)
    if scored is None:
        return frames.select(*keys, F.lit(0).alias("cx"), F.lit(0).alias("cy")).limit(0)
    best = argmax(scored, [*keys, "_sw", "_sh"], "score")
    placed = best.join(frames.select(*keys, "width", "height"), keys)

    def full(at: str, small_size: str, size: str) -> Column:
        pos = F.rint(F.col(at) / F.greatest(F.lit(1), F.col(small_size) - 1) * (F.col(size) - 1)).cast("int")
        return F.least(F.greatest(pos, F.lit(0)), F.col(size) - 1)

    return placed.select(*keys, full("x", "_sw", "width").alias("cx"), full("y", "_sh", "height").alias("cy"))


def _roi_scores(df: DataFrame, keys: list[str], wide: int, narrow: int) -> DataFrame:
    sw, sh = F.col("_sw"), F.col("_sh")
    rows = box_blur(df, keys, wide, sw, sh, "v", "_s1")
    rows = box_blur(rows, keys, wide, sw, sh, "_s1", "structure")
    rows = box_blur(rows, keys, narrow, sw, sh, "v", "_detail")
    rows = local_variance(rows, keys, wide, sw, sh, "_detail", "contrast")
    rows = cut(rows.select(*keys, "y", "x", "_sw", "_sh", "structure", "contrast"))
    tops = rows.groupBy(*keys).agg(F.max("structure").alias("_ms"), F.max("contrast").alias("_mc"))
    rows = with_group_values(rows, keys, tops)
    s = F.when(F.col("_ms") > 0, F.col("structure") / F.col("_ms")).otherwise(0.0)
    c = F.when(F.col("_mc") > 0, F.col("contrast") / F.col("_mc")).otherwise(0.0)
    sigma = F.least(sw, sh) * 0.35
    dx, dy = F.col("x") - (sw - 1) * 0.5, F.col("y") - (sh - 1) * 0.5
    central = F.exp(-(dx * dx + dy * dy) / (sigma * sigma * 2.0))
    score = (s * 0.6 + c * 0.4) * (s * 0.7 + 0.3) * (c * 0.7 + 0.3) * central
    mx, my = F.rint(sw * 0.05), F.rint(sh * 0.05)
    inside = F.col("x").between(mx, sw - mx - 1) & F.col("y").between(my, sh - my - 1)
    return rows.filter(inside).select(*keys, "y", "x", "_sw", "_sh", score.alias("score"))


def roi_rect(centers: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Normalised square around a centre: 400 px, within 240 and the smaller of 640 and half the short side."""
    short = F.least(width, height)
    high = F.least(F.lit(640.0), short * 0.5)
    low = F.least(F.least(short.cast("double"), F.lit(240.0)), high)
    side = F.least(F.greatest(F.lit(400.0), low), high)
    out = {}
    for at, size, name, extent in (("cx", width, "left", "roi_width"), ("cy", height, "top", "roi_height")):
        share = side / F.col(size)
        center = F.when(F.col(size) <= 1, F.lit(0.5)).otherwise(F.col(at) / (F.col(size) - 1))
        out[name] = F.least(F.greatest(center - share / 2.0, F.lit(0.0)), F.greatest(F.lit(0.0), F.lit(1.0) - share))
        out[extent] = share
    return centers.withColumns(out)
