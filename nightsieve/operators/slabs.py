"""Frame metrics from slabs of rows: one array kernel a slab, and statistics that merge.

A slab (keys…, y0, rows, above, width, height, samples) holds rows y0 to y0 + rows - 1 of a raster, `above` rows before
them and up to as many behind, so every neighbourhood is at hand.  Two passes read the samples.  The first makes
value counts and the few rows of the raster that the trail search looks at; the second, knowing each frame's levels, finds and
measures peaks.  What is shuffled are distinct values, reduced rows and stars, never a row per sample.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightsieve.functions.geometry import to_arcsec
from nightsieve.operators import stars, trail
from nightsieve.operators.detection import APERTURE, RING_INNER, RING_OUTER, RING_SAMPLES
from nightsieve.operators.profile import CHUNK, SUMS, offsets, sample_sums
from nightsieve.operators.raster import support_weights
from nightsieve.operators.statistics import center_weighted_medians, mad, with_group_values
from nightsieve.plans.lookup import checked
from nightsieve.session import cut

#: Rows that a slab needs beside its own: the ring of a star whose centre is moved inside the border.
HALO = RING_OUTER + 3
#: Longest sides of the two reductions before the trail search.
REDUCTIONS = (1536, 768)
#: Distinct values of a frame that one window ranks.
WINDOW_VALUES = 1 << 18


def slab_table(pixels: DataFrame, frames: DataFrame, keys: Sequence[str], slab_rows: int = 256, halo: int = HALO) -> DataFrame:
    """Slabs of rasters that exist as pixel rows (keys…, y, x, v); files are read as slabs from the start."""
    sized = with_group_values(pixels.select(*keys, "y", "x", "v"), keys, frames.select(*keys, "width", "height"))
    first = F.greatest(F.lit(0), F.floor((F.col("y") - halo) / slab_rows))
    last = F.floor(F.least(F.col("y") + halo, F.col("height") - 1) / slab_rows)
    sent = sized.withColumn("_s", F.explode(F.sequence(first, last)))
    cells = sent.groupBy(*keys, "_s", "width", "height").agg(F.sort_array(F.collect_list(F.struct("y", "x", F.col("v").cast("double").alias("v")))).alias("_c"))
    y0 = (F.col("_s") * slab_rows).cast("int")
    return cells.select(
        *keys, y0.alias("y0"), F.least(F.lit(slab_rows), F.col("height") - y0).cast("int").alias("rows"),
        F.least(F.lit(halo), y0).cast("int").alias("above"), "width", "height", F.col("_c.v").alias("samples"))


def _rasters(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int, int, int, np.ndarray]]:
    """(row, y0, rows, above, width, height, samples by row) of each slab."""
    at = {n: batch.schema.get_field_index(n) for n in ("y0", "rows", "above", "width", "height", "samples")}
    for row in range(batch.num_rows):
        y0, rows, above, width, height = (batch.column(at[n])[row].as_py() for n in ("y0", "rows", "above", "width", "height"))
        values = batch.column(at["samples"])[row]
        if values.is_valid:
            yield row, y0, rows, above, width, height, values.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _nearest(target: int, size: int) -> np.ndarray:
    """Source index of each target index of a nearest-sample resize."""
    return np.minimum(size - 1, np.rint(np.arange(target) / max(1, target - 1) * (size - 1)).astype(np.int64))


def _fit(width: int, height: int, longest: int) -> tuple[int, int]:
    side = max(width, height)
    return (width, height) if side <= longest else tuple(max(256, int(np.rint(s * (longest / side)))) for s in (width, height))


def _sources(width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Full-size column and row of each column and row of the reduced raster."""
    xs, ys, w, h = np.arange(width), np.arange(height), width, height
    for longest in REDUCTIONS:
        tw, th = _fit(w, h, longest)
        xs, ys, w, h = xs[_nearest(tw, w)], ys[_nearest(th, h)], tw, th
    return xs, ys


def _survey(batches: Iterator[pa.RecordBatch], keys: Sequence[str], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Value counts, merged over neighbouring slabs of a frame, and the rows of the reduced raster."""
    held: tuple | None = None
    values, counts = np.empty(0), np.empty(0, np.int64)

    def told(name: tuple, values=None, counts=None, y=None, row=None, size=(None, None), error=None) -> pa.RecordBatch:
        cells = [*name, values, counts, y, row, *size, error]
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, out)], schema=out)

    for batch in batches:
        cell = lambda k, at: batch.column(batch.schema.get_field_index(k))[at].as_py()  # noqa: E731, B023
        if "error" in batch.schema.names:
            for at in np.flatnonzero(np.asarray(batch.column(batch.schema.get_field_index("error")).is_valid())).tolist():
                yield told(tuple(cell(k, at) for k in keys), error=cell("error", at))
        for at, y0, rows, above, width, height, raster in _rasters(batch):
            name = tuple(cell(k, at) for k in keys)
            own = raster[above:above + rows]
            real = own[np.isfinite(own)]
            found, n = np.unique(real, return_counts=True)
            if held is not None and held != name:
                yield told(held, values, counts)
                values, counts = np.empty(0), np.empty(0, np.int64)
            held = name
            values, back = np.unique(np.concatenate((values, found)), return_inverse=True)
            counts = np.bincount(back, np.concatenate((counts, n)), len(values)).astype(np.int64)
            xs, ys = _sources(width, height)
            for y in np.flatnonzero((ys >= y0) & (ys < y0 + rows)).tolist():
                yield told(name, y=y, row=own[ys[y] - y0][xs], size=(len(xs), len(ys)))
    if held is not None:
        yield told(held, values, counts)


def survey(slabs: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Value counts (keys…, v, n), rows of the reduced rasters (keys…, y, row, width, height) and (keys…, error) of
    frames with a slab that could not be read, from one read of the samples."""
    schema, arrow = _schemas(slabs, keys, [
        ("values", "array<double>"), ("counts", "array<bigint>"), ("y", "int"), ("row", "array<double>"), ("width", "int"), ("height", "int"), ("error", "string")])
    rows = cut(slabs.mapInArrow(partial(_survey, keys=list(keys), out=arrow), schema))
    pairs = F.explode(F.arrays_zip("values", "counts")).alias("c")
    counts = rows.filter("values is not null").select(*keys, pairs).groupBy(*keys, F.col("c.values").alias("v")).agg(F.sum("c.counts").alias("n"))
    errors = rows.filter("error is not null").groupBy(*keys).agg(F.min("error").alias("error"))
    return cut(counts), rows.filter("y is not null").select(*keys, "y", "row", "width", "height"), errors


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64())}


def _schemas(df: DataFrame, keys: Sequence[str], fields: Sequence[tuple[str, str]]) -> tuple[str, pa.Schema]:
    """The schema of a kernel's rows, the keys before the fields, for Spark and for Arrow."""
    every = [(k, df.schema[k].dataType.simpleString()) for k in keys] + list(fields)
    return ", ".join(f"`{n}` {t}" for n, t in every), pa.schema([(n, _ARROW[t]) for n, t in every])


def levels_of(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, median, mad, background, sigma, min, min_count, max, max_count) from value counts."""
    most = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    # whole-number samples have few values, so one window a frame will do; others are ranked in ranges
    centers, _ = checked(mad(counts, keys, "v", weight="n", bounded=most <= WINDOW_VALUES))
    delta = F.col("v") - F.col("median")
    spread = with_group_values(counts, keys, centers).groupBy(*keys).agg(
        F.sqrt(F.sum(F.col("n") * delta * delta) / F.sum("n")).alias("sigma"), F.min("v").alias("min"),
        F.min_by("n", "v").alias("min_count"), F.max("v").alias("max"), F.max_by("n", "v").alias("max_count"))
    return centers.join(spread, list(keys)).withColumn("background", F.col("median"))


def _peaks(raster: np.ndarray, y0: int, rows: int, above: int, height: int, level: float, support: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (in the slab) and columns of the samples that top their 3x3 box; ties go to the left, then the upper sample."""
    top, bottom = max(above, above + 1 - y0), min(above + rows, above - y0 + height - 1)
    width = raster.shape[1]
    if bottom <= top or width < 5 or height < 5:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    y, x = np.nonzero(raster[top:bottom, 1:width - 1] >= max(level, support))
    y, x = y + top, x + 1
    center, backing, good = raster[y, x], np.zeros(len(y), np.int64), np.ones(len(y), bool)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dy or dx:
                near = raster[y + dy, x + dx]
                backing += near >= support
                later = (dy, dx) in ((0, 1), (1, 0), (-1, 1), (1, 1))
                good &= (center > near) if later else (center >= near)
    good &= backing >= 3
    return y[good], x[good]


_DY, _DX, _BOX, _RING = offsets(APERTURE, RING_INNER, RING_OUTER)


def _profile(raster: np.ndarray, cy: np.ndarray, cx: np.ndarray, background: float) -> np.ndarray:
    """The sums of `SUMS` for each centre; samples beyond the raster count for nothing."""
    high, width = raster.shape
    y, x = cy[:, None] + _DY, cx[:, None] + _DX
    inside = (y >= 0) & (y < high) & (x >= 0) & (x < width)
    v = np.where(inside, raster[np.clip(y, 0, high - 1), np.clip(x, 0, width - 1)], np.nan)
    n = np.isfinite(v[:, _RING]).sum(1)
    return sample_sums(v[:, _BOX], _DY[_BOX], _DX[_BOX], v[:, _RING], n, n >= RING_SAMPLES, background)


def _find(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one = lambda n, k: batch.column(batch.schema.get_field_index(n))[k].as_py()  # noqa: E731, B023
        for at, y0, rows, above, width, height, raster in _rasters(batch):
            background, sigma = one("background", at), one("sigma", at)
            y, x = _peaks(raster, y0, rows, above, height, background + 3.0 * sigma, background + 1.5 * sigma)
            for k in range(0, len(y), CHUNK):
                row, column = y[k:k + CHUNK] + (y0 - above), x[k:k + CHUNK]
                cy, cx = np.clip(row, 3, height - 4), np.clip(column, 3, width - 4)
                sums = _profile(raster, cy - (y0 - above), cx, background)
                names = [pa.array([one(n, at)] * len(row), batch.schema.field(n).type) for n in keys]
                yield pa.RecordBatch.from_arrays(
                    [*names, pa.array(row * width + column), pa.array(row.astype(np.int32)), pa.array(column.astype(np.int32)),
                     pa.array(raster[y[k:k + CHUNK], column]), pa.array(cx.astype(float)), pa.array(cy.astype(float)), *map(pa.array, sums.T)],
                    [*keys, "star_id", "y", "x", "peak", "cx", "cy", *SUMS])


def find_stars(slabs: DataFrame, levels: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(measurements of all stars, (keys…, star_count)) as `detect_stars` gives them, from one read of the samples.

    Peaks are measured where they are found; suppression then chooses among these few rows.
    """
    known = with_group_values(slabs, keys, levels.select(*keys, "background", "sigma"))
    measures = [(n, "double") for n in ("peak", "cx", "cy", *SUMS)]
    schema, _ = _schemas(slabs, keys, [("star_id", "bigint"), ("y", "int"), ("x", "int"), *measures])
    peaks = cut(known.mapInArrow(partial(_find, keys=list(keys)), schema))
    kept = cut(peaks.join(stars.thin_by_distance(peaks, keys, "star_id"), [*keys, "star_id"], "left_semi"))
    fwhm = stars.fit_fwhm(F.col("_n"), F.col("_core"))
    measured = kept.filter("_f > 0").select(
        *keys, "star_id", (F.col("cx") + F.col("_mx")).alias("x"), (F.col("cy") + F.col("_my")).alias("y"), fwhm.alias("fwhm"),
        F.col("_hfr").alias("hfr"), stars.moment_shape()["ecc"].alias("ecc"), "peak")
    return measured.filter((F.col("fwhm") > 0) & (F.col("hfr") > 0)), kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("star_count"))


def _box(raster: np.ndarray, radius: int) -> np.ndarray:
    """Mean over a clamped box, from running sums."""
    for axis in (0, 1):
        wide = np.pad(raster, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        sums = np.cumsum(np.insert(wide, 0, 0.0, axis=axis), axis=axis)
        n = raster.shape[axis]
        raster = np.take(sums, np.arange(2 * radius + 1, 2 * radius + 1 + n), axis) - np.take(sums, np.arange(n), axis)
    return raster / (2 * radius + 1) ** 2


def _votes(y: np.ndarray, x: np.ndarray, signal: np.ndarray, threshold: float, width: int, height: int):
    """(nx, ny, rho) of the line with the most votes in the accumulator of angles and distances; None below the least number."""
    cx, cy, side = (width - 1) * 0.5, (height - 1) * 0.5, min(width, height)
    reach, step = np.hypot(cx, cy), max(2.0, min(5.0, side / 180.0))
    bins = max(180, int(np.ceil(2 * reach / step)) + 1)
    weight = 1 + np.clip(np.rint(signal / max(1e-6, threshold * 3.0)), 0, 3)
    theta = np.arange(trail.ANGLES) / trail.ANGLES * np.pi
    board = np.zeros((trail.ANGLES, bins))
    for angle, t in enumerate(theta):
        at = np.rint(((x - cx) * np.cos(t) + (y - cy) * np.sin(t) + reach) / step).astype(np.int64)
        ok = (at >= 0) & (at < bins)
        board[angle] = np.bincount(at[ok], weight[ok], bins)
    best = int(board.argmax())  # ties: the smallest angle, then the smallest distance
    if board.reshape(-1)[best] < max(20, len(y) // 20):
        return None
    angle, rho = divmod(best, bins)
    return float(np.cos(theta[angle])), float(np.sin(theta[angle])), rho * step - reach


def _candidates(rows: pa.Table, keys: Sequence[str], out: pa.Schema) -> pa.Table:
    """The trail candidates of one reduced raster, each with its frame's line."""
    width, height = rows.column("width")[0].as_py(), rows.column("height")[0].as_py()
    raster = np.zeros((height, width))
    for y, row in zip(rows.column("y").to_pylist(), rows.column("row")):
        raster[y] = row.values.to_numpy(zero_copy_only=False)
    nothing = out.empty_table()
    if width < 16 or height < 16:
        return nothing
    e = np.maximum(0.0, raster - _box(raster, 2))
    flat = np.sort(e.reshape(-1))
    threshold = max(1e-6, float(flat[int(np.rint(0.997 * (len(flat) - 1)))]))
    y, x = np.nonzero(e[5:height - 5, 5:width - 5] >= threshold)
    y, x = y + 5, x + 5
    support = np.zeros((4, len(y)))
    for dy, dx, weights in support_weights():
        near = e[y + dy, x + dx]
        for k in range(4):
            support[k] += weights[k] * near
    ranked = np.sort(support, axis=0)
    best, second = ranked[3], np.maximum(ranked[2], np.where(ranked[3] == support[0], 0.0, ranked[2]))
    good = (best > 2 * np.maximum(0.0, second)) & (best - second >= 2 * threshold)
    y, x, signal = y[good], x[good], (best - second)[good]
    line = _votes(y, x, signal, threshold, width, height) if len(y) >= 12 else None
    if line is None:
        return nothing
    n = len(y)
    cells = [*([rows.column(k)[0].as_py()] * n for k in keys), y, x, signal, [threshold] * n, [width] * n, [height] * n, *([v] * n for v in line)]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cells, out)], schema=out)


def find_trails(reduced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, confidence, x1, y1, x2, y2) of the frames with a trail, from the rows of their reduced rasters.

    A reduced raster has at most 768 samples a side, so one frame is one small task.
    """
    fields = [("y", "int"), ("x", "int"), ("signal", "double"), ("threshold", "double"), ("width", "int"), ("height", "int"), ("nx", "double"), ("ny", "double"), ("rho_value", "double")]
    schema, arrow = _schemas(reduced, keys, fields)
    work = partial(_candidates, keys=list(keys), out=arrow)
    points = cut(reduced.groupBy(*keys).applyInArrow(lambda t: work(t), schema))
    lines = points.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("nx", "ny", "rho_value")])
    shown = points.drop("nx", "ny", "rho_value")
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    return trail.trail_gates_score(shown, trail.principal_axis(shown, lines, keys, w, h), keys, w, h)


def measured_frames(slabs: DataFrame, frames: DataFrame, keys: Sequence[str] = ("frame_id",)) -> tuple[DataFrame, DataFrame]:
    """(one row per frame as `detection.frame_metrics` gives it, (keys…, error) of frames that could not be read whole).

    A frame with an unreadable slab has no metrics.  All columns of `frames` are kept.
    """
    keys = list(keys)
    counts, reduced, errors = survey(slabs, keys)
    errors = cut(errors)
    frames = frames.join(errors.select(*keys), keys, "left_anti")
    levels = cut(levels_of(counts, keys).join(errors.select(*keys), keys, "left_anti"))
    measured, found = find_stars(slabs, levels, keys)
    measured = cut(measured)
    bright = with_group_values(measured, keys, levels.select(*keys, F.col("max").alias("_top")))
    good = stars.star_quality_filter(bright, keys, F.col("_top"))
    placed = with_group_values(good, keys, frames.select(*keys, "width", "height"))
    shape = center_weighted_medians(placed, keys, ["fwhm", "hfr", "ecc"], F.col("width"), F.col("height"))
    trails = find_trails(reduced, keys).withColumnsRenamed({"confidence": "trail_confidence"} | {n: f"trail_{n}" for n in ("x1", "y1", "x2", "y2")})
    told = levels.select(*keys, "median", "mad", "background", "min", "min_count", "max", "max_count")
    zero = F.lit(0.0)
    rows = frames.join(told, keys, "left").join(found, keys, "left").join(shape, keys, "left").join(trails, keys, "left").withColumns({
        "fwhm": F.coalesce("fwhm", zero), "hfr": F.coalesce("hfr", zero), "eccentricity": F.coalesce("ecc", zero),
        "star_count": F.coalesce("star_count", F.lit(0)), "trail_confidence": F.coalesce("trail_confidence", F.lit(0)),
    }).withColumnRenamed("background", "mean_background").drop("ecc")
    if {"pixel_um", "focal_mm"} <= set(frames.columns):
        rows = rows.withColumn("fwhm_arcsec", to_arcsec("fwhm", "pixel_um", "focal_mm"))
    return rows, errors


def frame_metrics(slabs: DataFrame, frames: DataFrame, keys: Sequence[str] = ("frame_id",)) -> DataFrame:
    """The metrics of `measured_frames`."""
    return measured_frames(slabs, frames, keys)[0]
