"""Straight trails: votes for lines, the principal axis of their points, gates and score."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightsieve.operators.ordering import top_k_per_group
from nightsieve.operators.raster import box_blur, directional_support
from nightsieve.operators.statistics import max_gap, nearest_rank_percentile, stride_sample, with_group_values
from nightsieve.plans.groups import per_group, split_large
from nightsieve.plans.lookup import checked
from nightsieve.session import cut

ANGLES = 180  # fixed value: angle bins of a half turn


def _c(value: Column | float) -> Column:
    return F.lit(float(value)) if isinstance(value, (int, float)) else value


def geometry(width: Column | float, height: Column | float) -> dict[str, Column]:
    """Image centre, largest distance from it, and bin sizes, as columns of a frame."""
    w, h = _c(width), _c(height)
    cx, cy = (w - 1) * 0.5, (h - 1) * 0.5
    side = F.least(w, h)
    rho_bin = F.greatest(F.lit(2.0), F.least(F.lit(5.0), side / 180.0))
    reach = F.sqrt(cx * cx + cy * cy)
    return {
        "_cx": cx, "_cy": cy, "_reach": reach, "_rho_bin": rho_bin,
        "_rho_bins": F.greatest(F.lit(180), F.ceil(F.lit(2.0) * reach / rho_bin).cast("int") + 1),
        "_span_bin": F.greatest(F.lit(4.0), side / 90.0), "_side": side,
    }


def line_votes(
    points: DataFrame, keys: Sequence[str], threshold: Column, width: Column | float, height: Column | float, signal: str = "signal",
    sizes: DataFrame | None = None,
) -> DataFrame:
    """(keys…, angle, rho, votes, points, nx, ny, rho_value): the line most points of a frame vote for.

    Each point votes for one line per degree, with weight 1 to 4 by its signal.
    Frames whose best line has fewer than max(20, points / 20) votes are left out.
    A frame's votes are counted in one kernel call; those of frames with very many points
    (`sizes`: see `split_large`) are shuffled and summed instead.
    """
    weight = F.lit(1) + F.least(
        F.greatest(F.rint(F.col(signal) / F.greatest(F.lit(1e-6), threshold * 3.0)), F.lit(0.0)), F.lit(3.0)
    ).cast("int")
    small, large = split_large(points, keys, sizes)
    theta = F.col("angle") / F.lit(float(ANGLES)) * F.lit(math.pi)
    shaped = small.withColumns(geometry(width, height)).select(
        *keys, (F.col("x") - F.col("_cx")).alias("dx"), (F.col("y") - F.col("_cy")).alias("dy"), weight.alias("weight"),
        F.col("_reach").alias("reach"), F.col("_rho_bin").alias("rho_bin"), F.col("_rho_bins").alias("rho_bins"),
    )
    found = per_group(shaped, keys, best_line, "angle int, rho int, votes bigint, points bigint, rho_value double")
    winners = found.withColumns({"nx": F.cos(theta), "ny": F.sin(theta)})
    if large is not None:
        winners = winners.unionByName(_line_votes_by_bins(large, keys, weight, theta, width, height))
    return winners.filter(F.col("votes") >= F.greatest(F.lit(20), F.floor(F.col("points") / 20)))


def best_line(points: dict[str, np.ndarray]) -> dict[str, list]:
    """The line of one frame with the most votes; ties go to the smaller angle, then the smaller rho."""
    reach, rho_bin, bins = float(points["reach"][0]), float(points["rho_bin"][0]), int(points["rho_bins"][0])
    theta = [a / float(ANGLES) * math.pi for a in range(ANGLES)]
    cos, sin = (np.array([f(t) for t in theta])[:, None] for f in (math.cos, math.sin))
    placed = np.isfinite(points["dx"]) & np.isfinite(points["dy"])
    dx, dy, weight = (points[c][placed] for c in ("dx", "dy", "weight"))
    first, counts = np.arange(ANGLES)[:, None] * bins, np.zeros(ANGLES * bins)
    for at in range(0, len(dx), 2048):
        part = slice(at, at + 2048)
        rho = np.rint((dx[part] * cos + dy[part] * sin + reach) / rho_bin)
        valid = (rho >= 0) & (rho < bins)
        cell = np.where(valid, rho, 0).astype(np.int64) + first
        counts += np.bincount(cell.ravel(), np.where(valid, weight[part], 0).ravel(), ANGLES * bins)
    angle, rho = divmod(int(counts.argmax()), bins)
    return {
        "angle": np.array([angle], np.int32), "rho": np.array([rho], np.int32), "votes": np.array([int(counts.max())]),
        "points": np.array([len(placed)]), "rho_value": np.array([rho * rho_bin - reach]),
    }


def _line_votes_by_bins(
    points: DataFrame, keys: Sequence[str], weight: Column, theta: Column, width: Column | float, height: Column | float
) -> DataFrame:
    """The best line of each frame with a row per point and angle."""
    shaped = points.withColumns(geometry(width, height)).withColumn("_weight", weight)
    counts = shaped.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"))
    cast = shaped.select("*", F.explode(F.sequence(F.lit(0), F.lit(ANGLES - 1))).alias("angle"))
    rho = (F.col("x") - F.col("_cx")) * F.cos(theta) + (F.col("y") - F.col("_cy")) * F.sin(theta)
    index = F.rint((rho + F.col("_reach")) / F.col("_rho_bin")).cast("int")
    bins = (
        cast.select(*keys, "angle", index.alias("rho"), "_weight", "_rho_bins", "_reach", "_rho_bin")
        .filter((F.col("rho") >= 0) & (F.col("rho") < F.col("_rho_bins")))
        .groupBy(*keys, "angle", "rho")
        .agg(
            F.sum("_weight").alias("votes"),
            (F.col("rho") * F.first("_rho_bin") - F.first("_reach")).alias("rho_value"),
        )
        .withColumns({"nx": F.cos(theta), "ny": F.sin(theta)})
    )
    best = F.max_by(
        F.struct("angle", "rho", "votes", "nx", "ny", "rho_value"), F.struct(F.col("votes"), -F.col("angle"), -F.col("rho"))
    )
    winners = bins.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")
    return winners.join(counts, list(keys))


def principal_axis(
    points: DataFrame, lines: DataFrame, keys: Sequence[str], width: Column | float, height: Column | float,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """(keys…, inliers, ex, ey, nx, ny, rho, elongation): direction of the points near each line.

    Left out are frames with fewer than 10 points near it or an elongation below 7.
    """
    near = with_group_values(points.withColumns(geometry(width, height)), keys, lines.select(*keys, "nx", "ny", "rho_value"))
    dx, dy = F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy")
    off = F.abs(dx * F.col("nx") + dy * F.col("ny") - F.col("rho_value"))
    inside = near.filter(off <= F.greatest(F.lit(2.5), F.col("_rho_bin") * 1.2))
    small, large = split_large(inside.select(*keys, dx.alias("_dx"), dy.alias("_dy")), keys, sizes)
    dealt = small.repartition(*keys)  # no partial sums of every frame in every task
    dx, dy = F.col("_dx"), F.col("_dy")
    sums = [
        F.count(F.lit(1)).alias("inliers"), F.avg(dx).alias("_mx"), F.avg(dy).alias("_my"),
        F.var_pop(dx).alias("_xx"), F.var_pop(dy).alias("_yy"), F.covar_pop(dx, dy).alias("_xy"),
    ]
    stats = dealt.groupBy(*keys).agg(*sums)
    if large is not None:
        stats = stats.unionByName(large.groupBy(*keys).agg(*sums))
    xx, yy, xy = F.col("_xx"), F.col("_yy"), F.col("_xy")
    trace = xx + yy
    root = F.sqrt(F.greatest(F.lit(0.0), trace * trace / 4.0 - (xx * yy - xy * xy)))
    major, minor = trace / 2.0 + root, trace / 2.0 - root
    skewed = F.abs(xy) > 1e-10
    vx = F.when(skewed, major - yy).when(xx >= yy, F.lit(1.0)).otherwise(F.lit(0.0))
    vy = F.when(skewed, xy).when(xx >= yy, F.lit(0.0)).otherwise(F.lit(1.0))
    shaped = stats.filter(F.col("inliers") >= 10).withColumns({"_l1": major, "_l2": minor, "_vx": vx, "_vy": vy})
    length = F.sqrt(F.col("_vx") * F.col("_vx") + F.col("_vy") * F.col("_vy"))
    kept = shaped.filter((F.col("_l2") >= 1e-9) & (F.col("_l1") >= F.col("_l2") * 7.0) & (length >= 1e-10))
    ex, ey = F.col("_vx") / length, F.col("_vy") / length
    return kept.select(
        *keys, "inliers", ex.alias("ex"), ey.alias("ey"), (-ey).alias("nx"), ex.alias("ny"),
        (F.col("_mx") * -ey + F.col("_my") * ex).alias("rho"), (F.col("_l1") / F.col("_l2")).alias("elongation"),
    )


def trail_gates_score(
    points: DataFrame, axes: DataFrame, keys: Sequence[str], width: Column | float, height: Column | float, bounded: bool = True,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """(keys…, confidence 1..100, x1, y1, x2, y2) of the trails that pass every gate; ends normalised to 0..1."""
    axes, _ = checked(axes)
    shaped = with_group_values(points.withColumns(geometry(width, height) | {"_w": _c(width), "_h": _c(height)}), keys, axes)
    dx, dy = F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy")
    off = F.abs(dx * F.col("nx") + dy * F.col("ny") - F.col("rho"))
    inside = (
        shaped.withColumn("_off", off)
        .filter(F.col("_off") <= F.greatest(F.lit(2.0), F.col("_rho_bin") * 0.7))
        .withColumn("_t", dx * F.col("ex") + dy * F.col("ey"))
    )
    inside = inside.withColumn("_bin", F.floor(F.col("_t") / F.col("_span_bin")).cast("double"))
    small, large = split_large(inside, keys, sizes)
    sized = isinstance(width, Column) or isinstance(height, Column)
    measured = per_group(
        small.select(*keys, "_t", "_off", "_bin", *(["_w", "_h"] if sized else [])), keys, span_of_line,
        "n bigint, t1 double, t2 double, bins bigint, rms double, gap double" + (", _w double, _h double" if sized else ""),
    )
    if not sized:
        measured = measured.withColumns({"_w": _c(width), "_h": _c(height)})
    if large is not None:
        stats = large.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.min("_t").alias("t1"), F.max("_t").alias("t2"), F.count_distinct("_bin").alias("bins"),
            F.sqrt(F.sum(F.col("_off") * F.col("_off")) / F.count(F.lit(1))).alias("rms"),
            F.first("_w").alias("_w"), F.first("_h").alias("_h"),
        )
        measured = measured.unionByName(stats.join(max_gap(large, keys, "_t", "gap", bounded), list(keys)))
    span = F.col("t2") - F.col("t1")
    joined = with_group_values(measured, keys, axes).withColumns(geometry(F.col("_w"), F.col("_h"))).withColumn("span", span)
    covered = F.col("bins") / F.greatest(F.lit(1.0), F.ceil(F.col("span") / F.col("_span_bin")).cast("double"))
    passed = (
        (F.col("n") >= 10) & (F.col("span") >= F.col("_side") * 0.20) & (covered >= 0.20)
        & (F.col("gap") <= F.col("span") * 0.35) & (F.col("rms") <= 2.0)
        & (F.col("n") >= F.col("span") / (F.col("_span_bin") * 2.0))
    )

    def unit(c: Column) -> Column:
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))

    raw = (
        unit((F.col("elongation") - 7.0) / 93.0) * 0.25
        + unit((F.col("span") / F.col("_side") - 0.20) / 0.70) * 0.25
        + unit((covered - 0.20) / 0.70) * 0.20
        + unit(F.lit(1.0) - F.when(F.col("span") > 0, F.col("gap") / F.col("span")).otherwise(1.0) / 0.35) * 0.15
        + unit(F.lit(1.0) - F.col("rms") / 2.0) * 0.15
    )
    confidence = F.greatest(F.lit(1), F.rint(raw * 100.0).cast("int"))

    def end(t: str, axis: str) -> Column:
        center, normal, along, size = (
            ("_cx", "nx", "ex", "_w") if axis == "x" else ("_cy", "ny", "ey", "_h")
        )
        at = F.col(center) + F.col("rho") * F.col(normal) + F.col(t) * F.col(along)
        return F.when(F.col(size) <= 1, F.lit(0.5)).otherwise(unit(at / (F.col(size) - 1)))

    return joined.filter(passed).select(
        *keys, confidence.alias("confidence"), end("t1", "x").alias("x1"), end("t1", "y").alias("y1"),
        end("t2", "x").alias("x2"), end("t2", "y").alias("y2"),
    )


def span_of_line(points: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Extent, coverage, spread and largest gap of one frame's points along its line."""
    t, off = np.unique(points["_t"]), points["_off"]
    out = {
        "n": np.array([len(off)]), "t1": t[:1], "t2": t[-1:], "bins": np.array([len(np.unique(points["_bin"]))]),
        "rms": np.array([math.sqrt(float((off * off).sum()) / len(off))]), "gap": np.array([np.diff(t).max() if len(t) > 1 else 0.0]),
    }
    return out | {c: points[c][:1].astype(float) for c in ("_w", "_h") if c in points}


def trail_candidates(
    pixels: DataFrame, keys: Sequence[str], width: Column, height: Column, cap: int | None = None
) -> DataFrame:
    """(keys…, y, x, signal, threshold): samples with strong support in exactly one direction.

    `pixels` are full rasters carrying `width` and `height` columns; `cap` limits the samples behind the threshold.
    """
    blurred = box_blur(pixels, keys, 2, width, height)
    # read three times below; the blur behind it should run once
    residual = cut(blurred.withColumn("e", F.greatest(F.lit(0.0), F.col("v") - F.col("blur"))).select(
        *keys, "y", "x", "e", width.alias("_w"), height.alias("_h")
    ))
    position = F.col("y").cast("bigint") * F.col("_w") + F.col("x")
    sampled = stride_sample(residual, position, F.col("_w").cast("bigint") * F.col("_h"), cap)
    levels = nearest_rank_percentile(sampled, keys, "e", {"_p": 0.997}, bounded=cap is not None).select(
        *keys, F.greatest(F.lit(1e-6), F.col("_p")).alias("threshold")
    )
    lit = with_group_values(residual, keys, levels)
    inner = F.col("x").between(5, F.col("_w") - 6) & F.col("y").between(5, F.col("_h") - 6)
    bright = lit.filter((F.col("e") >= F.col("threshold")) & inner)
    support = directional_support(residual, bright.select(*keys, "y", "x"), keys, "e")
    judged = with_group_values(support, keys, levels).withColumn("signal", F.col("best") - F.col("second"))
    return judged.filter(
        (F.col("best") > F.greatest(F.lit(0.0), F.col("second")) * 2.0) & (F.col("signal") >= F.col("threshold") * 2.0)
    ).select(*keys, "y", "x", "signal", "threshold")


def detect_trail(
    pixels: DataFrame, frames: DataFrame, keys: Sequence[str], limit: int | None = None, cap: int | None = None
) -> DataFrame:
    """(keys…, confidence, x1, y1, x2, y2) for every frame; confidence 0 without a trail.

    `frames` lists the rasters with their width and height; `limit` keeps the strongest candidates only.
    """
    sized = with_group_values(pixels, keys, frames.select(*keys, "width", "height"))
    large = sized.filter((F.col("width") >= 16) & (F.col("height") >= 16))
    found = trail_candidates(large, keys, F.col("width"), F.col("height"), cap)
    order = [F.col("signal").desc(), F.col("y"), F.col("x")]
    top = cut(found) if limit is None else top_k_per_group(found, keys, order, limit, "_rn").drop("_rn")
    enough = top.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 12).select(*keys)
    points = with_group_values(top.join(enough, list(keys), "left_semi"), keys, frames.select(*keys, "width", "height"))
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    points = cut(points)
    lines = line_votes(points, keys, F.col("threshold"), w, h)
    axes = principal_axis(points, lines, keys, w, h)
    trails = trail_gates_score(points, axes, keys, w, h)
    return frames.select(*keys).join(trails, list(keys), "left").withColumn(
        "confidence", F.coalesce("confidence", F.lit(0))
    )
