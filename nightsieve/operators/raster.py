"""Raster operators over pixel rows (keys…, y, x, v).

Neighbourhood sums run as windows along one image line at a time, which bounds a
window by the image side; other stencils scatter each sample to the cells that
need it and add up, which is one shuffle with partial sums on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightsieve.functions.geometry import resample_coord

LUMINANCE = (0.2126, 0.7152, 0.0722)  # fixed values: red, green, blue weights


def luminance(red: Column | str, green: Column | str, blue: Column | str) -> Column:
    """Luminance of three planes held as columns."""
    r, g, b = [F.col(c) if isinstance(c, str) else c for c in (red, green, blue)]
    return F.lit(LUMINANCE[0]) * r + F.lit(LUMINANCE[1]) * g + F.lit(LUMINANCE[2]) * b


def luminance_planes(df: DataFrame, keys: Sequence[str], channel: str = "channel", v: str = "v") -> DataFrame:
    """Luminance of planes held as rows; a single plane passes through, of more than three the first three count.

    Two interleaved channels use the second for blue as well.
    """
    planes = df.filter(F.col(channel) < 3)
    cells = planes.groupBy(*keys, "y", "x").agg(
        F.max(F.when(F.col(channel) == 0, F.col(v))).alias("_r"),
        F.max(F.when(F.col(channel) == 1, F.col(v))).alias("_g"),
        F.max(F.when(F.col(channel) == 2, F.col(v))).alias("_b"),
    )
    mixed = luminance("_r", "_g", F.coalesce("_b", "_g"))
    return cells.select(*keys, "y", "x", F.when(F.col("_g").isNull(), F.col("_r")).otherwise(mixed).alias(v))


def _line_sum(df: DataFrame, line: Sequence[str], along: str, v: str, radius: int, size: Column) -> Column:
    """Sum of 2r+1 samples along a line, edge samples repeated beyond the border."""
    order = Window.partitionBy(*line).orderBy(along)
    inner = F.sum(v).over(order.rangeBetween(-radius, radius))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(v).over(whole), F.last(v).over(whole)
    before = F.greatest(F.lit(0), F.lit(radius) - F.col(along))
    after = F.greatest(F.lit(0), F.lit(radius) - (size - 1 - F.col(along)))
    return inner + before * first + after * last


def box_blur(
    df: DataFrame, keys: Sequence[str], radius: int, width: Column | int, height: Column | int, v: str = "v", out: str = "blur"
) -> DataFrame:
    """Mean over a (2r+1)^2 box with clamped borders; adds a column to the rows of a full raster."""
    if radius <= 0:
        return df.withColumn(out, F.col(v))
    w = F.lit(width) if isinstance(width, int) else width
    h = F.lit(height) if isinstance(height, int) else height
    rows = df.withColumn("_row", _line_sum(df, [*keys, "y"], "x", v, radius, w))
    both = rows.withColumn("_sum", _line_sum(rows, [*keys, "x"], "y", "_row", radius, h))
    return both.withColumn(out, F.col("_sum") / F.lit(float((2 * radius + 1) ** 2))).drop("_row", "_sum")


def local_variance(
    df: DataFrame, keys: Sequence[str], radius: int, width: Column | int, height: Column | int, v: str = "v", out: str = "variance"
) -> DataFrame:
    """Mean of squares minus square of the mean in the box, not below 0."""
    squared = df.withColumn("_sq", F.col(v) * F.col(v))
    first = box_blur(squared, keys, radius, width, height, v, "_m")
    second = box_blur(first, keys, radius, width, height, "_sq", "_m2")
    return second.withColumn(out, F.greatest(F.col("_m2") - F.col("_m") * F.col("_m"), F.lit(0.0))).drop(
        "_sq", "_m", "_m2"
    )


def scatter(df: DataFrame, keys: Sequence[str], offsets: Sequence[tuple[int, int]], v: str = "v") -> DataFrame:
    """(keys…, y, x, slot, v): each sample sent to the cells that see it at offset number `slot`."""
    table = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(i).alias("slot")) for i, (dy, dx) in enumerate(offsets)])
    return df.select(*keys, "y", "x", v, F.explode(table).alias("o")).select(
        *keys, (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"), F.col("o.slot").alias("slot"), v
    )


EIGHT = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def neighbour_join(df: DataFrame, keys: Sequence[str], v: str = "v") -> DataFrame:
    """Each sample with its 8 neighbours as `n0`..`n7` (row order); null outside the raster."""
    sent = scatter(df, keys, [(0, 0), *EIGHT], v)
    cells = sent.groupBy(*keys, "y", "x").agg(
        F.max(F.when(F.col("slot") == 0, F.col(v))).alias(v),
        *[F.max(F.when(F.col("slot") == i + 1, F.col(v))).alias(f"n{i}") for i in range(8)],
    )
    return cells.filter(F.col(v).isNotNull())


def median3x3(df: DataFrame, keys: Sequence[str], v: str = "v", out: str = "median") -> DataFrame:
    """Median of the 3x3 box; border samples stay as they are."""
    around = neighbour_join(df, keys, v)
    sides = [F.col(f"n{i}") for i in range(8)]
    inner = F.lit(True)
    for s in sides:
        inner = inner & s.isNotNull()
    middle = F.get(F.sort_array(F.array(F.col(v), *sides)), F.lit(4))
    return around.withColumn(out, F.when(inner, middle).otherwise(F.col(v))).select(*keys, "y", "x", v, out)


def mosaic_interpolate(
    df: DataFrame, keys: Sequence[str], pattern: Column | str, width: Column | int, height: Column | int,
    offset_x: Column | int = 0, offset_y: Column | int = 0, v: str = "v",
) -> DataFrame:
    """Bilinear colour planes of a mosaic raster: (keys…, y, x, red, green, blue).

    `pattern` is one of RGGB, BGGR, GRBG, GBRG; anything else counts as RGGB.
    Samples beyond the border repeat the border.
    """
    w = F.lit(width) if isinstance(width, int) else width
    h = F.lit(height) if isinstance(height, int) else height
    # a border sample stands in for the outside, so it also sees itself from there
    def reach(at: Column, size: Column) -> Column:
        return F.filter(
            F.array(
                F.when(at > 0, F.struct((at - 1).alias("t"), F.lit(1).alias("d"))),
                F.struct(at.alias("t"), F.lit(0).alias("d")),
                F.when(at < size - 1, F.struct((at + 1).alias("t"), F.lit(-1).alias("d"))),
                F.when(at == 0, F.struct(at.alias("t"), F.lit(-1).alias("d"))),
                F.when(at == size - 1, F.struct(at.alias("t"), F.lit(1).alias("d"))),
            ),
            lambda s: s.isNotNull(),
        )

    carried = [c for c in df.columns if c not in (*keys, "y", "x", v)]
    seen = (
        df.select(*keys, *carried, v, F.explode(reach(F.col("y"), h)).alias("ry"), "x")
        .select("*", F.explode(reach(F.col("x"), w)).alias("rx"))
        .select(
            *keys, *carried, v, F.col("ry.t").alias("y"), F.col("rx.t").alias("x"),
            (F.col("ry.d") != 0).alias("_dy"), (F.col("rx.d") != 0).alias("_dx"),
        )
    )
    cells = seen.groupBy(*keys, *carried, "y", "x").agg(
        F.sum(F.when(~F.col("_dy") & ~F.col("_dx"), F.col(v))).alias("_c"),
        F.sum(F.when(~F.col("_dy") & F.col("_dx"), F.col(v))).alias("_h"),
        F.sum(F.when(F.col("_dy") & ~F.col("_dx"), F.col(v))).alias("_v"),
        F.sum(F.when(F.col("_dy") & F.col("_dx"), F.col(v))).alias("_d"),
    )
    code = F.upper(F.regexp_replace(F.lit(pattern) if isinstance(pattern, str) else pattern, r"""^[\s'"]+|[\s'"]+$""", ""))
    code = F.when(code.isin("RGGB", "BGGR", "GRBG", "GBRG"), code).otherwise("RGGB")
    ox = F.lit(offset_x) if isinstance(offset_x, int) else offset_x
    oy = F.lit(offset_y) if isinstance(offset_y, int) else offset_y
    row, column = F.pmod(F.col("y") + oy, F.lit(2)), F.pmod(F.col("x") + ox, F.lit(2))
    site = F.substring(code, (row * 2 + column + 1).cast("int"), F.lit(1))
    cross, diagonal = (F.col("_h") + F.col("_v")) * F.lit(0.25), F.col("_d") * F.lit(0.25)
    beside, above = F.col("_h") * F.lit(0.5), F.col("_v") * F.lit(0.5)
    red = F.when(site == "R", F.col("_c")).when(site == "B", diagonal).when(row == 0, beside).otherwise(above)
    green = F.when(site == "G", F.col("_c")).otherwise(cross)
    blue = F.when(site == "B", F.col("_c")).when(site == "R", diagonal).when(row == 0, above).otherwise(beside)
    return cells.select(*keys, "y", "x", red.alias("red"), green.alias("green"), blue.alias("blue"))


def analysis_size(width: Column, height: Column, longest: int) -> tuple[Column, Column]:
    """Target size that fits the longest side; never below 256 once reduced."""
    side = F.greatest(width, height)
    scale = F.lit(float(longest)) / side

    def fit(size: Column) -> Column:
        return F.when(side <= longest, size).otherwise(F.greatest(F.lit(256), F.rint(size * scale).cast("int")))

    return fit(width), fit(height)


def _source_of(t: Column, size: Column, target: Column) -> Column:
    steps, span = F.greatest(F.lit(1), target - 1).cast("double"), (size - 1).cast("double")
    return F.least(size - 1, F.rint(t.cast("double") / steps * span).cast("int"))


def _nearest_targets(at: Column, near: Column, size: Column, target: Column) -> Column:
    """Targets whose nearest source index is `at`, null for none.

    When reducing, only the target nearest to `at` can be one; when enlarging, the
    whole run around it is checked.
    """
    reach = F.ceil(target / size).cast("int") + 1
    run = F.sequence(F.greatest(F.lit(0), near - reach), F.least(target - 1, near + reach))
    several = F.filter(F.when(size > 1, run).otherwise(F.sequence(F.lit(0), target - 1)), lambda t: _source_of(t, size, target) == at)
    one = F.when(_source_of(near, size, target) == at, F.array(near))
    return F.when((target <= size) & (target > 1), one).otherwise(several)


def _near_target(at: Column, size: Column, target: Column) -> Column:
    steps, span = F.greatest(F.lit(1), target - 1).cast("double"), F.greatest(F.lit(1), size - 1).cast("double")
    return F.least(target - 1, F.rint(at * steps / span).cast("int"))


def _sized(*sizes: Column | int) -> list[Column]:
    return [F.lit(s) if isinstance(s, int) else s for s in sizes]


def resample_nearest(
    df: DataFrame, keys: Sequence[str], width: Column | int, height: Column | int, to_width: Column | int, to_height: Column | int,
    v: str = "v",
) -> DataFrame:
    """Nearest-sample resize. Every source row names its own targets, so nothing is shuffled."""
    w, h, tw, th = _sized(width, height, to_width, to_height)
    carried = [c for c in df.columns if c not in (*keys, "y", "x", v)]
    rows = df.withColumn("_near", _near_target(F.col("y"), h, th)).select(
        *keys, *carried, v, F.explode(_nearest_targets(F.col("y"), F.col("_near"), h, th)).alias("_ty"), "x"
    )
    return rows.withColumn("_near", _near_target(F.col("x"), w, tw)).select(
        *keys, *carried, F.col("_ty").alias("y"), F.explode(_nearest_targets(F.col("x"), F.col("_near"), w, tw)).alias("x"), v
    )


def _linear_targets(at: Column, size: Column, target: Column) -> Column:
    """(t, weight) of the targets that draw on source index `at`."""
    ratio = target.cast("double") / size.cast("double")
    low = F.greatest(F.floor((at - 1) * ratio) - 1, F.lit(0)).cast("int")
    high = F.least(F.ceil((at + 2) * ratio) + 1, target - 1).cast("int")
    # the first and last samples also serve every clamped coordinate
    low = F.when(at == 0, F.lit(0)).otherwise(low)
    high = F.when(at == size - 1, target - 1).otherwise(high)

    def entry(t: Column) -> Column:
        position = resample_coord(t, size, target)
        base = F.least(F.floor(position), size - 1)
        share = position - base
        follower = F.least(base + 1, size - 1)
        weight = F.when(base == at, F.lit(1.0) - share).otherwise(F.lit(0.0)) + F.when(follower == at, share).otherwise(F.lit(0.0))
        return F.struct(t.alias("t"), weight.alias("weight"))

    listed = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(listed, entry), lambda e: e["weight"] > 0)


def resample_bilinear(
    df: DataFrame, keys: Sequence[str], width: Column | int, height: Column | int, to_width: Column | int, to_height: Column | int,
    v: str = "v",
) -> DataFrame:
    """Bilinear resize on centre-aligned coordinates: weighted samples added up per target."""
    w, h, tw, th = _sized(width, height, to_width, to_height)
    carried = [c for c in df.columns if c not in (*keys, "y", "x", v)]
    rows = df.select(*keys, *carried, v, F.explode(_linear_targets(F.col("y"), h, th)).alias("ty"), "x")
    both = rows.select(*keys, *carried, v, "ty", F.explode(_linear_targets(F.col("x"), w, tw)).alias("tx"))
    weighted = F.col(v) * (F.col("tx.weight") * F.col("ty.weight"))
    return both.groupBy(*keys, *carried, F.col("ty.t").alias("y"), F.col("tx.t").alias("x")).agg(
        F.sum(weighted).alias(v)
    )


def roi_bounds(
    left: Column, top: Column, width: Column, height: Column, image_width: Column, image_height: Column, square: bool = True
) -> tuple[Column, Column, Column, Column]:
    """First x and y and the size of a normalised rectangle in pixels, cut to a centred square."""

    def unit(c: Column) -> Column:
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))

    x = F.rint(unit(left) * (image_width - 1)).cast("int")
    y = F.rint(unit(top) * (image_height - 1)).cast("int")
    w = F.least(F.greatest(F.lit(1), F.rint(unit(width) * image_width).cast("int")), image_width - x)
    h = F.least(F.greatest(F.lit(1), F.rint(unit(height) * image_height).cast("int")), image_height - y)
    if not square:
        return x, y, w, h
    side = F.least(w, h)
    return x + F.floor((w - side) / 2).cast("int"), y + F.floor((h - side) / 2).cast("int"), side, side


def roi_crop(
    df: DataFrame, left: float | Column, top: float | Column, width: float | Column, height: float | Column,
    image_width: Column | int, image_height: Column | int, square: bool = True,
) -> DataFrame:
    """Samples inside a normalised rectangle clamped to the image; one rectangle serves all frames."""
    rect = [F.lit(float(c)) if isinstance(c, (int, float)) else c for c in (left, top, width, height)]
    x, y, w, h = roi_bounds(*rect, *_sized(image_width, image_height), square)
    return df.filter((F.col("x") >= x) & (F.col("x") < x + w) & (F.col("y") >= y) & (F.col("y") < y + h))


def local_window_stats(
    df: DataFrame, points: DataFrame, keys: Sequence[str], width: Column | int, height: Column | int, side: int = 31, v: str = "v"
) -> DataFrame:
    """center, min, max and mean of the box around each point (keys…, point_id, px, py).

    A box that would cross the border is moved inside.  Points and samples meet in
    square buckets of the box side, so a point looks at no more than four of them.
    """
    w, h = _sized(width, height)

    def start(at: Column, size: Column) -> Column:
        return F.least(F.greatest(at - side // 2, F.lit(0)), F.greatest(F.lit(0), size - side)).cast("int")

    def buckets(first: str) -> Column:
        return F.sequence(F.floor(F.col(first) / side), F.floor((F.col(first) + side - 1) / side))

    wanted = (
        points.select(*keys, "point_id", "px", "py", start(F.col("px"), w).alias("_x0"), start(F.col("py"), h).alias("_y0"))
        .withColumn("_by", F.explode(buckets("_y0")))
        .withColumn("_bx", F.explode(buckets("_x0")))
    )
    placed = df.withColumn("_by", F.floor(F.col("y") / side)).withColumn("_bx", F.floor(F.col("x") / side))
    inside = (
        (F.col("x") >= F.col("_x0")) & (F.col("x") < F.col("_x0") + side)
        & (F.col("y") >= F.col("_y0")) & (F.col("y") < F.col("_y0") + side)
    )
    at_center = (F.col("x") == F.col("px")) & (F.col("y") == F.col("py"))
    return (
        placed.join(wanted, [*keys, "_by", "_bx"]).filter(inside)
        .groupBy(*keys, "point_id")
        .agg(
            F.max(F.when(at_center, F.col(v))).alias("center"), F.min(v).alias("min"), F.max(v).alias("max"),
            F.avg(v).alias("mean"),
        )
    )


def local_maxima(
    df: DataFrame, keys: Sequence[str], level: Column, support_level: Column, width: Column | int, height: Column | int, v: str = "v"
) -> DataFrame:
    """Samples at or above `level` that top their 3x3 box with at least 3 supporting neighbours.

    Equal values lose to their right, lower, upper-right and lower-right neighbour.
    Only samples at or above the support level can matter to a peak, so the rest is
    filtered away before anything is shuffled.
    """
    w, h = _sized(width, height)
    carried = [c for c in df.columns if c not in (*keys, "y", "x", v)]
    bright = df.filter(F.col(v) >= support_level).withColumns({"_level": level, "_w": w, "_h": h})
    packed = bright.select(
        *keys, "y", "x", F.struct(v, "_level", "_w", "_h", *carried).alias("_p")
    )
    sent = scatter(packed, keys, [(0, 0), *EIGHT], "_p")
    strict = [EIGHT.index(o) + 1 for o in ((0, 1), (1, 0), (-1, 1), (1, 1))]
    loose = [EIGHT.index(o) + 1 for o in ((0, -1), (-1, 0), (-1, -1), (1, -1))]
    cells = sent.groupBy(*keys, "y", "x").agg(
        F.max(F.when(F.col("slot") == 0, F.col("_p"))).alias("_c"),
        F.max(F.when(F.col("slot").isin(strict), F.col(f"_p.{v}"))).alias("_strict"),
        F.max(F.when(F.col("slot").isin(loose), F.col(f"_p.{v}"))).alias("_loose"),
        F.count_if(F.col("slot") > 0).alias("_support"),
    )
    center = F.col(f"_c.{v}")
    inside = F.col("y").between(1, F.col("_c._h") - 2) & F.col("x").between(1, F.col("_c._w") - 2)
    top = (center >= F.col("_c._level")) & F.coalesce(center > F.col("_strict"), F.lit(True)) & F.coalesce(
        center >= F.col("_loose"), F.lit(True)
    )
    kept = cells.filter(F.col("_c").isNotNull() & inside & top & (F.col("_support") >= 3))
    return kept.select(*keys, "y", "x", center.alias(v), *[F.col(f"_c.{c}").alias(c) for c in carried])


# Weights along and across a direction.
ALONG = [1.0, 0.85, 0.70, 0.55, 0.40]
ACROSS = [1.0, 0.70, 0.45]
CENTER = 1.25
DIRECTIONS = [(1, 0), (0, 1), (1, 1), (1, -1)]


def support_weights() -> list[tuple[int, int, list[float]]]:
    """(dy, dx, weight per direction) of every sample that a directional support adds up."""
    table: dict[tuple[int, int], list[float]] = {(0, 0): [CENTER] * 4}
    for i, (dx, dy) in enumerate(DIRECTIONS):
        for sign in (1, -1):
            for step, weight in enumerate(ALONG, 1):
                table.setdefault((sign * dy * step, sign * dx * step), [0.0] * 4)[i] += weight
            for step, weight in enumerate(ACROSS, 1):
                table.setdefault((sign * dx * step, -sign * dy * step), [0.0] * 4)[i] -= weight
    return [(dy, dx, weights) for (dy, dx), weights in table.items()]


def _literal(values: Sequence[float | int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)


def directional_support(df: DataFrame, candidates: DataFrame, keys: Sequence[str], v: str = "v") -> DataFrame:
    """Support of each candidate in 4 directions, with the best and second best.

    Candidates ask for the samples around them, so the work follows their number and
    not the raster's size.
    """
    dy, dx, weights = zip(*support_weights())
    slots = candidates.select(
        *keys, F.col("y").alias("cy"), F.col("x").alias("cx"), F.explode(F.sequence(F.lit(0), F.lit(len(dy) - 1))).alias("o")
    )
    slot = F.col("o")
    asked = slots.select(
        *keys, "cy", "cx", (F.col("cy") + _literal(dy, slot)).alias("y"), (F.col("cx") + _literal(dx, slot)).alias("x"),
        *[_literal([w[i] for w in weights], slot).alias(f"w{i}") for i in range(4)],
    )
    sums = [F.sum(F.col(f"w{i}") * F.col(v)).alias(f"s{i}") for i in range(4)]
    found = asked.join(df.select(*keys, "y", "x", v), [*keys, "y", "x"]).groupBy(*keys, "cy", "cx").agg(*sums)
    first, rest = F.col("s0"), F.lit(0.0)
    best, second = first, rest
    for i in (1, 2, 3):
        s = F.col(f"s{i}")
        best, second = (
            F.when(s >= best, s).otherwise(best),
            F.when(s >= best, best).otherwise(F.greatest(second, s)),
        )
    named = {"horizontal": "s0", "vertical": "s1", "diagonal": "s2", "antidiagonal": "s3"}
    return found.select(
        *keys, F.col("cy").alias("y"), F.col("cx").alias("x"), *[F.col(c).alias(n) for n, c in named.items()],
        best.alias("best"), second.alias("second"),
    )
