"""Midtones tone curve."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nightsieve.functions.geometry import clamp

SHADOWS_CLIPPING = -2.8  # fixed value
MAD_TO_SIGMA = 1.4826  # fixed value


def _col(column: Column | str | float) -> Column:
    if isinstance(column, (int, float)):
        return F.lit(float(column))
    return F.col(column) if isinstance(column, str) else column


def mtf(x: Column | str, midtones: Column | str | float) -> Column:
    """Midtones transfer of x."""
    x = clamp(_col(x), 0.0, 1.0)
    m = clamp(_col(midtones), 1e-6, 1.0 - 1e-6)
    denominator = (F.lit(2.0) * m - F.lit(1.0)) * x - m
    return (
        F.when(x <= 0, F.lit(0.0))
        .when(x >= 1, F.lit(1.0))
        .when(F.abs(denominator) < 1e-9, x)
        .otherwise((m - F.lit(1.0)) * x / denominator)
    )


def inverse_mtf(y: Column | str | float, x: Column | str | float) -> Column:
    """The midtones balance that maps x to y."""
    y, x = clamp(_col(y), 0.0, 1.0), clamp(_col(x), 0.0, 1.0)
    denominator = x + y - F.lit(2.0) * x * y
    return (
        F.when(x <= 0, F.lit(0.0))
        .when(x >= 1, F.lit(1.0))
        .when(F.abs(denominator) < 1e-9, F.lit(0.5))
        .otherwise(x * (F.lit(1.0) - y) / denominator)
    )


def stretch(
    raw: Column | str, data_max: Column | float, shadows: Column | float, midtones: Column | float, highlights: Column | float
) -> Column:
    """Sample -> byte 0..255 through clipping and the midtones curve."""
    low, high = _col(shadows), _col(highlights)
    span = F.greatest(F.lit(1e-9), high - low)
    clipped = clamp((_col(raw) / _col(data_max) - low) / span, 0.0, 1.0)
    return F.floor(clamp(mtf(clipped, midtones), 0.0, 1.0) * F.lit(255.0) + F.lit(0.5)).cast("int")


def curve_from_statistics(
    median: Column | str, mad: Column | str, target: float = 0.25
) -> tuple[Column, Column, Column]:
    """Shadows, midtones and highlights from a normalised median and MAD."""
    median, mad = _col(median), _col(mad)
    shadows = clamp(median + F.lit(SHADOWS_CLIPPING) * (F.lit(MAD_TO_SIGMA) * mad), 0.0, 1.0)
    above = clamp((median - shadows) / F.greatest(F.lit(1e-9), F.lit(1.0) - shadows), 1e-9, 1.0 - 1e-9)
    midtones = inverse_mtf(target, above)
    midtones = clamp(F.when(F.isnan(midtones), F.lit(0.25)).otherwise(midtones), 0.0, 1.0)
    return shadows, midtones, F.lit(1.0)


def norm_max_from_bits(bitpix: Column | str) -> Column:
    """2^bits - 1 for 8, 16 and 32 bit samples, else 1."""
    bits = F.abs(_col(bitpix))
    return F.when(bits.isin(8, 16, 32), F.pow(F.lit(2.0), bits.cast("double")) - F.lit(1.0)).otherwise(F.lit(1.0))


# Largest sample of each unsigned format.
FORMAT_MAX = {"UInt8": 255.0, "UInt16": 65535.0, "UInt32": 4294967295.0, "UInt64": 18446744073709551615.0}


def norm_max_from_format(sample_format: Column | str) -> Column:
    result = F.when(F.lit(False), F.lit(1.0))
    for name, value in FORMAT_MAX.items():
        result = result.when(_col(sample_format) == name, F.lit(value))
    return result.otherwise(F.lit(1.0))


# Colour ramp anchors (position, red, green, blue).
RAMP = [
    (0.00, 0.125, 0.125, 0.149),
    (0.10, 0.05, 0.05, 0.55),
    (0.20, 0.00, 0.20, 1.00),
    (0.35, 0.00, 0.85, 1.00),
    (0.50, 0.00, 0.85, 0.10),
    (0.68, 1.00, 1.00, 0.00),
    (0.82, 1.00, 0.55, 0.00),
    (0.93, 1.00, 0.10, 0.10),
    (1.00, 1.00, 0.55, 0.85),
]


def piecewise_linear(t: Column | str, anchors: list[tuple[float, float]], scale: float = 1.0) -> Column:
    """Linear interpolation between anchors, held constant outside, times scale, rounded half to even."""
    t = _col(t)
    first, last = anchors[0], anchors[-1]
    result = F.when(t <= first[0], F.lit(first[1] * scale)).when(t >= last[0], F.lit(last[1] * scale))
    for (t0, v0), (t1, v1) in zip(anchors, anchors[1:]):
        u = (t - F.lit(t0)) / F.lit(t1 - t0)
        result = result.when(t <= t1, (F.lit(v0) + F.lit(v1 - v0) * u) * F.lit(scale))
    return F.rint(result).cast("int")


def color_ramp(t: Column | str) -> dict[str, Column]:
    return {
        name: piecewise_linear(t, [(row[0], row[i]) for row in RAMP], 255.0)
        for i, name in ((1, "red"), (2, "green"), (3, "blue"))
    }


def score_marker(value: Column | str, low: Column | str, high: Column | str) -> Column:
    """Position of a score in the range of positive scores, 0..1."""
    low, high = _col(low), _col(high)
    span = F.when(high > low, high - low).otherwise(F.lit(1.0))
    return clamp((_col(value) - low) / span, 0.0, 1.0)


def blend(low: int, high: int, t: Column | str) -> Column:
    """One channel of a two-colour blend."""
    return F.floor(F.lit(float(low)) + F.lit(float(high - low)) * clamp(_col(t), 0.0, 1.0)).cast("int")
