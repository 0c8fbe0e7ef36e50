"""Point arithmetic, arcsecond scale and radial weights."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ARCSEC_PER_RADIAN_UM_MM = 206.265  # fixed value


def _col(column: Column | str | float) -> Column:
    if isinstance(column, (int, float)):
        return F.lit(float(column))
    return F.col(column) if isinstance(column, str) else column


def clamp(value: Column | str, low: Column | float, high: Column | float) -> Column:
    return F.least(F.greatest(_col(value), _col(low)), _col(high))


def distance(x1: Column | str, y1: Column | str, x2: Column | str, y2: Column | str) -> Column:
    dx, dy = _col(x1) - _col(x2), _col(y1) - _col(y2)
    return F.sqrt(dx * dx + dy * dy)


def arcsec_per_pixel(pixel_um: Column | str, focal_mm: Column | str) -> Column:
    p, f = _col(pixel_um), _col(focal_mm)
    return F.when((p > 0) & (f > 0), F.lit(ARCSEC_PER_RADIAN_UM_MM) * (p / f))


def to_arcsec(metric: Column | str, pixel_um: Column | str, focal_mm: Column | str) -> Column:
    """The metric in arcseconds, null unless scale and metric are positive."""
    m = _col(metric)
    return F.when(m > 0, m * arcsec_per_pixel(pixel_um, focal_mm))


def scale_from_pair(metric_px: Column | str, metric_arcsec: Column | str) -> Column:
    """Arcseconds per pixel recovered from a metric known in both units, else 0."""
    p, a = _col(metric_px), _col(metric_arcsec)
    return F.when((p > 0) & (a > 0), a / p).otherwise(F.lit(0.0))


def rotate_point(x: Column | str, y: Column | str, width: Column | float, height: Column | float) -> tuple[Column, Column]:
    """180 degree turn of a pixel position."""
    return _col(width) - 1 - _col(x), _col(height) - 1 - _col(y)


def rotate_unit_point(x: Column | str, y: Column | str) -> tuple[Column, Column]:
    """180 degree turn of a position normalised to 0..1."""
    return F.lit(1.0) - _col(x), F.lit(1.0) - _col(y)


def shift_point(
    x: Column | str, y: Column | str, dx: Column | float, dy: Column | float, width: Column | float, height: Column | float
) -> tuple[Column, Column, Column]:
    """Translated position and whether it is still inside the image."""
    nx, ny = _col(x) + _col(dx), _col(y) + _col(dy)
    inside = (nx >= 0) & (ny >= 0) & (nx < _col(width)) & (ny < _col(height))
    return nx, ny, inside


def radial_weight(x: Column | str, y: Column | str, width: Column | float, height: Column | float) -> Column:
    """cos^4 fall-off to 0 at three quarters of the half diagonal."""
    cx, cy = _col(width) * 0.5, _col(height) * 0.5
    half = F.sqrt(cx * cx + cy * cy)
    r = distance(x, y, cx, cy) / half
    c = F.cos(r / F.lit(0.75) * F.lit(math.pi) * F.lit(0.5))
    return F.when(half <= 0, F.lit(1.0)).when(r >= 0.75, F.lit(0.0)).otherwise((c * c) * (c * c))


def resample_coord(target: Column | str, source_size: Column | float, target_size: Column | float) -> Column:
    """Centre-aligned source coordinate of a target index."""
    s, t = _col(source_size).cast("double"), _col(target_size).cast("double")
    raw = (_col(target).cast("double") + F.lit(0.5)) * s / t - F.lit(0.5)
    return F.when((s <= 1) | (t <= 1), F.lit(0.0)).otherwise(clamp(raw, 0.0, s - 1.0))


def edge_margin(x: Column | str, y: Column | str, width: Column | float, height: Column | float, share: float) -> Column:
    """True for points at least `share` of each side away from the border."""
    mx, my = _col(width) * F.lit(share), _col(height) * F.lit(share)
    return _col(x).between(mx, _col(width) - 1 - mx) & _col(y).between(my, _col(height) - 1 - my)
