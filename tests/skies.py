"""Seeded star fields and FITS files for the tests."""

from __future__ import annotations

import numpy as np


def star_field(width, height, stars, sigma=1.6, noise=5.0, level=1000.0, seed=42, trail=None):
    """A raster with Gaussian stars (x, y, peak) and, if asked, a straight bright line."""
    rng = np.random.default_rng(seed)
    image = rng.normal(level, noise, (height, width))
    yy, xx = np.mgrid[0:height, 0:width]
    for x, y, peak in stars:
        x0, x1, y0, y1 = int(max(0, x - 15)), int(min(width, x + 16)), int(max(0, y - 15)), int(min(height, y + 16))
        box = (slice(y0, y1), slice(x0, x1))
        image[box] += peak * np.exp(-((xx[box] - x) ** 2 + (yy[box] - y) ** 2) / (2 * sigma**2))
    if trail:
        (ax, ay), (bx, by), strength = trail
        length = np.hypot(bx - ax, by - ay)
        off = np.abs((by - ay) * xx - (bx - ax) * yy + bx * ay - by * ax) / length
        image += strength * np.exp(-(off**2) / (2 * 0.6**2))
    return image


def scattered(n, width, height, seed=7, margin=25, gap=30.0):
    """Star positions with a minimum distance and peaks between 800 and 6000."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(100_000):
        if len(out) == n:
            break
        x, y = rng.uniform(margin, width - margin), rng.uniform(margin, height - margin)
        if all((x - a) ** 2 + (y - b) ** 2 >= gap**2 for a, b, _ in out):
            out.append((x, y, rng.uniform(800, 6000)))
    assert len(out) == n, "the field is too small for so many stars"
    return out


def card(key, value):
    return f"{key:<8}= {value}".ljust(80)[:80]


def write_fits(path, image, bitpix=16, extra=(), primary_first=False, bzero=None):
    """Write an image (planes, rows, columns) or (rows, columns)."""
    data = np.asarray(image)
    planes = data[None] if data.ndim == 2 else data
    kinds = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
    if bzero is None:
        bzero = 32768 if bitpix == 16 else 0
    raw = np.round(planes - bzero) if bitpix > 0 else planes - bzero
    cards = ["SIMPLE  =                    T".ljust(80), card("BITPIX", bitpix), card("NAXIS", 2 if data.ndim == 2 else 3),
             card("NAXIS1", planes.shape[2]), card("NAXIS2", planes.shape[1])]
    if data.ndim == 3:
        cards.append(card("NAXIS3", planes.shape[0]))
    cards += [card("BZERO", bzero), card("BSCALE", 1), *[card(k, v) for k, v in extra], "END".ljust(80)]
    header = "".join(cards).encode()
    header += b" " * (-len(header) % 2880)
    body = raw.astype(kinds[bitpix]).tobytes()
    body += b"\0" * (-len(body) % 2880)
    with open(path, "wb") as f:
        if primary_first:
            empty = ("SIMPLE  =                    T".ljust(80) + card("BITPIX", 8) + card("NAXIS", 0) + "END".ljust(80)).encode()
            f.write(empty + b" " * (-len(empty) % 2880))
        f.write(header + body)
