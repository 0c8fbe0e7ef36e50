"""The sums of a star's samples, as array kernels: for slabs of rows and for tiles of pixel rows."""

from __future__ import annotations

import numpy as np

SUMS = ["_n", "_f", "_fx", "_fy", "_fxx", "_fyy", "_fxy", "_k", "_w", "_wx", "_wy", "_wxx", "_wxy", "_wyy", "_core", "_hfr", "_mx", "_my"]
CHUNK = 256


def offsets(radius: int, inner: float, outer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(dy, dx, members of the box, members of the ring), by dy, then dx."""
    reach = max(radius, outer)
    dy, dx = (g.reshape(-1) for g in np.mgrid[-reach:reach + 1, -reach:reach + 1])
    squared = dy**2 + dx**2
    box = np.flatnonzero((np.abs(dy) <= radius) & (np.abs(dx) <= radius) & (np.maximum(np.abs(dy), np.abs(dx)) <= outer))
    ring = np.flatnonzero((squared >= inner**2) & (squared <= outer**2))
    return dy, dx, box, ring


def sample_sums(
    box: np.ndarray, dy: np.ndarray, dx: np.ndarray, ring: np.ndarray, n: np.ndarray, enough: np.ndarray, background: np.ndarray | float
) -> np.ndarray:
    """The sums of `SUMS` for each row: box samples at (dy, dx) and ring samples, NaN where there is none.

    The median of the `n` ring samples is the background where they are `enough`.
    """
    ring = np.sort(ring, axis=1)
    pick = np.arange(len(ring))
    middle = (ring[pick, np.maximum((n + 1) // 2 - 1, 0)] + ring[pick, np.minimum(n // 2, ring.shape[1] - 1)]) / 2
    s = box - np.where(enough, middle, background)[:, None]
    dy, dx = dy.astype(float), dx.astype(float)
    s = np.where(s > 0, s, 0.0)
    lit = s > 0
    total = s.sum(1)
    safe = np.where(total > 0, total, 1.0)
    mx, my = (s * dx).sum(1) / safe, (s * dy).sum(1) / safe
    px, py = dx - mx[:, None], dy - my[:, None]
    r = np.sqrt(px * px + py * py)
    order = np.argsort(np.where(lit, r, np.inf), axis=1, kind="stable")  # the box is listed by dy, then dx
    outward, far = np.take_along_axis(s, order, 1), np.take_along_axis(r, order, 1)
    reached = np.argmax(np.cumsum(outward, 1) >= (total * 0.5)[:, None], axis=1)
    few = np.sort(np.where(np.take_along_axis(lit, order, 1)[:, :3], outward[:, :3], np.inf), axis=1)
    count = lit.sum(1)
    core = few[pick, np.minimum(count, 3) // 2]
    used = lit & (s > core[:, None] * 0.4) & (s < core[:, None] * 1.05)
    x2, ln, w = r * r, np.log(np.where(lit, s, 1.0)), np.where(used, s, 0.0)
    add = lambda a: a.sum(1)
    return np.stack([
        count, total, add(s * px), add(s * py), add(s * px * px), add(s * py * py), add(s * px * py), used.sum(1), add(w), add(w * x2), add(w * ln),
        add(w * x2 * x2), add(w * x2 * ln), add(w * ln * ln), np.where(count > 0, core, 0.0), far[pick, reached], mx, my], 1)


def tile_sums(
    cy: np.ndarray, cx: np.ndarray, background: np.ndarray, y: np.ndarray, x: np.ndarray, v: np.ndarray, null: np.ndarray,
    radius: int, inner: float, outer: int, ring_samples: int,
) -> np.ndarray:
    """The sums of `SUMS` for each centre from a tile's samples, in any order; a position given twice counts twice.

    As in SQL, a null sample counts among the ring's rows only, and one that is no number leaves its star without a profile.
    """
    dy, dx, box, ring = offsets(radius, inner, outer)
    reach = max(radius, outer)
    top, left = cy.min() - reach, cx.min() - reach
    high, wide = cy.max() + reach + 1 - top, cx.max() + reach + 1 - left
    near = (y >= top) & (y < top + high) & (x >= left) & (x < left + wide)
    at = ((y - top) * wide + (x - left))[near]
    order = np.argsort(at, kind="stable")
    at, v, null = at[order], v[near][order], null[near][order]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    layer = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
    layers = int(layer.max(initial=0)) + 1
    values, known, rows = (np.full((layers, high * wide), fill) for fill in (np.nan, False, False))
    # a value that is no number ranks above all others, where missing ones must not take its place
    values[layer, at], known[layer, at], rows[layer, at] = np.where(np.isnan(v) & ~null, np.inf, v), ~null, True
    broken = np.zeros((layers, high * wide), bool)
    broken[layer, at] = np.isnan(v) & ~null
    out = np.empty((len(cy), len(SUMS)))
    for k in range(0, len(cy), CHUNK):
        cell = ((cy[k:k + CHUNK] - top) * wide + (cx[k:k + CHUNK] - left))[:, None] + dy * wide + dx

        def around(grid: np.ndarray, members: np.ndarray) -> np.ndarray:
            return np.moveaxis(grid[:, cell[:, members]], 0, 1).reshape(len(cell), -1)  # noqa: B023

        samples, bad = around(values, box), around(broken, box)
        sums = sample_sums(
            np.where(bad, np.nan, samples), np.tile(dy[box], layers), np.tile(dx[box], layers), around(values, ring),
            around(known, ring).sum(1), around(rows, ring).sum(1) >= ring_samples, background[k:k + CHUNK])
        sums[bad.any(1), SUMS.index("_k")] = 0
        out[k:k + CHUNK] = sums
    return out
