"""Synthetic skies with known truth, and brute force on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nightsieve.operators import alignment, detection, settling, stars, statistics, trail
from nightsieve.operators.raster import support_weights
from tests.skies import scattered, star_field

K = ["frame_id"]


def pixel_frame(spark, images):
    parts = []
    for i, image in images.items():
        y, x = np.indices(image.shape)
        parts.append(pd.DataFrame({"frame_id": i, "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "v": image.ravel().astype(float)}))
    return spark.createDataFrame(pd.concat(parts)).withColumns({"y": F.col("y").cast("int"), "x": F.col("x").cast("int")})


def frame_table(spark, images):
    return spark.createDataFrame([(i, m.shape[1], m.shape[0]) for i, m in images.items()], "frame_id bigint, width int, height int")


def greedy(points, radius, inclusive=True):
    kept = []
    for p in sorted(points, key=lambda p: (-p[3], p[2], p[1], p[0])):
        limit = radius * radius
        near = ((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 for q in kept)
        if not any(d <= limit if inclusive else d < limit for d in near):
            kept.append(p)
    return {p[0] for p in kept}


@pytest.mark.parametrize("inclusive", [True, False])
def test_thinning_equals_the_greedy_result(spark, inclusive):
    rng = np.random.default_rng(5)
    rows = [(f, i, float(rng.integers(0, 60)), float(rng.integers(0, 60)), float(rng.integers(0, 9))) for f in range(3) for i in range(150)]
    df = spark.createDataFrame(rows, "frame_id int, star_id int, x double, y double, peak double")
    got = {(r["frame_id"], r["star_id"]) for r in stars.thin_by_distance(df, K, "star_id", 5.0, inclusive=inclusive).collect()}
    want = {(f, i) for f in range(3) for i in greedy([r[1:] for r in rows if r[0] == f], 5.0, inclusive)}
    assert got == want
    alone = {(r["frame_id"], r["star_id"]) for r in stars.isolated_points(df, K, "star_id", 5.0, inclusive=inclusive).collect()}
    assert alone <= got


def test_thinning_with_a_third_of_all_points_in_one_cell(spark):
    rng = np.random.default_rng(6)
    rows = [(0, i, 10 + float(rng.random()) * 0.5, 10 + float(rng.random()) * 0.5, float(rng.random())) for i in range(400)]
    rows += [(0, 400 + i, float(rng.random() * 200), float(rng.random() * 200), float(rng.random())) for i in range(800)]
    df = spark.createDataFrame(rows, "frame_id int, star_id int, x double, y double, peak double")
    got = {r["star_id"] for r in stars.thin_by_distance(df, K, "star_id").collect()}
    assert got == greedy([r[1:] for r in rows], 4.0)


def test_separated_picks_are_the_first_of_the_greedy_order(spark):
    rng = np.random.default_rng(8)
    rows = [(0, i, float(rng.random() * 300), float(rng.random() * 300), float(rng.random())) for i in range(300)]
    df = spark.createDataFrame(rows, "frame_id int, star_id int, x double, y double, peak double")
    got = [r["star_id"] for r in stars.top_k_separated(df, K, "star_id", 12, 25.0).orderBy("position").collect()]
    kept = greedy([r[1:] for r in rows], 25.0, inclusive=False)
    want = [r[1] for r in sorted((r for r in rows if r[1] in kept), key=lambda r: -r[4])][:12]
    assert got == want


def anchors_by_hand(points, width, height, k, grid):
    mx, my = width * 0.16, height * 0.16
    safe = sorted((p for p in points if mx <= p[1] <= width - 1 - mx and my <= p[2] <= height - 1 - my), key=lambda p: -p[3])
    robust = [p for p in safe if p[3] >= safe[0][3] * 0.22]
    pool, out = robust if len(robust) >= 5 else safe, []
    far = lambda p: all((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 >= 576 for q in out)
    cw, ch = (width - 2 * mx) / grid, (height - 2 * my) / grid
    for gy in range(grid):
        for gx in range(grid):
            x1 = width - mx if gx == grid - 1 else mx + (gx + 1) * cw
            y1 = height - my if gy == grid - 1 else my + (gy + 1) * ch
            cell = [p for p in pool if mx + gx * cw <= p[1] < x1 and my + gy * ch <= p[2] < y1 and far(p)]
            if cell and len(out) < k:
                out.append(cell[0])
    for p in pool:
        if len(out) < k and far(p):
            out.append(p)
    return [p[0] for p in out]


def test_anchor_points(spark):
    rng = np.random.default_rng(9)
    rows = [(0, i, float(rng.random() * 400), float(rng.random() * 300), float(rng.random() + 0.1)) for i in range(120)]
    df = spark.createDataFrame(rows, "frame_id bigint, star_id bigint, x double, y double, peak double")
    got = [r["star_id"] for r in stars.anchor_points(df, "frame_id", "star_id", 400, 300, 20, 4).orderBy("position").collect()]
    assert got == anchors_by_hand([r[1:] for r in rows], 400, 300, 20, 4)


@pytest.fixture(scope="module")
def sky(spark):
    truth = scattered(40, 320, 240)
    images = {1: star_field(320, 240, truth, sigma=1.5), 2: star_field(320, 240, truth, sigma=2.2, seed=4, level=1500)}
    return truth, images, pixel_frame(spark, images).cache(), frame_table(spark, images)


def test_stars_are_found_and_measured(spark, sky):
    truth, images, px, frames = sky
    levels = detection.frame_levels(px, frames, K)
    for row in levels.collect():
        flat = np.sort(images[row["frame_id"]].ravel())
        assert row["median"] == flat[round(0.5 * (len(flat) - 1))]
        assert np.isclose(row["sigma"], np.sqrt(((flat - row["median"]) ** 2).mean()))
        dev = np.sort(np.abs(flat - row["median"]))
        assert np.isclose(row["mad"], dev[round(0.5 * (len(dev) - 1))])
    measured, counts = detection.detect_stars(px, levels.select(*K, "background", "sigma", "width", "height"), K)
    found = measured.toPandas()
    for frame, sigma in ((1, 1.5), (2, 2.2)):
        mine = found[found.frame_id == frame]
        hits = [np.hypot(mine.x - x, mine.y - y).min() for x, y, _ in truth]
        assert np.median(hits) < 0.1 and sum(h < 0.6 for h in hits) >= 34
        assert abs(mine.fwhm.median() - 2.3548 * sigma) < 0.1 * sigma
        assert mine.ecc.median() < 0.4
    assert all(c["star_count"] >= 36 for c in counts.collect())


def peaks_by_hand(image, level, support):
    out = set()
    for y in range(1, image.shape[0] - 1):
        for x in range(1, image.shape[1] - 1):
            v, box = image[y, x], image[y - 1:y + 2, x - 1:x + 2]
            if v < level or v < box.max():
                continue
            if any(v <= image[y + dy, x + dx] for dy, dx in ((0, 1), (1, 0), (-1, 1), (1, 1))):
                continue
            if (box >= support).sum() - 1 >= 3:
                out.add((y, x))
    return out


def test_peaks_and_suppression_by_hand(spark):
    rng = np.random.default_rng(11)
    image = np.round(rng.normal(100, 10, (60, 70)))
    px = pixel_frame(spark, {1: image})
    levels = spark.createDataFrame([(1, 100.0, 5.0, 70, 60)], "frame_id bigint, background double, sigma double, width int, height int")
    got = {(r["y"], r["x"]) for r in detection.star_points(px, levels, K).collect()}
    peaks = peaks_by_hand(image, 115.0, 107.5)
    want = greedy([(y * 70 + x, x, y, image[y, x]) for y, x in peaks], 4.0)
    assert {y * 70 + x for y, x in got} == want and len(want) > 20


def test_frame_metrics_rows(spark, sky):
    _, images, px, frames = sky
    rows = {r["frame_id"]: r for r in detection.frame_metrics(px, frames).collect()}
    assert abs(rows[1]["fwhm"] - 2.3548 * 1.5) < 0.15 and abs(rows[2]["fwhm"] - 2.3548 * 2.2) < 0.2
    assert rows[1]["max"] == images[1].max() and rows[1]["min"] == images[1].min()
    assert rows[1]["trail_confidence"] == 0 and rows[1]["hfr"] < rows[2]["hfr"]


@pytest.fixture(scope="module")
def crossed(spark):
    faint = [(x, y, p / 10) for x, y, p in scattered(15, 200, 160)]
    plain = star_field(200, 160, faint, seed=1)
    slanted = star_field(200, 160, faint, seed=2, trail=((20, 10), (160, 146), 3000))
    level = star_field(200, 160, faint, seed=3, trail=((10, 80), (190, 84), 3000))
    images = {1: plain, 2: slanted, 3: level, 4: np.zeros((12, 12))}
    return images, pixel_frame(spark, images), frame_table(spark, images)


def test_trails_are_found_where_they_are(crossed):
    _, px, frames = crossed
    rows = {r["frame_id"]: r for r in trail.detect_trail(px, frames, K).collect()}
    assert rows[1]["confidence"] == 0 and rows[4]["confidence"] == 0
    assert rows[2]["confidence"] > 40 and rows[3]["confidence"] > 40
    slope = (rows[2]["y2"] - rows[2]["y1"]) * 159 / ((rows[2]["x2"] - rows[2]["x1"]) * 199)
    assert abs(slope - 136 / 140) < 0.03
    ends = [(rows[3]["x1"] * 199, rows[3]["y1"] * 159), (rows[3]["x2"] * 199, rows[3]["y2"] * 159)]
    assert all(abs(y - (80 + (x - 10) * 4 / 180)) < 1.5 for x, y in ends)


def test_trail_candidates_by_hand(spark, crossed):
    images, px, frames = crossed
    image = images[2]
    pad = np.pad(image, 2, mode="edge")
    blur = sum(pad[dy:dy + 160, dx:dx + 200] for dy in range(5) for dx in range(5)) / 25
    e = np.maximum(0, image - blur)
    flat = np.sort(e.ravel())
    threshold = max(1e-6, flat[round(0.997 * (len(flat) - 1))])
    want = {}
    for y in range(5, 155):
        for x in range(5, 195):
            if e[y, x] >= threshold:
                s = [sum(w[i] * e[y + dy, x + dx] for dy, dx, w in support_weights()) for i in range(4)]
                best, second = s[0], 0.0
                for v in s[1:]:
                    if v >= best:
                        best, second = v, best
                    else:
                        second = max(second, v)
                if best > 2 * max(0, second) and best - second >= 2 * threshold:
                    want[(y, x)] = best - second
    one = px.filter("frame_id = 2").withColumns({"width": F.lit(200), "height": F.lit(160)})
    got = {(r["y"], r["x"]): r["signal"] for r in trail.trail_candidates(one, K, F.col("width"), F.col("height")).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_alignment_finds_shift_and_rotation(spark):
    width, height = 400, 320
    truth = scattered(45, width, height, seed=13, margin=60, gap=25)
    base = star_field(width, height, truth, sigma=1.8)
    moved = star_field(width, height, [(x - 12, y + 8, p) for x, y, p in truth], sigma=1.8, seed=2)
    turned = moved[::-1, ::-1].copy()
    images = {1: base, 2: moved, 3: turned}
    rows = {r["frame_id"]: r for r in alignment.align_frames(pixel_frame(spark, images), frame_table(spark, images), "frame_id").collect()}
    assert (rows[1]["rotate180"], rows[1]["shift_x"], rows[1]["shift_y"]) == (False, 0, 0)
    assert rows[2]["rotate180"] is False and rows[3]["rotate180"] is True
    for i in (2, 3):
        assert abs(rows[i]["shift_x"] - 12) <= 2 and abs(rows[i]["shift_y"] + 8) <= 2


def test_shift_is_refined_on_full_size_patches(spark):
    side = 812
    rng = np.random.default_rng(3)
    base = rng.normal(100, 5, (side, side))
    base = (base + np.roll(base, 1, 0) + np.roll(base, 1, 1) + np.roll(base, (1, 1), (0, 1))) / 4
    moved = np.roll(base, (-2, 3), (0, 1))  # to match, move by dx -3, dy +2
    images = {1: base, 2: moved}
    px = pixel_frame(spark, images)
    seeds = spark.createDataFrame([(1, False, side, side, 0, 0, 2, 2), (2, False, side, side, -2, 1, 2, 2)],
                                  "frame_id bigint, rotate180 boolean, width int, height int, dx int, dy int, rx int, ry int")
    first = spark.createDataFrame([(1,)], "r bigint")
    got = {r["frame_id"]: (r["dx"], r["dy"]) for r in alignment.refine_shift(px, seeds, first, "frame_id").collect()}
    assert got == {1: (0, 0), 2: (-3, 2)}


def test_region_of_interest_sits_on_the_nebula(spark):
    rng = np.random.default_rng(2)
    yy, xx = np.mgrid[0:300, 0:400]
    image = rng.normal(100, 2, (300, 400)) + 60 * np.exp(-((xx - 240) ** 2 + (yy - 130) ** 2) / (2 * 25**2)) * (1 + 0.3 * np.sin(xx / 3))
    images = {1: image}
    frames = frame_table(spark, images)
    centers = alignment.roi_center(pixel_frame(spark, images), frames, K)
    row = alignment.roi_rect(centers.join(frames, K)).first()
    assert abs(row["cx"] - 240) < 30 and abs(row["cy"] - 130) < 30
    assert np.isclose(row["roi_width"] * 400, 150) and np.isclose(row["roi_height"] * 300, 150)


def test_kernel_smooth_by_hand(spark):
    rng = np.random.default_rng(4)
    rows = [(0, i, float(rng.random() * 400), float(rng.random() * 200), float(rng.random() * 4 + 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "frame_id bigint, star_id bigint, x double, y double, fwhm double")
    got = {(r["gy"], r["gx"]): r["value"] for r in stars.kernel_smooth(df, K, "fwhm", 400, 200, 16).collect()}
    assert len(got) == 16 * 8
    bandwidth = 2 * (np.hypot(400, 200) / 6) ** 2
    for (gy, gx), value in list(got.items())[::17]:
        w = [np.exp(-((x - (gx + 0.5) * 25) ** 2 + (y - (gy + 0.5) * 25) ** 2) / bandwidth) for _, _, x, y, _ in rows]
        assert np.isclose(value, np.dot(w, [r[4] for r in rows]) / sum(w))


def test_large_rasters_use_the_strided_sample(spark):
    image = np.arange(1000.0).reshape(20, 50)
    got = [r["v"] for r in statistics.stride_sample(pixel_frame(spark, {1: image}), F.col("y") * 50 + F.col("x"), 1000, cap=333).orderBy("v").collect()]
    assert got == [float(int(i * (1000 / 333))) for i in range(333)]


def test_no_star_or_sample_is_left_out(spark):
    edge = [(0, i, float(i % 400), 2.0, 100.0 + i) for i in range(2100)]  # brighter than the one star inside the margin
    df = spark.createDataFrame([*edge, (0, 9999, 200.0, 150.0, 5.0)], "frame_id bigint, star_id bigint, x double, y double, peak double")
    assert [r["star_id"] for r in stars.anchor_points(df, "frame_id", "star_id", 400, 300).collect()] == [9999]
    wide = spark.range(500 * 401).select(
        F.lit(1).alias("frame_id"), F.floor(F.col("id") / 500).cast("int").alias("y"), (F.col("id") % 500).cast("int").alias("x"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    frames = spark.createDataFrame([(1, 500, 401)], "frame_id int, width int, height int")
    want = np.where(np.arange(500 * 401) % 3 == 0, 0.0, np.arange(500.0 * 401))
    [got] = detection.frame_levels(wide, frames, ["frame_id"]).collect()
    assert got["median"] == np.sort(want)[round(0.5 * (len(want) - 1))]
    points = np.array([(x, y) for y in range(14, 14 + 16 * 46, 16) for x in range(14, 14 + 16 * 46, 16)])
    image = np.full((750, 750), 100.0)
    for dy in range(-3, 4):
        for dx in range(-3, 4):
            image[points[:, 1] + dy, points[:, 0] + dx] += 500 * np.exp(-(dy * dy + dx * dx) / 1.6)
    levels = spark.createDataFrame([(1, 100.0, 5.0, 750, 750)], "frame_id int, background double, sigma double, width int, height int")
    measured, counts = detection.detect_stars(pixel_frame(spark, {1: image}), levels, ["frame_id"])
    assert counts.first()["star_count"] > 2000 and measured.count() > 2000


@pytest.mark.parametrize("inclusive", [True, False])
def test_thinning_across_small_tiles(spark, monkeypatch, inclusive):
    """Tiles of a few cells, so that nearly every decision crosses borders; ties, repeated rows and missing values."""
    monkeypatch.setattr(settling, "CELLS_A_TILE", 4)
    rng = np.random.default_rng(11)
    rows = [(f, i, float(rng.integers(-40, 60)), float(rng.integers(-40, 60)), float(rng.integers(0, 9))) for f in range(2) for i in range(500)]
    odd = [(0, 900, None, 1.0, 50.0), (0, 901, float("nan"), 1.0, 50.0), (None, 902, 1.0, 1.0, 50.0), (0, None, 1.0, 1.0, 50.0), (1, 903, 500.0, 500.0, None)]
    df = spark.createDataFrame(rows + rows[:50] + odd, "frame_id int, star_id int, x double, y double, peak double")
    got = sorted((r["frame_id"], r["star_id"]) for r in stars.thin_by_distance(df, K, "star_id", 5.0, inclusive=inclusive).collect())
    want = {(f, i) for f in range(2) for i in greedy([r[1:] for r in rows if r[0] == f], 5.0, inclusive)}
    assert got == sorted(want | {(1, 903)})
    assert stars.thin_by_distance(df.limit(0), K, "star_id").collect() == []


def test_thinning_of_tiles_too_crowded_for_a_task(spark, monkeypatch):
    monkeypatch.setattr(settling, "CELLS_A_TILE", 8)
    monkeypatch.setattr(settling, "POINTS_A_TILE", 40)
    rng = np.random.default_rng(12)
    rows = [(0, i, float(rng.random() * 20), float(rng.random() * 20), float(rng.random())) for i in range(300)]
    rows += [(0, 300 + i, float(rng.random() * 150), float(rng.random() * 150), float(rng.random())) for i in range(300)]
    df = spark.createDataFrame(rows, "frame_id int, star_id int, x double, y double, peak double")
    got = {r["star_id"] for r in stars.thin_by_distance(df, K, "star_id").collect()}
    assert got == greedy([r[1:] for r in rows], 4.0)


def test_a_long_falling_chain_ends_in_few_rounds(spark, monkeypatch):
    """10,000 points, each hiding the next: a round that settles only the brightest would need 5,000 of them."""
    passes = []
    whole = settling.settle_tiles
    monkeypatch.setattr(settling, "settle_tiles", lambda *a: passes.append(1) or whole(*a))
    chain = spark.range(10_000).select(
        F.lit(0).alias("frame_id"), F.col("id").alias("star_id"), (F.col("id") * 3.0).alias("x"), F.lit(5.0).alias("y"),
        (F.lit(1e6) - F.col("id")).alias("peak"),
    )
    got = sorted(r["star_id"] for r in stars.thin_by_distance(chain, K, "star_id").collect())
    assert got == list(range(0, 10_000, 2))
    assert len(passes) == 1


@pytest.mark.parametrize("inclusive", [True, False])
def test_small_frames_are_thinned_without_tiles(spark, monkeypatch, inclusive):
    """Far-off points, ties and repeated rows in one kernel call; the tiles come to the same."""
    rng = np.random.default_rng(21)
    rows = [(f, i, float(rng.integers(-40, 60)), float(rng.integers(-40, 60)), float(rng.integers(0, 9))) for f in range(2) for i in range(400)]
    rows += [(1, 500 + i, 1e17 * i, -1e17 * i, 3.0) for i in range(40)]
    df = spark.createDataFrame(rows + rows[:50], "frame_id int, star_id int, x double, y double, peak double")
    want = sorted((f, i) for f in range(2) for i in greedy([r[1:] for r in rows if r[0] == f], 5.0, inclusive))
    near = df.filter("star_id < 500")
    with monkeypatch.context() as small:
        small.setattr(settling, "CELLS_A_TILE", 4)
        tiles = sorted(map(tuple, stars.thin_by_tiles(near, K, "star_id", 5.0, "peak", inclusive).collect()))
    assert tiles == [w for w in want if w[1] < 500]
    monkeypatch.setattr(settling, "settle_tiles", lambda *a: pytest.fail("a small frame went to tiles"))
    assert sorted(map(tuple, stars.thin_by_distance(df, K, "star_id", 5.0, inclusive=inclusive).collect())) == want
