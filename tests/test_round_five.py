"""Stars are measured where their samples meet, not by a row per star and sample."""

import numpy as np

from nightsieve.operators import detection

K = ["frame_id"]


def glow(y, x, cy, cx, sigma=1.6):
    return 100.0 + 900.0 * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * sigma * sigma))


def field(spark, centres, height=40, width=280, lost=()):
    y, x = np.mgrid[0:height, 0:width]
    v = sum(glow(y, x, cy, cx) - 100.0 for cy, cx in centres) + 100.0
    rows = [(1, int(a), int(b), None if (a, b) in lost else float(v[a, b])) for a, b in zip(y.ravel(), x.ravel())]
    points = [(1, i, round(cx), round(cy), 900.0, 90.0) for i, (cy, cx) in enumerate(centres)]
    return (spark.createDataFrame(rows, "frame_id bigint, y int, x int, v double"),
            spark.createDataFrame(points, "frame_id bigint, star_id bigint, cx int, cy int, peak double, background double"))


CENTRES = [(15.2, 20.3), (18.4, 114.6), (20.1, 141.0), (22.0, 255.7)]


def measured(pixels, points):
    return {r["star_id"]: r for r in detection.measure_stars(pixels, points, K).collect()}


def test_stars_at_tile_borders_keep_their_centres_and_widths(spark, monkeypatch):
    pixels, points = field(spark, CENTRES)
    whole = measured(pixels, points)
    for i, (cy, cx) in enumerate(CENTRES):
        assert abs(whole[i]["x"] - cx) < 0.05 and abs(whole[i]["y"] - cy) < 0.05
        assert abs(whole[i]["fwhm"] - 1.6 * 2.35482) < 0.05
    monkeypatch.setattr(detection, "TILE", 32)
    again = measured(pixels, points)
    assert again.keys() == whole.keys() and all(np.allclose(again[i], whole[i], rtol=1e-12) for i in whole)


def test_null_samples_of_a_ring_do_not_lower_its_median(spark):
    y, x = np.mgrid[0:40, 0:280]
    squared = (y - 15) ** 2 + (x - 20) ** 2
    ring = list(zip(*(a.tolist() for a in np.nonzero((squared >= 81) & (squared <= 169)))))
    pixels, points = field(spark, CENTRES[:1])
    # the ring's samples rise from 100 to 400 outside the box, so losing the lowest ones moves a median that counts nulls
    raised = {at: 100.0 + k for k, at in enumerate(ring)}
    rows = [(1, r["y"], r["x"], raised.get((r["y"], r["x"]), r["v"])) for r in pixels.collect() if not (r["y"], r["x"]) in ring[1::2]]
    gaps = [(1, *at, None) for at in ring[1::2]]
    schema = "frame_id bigint, y int, x int, v double"
    without = measured(spark.createDataFrame(rows, schema), points)
    with_nulls = measured(spark.createDataFrame(rows + gaps, schema), points)
    assert with_nulls.keys() == without.keys() and all(np.allclose(with_nulls[i], without[i], rtol=1e-9) for i in without)


def test_measuring_sorts_no_row_per_star_and_sample(spark):
    pixels, points = field(spark, CENTRES)
    plan = detection.measure_stars(pixels, points, K)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("SortMergeJoin") == 0
