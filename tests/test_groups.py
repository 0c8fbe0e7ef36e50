"""Kernels over whole small groups agree with the paths for large ones and with brute force."""

import numpy as np
from pyspark.sql import functions as F

from nightsieve.catalog import stars_queries, views
from nightsieve.operators import alignment, stars, trail

K = ["frame_id"]
STARS = "frame_id bigint, star_id bigint, x double, y double, peak double"


def field(seed, frames=3, n=120, side=80):
    rng = np.random.default_rng(seed)
    return [(f, i, float(rng.integers(0, side)), float(rng.integers(0, side)), float(rng.integers(1, 40))) for f in range(frames) for i in range(n)]


def no_frame_fits(df):
    """Sizes that send every frame down the path for large ones."""
    return df.select(*K).distinct().withColumn("rows", F.lit(10**9))


def test_isolated_points_of_small_and_large_frames_and_without_position(spark):
    rows = field(3) + [(0, 900, None, 5.0, 9.0), (0, 901, None, 5.0, 9.0), (1, 902, 3.0, 4.0, None)]
    df = spark.createDataFrame(rows, STARS)

    def better(b, a):
        return (-b[4], b[3], b[2], b[1]) < (-a[4], a[3], a[2], a[1])

    known = [r for r in rows if None not in r]
    want = {r[:2] for r in rows if None in r} | {
        a[:2] for a in known if not any(b[0] == a[0] and (b[2] - a[2]) ** 2 + (b[3] - a[3]) ** 2 <= 36 and better(b, a) for b in known)
    }
    for sizes in (None, no_frame_fits(df)):
        got = [tuple(r) for r in stars.isolated_points(df, K, "star_id", 6.0, sizes=sizes).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    plan = stars.isolated_points(df, K, "star_id", 6.0)._jdf.queryExecution().toString()
    assert "explode" not in plan  # no row per point and cell


def test_density_maps_of_small_and_large_frames(spark):
    df = spark.createDataFrame(field(4) + [(7, 1, 2.0, 2.0, 0.0)], STARS)
    maps = [
        {(r["frame_id"], r["y"], r["x"]): r["v"] for r in alignment.density_map(df, K, 80, 80, 16, sizes=sizes).collect()}
        for sizes in (None, no_frame_fits(df))
    ]
    assert len(maps[0]) == 4 * 16 * 16 and maps[0].keys() == maps[1].keys()
    assert all(abs(v - maps[1][cell]) < 1e-9 for cell, v in maps[0].items())
    assert "explode" not in alignment.density_map(df, K, 80, 80, 16)._jdf.queryExecution().toString()


def test_lines_of_small_and_large_frames(spark):
    rows = [(f, i, 10.0 * i, 50.0 + 2.0 * i + f, 40.0) for f in range(2) for i in range(60)]
    df = spark.createDataFrame(rows + field(5, frames=3, side=600), "frame_id bigint, star_id bigint, x double, y double, signal double")
    found = []
    for sizes in (None, no_frame_fits(df)):
        lines = trail.line_votes(df, K, F.lit(10.0), 800, 600, sizes=sizes)
        axes = trail.principal_axis(df, lines, K, 800, 600, sizes=sizes)
        trails = trail.trail_gates_score(df, axes, K, 800, 600, sizes=sizes)
        found.append([sorted(lines.select(*K, "angle", "rho", "votes", "points").collect()), sorted(trails.collect())])
    assert found[0][0] == found[1][0] and len(found[0][0]) > 0
    assert [r["frame_id"] for r in found[0][1]] == [r["frame_id"] for r in found[1][1]] and len(found[0][1]) > 0
    for a, b in zip(*[f[1] for f in found]):
        assert a["confidence"] == b["confidence"] and all(abs(a[c] - b[c]) < 1e-9 for c in ("x1", "y1", "x2", "y2"))
    plan = trail.line_votes(df, K, F.lit(10.0), 800, 600)._jdf.queryExecution().toString()
    assert "explode" not in plan  # no row per point and angle


def test_the_reference_frame_is_found_without_forming_triangles(spark):
    folder = "/root/testdata/sf0.001"
    rows = views.stars(spark, folder)
    first = stars_queries.of_first_frame(spark, folder, rows)
    plan = first._jdf.queryExecution().toString()
    assert "generate" not in plan.lower() and "window" not in plan.lower()
    assert {r["frame_id"] for r in first.select("frame_id").collect()} == {rows.agg(F.min("frame_id")).first()[0]}
