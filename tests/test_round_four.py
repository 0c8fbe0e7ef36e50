"""Findings of the third review round."""

from pyspark.sql import functions as F

from nightsieve.operators import scoring, stars

K = ["frame_id"]


def test_votes_are_counted_about_the_unrounded_shift(spark):
    # one matched triangle: shifts 0, 7.4 and 15.3 in x; 15.3 is within 8 of 7.4, not of the rounded 7
    matches = spark.createDataFrame([(1, 0, 1, 2, 0, 1, 2)], "frame_id int, r_a int, r_b int, r_c int, a int, b int, c int")
    reference = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 7.4, 0.0, 1.0), (2, 15.3, 0.0, 1.0)], "position int, x double, y double, scale double")
    seen = reference.select(F.lit(1).alias("frame_id"), "position", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "scale")
    found = stars.triangle_votes(matches, reference, seen, K).collect()
    assert [tuple(r) for r in found] == [(1, 7, 0, 1.0)]


def test_percentiles_take_one_row_a_frame_through_the_joins(spark, monkeypatch):
    rows = [(i, "ab"[i % 2], None if i % 13 == 0 else float(i * 7 % 20), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "frame_id int, filter_name string, fwhm double, hfr double")
    found = []
    for room in (200_000, 50, 0):  # all tables broadcast, the smaller one, none
        monkeypatch.setattr(scoring, "MAX_LOOKUP_ROWS", room, raising=False)
        ranked = scoring.rank_percentile(df, "frame_id", F.col("filter_name"), {"fwhm": True, "hfr": False})
        assert "generate" not in ranked._jdf.queryExecution().toString().lower()  # no row per frame and metric
        found.append(sorted(tuple(r) for r in ranked.collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == 60
    by_hand = {}
    for name in "ab":
        values = [r[2] for r in rows if r[1] == name and r[2] is not None]
        for r in rows:
            if r[1] == name:
                below, equal = sum(v < r[2] for v in values) if r[2] is not None else 0, values.count(r[2])
                by_hand[r[0]] = 0.0 if r[2] is None else 1.0 - (below + (below + equal - 1)) / 2.0 / (len(values) - 1)
    assert {r[0]: r[2] for r in found[0]} == by_hand


def test_triangles_are_formed_in_kernels_and_skip_stars_without_position(spark):
    rows = [(1, 0, 0.0, 0.0, 9.0), (1, 1, 4.0, 0.0, 8.0), (1, 2, 0.0, 3.0, 7.0), (1, 3, None, 5.0, 6.0), (2, 0, 1.0, 1.0, 5.0), (2, 1, 2.0, 2.0, 4.0)]
    df = spark.createDataFrame(rows, "frame_id int, star_id int, x double, y double, peak double")
    found = stars.triangle_signatures(df, K, "star_id")
    assert "generate" not in found._jdf.queryExecution().toString().lower()  # no row per corner, copying the list
    assert [tuple(r) for r in found.collect()] == [(1, 1, 2, 0, 0.6, 0.8, 0.48)]
    assert dict(found.dtypes) == dict(frame_id="int", a="int", b="int", c="int", ratio1="double", ratio2="double", area="double")
