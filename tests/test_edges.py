"""Missing values, ties, tiny groups, mixed-case keys and other semantics the views do not reach."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nightsieve import catalog
from nightsieve.functions import display, keys, tone
from nightsieve.operators import ordering, scoring, stars, statistics, summary, thresholds, verdicts
from nightsieve.plans import ranges
from nightsieve.plans.lookup import checked
from nightsieve.schema import Limits, ScoredMetric, limits_table
from nightsieve.sources import documents, files

NAN, INF = float("nan"), float("inf")


def pcts(spark, rows, lower=True):
    df = spark.createDataFrame(rows, "id int, g string, v double")
    out = scoring.rank_percentile(df, "id", keys.group_key("g"), {"v": lower})
    return {r["id"]: r["pct_v"] for r in out.collect()}


def test_rank_percentile_ties_and_invalid_values(spark):
    rows = [(1, "Ha", 1.0), (2, " HA", 2.0), (3, "ha", 2.0), (4, "Ha ", 5.0), (5, "Ha", NAN), (6, "Ha", None), (7, "Ha", INF)]
    assert pcts(spark, rows) == {1: 1.0, 2: 0.5, 3: 0.5, 4: 0.0, 5: 0.0, 6: 0.0, 7: 0.0}
    assert pcts(spark, rows, lower=False) == {1: 0.0, 2: 0.5, 3: 0.5, 4: 1.0, 5: 0.0, 6: 0.0, 7: 0.0}


def test_rank_percentile_tiny_groups(spark):
    rows = [(1, "a", None), (2, "b", 3.0), (3, "c", 4.0), (4, "c", NAN), (5, None, None), (6, "  ", None)]
    # one row: 1 whatever it holds; one valid value: 1; none valid: 0
    assert pcts(spark, rows) == {1: 1.0, 2: 1.0, 3: 1.0, 4: 0.0, 5: 0.0, 6: 0.0}


def test_score_without_weights_is_zero(spark):
    df = spark.createDataFrame([(1, "a", 1.0)], "frame_id int, filter_name string, v double")
    assert scoring.quality_score(df, metrics=[ScoredMetric("v", -1.0)]).first()["score"] == 0.0
    assert scoring.quality_score(df, metrics=[ScoredMetric("v", 2.0, shown=False)]).first()["score"] == 0.0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 64, 101])
def test_nearest_rank_rounds_half_to_even(spark, n):
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("v"))
    row = statistics.nearest_rank_percentile(df, ["k"], "v", {"p": 0.5, "q": 0.25}).first()
    assert row["p"] == round(0.5 * (n - 1)) and row["q"] == round(0.25 * (n - 1))
    plain = statistics.nearest_rank_percentile(df, ["k"], "v", {"p": 0.5, "q": 0.25}, bounded=True).first()
    assert tuple(plain) == tuple(row)


def test_statistics_skip_non_finite_values(spark):
    df = spark.createDataFrame([(1, NAN), (1, 2.0), (1, INF), (1, 2.0), (1, -INF), (1, 7.0), (2, NAN)], "k int, v double")
    rows = {r["k"]: r for r in statistics.extrema_with_counts(df, ["k"], "v").collect()}
    assert tuple(rows[1])[1:] == (2.0, 2, 7.0, 1) and tuple(rows[2])[1:] == (0.0, 0, 0.0, 0)
    assert {r["k"]: r["p"] for r in statistics.nearest_rank_percentile(df, ["k"], "v", {"p": 1.0}).collect()} == {1: 7.0, 2: 0.0}


def test_weighted_median_without_weight_is_zero(spark):
    df = spark.createDataFrame([(1, 5.0, 0.0), (2, 5.0, 1.0), (2, 9.0, 1.0), (3, NAN, 4.0), (2, 1.0, -3.0)], "k int, v double, w double")
    got = {r["k"]: r["weighted_median"] for r in statistics.weighted_median(df, ["k"], "v", "w").collect()}
    assert got == {1: 0.0, 2: 5.0, 3: 0.0}


def limits(**kw):
    return {"": Limits.manual(**kw)}


def judged(spark, rows, table, schema="frame_id int, filter_name string, fwhm double, star_count int, trail_confidence int"):
    df = thresholds.with_thresholds(spark.createDataFrame(rows, schema), limits_table(spark, table))
    return {r[0]: r[1] for r in df.select("frame_id", thresholds.threshold_predicate(thresholds.clauses_for(df))).collect()}


def test_verdict_is_strict_and_ignores_missing(spark):
    rows = [(1, "a", 8.0, 5, 0), (2, "a", 8.1, 5, 0), (3, "a", NAN, 5, 0), (4, "a", None, 5, 0), (5, "a", 1.0, 4, 0), (6, "a", 1.0, 5, 80)]
    got = judged(spark, rows, limits(max_fwhm=8.0, min_stars=5, min_trail=80))
    assert got == {1: False, 2: True, 3: False, 4: False, 5: True, 6: True}
    off = judged(spark, rows, limits(max_fwhm=8.0, min_stars=5, min_trail=0))
    assert off[6] is False


def test_missing_group_uses_base_row_then_defaults(spark):
    df = spark.createDataFrame([(1, " HA "), (2, "x"), (3, None)], "frame_id int, filter_name string")
    with_base = thresholds.with_thresholds(df, limits_table(spark, {"": Limits(max_fwhm=3.0), "Ha": Limits(max_fwhm=2.0)}))
    assert {r["frame_id"]: r["max_fwhm"] for r in with_base.collect()} == {1: 2.0, 2: 3.0, 3: 3.0}
    bare = thresholds.with_thresholds(df, limits_table(spark, {"ha": Limits(max_fwhm=2.0)}))
    assert {r["frame_id"]: r["max_fwhm"] for r in bare.collect()} == {1: 2.0, 2: 8.0, 3: 8.0}


def test_automatic_limits_reject_nothing_but_trails(spark):
    rows = [(i, "Ha" if i % 2 else "oiii", float(i), 0.1, 10 * i, 100.0, i * 30) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "frame_id int, filter_name string, fwhm double, hfr double, star_count int, mean_background double, trail_confidence int")
    out = thresholds.apply_thresholds(df)
    assert {r["frame_id"]: r["auto_rejected"] for r in out.collect()} == {1: False, 2: False, 3: True, 4: True}
    reasons = {r["frame_id"]: r["reasons"] for r in out.collect()}
    assert reasons[1] == [] and reasons[3] == ["Satellite trail confidence 90%  ≥  limit 80%"]


def test_reason_text_and_rounding(spark):
    df = spark.createDataFrame([(1, "a", 4.21), (2, "a", 4.125)], "frame_id int, filter_name string, fwhm double")
    df = thresholds.with_thresholds(df, limits_table(spark, limits(max_fwhm=3.5)))
    texts = [r[0] for r in df.orderBy("frame_id").select(thresholds.rejection_reasons(thresholds.clauses_for(df))).collect()]
    assert texts == [["FWHM 4.21 px  >  limit 3.50 px"], ["FWHM 4.13 px  >  limit 3.50 px"]]


@pytest.mark.parametrize("value,digits,text", [(0.125, 2, "0.13"), (1.005, 2, "1.00"), (2.5, 0, "3"), (-2.5, 0, "-3"), (0.5, 0, "1"), (1234567.25, 1, "1234567.3")])
def test_fixed_point_text(spark, value, digits, text):
    assert spark.range(1).select(display.fixed(F.lit(value), digits)).first()[0] == text


def test_toggle_clears_override_when_back_to_automatic(spark):
    df = spark.createDataFrame([(1, True, None), (2, True, False), (3, False, None), (4, False, True)], "frame_id int, auto_rejected boolean, manual_override boolean")
    once = verdicts.toggle_override(df, df.select("frame_id"))
    assert {r[0]: r[2] for r in once.collect()} == {1: False, 2: None, 3: True, 4: None}
    twice = verdicts.toggle_override(once, df.select("frame_id"))
    assert {r[0]: r[2] for r in twice.collect()} == {1: None, 2: False, 3: None, 4: True}


def test_blank_groups_vanish_once_chips_exist(spark):
    df = spark.createDataFrame([(1, "Ha", False), (2, " ", False), (3, "OIII", True)], "frame_id int, filter_name string, is_rejected boolean")
    ids = lambda x: sorted(r["frame_id"] for r in x.collect())
    chips = spark.createDataFrame([("ha", True), ("oiii", False)], "group_key string, selected boolean")
    assert ids(verdicts.visible(df)) == [1, 2, 3]
    assert ids(verdicts.visible(df, chips)) == [1]
    assert ids(verdicts.visible(df, chips, include_blank=True)) == [1, 2]
    assert ids(verdicts.visible(df, chips.limit(0))) == [1, 2, 3]
    assert ids(verdicts.visible(df, show_accepted=False)) == [3]


def test_order_of_missing_values_and_nan(spark):
    rows = [(1, "b", None), (2, "A", None), (3, "c", 1.0), (4, "d", NAN), (5, "e", 2.0)]
    df = spark.createDataFrame(rows, "frame_id int, file_name string, fwhm double")
    order = lambda d: [r["frame_id"] for r in ordering.multi_sort(df, [("Fwhm", d)]).collect()]
    assert order("asc") == [4, 3, 5, 2, 1]
    assert order("desc") == [5, 3, 4, 2, 1]
    for d in ("asc", "desc"):
        placed = ordering.sort_position(df, [("Fwhm", d)])
        assert [r["frame_id"] for r in placed.orderBy("idx").collect()] == order(d)


def test_sort_rules_keep_the_last_one():
    rules = ordering.add_rule(list(ordering.DEFAULT_RULES))
    assert rules[-1] == ("Score", "asc")
    assert ordering.remove_rule(rules[:1], 0) == rules[:1]
    for _ in range(40):
        rules = ordering.add_rule(rules)
    assert len(rules) == 16


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_range_helpers_match_plain_windows(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.range(3000).select(
            "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 11).cast("string"))).alias("g"),
            F.when(F.col("id") % 17 == 0, None).otherwise((F.col("id") * 7919 % 251).cast("double")).alias("v"),
        )
        a = {(r["g"], r["v"]): tuple(r)[2:] for r in ranges.value_prefix(df, ["g"], "v").collect()}
        b = {(r["g"], r["v"]): tuple(r)[2:] for r in ranges.value_prefix(df, ["g"], "v", bounded=True).collect()}
        assert a == b
        indexed = ranges.row_index(df, [("v", "desc"), "id"], ["g"], size="n").collect()
        for g in {r["g"] for r in indexed}:
            mine = sorted((r for r in indexed if r["g"] == g), key=lambda r: (r["v"] is None, -(r["v"] or 0), r["id"]))
            assert [r["idx"] for r in mine] == list(range(len(mine))) and {r["n"] for r in mine} == {len(mine)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_checked_lookup_refuses_large_tables(spark):
    assert checked(spark.range(10), 10)[1] is True
    same, fits = checked(spark.range(11), 10)
    assert fits is False and same.count() == 11


@settings(max_examples=25, deadline=None)
@given(st.floats(0.001, 0.999), st.floats(0.001, 0.999))
def test_inverse_mtf_inverts(spark, target, x):
    m = tone.inverse_mtf(target, x)
    got = spark.range(1).select(tone.mtf(F.lit(x), m)).first()[0]
    assert math.isclose(got, target, rel_tol=1e-6, abs_tol=1e-5)


def test_sweep_falls_with_the_limit(spark):
    df = spark.range(200).select(F.lit("a").alias("filter_name"), (F.col("id") % 50 / 10).alias("fwhm"))
    got = [r["rejected"] for r in summary.threshold_sweep(df, "fwhm", [0.5, 1.0, 2.5, 4.9, 9.0]).orderBy("limit").collect()]
    assert got == sorted(got, reverse=True) and got[-1] == 0 and got[0] == 4 * 44


def test_relative_path_needs_a_separator(spark):
    df = spark.createDataFrame([("/a/bc/x.fits",), ("/a/b/n/x.fits",), ("/a/b/x.fits",), ("/A/B/N/y.fits",)], "p string")
    got = [r[0] for r in df.select(files.relative_path(F.col("p"), "/a/b/;/a")).collect()]
    assert got == ["bc", "n", "b", "N"]


def test_missing_session_is_none(spark, tmp_path):
    assert documents.session_read(spark, str(tmp_path / "none")) is None


def test_session_round_trip(spark, tmp_path):
    rows = [(f"/in/{i}.fits", f"{i}.fits", None if i % 2 else "n", bool(i % 3), None if i % 4 else True, float(i), "Ha") for i in range(25)]
    df = spark.createDataFrame(rows, "path string, file_name string, relative_path string, auto_rejected boolean, manual_override boolean, fwhm double, filter_name string")
    documents.session_write(df, str(tmp_path / "s"), {"ShowRejected": F.lit(False)}, part_rows=10)
    back = documents.session_read(spark, str(tmp_path / "s"))
    assert back.count() == 3
    assert {r["show_rejected"] for r in documents.session_settings(back).collect()} == {False}
    frames = documents.session_frames(back).select(*df.columns)
    assert sorted(map(tuple, frames.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_moves_share_no_destination(spark):
    from nightsieve.operators.moves import move_manifest

    names = ["a.fits", "a.fits", "a_1.fits", "A.fits", "b", "b", "a_1.fits"]
    df = spark.createDataFrame([(i, n, "", "Ha", True) for i, n in enumerate(names)], "frame_id int, file_name string, relative_path string, filter_name string, is_rejected boolean")
    got = {r[0]: r[1] for r in move_manifest(df, "/rej").collect()}
    assert len({v.lower() for v in got.values()}) == len(names)
    assert (got[0], got[2], got[4], got[5]) == ("/rej/a.fits", "/rej/a_1.fits", "/rej/b", "/rej/b_1")


def test_two_planes_have_no_blue(spark):
    from nightsieve.sources.fits import slab_luminance

    rows = [("p", 0, 1, 1, c, [v]) for c, v in ((0, 100.0), (1, 200.0))]
    slabs = spark.createDataFrame(rows, "path string, y0 int, width int, height int, channel int, samples array<float>")
    assert abs(slab_luminance(slabs).first()["samples"][0] - 164.30) < 1e-3


def test_scope_update_reaches_every_group(spark):
    from nightsieve.operators.thresholds import scope_update

    limits = spark.range(1500).selectExpr("cast(id as string) as group_key", "1.0d as max_fwhm")
    assert scope_update(limits, "max_fwhm", 5.5, [], []).filter("max_fwhm = 5.5").count() == 1500


def test_triangles_are_registered_over_all_stars_of_the_operator(spark):
    got = catalog.queries()["triangle_signatures_full"](spark, "/root/testdata/sf0.001")
    corners = {c for r in got.collect() for c in (r["a"], r["b"], r["c"])}
    assert corners == set(range(stars.TRIANGLE_STARS))
