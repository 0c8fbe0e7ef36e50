"""Queries over the `stars` view: 2000 x 1500 frames."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from nightsieve.catalog import views
from nightsieve.catalog.registry import query
from nightsieve.functions import geometry
from nightsieve.operators import alignment, ordering, stars, statistics, trail

K = ["frame_id"]
W, H = views.STAR_FRAME


def rounded(df, *columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


WEIGHT = f"""case when sqrt((x - 1000) * (x - 1000) + (y - 750) * (y - 750)) / sqrt(1000.0::double * 1000.0 + 750.0::double * 750.0) >= 0.75 then 0.0::double else
 power(cos(sqrt((x - 1000) * (x - 1000) + (y - 750) * (y - 750)) / sqrt(1000.0::double * 1000.0 + 750.0::double * 750.0) / 0.75::double * {math.pi!r}::double * 0.5::double), 4) end"""


@query("radial_weight", f"select frame_id, star_id, round({WEIGHT}, 9) as weight from stars", ("stars",))
def _radial_weight(spark, d):
    df = views.stars(spark, d)
    return df.select(*K, "star_id", F.round(geometry.radial_weight("x", "y", W, H), 9).alias("weight"))


@query("weighted_median", """
with c as (select frame_id, fwhm, sum(n) over (partition by frame_id order by fwhm) as run, sum(n) over (partition by frame_id) as total from stars)
select frame_id, min(fwhm) as weighted_median from c where run >= total * 0.5::double group by 1
""", ("stars",))
def _weighted_median(spark, d):
    return statistics.weighted_median(views.stars(spark, d), K, "fwhm", "n")


@query("center_weighted_medians", f"""
with w as (select *, {WEIGHT} as w from stars), g as (select * from w where w > 0),
f as (select frame_id, min(fwhm) as fwhm from (select *, sum(w) over (partition by frame_id order by fwhm) as run, sum(w) over (partition by frame_id) as total from g) where run >= total * 0.5::double group by 1),
h as (select frame_id, min(hfr) as hfr from (select *, sum(w) over (partition by frame_id order by hfr) as run, sum(w) over (partition by frame_id) as total from g) where run >= total * 0.5::double group by 1)
select frame_id, f.fwhm, h.hfr from f join h using (frame_id)
""", ("stars",))
def _center_weighted_medians(spark, d):
    return statistics.center_weighted_medians(views.stars(spark, d), K, ["fwhm", "hfr"], W, H)


@query("trimmed_median", """
with r as (select frame_id % 7 * 1000 + cast(x / 40 as int) as g, fwhm, row_number() over (partition by frame_id % 7 * 1000 + cast(x / 40 as int) order by fwhm) as rn,
  count(*) over (partition by frame_id % 7 * 1000 + cast(x / 40 as int)) as n from stars)
select g as cell, case when max(n) >= 10 then round(median(fwhm) filter (rn > n // 10 and rn <= n - n // 10), 9) else round(coalesce(median(fwhm) filter (fwhm > 0), 0), 9) end as trimmed_median from r group by 1
""".replace("cast(x / 40 as int)", "cast(floor(x / 40) as int)"), ("stars",))
def _trimmed_median(spark, d):
    cell = (F.col("frame_id") % 7 * 1000 + F.floor(F.col("x") / 40)).alias("cell")
    return rounded(statistics.trimmed_median(views.stars(spark, d).select(cell, "fwhm"), ["cell"], "fwhm"), "trimmed_median")


@query("median_metric", "select frame_id, round(median(fwhm) filter (fwhm > 0), 9) as median from stars group by 1", ("stars",))
def _median_metric(spark, d):
    return rounded(statistics.median_metric(views.stars(spark, d), K), "median")


@query("star_quality_filter", """
with t as (select *, max(peak) over (partition by frame_id) * 0.9::double as top from stars),
o as (select *, coalesce(peak < top * 0.85::double and ecc < 0.7 and fwhm > 0 and fwhm < 12, false) as ok from t),
c as (select *, count_if(ok) over (partition by frame_id) as n_ok from o)
select frame_id, star_id from c where ok or n_ok < 10
""", ("stars",))
def _star_quality_filter(spark, d):
    df = views.stars(spark, d)
    tops = df.groupBy(*K).agg((F.max("peak") * F.lit(0.9)).alias("top"))
    kept = stars.star_quality_filter(statistics.with_group_values(df, K, tops), K, F.col("top"))
    return kept.select(*K, "star_id")


@query("edge_margin", f"""
select frame_id, star_id from stars where peak > 0 and x between {W} * 0.1::double and {W} - 1 - {W} * 0.1::double and y between {H} * 0.1::double and {H} - 1 - {H} * 0.1::double
""", ("stars",))
def _edge_margin(spark, d):
    df = views.stars(spark, d)
    return df.filter((F.col("peak") > 0) & geometry.edge_margin("x", "y", W, H, 0.1)).select(*K, "star_id")


@query("top_k_per_group", """
select frame_id, star_id, rn from (select *, row_number() over (partition by frame_id order by peak desc, y, x, star_id) as rn from stars) where rn <= 50
""", ("stars",))
def _top_k_per_group(spark, d):
    order = [F.col("peak").desc(), F.col("y"), F.col("x"), F.col("star_id")]
    top = ordering.top_k_per_group(views.stars(spark, d), K, order, 50)
    return top.select(*K, "star_id", F.col("rn").cast("bigint").alias("rn"))


@query("isolated_points", """
select a.frame_id, a.star_id from stars a where not exists (select 1 from stars b where b.frame_id = a.frame_id
 and (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) <= 1600 and (b.peak > a.peak or (b.peak = a.peak and (b.y < a.y or (b.y = a.y and (b.x < a.x or (b.x = a.x and b.star_id < a.star_id)))))))
""", ("stars",))
def _isolated_points(spark, d):
    return stars.isolated_points(views.stars(spark, d), K, "star_id", 40.0, sizes=views.star_sizes(spark, d))


def greedy_sql(rows: str, test: str) -> str:
    """Brightest first, frame by frame: a star joins the list unless the squared distance to one of it meets `test`."""
    squared = "((k.x - s[1].x) * (k.x - s[1].x) + (k.y - s[1].y) * (k.y - s[1].y))"
    return f"""
with l as (select frame_id, list([{{'id': star_id, 'x': x, 'y': y}}] order by peak desc, y, x, star_id) as ranked from {rows} group by 1),
g as (select frame_id, list_reduce(ranked, lambda a, s: case when len(list_filter(a, lambda k: {squared} {test})) > 0 then a else list_concat(a, s) end) as kept from l)
"""


@query("thin_by_distance", greedy_sql("stars", "<= 1600") + "select frame_id, unnest(list_transform(kept, lambda k: k.id)) as star_id from g", ("stars",))
def _thin_by_distance(spark, d):
    return stars.thin_by_distance(views.stars(spark, d), K, "star_id", 40.0, sizes=views.star_sizes(spark, d))


def alignment_gap() -> float:
    return stars.alignment_separation(W, H)


INNER_STARS = f"""(select * from stars where peak > 0 and x between {W} * 0.1::double and {W} - 1 - {W} * 0.1::double
 and y between {H} * 0.1::double and {H} - 1 - {H} * 0.1::double)"""


@query("top_k_separated", greedy_sql(INNER_STARS, f"< {alignment_gap() ** 2!r}::double") + """
select frame_id, kept[position].id as star_id, position from (select frame_id, kept, unnest(range(1, least(len(kept), 160) + 1)) as position from g)
""", ("stars",))
def _top_k_separated(spark, d):
    df = views.stars(spark, d)
    inner = df.filter((F.col("peak") > 0) & geometry.edge_margin("x", "y", W, H, 0.1))
    picked = stars.top_k_separated(inner, K, "star_id", 160, alignment_gap(), sizes=views.star_sizes(spark, d))
    return picked.select(*K, "star_id", F.col("position").cast("bigint").alias("position"))


@query("best_per_cell", f"""
with i as (select *, least(floor((y - {H * 0.16!r}::double) / {(H - 2 * H * 0.16) / 6!r}::double), 5)::bigint as cell_y, least(floor((x - {W * 0.16!r}::double) / {(W - 2 * W * 0.16) / 6!r}::double), 5)::bigint as cell_x
 from stars where x between {W * 0.16!r}::double and {W - 1 - W * 0.16!r}::double and y between {H * 0.16!r}::double and {H - 1 - H * 0.16!r}::double)
select frame_id, cell_y, cell_x, star_id, x, y, peak from (select *, row_number() over (partition by frame_id, cell_y, cell_x order by peak desc, y, x, star_id) as rn from i) where rn = 1
""", ("stars",))
def _best_per_cell(spark, d):
    return stars.best_per_cell(views.stars(spark, d), K, W, H, 6)


@query("anchor_points")
def _anchor_points(spark, d):
    return stars.anchor_points(views.stars(spark, d), "frame_id", "star_id", W, H)


@query("clamp", """
select frame_id, star_id, least(greatest(x, 100), 1500) as clamped, round(sqrt((x - 1000) * (x - 1000) + (y - 750) * (y - 750)), 9) as off_center from stars
""", ("stars",))
def _clamp(spark, d):
    off = geometry.distance("x", "y", F.lit(1000.0), F.lit(750.0))
    return views.stars(spark, d).select(
        *K, "star_id", geometry.clamp("x", 100.0, 1500.0).alias("clamped"), F.round(off, 9).alias("off_center")
    )


@query("rotate_point", f"""
select frame_id, star_id, {W} - 1 - x as rx, {H} - 1 - y as ry, 1 - x / {W}::double as ux, 1 - y / {H}::double as uy from stars
""", ("stars",))
def _rotate_point(spark, d):
    rx, ry = geometry.rotate_point("x", "y", W, H)
    ux, uy = geometry.rotate_unit_point(F.col("x") / F.lit(float(W)), F.col("y") / F.lit(float(H)))
    return views.stars(spark, d).select(*K, "star_id", rx.alias("rx"), ry.alias("ry"), ux.alias("ux"), uy.alias("uy"))


@query("shift_point", f"""
select frame_id, star_id, x + 700 as sx, y - 300 as sy from stars where x + 700 < {W} and y - 300 >= 0
""", ("stars",))
def _shift_point(spark, d):
    sx, sy, inside = geometry.shift_point("x", "y", 700, -300, W, H)
    return views.stars(spark, d).filter(inside).select(*K, "star_id", sx.alias("sx"), sy.alias("sy"))


GW, GH = stars.grid_size(W, H, 12)
SMOOTH = f"""sm as (select frame_id, gy, gx, sum(w * fwhm) / sum(w) as value from (select frame_id, gy::int as gy, gx::int as gx, fwhm,
 exp(-((x - (gx + 0.5::double) * {W / GW!r}::double) ** 2 + (y - (gy + 0.5::double) * {H / GH!r}::double) ** 2) / {2 * (math.hypot(W, H) / 6) ** 2!r}::double) as w
 from stars, range(0, {GH}) a(gy), range(0, {GW}) b(gx) where fwhm > 0) group by 1, 2, 3)"""


@query("grid_kernel_join", f"""
select frame_id, gy::int as gy, gx::int as gx, round(sum(w), 7) as w, round(sum(w * fwhm), 7) as wv from (select frame_id, gy, gx, fwhm,
 exp(-((x - (gx + 0.5::double) * {W / GW!r}::double) ** 2 + (y - (gy + 0.5::double) * {H / GH!r}::double) ** 2) / {2 * (math.hypot(W, H) / 6) ** 2!r}::double) as w
 from stars, range(0, {GH}) a(gy), range(0, {GW}) b(gx) where fwhm > 0) group by 1, 2, 3
""", ("stars",))
def _grid_kernel_join(spark, d):
    return rounded(stars.grid_kernel_join(views.stars(spark, d), K, "fwhm", W, H, 12), "w", "wv", digits=7)


@query("kernel_smooth", f"with {SMOOTH} select frame_id, gy, gx, round(value, 8) as value from sm", ("stars",))
def _kernel_smooth(spark, d):
    return rounded(stars.kernel_smooth(views.stars(spark, d), K, "fwhm", W, H, 12), "value", digits=8)


@query("curvature_stats", f"""
with {SMOOTH}, b as (select frame_id, min(fwhm) as min, max(fwhm) as max, avg(fwhm) as mean, count(*) as used from stars where fwhm > 0 group by 1),
r as (select frame_id, fwhm, row_number() over (partition by frame_id order by fwhm) as rn, count(*) over (partition by frame_id) as n from stars where fwhm > 0),
p as (select frame_id, max(case when rn = cast(round_even(0.02::double * (n - 1), 0) as bigint) + 1 then fwhm end) p2, max(case when rn = cast(round_even(0.98::double * (n - 1), 0) as bigint) + 1 then fwhm end) p98 from r group by 1),
g as (select *, abs((gx + 0.5::double) / {GW} - 0.5::double) * 2 as rx, abs((gy + 0.5::double) / {GH} - 0.5::double) * 2 as ry from sm),
w as (select *, greatest(0, least(rx, ry) - 0.6::double) / 0.4::double as cw, greatest(0, 1 - sqrt(rx * rx + ry * ry) / 0.3::double) as mw from g where value > 0),
s as (select frame_id, sum(cw * value) / sum(cw) as corner, sum(mw * value) / sum(mw) as center from w group by 1)
select frame_id, min, max, round(mean, 6) as mean, used, case when p98 - p2 < 1e-6 then min else p2 end as ramp_min, case when p98 - p2 < 1e-6 then max else p98 end as ramp_max,
 round((corner - center) / center * 100, 6) as curvature from b join p using (frame_id) join s using (frame_id)
""", ("stars",))
def _curvature_stats(spark, d):
    df = views.stars(spark, d)
    grid = stars.kernel_smooth(df, K, "fwhm", W, H, 12)
    return rounded(rounded(stars.curvature_stats(df, grid, K, "fwhm", GW, GH), "mean", digits=6), "curvature", digits=6)


@query("max_gap", """
select frame_id, coalesce(max(gap), 0)::double as max_gap from (select frame_id, y - lag(y) over (partition by frame_id order by y) as gap from stars) group by 1
""", ("stars",))
def _max_gap(spark, d):
    return statistics.max_gap(views.stars(spark, d), K, "y")


TOP = "tp as (select *, row_number() over (partition by frame_id order by peak desc, y, x, star_id) - 1 as rn from stars qualify rn < 8)"
TRIANGLES = f"""{TOP}, tr as (select i.frame_id, i.rn as i, j.rn as j, k.rn as k, sqrt((i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y)) as d1,
 sqrt((i.x - k.x) * (i.x - k.x) + (i.y - k.y) * (i.y - k.y)) as d2, sqrt((j.x - k.x) * (j.x - k.x) + (j.y - k.y) * (j.y - k.y)) as d3,
 abs((j.x - i.x) * (k.y - i.y) - (j.y - i.y) * (k.x - i.x)) as a2
 from tp i join tp j on j.frame_id = i.frame_id and j.rn > i.rn join tp k on k.frame_id = i.frame_id and k.rn > j.rn),
so as (select *, list_sort([{{'d': d1, 'o': 0, 'v': k}}, {{'d': d2, 'o': 1, 'v': j}}, {{'d': d3, 'o': 2, 'v': i}}]) as s from tr),
tg as (select frame_id, s[1].v::int as a, s[2].v::int as b, s[3].v::int as c, s[1].d / s[3].d as ratio1, s[2].d / s[3].d as ratio2, a2 / (s[3].d * s[3].d) as area from so where s[3].d > 1e-6)"""


def triangles(spark, d, count=8):
    return stars.triangle_signatures(views.stars(spark, d), K, "star_id", count)


def full(sql):
    """The SQL over as many stars as the operator takes by itself."""
    return sql.replace("qualify rn < 8)", f"qualify rn < {stars.TRIANGLE_STARS})")


@query("triangle_signatures", f"with {TRIANGLES} select * from tg where area >= 0.05", ("stars",))
def _triangle_signatures(spark, d):
    return triangles(spark, d)


@query("triangle_signatures_full", full(f"with {TRIANGLES} select * from tg where area >= 0.05"), ("stars",))
def _triangle_signatures_full(spark, d):
    return triangles(spark, d, stars.TRIANGLE_STARS)


MATCH = f"""{TRIANGLES}, ref as (select * from tg where area >= 0.05 and frame_id = (select min(frame_id) from stars)), cd as (select * from tg where area >= 0.05),
mt as (select cd.frame_id, ref.a as r_a, ref.b as r_b, ref.c as r_c, cd.a, cd.b, cd.c, abs(ref.ratio1 - cd.ratio1) + abs(ref.ratio2 - cd.ratio2) + abs(ref.area - cd.area) as error
 from cd join ref on abs(ref.ratio1 - cd.ratio1) <= 0.02 and abs(ref.ratio2 - cd.ratio2) <= 0.02 and abs(ref.area - cd.area) <= 0.015),
bm as (select * from mt qualify row_number() over (partition by frame_id, r_a, r_b, r_c order by error, a, b, c) = 1)"""


@query("band_match", f"with {MATCH} select frame_id, r_a, r_b, r_c, a, b, c, round(error, 12) as error from bm", ("stars",))
def _band_match(spark, d):
    found = matches(spark, d)
    return found.withColumn("error", F.round("error", 12))


@query("band_match_full", full(f"with {MATCH} select frame_id, r_a, r_b, r_c, a, b, c, round(error, 12) as error from bm"), ("stars",))
def _band_match_full(spark, d):
    return matches(spark, d, stars.TRIANGLE_STARS).withColumn("error", F.round("error", 12))


def matches(spark, d, count=8):
    first = stars.triangle_signatures(of_first_frame(spark, d, views.stars(spark, d)), K, "star_id", count)
    return stars.band_match(first, triangles(spark, d, count), K)


def of_first_frame(spark, d, rows):
    """The rows of the smallest frame, found without forming stars or triangles."""
    return rows.filter(F.col("frame_id") == views.star_sizes(spark, d).agg(F.min("frame_id")).scalar())


VOTES = f"""
with {MATCH}, md as (select frame_id, median(fwhm) as scale from stars where fwhm > 0 group by 1), rs as (select tp.*, scale from tp join md using (frame_id)),
v as (select m.frame_id, r.x - c.x * least(greatest(r.scale / c.scale, 0.75::double), 1.25::double) as dx, r.y - c.y * least(greatest(r.scale / c.scale, 0.75::double), 1.25::double) as dy
 from (select frame_id, unnest([r_a, r_b, r_c]) as rp, unnest([a, b, c]) as cp from bm) m
 join rs r on r.frame_id = (select min(frame_id) from stars) and r.rn = m.rp join rs c on c.frame_id = m.frame_id and c.rn = m.cp),
l as (select frame_id, list_sort(list(dx)) as lx, list_sort(list(dy)) as ly from v group by 1),
p as (select frame_id, lx[len(lx) // 2 + 1] as mx, ly[len(ly) // 2 + 1] as my from l)
select frame_id, round_even(any_value(mx), 0)::int as dx, round_even(any_value(my), 0)::int as dy, round(count_if((dx - mx) * (dx - mx) + (dy - my) * (dy - my) <= 64) / count(*)::double, 9) as score
from v join p using (frame_id) group by 1
"""


@query("triangle_votes", VOTES, ("stars",))
def _triangle_votes(spark, d):
    return votes(spark, d, 8)


@query("triangle_votes_full", full(VOTES), ("stars",))
def _triangle_votes_full(spark, d):
    return votes(spark, d, stars.TRIANGLE_STARS)


def votes(spark, d, count):
    df = views.stars(spark, d)
    order = [F.col("peak").desc(), F.col("y"), F.col("x"), F.col("star_id")]
    top = ordering.top_k_per_group(df, K, order, count, "position").withColumn("position", F.col("position") - 1)
    scaled = statistics.with_group_values(top, K, statistics.median_metric(df, K).withColumnRenamed("median", "scale"))
    first = of_first_frame(spark, d, scaled)
    return rounded(stars.triangle_votes(matches(spark, d, count), first, scaled, K), "score")


SIGMA64 = max(1.5, 64 * 0.015)
DENSITY = f"""dn as (select frame_id, y, x, v - avg(v) over (partition by frame_id) as v from (
 select g.frame_id, g.y::int as y, g.x::int as x, coalesce(sum(case when (g.x - s.cx) ** 2 + (g.y - s.cy) ** 2 <= 16 and g.x between floor(s.cx) - 4 and ceil(s.cx) + 4 and g.y between floor(s.cy) - 4 and ceil(s.cy) + 4
  then ln(1 + s.peak) * exp(-((g.x - s.cx) ** 2 + (g.y - s.cy) ** 2) / {2 * SIGMA64**2!r}::double) end), 0) as v
 from (select frame_id, y, x from (select distinct frame_id from st), range(0, 64) a(y), range(0, 64) b(x)) g
 left join (select *, x * {63 / (W - 1)!r}::double as cx, y * {63 / (H - 1)!r}::double as cy from st) s on s.frame_id = g.frame_id and s.cx between g.x - 5 and g.x + 5 and s.cy between g.y - 5 and g.y + 5 group by 1, 2, 3))"""


@query("density_map", f"with st as (select * from stars), {DENSITY} select frame_id, y, x, round(v, 7) as v from dn", ("stars",))
def _density_map(spark, d):
    return rounded(alignment.density_map(views.stars(spark, d), K, W, H, 64, sizes=views.star_sizes(spark, d)), "v", digits=7)


# near-collinear points: stars folded onto a band
BAND = "bd as (select frame_id, star_id, x, 400 + x * 0.3::double + (star_id % 5) * 0.4::double + case when star_id % 11 = 0 then y * 0.3::double else 0 end as y, n * 20.0::double + 10 as signal from stars)"
CX, CY = (W - 1) / 2, (H - 1) / 2
REACH, RHO = math.sqrt(CX * CX + CY * CY), max(2.0, min(5.0, min(W, H) / 180))
LINES = f"""{BAND}, an as (select a, cos(a / 180.0::double * {math.pi!r}::double) as c, sin(a / 180.0::double * {math.pi!r}::double) as s from range(0, 180) t(a)),
vt as (select frame_id, a::int as angle, round_even(((x - {CX}) * c + (y - {CY}) * s + {REACH!r}::double) / {RHO!r}::double, 0)::int as rho,
 sum(1 + least(greatest(round_even(signal / 30.0::double, 0), 0), 3))::bigint as votes from bd, an group by 1, 2, 3),
bl as (select * from vt qualify row_number() over (partition by frame_id order by votes desc, angle, rho) = 1),
ln as (select bl.*, cos(angle / 180.0::double * {math.pi!r}::double) as nx, sin(angle / 180.0::double * {math.pi!r}::double) as ny, rho * {RHO!r}::double - {REACH!r}::double as rv, points
 from bl join (select frame_id, count(*) as points from bd group by 1) using (frame_id) where votes >= greatest(20, points // 20))"""


def band(spark, d):
    df = views.stars(spark, d)
    y = F.lit(400.0) + F.col("x") * F.lit(0.3) + (F.col("star_id") % 5) * F.lit(0.4)
    y = y + F.when(F.col("star_id") % 11 == 0, F.col("y") * F.lit(0.3)).otherwise(F.lit(0.0))
    return df.select(*K, "star_id", "x", y.alias("y"), (F.col("n") * F.lit(20.0) + 10).alias("signal"))


@query("line_votes", f"with {LINES} select frame_id, angle, rho, votes, points from ln", ("stars",))
def _line_votes(spark, d):
    return votes_of_lines(spark, d, band(spark, d)).select(*K, "angle", "rho", "votes", "points")


def votes_of_lines(spark, d, points):
    return trail.line_votes(points, K, F.lit(10.0), W, H, sizes=views.star_sizes(spark, d))


AXES = f"""{LINES}, nr as (select bd.frame_id, x - {CX} as dx, y - {CY} as dy from bd join ln using (frame_id) where abs((x - {CX}) * nx + (y - {CY}) * ny - rv) <= greatest(2.5, {RHO * 1.2!r}::double)),
ms as (select frame_id, count(*) as inliers, avg(dx) as mx, avg(dy) as my, var_pop(dx) as xx, var_pop(dy) as yy, covar_pop(dx, dy) as xy from nr group by 1 having count(*) >= 10),
eg as (select *, (xx + yy) / 2 + sqrt(greatest(0, (xx + yy) * (xx + yy) / 4 - (xx * yy - xy * xy))) as l1, (xx + yy) / 2 - sqrt(greatest(0, (xx + yy) * (xx + yy) / 4 - (xx * yy - xy * xy))) as l2 from ms),
ax as (select *, (l1 - yy) / sqrt((l1 - yy) * (l1 - yy) + xy * xy) as ex, xy / sqrt((l1 - yy) * (l1 - yy) + xy * xy) as ey from eg where l2 >= 1e-9 and l1 / l2 >= 7)"""


@query("principal_axis", f"with {AXES} select frame_id, inliers, round(ex, 8) as ex, round(ey, 8) as ey, round(mx * -ey + my * ex, 5) as rho, round(l1 / l2, 2) as elongation from ax", ("stars",))
def _principal_axis(spark, d):
    points = band(spark, d)
    axes = trail.principal_axis(points, votes_of_lines(spark, d, points), K, W, H, sizes=views.star_sizes(spark, d))
    found = rounded(rounded(axes, "ex", "ey", digits=8), "rho", digits=5)
    return found.select(*K, "inliers", "ex", "ey", "rho", F.round("elongation", 2).alias("elongation"))


SPAN = max(4.0, min(W, H) / 90)


@query("trail_gates_score", f"""
with {AXES}, tt as (select bd.frame_id, abs((x - {CX}) * -ey + (y - {CY}) * ex - (mx * -ey + my * ex)) as off, (x - {CX}) * ex + (y - {CY}) * ey as t, ex, ey, mx * -ey + my * ex as rho, l1 / l2 as el from bd join ax using (frame_id)),
ii as (select *, t - lag(t) over (partition by frame_id order by t) as gap from tt where off <= greatest(2.0, {RHO * 0.7!r}::double)),
sg as (select frame_id, count(*) as n, min(t) as t1, max(t) as t2, max(t) - min(t) as span, max(gap) as gap, sqrt(sum(off * off) / count(*)) as rms, count(distinct floor(t / {SPAN!r}::double)) as bins,
 any_value(ex) as ex, any_value(ey) as ey, any_value(rho) as rho, any_value(el) as el from ii group by 1),
cv as (select *, bins / greatest(1, ceil(span / {SPAN!r}::double)) as cov from sg),
sc as (select *, 0.25::double * least(greatest((el - 7) / 93, 0), 1) + 0.25::double * least(greatest((span / {min(W, H)} - 0.2::double) / 0.7::double, 0), 1) + 0.2::double * least(greatest((cov - 0.2::double) / 0.7::double, 0), 1)
 + 0.15::double * least(greatest(1 - gap / span / 0.35::double, 0), 1) + 0.15::double * least(greatest(1 - rms / 2, 0), 1) as raw
 from cv where n >= 10 and span >= 0.2::double * {min(W, H)} and cov >= 0.2 and gap <= 0.35::double * span and rms <= 2 and n >= span / ({SPAN!r}::double * 2))
select frame_id, greatest(1, round_even(raw * 100, 0)::int) as confidence, round(least(greatest(({CX} - rho * ey + t1 * ex) / {W - 1}, 0), 1), 7) as x1, round(least(greatest(({CY} + rho * ex + t1 * ey) / {H - 1}, 0), 1), 7) as y1,
 round(least(greatest(({CX} - rho * ey + t2 * ex) / {W - 1}, 0), 1), 7) as x2, round(least(greatest(({CY} + rho * ex + t2 * ey) / {H - 1}, 0), 1), 7) as y2 from sc
""", ("stars",))
def _trail_gates_score(spark, d):
    points = band(spark, d)
    axes = trail.principal_axis(points, votes_of_lines(spark, d, points), K, W, H, sizes=views.star_sizes(spark, d))
    return rounded(trail.trail_gates_score(points, axes, K, W, H, sizes=views.star_sizes(spark, d)), "x1", "y1", "x2", "y2", digits=7)
