"""Queries over the `pixels` view: 8x8 rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightsieve.catalog import views
from nightsieve.catalog.registry import query
from nightsieve.functions import geometry, tone
from nightsieve.operators import alignment, detection, ordering, raster, stars, statistics, trail

K = ["frame_id"]
S = views.RASTER_SIDE


def rounded(df, *columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("extrema_with_counts", """
select frame_id, min(v) as min, max(v) as max, count_if(v = lo)::bigint as min_count, count_if(v = hi)::bigint as max_count
from (select *, min(v) over (partition by frame_id) lo, max(v) over (partition by frame_id) hi from (select frame_id, round(v, 1) as v from pixels)) group by 1
""", ("pixels",))
def _extrema_with_counts(spark, d):
    df = views.pixels(spark, d).withColumn("v", F.round("v", 1))
    return statistics.extrema_with_counts(df, K, "v")


def _rank_sql(share: float) -> str:
    return f"max(case when rn = cast(round_even({share}::double * (n - 1), 0) as bigint) + 1 then v end)"


RANKS = "r as (select frame_id, v, row_number() over (partition by frame_id order by v) as rn, count(*) over (partition by frame_id) as n from pixels)"


@query("nearest_rank_percentile", f"""
with {RANKS} select frame_id, {_rank_sql(0.5)} as p50, {_rank_sql(0.02)} as p2, {_rank_sql(0.35)} as p35, {_rank_sql(0.997)} as p997 from r group by 1
""", ("pixels",))
def _nearest_rank_percentile(spark, d):
    shares = {"p50": 0.5, "p2": 0.02, "p35": 0.35, "p997": 0.997}
    return statistics.nearest_rank_percentile(views.pixels(spark, d), K, "v", shares)


MAD = f"""{RANKS}, med as (select frame_id, {_rank_sql(0.5)} as median from r group by 1),
dv as (select frame_id, median, abs(p.v - median) as v from pixels p join med using (frame_id)),
dr as (select *, row_number() over (partition by frame_id order by v) as rn, count(*) over (partition by frame_id) as n from dv),
mads as (select frame_id, max(median) as median, {_rank_sql(0.5)} as mad from dr group by 1)"""


@query("mad", f"with {MAD} select * from mads", ("pixels",))
def _mad(spark, d):
    return statistics.mad(views.pixels(spark, d), K, "v")


@query("rms_about", "select frame_id, round(sqrt(avg((v - 0.1::double) * (v - 0.1::double))), 9) as rms from pixels group by 1", ("pixels",))
def _rms_about(spark, d):
    return rounded(statistics.rms_about(views.pixels(spark, d), K, "v", F.lit(0.1)), "rms")


@query("stride_sample", """
with i as (select distinct cast(floor(i * (64 / 40.0::double)) as int) as pos from range(0, 40) t(i))
select frame_id, y, x, v from pixels join i on pos = y * 8 + x
""", ("pixels",))
def _stride_sample(spark, d):
    return statistics.stride_sample(views.pixels(spark, d), F.col("y") * S + F.col("x"), S * S, cap=40)


@query("correlation", """
select frame_id, case when count(*) * var_pop(v) <= 1e-20 then -1 else round(corr(v, (y * 3 + x)::double), 9) end as correlation from pixels group by 1
""", ("pixels",))
def _correlation(spark, d):
    df = views.pixels(spark, d).withColumn("w", (F.col("y") * 3 + F.col("x")).cast("double"))
    return rounded(statistics.correlation(df, K, "v", "w"), "correlation")


FLUX = """fx as (select frame_id, y, x, sqrt((x - 3.5::double) * (x - 3.5::double) + (y - 3.5::double) * (y - 3.5::double)) as r,
 floor((v + 20) * 1000)::double as flux from pixels)"""


def flux(spark, d):
    dx, dy = F.col("x") - F.lit(3.5), F.col("y") - F.lit(3.5)
    return views.pixels(spark, d).select(
        *K, "y", "x", F.sqrt(dx * dx + dy * dy).alias("r"),
        F.floor((F.col("v") + 20) * 1000).cast("double").alias("flux"),
    )


@query("half_flux_radius", f"""
with {FLUX}, c as (select frame_id, r, sum(flux) over (partition by frame_id order by r) as run, sum(flux) over (partition by frame_id) as total from fx)
select frame_id, min(r) as hfr from c where run >= total * 0.5::double group by 1
""", ("pixels",))
def _half_flux_radius(spark, d):
    return statistics.half_flux_radius(flux(spark, d), K, "r", "flux")


@query("centroid_moments", f"""
with {FLUX}, s as (select frame_id, count(*) n, sum(flux) f, sum(flux * (x - 3)) / sum(flux) mx, sum(flux * (y - 3)) / sum(flux) my,
 sum(flux * (x - 3) * (x - 3)) / sum(flux) xx, sum(flux * (y - 3) * (y - 3)) / sum(flux) yy, sum(flux * (x - 3) * (y - 3)) / sum(flux) xy from fx group by 1),
m as (select frame_id, mx, my, xx - mx * mx as cxx, yy - my * my as cyy, xy - mx * my as cxy from s),
e as (select *, greatest(1e-6, (cxx + cyy + sqrt(greatest(0, (cxx + cyy) * (cxx + cyy) - 4 * (cxx * cyy - cxy * cxy)))) / 2) as l1,
 greatest(1e-6, (cxx + cyy - sqrt(greatest(0, (cxx + cyy) * (cxx + cyy) - 4 * (cxx * cyy - cxy * cxy)))) / 2) as l2 from m)
select frame_id, round(mx, 6) as cx, round(my, 6) as cy, round(l1, 6) as lambda1, round(l2, 6) as lambda2, round(sqrt(greatest(0, 1 - l2 / l1)), 5) as ecc from e
""", ("pixels",))
def _centroid_moments(spark, d):
    shape = stars.centroid_moments(flux(spark, d), K, F.col("x") - 3, F.col("y") - 3, "flux")
    return rounded(rounded(shape, "cx", "cy", "lambda1", "lambda2", digits=6), "ecc", digits=5)


STAR = """st as (select frame_id, y, x, sqrt((x - 3.4::double) * (x - 3.4::double) + (y - 3.6::double) * (y - 3.6::double)) as r, v,
 0.9::double + (frame_id % 7) * 0.25::double as sg from pixels),
sx as (select frame_id, y, x, r, 1000.0::double * exp(-r * r / (2.0::double * sg * sg)) * (1.0::double + v * 0.05::double) as flux from st)"""


def star_flux(spark, d):
    dx, dy = F.col("x") - F.lit(3.4), F.col("y") - F.lit(3.6)
    df = views.pixels(spark, d).withColumn("r", F.sqrt(dx * dx + dy * dy))
    sigma = F.lit(0.9) + (F.col("frame_id") % 7) * F.lit(0.25)
    glow = F.lit(1000.0) * F.exp(-F.col("r") * F.col("r") / (F.lit(2.0) * sigma * sigma))
    return df.select(*K, "y", "x", "r", (glow * (F.lit(1.0) + F.col("v") * F.lit(0.05))).alias("flux"))


@query("gaussian_fwhm", f"""
with {STAR}, o as (select *, row_number() over (partition by frame_id order by r, y, x) as rn from sx),
p as (select frame_id, list_sort(list(flux) filter (rn <= 3))[2] as peak from o group by 1),
u as (select frame_id, r * r as a, ln(flux) as b, flux as w from sx join p using (frame_id) where flux > peak * 0.4::double and flux < peak * 1.05::double),
s as (select frame_id, count(*) k, sum(w) sw, sum(w * a) swx, sum(w * b) swy, sum(w * a * a) swxx, sum(w * a * b) swxy, sum(w * b * b) swyy from u group by 1),
f as (select *, sw * swxx - swx * swx as den, (sw * swxy - swx * swy) / (sw * swxx - swx * swx) as slope from s),
g as (select *, swyy - slope * swxy - (swy / sw - slope * (swx / sw)) * swy as sse, swyy - swy / sw * swy as sst from f),
h as (select frame_id, case when k >= 5 and abs(den) >= 1e-12 and slope < 0 and sst > 0 and 1 - sse / sst >= 0.75 and sqrt(-1 / (2 * slope)) between 0.4 and 6.0
 then 2.3548200450309493::double * sqrt(-1 / (2 * slope)) else 0 end as fwhm from g)
select p.frame_id, coalesce(round(fwhm, 6), 0)::double as fwhm from p left join h using (frame_id)
""", ("pixels",))
def _gaussian_fwhm(spark, d):
    return rounded(stars.gaussian_fwhm(star_flux(spark, d), K, ties=["y", "x"]), "fwhm", digits=6)


@query("halfmax_fwhm", f"""
with {STAR}, o as (select *, row_number() over (partition by frame_id order by r, y, x) as rn from sx),
p as (select frame_id, avg(flux) filter (rn <= 4) as peak from o group by 1),
b as (select frame_id, cast(floor(r / 0.3::double) as int) as bin, avg(flux) as m from sx group by 1, 2),
l as (select *, (bin + 0.5::double) * 0.3::double as radius, lag(m) over (partition by frame_id order by bin) as pm, (lag(bin) over (partition by frame_id order by bin) + 0.5::double) * 0.3::double as pr from b),
c as (select frame_id, bin, 2 * greatest(0, coalesce(pr, 0) + (radius - coalesce(pr, 0)) * ((peak * 0.5::double - coalesce(pm, peak)) / greatest(1e-9, m - coalesce(pm, peak)))) as fwhm
 from l join p using (frame_id) where m <= peak * 0.5::double)
select p.frame_id, coalesce(round(w, 6), 0)::double as fwhm from p left join (select frame_id, arg_min(fwhm, bin) as w from c group by 1) using (frame_id)
""".replace("greatest(1e-9, m - coalesce(pm, peak))", "greatest(1e-9::double, m - coalesce(pm, peak))"), ("pixels",))
def _halfmax_fwhm(spark, d):
    return rounded(stars.halfmax_fwhm(star_flux(spark, d), K, ties=["y", "x"]), "fwhm", digits=6)


MTF = """case when {x} <= 0 then 0.0::double when {x} >= 1 then 1.0::double when abs((2.0::double * {m} - 1.0::double) * {x} - {m}) < 1e-9 then {x}
 else ({m} - 1.0::double) * {x} / ((2.0::double * {m} - 1.0::double) * {x} - {m}) end"""
INV = """case when {x} <= 0 then 0.0::double when {x} >= 1 then 1.0::double when abs({x} + {y} - 2.0::double * {x} * {y}) < 1e-9 then 0.5::double
 else {x} * (1.0::double - {y}) / ({x} + {y} - 2.0::double * {x} * {y}) end"""


@query("mtf", f"""
with c as (select *, least(greatest(v * 4 + 0.5::double, 0), 1) as a from pixels) select frame_id, y, x, {MTF.format(x='a', m='0.2::double')} as out from c
""", ("pixels",))
def _mtf(spark, d):
    df = views.pixels(spark, d)
    return df.select(*K, "y", "x", tone.mtf(F.col("v") * 4 + F.lit(0.5), 0.2).alias("out"))


@query("inverse_mtf", f"""
with c as (select *, least(greatest(v * 4 + 0.5::double, 0), 1) as a from pixels) select frame_id, y, x, {INV.format(x='a', y='0.25::double')} as out from c
""", ("pixels",))
def _inverse_mtf(spark, d):
    df = views.pixels(spark, d)
    return df.select(*K, "y", "x", tone.inverse_mtf(0.25, F.col("v") * 4 + F.lit(0.5)).alias("out"))


@query("stretch", f"""
with c as (select *, least(greatest((v * 100 + 50) / 255.0::double - 0.1::double, 0) / (0.9::double - 0.1::double), 1) as a from pixels)
select frame_id, y, x, cast(floor({MTF.format(x='a', m='0.3::double')} * 255.0::double + 0.5::double) as int) as byte from c
""", ("pixels",))
def _stretch(spark, d):
    raw = F.col("v") * 100 + 50
    return views.pixels(spark, d).select(*K, "y", "x", tone.stretch(raw, 255.0, 0.1, 0.3, 0.9).alias("byte"))


@query("auto_stretch", f"""
with {MAD}, c as (select frame_id, median, least(greatest(median + -2.8::double * (1.4826::double * mad), 0), 1) as shadows from mads),
n as (select *, least(greatest((median - shadows) / greatest(1e-9, 1 - shadows), 1e-9), 1 - 1e-9) as a from c)
select frame_id, shadows, {INV.format(x='a', y='0.25::double')} as midtones, 1.0::double as highlights from n
""", ("pixels",))
def _auto_stretch(spark, d):
    return statistics.auto_stretch(views.pixels(spark, d), K, "v", position=F.col("y") * S + F.col("x"), size=S * S)


@query("resample_coord", """
select frame_id, y, x, least(greatest((x + 0.5::double) * 5.0::double / 8.0::double - 0.5::double, 0), 4.0) as sx,
 least(greatest((y + 0.5::double) * 13.0::double / 8.0::double - 0.5::double, 0), 12.0) as sy from pixels
""", ("pixels",))
def _resample_coord(spark, d):
    return views.pixels(spark, d).select(
        *K, "y", "x", geometry.resample_coord("x", 5, 8).alias("sx"), geometry.resample_coord("y", 13, 8).alias("sy")
    )


def _ramp_sql(i: int) -> str:
    parts = [f"when t <= {tone.RAMP[0][0]} then round_even({tone.RAMP[0][i]}::double * 255, 0)", f"when t >= {tone.RAMP[-1][0]} then round_even({tone.RAMP[-1][i]}::double * 255, 0)"]
    for a, b in zip(tone.RAMP, tone.RAMP[1:]):
        parts.append(f"when t <= {b[0]}::double then round_even(({a[i]}::double + ({b[i]}::double - {a[i]}::double) * ((t - {a[0]}::double) / ({b[0]}::double - {a[0]}::double))) * 255, 0)")
    return f"cast(case {' '.join(parts)} end as int)"


@query("piecewise_linear", f"""
with c as (select *, v * 4 + 0.5::double as t from pixels) select frame_id, y, x, {_ramp_sql(1)} as red, {_ramp_sql(2)} as green, {_ramp_sql(3)} as blue from c
""", ("pixels",))
def _piecewise_linear(spark, d):
    df = views.pixels(spark, d)
    return df.select(*K, "y", "x", *[c.alias(n) for n, c in tone.color_ramp(F.col("v") * 4 + F.lit(0.5)).items()])


@query("roi_crop", "select frame_id, y, x, v from pixels where x between 2 and 4 and y between 3 and 5", ("pixels",))
def _roi_crop(spark, d):
    # a 4 x 3 rectangle from (2, 3), cut to a 3 x 3 square
    return raster.roi_crop(views.pixels(spark, d), 0.3, 0.4, 0.5, 0.4, S, S)


@query("local_window_stats", """
with b as (select frame_id, arg_max(y * 8 + x, (v, -y, -x)) as pos from pixels group by 1),
p as (select frame_id, pos // 8 as py, pos % 8 as px, least(greatest(pos // 8 - 1, 0), 5) as y0, least(greatest(pos % 8 - 1, 0), 5) as x0 from b)
select p.frame_id, p.frame_id as point_id, max(case when x = px and y = py then v end) as center, min(v) as min, max(v) as max, round(avg(v), 9) as mean
from p join pixels q on q.frame_id = p.frame_id and x between x0 and x0 + 2 and y between y0 and y0 + 2 group by 1
""", ("pixels",))
def _local_window_stats(spark, d):
    df = views.pixels(spark, d)
    best = ordering.argmax(df, K, "v")
    points = best.select(*K, F.col("frame_id").alias("point_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    return rounded(raster.local_window_stats(df, points, K, S, S, 3), "mean")


@query("argmax", """
select frame_id, a // 8 as y, a % 8 as x, score from (select frame_id, arg_max(y * 8 + x, (round(v, 1), -y, -x)) as a, max(round(v, 1)) as score from pixels group by 1)
""", ("pixels",))
def _argmax(spark, d):
    return ordering.argmax(views.pixels(spark, d).withColumn("score", F.round("v", 1)), K, "score")


@query("luminance", """
select frame_id // 3 as frame_id, y, x, round(case when count(*) = 1 then max(v) filter (frame_id % 3 = 0) else
 0.2126::double * max(v) filter (frame_id % 3 = 0) + 0.7152::double * max(v) filter (frame_id % 3 = 1)
 + 0.0722::double * coalesce(max(v) filter (frame_id % 3 = 2), max(v) filter (frame_id % 3 = 1)) end, 12) as v from pixels group by 1, 2, 3
""", ("pixels",))
def _luminance(spark, d):
    df = views.pixels(spark, d)
    planes = df.select(F.floor(F.col("frame_id") / 3).alias("frame_id"), (F.col("frame_id") % 3).alias("channel"), "y", "x", "v")
    return rounded(raster.luminance_planes(planes, K), "v", digits=12)


def _at(dy: int, dx: int) -> str:
    return f"g[least(greatest(y + {dy}, 0), 7) * 8 + least(greatest(x + {dx}, 0), 7) + 1]"


GRID = "gr as (select frame_id, list(v order by y, x) as g from pixels group by 1), c as (select p.*, g from pixels p join gr using (frame_id))"
H = f"({_at(0, -1)} + {_at(0, 1)})"
V = f"({_at(-1, 0)} + {_at(1, 0)})"
DIAG = f"({_at(-1, -1)} + {_at(-1, 1)} + {_at(1, -1)} + {_at(1, 1)})"


@query("mosaic_interpolate", f"""
with {GRID}, k as (select *, case frame_id % 4 when 0 then 'RGGB' when 1 then 'BGGR' when 2 then 'GRBG' else 'GBRG' end as pat, (y + 1) % 2 as cr, x % 2 as cc from c),
s as (select *, pat[cr * 2 + cc + 1] as site from k)
select frame_id, y, x,
 round(case site when 'R' then v when 'B' then {DIAG} * 0.25::double else case when cr = 0 then {H} else {V} end * 0.5::double end, 12) as red,
 round(case site when 'G' then v else ({H} + {V}) * 0.25::double end, 12) as green,
 round(case site when 'B' then v when 'R' then {DIAG} * 0.25::double else case when cr = 0 then {V} else {H} end * 0.5::double end, 12) as blue from s
""", ("pixels",))
def _mosaic_interpolate(spark, d):
    pattern = F.expr("case frame_id % 4 when 0 then ' rggb' when 1 then '\"BGGR\"' when 2 then 'GRBG' else 'gbrg' end")
    df = views.pixels(spark, d).withColumn("pattern", pattern)
    planes = raster.mosaic_interpolate(df, K, F.col("pattern"), S, S, 0, 1)
    return rounded(planes, "red", "green", "blue", digits=12)


@query("resample_nearest", """
select frame_id, ty as y, tx as x, v from pixels join range(0, 5) a(ty) on y = least(7, cast(round_even(ty / 4.0::double * 7, 0) as int))
 join range(0, 11) b(tx) on x = least(7, cast(round_even(tx / 10.0::double * 7, 0) as int))
""", ("pixels",))
def _resample_nearest(spark, d):
    return raster.resample_nearest(views.pixels(spark, d), K, S, S, 11, 5)


@query("resample_bilinear", f"""
with {GRID}, f as (select frame_id, any_value(g) as g from c group by 1),
t as (select frame_id, g, ty, tx, least(greatest((tx + 0.5::double) * 8 / 5.0::double - 0.5::double, 0), 7) as sx, least(greatest((ty + 0.5::double) * 8 / 11.0::double - 0.5::double, 0), 7) as sy
 from f, range(0, 11) a(ty), range(0, 5) b(tx)),
i as (select *, cast(floor(sx) as int) as x0, cast(floor(sy) as int) as y0 from t)
select frame_id, ty as y, tx as x, round((g[y0 * 8 + x0 + 1] * (1 - (sx - x0)) + g[y0 * 8 + least(x0 + 1, 7) + 1] * (sx - x0)) * (1 - (sy - y0))
 + (g[least(y0 + 1, 7) * 8 + x0 + 1] * (1 - (sx - x0)) + g[least(y0 + 1, 7) * 8 + least(x0 + 1, 7) + 1] * (sx - x0)) * (sy - y0), 9) as v from i
""", ("pixels",))
def _resample_bilinear(spark, d):
    return rounded(raster.resample_bilinear(views.pixels(spark, d), K, S, S, 5, 11), "v")


BLUR = "(" + " + ".join(_at(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3)) + ") / 25.0::double"


@query("box_blur", f"with {GRID} select frame_id, y, x, round({BLUR}, 9) as blur from c", ("pixels",))
def _box_blur(spark, d):
    return rounded(raster.box_blur(views.pixels(spark, d), K, 2, S, S), "blur").drop("v")


MEAN1 = "(" + " + ".join(_at(dy, dx) for dy in range(-1, 2) for dx in range(-1, 2)) + ") / 9.0::double"
SQ1 = "(" + " + ".join(f"{_at(dy, dx)} * {_at(dy, dx)}" for dy in range(-1, 2) for dx in range(-1, 2)) + ") / 9.0::double"


@query("local_variance", f"with {GRID} select frame_id, y, x, round(greatest({SQ1} - {MEAN1} * {MEAN1}, 0), 9) as variance from c", ("pixels",))
def _local_variance(spark, d):
    return rounded(raster.local_variance(views.pixels(spark, d), K, 1, S, S), "variance").drop("v")


NINE = ", ".join(_at(dy, dx) for dy in range(-1, 2) for dx in range(-1, 2))


@query("median3x3", f"""
with {GRID} select frame_id, y, x, v, case when x between 1 and 6 and y between 1 and 6 then list_sort([{NINE}])[5] else v end as median from c
""", ("pixels",))
def _median3x3(spark, d):
    return raster.median3x3(views.pixels(spark, d), K)


@query("neighbour_join", """
select p.frame_id, p.y, p.x, p.v, count(q.v) as neighbours, max(q.v) as top, min(q.v) as low
from pixels p join pixels q on q.frame_id = p.frame_id and abs(q.y - p.y) <= 1 and abs(q.x - p.x) <= 1 and (q.y <> p.y or q.x <> p.x) group by 1, 2, 3, 4
""", ("pixels",))
def _neighbour_join(spark, d):
    sides = F.array_compact(F.array(*[F.col(f"n{i}") for i in range(8)]))
    df = raster.neighbour_join(views.pixels(spark, d), K)
    return df.select(
        *K, "y", "x", "v", F.size(sides).cast("bigint").alias("neighbours"), F.array_max(sides).alias("top"),
        F.array_min(sides).alias("low"),
    )


@query("local_maxima", f"""
with {MAD.replace('from pixels', 'from q')}, {GRID.replace('pixels', 'q')}
select frame_id, y, x, v from c join mads using (frame_id)
where v >= median + 0.5::double * mad and x between 1 and 6 and y between 1 and 6
 and v >= {_at(0, -1)} and v > {_at(0, 1)} and v >= {_at(-1, 0)} and v > {_at(1, 0)}
 and v >= {_at(-1, -1)} and v > {_at(-1, 1)} and v >= {_at(1, -1)} and v > {_at(1, 1)}
 and {' + '.join(f"({_at(dy, dx)} >= median - 0.5::double * mad)::int" for dy, dx in raster.EIGHT)} >= 3
""".replace("with ", "with q as (select frame_id, y, x, round(v, 1) as v from pixels), ", 1), ("pixels",))
def _local_maxima(spark, d):
    df = views.pixels(spark, d).withColumn("v", F.round("v", 1))
    leveled = statistics.with_group_values(df, K, statistics.mad(df, K, "v"))
    level, support = F.col("median") + F.col("mad") * 0.5, F.col("median") - F.col("mad") * 0.5
    return raster.local_maxima(leveled, K, level, support, S, S).select(*K, "y", "x", "v")


def _support_sql(i: int) -> str:
    terms = [f"coalesce(sum(case when q.y - p.y = {dy} and q.x - p.x = {dx} then {w[i]}::double * q.v end), 0)" for dy, dx, w in raster.support_weights() if w[i]]
    return " + ".join(terms)


@query("directional_support", f"""
with s as (select p.frame_id, p.y, p.x, {_support_sql(0)} as horizontal, {_support_sql(1)} as vertical, {_support_sql(2)} as diagonal, {_support_sql(3)} as antidiagonal
 from pixels p join pixels q on q.frame_id = p.frame_id where p.y between 3 and 4 and p.x between 3 and 4 group by 1, 2, 3)
select frame_id, y, x, round(horizontal, 9) as horizontal, round(vertical, 9) as vertical, round(diagonal, 9) as diagonal, round(antidiagonal, 9) as antidiagonal,
 round(greatest(horizontal, vertical, diagonal, antidiagonal), 9) as best from s
""", ("pixels",))
def _directional_support(spark, d):
    df = views.pixels(spark, d)
    found = raster.directional_support(df, df.filter("y between 3 and 4 and x between 3 and 4"), K)
    return rounded(found.drop("second"), "horizontal", "vertical", "diagonal", "antidiagonal", "best")


@query("normalize_background", f"""
with q as (select frame_id, y, x, floor((v + 1) * 100)::double as v from pixels), {RANKS.replace('from pixels', 'from q')},
p as (select frame_id, {_rank_sql(0.35)} as p from r group by 1)
select frame_id, y, x, least(greatest(v + (round_even(0.25::double * 255, 0) - p), 0), 255) as v from q join p using (frame_id)
""", ("pixels",))
def _normalize_background(spark, d):
    df = views.pixels(spark, d).withColumn("v", F.floor((F.col("v") + 1) * 100).cast("double"))
    return statistics.normalize_background(df, K, "v", 0.25).select(*K, "y", "x", "v")


@query("shift_correlation", """
with r as (select embedding as e from embeddings order by vec_id limit 1), o as (select dx, dy from range(-4, 5) a(dx), range(-4, 5) b(dy)),
t as (select vec_id, dx, dy, y, x, r.e[y * 8 + x + 1]::double as a, embedding[(y - dy) * 8 + (x - dx) + 1]::double as b from embeddings, r, o, range(0, 8) p(y), range(0, 8) q(x)
 where x - dx between 0 and 7 and y - dy between 0 and 7),
c as (select vec_id, dx, dy, corr(a, b) as score from t group by 1, 2, 3)
select vec_id as frame_id, round(max(score), 9) as score, arg_max(dx, (round(score, 12), -dy, -dx))::int as dx, arg_max(dy, (round(score, 12), -dy, -dx))::int as dy from c group by 1
""")
def _shift_correlation(spark, d):
    maps = views.table(spark, d, "embeddings")
    first = maps.agg(F.min_by("embedding", "vec_id").alias("r")).scalar()
    found = alignment.shift_correlation(maps.withColumn("ref", first), "ref", "embedding", 4)
    return found.select(
        F.col("vec_id").alias("frame_id"), F.round("shift.score", 9).alias("score"), F.col("shift.dx").alias("dx"), F.col("shift.dy").alias("dy")
    )


POINTS = "pt as (select frame_id, pos // 8 as cy, pos % 8 as cx from (select frame_id, arg_max(y * 8 + x, (v, -y, -x)) as pos from pixels group by 1))"


@query("aperture_join", f"""
with {POINTS}, j as (select p.frame_id, y - cy as dy, x - cx as dx, v from pt p join pixels q on q.frame_id = p.frame_id)
select frame_id, dy, dx, v, abs(dy) <= 1 and abs(dx) <= 1 as in_box, dy * dy + dx * dx between 4 and 9 as in_ring from j
where (abs(dy) <= 1 and abs(dx) <= 1) or dy * dy + dx * dx between 4 and 9
""", ("pixels",))
def _aperture_join(spark, d):
    df = views.pixels(spark, d)
    points = ordering.argmax(df, K, "v").select(*K, F.lit(1).alias("star_id"), F.col("y").alias("cy"), F.col("x").alias("cx"))
    near = detection.aperture_join(df, points, K, "star_id", 1, 2, 3)
    return near.select(*K, "dy", "dx", "v", "in_box", "in_ring")


@query("measure_stars", f"""
with {STAR}, px as (select frame_id, y, x, flux + 100 as v from sx),
n as (select *, y - 4 as dy, x - 3 as dx, (y - 4) * (y - 4) + (x - 3) * (x - 3) as q from px),
bg as (select frame_id, case when count(*) filter (q between 9 and 16) >= 16 then median(v) filter (q between 9 and 16) else 100 end as bg from n group by 1),
s as (select n.frame_id, dy, dx, v - bg as s from n join bg using (frame_id) where abs(dy) <= 3 and abs(dx) <= 3 and v - bg > 0),
ct as (select frame_id, count(*) as np, sum(s) as f, sum(s * dx) / sum(s) as mx, sum(s * dy) / sum(s) as my from s group by 1),
r as (select s.*, np, f, mx, my, dx - mx as ax, dy - my as ay, sqrt((dx - mx) * (dx - mx) + (dy - my) * (dy - my)) as r from s join ct using (frame_id)),
o as (select *, row_number() over (partition by frame_id order by r, dy, dx) as rn, sum(s) over (partition by frame_id order by r, dy, dx rows unbounded preceding) as cum from r),
p as (select frame_id, list_sort(list(s) filter (rn <= 3))[2] as peak, min(r) filter (cum >= f * 0.5::double) as hfr, any_value(mx) as mx, any_value(my) as my, any_value(np) as np,
 sum(s * ax * ax) / any_value(f) as xx, sum(s * ay * ay) / any_value(f) as yy, sum(s * ax * ay) / any_value(f) as xy from o group by 1),
u as (select frame_id, r * r as a, ln(s) as b, s as w from r join p using (frame_id) where s > peak * 0.4::double and s < peak * 1.05::double),
t as (select frame_id, count(*) k, sum(w) sw, sum(w * a) swx, sum(w * b) swy, sum(w * a * a) swxx, sum(w * a * b) swxy, sum(w * b * b) swyy from u group by 1),
f as (select *, sw * swxx - swx * swx as den, (sw * swxy - swx * swy) / (sw * swxx - swx * swx) as slope from t),
g as (select *, swyy - slope * swxy - (swy / sw - slope * (swx / sw)) * swy as sse, swyy - swy / sw * swy as sst from f)
select frame_id, round(3 + mx, 5) as x, round(4 + my, 5) as y, round(2.3548200450309493::double * sqrt(-1 / (2 * slope)), 5) as fwhm, round(hfr, 5) as hfr,
 round(sqrt(greatest(0, 1 - greatest(1e-6, (xx + yy - sqrt(greatest(0, (xx + yy) * (xx + yy) - 4 * (xx * yy - xy * xy)))) / 2)
  / greatest(1e-6, (xx + yy + sqrt(greatest(0, (xx + yy) * (xx + yy) - 4 * (xx * yy - xy * xy)))) / 2))), 4) as ecc
from g join p using (frame_id) where np >= 6 and k >= 5 and abs(den) >= 1e-12 and slope < 0 and sst > 0 and 1 - sse / sst >= 0.75 and sqrt(-1 / (2 * slope)) between 0.4 and 6.0
""", ("pixels",))
def _measure_stars(spark, d):
    px = star_flux(spark, d).select(*K, "y", "x", (F.col("flux") + 100).alias("v"))
    points = px.select(*K).distinct().select(
        *K, F.lit(1).alias("star_id"), F.lit(3).alias("cx"), F.lit(4).alias("cy"), F.lit(1000.0).alias("peak"), F.lit(100.0).alias("background")
    )
    found = detection.measure_stars(px, points, K, radius=3, inner=3, outer=4)
    return rounded(rounded(found, "x", "y", "fwhm", "hfr", digits=5), "ecc", digits=4).select(*K, "x", "y", "fwhm", "hfr", "ecc")


@query("detect_stars")
def _detect_stars(spark, d):
    px, frames = views.mosaics(spark, d), views.mosaic_frames(spark, d)
    levels = detection.frame_levels(px, frames, K).select(*K, "background", "sigma", "width", "height")
    measured, _ = detection.detect_stars(px, levels, K)
    return measured


@query("frame_metrics")
def _frame_metrics(spark, d):
    return detection.frame_metrics(views.mosaics(spark, d), views.mosaic_frames(spark, d))


@query("detect_trail")
def _detect_trail(spark, d):
    return trail.detect_trail(views.mosaics(spark, d), views.mosaic_frames(spark, d), K)


@query("roi_center")
def _roi_center(spark, d):
    frames = views.mosaic_frames(spark, d)
    centers = alignment.roi_center(views.mosaics(spark, d), frames, K)
    return alignment.roi_rect(centers.join(frames, K))


@query("align_frames")
def _align_frames(spark, d):
    return alignment.align_frames(views.mosaics(spark, d), views.mosaic_frames(spark, d), "frame_id")
