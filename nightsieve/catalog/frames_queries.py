"""Queries over the `frames` view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightsieve.catalog import views
from nightsieve.catalog.registry import query
from nightsieve.functions import display, geometry, headers, keys
from nightsieve.operators import moves, ordering, scoring, sets, summary, thresholds, verdicts
from nightsieve.schema import Limits, limits_table

BASE = dict(
    max_fwhm=4.5, max_hfr=4.0, max_eccentricity=0.08, max_mean_background=400000.0, min_stars=2.0, min_sqm=19.0,
    max_sky_temp=30.0, min_trail=80,
)
STORED = {
    "": Limits.manual(**BASE),
    "automobile": Limits.manual(**{**BASE, "max_fwhm": 4.0, "max_hfr": 3.0}),
    "furniture": Limits(max_mean_background=123.0, auto_fwhm=False, auto_trail=False, min_trail=70),
}

views.CHECK_SQL["limits"] = """
select * from (values
  ('', 4.5::double, 4.0::double, 0.08::double, 400000.0::double, 2.0::double, 19.0::double, 30.0::double, 80),
  ('automobile', 4.0, 3.0, 0.08, 400000.0, 2.0, 19.0, 30.0, 80))
  t(group_key, max_fwhm, max_hfr, max_eccentricity, max_mean_background, min_stars, min_sqm, max_sky_temp, min_trail)
"""
MANUAL = {"": STORED[""], "automobile": STORED["automobile"]}

views.CHECK_SQL["judged"] = """
select f.*, lower(trim(filter_name)) as group_key, b.max_fwhm, b.max_hfr, b.max_eccentricity, b.max_mean_background,
  b.min_stars, b.min_sqm, b.max_sky_temp, b.min_trail,
  coalesce(f.fwhm > b.max_fwhm, false) as v_fwhm, coalesce(f.sqm < b.min_sqm, false) as v_sqm,
  coalesce(f.sky_temp > b.max_sky_temp, false) as v_sky_temp, coalesce(f.hfr > b.max_hfr, false) as v_hfr,
  coalesce(f.eccentricity > b.max_eccentricity, false) as v_eccentricity,
  coalesce(f.mean_background > b.max_mean_background, false) as v_mean_background,
  coalesce(f.star_count < b.min_stars, false) as v_stars,
  coalesce(b.min_trail > 0 and f.trail_confidence >= b.min_trail, false) as v_trail,
  (v_fwhm or v_sqm or v_sky_temp or v_hfr or v_eccentricity or v_mean_background or v_stars or v_trail) as auto_rejected,
  coalesce(manual_override, auto_rejected) as is_rejected
from frames f join limits b on b.group_key = case when lower(trim(filter_name)) = 'automobile' then 'automobile' else '' end
"""
JUDGED = ("frames", "limits", "judged")


def judged(spark: SparkSession, folder: str) -> DataFrame:
    df = thresholds.with_thresholds(views.frames(spark, folder), limits_table(spark, MANUAL))
    df = df.withColumn("auto_rejected", thresholds.threshold_predicate(thresholds.clauses_for(df)))
    return verdicts.override_state(df)


def sql_fixed(x: str, digits: int) -> str:
    p = 2 ** (digits + 1)
    return (
        f"printf('%.{digits}f', case when abs({x})::double * {p} = floor(abs({x})::double * {p}) "
        f"and (floor(abs({x})::double * {p}) % 2) = 1 then ({x})::double + sign({x}) * 1e-{digits + 3} else ({x})::double end)"
    )


MESSY = """case when frame_id % 3 = 0 then concat('  ', filter_name, ' ')
 when frame_id % 3 = 1 then lower(filter_name) when frame_id % 7 = 0 then null else filter_name end"""


def messy(spark: SparkSession, folder: str) -> DataFrame:
    return views.frames(spark, folder).withColumn("raw", F.expr(MESSY))


@query("normalize_key", f"""
select frame_id, coalesce(trim({MESSY}), '') as key, lower(coalesce(trim({MESSY}), '')) as group_key from frames
""", ("frames",))
def _normalize_key(spark, d):
    return messy(spark, d).select(
        "frame_id", keys.normalize_key("raw").alias("key"), keys.group_key("raw").alias("group_key")
    )


CATEGORY = """case upper(substr(ltrim(raw), 1, 1)) when 'H' then 'Ha' when 'O' then 'OIII' when 'S' then 'SII'
 when 'L' then 'Lum' when 'R' then 'Red' when 'G' then 'Green' when 'B' then 'Blue' else 'Unknown' end"""
DIM = """dim as (select * from (values ('Ha','Narrowband','Ha',0,'#E07A7A'),('OIII','Narrowband','OIII',1,'#6FD8D8'),
 ('SII','Narrowband','SII',2,'#E0C36F'),('Lum','LRGB','L',10,'#DDDDDD'),('Red','LRGB','R',11,'#FF7070'),
 ('Green','LRGB','G',12,'#7FE090'),('Blue','LRGB','B',13,'#8FB3FF'),('Unknown','Other',null,100,'#6D88C4'))
 t(category, filter_group, short, sort_order, border))"""


@query("classify_filter", f"""
with m as (select frame_id, {MESSY} as raw from frames) select frame_id, {CATEGORY} as category from m
""", ("frames",))
def _classify_filter(spark, d):
    return messy(spark, d).select("frame_id", keys.classify_filter("raw").alias("category"))


@query("filter_group", f"""
with m as (select frame_id, {MESSY} as raw from frames), {DIM}
select frame_id, d.filter_group, coalesce(d.short, coalesce(trim(raw), '')) as display, d.sort_order, d.border
from m join dim d on d.category = {CATEGORY}
""", ("frames",))
def _filter_group(spark, d):
    return messy(spark, d).select(
        "frame_id", keys.filter_group("raw").alias("filter_group"), keys.filter_display("raw").alias("display"),
        keys.filter_order("raw").alias("sort_order"), keys.filter_colors("raw")["border"].alias("border"),
    )


@query("quality_band", f"""
select frame_id, case when fwhm >= 4 then 'GOOD' when fwhm >= 2 then 'FAIR' else 'POOR' end as quality,
  cast(round_even(fwhm, 0) as int) as rating,
  concat(repeat('★', cast(round_even(fwhm, 0) as int)), repeat('☆', 5 - cast(round_even(fwhm, 0) as int))) as rating_text,
  least(greatest(fwhm / 5.0::double * 100.0::double, 0), 100) as score_percent,
  {sql_fixed('fwhm', 1)} || '/5' as score_text
from frames where fwhm is not null
""", ("frames",))
def _quality_band(spark, d):
    df = views.frames(spark, d).filter("fwhm is not null").withColumn("score", F.col("fwhm"))
    return scoring.quality_band(df).select(
        "frame_id", "quality", "rating", "rating_text", "score_percent", "score_text"
    )


@query("display_columns", f"""
select frame_id, coalesce({sql_fixed('exposure_s', 1)} || 's', 'n/a') as exposure_text,
  coalesce(strftime(exposure_ts, '%Y-%m-%d %H:%M:%S'), 'n/a') as timestamp_text,
  case when filter_name = '' then 'n/a' else filter_name end as filter_text,
  coalesce({sql_fixed('sqm', 3)}, 'n/a') as sqm_text, coalesce({sql_fixed('sky_temp', 1)} || '°', 'n/a') as sky_temp_text,
  {sql_fixed('mean_background', 0)} || ' ADU' as background_text,
  case when trail_confidence > 0 then trail_confidence || '%' else '–' end as trail_text
from frames
""", ("frames",))
def _display_columns(spark, d):
    return views.frames(spark, d).select("frame_id", *[c.alias(n) for n, c in display.display_columns().items()])


@query("format_integration", f"""
select frame_id, case when exposure_s * star_count * star_count / 3600.0::double >= 1
  then {sql_fixed('exposure_s * star_count * star_count / 3600.0::double', 1)} || ' h'
  else {sql_fixed('exposure_s * star_count * star_count / 60.0::double', 0)} || ' min' end as text
from frames where exposure_s is not null
""", ("frames",))
def _format_integration(spark, d):
    df = views.frames(spark, d).filter("exposure_s is not null")
    total = F.col("exposure_s") * F.col("star_count") * F.col("star_count")
    return df.select("frame_id", display.format_integration(total).alias("text"))


@query("arcsec_scale", """
with o as (select frame_id, fwhm, hfr + 2.4::double as um, cast(sky_temp as double) * 10 as mm from frames),
s as (select *, case when um > 0 and mm > 0 then 206.265::double * (um / mm) end as scale from o),
m as (select frame_id, scale, fwhm, case when fwhm > 0 then fwhm * scale end as arcsec from s)
select frame_id, scale, arcsec, case when fwhm > 0 and arcsec > 0 then arcsec / fwhm else 0 end as recovered from m
""", ("frames",))
def _arcsec_scale(spark, d):
    df = views.frames(spark, d).select(
        "frame_id", "fwhm", (F.col("hfr") + F.lit(2.4)).alias("um"), (F.col("sky_temp").cast("double") * 10).alias("mm")
    )
    df = df.withColumns(
        {"scale": geometry.arcsec_per_pixel("um", "mm"), "arcsec": geometry.to_arcsec("fwhm", "um", "mm")}
    )
    return df.select("frame_id", "scale", "arcsec", geometry.scale_from_pair("fwhm", "arcsec").alias("recovered"))


@query("light_only", """
with t as (select frame_id, case frame_id % 4 when 0 then ' ' when 1 then 'Light Frame' when 2 then 'DARK' end as image_type from frames)
select frame_id from t where coalesce(trim(image_type), '') = '' or image_type ilike '%light%'
""", ("frames",))
def _light_only(spark, d):
    kind = F.expr("case frame_id % 4 when 0 then ' ' when 1 then 'Light Frame' when 2 then 'DARK' end")
    df = views.frames(spark, d).withColumn("image_type", kind)
    return df.filter(headers.is_light("image_type")).select("frame_id")


METRICS = {"fwhm": 1, "eccentricity": 1, "hfr": 1, "star_count": 0, "mean_background": 1, "trail_confidence": 1}


def _pct_sql(m: str, lower: int) -> str:
    share = (
        f"((rank() over (partition by group_key order by {m} nulls last) - 1) + (rank() over (partition by group_key "
        f"order by {m} nulls last) + count(*) over (partition by group_key, {m}) - 2))::double / 2.0::double / "
        f"(count({m}) over (partition by group_key) - 1.0::double)"
    )
    return (
        f"case when count(*) over (partition by group_key) = 1 then 1.0::double when {m} is null then 0.0::double "
        f"when count({m}) over (partition by group_key) = 1 then 1.0::double "
        f"else {'1.0::double - ' if lower else ''}{share} end as pct_{m}"
    )


RANKED = f"""ranked as (select frame_id, group_key, {', '.join(_pct_sql(m, low) for m, low in METRICS.items())}
 from (select *, lower(trim(filter_name)) as group_key from frames))"""
SCORE = """least(greatest((pct_fwhm * 3.0::double + pct_eccentricity * 2.5::double + pct_hfr * 1.5::double
 + pct_star_count * 1.5::double + pct_mean_background * 0.5::double + pct_trail_confidence * 2.0::double)
 / 11.0::double * 5.0::double, 0), 5)"""


@query("rank_percentile", f"with {RANKED} select * from ranked", ("frames",))
def _rank_percentile(spark, d):
    return scoring.rank_percentile(
        views.frames(spark, d), "frame_id", keys.group_key("filter_name"), {m: bool(v) for m, v in METRICS.items()}
    )


@query("quality_score", f"with {RANKED} select frame_id, {SCORE} as score from ranked", ("frames",))
def _quality_score(spark, d):
    return scoring.quality_score(views.frames(spark, d)).select("frame_id", "score")


def _light_sql(m: str, avg: str, lower: bool) -> str:
    good, bad = (f"{m} <= {avg} * 0.92::double", f"{m} >= {avg} * 1.08::double")
    if not lower:
        good, bad = bad, good
    return f"case when {good} then 'green' when {bad} then 'red' else 'yellow' end as {m}_light"


@query("traffic_light", f"""
with s as (select avg(fwhm) af, avg(hfr) ah, avg(eccentricity) ae from frames),
g as (select filter_name k, avg(star_count) ast, avg(mean_background) ab from frames group by 1)
select frame_id, {_light_sql('fwhm', 'af', True)}, {_light_sql('hfr', 'ah', True)}, {_light_sql('eccentricity', 'ae', True)},
 {_light_sql('star_count', 'ast', False)}, {_light_sql('mean_background', 'ab', True)},
 case when trail_confidence >= 60 then 'red' else 'green' end as trail_confidence_light
from frames, s join g on k = filter_name
""".replace("from frames, s join g on k = filter_name", "from frames join g on k = filter_name cross join s"), ("frames",))
def _traffic_light(spark, d):
    df = scoring.traffic_light(views.frames(spark, d))
    return df.select("frame_id", *[c for c in df.columns if c.endswith("_light")])


LIMITS_OUT = [
    "group_key", "max_fwhm", "max_fwhm_arcsec", "min_sqm", "max_sky_temp", "max_hfr", "max_eccentricity",
    "max_mean_background", "min_stars", "min_trail", "min_score", "auto_fwhm", "auto_trail",
]
MEASURED = """m as (select lower(trim(filter_name)) as group_key, max(fwhm) mf, max(hfr) mh, max(eccentricity) me,
 max(mean_background) mb, min(star_count)::double ms, coalesce(min(sqm), 0)::double mq,
 coalesce(max(sky_temp), 40)::double mt from frames group by 1)"""


@query("auto_thresholds", f"""
with {MEASURED} select group_key, mf as max_fwhm, 20.0::double as max_fwhm_arcsec, mq as min_sqm, mt as max_sky_temp,
 mh as max_hfr, me as max_eccentricity, mb as max_mean_background, ms as min_stars, 80 as min_trail, 0.0::double as min_score,
 true as auto_fwhm, true as auto_trail from m
""", ("frames",))
def _auto_thresholds(spark, d):
    return thresholds.auto_thresholds(views.frames(spark, d)).select(*LIMITS_OUT)


@query("auto_thresholds_stored", f"""
with {MEASURED} select group_key,
 case group_key when 'automobile' then 4.0::double when 'furniture' then 8.0 else 4.5 end as max_fwhm, 20.0::double as max_fwhm_arcsec,
 case group_key when 'furniture' then mq else 19.0::double end as min_sqm,
 case group_key when 'furniture' then mt else 30.0::double end as max_sky_temp,
 case group_key when 'automobile' then 3.0::double when 'furniture' then mh else 4.0 end as max_hfr,
 case group_key when 'furniture' then me else 0.08::double end as max_eccentricity,
 case group_key when 'furniture' then mb else 400000.0::double end as max_mean_background,
 case group_key when 'furniture' then ms else 2.0::double end as min_stars,
 case group_key when 'furniture' then 70 else 80 end as min_trail, 0.0::double as min_score, false as auto_fwhm, false as auto_trail
from m
""", ("frames",))
def _auto_thresholds_stored(spark, d):
    return thresholds.auto_thresholds(views.frames(spark, d), limits_table(spark, STORED)).select(*LIMITS_OUT)


@query("auto_thresholds_new_groups", f"""
with {MEASURED} select group_key, case when group_key in ('', 'automobile', 'furniture') then
 case group_key when 'automobile' then 4.0::double when 'furniture' then 8.0 else 4.5 end else 4.5 end as max_fwhm,
 case when group_key = 'furniture' then 123.0::double else 400000.0 end as max_mean_background from m
""", ("frames",))
def _auto_thresholds_new_groups(spark, d):
    limits = thresholds.auto_thresholds(
        views.frames(spark, d), limits_table(spark, STORED), preserve_existing=True
    )
    return limits.select("group_key", "max_fwhm", "max_mean_background")


@query("reset_thresholds", f"""
with {MEASURED} select group_key, mf as max_fwhm, mb as max_mean_background, ms as min_stars, mq as min_sqm, 0 as min_trail, 0.0::double as min_score,
 false as auto_trail from m where group_key in ('automobile', 'building')
union all values ('', 4.5::double, 400000.0::double, 2.0::double, 19.0::double, 80, 0.0::double, false), ('furniture', 8.0, 123.0, 0.0, 0.0, 70, 0.0, false)
""", ("frames",))
def _reset_thresholds(spark, d):
    fresh = thresholds.reset_thresholds(
        views.frames(spark, d), limits_table(spark, STORED), ["AUTOMOBILE", "Building"]
    )
    return fresh.select(
        "group_key", "max_fwhm", "max_mean_background", "min_stars", "min_sqm", "min_trail", "min_score", "auto_trail"
    )


@query("with_thresholds", """
select frame_id, group_key, max_fwhm, max_hfr, max_mean_background, min_trail, 20.0::double as max_fwhm_arcsec from judged
""", JUDGED)
def _with_thresholds(spark, d):
    df = thresholds.with_thresholds(views.frames(spark, d), limits_table(spark, MANUAL))
    return df.select(
        "frame_id", "group_key", "max_fwhm", "max_hfr", "max_mean_background", "min_trail", "max_fwhm_arcsec"
    )


@query("scope_update", """
select group_key, 5.5::double as max_fwhm, mx as max_hfr from (select lower(trim(filter_name)) as group_key, max(hfr) as mx from frames group by 1)
""", ("frames",))
def _scope_update(spark, d):
    frames = views.frames(spark, d)
    limits = thresholds.auto_thresholds(frames)
    return thresholds.scope_update(limits, "max_fwhm", 5.5, [], []).select("group_key", "max_fwhm", "max_hfr")


@query("threshold_predicate", "select frame_id, auto_rejected from judged", JUDGED)
def _threshold_predicate(spark, d):
    return judged(spark, d).select("frame_id", "auto_rejected")


REASONS = f"""concat_ws(' | ',
 case when v_fwhm then concat('FWHM ', {sql_fixed('fwhm', 2)}, ' px  >  limit ', {sql_fixed('max_fwhm', 2)}, ' px') end,
 case when v_sqm then concat('SQM ', {sql_fixed('sqm', 3)}, '  <  limit ', {sql_fixed('min_sqm', 3)}) end,
 case when v_sky_temp then concat('Sky temp ', {sql_fixed('sky_temp', 1)}, '°  >  limit ', {sql_fixed('max_sky_temp', 1)}, '°') end,
 case when v_hfr then concat('HFR ', {sql_fixed('hfr', 2)}, ' px  >  limit ', {sql_fixed('max_hfr', 2)}, ' px') end,
 case when v_eccentricity then concat('Eccentricity ', {sql_fixed('eccentricity', 3)}, '  >  limit ', {sql_fixed('max_eccentricity', 3)}) end,
 case when v_mean_background then concat('Mean BG ', {sql_fixed('mean_background', 0)}, '  >  limit ', {sql_fixed('max_mean_background', 0)}) end,
 case when v_stars then concat('Stars ', star_count, '  <  limit ', {sql_fixed('min_stars', 0)}) end,
 case when v_trail then concat('Satellite trail confidence ', trail_confidence, '%  ≥  limit ', min_trail, '%') end"""


@query("rejection_reasons", f"select frame_id, {REASONS}) as reasons from judged", JUDGED)
def _rejection_reasons(spark, d):
    df = judged(spark, d)
    reasons = thresholds.rejection_reasons(thresholds.clauses_for(df))
    return df.select("frame_id", F.array_join(reasons, " | ").alias("reasons"))


@query("rejection_details", """
select frame_id, 'fwhm' as metric, fwhm as value, max_fwhm as "limit", fwhm - max_fwhm as excess from judged where v_fwhm
union all select frame_id, 'sqm', sqm, min_sqm, min_sqm - sqm from judged where v_sqm
union all select frame_id, 'sky_temp', sky_temp, max_sky_temp, sky_temp - max_sky_temp from judged where v_sky_temp
union all select frame_id, 'hfr', hfr, max_hfr, hfr - max_hfr from judged where v_hfr
union all select frame_id, 'eccentricity', eccentricity, max_eccentricity, eccentricity - max_eccentricity from judged where v_eccentricity
union all select frame_id, 'mean_background', mean_background, max_mean_background, mean_background - max_mean_background from judged where v_mean_background
union all select frame_id, 'stars', star_count, min_stars, min_stars - star_count from judged where v_stars
union all select frame_id, 'trail', trail_confidence, min_trail, trail_confidence - min_trail from judged where v_trail
""", JUDGED)
def _rejection_details(spark, d):
    df = judged(spark, d)
    details = df.select("frame_id", F.explode(thresholds.rejection_details(thresholds.clauses_for(df))).alias("r"))
    return details.select("frame_id", "r.metric", "r.value", "r.limit", "r.excess")


@query("effective_thresholds", """
select frame_id, 'inf'::double as max_fwhm, '-inf'::double as min_sqm, max_hfr, 0 as min_trail,
 (v_sky_temp or v_hfr or v_eccentricity or v_mean_background or v_stars) as hit from judged
""", JUDGED)
def _effective_thresholds(spark, d):
    df = thresholds.with_thresholds(views.frames(spark, d), limits_table(spark, MANUAL))
    masked = thresholds.effective_thresholds(df, {"fwhm": False, "sqm": False, "trail": False, "hfr": True})
    hit = thresholds.threshold_predicate(thresholds.clauses_for(df))
    return masked.select("frame_id", "max_fwhm", "min_sqm", "max_hfr", "min_trail", hit.alias("hit"))


@query("apply_thresholds", f"""
with {RANKED}, scored as (select frame_id, {SCORE} as score from ranked),
{MEASURED},
v as (select f.*, s.score, m.*, lower(trim(filter_name)) as gk,
  coalesce(case when m.group_key = 'automobile' then f.fwhm > 4.0 when m.group_key = 'furniture' then f.fwhm > 8.0 else f.fwhm > 4.5 end, false) as a1,
  coalesce(m.group_key <> 'furniture' and f.sqm < 19, false) as a2,
  coalesce(m.group_key <> 'furniture' and f.sky_temp > 30, false) as a3,
  coalesce(m.group_key <> 'furniture' and f.eccentricity > 0.08::double, false) as a4,
  coalesce(m.group_key <> 'furniture' and f.mean_background > 400000, false) as a5,
  coalesce(m.group_key <> 'furniture' and f.star_count < 2, false) as a6,
  case when m.group_key = 'furniture' then f.trail_confidence >= 70 else f.trail_confidence >= 80 end as a7
 from frames f join scored s using (frame_id) join m on m.group_key = lower(trim(filter_name)))
select frame_id, gk as group_key, round(score, 9) as score, (a1 or a2 or a3 or a4 or a5 or a6 or a7) as auto_rejected,
  coalesce(manual_override, (a1 or a2 or a3 or a4 or a5 or a6 or a7)) as is_rejected,
  (a1::int + a2::int + a3::int + a4::int + a5::int + a6::int + a7::int) as reason_count
from v
""", ("frames",))
def _apply_thresholds(spark, d):
    frames = views.frames(spark, d)
    scored = scoring.with_score(frames)
    df = thresholds.apply_thresholds(scored, limits_table(spark, STORED), enabled={"hfr": False}, peers=frames)
    return df.select(
        "frame_id", "group_key", F.round("score", 9).alias("score"), "auto_rejected", "is_rejected",
        F.size("reasons").alias("reason_count"),
    )


@query("override_state", """
select frame_id, is_rejected, manual_override is not null as override_active,
 concat(case when manual_override is not null then '✋ ' else '' end, case when is_rejected then 'Rejected' else 'Keep' end) as state_label from judged
""", JUDGED)
def _override_state(spark, d):
    return judged(spark, d).select("frame_id", "is_rejected", "override_active", "state_label")


@query("toggle_override", """
select frame_id, case when frame_id % 5 = 0 then case when (not is_rejected) = auto_rejected then null else not is_rejected end
 else manual_override end as manual_override from judged
""", JUDGED)
def _toggle_override(spark, d):
    df = judged(spark, d)
    edits = df.filter("frame_id % 5 = 0").select("frame_id")
    return verdicts.toggle_override(df, edits).select("frame_id", "manual_override")


def chips(spark: SparkSession, folder: str) -> DataFrame:
    named = summary.distinct_keys(views.frames(spark, folder))
    return named.select("group_key", (F.col("group_key") != "machinery").alias("selected"))


@query("visible", """
select frame_id from judged where not is_rejected and group_key not in ('', 'machinery')
""", JUDGED)
def _visible(spark, d):
    return verdicts.visible(judged(spark, d), chips(spark, d), show_rejected=False).select("frame_id")


@query("visible_with_blank", "select frame_id from judged where group_key <> 'machinery'", JUDGED)
def _visible_with_blank(spark, d):
    return verdicts.visible(judged(spark, d), chips(spark, d), include_blank=True).select("frame_id")


TIME = "case when {0} / 3600.0::double >= 1 then " + sql_fixed("{0} / 3600.0::double", 1) + " || ' h' else " + sql_fixed(
    "{0} / 60.0::double", 0) + " || ' min' end"


@query("session_summary", f"""
with t as (select count(*) as total, count_if(is_rejected) as rejected, sum(coalesce(exposure_s, 0))::double as total_s,
 sum(case when not is_rejected then coalesce(exposure_s, 0) else 0 end)::double as accepted_s from judged)
select total, rejected::bigint as rejected, (total - rejected)::bigint as accepted, (total - rejected) / total::double as accepted_ratio, total_s, accepted_s,
 {TIME.format('total_s')} as total_text, {TIME.format('accepted_s')} as accepted_text from t
""", JUDGED)
def _session_summary(spark, d):
    return summary.session_summary(judged(spark, d))


@query("group_summary", f"""
with t as (select case when filter_name = '' then '(none)' else trim(filter_name) end as filter_key, count(*) as total, count_if(is_rejected) as rejected,
 sum(coalesce(exposure_s, 0))::double as total_s, sum(case when not is_rejected then coalesce(exposure_s, 0) else 0 end)::double as accepted_s from judged group by 1)
select filter_key, total, rejected::bigint as rejected, (total - rejected)::bigint as accepted, (total - rejected) / total::double as accepted_ratio, total_s, accepted_s,
 case when accepted_s > 0 then {TIME.format('accepted_s')} when total_s > 0 then {TIME.format('total_s')} else '' end as time_text from t
""", JUDGED)
def _group_summary(spark, d):
    return summary.group_summary(judged(spark, d))


@query("summary_rollup", """
with t as (select case when filter_name = '' then '(none)' else trim(filter_name) end as filter_key, * exclude (group_key) from judged)
select filter_key, count(*) as total, count_if(is_rejected)::bigint as rejected, (count(*) - count_if(is_rejected))::bigint as accepted,
 (count(*) - count_if(is_rejected)) / count(*)::double as accepted_ratio, sum(coalesce(exposure_s, 0))::double as total_s,
 sum(case when not is_rejected then coalesce(exposure_s, 0) else 0 end)::double as accepted_s from t group by rollup (filter_key)
""", JUDGED)
def _summary_rollup(spark, d):
    return summary.summary_rollup(judged(spark, d))


@query("reject_counters", """
select count_if(v_fwhm)::bigint as fwhm_rejected, count_if(v_sqm)::bigint as sqm_rejected, count_if(v_sky_temp)::bigint as sky_temp_rejected,
 count_if(v_hfr)::bigint as hfr_rejected, count_if(v_eccentricity)::bigint as eccentricity_rejected, count_if(v_mean_background)::bigint as mean_background_rejected,
 count_if(v_stars)::bigint as stars_rejected, count_if(v_trail)::bigint as trail_rejected from judged where group_key not in ('', 'machinery')
""", JUDGED)
def _reject_counters(spark, d):
    selected = verdicts.selected_rows(views.frames(spark, d), chips(spark, d))
    return summary.reject_counters(selected, limits_table(spark, MANUAL))


@query("reject_counters_scope", """
select count_if(coalesce(fwhm > 4.0, false))::bigint as fwhm_rejected, count_if(coalesce(hfr > 3.0, false))::bigint as hfr_rejected from frames
""", ("frames",))
def _reject_counters_scope(spark, d):
    counts = summary.reject_counters(views.frames(spark, d), limits_table(spark, MANUAL), scope_key="Automobile")
    return counts.select("fwhm_rejected", "hfr_rejected")


SWEEP = [1.0, 2.0, 3.0, 4.0, 4.5, 5.0]


@query("threshold_sweep", f"""
select lower(trim(filter_name)) as group_key, l as "limit", count_if(coalesce(fwhm > l, false))::bigint as rejected
from frames, (select unnest({SWEEP}::double[]) as l) group by 1, 2
""", ("frames",))
def _threshold_sweep(spark, d):
    return summary.threshold_sweep(views.frames(spark, d), "fwhm", SWEEP)


@query("rejected_by_group", """
select case when filter_name = '' then '(no filter)' else filter_name end as filter_key, count(*) as rejected from judged where is_rejected group by 1
""", JUDGED)
def _rejected_by_group(spark, d):
    return summary.rejected_by_group(judged(spark, d))


@query("rejected_in_selection", """
with c as (select case when filter_name = '' then '(no filter)' else filter_name end as k, count(*) as n from judged where is_rejected group by 1)
select sum(case when k in ('(no filter)', 'BUILDING') then n else 0 end)::bigint as rejected, count(*) >= 2 as offers_choice from c
""", JUDGED)
def _rejected_in_selection(spark, d):
    return summary.rejected_in_selection(summary.rejected_by_group(judged(spark, d)), ["(no filter)", "BUILDING"])


@query("distinct_keys", f"""
with m as (select frame_id, coalesce(trim({MESSY}), '') as raw from frames), {DIM},
k as (select lower(raw) as group_key, arg_min(raw, frame_id) as raw from m where raw <> '' group by 1)
select group_key, raw as key, coalesce(short, raw) as display, sort_order, filter_group from k join dim d on d.category = {CATEGORY}
""", ("frames",))
def _distinct_keys(spark, d):
    return summary.ordered_keys(summary.distinct_keys(messy(spark, d), "raw"))


@query("keys_by_group", f"""
with m as (select frame_id, coalesce(trim({MESSY}), '') as raw from frames), {DIM},
k as (select lower(raw) as group_key, arg_min(raw, frame_id) as raw from m group by 1),
j as (select group_key, raw, coalesce(short, raw) as display, sort_order, filter_group from k join dim d on d.category = {CATEGORY})
select filter_group, dense_rank() over (order by first_order) as group_position,
 row_number() over (partition by filter_group order by sort_order, lower(raw)) as position, raw as key, display
from (select *, min(sort_order) over (partition by filter_group) as first_order from j)
""", ("frames",))
def _keys_by_group(spark, d):
    named = summary.distinct_keys(messy(spark, d), "raw", include_blank=True)
    return summary.keys_by_group(named).withColumn("group_position", F.col("group_position").cast("bigint"))


@query("first_non_null", """
select arg_min(sqm, case when sqm is not null then frame_id end) as sqm,
 arg_min(sky_temp, case when sky_temp is not null then frame_id end) as sky_temp from frames
""", ("frames",))
def _first_non_null(spark, d):
    return summary.first_non_null(views.frames(spark, d), ["sqm", "sky_temp"], "frame_id")


RULES = [("SkyTemp", "desc"), ("Fwhm", "asc"), ("ObservationDate", "desc")]
ORDER = "sky_temp desc nulls last, fwhm asc nulls last, exposure_ts desc nulls last, lower(file_name), frame_id"


@query("multi_sort", f"select frame_id, row_number() over (order by {ORDER}) - 1 as idx from frames", ("frames",))
def _multi_sort(spark, d):
    return ordering.sort_position(views.frames(spark, d), RULES).select("frame_id", "idx")


def shown(spark: SparkSession, folder: str) -> DataFrame:
    return verdicts.visible(judged(spark, folder), chips(spark, folder), show_rejected=False)


SHOWN = """shown as (select *, row_number() over (order by exposure_ts asc nulls last, lower(file_name), frame_id) - 1 as idx
 from judged where not is_rejected and group_key not in ('', 'machinery'))"""


@query("neighbours", f"""
with {SHOWN} select frame_id, idx, coalesce(lag(frame_id) over (order by idx), frame_id) as prev_id,
 coalesce(lead(frame_id) over (order by idx), frame_id) as next_id from shown
""", JUDGED)
def _neighbours(spark, d):
    indexed = ordering.sort_position(shown(spark, d))
    return ordering.neighbours(indexed, chunk=512)


@query("neighbourhood", f"""
with {SHOWN} select frame_id, idx, concat_ws(',', lead(frame_id, 1) over (order by idx), lag(frame_id, 1) over (order by idx),
 lead(frame_id, 2) over (order by idx), lag(frame_id, 2) over (order by idx), lead(frame_id, 3) over (order by idx)) as nearby from shown
""", JUDGED)
def _neighbourhood(spark, d):
    indexed = ordering.sort_position(shown(spark, d))
    return ordering.neighbourhood(indexed, 3, 2, chunk=512).withColumn("nearby", F.array_join("nearby", ","))


@query("remove_frames", "select frame_id from judged where not is_rejected", JUDGED)
def _remove_frames(spark, d):
    df = judged(spark, d)
    return sets.remove_frames(df, df.filter("is_rejected")).select("frame_id")


@query("obsolete_keys", """
with o as (select lower(filter_name) as k, min(filter_name) as filter_key from frames where filter_name in ('AUTOMOBILE', 'BUILDING', '') group by 1),
n as (select lower(filter_name) as k, min(lower(filter_name)) as filter_key from frames where filter_name in ('BUILDING', 'MACHINERY') group by 1)
select filter_key, 'dropped' as status from o where k not in (select k from n)
union all select filter_key, 'added' from n where k not in (select k from o)
""", ("frames",))
def _obsolete_keys(spark, d):
    named = views.frames(spark, d).withColumn("filter_key", F.col("filter_name"))
    old = named.filter(F.col("filter_name").isin("AUTOMOBILE", "BUILDING", ""))
    new = named.filter(F.col("filter_name").isin("BUILDING", "MACHINERY")).withColumn("filter_key", F.lower("filter_key"))
    return sets.obsolete_keys(old, new)


@query("reference_join", """
with r as (select frame_id as rid, fwhm as rf, mean_background as rb from frames where star_count > 3 order by frame_id limit 1)
select f.frame_id, rid as reference_id, f.fwhm - rf as fwhm_delta, f.mean_background - rb as background_delta from frames f, r
""", ("frames",))
def _reference_join(spark, d):
    df = views.frames(spark, d)
    joined = sets.reference_join(df, "frame_id", ["frame_id", "fwhm", "mean_background"], F.col("star_count") > 3)
    return joined.select(
        "frame_id", F.col("reference.frame_id").alias("reference_id"),
        (F.col("fwhm") - F.col("reference.fwhm")).alias("fwhm_delta"),
        (F.col("mean_background") - F.col("reference.mean_background")).alias("background_delta"),
    )


@query("move_manifest", """
with j as (select *, case frame_id % 3 when 0 then concat('Night', frame_id % 40, '/', lower(filter_name)) when 1 then concat('night', frame_id % 40, '/', filter_name) end as rel,
  concat('L', frame_id % 50, '.fits') as name from judged where is_rejected and filter_name in ('', 'BUILDING', 'FURNITURE')),
p as (select *, case when coalesce(rel, '') = '' then '/rejected' else concat('/rejected/', rel) end as folder from j),
n as (select *, row_number() over (partition by lower(concat(folder, '/', name)) order by frame_id) - 1 as k from p)
select frame_id, concat(folder, '/', case when k = 0 then name else concat('L', frame_id % 50, '_', k, '.fits') end) as destination from n
""", JUDGED)
def _move_manifest(spark, d):
    df = judged(spark, d).withColumn("relative_path", F.expr(
        "case frame_id % 3 when 0 then concat('Night', frame_id % 40, '/', lower(filter_name)) "
        "when 1 then concat('night', frame_id % 40, '/', filter_name) end"
    )).withColumn("file_name", F.expr("concat('L', frame_id % 50, '.fits')"))
    return moves.move_manifest(df, "/rejected", ["(no filter)", "BUILDING", "FURNITURE"])


@query("move_onto_existing", r"""
with j as (select *, case frame_id % 3 when 0 then concat('Night', frame_id % 40) when 1 then concat('night', frame_id % 40, '/', filter_name) end as rel,
  concat(case frame_id % 2 when 0 then 'L' else 'l' end, frame_id % 50, case when frame_id % 7 < 3 then concat('_', frame_id % 9) else '' end, '.fits') as name from judged),
p as (select frame_id, name, is_rejected, regexp_replace(name, '\.[^.]*$', '') as stem,
  case when coalesce(rel, '') = '' then '/rejected' else concat('/rejected/', rel) end as folder from j),
q as (select *, lower(concat(folder, '/', name)) as place, regexp_replace(stem, '_([0-9]{1,9})$', '') as root,
  coalesce(try_cast(regexp_extract(stem, '_([0-9]{1,9})$', 1) as int), 0) as num from p),
f as (select *, lower(concat(folder, '/', root, '.fits')) as family from q),
t as (select family, max(num) as top from f group by family),
n as (select *, row_number() over (partition by place order by frame_id) = 1
  and place not in (select place from f where not is_rejected) as stays from f where is_rejected),
m as (select *, row_number() over (partition by family, stays order by frame_id) as k from n)
select frame_id, concat(folder, '/', case when stays then name else concat(root, '_', top + k, '.fits') end) as destination from m join t using (family)
""", JUDGED)
def _move_onto_existing(spark, d):
    """The frames that are not rejected play the files that lie at the destination."""
    df = judged(spark, d).withColumn("relative_path", F.expr(
        "case frame_id % 3 when 0 then concat('Night', frame_id % 40) when 1 then concat('night', frame_id % 40, '/', filter_name) end"
    )).withColumn("file_name", F.expr(
        "concat(case frame_id % 2 when 0 then 'L' else 'l' end, frame_id % 50, case when frame_id % 7 < 3 then concat('_', frame_id % 9) else '' end, '.fits')"
    ))
    there = df.filter("not is_rejected").select(F.expr(
        "concat_ws('/', '/rejected', nullif(relative_path, ''), file_name)").alias("path"))
    return moves.move_manifest(df, "/rejected", existing=there)
