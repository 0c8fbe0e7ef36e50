"""Queries over the `files`, `cards`, `session` and `live` views."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightsieve.catalog import views
from nightsieve.catalog.registry import query
from nightsieve.functions import headers, keys, tone
from nightsieve.operators import sets
from nightsieve.sources import cards as card_source
from nightsieve.sources import documents, files

FRAME_PATH = "case page_id % 4 when 0 then concat(path, '.FITS') when 1 then concat(path, '.xisf') when 2 then path else concat(upper(path), '.fits') end"


def framed(spark, d):
    """Page paths with frame extensions on most of them."""
    return views.files(spark, d).withColumn("path", F.expr(FRAME_PATH))


FRAMED = f"framed as (select * replace ({FRAME_PATH} as path) from files)"
EXT = "lower(regexp_extract(split_part(path, '/', -1), '[.]([^.]*)$', 1))"


@query("discover_files", f"""
with {FRAMED} select arg_min(path, path) as path, count(*) as copies from (select path from framed union all select upper(path) from framed)
where {EXT} in ('fit', 'fits', 'xisf') group by lower(path)
""", ("files",))
def _discover_files(spark, d):
    parts = files.path_parts(framed(spark, d)).filter("kind <> 'unsupported'").select("path")
    both = parts.unionByName(parts.select(F.upper("path").alias("path")))
    counts = both.groupBy(F.lower("path").alias("k")).agg(F.count(F.lit(1)).alias("copies"))
    first = sets.dedupe_keep_first(both, F.col("path"), ["path"])
    return files.in_path_order(first.join(counts, F.lower("path") == F.col("k")).select("path", "copies"))


ROOTS = "/blog.ththan.example.net; /ththre.example.com/fr/ ;/blog.ththan.example.net/en;;/m.therou.example.com"
DIR = "regexp_replace(path, '/[^/]*$', '')"


@query("relative_path", f"""
with r as (select unnest(['/blog.ththan.example.net', '/ththre.example.com/fr', '/blog.ththan.example.net/en', '/m.therou.example.com']) as root),
m as (select page_id, root, substr({DIR}, length(root) + 2) as rel, row_number() over (partition by page_id order by length(root) desc) as rn
 from files join r on lower({DIR}) like lower(root) || '/%')
select f.page_id, m.rel as relative_path from files f left join m on m.page_id = f.page_id and rn = 1
""", ("files",))
def _relative_path(spark, d):
    return views.files(spark, d).select("page_id", files.relative_path("path", ROOTS).alias("relative_path"))


@query("path_parts", f"""
with {FRAMED}, e as (select page_id, split_part(path, '/', -1) as file_name, {EXT} as extension from framed)
select page_id, file_name, extension, case when extension in ('fit', 'fits') then 'fits' when extension = 'xisf' then 'xisf' else 'unsupported' end as kind,
 case when extension not in ('fit', 'fits', 'xisf') then concat('unsupported extension: ', extension) end as error from e
""", ("files",))
def _path_parts(spark, d):
    return files.path_parts(framed(spark, d)).select("page_id", "file_name", "extension", "kind", "error")


@query("header_cards", """
select page_id, upper(k) as key, arg_max(v, seq) as value from cards group by 1, 2
""", ("cards",))
def _header_cards(spark, d):
    text = views.table(spark, d, "pages").select(
        "page_id", F.regexp_extract("url", r"[?]([^#]*)", 1).alias("header")
    )
    return card_source.last_card(card_source.key_values(text, "header", "&"), "page_id")


def maps(spark, d):
    return card_source.card_map(views.cards(spark, d), "page_id", "k", "v")


CARD_MAP = """last as (select page_id, upper(k) as k, arg_max(v, seq) as v from cards group by 1, 2),
m as (select page_id, max(case when k = 'PAGE' then v end) as page, max(case when k = 'REF' then v end) as ref,
 max(case when k = 'UTM_SOURCE' then v end) as utm from last group by 1)"""


@query("first_available", f"""
with {CARD_MAP} select page_id, case when try_cast(ref as double) > 0 then try_cast(ref as double) when try_cast(page as double) > 0 then try_cast(page as double) end as number,
 coalesce(try_cast(utm as double), try_cast(page as double)) as any_number, coalesce(utm, ref) as text from m
""", ("cards",))
def _first_available(spark, d):
    return maps(spark, d).select(
        "page_id",
        headers.first_available("cards", ["ref", "page"]).alias("number"),
        headers.first_available("cards", ["utm_source", "page"], positive=False).alias("any_number"),
        headers.first_text("cards", ["utm_source", "ref"]).alias("text"),
    )


@query("first_available_multi", """
with e as (select page_id, seq % 2 as source, upper(k) as key, v from cards union all select page_id, 2, 'EXTRA', cast(page_id - 50 as string) from cards),
t as (select *, try_cast(v as double) as n, list_position(['REF', 'EXTRA', 'PAGE'], key) as kr from e),
p as (select page_id, kr, arg_min(n, source) as n from t where n is not null and kr is not null group by 1, 2)
select page_id, arg_min(n, kr) as value from p where n > 0 group by 1
""", ("cards",))
def _first_available_multi(spark, d):
    base = views.cards(spark, d).select(
        "page_id", (F.col("seq") % 2).alias("source"), F.col("k").alias("key"), F.col("v").alias("value")
    )
    extra = base.select(
        "page_id", F.lit(2).alias("source"), F.lit("extra").alias("key"), (F.col("page_id") - 50).cast("string").alias("value")
    )
    return card_source.first_available_multi(base.unionByName(extra), "page_id", ["ref", "extra", "page"])


@query("resolve_pixel_size", """
with o as (select o_orderkey as id, case when o_orderkey % 3 = 0 then o_totalprice end as a, case when o_orderkey % 2 = 0 then nullif(o_custkey, 0) end as b,
 case when o_orderkey % 5 = 0 then o_orderkey else -1 end as c from orders)
select id, coalesce(a, case when c > 0 then (b + c) / 2.0::double end, b, case when c > 0 then c end)::double as pixel_um from o
""")
def _resolve_pixel_size(spark, d):
    o = views.table(spark, d, "orders")
    cards = F.map_from_arrays(
        F.array(F.lit("PIXSIZE"), F.lit("XPIXSIZE"), F.lit("YPIXSIZE")),
        F.array(
            F.expr("case when o_orderkey % 3 = 0 then concat(\"'\", o_totalprice, \"' \") end"),
            F.expr("case when o_orderkey % 2 = 0 then cast(o_custkey as string) end"),
            F.expr("case when o_orderkey % 5 = 0 then cast(o_orderkey as string) else '-1' end"),
        ),
    )
    return o.select(F.col("o_orderkey").alias("id"), headers.resolve_pixel_size(cards).alias("pixel_um"))


@query("resolve_timestamp", """
select event_id as id, case event_id % 5 when 3 then null
 when 2 then strftime(date_trunc('second', ts) - interval 2 hour, '%Y-%m-%d %H:%M:%S')
 else strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') end as at
from events
""")
def _resolve_timestamp(spark, d):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    mode = F.col("event_id") % 5
    text = (
        F.when(mode == 0, stamp).when(mode == 1, F.concat(F.lit("'"), stamp, F.lit("  '")))
        .when(mode == 2, F.concat(stamp, F.lit("+02:00"))).when(mode == 3, F.lit("not a date"))
        .otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"))
    )
    cards = F.create_map(F.when(F.col("event_id") % 2 == 0, "DATE-OBS").otherwise("DATE_OBS"), text)
    df = views.table(spark, d, "events").select("event_id", headers.resolve_timestamp(cards).alias("t"))
    return df.select(F.col("event_id").alias("id"), F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("sqm_from_name", """
select o_orderkey as id, case o_orderkey % 4 when 3 then null else round(18 + (o_orderkey % 400) / 100.0, 2)::double end as sqm from orders
""")
def _sqm_from_name(spark, d):
    value = F.format_number(F.lit(18.0) + (F.col("o_orderkey") % 400) / 100.0, 2)
    mode = F.col("o_orderkey") % 4
    name = (
        F.when(mode == 0, F.concat(F.lit("M31_Exp300.00s__SQM_"), value, F.lit("_0000.fits")))
        .when(mode == 1, F.concat(F.lit("a%sqm%"), value, F.lit("%b.xisf")))
        .when(mode == 2, F.concat(F.lit("x_Sqm-"), value, F.lit(".fit")))
        .otherwise(F.concat(F.lit("SQM"), value))
    )
    df = views.table(spark, d, "orders")
    return df.select(F.col("o_orderkey").alias("id"), headers.sqm_from_name(name).alias("sqm"))


@query("norm_max", """
select page_id, seq, case length(v) % 4 when 1 then 255.0::double when 2 then 65535.0 when 3 then 4294967295.0 else 1.0 end as by_bits,
 case k when 'ref' then 65535.0::double when 'page' then 255.0 else 1.0 end as by_format from cards
""", ("cards",))
def _norm_max(spark, d):
    df = views.cards(spark, d)
    bits = F.expr("case length(v) % 4 when 1 then 8 when 2 then 16 when 3 then -32 else -64 end")
    kind = F.expr("case k when 'ref' then 'UInt16' when 'page' then 'UInt8' else 'Float32' end")
    return df.select(
        "page_id", "seq", tone.norm_max_from_bits(bits).alias("by_bits"), tone.norm_max_from_format(kind).alias("by_format")
    )


@query("load_report", f"""
with {FRAMED}, s as (select case when {EXT} not in ('fit', 'fits', 'xisf') then 'error' when page_id % 7 = 0 then 'not light' else 'loaded' end as status from framed)
select count(*) as total, count_if(status = 'loaded')::bigint as loaded, count_if(status <> 'loaded')::bigint as skipped, count_if(status = 'error')::bigint as errors from s
""", ("files",))
def _load_report(spark, d):
    parts = files.path_parts(framed(spark, d))
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("page_id") % 7 == 0, "not light").otherwise("loaded")
    return files.load_report(parts.withColumn("status", status))


@query("split_list", """
select page_id, trim(u) as item from (select page_id, unnest(string_split(concat(path, ' ;; ', upper(path), '; '), ';')) as u from files) where trim(u) <> ''
""", ("files",))
def _split_list(spark, d):
    text = F.concat(F.col("path"), F.lit(" ;; "), F.upper("path"), F.lit("; "))
    return views.files(spark, d).select("page_id", F.explode(keys.split_list(text)).alias("item"))


@query("strip_quotes", """
select page_id, nullif(trim(split_part(path, '/', 3)), '') as text, contains(lower(path), 'example.com') as has_part from files
""", ("files",))
def _strip_quotes(spark, d):
    quoted = F.concat(F.lit(" '\""), F.get(F.split("path", "/"), F.lit(2)), F.lit("\" ' "))
    return views.files(spark, d).select(
        "page_id", keys.strip_quotes(quoted).alias("text"), keys.contains_ci("path", "Example.COM").alias("has_part")
    )


@query("union_sources", """
with l as (select path, 0 as source from files where page_id % 2 = 0 union all select upper(path), 1 from files where page_id % 3 = 0)
select arg_min(path, source) as path, min(source) as source from l group by lower(path)
""", ("files",))
def _union_sources(spark, d):
    df = views.files(spark, d)
    one = df.filter("page_id % 2 = 0").select("path").distinct()
    two = df.filter("page_id % 3 = 0").select(F.upper("path").alias("path")).distinct()
    return sets.union_sources([one, two])


@query("new_files", "select page_id, path from files f where lower(path) not in (select lower(path) from files where page_id % 3 <> 0)", ("files",))
def _new_files(spark, d):
    df = views.files(spark, d)
    saved = df.filter("page_id % 3 <> 0").select(F.upper("path").alias("path"))
    return sets.new_files(df, saved).select("page_id", "path")


DOC = """concat('{"Version":2,', case when event_id % 2 = 0 then concat('"ShowRejected":false,"MaxFwhm":', value, ',"MaxFwhmArcsec":', event_id % 3 - 1, ',"Frames":[{"FilePath":"/a"},{"FilePath":"/b"}]')
 else concat('"FilterThresholds":[{"Key":" HA ","MaxFwhm":', value, ',"MaxFwhmArcsec":3.5,"AutoCalcFwhmThreshold":false},{"Key":"', event_type, '","MaxHfr":1.5}]') end, '}')"""


@query("session_read", """
with e as (select event_id, value, event_type from events)
select event_id, '' as group_key, value as max_fwhm, case when event_id % 3 - 1 > 0 then 1.0::double else 20.0 end as max_fwhm_arcsec, 0.0::double as max_hfr, true as auto_fwhm from e where event_id % 2 = 0
union all select event_id, 'ha', value, 3.5, 0.0, false from e where event_id % 2 = 1
union all select event_id, '', value, 3.5, 0.0, false from e where event_id % 2 = 1
union all select event_id, lower(event_type), 0.0, 20.0, 1.5, true from e where event_id % 2 = 1
""")
def _session_read(spark, d):
    docs = views.table(spark, d, "events").select("event_id", F.expr(DOC).alias("text"))
    limits = documents.session_thresholds(documents.parse_sessions(docs, "text"), "doc", ["event_id"])
    return limits.select("event_id", "group_key", "max_fwhm", "max_fwhm_arcsec", "max_hfr", "auto_fwhm")


@query("session_settings", """
select event_id, 2 as version, true as show_accepted, event_id % 2 = 1 as show_rejected, case when event_id % 2 = 0 then 2 else 0 end as n_frames from events
""")
def _session_settings(spark, d):
    docs = views.table(spark, d, "events").select("event_id", F.expr(DOC).alias("text"))
    parsed = documents.parse_sessions(docs, "text").drop("text")
    return documents.session_settings(parsed, "doc").select(
        "event_id", "version", "show_accepted", "show_rejected", "n_frames"
    )


@query("session_write", """
with i as (select session_id, ord, row_number() over (partition by session_id order by ord, filter_name, note) - 1 as i from session)
select session_id, i // 3 as part, count(*) as entries, min(ord) as first_ord, max(ord) as last_ord from i group by 1, 2
""", ("session",))
def _session_write(spark, d):
    parts = documents.document_parts(
        views.session(spark, d), ["session_id"], ["ord", "filter_name", "note"], ["ord", "filter_name", "note"], 3
    )
    return parts.select(
        "session_id", "part", F.size("entries").cast("bigint").alias("entries"),
        F.array_min(F.transform("entries", lambda e: e["ord"])).alias("first_ord"),
        F.element_at("entries", -1)["ord"].alias("last_ord"),
    )


@query("nested_roundtrip", "select session_id, ord, filter_name, note from session", ("session",))
def _nested_roundtrip(spark, d):
    return documents.nested_roundtrip(views.session(spark, d), ["session_id"], ["ord", "filter_name", "note"], 2)


NAME = "case when ord % 4 = 3 then ' ' when ord % 2 = 0 then upper(filter_name) else concat(filter_name, ' ') end"


@query("profiles_read", f"""
with p as (select session_id, ord, case when trim({NAME}) = '' then 'Default' else trim({NAME}) end as name from session where filter_name <> 'system' and session_id % 5 <> 0),
u as (select session_id, arg_min(name, ord) as name, min(ord) as ord from p group by session_id, lower(name)),
a as (select * from u union all select distinct session_id, 'Default', 0 from session where session_id not in (select session_id from u)),
w as (select distinct session_id, case session_id % 3 when 0 then 'assistant' when 1 then 'nobody' else 'Default' end as wanted from session),
d as (select a.session_id, arg_min(name, case when lower(name) = lower(wanted) then -1 else ord end) as dn from a join w using (session_id) group by 1)
select a.session_id, name, ord, name = dn as is_default from a join d using (session_id)
""", ("session",))
def _profiles_read(spark, d):
    s = views.session(spark, d)
    profiles = s.filter("filter_name <> 'system' and session_id % 5 <> 0").select("session_id", "ord", F.expr(NAME).alias("name"))
    wanted = F.expr("case session_id % 3 when 0 then ' assistant ' when 1 then 'nobody' end")
    settings = s.select("session_id", wanted.alias("default_name")).distinct()
    return documents.profiles_read(profiles, settings, "session_id").select("session_id", "name", "ord", "is_default")


@query("profile_apply", """
with g as (select session_id, lower(filter_name) as group_key, max(ord) + 0.5::double as max_fwhm from session where session_id % 4 <> 0 and filter_name <> 'user' group by 1, 2
 union all select session_id, '', max(ord) + 9.5 from session where session_id % 4 = 1 group by 1),
b as (select session_id, min(ord) + 4.25::double as max_fwhm from session group by 1)
select * from g union all select session_id, '', max_fwhm from b where session_id not in (select session_id from g where group_key = '')
""", ("session",))
def _profile_apply(spark, d):
    s = views.session(spark, d).withColumn("name", F.lit("Night"))
    rows = s.filter("session_id % 4 <> 0 and filter_name <> 'user'").groupBy("session_id", "name", F.upper("filter_name").alias("group_key"))
    base = s.filter("session_id % 4 = 1").groupBy("session_id", "name", F.lit(" ").alias("group_key"))
    groups = rows.agg((F.max("ord") + F.lit(0.5)).alias("max_fwhm")).unionByName(
        base.agg((F.max("ord") + F.lit(9.5)).alias("max_fwhm"))
    )
    single = s.groupBy("session_id", "name").agg((F.min("ord") + F.lit(4.25)).alias("max_fwhm"))
    return documents.profile_apply(groups, single, " nIGHT", "session_id").select("session_id", "group_key", "max_fwhm")


@query("resume_union", """
select session_id, ord, true as restored, note from session where ord % 2 = 0 union all select session_id, ord, false, null from session where ord % 2 = 1
""", ("session",))
def _resume_union(spark, d):
    s = views.session(spark, d)
    restored = s.filter("ord % 2 = 0").select("session_id", "ord", "note")
    return sets.resume_union(restored, s.filter("ord % 2 = 1").select("session_id", "ord"))


@query("dedupe_keep_first", """
select session_id, arg_min(filter_name, ord) as filter_name, min(ord) as ord from session group by session_id, lower(filter_name)
""", ("session",))
def _dedupe_keep_first(spark, d):
    s = views.session(spark, d).select("session_id", "ord", "filter_name")
    both = s.unionByName(s.select("session_id", (F.col("ord") + 1000).alias("ord"), F.upper("filter_name").alias("filter_name")))
    return sets.dedupe_keep_first(both, F.col("filter_name"), ["ord"], ["session_id"])


@query("restore_selection", """
with k as (select distinct session_id, lower(filter_name) as group_key from session)
select session_id, group_key, case when session_id % 2 = 0 and group_key = 'user' then false else true end as selected from k
""", ("session",))
def _restore_selection(spark, d):
    s = views.session(spark, d)
    named = s.select("session_id", F.lower("filter_name").alias("group_key")).distinct()
    saved = s.filter("session_id % 2 = 0").select(
        "session_id", F.concat(F.upper("filter_name"), F.lit(" ")).alias("key"), (F.col("filter_name") != "user").alias("selected")
    )
    return sets.restore_selection(named, saved, ["session_id"])
