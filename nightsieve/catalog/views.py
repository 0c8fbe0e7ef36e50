"""The views the queries run over, as DataFrames and as check SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


FRAMES_SQL = """
select o_orderkey as frame_id,
       concat('F', lpad(cast(o_orderkey as string), 8, '0'), '.fits') as file_name,
       case when o_orderkey % 10 = 0 and o_orderstatus = 'P' then '' else c_mktsegment end as filter_name,
       o_orderdate as exposure_ts,
       mq * 10 as exposure_s,
       mq / 10 as fwhm, nq / 10 as hfr, md as eccentricity,
       coalesce(c, 0) as star_count,
       o_totalprice as mean_background,
       cast(round(coalesce(mt, 0) * 1000) as int) as trail_confidence,
       case when nt is null then null else 18 + nt * 50 end as sqm,
       case when o_orderstatus = 'F' then null else (o_custkey % 60) - 20 end as sky_temp,
       case when o_orderkey % 97 = 0 then true when o_orderkey % 89 = 0 then false end as manual_override
from {orders} join {customer} on o_custkey = c_custkey left join (
  select l_orderkey, max(l_quantity) mq, min(l_quantity) nq, count(*) c,
         max(l_discount) md, max(l_tax) mt, min(l_tax) nt
  from {lineitem} group by l_orderkey) on l_orderkey = o_orderkey
"""

STARS_SQL = """
select l_suppkey as frame_id, l_partkey as star_id,
       cast((l_partkey * 131) % 2000 as double) as x,
       cast((l_partkey * 37 + l_suppkey * 101) % 1500 as double) as y,
       min(l_quantity) / 5 as fwhm, max(l_quantity) / 10 as hfr,
       max(l_discount) * 8 as ecc, max(l_extendedprice) as peak, count(*) as n
from {lineitem} group by l_suppkey, l_partkey
"""

FILES_SQL = """
select page_id, url,
       regexp_replace(regexp_replace(url, '^https?:/', ''), '[?#].*$', '') as path
from {pages}
"""

LIVE_SQL = """
select event_id as frame_id, ts as arrival_ts, event_type as filter_name, value as fwhm,
       cast(regexp_extract(props, '([0-9]+)', 1) as int) as star_count, user_id
from {events}
"""

SESSION_SQL = """
select conv_id as session_id, turn as ord, role as filter_name, text as note from {conversations}
"""

CHECK_SQL = {
    "frames": FRAMES_SQL.format(orders="orders", customer="customer", lineitem="lineitem"),
    "stars": STARS_SQL.format(lineitem="lineitem"),
    "files": FILES_SQL.format(pages="pages"),
    "live": LIVE_SQL.format(events="events"),
    "session": SESSION_SQL.format(conversations="conversations"),
    "pixels": """
select vec_id as frame_id, cast((i - 1) // 8 as int) as y, cast((i - 1) % 8 as int) as x, cast(embedding[i] as double) as v
from embeddings, range(1, 65) t(i)
""",
    "cards": """
select page_id, i - 1 as seq, split_part(kv, '=', 1) as k, split_part(kv, '=', 2) as v
from (select page_id, i, parts[i] as kv
      from (select page_id, string_split(regexp_extract(url, '[?]([^#]*)', 1), '&') as parts from pages), range(1, 20) t(i)
      where i <= len(parts))
where kv like '%=%'
""",
}

RASTER_SIDE = 8
STAR_FRAME = (2000, 1500)


def frames(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(
        FRAMES_SQL,
        orders=table(spark, folder, "orders"),
        customer=table(spark, folder, "customer"),
        lineitem=table(spark, folder, "lineitem"),
    )


def stars(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(STARS_SQL, lineitem=table(spark, folder, "lineitem"))


def star_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(frame_id, rows): at least as many rows as the frame has stars, counted without forming the stars."""
    lines = table(spark, folder, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("frame_id")).agg(F.count(F.lit(1)).alias("rows"))


def files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(FILES_SQL, pages=table(spark, folder, "pages"))


def live(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(LIVE_SQL, events=table(spark, folder, "events"))


def session(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(SESSION_SQL, conversations=table(spark, folder, "conversations"))


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    exploded = table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return exploded.select(
        F.col("vec_id").alias("frame_id"),
        F.floor(F.col("pos") / RASTER_SIDE).cast("int").alias("y"),
        (F.col("pos") % RASTER_SIDE).alias("x"),
        F.col("v").cast("double").alias("v"),
    )


def cards(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "pages").select(
        "page_id", F.posexplode(F.split(F.regexp_extract("url", r"[?]([^#]*)", 1), "&")).alias("seq", "kv")
    )
    parts = F.split("kv", "=")
    return pairs.filter(F.col("kv").contains("=")).select(
        "page_id", "seq", F.get(parts, F.lit(0)).alias("k"), F.get(parts, F.lit(1)).alias("v")
    )


MOSAIC_TILES = 10
MOSAIC_SIDE = MOSAIC_TILES * RASTER_SIDE


def mosaics(spark: SparkSession, folder: str) -> DataFrame:
    """80x80 rasters, each of 100 vectors laid out as 8x8 tiles on a flat level; every 7th tile holds a star."""
    tile = F.col("frame_id") % (MOSAIC_TILES * MOSAIC_TILES)
    dx, dy = F.col("x") - F.lit(3.4), F.col("y") - F.lit(3.6)
    glow = F.lit(3000.0) * F.exp(-(dx * dx + dy * dy) / F.lit(2.0 * 1.3 * 1.3))
    star = F.when(F.col("frame_id") % 7 == 0, glow * (F.lit(1.0) + F.abs("v"))).otherwise(F.lit(0.0))
    return pixels(spark, folder).select(
        F.floor(F.col("frame_id") / (MOSAIC_TILES * MOSAIC_TILES)).alias("frame_id"),
        (F.floor(tile / MOSAIC_TILES) * RASTER_SIDE + F.col("y")).cast("int").alias("y"),
        (tile % MOSAIC_TILES * RASTER_SIDE + F.col("x")).cast("int").alias("x"),
        (F.col("v") * 100 + 1000 + star).alias("v"),
    )


def mosaic_frames(spark: SparkSession, folder: str) -> DataFrame:
    """The rasters' headers."""
    side = F.lit(MOSAIC_SIDE)
    rows = mosaics(spark, folder).select("frame_id").distinct()
    return rows.withColumns({"width": side, "height": side, "pixel_um": F.lit(3.76), "focal_mm": F.lit(500.0)})
