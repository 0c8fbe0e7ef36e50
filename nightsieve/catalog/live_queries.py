"""Queries over the `live` view, as batch and as stream."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightsieve.catalog import views
from nightsieve.catalog.registry import query
from nightsieve.operators import sets
from nightsieve.schema import ScoredMetric
from nightsieve.session import ensure_checkpoint_dir
from nightsieve.streaming import live

METRICS = [ScoredMetric("fwhm", 3.0), ScoredMetric("star_count", 1.5, lower_is_better=False)]


def _pct(m: str, lower: bool) -> str:
    share = (
        f"(2 * (rank() over (partition by group_key order by {m}) - 1) + count(*) over (partition by group_key, {m}) - 1)::double "
        f"/ 2.0::double / (count({m}) over (partition by group_key) - 1.0::double)"
    )
    return f"case when count(*) over (partition by group_key) = 1 then 1.0::double else {'1.0::double - ' if lower else ''}{share} end"


def _scored(source: str) -> str:
    return f"""p as (select *, {_pct('fwhm', True)} as a, {_pct('star_count', False)} as b from (select *, lower(trim(filter_name)) as group_key from {source})),
s as (select frame_id, group_key, least(greatest((a * 3.0::double + b * 1.5::double) / 4.5::double * 5.0::double, 0), 5) as score from p)"""


@query("live_rescore", f"""
with {_scored('live')} select * from s where group_key in (select lower(filter_name) from live where arrival_ts >= timestamp '2024-01-30' and user_id % 2 = 0)
""", ("live",))
def _live_rescore(spark, d):
    df = views.live(spark, d)
    late = df.filter("arrival_ts >= timestamp_ntz '2024-01-30' and user_id % 2 = 0")
    touched = late.select(F.lower("filter_name").alias("group_key")).distinct()
    return live.touched_scores(df, touched, "frame_id", METRICS).select("frame_id", "group_key", "score")


@query("live_delete", f"""
with k as (select * from live where user_id % 10 <> 0), {_scored('k')} select * from s
""", ("live",))
def _live_delete(spark, d):
    df = views.live(spark, d)
    left = sets.remove_frames(df, df.filter("user_id % 10 = 0"))
    every = left.select(F.lower("filter_name").alias("group_key")).distinct()
    return live.touched_scores(left, every, "frame_id", METRICS).select("frame_id", "group_key", "score")


@query("dedupe_arrivals", """
select concat('u', user_id) as path, min(arrival_ts)::varchar as first_seen from live where user_id % 3 <> 0 group by 1
""", ("live",))
def _dedupe_arrivals(spark, d):
    df = views.live(spark, d)
    name = F.when(F.col("frame_id") % 2 == 0, F.concat(F.lit("u"), "user_id")).otherwise(F.concat(F.lit("U"), "user_id"))
    events = df.select(F.col("arrival_ts"), name.alias("path"))
    known = df.filter("user_id % 3 = 0").select(F.concat(F.lit("U"), "user_id").alias("path")).distinct()
    fresh = live.dedupe_arrivals(events, known)
    stamp = F.regexp_replace(F.date_format("arrival_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    return fresh.select(F.lower("path").alias("path"), stamp.alias("first_seen"))


@query("settle_delay", """
select frame_id from live where arrival_ts <= timestamp '2024-01-15 12:00:00' - interval 1500 millisecond
""", ("live",))
def _settle_delay(spark, d):
    df = views.live(spark, d).withColumn("modificationTime", F.col("arrival_ts").cast("timestamp"))
    return live.settled(df, F.to_timestamp(F.lit("2024-01-15 12:00:00"))).select("frame_id")


@query("load_progress", """
select count(*) as completed, count_if(star_count % 10 <> 0)::bigint as loaded, count_if(star_count % 10 = 0)::bigint as skipped, 1000000 - count(*) as left from live
""", ("live",))
def _load_progress(spark, d):
    status = F.when(F.col("star_count") % 10 == 0, "error").otherwise("loaded")
    return live.load_progress(views.live(spark, d).withColumn("status", status), 1_000_000)


def stream_through(spark: SparkSession, folder: str) -> DataFrame:
    """The events table read as a stream and scored batch by batch."""
    base = ensure_checkpoint_dir(spark)
    state = tempfile.mkdtemp(prefix="live-", dir=base[5:] if base.startswith("file:") else base) if _is_local(base) else (
        f"{base}/live-{spark.sparkContext.applicationId}-{spark.range(1).select(F.uuid()).first()[0]}"
    )
    session = live.LiveSession(spark, state, "frame_id", metrics=METRICS)
    events = spark.readStream.schema(views.table(spark, folder, "events").schema).option(
        "pathGlobFilter", "events.parquet"
    ).parquet(folder)
    query_ = (
        spark.sql(views.LIVE_SQL, events=events).writeStream.foreachBatch(session.on_arrivals)
        .option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    )
    query_.awaitTermination()
    return session.scored().select("frame_id", "group_key", "score")


def _is_local(base: str) -> bool:
    return base.startswith(("file:", "/"))


@query("live_stream", f"with {_scored('live')} select * from s", ("live",))
def _live_stream(spark, d):
    return stream_through(spark, d)
