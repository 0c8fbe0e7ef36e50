"""Live folders: arrivals, deletions, settling and regional rescoring.

State is a folder of small append-only tables, one sub-folder per batch, so a batch
that is run again after a failure overwrites only itself:

    arrivals/batch=N   rows that came in, with the file's modification time
    removals/batch=N   paths that went away
    scores/            scores of the groups last touched, one sub-folder per group

The frames of the session are the latest event of each path.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from nightsieve.functions.keys import group_key
from nightsieve.operators.scoring import quality_score
from nightsieve.schema import SCORED, ScoredMetric
from nightsieve.session import cut
from nightsieve.sources.files import FRAME_GLOB, split_roots
from nightsieve.streaming.folder_source import folder_changes

BINARY_FILES = "path string, modificationTime timestamp, length bigint, content binary"
SETTLE_SECONDS = 1.5  # fixed value: age a file needs before it is read


def watch_source(spark: SparkSession, roots: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """Stream of (path, modificationTime, length) of frame files as they appear."""
    streams = None
    for root in split_roots(roots):
        one = (
            spark.readStream.schema(BINARY_FILES).format("binaryFile").option("pathGlobFilter", FRAME_GLOB)
            .option("recursiveFileLookup", str(recursive).lower()).load(root)
            .select("path", "modificationTime", "length")
        )
        streams = one if streams is None else streams.unionByName(one)
    if streams is None:
        raise ValueError("no folder to watch")
    return streams


def settled(listing: DataFrame, now: Column | None = None, seconds: float = SETTLE_SECONDS) -> DataFrame:
    """Files old enough to be complete; the rest stays for a later look."""
    now = F.current_timestamp() if now is None else now
    return listing.filter(F.col("modificationTime") <= now - F.make_dt_interval(secs=F.lit(seconds)))


def dedupe_arrivals(events: DataFrame, known: DataFrame | None, path: str = "path") -> DataFrame:
    """Each path once, ignoring case, and none that is known already."""
    first = events.groupBy(F.lower(path).alias("_p")).agg(F.min(F.struct(*events.columns)).alias("_e"))
    if known is not None:
        first = first.join(known.select(F.lower(path).alias("_p")).distinct(), "_p", "left_anti")
    return first.select("_e.*")


def dedupe_stream(stream: DataFrame, event_time: str, path: str = "path", delay: str = "1 hour") -> DataFrame:
    """The same on an event stream, with state bounded by the watermark."""
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withColumn("_p", F.lower(path))
    return timed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_p"]).drop("_p")


class LiveSession:
    """State of one watched session in a shared folder.

    `measure` turns arriving files (or events) into rows of the frames table.
    """

    def __init__(
        self, spark: SparkSession, state: str, id_col: str = "path",
        measure: Callable[[DataFrame], DataFrame] | None = None, metrics: Sequence[ScoredMetric] = SCORED,
    ) -> None:
        self.spark, self.state, self.id_col = spark, state.rstrip("/"), id_col
        self.measure = measure or (lambda files: files)
        self.metrics = list(metrics)

    def _table(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.option("mergeSchema", True).parquet(f"{self.state}/{name}")
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def frames(self, before: int | None = None) -> DataFrame | None:
        """Current frames: the latest event of each path, unless it is a removal.

        `before` leaves out that batch and later ones, so a batch run again sees the
        state it saw first.
        """
        arrivals = self._table("arrivals")
        if arrivals is None:
            return None
        columns = [c for c in arrivals.columns if c not in ("batch", "_p")]
        seen = arrivals.select("_p", "batch", F.lit(1).alias("_kind"), F.struct(*columns).alias("_row"))
        removals = self._table("removals")
        if removals is not None:
            # within a batch removals come first: a file that was replaced is there again
            gone = removals.select("_p", "batch", F.lit(0).alias("_kind"), F.lit(None).cast(seen.schema["_row"].dataType).alias("_row"))
            seen = seen.unionByName(gone)
        if before is not None:
            seen = seen.filter(F.col("batch") < before)
        last = seen.groupBy("_p").agg(F.max_by(F.struct("_kind", "_row"), F.struct("batch", "_kind")).alias("_last"))
        return last.filter(F.col("_last._kind") == 1).select("_last._row.*")

    def apply(self, arrivals: DataFrame | None, removed: DataFrame | None, batch: int) -> None:
        """Record a batch of new rows and removed ids, then rescore the groups it touched."""
        touched = None
        known = self.frames(before=batch)
        if removed is not None and known is not None:
            gone = removed.select(F.lower(F.col(self.id_col).cast("string")).alias("_p")).distinct()
            groups = known.join(gone, F.lower(F.col(self.id_col).cast("string")) == F.col("_p"), "left_semi")
            touched = groups.select(group_key("filter_name").alias("group_key"))
            gone.write.mode("overwrite").parquet(f"{self.state}/removals/batch={batch}")
        if arrivals is not None:
            rows = self.measure(arrivals).withColumn("_p", F.lower(F.col(self.id_col).cast("string")))
            rows.write.mode("overwrite").parquet(f"{self.state}/arrivals/batch={batch}")
            fresh = self.spark.read.parquet(f"{self.state}/arrivals/batch={batch}")
            keys = fresh.select(group_key("filter_name").alias("group_key"))
            if known is not None:  # a replaced file leaves its old group too
                same = F.lower(F.col(self.id_col).cast("string")) == F.col("_p")
                old = known.drop("_p").join(fresh.select("_p").distinct(), same, "left_semi")
                keys = keys.unionByName(old.select(group_key("filter_name").alias("group_key")))
            touched = keys if touched is None else touched.unionByName(keys)
        if touched is not None:
            self.rescore(touched.distinct(), batch)

    def rescore(self, touched: DataFrame, batch: int) -> None:
        """Recompute the scores of whole groups; ranks are relative, so one arrival moves all its peers."""
        now = self.frames(before=batch + 1)
        if now is None:
            return
        scores = touched_scores(now, touched, self.id_col, self.metrics)
        scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("group_part").parquet(
            f"{self.state}/scores"
        )

    def scored(self) -> DataFrame | None:
        """Current frames with their scores."""
        now, scores = self.frames(), self._table("scores")
        if now is None or scores is None:
            return None
        now = now.withColumn("group_key", group_key("filter_name"))
        return now.join(scores.select(self.id_col, "group_key", "score"), [self.id_col, "group_key"])

    def on_arrivals(self, batch_df: DataFrame, batch: int) -> None:
        """foreachBatch body for a stream of arrivals."""
        known = self.frames(before=batch)
        fresh = dedupe_arrivals(batch_df, known, self.id_col) if self.id_col == "path" else batch_df
        fresh = cut(fresh)
        if not fresh.isEmpty():
            self.apply(fresh, None, batch)

    def sweep(self, listing: DataFrame, batch: int, now: Column | None = None) -> None:
        """Compare a folder listing with the state: new, replaced and deleted files.

        A file too young to be complete is left for the next sweep.  A path deleted and
        created again is read again.
        """
        ready = settled(listing, now)
        known = self.frames(before=batch)
        if known is None:
            arrivals, removed = dedupe_arrivals(ready, None), None
        else:
            stamps = known.select(F.lower("path").alias("_k"), F.col("modificationTime").alias("_m"))
            unchanged = (F.lower("path") == F.col("_k")) & (F.col("modificationTime") == F.col("_m"))
            arrivals = dedupe_arrivals(ready.join(stamps, unchanged, "left_anti"), None)
            present = listing.select(F.lower("path").alias("_k"))
            removed = cut(known.join(present, F.lower("path") == F.col("_k"), "left_anti").select("path"))
            removed = None if removed.isEmpty() else removed
        arrivals = cut(arrivals)
        arrivals = None if arrivals.isEmpty() else arrivals
        if arrivals is not None or removed is not None:
            self.apply(arrivals, removed, batch)

    def on_changes(self, changes: DataFrame, batch: int) -> None:
        """foreachBatch body for a stream of `folder_source.folder_changes`; the checkpoint and the state belong together."""
        changes = cut(changes)
        arrived = changes.filter(F.col("change") == "arrived").drop("change")
        removed = changes.filter(F.col("change") == "removed").select("path")
        arrivals = None if arrived.isEmpty() else dedupe_arrivals(arrived, None)
        removed = None if removed.isEmpty() else removed
        if arrivals is not None or removed is not None:
            self.apply(arrivals, removed, batch)

    def start(
        self, roots: str | Sequence[str], recursive: bool = False, interval: str = "2 seconds", checkpoint: str | None = None,
        buckets: int = 64,
    ) -> StreamingQuery:
        """Watch folders until the query is stopped: tasks list them, batches run one at a time and carry what changed."""
        checkpoint = checkpoint or f"{self.state}/checkpoint"
        changes = folder_changes(self.spark, roots, f"{checkpoint}/listings", recursive, SETTLE_SECONDS, buckets)
        return (
            changes.writeStream.foreachBatch(self.on_changes).trigger(processingTime=interval)
            .option("checkpointLocation", checkpoint).start()
        )


def touched_scores(
    frames: DataFrame, touched: DataFrame, id_col: str, metrics: Sequence[ScoredMetric] = SCORED
) -> DataFrame:
    """Scores of all members of the touched groups."""
    members = frames.withColumn("group_key", group_key("filter_name")).join(touched, "group_key", "left_semi")
    scores = quality_score(members, id_col, F.col("group_key"), metrics)
    # folder names cannot be blank
    return scores.select(id_col, "group_key", "score", F.concat(F.lit("g_"), F.hex("group_key")).alias("group_part"))


class Progress(StreamingQueryListener):
    """Batches, rows and failures of running queries, at most one report per interval."""

    def __init__(self, report: Callable[[dict], None], interval: float = 0.15) -> None:
        self.report, self.interval, self.last = report, interval, 0.0
        self.state = {"batches": 0, "rows": 0, "failed": 0, "active": 0}

    def onQueryStarted(self, event) -> None:
        self.state["active"] += 1

    def onQueryProgress(self, event) -> None:
        self.state["batches"] += 1
        self.state["rows"] += max(0, event.progress.numInputRows)
        if time.monotonic() - self.last >= self.interval:
            self.last = time.monotonic()
            self.report(dict(self.state))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.state["active"] -= 1
        self.state["failed"] += event.exception is not None
        self.report(dict(self.state))


def load_progress(df: DataFrame, total: int, status: str = "status") -> DataFrame:
    """completed, loaded, skipped and left of a load with a known number of files."""
    return df.agg(
        F.count(F.lit(1)).alias("completed"), F.count_if(F.col(status) == "loaded").alias("loaded"),
        F.count_if(F.col(status) != "loaded").alias("skipped"), (F.lit(total) - F.count(F.lit(1))).alias("left"),
    )
