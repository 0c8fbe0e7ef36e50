"""Results written out: metrics reports and the moves themselves."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightsieve.functions.display import fixed, or_na
from nightsieve.operators.moves import destination_folders, move_manifest
from nightsieve.sources.files import arrow_path, files_in

# Columns of a report line, in order.
REPORT_COLUMNS = [
    "file_name", "fwhm", "fwhm_arcsec", "star_count", "hfr", "eccentricity", "mean_background", "focal_mm", "pixel_um",
    "trail_confidence", "is_rejected",
]


def metrics_report(df: DataFrame, path: str, fmt: str = "csv", partition_by: Sequence[str] = ("group_key",), mode: str = "errorifexists") -> None:
    """One row per frame, written in parallel and partitioned by group; a folder that is there is an error unless `mode` says so."""
    columns = [c for c in (*REPORT_COLUMNS, *partition_by) if c in df.columns]
    writer = df.select(*columns).write.mode(mode)
    by = [c for c in partition_by if c in df.columns]
    writer = writer.partitionBy(*by) if by else writer
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def report_lines(df: DataFrame) -> DataFrame:
    """The text line of each frame."""
    text = F.concat(
        F.col("file_name"), F.lit(": FWHM="), fixed("fwhm", 2), F.lit("px FWHM\"="), or_na(fixed("fwhm_arcsec", 2)),
        F.lit(" Stars="), F.col("star_count").cast("string"), F.lit(" HFR="), fixed("hfr", 2), F.lit(" Ecc="),
        fixed("eccentricity", 3), F.lit(" BG="), fixed("mean_background", 1), F.lit(" Trail="),
        F.col("trail_confidence").cast("string"), F.lit("% Reject="), F.initcap(F.col("is_rejected").cast("string")),
    )
    return df.select("file_name", text.alias("line"))


def _move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    missing = pyarrow.fs.FileType.NotFound
    for batch in batches:
        states = []
        for source, target in zip(batch["path"], batch["destination"]):
            try:
                system, inner = arrow_path(source)
                _, goal = arrow_path(target)
                here, there = system.get_file_info([inner, goal])
                if here.type == missing:
                    states.append("moved" if there.type != missing else "missing")
                elif there.type != missing:
                    states.append("occupied")
                else:
                    system.create_dir(goal.rsplit("/", 1)[0], recursive=True)
                    system.move(inner, goal)
                    states.append("moved")
            except OSError as error:
                states.append(f"failed: {error}")
        yield batch.assign(status=states)


def execute_moves(manifest: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Move each (path, destination); a retried task finds a finished move and reports it as such."""
    kept = "".join(f", `{c}` {manifest.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"path string, destination string{kept}, status string"
    return manifest.select("path", "destination", *keep).mapInPandas(_move, schema)


def _journal(spark: SparkSession, path: str, columns: str) -> DataFrame:
    try:
        return spark.read.schema(columns).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], columns)


PLANNED, DONE = "run string, path string, destination string", "run string, path string, destination string, status string"


def finish_moves(spark: SparkSession, journal: str) -> DataFrame:
    """Carry out the planned moves of a journal that have no result yet, and give these results.

    Names come from the journal, so a lost task, a second attempt or a new driver moves each file to the place planned first.
    """
    planned, done = _journal(spark, f"{journal}/planned", PLANNED), _journal(spark, f"{journal}/done", DONE)
    open_runs = planned.join(done, ["run", "path"], "left_anti")
    runs = [r[0] for r in open_runs.select("run").distinct().collect()]  # a handful: runs that were broken off
    # the names leave the table and come back, for the results of the moves are put down beside them
    results = execute_moves(open_runs.select("path", "destination", "run"), ["run"])
    if runs:
        results.select("run", "path", "destination", "status").write.mode("append").parquet(f"{journal}/done")
    return _journal(spark, f"{journal}/done", DONE).filter(F.col("run").isin(runs))


def move_frames(frames: DataFrame, destination: str, journal: str, id_col: str = "path") -> DataFrame:
    """Move the rejected frames below the destination; (path, destination, status) of each move.

    The journal, a folder that executors share, holds what is planned and what is done: (1) moves that an earlier run planned
    and did not finish are finished, (2) what lies in the folders at the destination is listed and names planned against them, (3) the plan
    is written, (4) files move by it.  Names taken by somebody else between (2) and (4) are planned again.
    """
    spark, out = frames.sparkSession, None
    finish_moves(spark, journal)
    left = frames
    while True:
        run = uuid.uuid4().hex
        existing = files_in(destination_folders(left, destination))
        manifest = move_manifest(left, destination, id_col=id_col, existing=existing)
        planned = manifest.select(F.lit(run).alias("run"), F.col(id_col).alias("path"), "destination")
        planned.write.mode("append").parquet(f"{journal}/planned")
        results = finish_moves(spark, journal)
        settled = results.filter("status <> 'occupied'").drop("run")
        out = settled if out is None else out.unionByName(settled)
        taken = results.filter("status = 'occupied'").select(F.col("path").alias(id_col))
        if taken.isEmpty():
            return out
        left = frames.join(taken, id_col, "left_semi")
