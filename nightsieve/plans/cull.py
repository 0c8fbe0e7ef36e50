"""The batch run: discover, measure, judge, report, move."""

from __future__ import annotations

import argparse
import sys
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightsieve.operators import scoring, slabs, thresholds
from nightsieve.operators.moves import destination_folders, move_manifest
from nightsieve.schema import Limits, limits_table
from nightsieve.session import cut, ensure_checkpoint_dir
from nightsieve.sources import files, fits, reports


@dataclass(frozen=True)
class CullOptions:
    """What a batch run needs; limits apply to all groups unless given per group."""

    input: str = ""
    rejected: str = ""
    limits: dict[str, Limits] = field(default_factory=lambda: {"": Limits.manual()})
    recursive: bool = False
    light_only: bool = True
    report: str | None = None
    report_format: str = "csv"
    overwrite_report: bool = False
    move: bool = True
    #: Folder of planned and finished moves; named, a run that was broken off is finished by the next.
    journal: str | None = None

    @staticmethod
    def parse(args: Sequence[str]) -> CullOptions:
        """Options of a command line; limits that are not numbers keep their defaults."""
        parser = argparse.ArgumentParser(prog="cull", allow_abbrev=False)
        for name in ("--input", "--rejected", "--report", "--journal"):
            parser.add_argument(name, default="")
        for name in ("--max-fwhm", "--max-hfr", "--max-ecc", "--max-bg"):
            parser.add_argument(name, default=None)
        for name in ("--headless", "--allow-trails", "--recursive", "--dry-run", "--overwrite-report"):
            parser.add_argument(name, action="store_true")
        known, _ = parser.parse_known_args(list(args))
        chosen = {}
        for option, column in (("max_fwhm", "max_fwhm"), ("max_hfr", "max_hfr"), ("max_ecc", "max_eccentricity"), ("max_bg", "max_mean_background")):
            try:
                chosen[column] = float(getattr(known, option))
            except (TypeError, ValueError):
                continue
        if known.allow_trails:
            chosen["min_trail"] = 0
        return CullOptions(
            known.input, known.rejected, {"": Limits.manual(**chosen)}, known.recursive, report=known.report or None,
            move=not known.dry_run, journal=known.journal or None, overwrite_report=known.overwrite_report,
        )


def measured_frames(spark: SparkSession, options: CullOptions) -> tuple[DataFrame, DataFrame]:
    """(headers with status, metrics of the usable frames); files are read as slabs, twice."""
    header = cut(fits.header_table(files.discover_files(spark, options.input, options.recursive)))
    usable = header.filter("status = 'loaded'" if options.light_only else "error is null")
    metrics, broken = slabs.measured_frames(fits.luminance_slabs(usable, halo=slabs.HALO), usable, ["path"])
    header = header.join(broken.withColumnRenamed("error", "_late"), "path", "left").withColumns({
        "status": F.when(F.col("_late").isNotNull(), "error").otherwise(F.col("status")),
        "error": F.coalesce("error", "_late"),
    }).drop("_late")
    return header, metrics


def judged_frames(metrics: DataFrame, options: CullOptions) -> DataFrame:
    """Metrics with score, verdict, reasons and relative path."""
    scored = scoring.with_score(metrics, "path")
    limits = limits_table(metrics.sparkSession, options.limits)
    judged = thresholds.apply_thresholds(scored, limits, peers=metrics)
    return judged.withColumn("relative_path", files.relative_path(F.regexp_replace("path", "^file:/+", "/"), options.input))


def cull_session(spark: SparkSession, options: CullOptions) -> tuple[int, dict[str, DataFrame]]:
    """(exit code, tables): 2 when folders are missing, 0 else.

    Tables: load_report, frames (judged), moves.
    """
    if not options.input.strip() or not options.rejected.strip():
        return 2, {}
    if options.move and options.journal:
        reports.finish_moves(spark, options.journal)  # before anything is listed
    header, metrics = measured_frames(spark, options)
    if header.isEmpty():
        return 0, {}
    frames = cut(judged_frames(cut(metrics), options))
    if options.report:
        reports.metrics_report(frames, options.report, options.report_format, mode="overwrite" if options.overwrite_report else "errorifexists")
    if options.move:
        journal = options.journal or f"{ensure_checkpoint_dir(spark)}/moves-{uuid.uuid4().hex}"
        moves = reports.move_frames(frames, options.rejected, journal)
    else:
        existing = files.files_in(destination_folders(frames, options.rejected))
        moves = move_manifest(frames, options.rejected, id_col="path", existing=existing)
    return 0, {"load_report": files.load_report(header), "frames": frames, "moves": moves}


def main(args: Sequence[str] | None = None) -> int:
    options = CullOptions.parse(sys.argv[1:] if args is None else args)
    spark = SparkSession.builder.appName("cull").getOrCreate()
    code, tables = cull_session(spark, options)
    if code == 2:
        print("needs --input and --rejected", file=sys.stderr)
    for name in ("load_report", "moves"):
        if name in tables:
            tables[name].show(50, truncate=False)
    return code


if __name__ == "__main__":
    raise SystemExit(main())
