"""Session documents and settings profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightsieve.functions.keys import normalize_key
from nightsieve.operators.sets import dedupe_keep_first
from nightsieve.plans.ranges import row_index
from nightsieve.schema import AUTO_COLUMNS, CLAUSES, LIMIT_COLUMNS, LIMITS_SCHEMA

# Field names of the document's limits.
LIMIT_FIELDS = {
    "max_fwhm": "MaxFwhm", "max_fwhm_arcsec": "MaxFwhmArcsec", "min_sqm": "MinSqm", "max_sky_temp": "MaxSkyTemp",
    "max_hfr": "MaxHfr", "max_eccentricity": "MaxEccentricity", "max_mean_background": "MaxMeanBackground",
    "min_stars": "MinStars", "min_trail": "MinSatelliteConfidence", "min_score": "MinScore",
}
AUTO_FIELDS = {
    "auto_fwhm": "AutoCalcFwhmThreshold", "auto_fwhm_arcsec": "AutoCalcFwhmArcsecThreshold",
    "auto_sqm": "AutoCalcSqmThreshold", "auto_sky_temp": "AutoCalcSkyTempThreshold",
    "auto_hfr": "AutoCalcHfrThreshold", "auto_eccentricity": "AutoCalcEccentricityThreshold",
    "auto_mean_background": "AutoCalcMeanBackgroundThreshold", "auto_stars": "AutoCalcStarsThreshold",
    "auto_trail": "AutoCalcTrailThreshold", "auto_score": "AutoCalcScoreThreshold",
}
# Field names of the document's frames -> frames columns.
FRAME_FIELDS = {
    "FilePath": ("path", "string"), "FileName": ("file_name", "string"), "RelativePath": ("relative_path", "string"),
    "AutoRejected": ("auto_rejected", "boolean"), "ManualRejectedOverride": ("manual_override", "boolean"),
    "OverallScore": ("score", "double"), "Fwhm": ("fwhm", "double"), "FwhmArcsec": ("fwhm_arcsec", "double"),
    "Sqm": ("sqm", "double"), "SkyTemp": ("sky_temp", "double"), "Hfr": ("hfr", "double"),
    "StarCount": ("star_count", "bigint"), "Eccentricity": ("eccentricity", "double"),
    "MeanBackground": ("mean_background", "double"), "Median": ("median", "double"), "Mad": ("mad", "double"),
    "Min": ("min", "double"), "MinCount": ("min_count", "bigint"), "Max": ("max", "double"),
    "MaxCount": ("max_count", "bigint"), "SatelliteTrailConfidence": ("trail_confidence", "int"),
    "TrailX1": ("trail_x1", "double"), "TrailY1": ("trail_y1", "double"), "TrailX2": ("trail_x2", "double"),
    "TrailY2": ("trail_y2", "double"), "ExposureDateTime": ("exposure_ts", "timestamp"),
    "ExposureSeconds": ("exposure_s", "double"), "FilterName": ("filter_name", "string"),
    "FocalLengthMm": ("focal_mm", "double"), "PixelSizeUm": ("pixel_um", "double"), "Width": ("width", "int"),
    "Height": ("height", "int"), "Rotate180": ("rotate180", "boolean"), "ShiftX": ("shift_x", "int"),
    "ShiftY": ("shift_y", "int"), "NormalizationMax": ("norm_max", "double"),
}

_ROI = "struct<Left:double,Top:double,Width:double,Height:double>"
_LIMITS = ",".join(
    f"{name}:{LIMITS_SCHEMA[column].dataType.simpleString()}" for column, name in LIMIT_FIELDS.items()
)
_AUTO = ",".join(f"{name}:boolean" for name in AUTO_FIELDS.values())
_FRAMES = ",".join(f"{name}:{kind}" for name, (_, kind) in FRAME_FIELDS.items())
SESSION_DDL = (
    f"Version:int,SavedAt:timestamp,InputFolder:string,RejectedFolder:string,IncludeSubfolders:boolean,{_LIMITS},"
    "RejectSatelliteTrail:boolean,StfShadows:double,StfMidtones:double,StfHighlights:double,StfTargetBackground:double,"
    f"AutoStretchPerFrame:boolean,ManualRoi:{_ROI},SortRules:array<struct<Field:string,Direction:string>>,"
    f"FilterChips:array<struct<Key:string,IsSelected:boolean>>,FilterThresholds:array<struct<Key:string,{_LIMITS},{_AUTO}>>,"
    f"ShowAccepted:boolean,ShowRejected:boolean,Frames:array<struct<{_FRAMES}>>"
)


def session_schema() -> T.StructType:
    return T.StructType.fromDDL(SESSION_DDL)


def session_read(spark: SparkSession, path: str) -> DataFrame | None:
    """One row per document part; None when there is no such session."""
    try:
        return spark.read.schema(session_schema()).option("multiLine", True).json(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def parse_sessions(df: DataFrame, text: str, out: str = "doc") -> DataFrame:
    """Session documents held as text, parsed into one struct column."""
    return df.withColumn(out, F.from_json(text, session_schema()))


def session_settings(df: DataFrame, doc: str | None = None) -> DataFrame:
    """Scalar settings with the defaults of fields an old document lacks."""
    at = (lambda n: F.col(f"{doc}.{n}")) if doc else F.col
    keep = [c for c in df.columns if doc and c != doc]
    return df.select(
        *keep,
        F.coalesce(at("Version"), F.lit(1)).alias("version"),
        F.coalesce(at("IncludeSubfolders"), F.lit(False)).alias("recursive"),
        F.coalesce(at("ShowAccepted"), F.lit(True)).alias("show_accepted"),
        F.coalesce(at("ShowRejected"), F.lit(True)).alias("show_rejected"),
        F.coalesce(at("RejectSatelliteTrail"), F.lit(False)).alias("reject_trail"),
        F.coalesce(F.size(at("Frames")), F.lit(0)).alias("n_frames"),
    )


def _limits_of(row: Column | None, default_auto: bool) -> list[Column]:
    """Limits of one document entry; missing numbers are 0, an arcsecond limit of 0 or less is 20."""
    at = (lambda n: row[n]) if row is not None else F.col
    columns = []
    for c in CLAUSES:
        value = F.coalesce(at(LIMIT_FIELDS[c.limit]), F.lit(0).cast(LIMITS_SCHEMA[c.limit].dataType))
        if c.limit == "max_fwhm_arcsec":
            value = F.when(value > 0, value).otherwise(F.lit(20.0))
        columns.append(value.alias(c.limit))
    for name in AUTO_COLUMNS:
        auto = F.lit(True) if row is None or not default_auto else F.coalesce(row[AUTO_FIELDS[name]], F.lit(True))
        columns.append(auto.alias(name))
    return columns


def session_thresholds(df: DataFrame, doc: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys…, group_key, limits…) of each document.

    A document without per-group limits is an old one: its single set becomes the ''
    row.  With per-group limits but no '' row, the first entry's limits fill it.
    """
    prefix = f"{doc}." if doc else ""
    listed = F.coalesce(F.size(f"{prefix}FilterThresholds"), F.lit(0)) > 0
    entries = df.filter(listed).select(*keys, F.posexplode(f"{prefix}FilterThresholds").alias("_i", "_t"))
    grouped = entries.select(
        *keys, "_i", F.lower(normalize_key(F.col("_t.Key"))).alias("group_key"), *_limits_of(F.col("_t"), True)
    )
    names = ["group_key", *LIMIT_COLUMNS, *AUTO_COLUMNS]
    last = grouped.groupBy(*keys, "group_key").agg(F.max_by(F.struct(*names[1:]), "_i").alias("_r"))
    last = last.select(*keys, "group_key", "_r.*")
    base = grouped.groupBy(*keys).agg(
        F.max(F.col("group_key") == "").alias("_has"), F.min_by(F.struct(*names[1:]), "_i").alias("_r")
    ).filter(~F.col("_has")).select(*keys, F.lit("").alias("group_key"), "_r.*")
    old = df.filter(~listed)
    flat = old.select(*keys, f"{doc}.*") if doc else old
    legacy = flat.select(*keys, F.lit("").alias("group_key"), *_limits_of(None, False))
    return last.unionByName(base).unionByName(legacy)


def session_frames(df: DataFrame, doc: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """One row per frame of each document, under the frames table's names."""
    entry = F.explode(f"{doc}.Frames" if doc else "Frames").alias("_f")
    return df.select(*keys, entry).select(
        *keys, *[F.col(f"_f.{name}").alias(column) for name, (column, _) in FRAME_FIELDS.items()]
    )


def session_chips(df: DataFrame) -> DataFrame:
    return df.select(F.explode("FilterChips").alias("c")).select(
        F.col("c.Key").alias("key"), F.col("c.IsSelected").alias("selected")
    )


def session_sort_rules(df: DataFrame) -> DataFrame:
    return df.select(F.posexplode("SortRules").alias("position", "r")).select(
        "position", F.col("r.Field").alias("field"),
        F.when(F.lower("r.Direction").startswith("desc"), "desc").otherwise("asc").alias("direction"),
    )


def document_parts(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], part_rows: int = 10_000
) -> DataFrame:
    """(keys…, part, entries): rows nested as arrays of at most `part_rows` structs.

    A session of any length becomes several parts, so no task holds it whole.
    """
    indexed = row_index(df, list(order), list(keys), out="_i")
    part = indexed.withColumn("part", F.floor(F.col("_i") / part_rows))
    entries = F.array_sort(F.collect_list(F.struct("_i", F.struct(*columns).alias("e"))))
    return part.groupBy(*keys, "part").agg(F.transform(entries, lambda x: x["e"]).alias("entries"))


def session_write(
    frames: DataFrame, path: str, settings: dict[str, Column] | None = None, order: str = "path", part_rows: int = 10_000
) -> None:
    """Write the session as JSON, one document per part, each with the settings."""
    present = {name: column for name, (column, _) in FRAME_FIELDS.items() if column in frames.columns}
    renamed = frames.select(*[F.col(column).alias(name) for name, column in present.items()])
    sort = next(name for name, column in present.items() if column == order)
    parts = document_parts(renamed, [], [sort], list(present), part_rows)
    values = {"Version": F.lit(1), "SavedAt": F.current_timestamp()} | (settings or {})
    parts.select(
        *[value.alias(name) for name, value in values.items()], F.col("entries").alias("Frames")
    ).write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def nested_roundtrip(df: DataFrame, keys: Sequence[str], order: Sequence[str], part_rows: int = 1000) -> DataFrame:
    """Rows -> JSON text per group part -> rows again."""
    columns = [c for c in df.columns if c not in keys]
    parts = document_parts(df, keys, order, columns, part_rows)
    text = parts.select(*keys, F.to_json("entries").alias("doc"))
    schema = T.ArrayType(T.StructType([df.schema[c] for c in columns]))
    return text.select(*keys, F.inline(F.from_json("doc", schema)))


def profiles_read(
    profiles: DataFrame, settings: DataFrame, owner: str, name: str = "name", order: str = "ord", default: str = "default_name"
) -> DataFrame:
    """(owner, name, position, is_default, columns…): a cleaned profile list.

    Names are trimmed, blanks become 'Default', the first of equal names (ignoring
    case) stays, an owner without profiles gets 'Default', and a default name that
    no profile has falls back to the first profile.
    """
    clean = F.when(normalize_key(name) == "", F.lit("Default")).otherwise(normalize_key(name))
    named = profiles.withColumn(name, clean)
    unique = dedupe_keep_first(named, F.col(name), [order], [owner])
    empty = settings.join(unique.select(owner).distinct(), owner, "left_anti").select(
        owner, F.lit("Default").alias(name), F.lit(0).cast("bigint").alias(order)
    )
    full = unique.unionByName(empty, allowMissingColumns=True)
    wanted = F.when(normalize_key(default) == "", F.lit("Default")).otherwise(normalize_key(default))
    chosen = (
        full.join(settings.select(owner, wanted.alias("_wanted")), owner)
        .groupBy(owner).agg(
            F.min_by(name, F.struct(F.lower(name) != F.lower("_wanted"), F.col(order))).alias("_default")
        )
    )
    return full.join(chosen, owner).withColumn("is_default", F.col(name) == F.col("_default")).drop("_default")


def profile_apply(
    group_rows: DataFrame, single_rows: DataFrame, profile: str, owner: str, name: str = "name", key: str = "group_key"
) -> DataFrame:
    """Limits of the named profile: its per-group rows, and its single set as the '' row where they lack one."""
    same = F.lower(name) == F.lit(profile.strip().lower())
    chosen = group_rows.filter(same).withColumn(key, F.lower(normalize_key(key)))
    base = single_rows.filter(same).withColumn(key, F.lit(""))
    lacking = base.join(chosen.filter(F.col(key) == "").select(owner), owner, "left_anti")
    return chosen.unionByName(lacking, allowMissingColumns=True)
