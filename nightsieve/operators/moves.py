"""Where rejected files go."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightsieve.functions.keys import labelled_key, normalize_key
from nightsieve.plans.ranges import row_index
from nightsieve.sources.files import directory, file_name

SUFFIX = "_([0-9]{1,9})$"


def _folder(destination: str, relative: str) -> Column:
    below = F.concat_ws("/", F.lit(destination), F.col(relative))
    return F.when(normalize_key(relative) == "", F.lit(destination)).otherwise(below)


def destination_folders(df: DataFrame, destination: str, relative: str = "relative_path", rejected: str = "is_rejected") -> DataFrame:
    """(folder) of the rejected rows, each once; none for a blank destination."""
    chosen = df.filter(F.col(rejected) & F.lit(bool(destination.strip())))
    return chosen.select(_folder(destination, relative).alias("folder")).distinct()


def _named(df: DataFrame, ids: Sequence[str], folder: Column, name: Column) -> DataFrame:
    """ids, folder and name, the place ignoring case, and the family: all names that differ only in a final `_<number>`."""
    stem, dot = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    number = F.regexp_extract(stem, SUFFIX, 1)
    placed = df.select(
        *ids, name.alias("_name"), folder.alias("_folder"), F.regexp_replace(stem, SUFFIX, "").alias("_root"), dot.alias("_dot"),
        F.coalesce(number.try_cast("int"), F.lit(0)).alias("_taken"),
    )
    placed = placed.withColumn("_place", F.lower(F.concat_ws("/", "_folder", "_name")))
    return placed.withColumn("_family", F.lower(F.concat(F.col("_folder"), F.lit("/"), F.col("_root"), F.col("_dot"))))


def move_manifest(
    df: DataFrame,
    destination: str,
    filter_keys: Sequence[str] | None = None,
    id_col: str = "frame_id",
    name: str = "file_name",
    relative: str = "relative_path",
    filter_col: str = "filter_name",
    rejected: str = "is_rejected",
    existing: DataFrame | None = None,
) -> DataFrame:
    """(id, destination) of each rejected row, folder structure kept.

    `existing` has the `path` of every file in the folders of the destination (`files.files_in`), null paths count for nothing.
    Of files that would meet at one place, ignoring case, the first in id order keeps its name unless a file is there, and the
    others get `_1`, `_2`, ...: numbers above all that names of the same stem have, moved or there before, so every name is
    free, no two rows share a destination, and a second run over the same tables names them alike.  A blank destination
    moves nothing.
    """
    chosen = df.filter(F.col(rejected) & F.lit(bool(destination.strip())))
    if filter_keys is not None:
        chosen = chosen.filter(labelled_key(filter_col, "(no filter)", trimmed=False).isin(list(filter_keys)))
    placed = _named(chosen, [id_col], _folder(destination, relative), F.col(name)).withColumn("_there", F.lit(False))
    families = placed.select("_family", "_taken")
    if existing is not None:
        there = _named(existing.filter("path is not null"), [], directory("path"), file_name("path"))
        # one row a place: names that differ in case alone must not double a moved row
        places = there.select("_place").distinct().withColumn("_there", F.lit(True))
        placed = placed.drop("_there").join(places, "_place", "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
        # only numbers of families that move are looked at
        families = families.unionByName(there.join(placed.select("_family").distinct(), "_family", "left_semi").select("_family", "_taken"))
    numbered = row_index(placed, [(id_col, "asc")], keys=["_place"], out="_n")
    first = (F.col("_n") == 0) & ~F.col("_there")
    kept = numbered.filter(first).select(id_col, F.concat_ws("/", "_folder", "_name").alias("destination"))
    again = row_index(numbered.filter(~first), [(id_col, "asc")], keys=["_family"], out="_m")
    top = families.groupBy("_family").agg(F.max("_taken").alias("_top"))
    free = (F.col("_top") + F.col("_m") + 1).cast("string")
    renamed = F.concat(F.col("_folder"), F.lit("/"), F.col("_root"), F.lit("_"), free, F.col("_dot"))
    return kept.unionByName(again.join(top, "_family").select(id_col, renamed.alias("destination")))
