"""Finding frame files and taking their paths apart."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightsieve.operators.sets import union_sources

# File kinds by extension, and the same as a case-insensitive glob.
FITS_EXTENSIONS = ["fit", "fits"]
XISF_EXTENSIONS = ["xisf"]
FRAME_GLOB = "*.{[fF][iI][tT],[fF][iI][tT][sS],[xX][iI][sS][fF]}"
LISTING = "path string, modificationTime timestamp, length bigint"


def split_roots(roots: str | Sequence[str]) -> list[str]:
    """Folders of a `;` separated list, blanks dropped."""
    items = roots.split(";") if isinstance(roots, str) else list(roots)
    return [r.strip() for r in items if r.strip()]


def discover_files(spark: SparkSession, roots: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """(path, modificationTime, length) of the frame files below the roots.

    Missing roots are skipped, a path seen twice (ignoring case) is kept once, and
    the list is in path order.  Only the listing is read, never file contents.
    """
    found = []
    for root in split_roots(roots):
        reader = spark.read.format("binaryFile").option("pathGlobFilter", FRAME_GLOB)
        try:
            listing = reader.option("recursiveFileLookup", str(recursive).lower()).load(root)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        found.append(listing.select("path", "modificationTime", "length"))
    if not found:
        return spark.createDataFrame([], LISTING)
    return in_path_order(union_sources(found).drop("source"))


def arrow_path(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path and the path in it; without a scheme it is local."""
    uri = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
    return (pyarrow.fs.LocalFileSystem(), uri) if "://" not in uri else pyarrow.fs.FileSystem.from_uri(uri)


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for folder in batch["folder"]:
            system, inner = arrow_path(folder)
            found = system.get_file_info(pyarrow.fs.FileSelector(inner, allow_not_found=True))
            yield pd.DataFrame({"path": [f"{folder}/{info.base_name}" for info in found]}, dtype=object)


def files_in(folders: DataFrame) -> DataFrame:
    """(path) of all that lies directly in each `folder`, empty and hidden files and folders too; none where it does not exist.

    Spark's own listing leaves empty and hidden files out, and a name is taken by those as well.  Each folder is listed in a task.
    """
    return folders.filter("folder is not null").select("folder").distinct().mapInPandas(_entries, "path string")


def in_path_order(df: DataFrame, path: str = "path") -> DataFrame:
    return df.orderBy(F.lower(path), path)


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column | str) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def extension(path: Column | str) -> Column:
    """Lower-case extension without the dot, '' when there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))


def path_parts(df: DataFrame, path: str = "path") -> DataFrame:
    """file_name, extension, reader kind and, for unsupported files, an error text."""
    ext = extension(path)
    kind = F.when(ext.isin(FITS_EXTENSIONS), "fits").when(ext.isin(XISF_EXTENSIONS), "xisf").otherwise("unsupported")
    return df.withColumns({"file_name": file_name(path), "extension": ext, "kind": kind}).withColumn(
        "error", F.when(F.col("kind") == "unsupported", F.concat(F.lit("unsupported extension: "), F.col("extension")))
    )


def relative_path(path: Column | str, roots: str | Sequence[str]) -> Column:
    """Folder of the file below its longest matching root, null at the root itself or outside all roots."""
    folder = directory(path)
    result = F.lit(None).cast("string")
    cleaned = [r.rstrip("/") for r in split_roots(roots)]
    for root in sorted((r for r in cleaned if r), key=len):
        inside = F.startswith(F.lower(folder), F.lit(root.lower() + "/"))
        result = F.when(inside, F.substring(folder, len(root) + 2, 1 << 30)).otherwise(result)
    return result


def load_report(df: DataFrame, status: str = "status") -> DataFrame:
    """Total, loaded, skipped and failed counts of a load."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(status) == "loaded").alias("loaded"),
        F.count_if(F.col(status) != "loaded").alias("skipped"),
        F.count_if(F.col(status) == "error").alias("errors"),
    )
