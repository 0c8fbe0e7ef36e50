"""Watched folders as a streaming source: `spark.readStream.format("frame_folder")` tells which frame files came and went.

    folder_source.register(spark)
    changes = spark.readStream.format("frame_folder").option("state", "hdfs://…/watch").load("/data/in;/data/more")

Rows are (path, modificationTime, length, change); `change` is `arrived` (new, or with another time or length) or `removed`.

Every trigger is one offset, a number.  Folders are dealt to `buckets` (64) partitions by name; a task lists its folders, writes
what it found to `state` as `<bucket>-<offset>.parquet`, and gives the difference to the last listing there.  An offset that runs again
after a failure finds its listing and gives the same rows; a bucket that was not read at some offset is compared with the last
one that was.  The driver lists only `state` and, with `recursiveFileLookup`, reads the names of subfolders from the footers
there, so a new level of folders is seen one trigger later.  Listings that no later offset needs are removed when an offset is committed.

Defined results: a file younger than `settleSeconds` (1.5) waits for a later offset, and so does its replacement; a missing folder
is empty, any other failure of a listing fails the batch, so it never passes for removals.  Hidden names (`.`, `_`) and other kinds of
files are left out.  Paths come back in Spark's form.  A folder is listed by one task.  `state` is a folder that all executors share, without a
scheme a local one.  Speculative copies of a task may list at slightly different moments: keep speculation off.
"""

from __future__ import annotations

import json
import re
import time
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from nightsieve.shipping import ship
from nightsieve.sources.files import FITS_EXTENSIONS, XISF_EXTENSIONS, arrow_path, split_roots

NAME = "frame_folder"
SCHEMA = "path string, modificationTime timestamp, length bigint, change string"
LISTED = pa.schema([("path", pa.string()), ("ms", pa.int64()), ("length", pa.int64())])
CHANGES = pa.schema([
    ("path", pa.string()), ("modificationTime", pa.timestamp("us", tz="UTC")), ("length", pa.int64()), ("change", pa.string()),
])
_FILE = re.compile(r"(\d+)-(\d+)\.parquet")


@dataclass
class Bucket(InputPartition):
    """The folders of a bucket, the listing before (None: none yet) and the listing to make or find."""

    folders: tuple[str, ...]
    before: str | None
    after: str

    def __init__(self, folders: Sequence[str], before: str | None, after: str):
        self.folders, self.before, self.after = tuple(folders), before, after


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.roots = split_roots(options.get("path", ""))
        self.state = options.get("state", "").rstrip("/")
        if not self.roots or not self.state:
            raise ValueError("frame_folder needs a path and the option state")
        self.recursive = options.get("recursivefilelookup", "false").lower() == "true"
        self.buckets = int(options.get("buckets", "64"))
        self.settle = float(options.get("settleseconds", "1.5"))

    def initialOffset(self) -> dict:
        return {"tick": 0}

    def latestOffset(self) -> dict:
        return {"tick": max((tick for _, tick in self._listings()), default=0) + 1}

    def _listings(self) -> list[tuple[int, int]]:
        """(bucket, tick) of the listings in the state folder."""
        system, inner = arrow_path(self.state)
        found = system.get_file_info(pyarrow.fs.FileSelector(inner, allow_not_found=True))
        named = (_FILE.fullmatch(info.base_name) for info in found)
        return [(int(m[1]), int(m[2])) for m in named if m]

    def _name(self, bucket: int, tick: int) -> str:
        return f"{self.state}/{bucket}-{tick}.parquet"

    def _last(self, upto: int) -> dict[int, int]:
        """The last listing of each bucket up to an offset."""
        last: dict[int, int] = {}
        for bucket, tick in self._listings():
            if last.get(bucket, 0) < tick <= upto:
                last[bucket] = tick
        return last

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        last = self._last(start["tick"])
        folders = {root.rstrip("/") or "/" for root in self.roots}
        if self.recursive:
            for bucket, tick in last.items():
                system, inner = arrow_path(self._name(bucket, tick))
                folders.update(json.loads(pyarrow.parquet.read_schema(inner, filesystem=system).metadata[b"folders"]))
        dealt: list[list[str]] = [[] for _ in range(self.buckets)]
        for folder in sorted(folders):
            dealt[zlib.crc32(folder.encode()) % self.buckets].append(folder)
        return [
            Bucket(dealt[b], self._name(b, last[b]) if b in last else None, self._name(b, end["tick"]))
            for b in range(self.buckets) if dealt[b] or b in last
        ]

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        before = _stamps(partition.before) if partition.before else {}
        after = _stamps(partition.after)
        if after is None:
            after = self._list(partition, before)
        rows = [(p, s, "arrived") for p, s in after.items() if before.get(p) != s]
        rows += [(p, s, "removed") for p, s in before.items() if p not in after]
        columns = [
            [p for p, _, _ in rows], [ms * 1000 for _, (ms, _), _ in rows], [length for _, (_, length), _ in rows], [c for _, _, c in rows],
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, field.type) for c, field in zip(columns, CHANGES)], schema=CHANGES)

    def _list(self, partition: Bucket, before: dict[str, tuple[int, int]]) -> dict[str, tuple[int, int]]:
        """List the folders of a bucket and keep the listing."""
        newest, seen, below = time.time() - self.settle, {}, []
        for folder in partition.folders:
            system, inner = arrow_path(folder)
            for info in system.get_file_info(pyarrow.fs.FileSelector(inner, allow_not_found=True)):
                path = f"{_spark_form(folder)}/{info.base_name}"
                if info.base_name.startswith((".", "_")):
                    continue
                if info.type == pyarrow.fs.FileType.Directory:
                    below.append(path)
                elif info.base_name.lower().rpartition(".")[2] in FITS_EXTENSIONS + XISF_EXTENSIONS:
                    stamp = ((info.mtime_ns or 0) // 1_000_000, info.size or 0)
                    stamp = stamp if stamp[0] <= newest * 1000 else before.get(path)
                    if stamp is not None:
                        seen[path] = stamp
        table = pa.table([list(seen), [s[0] for s in seen.values()], [s[1] for s in seen.values()]], schema=LISTED)
        system, inner = arrow_path(partition.after)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        scratch = f"{inner}.{uuid.uuid4().hex}"
        pyarrow.parquet.write_table(table.replace_schema_metadata({"folders": json.dumps(below)}), scratch, filesystem=system)
        system.move(scratch, inner)
        return seen

    def commit(self, end: dict) -> None:
        needed = self._last(end["tick"])
        for bucket, tick in self._listings():
            if tick < needed.get(bucket, 0):
                system, inner = arrow_path(self._name(bucket, tick))
                system.delete_file(inner)


def _spark_form(folder: str) -> str:
    return folder if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", folder) else f"file:{folder}"


def _stamps(listing: str) -> dict[str, tuple[int, int]] | None:
    """path -> (milliseconds, length) of a kept listing; None if there is none."""
    system, inner = arrow_path(listing)
    if system.get_file_info(inner).type == pyarrow.fs.FileType.NotFound:
        return None
    table = pyarrow.parquet.read_table(inner, filesystem=system)
    return dict(zip(table["path"].to_pylist(), zip(table["ms"].to_pylist(), table["length"].to_pylist())))


class FrameFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FolderReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(FrameFolder)


def folder_changes(
    spark: SparkSession, roots: str | Sequence[str], state: str, recursive: bool = False, settle_seconds: float = 1.5, buckets: int = 64
) -> DataFrame:
    """Stream of (path, modificationTime, length, change) of the frame files in the roots."""
    register(spark)
    reader = spark.readStream.format(NAME).option("state", state).option("recursiveFileLookup", str(recursive).lower())
    return reader.option("settleSeconds", settle_seconds).option("buckets", buckets).load(";".join(split_roots(roots)))
