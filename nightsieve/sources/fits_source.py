"""FITS files as a Spark data source: `spark.read.format("fits_slabs").load(folder)`.

One row is a slab, some rows of one plane of one image unit; all image units of a file and all planes of a unit are read.

    fits_source.register(spark)
    slabs = spark.read.format("fits_slabs").option("slabRows", 128).load("/data/in;/data/more")
    cards = spark.read.format("fits_slabs").schema("path string, hdu int, cards map<string,string>").load("/data/in")

Partitions are byte ranges of the listing, so planning opens no file.  A task reads the headers of its files, seeking over
the data, and owns the slabs whose first byte lies in its range; together the tasks read each sample once.  Columns that the
given schema leaves out are not built, and without `samples` no sample is read.

Options: `path` (folders or files, `;` between them; missing ones are skipped; without a scheme they are local, whatever the
cluster's default file system; paths come back in Spark's form, `file:/...`), `recursiveFileLookup` (false),
`slabRows` (64), `splitBytes` (128 MB, the bytes of a partition), `units` and `planes` (numbers with commas: only these).

Defined results: a file that cannot be read as FITS, or holds no image, is one row with `error`, its other columns but the path
null.  A slab that the file ends inside of is a row with its place and `error`, without samples; slabs behind it are told once
more at most for each range.  No files give no rows.
A file system that fails while a range is read gives an error row for that range.  A scale that is no number counts as none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from nightsieve.shipping import ship
from nightsieve.sources.files import FITS_EXTENSIONS, split_roots
from nightsieve.sources.fits import SAMPLE_TYPES, ImageUnit, image_units, open_path

NAME = "fits_slabs"
SCHEMA = (
    "path string, hdu int, plane int, y0 int, rows int, width int, height int, planes int, bitpix int, "
    "samples array<float>, error string"
)
#: Every column there is; `cards` comes only when a schema asks for it.
COLUMNS = {
    "path": pa.string(), "hdu": pa.int32(), "plane": pa.int32(), "y0": pa.int32(), "rows": pa.int32(), "width": pa.int32(),
    "height": pa.int32(), "planes": pa.int32(), "bitpix": pa.int32(), "samples": pa.list_(pa.float32()),
    "cards": pa.map_(pa.string(), pa.string()), "error": pa.string(),
}
SPLIT_BYTES = 128 << 20
LONGEST = (1 << 31) - 1


@dataclass
class Ranges(InputPartition):
    """(path, first byte, byte behind the last; None: to the end and beyond) of each range of a partition."""

    ranges: tuple[tuple[str, int, int | None], ...]

    def __init__(self, ranges: Sequence[tuple[str, int, int | None]]):
        self.ranges = tuple(ranges)


def _listed(root: str, recursive: bool) -> Iterator[tuple[str, int]]:
    """(path, bytes) of the FITS files at a root."""
    uri = "file://" + root[5:] if root.startswith("file:/") and not root.startswith("file://") else root
    scheme = uri.split("://", 1)[0] + "://" if "://" in uri else ""
    system, inner = pyarrow.fs.FileSystem.from_uri(uri) if scheme else (pyarrow.fs.LocalFileSystem(), uri)
    authority = uri[len(scheme):].split("/", 1)[0] if scheme == "hdfs://" else ""  # Arrow's paths of other schemes keep theirs
    here = system.get_file_info(inner)
    if here.type == pyarrow.fs.FileType.File:
        found = [here]
    else:
        found = system.get_file_info(pyarrow.fs.FileSelector(inner, allow_not_found=True, recursive=recursive))
    for info in found:
        if info.type == pyarrow.fs.FileType.File and info.extension.lower() in FITS_EXTENSIONS:
            yield (f"file:{info.path}" if scheme in ("", "file://") else scheme + authority + info.path), info.size


def byte_ranges(files: Sequence[tuple[str, int]], split: int) -> list[Ranges]:
    """Partitions of about `split` bytes: large files are cut, small ones share a partition."""
    out, shared, filled = [], [], 0
    for path, size in files:
        starts = list(range(0, max(1, size), split))
        for start in starts[:-1]:
            out.append(Ranges([(path, start, start + split)]))
        rest = size - starts[-1]
        if shared and filled + rest > split:
            out.append(Ranges(shared))
            shared, filled = [], 0
        # slabs that a file ends before belong to its last range
        shared.append((path, starts[-1], None))
        filled += rest
    return out + [Ranges(shared)] if shared else out


def _scale(cards: dict[str, str], key: str, default: float) -> float:
    try:
        value = float(cards[key].upper().replace("D", "E"))
    except (KeyError, ValueError):
        return default
    return value if math.isfinite(value) else default


def _chosen(options, key: str) -> set[int] | None:
    text = options.get(key)
    return None if text is None else {int(part) for part in text.split(",") if part.strip()}


class SlabReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.names = schema.names
        unknown = [n for n in self.names if n not in COLUMNS]
        if unknown:
            raise ValueError(f"no such columns: {', '.join(unknown)}; there are {', '.join(COLUMNS)}")
        self.roots = split_roots(options.get("path", ""))
        self.recursive = options.get("recursiveFileLookup", "false").lower() == "true"
        self.slab_rows, self.split = int(options.get("slabRows", 64)), int(options.get("splitBytes", SPLIT_BYTES))
        if self.slab_rows < 1 or self.split < 1:
            raise ValueError("slabRows and splitBytes must be above 0")
        self.units, self.planes = _chosen(options, "units"), _chosen(options, "planes")

    def partitions(self) -> list[Ranges]:
        files = {path: size for root in self.roots for path, size in _listed(root, self.recursive)}
        # an empty list would be read as one partition without a range
        return byte_ranges(sorted(files.items()), self.split) or [Ranges(())]

    def _row(self, **cells) -> pa.RecordBatch:
        kinds = [COLUMNS[n] for n in self.names]
        return pa.RecordBatch.from_arrays([pa.array([cells.get(n)], k) for n, k in zip(self.names, kinds)], names=self.names)

    def _slabs(self, handle, path: str, unit: ImageUnit, start: int, end: int | None) -> Iterator[pa.RecordBatch]:
        width, height = unit.axes[:2]
        planes, kind = math.prod(unit.axes[2:]), np.dtype(SAMPLE_TYPES[unit.bits])
        if max(width, height, planes) > LONGEST:
            raise ValueError(f"axes above {LONGEST}")
        slope, zero = _scale(unit.cards, "BSCALE", 1.0), _scale(unit.cards, "BZERO", 0.0)
        line, per_plane = width * kind.itemsize, -(-height // self.slab_rows)
        shared = {"path": path, "hdu": unit.hdu, "width": width, "height": height, "planes": planes, "bitpix": unit.bits}
        if "cards" in self.names:
            shared["cards"] = list(unit.cards.items())
        # the first slab at or behind the range's start: whole planes before it are skipped by division
        number = max(0, (start - unit.offset) // (line * height)) * per_plane
        for slab in range(number, planes * per_plane):
            plane, y0 = slab // per_plane, slab % per_plane * self.slab_rows
            first = unit.offset + (plane * height + y0) * line
            if end is not None and first >= end:
                return
            if first < start or (self.planes is not None and plane not in self.planes):
                continue
            rows, samples, error = min(self.slab_rows, height - y0), None, None
            whole = first + rows * line <= handle.size()
            if not whole:
                error = "ValueError: file ends inside the image"
            elif "samples" in self.names:
                try:
                    handle.seek(first)
                    samples = (np.frombuffer(handle.read(rows * line), kind) * slope + zero).astype(np.float32)
                except OSError as problem:
                    error = f"{type(problem).__name__}: {problem}"
            yield self._row(**shared, plane=plane, y0=y0, rows=rows, samples=samples, error=error)
            if not whole:
                return

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, start, end in partition.ranges:
            try:
                with open_path(path) as handle, open_path(path) as data:
                    seen = False
                    for unit in image_units(handle):
                        seen = True
                        if end is not None and unit.offset >= end:
                            break
                        if self.units is None or unit.hdu in self.units:
                            yield from self._slabs(data, path, unit, start, end)
                    if not seen:
                        raise ValueError("no image data")
            except ValueError as problem:
                # every range that comes so far finds the same; the last one always does
                if end is None:
                    yield self._row(path=path, error=f"{type(problem).__name__}: {problem}")
            except OSError as problem:
                yield self._row(path=path, error=f"{type(problem).__name__}: {problem}")


class FitsSlabs(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> SlabReader:
        return SlabReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make `spark.read.format("fits_slabs")` known to this session."""
    ship(spark)
    spark.dataSource.register(FitsSlabs)
