"""FITS rasters: headers first, then slabs of rows read where they are needed.

Headers are a small table.  Gates and joins work on it before any sample is read,
then each image is cut into slabs of rows that tasks read by seeking, so one large
file is shared by many tasks and no task holds an image.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightsieve.functions import headers
from nightsieve.functions.tone import norm_max_from_bits
from nightsieve.operators.raster import LUMINANCE, luminance
from nightsieve.sources.files import discover_files, file_name, path_parts

# Fixed values of the file format.
BLOCK, CARD = 2880, 80
SAMPLE_TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
HEADER_SCHEMA = "path string, hdu int, cards map<string,string>, data_offset bigint, error string"
SLAB_SCHEMA = "path string, channel int, y0 int, width int, height int, samples array<float>, error string"


def open_path(path: str):
    """A seekable handle on any file system Arrow knows."""
    uri = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
    if "://" not in uri:
        return pyarrow.fs.LocalFileSystem().open_input_file(uri)
    system, inner = pyarrow.fs.FileSystem.from_uri(uri)
    return system.open_input_file(inner)


def parse_card(card: str) -> tuple[str, str] | None:
    """Keyword and value of one card; None when it has no value."""
    key, sign, rest = card[:8].strip().upper(), *card.partition("=")[1:]
    if not sign or not key:
        return None
    return key, rest.split("/", 1)[0].strip()


def read_header(handle) -> dict[str, str]:
    """Cards up to END at the handle's position; the last of equal keywords wins."""
    cards: dict[str, str] = {}
    while True:
        block = handle.read(BLOCK)
        if len(block) < BLOCK:
            raise ValueError("header ends without END")
        text = block.decode("ascii", "replace")
        for at in range(0, BLOCK, CARD):
            card = text[at:at + CARD]
            if card[:8].strip().upper() == "END":
                return cards
            pair = parse_card(card)
            if pair:
                cards[pair[0]] = pair[1]


def _number(cards: dict[str, str], key: str, default: int = 0) -> int:
    try:
        return int(float(cards.get(key, default)))
    except (ValueError, OverflowError):
        return default


class ImageUnit(NamedTuple):
    """A unit that holds an image: its number, cards, axes and the place of its first sample."""

    hdu: int
    cards: dict[str, str]
    axes: list[int]
    bits: int
    offset: int


def image_units(handle) -> Iterator[ImageUnit]:
    """The units of an open file that hold an image: two axes or more, none empty, known samples.

    Only headers are read; data are sought over.  What follows the last unit without being a header is left alone.
    """
    size, hdu = handle.size(), 0
    while (start := handle.tell()) < size:
        if hdu and handle.read(8) not in (b"SIMPLE  ", b"XTENSION"):
            return
        handle.seek(start)
        cards = read_header(handle)
        axes = [max(0, _number(cards, f"NAXIS{i + 1}")) for i in range(max(0, _number(cards, "NAXIS")))]
        bits, offset = _number(cards, "BITPIX"), handle.tell()
        if len(axes) >= 2 and all(axes) and bits in SAMPLE_TYPES:
            yield ImageUnit(hdu, cards, axes, bits, offset)
        # tables keep a heap behind their rows, groups repeat
        values = math.prod(axes) if axes else 0
        data = (values + max(0, _number(cards, "PCOUNT"))) * max(1, _number(cards, "GCOUNT", 1)) * abs(bits) // 8
        behind = offset + -(-data // BLOCK) * BLOCK
        if behind >= size:
            return
        handle.seek(behind)
        hdu += 1


def image_header(path: str) -> tuple[int, dict[str, str], int]:
    """(unit number, cards, data offset) of the first unit that holds an image."""
    with open_path(path) as handle:
        for unit in image_units(handle):
            return unit.hdu, unit.cards, unit.offset
    raise ValueError("no image data")


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path in batch["path"]:
            try:
                rows.append((path, *image_header(path), None))
            except (OSError, ValueError) as error:
                rows.append((path, None, None, None, f"{type(error).__name__}: {error}"))
        yield pd.DataFrame(rows, columns=["path", "hdu", "cards", "data_offset", "error"])


def fits_headers(files: DataFrame) -> DataFrame:
    """(path, hdu, cards, data_offset, error) per file; an unreadable file is a row with an error."""
    return files.select("path").mapInPandas(_headers, HEADER_SCHEMA)


def header_table(files: DataFrame) -> DataFrame:
    """Typed header columns and a status per file: loaded, not light or error."""
    sorted_files = path_parts(files.select("path"))
    readable = fits_headers(sorted_files.filter("kind = 'fits'"))
    others = sorted_files.filter("kind <> 'fits'").select(
        "path", F.lit(None).cast("int").alias("hdu"), F.lit(None).cast("map<string,string>").alias("cards"),
        F.lit(None).cast("bigint").alias("data_offset"),
        F.coalesce("error", F.lit("no reader for xisf containers")).alias("error"),
    )
    every = readable.unionByName(others)
    cards = "cards"
    typed = every.select(
        "path", "hdu", "data_offset", "error", file_name("path").alias("file_name"),
        headers.integer(cards, "BITPIX", 0).alias("bitpix"),
        headers.integer(cards, "NAXIS1", 0).alias("width"), headers.integer(cards, "NAXIS2", 0).alias("height"),
        F.when(headers.integer(cards, "NAXIS", 0) > 2, F.greatest(F.lit(1), headers.integer(cards, "NAXIS3", 1)))
        .otherwise(F.lit(1)).alias("planes"),
        F.coalesce(headers.number(headers.card(cards, "BSCALE")), F.lit(1.0)).alias("bscale"),
        F.coalesce(headers.number(headers.card(cards, "BZERO")), F.lit(0.0)).alias("bzero"),
        headers.first_available(cards, headers.FOCAL_LENGTH).alias("focal_mm"),
        headers.resolve_pixel_size(cards).alias("pixel_um"),
        headers.resolve_timestamp(cards).alias("exposure_ts"),
        headers.first_available(cards, headers.EXPOSURE).alias("exposure_s"),
        headers.first_text(cards, headers.FILTER).alias("filter_name"),
        headers.first_available(cards, headers.SKY_TEMP, positive=False).alias("sky_temp"),
        headers.first_text(cards, headers.BAYER).alias("bayer_pattern"),
        headers.integer(cards, "XBAYROFF", 0).alias("bayer_x"), headers.integer(cards, "YBAYROFF", 0).alias("bayer_y"),
        headers.first_text(cards, headers.IMAGE_TYPE).alias("image_type"),
        headers.sqm_from_name(file_name("path")).alias("sqm"),
    )
    status = F.when(F.col("error").isNotNull(), "error").when(headers.is_light("image_type"), "loaded").otherwise("not light")
    return typed.withColumns({"status": status, "norm_max": norm_max_from_bits("bitpix")})


def _slabs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            width, rows = int(row.width), int(row.rows)
            kind = np.dtype(SAMPLE_TYPES[int(row.bitpix)])
            first = (int(row.channel) * int(row.height) + int(row.y0)) * width
            wanted, samples, error = rows * width * kind.itemsize, None, None
            try:
                with open_path(row.path) as handle:
                    handle.seek(int(row.data_offset) + first * kind.itemsize)
                    raw = handle.read(wanted)
                if len(raw) < wanted:
                    raise ValueError("file ends inside the image")
                values = np.frombuffer(raw, kind).astype(np.float64) * row.bscale + row.bzero
                samples = values.astype(np.float32)
            except (OSError, ValueError) as problem:
                error = f"{type(problem).__name__}: {problem}"
            yield pd.DataFrame({
                "path": [row.path], "channel": [int(row.channel)], "y0": [int(row.y0)], "width": [width],
                "height": [int(row.height)], "samples": [samples], "error": [error],
            })


def image_slabs(header: DataFrame, slab_rows: int = 64) -> DataFrame:
    """(path, channel, y0, width, height, samples, error): rows y0.. of each of the first three planes."""
    wanted = header.filter("error is null").select(
        "path", "data_offset", "bitpix", "bscale", "bzero", "width", "height",
        F.explode(F.sequence(F.lit(0), F.least(F.col("planes"), F.lit(3)) - 1)).alias("channel"),
    ).withColumn("y0", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(slab_rows))))
    sized = wanted.withColumn("rows", F.least(F.lit(slab_rows), F.col("height") - F.col("y0")))
    # only these small descriptions are shuffled; the samples are read after it
    return sized.repartition("path", "channel", "y0").mapInPandas(_slabs, SLAB_SCHEMA)


def _mixed_slabs(batches: Iterator[pd.DataFrame], halo: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            width, height, y0, rows = int(row.width), int(row.height), int(row.y0), int(row.rows)
            kind = np.dtype(SAMPLE_TYPES[int(row.bitpix)])
            above, last = min(halo, y0), min(height, y0 + rows + halo)
            size, samples, error, planes = (last - y0 + above) * width, None, None, []
            try:
                with open_path(row.path) as handle:
                    for channel in range(min(int(row.planes), len(LUMINANCE))):
                        handle.seek(int(row.data_offset) + ((channel * height + y0 - above) * width) * kind.itemsize)
                        raw = handle.read(size * kind.itemsize)
                        if len(raw) < size * kind.itemsize:
                            raise ValueError("file ends inside the image")
                        planes.append((np.frombuffer(raw, kind) * float(row.bscale) + row.bzero).astype(np.float32))
                mixed = planes[0] if len(planes) == 1 else sum(w * p.astype(np.float64) for w, p in zip(LUMINANCE, planes))
                samples = mixed.astype(np.float32)
            except (OSError, ValueError) as problem:
                error = f"{type(problem).__name__}: {problem}"
            yield pd.DataFrame({
                "path": [row.path], "y0": [y0], "rows": [rows], "above": [above], "width": [width], "height": [height],
                "samples": [samples], "error": [error],
            })


def luminance_slabs(header: DataFrame, slab_rows: int = 256, halo: int = 0) -> DataFrame:
    """(path, y0, rows, above, width, height, samples, error): one plane of each image in slabs of rows.

    A task reads the same rows of all colour planes and mixes them, so no samples are shuffled; `halo` rows before and behind
    come from the file too.  Luminance is defined on three planes: a missing blue plane adds nothing, later ones take no part.
    """
    wanted = header.filter("error is null").select("path", "data_offset", "bitpix", "bscale", "bzero", "width", "height", "planes")
    wanted = wanted.withColumn("y0", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(slab_rows))))
    sized = wanted.withColumn("rows", F.least(F.lit(slab_rows), F.col("height") - F.col("y0")))
    # only these small descriptions are shuffled; the samples are read after it
    schema = "path string, y0 int, rows int, above int, width int, height int, samples array<float>, error string"
    tasks = 4 * int(header.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number: adaptive execution would merge these tiny rows
    return sized.repartition(tasks, "path", "y0").mapInPandas(partial(_mixed_slabs, halo=halo), schema)


def read_fits(header: DataFrame, light_only: bool = True, slab_rows: int = 64) -> DataFrame:
    """Slabs of the usable files. The gates act on headers, before any sample is read."""
    return image_slabs(header.filter("status = 'loaded'") if light_only else header, slab_rows)


def failed_paths(slabs: DataFrame) -> DataFrame:
    """Files with at least one slab that could not be read."""
    return slabs.filter("error is not null").groupBy("path").agg(F.min("error").alias("error"))


def slab_luminance(slabs: DataFrame) -> DataFrame:
    """(path, y0, width, height, samples): one plane per image, colour planes mixed array by array."""
    one = slabs.groupBy("path", "y0", "width", "height").agg(
        *[F.max(F.when(F.col("channel") == i, F.col("samples"))).alias(f"_{i}") for i in range(3)]
    )
    # planar files: a blue plane that is missing adds nothing
    dark = F.transform("_1", lambda _: F.lit(0.0).cast("float"))
    zipped = F.arrays_zip("_0", "_1", F.coalesce("_2", dark).alias("_2"))
    mixed = F.transform(zipped, lambda s: luminance(s["_0"], s["_1"], s["_2"]).cast("float"))
    return one.select(
        "path", "y0", "width", "height", F.when(F.col("_1").isNull(), F.col("_0")).otherwise(mixed).alias("samples")
    )


def pixel_rows(slabs: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys…, y, x, v) of single-plane slabs."""
    cells = slabs.select(*keys, "y0", "width", F.posexplode("samples").alias("_p", "_v"))
    return cells.select(
        *keys, (F.col("y0") + F.floor(F.col("_p") / F.col("width"))).cast("int").alias("y"),
        (F.col("_p") % F.col("width")).cast("int").alias("x"), F.col("_v").cast("double").alias("v"),
    )


def load_frames(
    spark: SparkSession, roots: str, recursive: bool = False, light_only: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(headers with status, pixel rows keyed by path) of the frame files below the roots."""
    header = header_table(discover_files(spark, roots, recursive))
    return header, pixel_rows(slab_luminance(read_fits(header, light_only)))


def frame_key(path: Column | str = "path") -> Column:
    """Frames are identified by their path, ignoring case."""
    return F.lower(path)
