"""Token files: whole texts as ids, in id order, coded in segments of a file per task."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nightsieve.llm import range_coder
from nightsieve.llm.common import file_system, map_batches, map_partitions, shared_folder, staged
from nightsieve.llm.tokens import encoder

SEGMENT_IDS = range_coder.BLOCK * range_coder.LANES
#: Pieces of text a task remembers; a larger cache saves no time, as words past these are mostly met once.
CACHED_PIECES = 100_000
#: Stands for a null id in the files.
NO_ID = -(1 << 63)
MANIFEST = "path string, at long, bytes long, first long, texts long, ids long"


def _segment(names: list[int], counts: list[int], ids: np.ndarray) -> bytes:
    """One segment: the number of texts, their names and lengths, the coded ids."""
    index = zlib.compress(np.array([names, counts], "<i8").tobytes(), 1)
    return struct.pack("<QQ", len(names), len(index)) + index + range_coder.encode(ids)


def read_segment(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, lengths, ids) of a segment."""
    texts, size = struct.unpack_from("<QQ", raw)
    names, counts = np.frombuffer(zlib.decompress(raw[16:16 + size]), "<i8").reshape(2, texts)
    return names, counts, range_coder.decode(raw[16 + size:])


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int, segment_ids: int) -> Iterator[pa.RecordBatch]:
    """Write this partition's texts to one file of its own; a repeated attempt writes another that nobody lists."""
    system, root = file_system(folder)
    path = f"{root}/ids-{uuid.uuid4().hex}.seg"
    rows: list[tuple] = []
    names: list[int] = []
    counts: list[int] = []
    parts: list[np.ndarray] = []
    held = at = 0
    sink = None

    def flush() -> None:
        nonlocal at, held, sink
        if sink is None:
            system.create_dir(root, recursive=True)
            sink = system.open_output_stream(path)
        raw = _segment(names, counts, np.concatenate(parts))
        sink.write(raw)
        rows.append((path, at, len(raw), names[0], len(names), held))
        at += len(raw)
        held = 0
        names.clear(), counts.clear(), parts.clear()

    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            part = batch.slice(k, 200)
            ids, bounds = encoder(tokenizer, CACHED_PIECES).encode(part.column(1).to_pylist())
            for row, name in enumerate(part.column(0).to_pylist()):
                own = np.append(ids[bounds[row]:bounds[row + 1]], end_id)
                names.append(name)
                counts.append(len(own))
                parts.append(own.astype(np.uint32))
                held += len(own)
                if held >= segment_ids:
                    flush()
    if names:
        flush()
    if sink is not None:
        sink.close()
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "at", "bytes", "first", "texts", "ids"])


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> tuple[str, DataFrame]:
    """Write all texts in ascending id order; (folder, manifest), a manifest row for each segment.

    A text is its ids and `end_id`, null and empty texts the end id alone.  The manifest lists only what successful tasks
    wrote.  Rows with a null id go first.  Executors must reach the folder through an Arrow file system.
    """
    folder = shared_folder(docs.sparkSession, "token-files")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id")
    work = partial(_write, folder=folder, tokenizer=tokenizer, end_id=end_id, segment_ids=segment_ids)
    return folder, staged(map_partitions(rows, work, MANIFEST), "token-manifest")


def _read(batch: pa.RecordBatch, folder: str):
    system, _ = file_system(folder)
    for row in batch.to_pylist():
        with system.open_input_file(row["path"]) as source:
            source.seek(row["at"])
            names, counts, ids = read_segment(source.read(row["bytes"]))
        ends = np.cumsum(counts)
        sums = [zlib.crc32(ids[e - c:e].tobytes()) for c, e in zip(counts, ends)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array(row["start"] + ends - counts), pa.array(counts), pa.array(sums, pa.int64())],
            ["id", "start", "n_tokens", "ids_crc32"],
        )


def read_ids(folder: str, manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each text, from the files; segments are read apart."""
    before = F.sum("ids").over(W.orderBy("first", "path", "at").rowsBetween(W.unboundedPreceding, -1))
    segments = staged(manifest.withColumn("start", F.coalesce(before, F.lit(0))), "token-segments")
    spread = segments.repartition(max(1, segments.count()))
    rows = map_batches(spread, partial(_read, folder=folder), "id long, start long, n_tokens long, ids_crc32 long")
    return rows.select(F.nullif("id", F.lit(NO_ID)).alias(id_col), "start", "n_tokens", "ids_crc32")
