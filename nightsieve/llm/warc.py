"""WARC archives: a writer with one compressed member a record, and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightsieve.llm.common import file_system, map_batches, map_partitions, shared_folder, small_side, staged

MAGIC = b"\x1f\x8b\x08"
FILE_BYTES = 64 << 20
SPLIT_BYTES = 4 << 20
STEP = 256 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PLAIN = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes, first: int) -> bytes:
    """A response record, or a revisit without payload when another page came first; a null url has no target line."""
    revisit = first != page_id
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_PLAIN)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _write(batches: Iterator[pa.RecordBatch], folder: str, file_bytes: int) -> Iterator[pa.RecordBatch]:
    system, root = file_system(folder)
    sink, path, size = None, "", 0
    made: list[tuple[str, int]] = []
    for batch in batches:
        for page_id, url, html, first in zip(*(batch.column(k) for k in range(4))):
            if sink is None:
                system.create_dir(root, recursive=True)
                path, size = f"{root}/part-{uuid.uuid4().hex}.warc.gz", 0
                sink = system.open_output_stream(path, compression=None)
            payload = html.as_buffer().to_pybytes() if html.is_valid else b""
            raw = _member(record(page_id.as_py(), url.as_py(), payload, first.as_py()))
            sink.write(raw)
            size += len(raw)
            if size >= file_bytes:
                sink.close()
                made.append((path, size))
                sink = None
    if sink is not None:
        sink.close()
        made.append((path, size))
    if made:
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made]), pa.array([n for _, n in made], pa.int64())], ["path", "bytes"])


def write_archives(pages: DataFrame, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """Write one record per row (page_id, url, html); (folder, manifest of files).

    Of rows with one payload of at least `min_bytes` bytes that with the smallest page_id is a response and the others are
    revisits; equal page_ids with the smallest id are responses all.  Null html is an empty payload; a null page_id stays null and is never the first of several.  Only digests that occur twice
    are looked up; the manifest names only files of successful tasks.  Executors must reach the folder through an Arrow file system.
    """
    folder = shared_folder(pages.sparkSession, "warc")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    key = F.unhex(F.sha2("html", 256))
    twins = rows.where(F.octet_length("html") >= min_bytes).groupBy(key.alias("key"))
    twins = twins.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    twins, _ = small_side(staged(twins, "twins"), 50_000)
    rows = rows.withColumn("key", F.when(F.octet_length("html") >= min_bytes, key)).join(twins, "key", "left")
    rows = rows.select("page_id", "url", "html", F.coalesce("first", "page_id").alias("first"))
    made = map_partitions(rows, partial(_write, folder=folder, file_bytes=file_bytes), "path string, bytes long")
    return folder, staged(made, "warc-files")


class _Window:
    """Bytes of a file from a place on, read in steps."""

    def __init__(self, source, size: int, at: int) -> None:
        self.source, self.size, self.base, self.end = source, size, at, at
        self.data = b""
        source.seek(at)

    def more(self) -> bool:
        if self.end >= self.size:
            return False
        got = self.source.read(min(STEP, self.size - self.end))
        self.data += got
        self.end += len(got)
        return bool(got)

    def drop(self, at: int) -> None:
        self.data = self.data[at - self.base:]
        self.base = at

    def member(self, at: int) -> tuple[bytes, int] | None:
        """(record, place after it) if a whole member of a WARC record starts here, decoded as far as its head first."""
        unpacker = zlib.decompressobj(31)
        out: list[bytes] = []
        known = False
        head = b""
        while not unpacker.eof:
            if at >= self.end and not self.more():
                return None
            piece = self.data[at - self.base:at - self.base + STEP]
            try:
                got = unpacker.decompress(piece)
            except zlib.error:
                return None
            out.append(got)
            at += len(piece) - len(unpacker.unused_data)
            if not known:
                head += got
                if len(head) >= 7 or unpacker.eof:
                    if not head.startswith(b"WARC/1."):
                        return None
                    known = True
        return b"".join(out), at


def records(source, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, record) of each record that starts in [start, end): scan for a member's magic, decode, go on after it."""
    window = _Window(source, size, start)
    at = start
    while at < end:
        while window.end < min(at + len(MAGIC), size) and window.more():
            pass
        spot = window.data.find(MAGIC, at - window.base)
        if spot < 0:
            at = max(at, window.end - len(MAGIC) + 1)  # magic may lie across the next step
            window.drop(min(at, window.end))
            if at >= end or not window.more():
                return
            continue
        at = window.base + spot
        if at >= end:
            return
        window.drop(at)
        found = window.member(at)
        if found is None:
            at += 1
            continue
        yield at, found[0]
        at = found[1]


def parse(raw: bytes) -> dict[str, object]:
    """The fields of a record and its payload; the digest of a response is taken from the payload itself."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = int(dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"Content-Length"])
    kind = fields["WARC-Type"]

    def name(key: str) -> int | None:
        said = fields.get(key, "<urn:page:None>").removeprefix("<urn:page:").removesuffix(">")
        return None if said == "None" else int(said)

    noted = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (digest(payload) != noted or len(payload) != said):
        raise ValueError(f"the payload of page {name('WARC-Record-ID')} is damaged")
    url = fields.get("WARC-Target-URI")
    return {"page_id": name("WARC-Record-ID"), "payload_bytes": said, "payload_digest": noted, "record_type": kind,
            "refers_to": name("WARC-Refers-To"), "url": None if url is None else unquote(url), "payload": payload if kind == "response" else None}


KIND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(batch: pa.RecordBatch, folder: str, payloads: bool):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["url", "payload"] * payloads]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    system, _ = file_system(folder)
    for row in batch.to_pylist():
        with system.open_input_file(row["path"]) as source:
            held: list[dict] = []
            for _, raw in records(source, row["bytes"], row["start"], row["end"]):
                held.append(parse(raw))
                if len(held) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array([h[n] for h in held], t) for n, t in zip(names, kinds)], names)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([h[n] for h in held], t) for n, t in zip(names, kinds)], names)


def read_archives(folder: str, files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = False) -> DataFrame:
    """The records of the listed files, read by byte ranges of `split_bytes`, each by the task in whose range it starts."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    ranges = files.select("path", "bytes", F.explode(starts).alias("start"))
    ranges = staged(ranges.withColumn("end", F.least(F.col("start") + split_bytes, "bytes")), "warc-ranges")
    spread = ranges.repartition(max(1, ranges.count()))
    return map_batches(spread, partial(_read, folder=folder, payloads=payloads), KIND + ", url string, payload binary" * payloads)
