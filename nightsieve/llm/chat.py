"""Chat formatting by columnar byte assembly.

A turn is `<|role|>text</s>`.  In roles and texts each of the bytes < [ \\ | gets a backslash behind it, so none of the strings
`<|`, `|>`, `</s>`, `[INST]`, `[/INST]` can be made by a text, and dropping those backslashes gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightsieve.llm.bytes_hash import texts
from nightsieve.llm.common import map_batches, map_partitions, staged

OPEN, MIDDLE, CLOSE = b"<|", b"|>", b"</s>"
_MARKED = np.zeros(256, bool)
_MARKED[list(b"<[\\|")] = True
_ESCAPED = re.compile(rb"([<\[\\|])\\")
SPANS = "array<struct<start:long,end:long>>"


def escape(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The escaped bytes and bounds of many strings at once: each byte goes to its place plus the marks before it."""
    marks = _MARKED[data]
    before = np.cumsum(marks)
    out = np.full(len(data) + (int(before[-1]) if len(data) else 0), ord("\\"), np.uint8)
    out[np.arange(len(data)) + before - marks] = data
    return out, bounds + np.concatenate(([0], before))[bounds]


def unescape(raw: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", raw)


def assemble(segments: list[tuple[np.ndarray, np.ndarray] | bytes], rows: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row by row, all segments one after another in one buffer; also where each segment of each row starts, and the end."""
    sizes = [np.full(rows, len(s)) if isinstance(s, bytes) else np.diff(s[1]) for s in segments]
    length = np.sum(sizes, axis=0)
    at = np.cumsum(length) - length
    out = np.empty(int(length.sum()), np.uint8)
    starts = []
    for segment, size in zip(segments, sizes):
        starts.append(at)
        if isinstance(segment, bytes):
            out[at[:, None] + np.arange(len(segment))] = np.frombuffer(segment, np.uint8)
        else:
            data, bounds = segment
            out[np.arange(len(data)) + np.repeat(at - bounds[:-1], size)] = data
        at = at + size
    return out, [*starts, at]


def _format(rows: pa.Table) -> pa.RecordBatch:
    """One row for each conversation of `rows`, which come sorted."""
    rows = rows.combine_chunks()
    ids = rows.column("conv_id")
    n = rows.num_rows
    known = np.asarray(ids.is_valid())
    value = np.asarray(ids.fill_null(0))
    new = np.ones(n, bool)
    new[1:] = (value[1:] != value[:-1]) | (known[1:] != known[:-1])
    first = np.flatnonzero(new)
    role, text = escape(*texts(rows.column("role"))), escape(*texts(rows.column("text")))
    buffer, starts = assemble([OPEN, role, MIDDLE, text, CLOSE], n)
    edges = np.append(starts[0][first], len(buffer)).astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(edges), pa.py_buffer(buffer)]).cast(pa.string())
    speaks = np.asarray(rows.column("role").fill_null("")) == "assistant"
    base = np.repeat(edges[:-1], np.diff(np.append(first, n)))
    spans: list[list[dict]] = [[] for _ in first]
    number = np.cumsum(new) - 1
    for k in np.flatnonzero(speaks):
        spans[number[k]].append({"start": int(starts[3][k] - base[k]), "end": int(starts[4][k] - base[k])})
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([ids.combine_chunks().take(pa.array(first)), whole, pa.array(spans, kind)], ["conv_id", "formatted", "loss"])


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Format whole conversations; the last of a batch waits for its other turns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_pylist()
        cut = len(ids)
        while cut and ids[cut - 1] == ids[-1]:
            cut -= 1
        if held and held[-1].column("conv_id")[-1].as_py() != ids[0]:
            yield _format(pa.Table.from_batches(held))
            held = []
        if cut:
            yield _format(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _format(pa.Table.from_batches(held))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): each conversation's turns in order and the byte ranges of assistant texts.

    Turns are ordered by turn, nulls first, equal ones by role and text, so repeated rows stay.  A null role or text is
    empty; rows without conv_id are one conversation.  Extra columns are not read; an empty table gives no row.
    """
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = turns.schema["conv_id"].dataType.simpleString()
    return map_partitions(rows.select("conv_id", "role", "text"), _conversations, f"conv_id {kind}, formatted string, loss {SPANS}")


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn."""
    turns = []
    for turn in formatted.split(CLOSE)[:-1]:
        role, text = turn[len(OPEN):].split(MIDDLE, 1)
        turns.append((unescape(role), unescape(text)))
    return turns


def _read(batch: pa.RecordBatch):
    rows = []
    for whole, spans in zip(batch.column("formatted"), batch.column("loss").to_pylist()):
        raw = whole.as_buffer().to_pybytes()
        turns = parse(raw)
        told = hashlib.sha256(b"".join(role + b"\n" + text + b"\n" for role, text in turns)).hexdigest()
        loss = b"".join(unescape(raw[s["start"]:s["end"]]) for s in spans)
        rows.append((len(turns), told, len(loss.decode()), hashlib.sha256(loss).hexdigest(), len(raw.decode())))
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c) for c in zip(*rows))], ["conv_id", *names])


def read_conversations(formatted: DataFrame) -> DataFrame:
    """What the formatted text says of itself: turns and masked text with the escapes undone."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return map_batches(formatted, _read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def written(formatted: DataFrame) -> DataFrame:
    return staged(formatted, "chat")
