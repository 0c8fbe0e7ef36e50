"""The numpy kernels against plain versions."""

import itertools
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nightsieve.llm import bytes_hash, chat, near_dedup, neighbours, packing, range_coder, suffix_dedup, tokens, toxicity, warc


def joined(texts):
    raw = [t.encode() if isinstance(t, str) else t for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]).astype(np.int64)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB c\t\n\x0bé", max_size=30), max_size=6), st.integers(1, 4))
def test_shingles_count_like_sets(texts, width):
    values, bounds = bytes_hash.shingles(*joined(texts), width)
    seen = {}
    for k, text in enumerate(texts):
        words = text.encode().lower().split()
        plain = {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
        mine = values[bounds[k]:bounds[k + 1]]
        assert len(mine) == len(plain)
        assert seen.setdefault(frozenset(plain), mine.tobytes()) == mine.tobytes()


@pytest.mark.parametrize("size", [1, 3, 40, 2000])
def test_sketch_fills_and_estimates(size):
    rng = np.random.default_rng(size)
    a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
    b = np.concatenate((a[: size // 2], rng.integers(0, 1 << 63, size - size // 2, dtype=np.uint64)))
    got = near_dedup.sketches(np.concatenate((a, b)), np.array([0, size, 2 * size]), 256)
    assert (got != near_dedup.EMPTY).all()
    share = (got[0] == got[1]).mean()
    assert abs(share - (size // 2) / (2 * size - size // 2)) < 0.15


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=60), min_size=1, max_size=6), st.integers(0, 2**32))
def test_repeated_starts(texts, seed):
    rng = random.Random(seed)
    texts = [bytes(b"ab"[x % 2] for x in t) + b"abab" * 2 for t in texts]
    data, bounds = joined(texts)
    counts = np.diff(bounds) - 8 + 1
    shard = np.array([rng.randrange(suffix_dedup.SHARDS) for _ in texts])
    got = suffix_dedup.repeated_starts(data, bounds, counts, shard, 8, 4)
    strings = [t[i:i + 8] for t in texts for i in range(len(t) - 7)]
    assert got.tolist() == [strings.count(s) > 1 for s in strings]


def test_merged_order_is_the_sorted_order():
    rng = np.random.default_rng(5)
    strings = [rng.integers(1, 4, n).tolist() for n in (1, 5, 6, 3, 9, 9)]
    parts, suffixes = [], []
    for group in (strings[:3], strings[3:]):
        n = np.array([len(s) for s in group])
        k = len(group)
        string = np.repeat(np.arange(k), n)
        nth = np.arange(len(string)) - np.repeat(np.cumsum(n) - n, n)
        row = k + np.arange(len(string))
        follow = np.concatenate((np.arange(k), np.where(nth == n[string] - 1, string, row + 1)))
        lead = np.concatenate((k + np.cumsum(n) - 1, np.where(nth == 0, -1, row - 1)))
        symbol = np.concatenate((np.zeros(k, np.int64), np.concatenate(group)))
        parts.append(suffix_dedup.build(symbol, follow, lead, k, int(n.max())))
        suffixes.append([[]] * k + [group[s][i:] for s, i in zip(string, nth)])
    inter, prefix = suffix_dedup.merge(parts, 3)
    rows = [[suffixes[s][i] for i in part.origin] for s, part in enumerate(parts)]
    turn = [iter(r) for r in rows]
    merged = [next(turn[s]) for s in inter]
    assert [m[:3] for m in merged] == sorted(m[:3] for m in merged)
    for a, b, p in zip(merged, merged[1:], prefix[1:]):
        same = len(list(itertools.takewhile(lambda x: x[0] == x[1], zip(a, b))))
        assert p == min(same, 3) or (p == 3 and a[:3] == b[:3])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-2, 2, allow_nan=False).map(lambda x: round(x, 2)), max_size=40))
def test_maximal_segments(weights):
    found = toxicity.maximal_segments(weights)
    best = max((sum(weights[i:j]) for i in range(len(weights)) for j in range(i + 1, len(weights) + 1)), default=0)
    if best > 1e-9:
        assert max(s for s, _, _ in found) == pytest.approx(best)
    for score, a, b in found:
        assert score == pytest.approx(sum(weights[a:b]))
        assert all(sum(weights[a:j]) > -1e-9 for j in range(a + 1, b)) and weights[a] > 0 and weights[b - 1] > 0
    assert all(x[2] <= y[1] for x, y in zip(found, found[1:]))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.integers(1, 90))
def test_range_coder_round_trip(ids, block):
    ids = np.array(ids, np.uint32)
    raw = range_coder.encode(ids, block)
    assert (range_coder.decode(raw) == ids).all()
    if len(ids):
        assert (range_coder.decode(raw, 0, 1) == ids[:block]).all()


def test_range_coder_keeps_its_range_on_long_repeats():
    rng = np.random.default_rng(0)
    ids = np.concatenate([np.tile(rng.integers(0, 50000, rng.integers(1, 60)), rng.integers(1, 300)) for _ in range(300)]).astype(np.uint32)
    assert (range_coder.decode(range_coder.encode(ids)) == ids).all()
    coder = range_coder._Range(1)
    coder.low[:], coder.range[:] = 1 << 60, 1 << 48
    assert not coder.ready(slice(1)).any()


def test_range_coder_beats_zlib_on_texts():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    ids, _ = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), 10**5).encode(texts)
    assert len(range_coder.encode(ids)) < len(zlib.compress(ids.astype("<u4").tobytes(), 6))


def test_range_coder_notices_damage_and_shrinks():
    ids = np.tile(np.arange(50), 400)
    raw = bytearray(range_coder.encode(ids))
    assert len(raw) < len(ids) // 4
    raw[-20] ^= 255
    with pytest.raises(ValueError):
        range_coder.decode(bytes(raw))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_are_the_library_s(name):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(name))
    texts = ["<|startoftext|> x <|EndOfText|>", "a <| b", "", None, " ", "a", " a  b", "It's\n\nfine\n x", "tab\there", "\nstart", "end ", "é́ ß　x", "<|endoftext|> 12 34!!", "\x01 mark", "a\x1cb c", "x " * 500]
    ids, bounds = tokens.Encoder(public_tokenizers.path(name), 10).encode(texts)
    for k, text in enumerate(texts):
        assert ids[bounds[k]:bounds[k + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_plan_holds_every_piece():
    rng = np.random.default_rng(2)
    counts = np.concatenate(([0], rng.integers(0, 40, 64)))
    runs = packing.plan(counts, 64)
    held = np.zeros(65, np.int64)
    for lengths, times in runs:
        assert sum(lengths) <= 64 and times > 0
        for x in lengths:
            held[x] += times
    assert (held == counts).all()
    assert sum(t for _, t in runs) <= 1.07 * (counts * np.arange(65)).sum() / 64 + 2
    places = packing.Places(runs)
    seen = set()
    for length in range(1, 65):
        sequence, offset = places.find(np.full(counts[length], length), np.arange(counts[length]))
        for s, o in zip(sequence, offset):
            cells = {(s, o + k) for k in range(length)}
            assert not cells & seen and o + length <= 64
            seen |= cells
    assert packing.plan(np.zeros(65, np.int64), 64) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="<>|[]\\/sINT endé", max_size=20), min_size=1, max_size=5))
def test_chat_escapes(texts):
    data, bounds = chat.escape(*joined(texts))
    for k, text in enumerate(texts):
        raw = data[bounds[k]:bounds[k + 1]].tobytes()
        assert chat.unescape(raw) == text.encode()
        assert not any(mark in raw for mark in (b"<|", b"|>", b"</s>", b"[INST]", b"[/INST]"))


class Source:
    def __init__(self, raw):
        self.raw, self.at = raw, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        self.at += n
        return self.raw[self.at - n:self.at]


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 10**6])
def test_warc_ranges_own_each_record_once(split):
    payloads = [b"", b"x" * 300, "é\r\n\r\nWARC/1.1".encode(), random.Random(1).randbytes(500) + warc.MAGIC * 5, warc.MAGIC]
    raw = b"".join(warc._member(warc.record(k, "http://a/ b%\n", p, k)) for k, p in enumerate(payloads))
    found = []
    for start in range(0, len(raw), split):
        found += [warc.parse(r) for _, r in warc.records(Source(raw), len(raw), start, min(start + split, len(raw)))]
    assert [f["page_id"] for f in found] == list(range(len(payloads)))
    assert [f["payload"] for f in found] == payloads and found[0]["url"] == "http://a/ b%\n"


def test_tree_is_exact_at_factor_one():
    rng = np.random.default_rng(0)
    points = rng.normal(size=(1500, 6)).round(1)
    points[::7] = points[0]
    ids = rng.permutation(1500).astype(np.int64)
    tree = neighbours.Tree(points, ids, leaf=20)
    scores, got = tree.search(points[:40], ids[:40], 9, 1.0)
    for k in range(40):
        all_scores = points @ points[k]
        all_scores[k] = -np.inf
        order = np.lexsort((ids, -all_scores.round(9)))[:9]
        assert np.allclose(scores[k], all_scores[order])
    loose, _ = tree.search(points[:40], ids[:40], 9, 0.3)
    assert (loose <= scores + 1e-9).all()


def test_crc_of_ids():
    assert zlib.crc32(np.array([2], "<u4").tobytes()) == zlib.crc32(b"\x02\0\0\0")


def test_range_coder_holds_few_bytes_an_id():
    ids = np.random.default_rng(4).integers(0, 300, range_coder.BLOCK * 128).astype("<u4")
    held = []
    for work, given in ((range_coder.encode, ids), (range_coder.decode, range_coder.encode(ids))):
        tracemalloc.start()
        work(given)
        held.append(tracemalloc.get_traced_memory()[1] / len(ids))
        tracemalloc.stop()
    assert held[0] < 30 and held[1] < 35, held
