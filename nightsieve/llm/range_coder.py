"""An adaptive context-mixing range coder for token ids.

Ids are cut into blocks, each coded from a fresh model, so any block can be decoded alone; its check sum is kept.  Inside a
block an order-2 context and an order-1 context each name the id that followed them, with a confidence, and order 0 keeps
counts of the block's ids.  Weights learned for each pair of confidences mix the three into one partition of the coder's range: a
share for the order-2 id, a share for the order-1 id, and the rest spread by the counts.  Blocks are lanes of numpy arrays, all
advanced one id at a time.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
LANES = 1024
UNIT = 16  # bits of the weights
SLOTS = 14  # bits of the order-0 counts
CONTEXTS = 11  # bits of the order-2 table, as many as a block can fill
REFRESH = 256  # ids between new order-0 counts
U = np.uint64
_LOW_BITS = U((1 << 40) - 1)
_ONE = U(1)
#: The confidence that follows 0 to 3, after a miss and after a hit.
_CONFIDENCE = np.array([0, 1, 0, 2, 1, 3, 2, 3], np.uint8)
_MAGIC = b"NSRC1\0\0\0"


class _Model:
    """The state of all lanes; both directions take the same steps."""

    def __init__(self, sizes: np.ndarray) -> None:
        self.sizes = sizes.astype(np.int64)
        self.width = int(sizes.max()) + 1
        n = len(sizes)
        self.sym2 = np.full(n << CONTEXTS, self.width - 1, np.uint16)
        self.conf2 = np.zeros(n << CONTEXTS, np.uint8)
        self.sym1 = np.full(n * self.width, self.width - 1, np.uint16)
        self.conf1 = np.zeros(n * self.width, np.uint8)
        self.counts = np.zeros((n, self.width), np.int32)
        share = np.array([1500, 16000, 36000, 50000])
        w2 = np.repeat(share, 8)
        w1 = np.tile(np.repeat(share, 2), 4) * (65536 - w2) // 70000
        w1[1::2] = 200
        self.mix = np.tile(np.stack((w2, w1), axis=1), (n, 1)).astype(np.int64)
        self.last = np.zeros(n, np.int64)
        self.before = np.zeros(n, np.int64)
        self.lane = np.arange(n, dtype=np.int64)
        self.refresh()

    def refresh(self) -> None:
        """Order-0 shares of all symbols from their counts so far; each has at least one slot."""
        total = self.counts.sum(axis=1, dtype=np.int64)
        spare = (1 << SLOTS) - self.sizes
        inside = np.arange(self.width) < self.sizes[:, None]
        extra = self.counts * spare[:, None] // np.maximum(total, 1)[:, None]
        extra[total == 0] = (spare // np.maximum(self.sizes, 1))[total == 0, None]
        share = np.where(inside, extra + 1, 0)
        share[:, 0] += (1 << SLOTS) - share.sum(axis=1)
        start = np.cumsum(share, axis=1) - share
        self.share, self.start = share.reshape(-1).astype(np.int32), start.reshape(-1).astype(np.int32)
        self.slot: np.ndarray | None = None

    def slots(self) -> np.ndarray:
        if self.slot is None:
            n = len(self.sizes)
            self.slot = np.repeat(np.tile(np.arange(self.width, dtype=np.uint16), n), self.share)
        return self.slot

    def predict(self, n: int):
        """Places and predictions of the first `n` lanes."""
        lane, last = self.lane[:n], self.last[:n]
        hashed = (last * 40503 + self.before[:n] * 30011) & ((1 << CONTEXTS) - 1)
        at2, at1 = (lane << CONTEXTS) + hashed, lane * self.width + last
        two, one = self.sym2.take(at2), self.sym1.take(at1)
        conf2, conf1 = self.conf2.take(at2), self.conf1.take(at1)
        row = (lane << 5) + (conf2 << 3) + (conf1 << 1) + (two == one)
        weight = self.mix.take(row, 0)
        return at2, at1, two, one, conf2, conf1, row, weight[:, 0], weight[:, 1], weight

    def learn(self, n: int, symbol: np.ndarray, seen) -> None:
        at2, at1, two, one, conf2, conf1, row, _, _, weight = seen
        hit2, hit1 = two == symbol, one == symbol
        for sym, conf, at, was, old, hit in ((self.sym2, self.conf2, at2, two, conf2, hit2), (self.sym1, self.conf1, at1, one, conf1, hit1)):
            conf[at] = _CONFIDENCE.take((old << 1) + hit)
            sym[at] = np.where(hit | (old > 0), was, symbol)
        goal = np.empty((n, 2), np.int64)
        goal[:, 0] = np.where(hit2, 65536 - 256, 64)
        goal[:, 1] = np.where(hit1 & ~hit2, 65536 - 256, 64)
        goal -= weight
        goal >>= 5
        goal += weight
        self.mix[row] = goal
        self.counts.reshape(-1)[self.lane[:n] * self.width + symbol] += 24
        self.before[:n] = self.last[:n]
        self.last[:n] = symbol


class _Range:
    """A carry-less range coder of 64 bits that moves 16 bits at a time, for all lanes."""

    def __init__(self, n: int) -> None:
        self.low = np.zeros(n, U)
        self.range = np.full(n, (1 << 64) - 1, U)

    def unit(self, n: int) -> np.ndarray:
        return self.range[:n] >> U(UNIT + SLOTS)

    def narrow(self, n: int, unit: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.low[:n] += unit * start.astype(U)
        self.range[:n] = unit * size.astype(U)

    def ready(self, lanes: np.ndarray | slice) -> np.ndarray:
        """Which of the lanes have their leading 16 bits settled; a short range across a border is cut there."""
        low, wide = self.low[lanes], self.range[lanes]
        settled = ((low ^ (low + wide)) >> U(48)) == 0  # a range that just touches the border is not settled: it could grow past 64 bits
        short = ~settled & (wide <= _LOW_BITS)
        if short.any():
            wide[short] = (~low[short] + _ONE) & _LOW_BITS
            self.range[lanes] = wide
            settled |= short
        return settled

    def shift(self, lanes: np.ndarray) -> None:
        self.low[lanes] <<= U(16)
        self.range[lanes] <<= U(16)


def _active(sizes: np.ndarray) -> np.ndarray:
    """How many of the lanes, longest first, still run at each step."""
    return np.searchsorted(-sizes, -np.arange(sizes.max() if len(sizes) else 0), "left")


def _encode_lanes(blocks: list[np.ndarray], sizes: np.ndarray) -> list[bytes]:
    lengths = np.array([len(b) for b in blocks])
    n, steps = len(blocks), int(lengths.max())
    grid = np.zeros((steps, n), np.uint16)
    for k, block in enumerate(blocks):
        grid[:len(block), k] = block
    model, coder = _Model(sizes), _Range(n)
    out = np.empty((n, steps * 3 + 8), "<u2")
    used = np.zeros(n, np.int64)
    for step, m in enumerate(_active(lengths)):
        if step % REFRESH == 0 and step:
            model.refresh()
        symbol = grid[step, :m].astype(np.int64)
        seen = model.predict(m)
        two, one, w2, w1 = seen[2], seen[3], seen[7], seen[8]
        hit2 = two == symbol
        hit1 = (one == symbol) & ~hit2
        at = model.lane[:m] * model.width + symbol
        w0 = 65536 - w2 - w1
        start = np.where(hit2, 0, np.where(hit1, w2 << SLOTS, ((w2 + w1) << SLOTS) + w0 * model.start.take(at)))
        size = np.where(hit2, w2 << SLOTS, np.where(hit1, w1 << SLOTS, w0 * model.share.take(at)))
        coder.narrow(m, coder.unit(m), start, size)
        lanes = np.flatnonzero(coder.ready(slice(m)))
        while len(lanes):
            out[lanes, used[lanes]] = coder.low[lanes] >> U(48)
            used[lanes] += 1
            coder.shift(lanes)
            lanes = lanes[coder.ready(lanes)]
        model.learn(m, symbol, seen)
    for _ in range(4):
        out[np.arange(n), used] = coder.low >> U(48)
        used += 1
        coder.low <<= U(16)
    return [out[k, :used[k]].tobytes() for k in range(n)]


def _decode_lanes(coded: list[bytes], lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The grid [step, lane] of symbols."""
    n, steps = len(coded), int(lengths.max())
    words = np.zeros((n, max(len(c) // 2 for c in coded) + 8), np.uint16)
    for k, c in enumerate(coded):
        words[k, :len(c) // 2] = np.frombuffer(c, "<u2")
    grid = np.zeros((steps, n), np.uint16)
    model, coder = _Model(sizes), _Range(n)
    code = np.zeros(n, U)
    for k in range(4):
        code = (code << U(16)) | words[:, k].astype(U)
    used = np.full(n, 4, np.int64)
    for step, m in enumerate(_active(lengths)):
        if step % REFRESH == 0 and step:
            model.refresh()
        seen = model.predict(m)
        two, one, w2, w1 = seen[2], seen[3], seen[7], seen[8]
        unit = coder.unit(m)
        value = np.minimum((code[:m] - coder.low[:m]) // unit, U((1 << (UNIT + SLOTS)) - 1)).astype(np.int64)
        edge2, edge1 = w2 << SLOTS, (w2 + w1) << SLOTS
        w0 = 65536 - w2 - w1
        hit2 = value < edge2
        hit1 = (value < edge1) & ~hit2
        slot = np.maximum(value - edge1, 0) // w0
        symbol = np.where(hit2, two, np.where(hit1, one, model.slots().take((model.lane[:m] << SLOTS) + slot))).astype(np.int64)
        at = model.lane[:m] * model.width + symbol
        start = np.where(hit2, 0, np.where(hit1, edge2, edge1 + w0 * model.start.take(at)))
        size = np.where(hit2, edge2, np.where(hit1, w1 << SLOTS, w0 * model.share.take(at)))
        coder.narrow(m, unit, start, size)
        lanes = np.flatnonzero(coder.ready(slice(m)))
        while len(lanes):
            code[lanes] = (code[lanes] << U(16)) | words[lanes, np.minimum(used[lanes], words.shape[1] - 1)].astype(U)
            used[lanes] += 1
            coder.shift(lanes)
            lanes = lanes[coder.ready(lanes)]
        grid[step, :m] = symbol
        model.learn(m, symbol, seen)
    return grid


def _alphabet(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids of a block, and the place of each of its ids among them."""
    found, places = np.unique(part, return_inverse=True)
    return found, places.astype(np.uint16)


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Code unsigned 32-bit ids; blocks of `block` ids are independent.  No ids are a header alone."""
    ids = np.ascontiguousarray(ids, "<u4")
    parts = [ids[at:at + block] for at in range(0, len(ids), block)]
    table, alphabets, bodies = [], [], []
    for at in range(0, len(parts), LANES):
        group = parts[at:at + LANES]
        order = sorted(range(len(group)), key=lambda k: -len(group[k]))
        found = [_alphabet(group[k]) for k in order]
        coded = _encode_lanes([inverse for _, inverse in found], np.array([len(u) for u, _ in found]))
        back = {k: i for i, k in enumerate(order)}
        for k, part in enumerate(group):
            alphabet = found[back[k]][0]
            packed = zlib.compress(np.diff(alphabet, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)
            table.append((len(part), len(alphabet), len(packed), len(coded[back[k]]), zlib.crc32(part.tobytes())))
            alphabets.append(packed)
            bodies.append(coded[back[k]])
    head = struct.pack("<8sQQ", _MAGIC, len(ids), len(parts))
    return b"".join([head, np.array(table, "<u4").reshape(-1, 5).tobytes(), *(x for pair in zip(alphabets, bodies) for x in pair)])


def decode(raw: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks `first` to `last`, each checked against its sum."""
    magic, _, count = struct.unpack_from("<8sQQ", raw)
    if magic != _MAGIC:
        raise ValueError("not a coded stream of ids")
    table = np.frombuffer(raw, "<u4", count * 5, 24).reshape(-1, 5).astype(np.int64)
    ends = 24 + count * 20 + np.cumsum(table[:, 2] + table[:, 3])
    out = []
    wanted = np.arange(count)[first:last]
    for at in range(0, len(wanted), LANES):
        group = wanted[at:at + LANES]
        group = group[np.argsort(-table[group, 0], kind="stable")]
        coded, alphabets = [], []
        for k in group:
            start = int(ends[k] - table[k, 2] - table[k, 3])
            middle = start + int(table[k, 2])
            planes = np.frombuffer(zlib.decompress(raw[start:middle]), np.uint8).reshape(4, -1)
            alphabets.append(np.cumsum(np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)))
            coded.append(raw[middle:int(ends[k])])
        grid = _decode_lanes(coded, table[group, 0], table[group, 1])
        done = {}
        for lane, k in enumerate(group):
            ids = alphabets[lane][grid[:table[k, 0], lane]].astype("<u4")
            if zlib.crc32(ids.tobytes()) != table[k, 4]:
                raise ValueError(f"block {k} is damaged")
            done[k] = ids
        out += [done[k] for k in sorted(done)]
    return np.concatenate(out) if out else np.empty(0, "<u4")
