"""Token ids of whole texts, with words that were met before taken from a cache."""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: White space other than space and line feed, and the mark below: such texts go to the library whole.
_OTHER = re.compile("[\x01\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_FIRST = "\x01"
_LOADED: dict[tuple[str, int], "Encoder"] = {}


def encoder(path: str, limit: int = 800_000) -> "Encoder":
    """One encoder a worker process and file."""
    if (path, limit) not in _LOADED:
        _LOADED[path, limit] = Encoder(path, limit)
    return _LOADED[path, limit]


class Encoder:
    """Encodes as the library does on the whole text with `add_special_tokens` off.

    Both kinds of tokenizer split texts before any white space that follows other characters, so pieces "white space and
    word" can be encoded alone.  Texts that hold the string of an added token go to the library whole.  About `limit` pieces, of 40 characters each, are remembered; then the cache starts anew.
    """

    def __init__(self, path: str, limit: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.hint = os.path.commonprefix(special)
        self.hint = self.hint if self.hint.lower() == self.hint.upper() else ""
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)", re.IGNORECASE)
        self._clear()

    def _clear(self) -> None:
        self.places: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.used = self.chars = 0

    def _learn(self, pieces: list[str]) -> None:
        # words after a space are encoded many at a time, as one text; the tokens' places in it tell the words apart
        pieces = sorted(pieces, key=lambda p: p[:1] in ("\n", _FIRST))
        plain = next((k for k, p in enumerate(pieces) if p[:1] in ("\n", _FIRST)), len(pieces))
        found, sizes = [], []
        for at in range(0, plain, 2048):
            part = pieces[at:min(plain, at + 2048)]
            seen = self.tokenizer.encode(" " + " ".join(part), add_special_tokens=False)
            edges = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            begins = np.fromiter((a for a, _ in seen.offsets), np.int64, len(seen.ids))
            found.append(np.array(seen.ids, np.int32))
            sizes.append(np.bincount(np.searchsorted(edges, begins, "right"), minlength=len(part)))
        alone = [p if p[:1] == "\n" else p[1:] for p in pieces[plain:]]
        for at in range(0, len(alone), 4096):
            each = [e.ids for e in self.tokenizer.encode_batch_fast(alone[at:at + 4096], add_special_tokens=False)]
            found.append(np.fromiter(chain.from_iterable(each), np.int32))
            sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
        ids, counts = np.concatenate(found), np.concatenate(sizes)
        place = len(self.places)
        while place + len(pieces) + 1 > len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros(len(self.starts), np.int64)))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty(len(self.ids), np.int32)))
        self.ids[self.used:self.used + len(ids)] = ids
        self.starts[place + 1:place + 1 + len(pieces)] = self.used + np.cumsum(counts)
        self.used += len(ids)
        self.chars += sum(map(len, pieces))
        self.places.update(zip(pieces, range(place, place + len(pieces))))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds)."""
        out: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):  # a few MB of text at a time
            end, size = at, 0
            while end < len(texts) and (end == at or size < 2_000_000):
                size += len(texts[end] or "")
                end += 1
            part, counts[at:end] = self._encode(texts[at:end])
            out.append(part)
            at = end
        return (np.concatenate(out) if out else np.empty(0, np.int32)), np.concatenate(([0], np.cumsum(counts)))

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.places) > self.limit or self.chars > 40 * self.limit:
            self._clear()
        pieces: list[str] = []
        sizes = np.zeros(len(texts), np.int64)
        whole: dict[int, np.ndarray] = {}
        for i, text in enumerate(texts):
            if not text:
                continue
            whole_text = _OTHER.search(text) or (self.hint in text and self.special.search(text))
            words = None if whole_text else text.replace("\n", " \n").split(" ")
            if words is not None:
                first = words[0]
                if text[0] == "\n":
                    words = words[1:]
                else:
                    words[0] = _FIRST + first
                if "" in words or "\n" in words or _FIRST in words:
                    words = None  # runs of white space
            if words is None:
                whole[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
                continue
            pieces += words
            sizes[i] = len(words)
        place = np.fromiter(map(self.places.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(place < 0)
        if len(missing):
            self._learn(list(dict.fromkeys(pieces[k] for k in missing)))
            place[missing] = [self.places[pieces[k]] for k in missing]
        first = self.starts[place]
        length = self.starts[place + 1] - first
        ends = np.cumsum(length)
        spot = np.repeat(first - ends + length, length)
        spot += np.arange(len(spot))
        ids = self.ids[spot]
        edge = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))]
        counts = np.diff(edge)
        if whole:
            parts = [whole.get(i, ids[edge[i]:edge[i + 1]]) for i in range(len(texts))]
            counts = np.array([len(p) for p in parts], np.int64)
            ids = np.concatenate(parts)
        return ids, counts
