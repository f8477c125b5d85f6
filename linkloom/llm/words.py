"""Words of many texts at once, as positions and hashes in flat arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import mix64

#: Bytes of words after A-Z are lower-cased: digits, a-z and all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
ALNUM[128:] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers = np.ones(1, np.uint64)
CHUNK = 4 << 20


def powers(n: int) -> np.ndarray:
    """_BASE to the power 0..n-1, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        size = max(n, 64, 2 * len(_powers))
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE, np.uint64)]))
    return _powers[:n]


class Words:
    """Words of a list of texts: byte spans in ``data``, the text of each word, and 64-bit hashes."""

    def __init__(self, texts: list[bytes | None], is_word: np.ndarray = ALNUM) -> None:
        self.data = b"\n".join(t or b"" for t in texts).lower()
        raw = np.frombuffer(self.data, np.uint8)
        lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        text_starts = np.cumsum(lengths + 1) - lengths - 1
        inside = is_word[raw]
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        #: Index of the first word of each text, and the number of all words at the end.
        self.first = np.append(np.searchsorted(self.starts, text_starts), len(self.starts))
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        self._raw, self._inside = raw, inside

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        if not len(self):
            return np.zeros(0, np.uint64)
        sizes = self.ends - self.starts
        at = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) - np.repeat(at, sizes)
        return mix64(np.add.reduceat(_BYTES[self._raw[self._inside]] * powers(int(sizes.max()))[place], at))

    def byte_hashes(self, at: np.ndarray) -> np.ndarray:
        """Random values of the bytes at these places."""
        return _BYTES[self._raw[at]]

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].decode("utf-8", "replace")

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k words in a row from each word on, and whether they lie in one text."""
        n = max(0, len(hashes) - k + 1)
        out = np.zeros(n, np.uint64)
        for j, p in enumerate(powers(k)):
            out += hashes[j : j + n] * p
        return mix64(out + np.uint64(k)), self.text[:n] == self.text[k - 1 : k - 1 + n]


def chunks(texts: list[bytes | None], size: int = CHUNK) -> Iterator[slice]:
    """Runs of texts of about ``size`` bytes; a longer text is a run of its own."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > size:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(texts):
        yield slice(start, len(texts))


def winnow(grams: np.ndarray, valid: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest gram (the last, if equal) of every window of ``window`` valid grams."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    least, place, whole, span = grams, np.arange(len(grams)), valid, 1
    while span < window:  # each step joins two windows, which may overlap
        by = min(span, window - span)
        better = least[by:] <= least[:-by]
        least = np.where(better, least[by:], least[:-by])
        place = np.where(better, place[by:], place[:-by])
        whole = whole[by:] & whole[:-by]
        span += by
    place = place[whole]  # never falls from one window to the next
    return place[np.diff(place, prepend=-1) > 0]
