"""Occurrences of vocabulary pieces in many short strings at once, and sums over their chains."""

from __future__ import annotations

import numpy as np

from .common import mix64
from .words import _BYTES, powers

PREFIX_BITS = 22
_SHIFT = np.uint64(64 - PREFIX_BITS)


def _hash(p: bytes) -> int:
    raw = np.frombuffer(p, np.uint8)
    return int(mix64((_BYTES[raw] * powers(len(raw))).sum(keepdims=True))[0])


class PieceTable:
    """Pieces by their bytes, numbered by the caller."""

    def __init__(self, pieces: list[bytes], ids: list[int]) -> None:
        hashes = np.array([_hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(ids, np.int32)[order]
        #: Whether any piece begins with bytes of this hash (its top bits); hits are looked up exactly.
        self.opens = np.zeros(1 << PREFIX_BITS, bool)
        self.opens[(np.array([_hash(p[:n]) for p in pieces for n in range(1, len(p) + 1)], np.uint64) >> _SHIFT).astype(np.int64)] = True
        self.longest = max(map(len, pieces))

    def arcs(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id) of every piece in the strings of these lengths that stand one behind another in ``raw``.

        The last result are the bytes of the characters that are no piece alone.
        """
        stops = np.repeat(np.cumsum(lengths), lengths)
        lead = (raw < 128) | (raw >= 192)
        char = np.cumsum(lead) - 1
        width = np.diff(np.append(np.flatnonzero(lead), len(raw)))
        spelled = np.ones(len(width), bool)
        at, h = np.flatnonzero(lead), np.zeros(lead.sum(), np.uint64)
        out = [(at[:0], at[:0], self.ids[:0])]
        for n in range(1, self.longest + 1):
            fits = at + n <= stops[at]
            at, h = at[fits], h[fits]
            h = h + _BYTES[raw[at + n - 1]] * powers(n)[n - 1]
            mixed = mix64(h)
            some = self.opens[(mixed >> _SHIFT).astype(np.int64)]
            at, h, mixed = at[some], h[some], mixed[some]
            if not len(at):
                break
            found = np.minimum(np.searchsorted(self.hashes, mixed), len(self.hashes) - 1)
            hit = self.hashes[found] == mixed
            start = at[hit]
            out.append((start, start + n, self.ids[found[hit]]))
            spelled[char[start[width[char[start]] == n]]] = False
        start, end, ids = (np.concatenate(x) for x in zip(*out, strict=True))
        return start, end, ids, np.flatnonzero(spelled[char])


def forward(start: np.ndarray, end: np.ndarray, weight: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, inflow, total) of forward filtering, all strings together, byte position by byte position.

    ``weight`` has log-weights of the arcs, one row per model.  ``order`` puts the
    arcs by their end's depth; ``inflow`` is, in that order, the log-sum of all
    chains whose last arc this is, and ``total`` the log-sum of all chains to an
    end position.
    """
    offsets = np.repeat(np.cumsum(lengths) - lengths, lengths)
    depth = end - offsets[end - 1]
    order = np.lexsort((end, depth))
    start, end, depth, weight = start[order], end[order], depth[order], weight[:, order]
    opening = start == offsets[start]
    total = np.full((len(weight), int(lengths.sum()) + 1), -np.inf)
    inflow = np.empty_like(weight)
    cuts = np.searchsorted(depth, np.arange(1, depth.max(initial=0) + 2))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        inflow[:, a:b] = weight[:, a:b] + np.where(opening[a:b], 0.0, total[:, start[a:b]])
        heads = np.flatnonzero(np.append(True, end[a + 1 : b] != end[a : b - 1]))
        total[:, end[a:b][heads]] = np.logaddexp.reduceat(inflow[:, a:b], heads, axis=1)
    return order, inflow, total
