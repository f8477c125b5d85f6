"""Sampled segmentation over the piece lattice: forward filtering, backward sampling.

A text is cut before every run of blanks and around line breaks.  No piece of
the vocabulary crosses these cuts, so the lattice of a text is the chain of the
lattices of its chunks.  Forward filtering sums, for every byte position of a
chunk, the probabilities of all segmentations up to it; each arc into a position
has its share of that sum.  Backward sampling walks from the end of a chunk to
its start, drawing one arc a step.  Draws are a hash of (seed, row key, chunk
number, step): a row gets the same pieces wherever and however often it is
encoded, and another seed gives other pieces.

A piece's weight falls with its rank in the vocabulary, (rank + 2) ** -THETA.
Blanks become the space mark of the vocabulary and a blank is put before a
text, as the vocabulary's own encoder does.  Characters that are in no piece
(the space mark itself among them) become byte pieces, so decoding is lossless.

Lattices of different chunks are built once per worker and stored in flat
arrays; all chunks of a batch take each backward step together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, mix64, per_batch, table
from .lattice import PieceTable, forward
from .words import _BYTES, chunks, powers

THETA = 1.0
SEED = 20240
MARK = "▁".encode()
#: Arcs that a worker remembers, and bytes of text that it handles at once.
ARCS = 2_000_000
PART = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Bytes and weights of a SentencePiece vocabulary; blanks stand for its space mark."""

    def __init__(self, path: str, theta: float = THETA) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * size
        self.byte = np.zeros(256, np.int32)
        plain: list[int] = []
        for i in range(size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.bytes[i], self.byte[value] = bytes([value]), i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes[i] = model.id_to_piece(i).encode().replace(MARK, b" ")
                plain.append(i)
        pieces = [self.bytes[i] for i in plain]
        assert all(p.strip(b" ") == b"" or b" " not in p[1:] for p in pieces) and not any(b"\n" in p for p in pieces)
        self.table = PieceTable(pieces, plain)
        self.log_weight = -theta * np.log(np.arange(size) + 2.0)
        self.log_weight[self.byte] = -theta * np.log(size + 2.0)
        self.starts = np.cumsum([0, *map(len, self.bytes)])
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of a row's pieces: their bytes without the blank put before it."""
        sizes = (self.starts[ids + 1] - self.starts[ids]).astype(np.int64)
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(self.starts[ids], sizes)
        return self.flat[at].tobytes()[1:]


class Lattices:
    """Arcs of all chunks seen so far, by the node (byte position of some chunk) they lead into.

    ``first[node]`` is the first arc of a node, ``upto`` the running share of its
    arcs (the last is 1), ``back`` the length of an arc and ``id`` its piece.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.root: dict[int, int] = {}
        self.nodes = self.arcs = 0
        self.first, self.upto = np.zeros(1 << 16, np.int32), np.zeros(1 << 16)
        self.back, self.id = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)

    def _store(self, name: str, at: int, values: np.ndarray) -> None:
        array = getattr(self, name)
        if at + len(values) > len(array):
            array = np.concatenate([array[:at], np.zeros(max(len(array) // 2, 2 * len(values)), array.dtype)])
            setattr(self, name, array)
        array[at : at + len(values)] = values

    def _build(self, raw: np.ndarray, lengths: np.ndarray) -> None:
        start, end, ids, alone = self.pieces.table.arcs(raw, lengths)
        start, end = np.append(start, alone), np.append(end, alone + 1)
        ids = np.append(ids, self.pieces.byte[raw[alone]])
        order, inflow, total = forward(start, end, self.pieces.log_weight[ids][None, :], lengths)
        start, end, ids, inflow, total = start[order], end[order], ids[order], inflow[0], total[0]
        live = np.flatnonzero(np.isfinite(inflow))
        live = live[np.argsort(end[live], kind="stable")]
        start, end, ids = start[live], end[live], ids[live]
        share = np.exp(inflow[live] - total[end])
        heads = np.flatnonzero(np.append(True, end[1:] != end[:-1]))
        sizes = np.diff(np.append(heads, len(end)))
        upto = share.copy()
        for k in range(1, sizes.max()):  # node by node in the same order, whatever else is in the batch
            more = heads[sizes > k]
            upto[more + k] += upto[more + k - 1]
        upto[heads + sizes - 1] = 1.0
        first = np.zeros(len(raw), np.int32)
        first[end[heads] - 1] = self.arcs + heads
        for name, values in (("upto", upto), ("back", end - start), ("id", ids)):
            self._store(name, self.arcs, values)
        self._store("first", self.nodes, first)
        self.nodes += len(raw)
        self.arcs += len(end)

    def roots(self, hashes: list[int], chunk_of) -> np.ndarray:
        """End nodes of the chunks with these hashes; unknown ones are built from ``chunk_of(place)``."""
        if self.arcs > ARCS:
            self.clear()
        new = [k for k, h in enumerate(hashes) if h not in self.root]
        if new:
            missing = [chunk_of(k) for k in new]
            lengths = np.fromiter(map(len, missing), np.int64, len(missing))
            ends = (self.nodes + np.cumsum(lengths) - 1).tolist()
            self._build(np.frombuffer(b"".join(missing), np.uint8), lengths)
            self.root.update(zip((hashes[k] for k in new), ends, strict=True))
        return np.fromiter(map(self.root.__getitem__, hashes), np.int64, len(hashes))

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An arc into each node: the first whose running share exceeds ``u``."""
        arc = self.first[node].astype(np.int64)
        late = np.flatnonzero(self.upto[arc] <= u)
        while len(late):
            arc[late] += 1
            late = late[self.upto[arc[late]] <= u[late]]
        return arc


def encode(texts: list[bytes | None], keys: np.ndarray, lattices: Lattices, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all texts in a row, and the number of pieces of each text."""
    full = [(b" " + t) if t else b"" for t in texts]
    data = b"".join(full)
    raw = np.frombuffer(data, np.uint8)
    counts = np.zeros(len(texts), np.int64)
    if not len(raw):
        return np.zeros(0, np.int32), counts
    sizes = np.fromiter(map(len, full), np.int64, len(full))
    text_starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    opens = (raw == 10) | (raw == 32)
    opens[1:] &= (raw[1:] == 10) | (raw[:-1] != 32)
    opens[1:] |= raw[:-1] == 10
    opens[text_starts] = True
    starts = np.flatnonzero(opens)
    lengths = np.diff(np.append(starts, len(raw)))
    place = np.arange(len(raw)) - np.repeat(starts, lengths)
    hashes = mix64(np.add.reduceat(_BYTES[raw] * powers(int(lengths.max()))[place], starts))
    unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    ends = lattices.roots(unique.tolist(), lambda k: data[starts[first[k]] : starts[first[k]] + lengths[first[k]]])
    text = np.searchsorted(np.cumsum(sizes), starts, side="right")
    number = np.arange(len(starts)) - np.searchsorted(starts, (np.cumsum(sizes) - sizes)[text])
    state = mix64(mix64(keys.astype(np.uint64) ^ np.uint64(seed))[text] + number.astype(np.uint64) * _STEP)
    node, left = ends[inverse], lengths.astype(np.int32)
    active = np.arange(len(starts))
    who, what, step = [], [], 0
    while len(active):
        arc = lattices.draw(node, (mix64(state[active] + np.uint64(step)) >> np.uint64(11)) * 2.0**-53)
        who.append(active)
        what.append(lattices.id[arc])
        back = lattices.back[arc]
        node, left = node - back, left - back
        more = left > 0
        active, node, left = active[more], node[more], left[more]
        step += 1
    per_chunk = np.zeros(len(starts), np.int64)
    for w in who:
        per_chunk[w] += 1
    stop = np.cumsum(per_chunk)
    ids = np.zeros(stop[-1], np.int32)
    for s, (w, x) in enumerate(zip(who, what, strict=True)):
        ids[stop[w] - 1 - s] = x
    return ids, np.bincount(text, weights=per_chunk, minlength=len(texts)).astype(np.int64)


_stores: dict[tuple[str, float], Lattices] = {}


def lattices(path: str, theta: float = THETA) -> Lattices:
    """The lattices of this Python worker."""
    if (path, theta) not in _stores:
        _stores[path, theta] = Lattices(Pieces(path, theta))
    return _stores[path, theta]


def sampled_pieces(docs: DataFrame, model: str, seed: int = SEED, theta: float = THETA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, lossless, n_pieces, ids_crc32) per row of ``docs``.

    lossless says that decoding gave the text back, byte for byte; ids_crc32 is
    the crc32 of the ids as little-endian unsigned 32-bit integers.

    NULL and empty texts have no pieces.  Rows that repeat an id and a text get
    the same pieces; rows without an id share the key 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = lattices(model, theta)
        for rows in batches:
            texts, keys = bytes_of(rows.column(1)), rows.column(0).fill_null(0).to_numpy()
            for part in chunks(texts, PART):  # a part at a time, so that memory does not follow the size of batches
                ids, counts = encode(texts[part], keys[part], store, seed)
                ends = np.cumsum(counts)
                own = [ids[e - n : e] for n, e in zip(counts, ends, strict=True)]
                same = [store.pieces.decode(x) == (t or b"") for x, t in zip(own, texts[part], strict=True)]
                crc = [zlib.crc32(x.astype("<u4", copy=False).tobytes()) for x in own]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).slice(part.start, len(own)), lists, pa.array(same), pa.array(counts), pa.array(crc, pa.int64())],
                    ["doc_id", "ids", "lossless", "n_pieces", "ids_crc32"],
                )

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, ids array<int>, lossless boolean, n_pieces bigint, ids_crc32 bigint")


def decoded(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text): the texts of ``ids``; NULL ids and no ids give an empty text."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        pieces = lattices(model).pieces
        texts = [pieces.decode(np.array(x or [], np.int64)).decode() for x in rows.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return per_batch(encoded.select("doc_id", "ids"), batch, "doc_id bigint, text string")


def op7_sampled_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoded = sampled_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "n_pieces", "ids_crc32", "lossless")
