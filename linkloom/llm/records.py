"""Token sequences in length-delimited binary records, with a separate offset index.

A record file is a run of frames, all numbers little-endian:

    u64 length | u32 mask(crc32(length bytes)) | payload | u32 mask(crc32(payload))

mask(c) = rotate_right(c, 15) + 0xA282EAD8 mod 2**32, so that a checksum of data
that holds checksums stays meaningful.  A payload is u8 bytes per id (2 or 4),
u8 whether there is a doc_id, i64 doc_id, then the ids.  The index file beside it
holds a u64 frame offset per record; its length gives the number of records, so
any record is read with two small reads.

Rows are range-partitioned and sorted by doc_id (NULL first), each task writes
its rows in order and starts a new file at ``file_bytes``.  A task attempt uses
file names of its own and only finished attempts enter the manifest, so a lost
executor or a speculative copy leaves unlisted files, never doubled records.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, partitions_of, staged, table

MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
INNER = struct.Struct("<BBq")
#: White space other than the blank, by any of the definitions in use.
WHITE = re.compile(r"[\t\n\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]")
#: Pieces in the cache, and pieces of one joined text.
CACHE = 800_000
JOINED = 4000
#: Bytes of texts that are cut into pieces at once.
BATCH = 4 << 20


def mask(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


class Encoder:
    """Ids of whole texts as little-endian bytes, with a cache of pieces.

    The pre-tokenizer always cuts before a blank that stands between two visible
    characters, and on both sides of such a line break; pieces between these cuts
    are encoded once and remembered.  Texts with other white space, or with two
    white characters in a row, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        (_, blank, *_), (self.newline, *_) = self._ids(["a b", "\n"])
        mark = self.tokenizer.id_to_token(blank)[0]
        #: Whether a token begins with a blank, as the first of a piece does, and no other.
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith(mark) for i in range(size)])
        self._reset()

    def _reset(self) -> None:
        #: Number of each piece; 0 and 1 have no ids of their own.
        self.cache: dict[str, int] = {"": 0, " ": 1}
        self.store, self.sizes, self.alone = np.zeros(0, self.dtype), np.zeros(2, np.int64), np.ones(2, bool)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str], glue: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of pieces that all begin with a blank, or all not, encoded as a few long texts."""
        groups = [pieces[i : i + JOINED] for i in range(0, len(pieces), JOINED)]
        found, sizes = [], []
        for group, got in zip(groups, self._ids([glue.join(g) for g in groups]), strict=True):
            ids = np.array(got, self.dtype)
            if glue:
                breaks = np.flatnonzero(ids == self.newline)
                size = np.diff(np.concatenate([[-1], breaks, [len(ids)]])) - 1
                ids = np.delete(ids, breaks)
            else:
                size = np.diff(np.concatenate([np.flatnonzero(self.opens[ids]), [len(ids)]]))
            if len(size) != len(group) or size.min() == 0:  # not cut as expected: each by itself
                each = self._ids(group)
                ids, size = np.array([x for e in each for x in e], self.dtype), np.array([len(e) for e in each])
            found.append(ids)
            sizes.append(size)
        return np.concatenate(found or [np.zeros(0, self.dtype)]), np.concatenate(sizes or [np.zeros(0, np.int64)])

    def _learn(self, missing: list[str]) -> None:
        whole = [c for c in missing if WHITE.search(c) and c != "\n"]
        rest = [c for c in missing if c == "\n" or not WHITE.search(c)] if whole or "\n" in missing else missing
        blank = [c for c in rest if c[0] == " "]
        other = [c for c in rest if c[0] != " " and c != "\n"]
        lines = [c for c in rest if c == "\n"]
        parts = [self._joined(blank, ""), self._joined(other, "\n"), self._joined(lines, "")]
        for i, c in enumerate([*blank, *other, *lines, *whole], len(self.cache)):
            self.cache[c] = i
        self.store = np.concatenate([self.store, *[ids for ids, _ in parts]])
        self.sizes = np.concatenate([self.sizes, *[n for _, n in parts], np.zeros(len(whole), np.int64)])
        self.alone = np.concatenate([self.alone, np.zeros(len(rest), bool), np.ones(len(whole), bool)])

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text.  Arrow cuts texts into pieces and numbers them; Python sees every different piece once a call."""
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        marked = pc.replace_substring(pc.replace_substring(column.cast(pa.large_string()), " ", "\x01 "), "\n", "\x01\n\x01")
        cut = pc.split_pattern(marked, "\x01")
        pieces = cut.flatten().dictionary_encode()
        known = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.cache) + len(known) > CACHE:
            self._reset()
        if missing := [x for x in known if x not in self.cache]:
            self._learn(missing)
        which = np.fromiter(map(self.cache.__getitem__, known), np.int64, len(known))[pieces.indices.to_numpy()]
        first, long = np.cumsum(self.sizes) - self.sizes, self.sizes[which]
        # ids of the pieces one after another: the place in the store, counted on within each piece
        ends = np.cumsum(long)
        flat = self.store[np.repeat(first[which] - ends + long, long) + np.arange(long.sum())]
        data, width, offsets = flat.tobytes(), self.dtype.itemsize, cut.offsets.to_numpy()
        bounds = (np.concatenate([[0], ends])[offsets] * width).tolist()
        out = [data[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        # texts with a piece that has no ids of its own, or with the mark itself, are encoded whole
        odd = np.concatenate([[0], np.cumsum(self.alone[which])])[offsets]
        lost = np.flatnonzero((np.diff(odd) > 0) | pc.match_substring(column, "\x01").to_numpy(zero_copy_only=False))
        whole = [i for i in lost.tolist() if len(column[i].as_py())]
        for i, x in zip(whole, self._ids([column[i].as_py() for i in whole]), strict=True):
            out[i] = np.array(x, self.dtype).tobytes()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of texts of about BATCH bytes; a longer text is a run of its own."""
    number = (np.cumsum(sizes) - sizes) // BATCH
    cuts = np.concatenate([np.flatnonzero(np.diff(number, prepend=-1)), [len(sizes)]]).tolist()
    yield from map(slice, cuts[:-1], cuts[1:])


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the path in it; Hadoop's names of the S3 scheme are known too."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder))


class Writer:
    """One pair of record and index files after another."""

    def __init__(self, folder: str, file_bytes: int) -> None:
        self.system, self.folder = filesystem(folder)
        self.limit, self.done, self.file = file_bytes, [], None
        self.attempt = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"

    def add(self, doc_id: int | None, ids: bytes, width: int) -> None:
        if self.file is None:
            self.name = f"{self.attempt}-{len(self.done):05d}"
            self.file = self.system.open_output_stream(f"{self.folder}/{self.name}.rec", buffer_size=1 << 20)
            self.size, self.offsets, self.ids = 0, [], 0
        payload = INNER.pack(width, doc_id is not None, doc_id or 0) + ids
        length = struct.pack("<Q", len(payload))
        self.offsets.append(self.size)
        self.file.write(length + struct.pack("<I", mask(zlib.crc32(length))) + payload + struct.pack("<I", mask(zlib.crc32(payload))))
        self.size += HEAD.size + len(payload) + 4
        self.ids += len(ids) // width
        if self.size >= self.limit:
            self.close()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            with self.system.open_output_stream(f"{self.folder}/{self.name}.idx") as index:
                index.write(np.array(self.offsets, "<u8").tobytes())
            self.done.append((self.name, len(self.offsets), self.ids, self.size))
            self.file = None


MANIFEST = "part int, number int, name string, records bigint, ids bigint, bytes bigint"


def write_records(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = 64 << 20
) -> DataFrame:
    """Write ``docs`` below ``folder``; the written manifest (one row per file, with ``start``: ids before the file).

    A NULL text is an empty one; ``end_id`` is put behind every document.  Rows
    that repeat an id stand beside each other.  An empty table writes no file.
    """
    tail = () if end_id is None else (end_id,)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, writer = encoder(tokenizer), None
        width, end = tool.dtype.itemsize, np.array(tail, tool.dtype).tobytes()
        for rows in batches:
            ids, texts = rows.column(0).to_pylist(), rows.column(1)
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            for part in slices(sizes):
                writer = writer or Writer(folder, file_bytes)
                for doc_id, x in zip(ids[part], tool.encode(texts[part]), strict=True):
                    writer.add(doc_id, x + end, width)
        if writer is not None:
            writer.close()
            part, names = TaskContext.get().partitionId(), list(zip(*writer.done, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(writer.done), pa.int32()), pa.array(range(len(writer.done)), pa.int32()), *map(pa.array, names)],
                ["part", "number", "name", "records", "ids", "bytes"],
            )

    spark = docs.sparkSession
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).mkdirs(path)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(partitions_of(docs), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = staged(dealt.mapInArrow(write, MANIFEST), "manifest")
    return manifest.withColumn("start", F.expr("coalesce(sum(ids) over (order by part, number rows between unbounded preceding and 1 preceding), 0)"))


def frames(stream, verify: bool = True) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a record stream, in order; ValueError where a checksum does not fit."""
    while head := stream.read(HEAD.size):
        length, check = HEAD.unpack(head)
        body = stream.read(length + 4)
        if verify and (check != mask(zlib.crc32(head[:8])) or int.from_bytes(body[-4:], "little") != mask(zlib.crc32(body[:-4]))):
            raise ValueError("damaged record")
        width, known, doc_id = INNER.unpack_from(body)
        yield (doc_id if known else None), np.frombuffer(body, f"<u{width}", offset=INNER.size, count=(length - INNER.size) // width)


def read_at(folder: str, name: str, number: int) -> tuple[int | None, np.ndarray]:
    """One record by its number, through the index."""
    system, base = filesystem(folder)
    with system.open_input_file(f"{base}/{name}.idx") as index:
        index.seek(8 * number)
        offset = int.from_bytes(index.read(8), "little")
    with system.open_input_file(f"{base}/{name}.rec") as file:
        file.seek(offset)
        return next(frames(file))


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record; checksums are verified.

    ids_crc32 is the crc32 of the ids as little-endian unsigned 32-bit integers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        for files in batches:
            for name, start in zip(files.column(0).to_pylist(), files.column(1).to_pylist(), strict=True):
                with system.open_input_stream(f"{base}/{name}.rec", buffer_size=1 << 20) as stream:
                    found = [(d, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, x in frames(stream)]
                doc_ids, counts, crcs = zip(*found, strict=True)
                ends = start + np.cumsum(counts, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(ends - counts), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = manifest.select("name", F.col("start").cast("bigint").alias("start")).repartition(partitions_of(manifest))
    return files.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op5_token_records(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "records")
    manifest = write_records(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_records(manifest, folder)
