import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from linkloom.llm import records as R
from linkloom.llm.common import new_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    tool, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tool.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip_and_index(spark, make_docs, odd_texts):
    folder = new_path(spark, "records")
    manifest = R.write_records(make_docs(odd_texts), folder, PATH, end_id=2, file_bytes=20_000)
    got = [tuple(r) for r in R.read_records(manifest, folder).collect()]
    assert sorted(got, key=str) == sorted(expected(odd_texts), key=str)
    tool, texts = Tokenizer.from_file(PATH), sorted(t or "" for _, t in odd_texts)
    files = manifest.collect()
    random.Random(1).shuffle(files)
    found = [tool.decode(R.read_at(folder, f.name, n)[1][:-1], skip_special_tokens=False) for f in files for n in reversed(range(f.records))]
    assert sorted(found) == texts


def test_encoder_matches_library():
    rng = random.Random(3)
    parts = ["a", "B", " ", "  ", "\n", "\n\n", "\t", "'s", "é", "😀", "12", "...", " ", " ", "<|endoftext|>", "\x01", "\r\n", "Straße", "​"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)]
    tool, encoder = Tokenizer.from_file(PATH), R.Encoder(PATH)
    for i in range(0, len(texts), 300):
        for text, ids in zip(texts[i : i + 300], encoder.encode(texts[i : i + 300]), strict=True):
            assert np.frombuffer(ids, encoder.dtype).tolist() == tool.encode(text, add_special_tokens=False).ids, repr(text)


def test_damage_is_found(spark, make_docs):
    folder = new_path(spark, "records")
    name = R.write_records(make_docs(["some words here"]), folder, PATH).first().name
    path = f"{folder.removeprefix('file://')}/{name}.rec"
    with open(path, "r+b") as file:
        file.seek(30)
        byte = file.read(1)
        file.seek(30)
        file.write(bytes([byte[0] ^ 1]))
    with pytest.raises(ValueError, match="damaged"):
        R.read_at(folder, name, 0)


def test_empty(spark, make_docs):
    folder = new_path(spark, "records")
    assert R.read_records(R.write_records(make_docs([]), folder, PATH), folder).collect() == []


def test_long_texts_and_runs():
    encoder, tool = R.Encoder(PATH), Tokenizer.from_file(PATH)
    texts = ["", "word " * 300_000, "x" * 500_000, " lead", "tail ", "\n", "a\n\nb", "a \n b"]
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)] == [tool.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.encode([]) == []
    sizes = np.array([5, R.BATCH, 7, 0, 3 * R.BATCH, 1])
    parts = list(R.slices(sizes))
    assert [i for p in parts for i in range(p.start, p.stop)] == list(range(6)) and list(R.slices(sizes[:0])) == []


def test_folders_of_object_stores(monkeypatch):
    seen = []
    monkeypatch.setattr(R.fs, "FileSystem", type("F", (), {"from_uri": staticmethod(lambda u: seen.append(u) or (None, u))}))
    for uri in ("s3a://bucket/f", "s3n://bucket/f", "s3://bucket/f", "file:///tmp/f"):
        R.filesystem(uri)
    assert seen == ["s3://bucket/f"] * 3 + ["file:///tmp/f"]
