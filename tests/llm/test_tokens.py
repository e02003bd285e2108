import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.fs
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vacantia.llm import bpe, token_files
from vacantia.llm.packing import ByteEncoder
from vacantia.llm.tokens import Encoder, tokenizer

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = list(" \t\n\r\x0b\x0c\x1c\x1d\x85\xa0    　abC'sstreé́İΣς1²½5,.!<|>名前한가😀ß\xad​‍﻿_-") + [
    "'ll", "'re", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", " the", "The "]


@pytest.mark.parametrize("path,keep", [(WORD, False), (BYTE, True)])
def test_chunks_give_the_ids_of_the_library(path, keep):
    encoder, rng = Encoder(path, keep), random.Random(7)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, np.uint32).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_byte_encoder_gives_the_ids_of_the_library():
    encoder, rng = ByteEncoder(BYTE), random.Random(8)
    for text in ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + ["x" * 50_000, " " * 50_000]:
        assert encoder.encode(text).tolist() == encoder.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("buckets", [None, 3])
def test_encode_and_decode(documents, odd, buckets, monkeypatch):
    library = tokenizer(WORD)
    want = Counter()
    for r in documents.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, np.array(ids, np.uint32).tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
    if buckets:
        monkeypatch.setattr(bpe, "BLOCK", 5000)
        monkeypatch.setattr(bpe, "ROW", 100)
    got = Counter((r.doc_id, bytes(r.ids), r.decoded) for r in bpe.encode_decode(odd, WORD, buckets=buckets).collect())
    assert got == want
    assert bpe.encode_decode(documents.limit(0), WORD).count() == 0


def test_decode_join():
    pieces = pa.table({"id": [1, 2], "piece": [b"a</w>", b"b"]})
    lists = [np.array(x, np.uint32).tobytes() for x in ([2, 1, 1], [], [9, 2], [9])]
    assert bpe.spelled(lists, pieces) == [b"b a</w> a</w>", b"", b"b", b""] and bpe.spelled([], pieces) == []


def test_words_are_split_as_the_tokenizer_does(spark):
    encoder, rng = Encoder(WORD, False), random.Random(5)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", bpe.words("t").alias("w")).collect()
    assert all(r.w == encoder.chunks(r.t.lower() if r.t.isascii() and "<|" not in r.t else r.t) for r in rows)


def test_files(spark, documents, odd):
    library = tokenizer(WORD)
    table = odd.union(odd.filter("doc_id = 100000").withColumn("doc_id", F.lit(None).cast("long")))
    manifest, folder = token_files.write_tokens(table, WORD)
    got = token_files.read_tokens(manifest, folder).collect()
    rows = sorted(((r.doc_id, r.text) for r in documents.collect()), key=lambda r: r[0])
    texts = dict(rows) | {None: rows[-20][1]}
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [r[0] for r in rows]
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        ids = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert r.start == at and np.frombuffer(r.ids, np.uint32).tolist() == ids and r.n_tokens == len(ids)
        at += len(ids)
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])
    some = token_files.read_tokens(manifest, folder, {rows[3][0], rows[-1][0]}).collect()
    assert {(r.doc_id, r.start) for r in some} == {(r.doc_id, r.start) for r in got if r.doc_id in (rows[3][0], rows[-1][0])}
    manifest, folder = token_files.write_tokens(documents.limit(0), WORD)
    assert token_files.read_tokens(manifest, folder).count() == 0


def test_frames_are_independent_and_checked(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME", 8)
    path = tmp_path / "x.tok"
    docs = [(i, np.arange(i, 2 * i, dtype=np.uint32).tobytes()) for i in range(12)]
    with path.open("wb") as out:
        writer = token_files.FrameWriter(out)
        for key, ids in docs:
            writer.add(key, ids)
        writer.close()
    raw = path.read_bytes()
    system = pyarrow.fs.LocalFileSystem()
    with system.open_input_file(str(path)) as source:
        assert [(k, i) for k, _, i in token_files.read_documents(source)] == docs
    n, flags, magic = struct.unpack("<IBI", raw[-9:])
    assert n > 5 and flags == 0x80 and magic == 0x8F92EAB1
    path.write_bytes(b"\0" * 20 + raw[20:])  # the first frame is damaged, others can still be read
    with system.open_input_file(str(path)) as source:
        assert [(k, i) for k, _, i in token_files.read_documents(source, {11})] == docs[11:]
    with system.open_input_file(str(path)) as source, pytest.raises(Exception):
        list(token_files.read_documents(source))
    with system.open_input_file(str(tmp_path / "x.tok")) as source:
        assert zlib.crc32(docs[11][1]) == zlib.crc32(next(iter(token_files.read_documents(source, {11})))[2])
    assert hashlib.sha256(docs[0][1]).hexdigest()
