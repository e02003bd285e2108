"""Byte-pair encoding through a table of distinct words, and decoding through a join of ids with pieces."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import packed, shared_folder, unpacked
from .tokens import SPACE, Encoder, tokenizer

# characters of the texts of a block, which share one word list, and words of the texts packed in one row
BLOCK, ROW = 16 << 20, 200_000
# compression of what is stored and shuffled: time for disk
LEVEL = 9
ROWS = "block long, bucket int, keys array<{kind}>, blob binary"


def words(text: str) -> Column:
    """Words of a whole text (null: none), in order.

    The file's tokenizer lower-cases, so where that is sure to be A-Z alone it is done here: fewer distinct words."""
    text = F.coalesce(F.col(text), F.lit(""))
    plain = (F.octet_length(text) == F.length(text)) & ~text.contains("<|")
    return F.filter(F.split(F.when(plain, F.lower(text)).otherwise(text), f"[{SPACE}]+", -1), lambda w: w != "")


def _parts(raw: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    return [raw[s:e] for s, e in zip([0, *ends], ends)]


def _numbered(buckets: int):
    def run(batches):
        """Blocks of texts: rows of texts as the numbers of their words, and a row per bucket of the block's distinct words."""
        block, kind = TaskContext.get().partitionId() << 33, None
        keys, sizes, flat, held = [], [], [], 0

        def flush():
            found = pa.chunked_array(flat, pa.string()).combine_chunks().dictionary_encode()
            if isinstance(found, pa.ChunkedArray):
                found = found.combine_chunks()
            codes, distinct = found.indices.to_numpy(zero_copy_only=False), [w.encode() for w in found.dictionary.to_pylist()]
            order = np.argsort(-np.bincount(codes, minlength=len(distinct)), kind="stable")  # small numbers for frequent words
            rank = np.empty(len(distinct), np.int64)
            rank[order] = np.arange(len(distinct))
            numbers = rank[codes]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in distinct), np.int64, len(distinct))[order]
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1)).tolist()
            rows = []
            for b in range(buckets):
                if cuts[b] < cuts[b + 1]:
                    ranks = by[cuts[b]:cuts[b + 1]]
                    own = [distinct[i] for i in order[ranks].tolist()]
                    rows.append((b, None, packed([np.diff(ranks, prepend=0), np.array([*map(len, own)])], b"".join(own), LEVEL)))
            first = start = end = 0
            for i, n in enumerate(sizes):
                end += n
                if end - start >= ROW or i + 1 == len(sizes):
                    rows.append((buckets, keys[first:i + 1], packed([np.array(sizes[first:i + 1]), numbers[start:end]], level=LEVEL)))
                    first, start = i + 1, end
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), block)), pa.array([r[0] for r in rows], pa.int32()),
                 pa.array([r[1] for r in rows], pa.list_(kind)), pa.array([r[2] for r in rows], pa.binary())],
                ["block", "bucket", "keys", "blob"])

        for batch in batches:
            kind = batch.schema.field(0).type
            lists = batch.column(1)
            keys += batch.column(0).to_pylist()
            sizes += pc.list_value_length(lists).to_pylist()
            flat.append(lists.flatten())
            held += flat[-1].nbytes
            if held >= BLOCK:
                yield flush()
                keys, sizes, flat, held, block = [], [], [], 0, block + 1
        if keys:
            yield flush()

    return run


def spelled(ids: list[bytes], pieces: pa.Table) -> list[bytes]:
    """Each list of ids (little-endian, 32 bits) as its pieces, parted by blanks: a join of ids with the table (id, piece).

    An id without a piece gives nothing."""
    flat = np.frombuffer(b"".join(ids), np.uint32).astype(np.int64)
    rows = pa.table({"id": flat, "at": np.arange(len(flat)), "list": np.repeat(np.arange(len(ids)), [len(i) // 4 for i in ids])})
    found = rows.join(pieces, "id", join_type="inner", use_threads=False).sort_by("at")
    out, names, owner = [b""] * len(ids), found["piece"].to_pylist(), found["list"].to_numpy()
    cuts = np.flatnonzero(np.diff(owner, prepend=-1, append=len(ids))).tolist()
    for s, e in zip(cuts, cuts[1:]):
        out[int(owner[s])] = b" ".join(names[s:e])
    return out


def _encoded(path: str):
    def run(batches):
        """Word lists of the blocks to lists of ids; a word stands in one bucket, so it is encoded once."""
        encoder, now = Encoder(path, keep_space=False), None
        for batch in batches:
            out = []
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob")):
                if bucket != now:
                    now = bucket
                    encoder.memo.clear()
                    if encoder.words:
                        encoder.words.clear()
                (ranks, lengths), raw = unpacked(blob.as_py())
                own = [w.decode() for w in _parts(raw, lengths)]
                encoder.learn(own, keep=True)
                ids = [encoder.memo[w] for w in own]
                out.append(packed([ranks, np.array([*map(len, ids)]), np.frombuffer(b"".join(ids), np.uint32)], level=LEVEL))
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.binary())], ["block", "blob"])

    return run


def vocabulary(path: str) -> pa.Table:
    """The pieces of a tokenizer file: id, piece."""
    known = tokenizer(path).get_vocab(with_added_tokens=True)
    return pa.table({"id": pa.array(known.values(), pa.int64()), "piece": pa.array([p.encode() for p in known], pa.binary())})


def _joined(path: str, name: str):
    held = []

    def run(texts: pa.Table, lists: pa.Table) -> pa.Table:
        """Texts of a block with ids and decoded text: the block's distinct words meet their pieces, texts their words by position."""
        if not held:
            held.append(vocabulary(path))
        found = {}
        for blob in lists["blob"]:
            (ranks, lengths, flat), _ = unpacked(blob.as_py())
            found.update(zip(np.cumsum(ranks, dtype=np.int64).tolist(), _parts(flat.tobytes(), lengths)))
        ids = [found[i] for i in range(len(found))]
        decoded = spelled(ids, held[0])
        keys, encoded, plain = [], [], []
        for row in range(len(texts)):
            (sizes, numbers), _ = unpacked(texts["blob"][row].as_py())
            keys += texts["keys"][row].as_py()
            ends, codes = np.cumsum(sizes, dtype=np.int64).tolist(), numbers.tolist()
            for s, e in zip([0, *ends], ends):
                own = codes[s:e]
                encoded.append(b"".join([ids[c] for c in own]))
                plain.append(b" ".join([decoded[c] for c in own if decoded[c]]))
        return pa.table([pa.array(keys, texts["keys"].type.value_type), pa.array(encoded, pa.binary()), pa.array(plain, pa.binary()).cast(pa.string())],
                        [name, "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """``id_col``, ``ids`` (little-endian unsigned 32-bit) and ``decoded`` of each whole text (null: empty).

    For vocabularies that only take white space as the end of a word and decode by joining pieces with blanks.  Texts
    are split into words by Spark and numbered in blocks of bounded size.  A block is stored, by its number in the
    buckets of a table, as the numbers of its texts and its distinct words; the words come together by a hash, so a task
    encodes each distinct word of the whole table once.  The lists of ids return to their block, whose texts stay where
    they are stored, and in the order of the words, so that a text's numbers are the positions to join them by; a block
    decodes its distinct words by a join of their ids with the pieces.  A frequent word costs one entry a block, whatever its count.  Repeated
    rows and null ids stay as they are; other columns are not returned; an empty table gives an empty one."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or parts
    rows = docs.select(F.col(id_col).alias("key"), words(text_col).alias("words"))
    kind = rows.schema["key"].dataType.simpleString()
    table = f"word_blocks_{uuid.uuid4().hex}"
    blocks = rows.mapInArrow(_numbered(buckets), ROWS.format(kind=kind))
    blocks.write.bucketBy(parts, "block").option("path", shared_folder(spark)).saveAsTable(table)
    blocks = spark.table(table)
    own = blocks.filter(F.col("bucket") < buckets).select("block", "bucket", "blob")
    lists = own.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_encoded(path), "block long, blob binary")
    texts = blocks.filter(F.col("bucket") == buckets).select("block", "keys", "blob")
    both = texts.groupBy("block").cogroup(lists.groupBy("block"))
    return both.applyInArrow(_joined(path, id_col), f"`{id_col}` {kind}, ids binary, decoded string")
