"""Files of token ids: independent zstandard frames with checksums, a document index and a trailing seek table."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import shared_folder, slices, stored
from .tokens import Encoder

# ids of a frame, but for a longer document, which has a frame of its own
FRAME = 1 << 18
# fixed values of the public seekable format: skippable frames for the index and the seek table, the closing mark
INDEX_MAGIC, TABLE_MAGIC, CLOSING_MAGIC, HAS_CHECKSUM = 0x184D2A51, 0x184D2A5E, 0x8F92EAB1, 0x80
MANIFEST = "part int, file string, n_docs long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids binary"


class FrameWriter:
    """Writes documents to an open binary file, frame by frame."""

    def __init__(self, out):
        self.out, self.compressor = out, zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.table, self.keys, self.sizes, self.frames = [], [], [], []
        self.held, self.n, self.tokens = [], 0, 0

    def add(self, key: int | None, ids: bytes) -> None:
        if self.n and self.n + len(ids) // 4 > FRAME:
            self.flush()
        self.held.append(ids)
        self.n += len(ids) // 4
        self.tokens += len(ids) // 4
        self.keys.append(key)
        self.sizes.append(len(ids) // 4)
        self.frames.append(len(self.table))

    def flush(self) -> None:
        raw = b"".join(self.held)
        packed = self.compressor.compress(raw)
        self.out.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.n = [], 0

    def close(self) -> None:
        if self.held:
            self.flush()
        null = np.array([k is None for k in self.keys], np.uint8)
        keys = np.array([k or 0 for k in self.keys], np.int64)
        index = struct.pack("<Q", len(keys)) + keys.tobytes() + np.array(self.sizes, np.uint64).tobytes() + np.array(
            self.frames, np.uint32).tobytes() + null.tobytes()
        index = self.compressor.compress(index)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        entries = b"".join(struct.pack("<III", *e) for e in self.table)
        footer = struct.pack("<IBI", len(self.table), HAS_CHECKSUM, CLOSING_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(entries) + len(footer)) + entries + footer)


def read_documents(source, wanted: set | None = None):
    """(key, first id's place, ids) of the documents in an open file; only their frames are decompressed.

    A frame whose checksum does not hold raises an error."""
    end = source.size()
    source.seek(end - 9)
    n_frames, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != CLOSING_MAGIC:
        raise ValueError("no seek table at the end of the file")
    source.seek(end - 9 - 12 * n_frames)
    table = np.frombuffer(source.read(12 * n_frames), np.uint32).reshape(n_frames, 3).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(table[:, 0])])
    source.seek(int(starts[-1]))
    _, size = struct.unpack("<II", source.read(8))
    raw = zstandard.decompress(source.read(size))
    n = struct.unpack_from("<Q", raw)[0]
    keys, sizes = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.uint64, n, 8 + 8 * n).astype(np.int64)
    frames, null = np.frombuffer(raw, np.uint32, n, 8 + 16 * n), np.frombuffer(raw, np.uint8, n, 8 + 20 * n)
    place = np.concatenate([[0], np.cumsum(sizes)])
    first = np.searchsorted(frames, np.arange(n_frames))
    held, data = -1, b""
    for i, (key, frame, gone) in enumerate(zip(keys.tolist(), frames.tolist(), null.tolist())):
        key = None if gone else key
        if wanted is not None and key not in wanted:
            continue
        if frame != held:
            source.seek(int(starts[frame]))
            data, held = zstandard.ZstdDecompressor().decompress(source.read(int(table[frame, 0]))), frame
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != table[frame, 2]:
                raise ValueError(f"frame {frame} is damaged")
        at = 4 * int(place[i] - place[first[frame]])
        yield key, int(place[i]), data[at:at + 4 * int(sizes[i])]


def _written(path: str, folder: str, end: bytes, keep_space: bool):
    def run(batches):
        encoder, writer, context = Encoder(path, keep_space), None, TaskContext.get()
        system, root = pyarrow.fs.FileSystem.from_uri(folder)
        part = context.partitionId()
        final, draft = f"{root}/part-{part:06d}.tok", f"{root}/.part-{part:06d}-{context.taskAttemptId()}"
        out = None
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for first, last in slices(texts):
                if writer is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(draft)
                    writer = FrameWriter(out)
                for key, ids in zip(keys[first:last], encoder.encode(texts[first:last], end)):
                    writer.add(key, ids)
        if writer:
            writer.close()
            out.close()
            system.move(draft, final)  # a task that is run again replaces the file as a whole
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [final], "n_docs": [len(writer.keys)],
                                              "n_tokens": [writer.tokens]})

    return run


def write_tokens(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
                 keep_space: bool = False) -> tuple[DataFrame, str]:
    """Writes the ids of whole texts (null: empty) and ``end_id`` in ascending order of ids, nulls first.

    Rows are dealt by ranges of id, then of the text's hash, then of their place, so that repeated ids and copies are
    cut as well; each task writes one file to ``folder``, a place that all executors reach (by default a new one in
    the shared folder; pyarrow's file systems, such as file, hdfs or s3).  Returns the manifest, one row per file, and
    the folder.  An empty table writes no file."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"),
                       F.monotonically_increasing_id().alias("place"))
    ranged = rows.repartitionByRange("id", "h", "place").sortWithinPartitions("id", "h", "place").select("id", "text")
    end = np.uint32(end_id).tobytes()
    return stored(ranged.mapInArrow(_written(path, folder, end, keep_space), MANIFEST)), folder


def _read(folder: str, wanted: set | None):
    def run(batches):
        system, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                with system.open_input_file(file) as source:
                    rows, size = [], 0
                    for key, start, ids in read_documents(source, wanted):
                        rows.append((key, before + start, len(ids) // 4, ids))
                        size += len(ids)
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch_of(rows)

    def batch_of(rows):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in READ.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def read_tokens(manifest: DataFrame, folder: str, wanted: set[int] | None = None) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` from the files.

    With ``wanted`` only these documents' frames are decompressed.  The places of files are a running sum over the
    manifest, one row per file."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = manifest.select("part", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before"))
    files = places.repartition(max(1, manifest.count()), "part")
    return files.mapInArrow(_read(folder, wanted), READ)
