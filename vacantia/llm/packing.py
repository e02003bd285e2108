"""Pack documents into token sequences of bounded length by multiway differencing."""

from __future__ import annotations

import heapq
import itertools
import json
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import slices
from .tokens import BYTE_LETTERS, tokenizer

# windows balanced at a time; ids that a group leaves free in each, so that balance rarely exceeds the capacity;
# longest piece of a rest, as balance needs several pieces a window
GROUP, SLACK, LONGEST = 256, 4, 512
PIECES = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp differencing into ``k`` bins: indices of each bin.

    A partial partition is its non-empty bins by falling sum.  The two with the largest spread are merged, largest
    bins of one with smallest of the other, until one is left."""
    order = itertools.count()
    heap = [(-size, next(order), [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        over = len(a) + len(b) - k
        if over > 0:
            free = len(a) - over
            both = [(x + y, (i, j)) for (x, i), (y, j) in zip(a[free:], reversed(b[len(b) - over:]))]
            merged = a[:free] + both + b[:len(b) - over]
        else:
            merged = a + b
        merged.sort(key=lambda bin_: bin_[0], reverse=True)
        heapq.heappush(heap, (-(merged[0][0] - (merged[-1][0] if len(merged) == k else 0)), next(order), merged))
    bins = []
    for _, tree in heap[0][2] if heap else []:
        items, todo = [], [tree]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo += node
            else:
                items.append(node)
        bins.append(items)
    return bins


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items in near-equal windows within the capacity: the number of windows rises while one exceeds it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        bins = difference(sizes, k)
        if all(sum(sizes[i] for i in b) <= capacity for b in bins):
            return bins
        k += 1


class ByteEncoder:
    """Ids of a byte-level vocabulary file as the library gives them; texts with a special token go to the library."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        self.special, vocabulary = [t["content"] for t in whole["added_tokens"]], whole["model"]["vocab"]
        byte = {letter: b for b, letter in BYTE_LETTERS.items()}
        ranks = {bytes(byte[c] for c in piece): i for piece, i in vocabulary.items() if piece not in self.special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def library(self):
        return tokenizer(self.path)

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


def _packed(path: str, capacity: int, end_id: int, group: int):
    def pieces(held, sequence):
        """Windows of the pieces held: (key, start, ids, document's ids)."""
        out = []
        for window in windows([len(p[2]) for p in held], capacity):
            offset = 0
            for i in sorted(window):
                key, start, ids, total = held[i]
                out.append((key, start, len(ids), total, sequence, offset, ids.tobytes()))
                offset += len(ids)
            sequence += 1
        return out, sequence

    def run(batches):
        encoder = ByteEncoder(path)
        context = TaskContext.get()
        sequence = context.partitionId() << 36
        room = group * (capacity - SLACK)
        held, size, end = [], 0, np.array([end_id], np.uint32)

        def emit(rows, schema):
            keys = pa.array([r[0] for r in rows], schema.field(0).type)
            rest = [pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 6)]
            return pa.RecordBatch.from_arrays([keys, *rest, pa.array([r[6] for r in rows], pa.binary())],
                                              [schema.names[0], "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        schema = None
        for batch in batches:
            schema = batch.schema
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, last in slices(texts):
                out = []
                for key, text in zip(keys[first:last], texts[first:last]):
                    ids = np.concatenate([encoder.encode(text or ""), end])
                    total, start = len(ids), 0
                    while total - start >= capacity:  # full windows need no balance
                        out.append((key, start, capacity, total, sequence, 0, ids[start:start + capacity].tobytes()))
                        sequence += 1
                        start += capacity
                    while start < total:
                        part = ids[start:start + min(LONGEST, room - size)]
                        held.append((key, start, part, total))
                        start += len(part)
                        size += len(part)
                        if size == room:
                            more, sequence = pieces(held, sequence)
                            out += more
                            held, size = [], 0
                if out:
                    yield emit(out, schema)
        if held:
            yield emit(pieces(held, sequence)[0], schema)

    return run


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
         group: int = GROUP) -> DataFrame:
    """Pieces of documents in sequences of at most ``capacity`` ids, with their ids (little-endian unsigned 32-bit).

    A document is the ids of its whole text (null: empty) and ``end_id``, so it has at least one piece.  Full windows
    are cut off; rests are cut to pieces of at most 512 ids and gathered until they fill ``group`` windows but for a few ids, and balanced by differencing
    into near-equal windows, whose number rises while one exceeds the capacity.  One pass over the table without a
    shuffle: a task packs what it reads, holds one group, and numbers its sequences from its partition's number on, so
    a task that is run again gives the same sequences.  A partition leaves at most one group half filled, whose
    windows are balanced among themselves.  Rows repeat as often as they stand in the table; other columns are not
    returned; an empty table gives an empty table."""
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(_packed(path, capacity, end_id, group), f"key {kind}, {PIECES}")
    return out.withColumnRenamed("key", id_col)
