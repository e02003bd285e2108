"""Near-duplicates by SimHash: fingerprints, pivot distance tables, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import fresh, hash128, stored
from .components import components

BITS = 64
# six blocks of bits: two fingerprints with at most three differing bits agree on three blocks of six
BLOCKS = [11, 11, 11, 11, 10, 10]
# a bucket with more fingerprints than this is cut by further blocks
BUCKET = 20_000
# reference fingerprints of the distance table: fixed numbers from a multiplicative sequence
PIVOTS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) * (2 * i + 1)) % (1 << 64) for i in range(1, 17)], np.uint64)


def fingerprint(words: list[bytes], shingle: int, seed: int = 42) -> int:
    """Majority of the bits of the hashes of all shingles; fewer words than a shingle are one, none gives zero."""
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1:].tolist())], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 65536):
        part = h[i:i + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = np.array([fingerprint((t.as_py() or "").encode().lower().split(), shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], [*batch.schema.names[:-1], "fp"])

    return run


def fingerprints(docs: DataFrame, key: list[str], shingle: int = 3, text_col: str = "text") -> DataFrame:
    """The columns ``key`` and ``fp`` (long) of each row: bytes A-Z lower-cased, words between blanks."""
    names = [f"k{i}" for i in range(len(key))]
    rows = docs.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(key, names)], F.col(text_col).alias("text"))
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, rows.schema.fields)) + ", fp long"
    return rows.mapInArrow(_fingerprints(shingle), schema).withColumnsRenamed(dict(zip(names, key)))


def _masks(bits: list[int], sizes: list[int], equal: int) -> list[int]:
    """Masks of all choices of ``equal`` blocks."""
    at, blocks = 0, []
    for n in sizes:
        blocks.append(sum(1 << b for b in bits[at:at + n]))
        at += n
    return [sum(c) for c in combinations(blocks, equal)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _finer(mask: int) -> list[int]:
    """The mask with one of four blocks of the bits it leaves open: one of them holds none of three differing bits."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    sizes = [len(free) // 4 + (i < len(free) % 4) for i in range(4)]
    return [mask | m for m in _masks(free, sizes, 1)]


def linked(fps: np.ndarray, most: int) -> np.ndarray:
    """For each of some distinct fingerprints the index of its group under links of at most ``most`` bits.

    The table of distances to the pivots is sorted by its first column; only rows within ``most`` in every column
    are compared bit by bit, since distances to a pivot differ by no more than the distance of the two."""
    table = np.bitwise_count(fps[:, None] ^ PIVOTS).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    fps_, table = fps[order], np.ascontiguousarray(table[order].T)
    label = np.arange(len(fps))
    step = max(1, 2_000_000 // len(fps))
    for start in range(0, len(fps), step):
        end = min(start + step, len(fps))
        last = np.searchsorted(table[0], table[0, end - 1] + most, "right")
        near = np.abs(table[0, start:end, None] - table[0, None, start:last]) <= most
        i, j = np.nonzero(near)
        i, j = (i + start)[j > i], (j + start)[j > i]
        for row in table[1:]:
            close = np.abs(row[i] - row[j]) <= most
            i, j = i[close], j[close]
        sure = np.bitwise_count(fps_[i] ^ fps_[j]) <= most
        i, j = i[sure], j[sure]
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    out = np.empty(len(fps), np.int64)
    out[order] = order[label]
    return out


def _links(most: int):
    def found(mask, key, fp):
        """Links inside the buckets of sorted rows, as stars; and rows of the last bucket, which may go on."""
        cut = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(fp)]])
        pairs = starts[ends - starts == 2]
        near = np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= most
        a, b = [fp[pairs][near]], [fp[pairs + 1][near]]
        for s, e in zip(*(x[ends - starts > 2] for x in (starts, ends))):
            group = linked(fp[s:e], most)
            moved = group != np.arange(e - s)
            a.append(fp[s:e][moved])
            b.append(fp[s:e][group[moved]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = [np.concatenate(x) for x in zip(held, rows)] if held else rows
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1])) if len(rows[0]) else []
            at = int(last[-1]) + 1 if len(last) else 0
            if at:
                yield found(rows[0][:at], rows[1][:at], rows[2][:at].view(np.uint64))
            held = [x[at:] for x in rows]
        if held and len(held[0]):
            yield found(held[0], held[1], held[2].view(np.uint64))

    return run


def links(fps: DataFrame, most: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` exactly as all links of at most ``most`` bits do.

    Fingerprints meet in buckets of equal bits in three of six blocks (20 keys of about 32 bits each).  Inside a
    bucket the pivot distance table discards pairs and the survivors are verified; a bucket hands on stars, not
    pairs.  Buckets above ``bucket`` rows are cut by one of four blocks of their open bits, twice if need be, which
    bounds any bucket by the 2^18 values of its open bits, whatever the data."""
    if most > 3:
        raise ValueError("the keys cover at most three differing bits")
    spark = fps.sparkSession
    masks = _masks(list(range(BITS)), BLOCKS, 3)
    array = F.array(*[F.lit(_signed(m)) for m in masks])
    rows = fps.select("fp", F.explode(array).alias("mask"))
    rows = rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    small = None
    for level in range(3):
        sizes = rows.groupBy("mask", "key").count().filter("count > 1")
        large = stored(sizes.filter(F.col("count") > bucket)) if level < 2 else None
        hot = large is not None and large.count() > 0
        now = rows.join(large, ["mask", "key"], "left_anti") if hot else rows
        small = now if small is None else small.union(now)
        if not hot:
            break
        finer = [(m, f) for m in masks for f in _finer(m)]
        cut = spark.createDataFrame([(_signed(m), _signed(f)) for m, f in finer], "mask long, finer long")
        rows = rows.join(large.select("mask", "key"), ["mask", "key"], "left_semi").join(F.broadcast(cut), "mask")
        rows = rows.select(F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key"), "fp")
        masks = [f for _, f in finer]
    sorted_ = small.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return sorted_.mapInArrow(_links(most), "a long, b long")


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3,
             bucket: int = BUCKET) -> DataFrame:
    """``docs`` ids with ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over links of
    at most ``most`` differing bits.

    A null or empty text has fingerprint zero and is linked like any other.  Repeated rows stay and share their
    component; a null id never names a component unless it has no other.  Other columns do not matter; an empty
    table gives an empty table.  Equal fingerprints are one node, so copies cost nothing beyond their own row."""
    rows = stored(fingerprints(docs, [id_col], shingle, text_col))
    nodes = rows.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = components(links(nodes.select("fp"), most, bucket))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    firsts = named.groupBy("root").agg(F.min("least").alias("component_id"))
    table = stored(named.join(firsts, "root").select("fp", "component_id"))
    return rows.join(table, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, most: int = 3,
                    bucket: int = BUCKET) -> DataFrame:
    """``docs`` with one row of each group of linked fingerprints: that of the smallest id, then of the least hash.

    A null id comes after all others; of rows that are equal in id and text one stays.  A group is found as in
    ``clusters``; only keys of rows are grouped, and texts are fetched by an equality join."""
    key, kept = fresh(docs, "_key", "_kept")
    marks = [c.alias(n) for c, n in zip(hash128(F.col(text_col)), ("a", "b"))]
    same = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), *marks)
    rows = stored(fingerprints(docs.select(same.alias("same"), text_col), ["same"], shingle, text_col))
    nodes = rows.groupBy("fp").agg(F.min("same").alias("least"))
    roots = components(links(nodes.select("fp"), most, bucket))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("least", F.coalesce("root", "fp").alias("root"))
    firsts = named.groupBy("root").agg(F.min("least").alias(kept)).select(kept)
    found = docs.withColumn(key, same).join(firsts, F.col(key) == F.col(kept), "left_semi")
    return found.dropDuplicates([key]).drop(key)
