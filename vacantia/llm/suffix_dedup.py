"""Remove long byte strings that stand more than once in the corpus.

A string of ``length`` bytes is repeated if it also starts anywhere else.  Every window of that length holds one
anchor, the run of GRAM bytes with the smallest hash, so equal windows have equal anchors at equal places.  The
windows of one anchor are a segment of the text.  Segments meet by the hash of their anchor; equal segments are
decided by counting, and the different ones of an anchor by the common prefixes of their suffixes, which are derived
by increasing value on a Burrows-Wheeler transform of a bounded group of segments."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import hash128, stored, without

GRAM = 32
# members of an interval that are looked at side by side with those of others, before the rest is taken as a whole
STEPS = 16
# bytes that one step looks at; different segments of an anchor beyond which they are cut by halves; bytes of one transform
PART, GROUP, CHUNK = 1 << 20, 512, 2 << 20
ANCHORS = "id1 long, id2 long, at long, first long, last long, gram long, same1 long, same2 long"


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    span, out = 1, values
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[:len(values) - width + 1], out[width - span:]) if span < width else out


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every run of GRAM bytes."""
    h, span, factor = raw.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while span < GRAM:
        h = h[:-span] * np.uint64(factor) + h[span:]
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64) | 1
        span *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors(texts: list[bytes], length: int):
    """Arrays (text, anchor, first and last window start, gram hash) of some texts; windows never cross texts.

    Long texts are looked at in parts; a part cuts the windows of an anchor in two, which costs a segment, not a match."""
    parts = [(i, s) for i, t in enumerate(texts) for s in range(0, len(t) - length + 1, PART)]
    found, held, size = [], [], 0

    def flush():
        raw = np.frombuffer(b"".join(t for _, _, t in held), np.uint8)
        sizes = np.array([len(t) for _, _, t in held])
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        h = _gram_hashes(raw)
        ranked = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        least = (_sliding_min(ranked, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        part = np.repeat(np.arange(len(held)), sizes)[:len(least)]
        valid = np.flatnonzero(np.arange(len(least)) - begin[part] <= sizes[part] - length)
        where, anchor = part[valid], least[valid]
        cut = np.flatnonzero(np.diff(anchor, prepend=-1) | np.diff(where, prepend=-1))
        stop = np.concatenate([cut[1:], [len(valid)]]) - 1
        where, anchor = where[cut], anchor[cut]
        shift = np.array([s for _, s, _ in held])[where] - begin[where]
        text = np.array([i for i, _, _ in held])[where]
        found.append((text, anchor + shift, valid[cut] + shift, valid[stop] + shift, h[anchor].view(np.int64)))

    for i, s in parts:
        piece = texts[i][s:s + PART + length - 1]
        held.append((i, s, piece))
        size += len(piece)
        if size >= PART:
            flush()
            held, size = [], 0
    if held:
        flush()
    return [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 5


def _anchored(length: int):
    def run(batches):
        for batch in batches:
            texts = [t.encode() if t else b"" for t in batch.column(2).to_pylist()]
            text, anchor, first, last, gram = anchors(texts, length)
            same = [xxhash.xxh3_128_digest(texts[i][f:z + length], a - f) for i, f, z, a in zip(
                text.tolist(), first.tolist(), last.tolist(), anchor.tolist())]
            same = np.frombuffer(b"".join(same), np.int64).reshape(-1, 2)
            ids = [batch.column(c).take(pa.array(text)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, (anchor, first, last, gram, np.ascontiguousarray(same[:, 0]), np.ascontiguousarray(same[:, 1])))],
                                             [c.split()[0] for c in ANCHORS.split(", ")])

    return run


def suffixes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, ranks, and the common prefix of neighbours where it is under 8 (else 8); 8 bytes, then doubling."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j:j + n].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    differ = ranked[1:] ^ ranked[:-1]
    common = np.zeros(n, np.int16)
    for j in range(1, 9):  # bytes equal from the front
        common[1:][differ >> np.uint64(64 - 8 * j) == 0] = j
    new = np.concatenate([[True], differ != 0])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    span = 8
    while True:
        heads = np.concatenate([np.flatnonzero(new), [n]])
        open_ = np.repeat(np.diff(heads) > 1, np.diff(heads))
        at = np.flatnonzero(open_)
        if not len(at):
            return order, rank, common
        rows = order[at]
        after = np.where(rows + span < n, rank[np.minimum(rows + span, n - 1)] + 1, 0)
        pair = rank[rows] * (n + 1) + after
        inner = np.argsort(pair, kind="stable")
        order[at], pair = rows[inner], pair[inner]
        fresh_ = np.concatenate([[True], pair[1:] != pair[:-1]])
        new[at] = fresh_
        rank[order[at]] = at[np.maximum.accumulate(np.where(fresh_, np.arange(len(at)), 0))]
        span *= 2


def repeated_starts(text: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes from each place of the text also start at another place (bytes are above 0).

    Breadth first over the value of common prefixes: a boundary between neighbouring suffixes that share v bytes
    makes one of v + 1 bytes for each byte that precedes suffixes on either side of it, one backward extension.
    A boundary looks only at its own interval, up to the next boundary.  Values from ``length`` on are never derived."""
    order, rank, common = suffixes(text)
    n = len(text)
    before = text[order - 1].astype(np.int16)
    before[rank[0]] = -1
    back = rank[order - 1]
    by = np.argsort(before, kind="stable")
    earlier = np.full(n, -1)
    earlier[by[1:]] = np.where(before[by[1:]] == before[by[:-1]], by[:-1], n)
    earlier[by[0]] = n  # without an equal byte before: nothing to extend
    bound = np.ones(n + 1, bool)
    bound[:n] = common < 8
    level = np.flatnonzero(common == 7)
    for _ in range(8, length):
        if not len(level):
            break
        made, start, at = [], level, level
        for _ in range(STEPS):
            if not len(at):
                break
            first = earlier[at] < start  # the first of its byte in the interval
            target = back[at[first]]
            made.append(target[~bound[target]])
            at = at + 1
            go = ~bound[at]
            start, at = start[go], at[go]
        for s, a in zip(start.tolist(), at.tolist()):  # long intervals as a whole
            target = back[a:a + int(bound[a:].argmax())]
            target = target[earlier[a:a + len(target)] < s]
            made.append(target[~bound[target]])
        level = np.concatenate(made)
        bound[level] = True
        level.sort()
    hit = np.flatnonzero(~bound[:n])
    out = np.zeros(n, bool)
    out[order[hit]] = True
    out[order[hit - 1]] = True
    return out


def partners(rows: list[tuple], length: int) -> list[tuple]:
    """The segments of one anchor that may share a window with another of them.

    A window holds its anchor, so it reaches at least half of the rest to one side of it: segments that share a window
    agree in all bytes of that half."""
    half = (length - GRAM + 1) // 2
    sides = []
    for _, content, *_, back in rows:
        after = back + GRAM
        sides.append((content[back - half:back] if back >= half else None, content[after:after + half] if len(content) >= after + half else None))
    left, right = (Counter(s for s in side if s is not None) for side in zip(*sides))
    near = [row for row, (a, b) in zip(rows, sides) if left[a] > 1 or right[b] > 1]
    return near if any(row[5] == 1 for row in near) else []


def _compared(length: int, chunk: int):
    def run(batches):
        """Repeated spans of the segments (only those that stand once) from groups that arrive together."""
        group, held, rows, size = None, [], [], 0

        def spans():
            text = np.frombuffer(b"\xff".join(r[1] for r in rows) + b"\xff", np.uint8) + np.uint8(1)  # the mark between segments becomes 0
            hit = repeated_starts(text, length)
            out, at = [], 0
            for _, content, id1, id2, first, times, _ in rows:
                if times == 1:
                    run_ = np.diff(np.concatenate([[0], hit[at:at + len(content) - length + 1].astype(np.int8), [0]]))
                    for s, e in zip(np.flatnonzero(run_ == 1).tolist(), np.flatnonzero(run_ == -1).tolist()):
                        out.append((id1, id2, first + s, first + e - 1 + length))
                at += len(content) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], ["id1", "id2", "start", "stop"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != group:
                    near = partners(held, length) if held else []
                    rows += near
                    size += sum(len(r[1]) for r in near)
                    group, held = row[0], []
                    if size > chunk:
                        yield spans()
                        rows, size = [], 0
                held.append(row)
        rows += partners(held, length) if held else []
        if rows:
            yield spans()

    return run


def _cut(nodes: DataFrame, length: int) -> DataFrame:
    """Both halves of the window starts of a node; members of a half share the bytes that all its windows cover.

    A half keeps the bytes of its own windows only: with more, a segment in two halves would meet itself in a transform."""
    middle = F.floor((F.col("x1") + F.col("x2")) / 2).cast("int")
    halves = F.explode(F.array(F.struct(F.col("x1").alias("l"), middle.alias("r")), F.struct((middle + 1).alias("l"), F.col("x2").alias("r"))))
    out = nodes.withColumn("half", halves).withColumns({"x1": F.col("half.l"), "x2": F.col("half.r")})
    high = F.least(F.octet_length("content") - length, F.col("x2") + F.col("back"))
    out = out.withColumns({"low": F.greatest(F.lit(0), F.col("x1") + F.col("back")), "high": high}).filter("low <= high")
    own = F.substring("content", F.col("low") + 1, F.col("high") - F.col("low") + length)
    out = out.withColumns({"content": own, "first": F.col("first") + F.col("low"), "back": F.col("back") - F.col("low")})
    shared = F.substring("content", F.col("x2") + F.col("back") + 1, F.col("x1") - F.col("x2") + length)
    return out.withColumn("node", F.xxhash64("node", "x1", shared)).drop("half", "low", "high")


def repeats(docs: DataFrame, length: int = 400, text_col: str = "text", group: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """Repeated spans (``id1``, ``id2``, ``start``, ``stop`` in bytes, overlaps possible) of texts, by the hash of the text."""
    id1, id2 = hash128(F.col("text"))
    texts = docs.select(F.col(text_col).alias("text")).filter(F.octet_length("text") >= length)
    texts = texts.select(id1.alias("id1"), id2.alias("id2"), "text")
    found = stored(texts.mapInArrow(_anchored(length), ANCHORS))
    # anchors that stand once hold no repeat; as a table of its own, the join can split a frequent anchor
    again = stored(found.groupBy("gram").count().filter("count > 1").select("gram"))
    found = stored(found.join(again, "gram", "left_semi"))
    # equal segments count; one of each stands for all
    key = ["gram", "same1", "same2"]
    segments = found.groupBy(*key).agg(F.count("*").alias("times"), F.min(F.struct("id1", "id2", "at", "first", "last")).alias("s"))
    segments = stored(segments)
    copies = found.join(segments.filter("times > 1").select(*key), key, "left_semi")
    spans = copies.select("id1", "id2", F.col("first").alias("start"), (F.col("last") + length).alias("stop")).distinct()

    kinds = segments.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("times").alias("least")).filter("kinds > 1 and least = 1")
    mixed = segments.join(kinds.select("gram", "kinds"), "gram").select("gram", "kinds", "times", "s.*")
    needed = mixed.select("id1", "id2").distinct()
    bodies = texts.join(needed, ["id1", "id2"], "left_semi").groupBy("id1", "id2").agg(F.first("text").alias("text"))
    body = F.substring(F.col("text").cast("binary"), F.col("first") + 1, F.col("last") - F.col("first") + length)
    nodes = mixed.join(bodies, ["id1", "id2"]).select(
        F.col("gram").alias("node"), body.alias("content"), "id1", "id2", "first", "times", (F.col("at") - F.col("first")).cast("int").alias("back"),
        F.lit(GRAM - length).alias("x1"), F.lit(0).alias("x2"), "kinds")
    nodes = stored(nodes)
    order = ["node", "content", "id1", "id2", "first", "times", "back"]
    ready = nodes.filter(F.col("kinds") <= group).select(*order)
    crowded = nodes.filter(F.col("kinds") > group).drop("kinds")
    while not crowded.isEmpty():
        halves = _cut(crowded, length)
        halves = stored(halves.withColumns(dict(zip(("same1", "same2"), hash128(F.col("back"), F.col("content"))))))
        key = ["node", "same1", "same2"]
        rest = [c for c in halves.columns if c not in (*key, "times")]
        counted = halves.groupBy(*key).agg(F.sum("times").alias("all"), F.min(F.struct(*rest)).alias("s"))
        counted = stored(counted)
        mine = halves.filter("times = 1").join(counted.filter("all > 1").select(*key), key, "left_semi")
        spans = spans.union(mine.select("id1", "id2", "first", F.col("first") + F.octet_length("content")))
        kinds = counted.groupBy("node").agg(F.count("*").alias("kinds"), F.min("all").alias("least")).filter("kinds > 1 and least = 1")
        nodes = stored(counted.join(kinds.select("node", "kinds"), "node").select("node", F.col("all").alias("times"), "kinds", "s.*"))
        ready = ready.union(nodes.filter(F.col("kinds") <= group).select(*order))
        crowded = nodes.filter(F.col("kinds") > group).drop("kinds")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    compared = ready.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(_compared(length, chunk), "id1 long, id2 long, start long, stop long")
    return stored(spans.union(compared))


def _removed(batches):
    for batch in batches:
        kept, sizes, removed, runs = [], [], [], []
        for text, spans in zip(batch.column(0), batch.column(1)):
            raw, out, at, gone, n = (text.as_py() or "").encode(), [], 0, 0, 0
            for span in spans.as_py() or ():
                start, stop = span["start"], span["stop"]
                if start > at or n == 0:
                    out.append(raw[at:start])
                    n += 1
                    gone += stop - start
                else:
                    gone += max(0, stop - at)
                at = max(at, stop)
            out.append(raw[at:])
            kept.append(b"".join(out))
            sizes.append(len(raw))
            removed.append(gone)
            runs.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in (sizes, removed, runs))],
                                         [*batch.schema.names[2:], "kept", "n_bytes", "n_removed", "n_spans"])


def dedup(docs: DataFrame, length: int = 400, text_col: str = "text", keep: list[str] | None = None, group: int = GROUP,
          chunk: int = CHUNK) -> DataFrame:
    """The columns ``keep`` (all, if None) with ``kept`` (remaining bytes, UTF-8 may be cut), ``n_bytes``, ``n_removed``
    and ``n_spans`` (maximal removed runs) of each whole text.

    Each byte covered by a string of ``length`` bytes that also starts elsewhere, in this or another text, is removed;
    strings are judged on the input.  A null text is empty.  Repeated rows repeat all their strings.  Columns named
    like a result give way to it; an empty table gives an empty table.  No step holds more than ``group`` segments of
    one anchor: anchors with more different segments are cut by halves of their window starts, down to single windows,
    which are decided by counting."""
    if length < GRAM + 1:
        raise ValueError(f"the method needs strings of more than {GRAM} bytes")
    spans = repeats(docs, length, text_col, group, chunk).distinct()
    merged = spans.groupBy("id1", "id2").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    kept = without(docs, "kept", "n_bytes", "n_removed", "n_spans")
    names = [c for c in kept.columns if keep is None or c in keep]
    plain = [f"c{i}" for i in range(len(names))]
    id1, id2 = hash128(F.col(text_col))
    rows = kept.select(F.col(text_col).alias("text"), id1.alias("id1"), id2.alias("id2"), *[F.col(f"`{c}`").alias(p) for c, p in zip(names, plain)])
    joined = rows.join(merged, ["id1", "id2"], "left").select("text", "spans", *plain)
    schema = "".join(f"{p} {rows.schema[p].dataType.simpleString()}, " for p in plain)
    out = joined.mapInArrow(_removed, f"{schema}kept binary, n_bytes long, n_removed long, n_spans long")
    return out.withColumnsRenamed(dict(zip(plain, names)))
