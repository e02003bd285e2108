"""Alignment of the tokens of two tokenizers by the bytes they cover.

The spans that the libraries give (character offsets of ``tokenizers``, byte spans of the ``sentencepiece`` protos) are
coarse cuts: tokens that share a character, and tokens of single bytes, are placed between them by the bytes they
decode to.  Texts are cut before blanks, where neither vocabulary has a token that goes on, and every distinct chunk
of a task is encoded and aligned once."""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import packed, stored, summed, unpacked
from .tokens import BYTE_LETTERS, SPACE, tokenizer

# characters of the texts of a block, and bytes of chunks (each with what objects take) that a task remembers before it starts anew
BLOCK, MEMO, OBJECTS = 4 << 20, 64 << 20, 240
BLOCKS = "block long, keys array<{kind}>, blob binary, pairs array<long>, docs array<int>"
# counts of pairs in one row on their way back, chunks of the documents that leave in one batch
RUN, SLICE = 8192, 200_000
# chunks that are encoded as one text
JOINED = 256
# a pair of ids as one number
SECOND = 1 << 32
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def refined(coarse: np.ndarray, own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ends of tokens in bytes: coarse cuts where a token has its own span, else the end before it and the bytes it decodes to."""
    total = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(own, np.arange(len(own)), -1))
    return np.where(last >= 0, coarse[last] + total - total[last], total)


class Spans:
    """Ids and byte ends of tokens of a text, of which ``names`` and ``sizes`` are the bytes each id decodes to and how many."""

    def __init__(self, names: list[bytes]):
        self.names, self.sizes = names, np.array([*map(len, names)], np.int64)

    def checked(self, ids, coarse, own, raw: bytes):
        """(ids, ends), or None where the tokens do not give the text."""
        ids = np.array(ids, np.int64)
        if b"".join(map(self.names.__getitem__, ids.tolist())) != raw:
            return None
        return ids, refined(coarse, own, self.sizes[ids])


class ByteLevel(Spans):
    """A byte-level vocabulary of the ``tokenizers`` library."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.tokenizer.encode_special_tokens = True
        byte = {letter: b for b, letter in BYTE_LETTERS.items()}
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        names = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            names[i] = bytes(byte.get(c, 63) for c in piece)
        super().__init__(names)

    def encode(self, texts: list[str]):
        for text, found in zip(texts, self.tokenizer.encode_batch(texts, add_special_tokens=False)):
            spans = np.fromiter(chain.from_iterable(found.offsets), np.int64).reshape(-1, 2)
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            places = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
            # a character that the next token shares is cut by the bytes of the tokens
            own = np.append(spans[1:, 0] >= spans[:-1, 1], True)[:len(spans)]
            yield self.checked(found.ids, places[spans[:, 1]], own, text.encode())


class Pieces(Spans):
    """A ``sentencepiece`` model that puts a blank in front, which the texts begin with."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])

    def encode(self, texts: list[str]):
        for text, proto in zip(texts, self.model.encode([t[1:] for t in texts], return_type="proto", num_threads=1)):
            pieces = proto.pieces
            ids, ends = np.array([p.id for p in pieces], np.int64), np.array([p.end for p in pieces], np.int64)
            # bytes of a character, and the blank in front, have no span of their own
            own = np.diff(ends, prepend=0) > 0
            yield self.checked(ids, ends + 1, own, text.encode())


class Aligner:
    """Chunks to numbers, groups and linked id pairs, every distinct chunk once."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b, self.memo, self.held = ByteLevel(path_a), Pieces(path_b), {}, 0
        self.digits = [str(i) for i in range(max(len(self.a.names), len(self.b.names)))]
        self.odd, self.cut = re.compile(f"[{SPACE}] "), re.compile(f"(?<=[^{SPACE}])(?= )")

    def chunks(self, text: str) -> list[str]:
        """The text with a blank in front, cut before blanks that follow another character; a last lone blank is no chunk."""
        text = " " + text
        out = self.cut.split(text) if self.odd.search(text) else [" " + c for c in text[1:].split(" ")]
        if len(out) > 1 and out[-1] == " ":
            out[-2:] = [out[-2] + " "]
        return out

    def forget(self) -> None:
        """Start anew once the memo is full."""
        if self.held > MEMO:
            self.memo.clear()
            self.held = 0

    def learn(self, chunks) -> None:
        """Encode what the memo lacks, many chunks as one text; one by one where a text does not come out whole, or where a last blank might join the next chunk's."""
        new = [c for c in chunks if c not in self.memo]
        good = [c for c in new if not c[-1].isspace()]
        self._learn(good, JOINED)
        self._learn([c for c in new if c not in self.memo], 1)

    def _learn(self, chunks: list[str], joined: int) -> None:
        for i in range(0, len(chunks), 32 * joined):
            parts = [chunks[k:k + joined] for k in range(i, min(i + 32 * joined, len(chunks)), joined)]
            texts = ["".join(p) for p in parts]
            for part, a, b in zip(parts, self.a.encode(texts), self.b.encode(texts)):
                if a is not None and b is not None:
                    sizes = [len(c.encode()) for c in part]
                    found = entries(self.digits, np.cumsum(sizes), *a, *b)
                    self.memo.update(zip(part, found))
                    self.held += sum(sizes) + sum(map(len, found)) + OBJECTS * len(part)
                elif joined == 1:
                    self.memo[part[0]] = b""
                    self.held += len(part[0]) + OBJECTS


def entries(digits, chunk_ends, ids_a, ends_a, ids_b, ends_b) -> list[bytes]:
    """For each chunk of a text (``digits``: the ids spelled): counts (four bytes each), links (eight bytes each) and spelled groups.

    Between two neighbouring ends of either side lies what one token of each covers: one link.  Ends that both sides have close a group."""
    ends = np.union1d(ends_a, ends_b)
    i, j = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    links = (ids_a[i] * SECOND + ids_b[j]).tobytes()
    cuts = ends[(ends_a[i] == ends) & (ends_b[j] == ends)]
    place = [np.searchsorted(x, chunk_ends, "right") for x in (ends_a, ends_b, cuts, ends)]
    counts = np.stack([np.diff(p, prepend=0) for p in place], 1).astype(np.uint32).tobytes()
    # tokens by group, those of the first side first, each with what stands after it
    group = [np.searchsorted(cuts, x) for x in (ends_a, ends_b)]
    last_a, last_b = np.append(np.diff(group[0]) > 0, True), np.append(np.diff(group[1]) > 0, True)
    after = np.concatenate([np.where(last_a, 1, 0), np.where(last_b, np.where(np.isin(ends_b, chunk_ends), 3, 2), 0)])
    order = np.argsort(np.concatenate([group[0] * 2, group[1] * 2 + 1]), kind="stable")
    spelled = "".join([digits[t] + ",|;\n"[s] for t, s in zip(np.concatenate([ids_a, ids_b])[order].tolist(), after[order].tolist())]).encode().split(b"\n")
    at = [0, *(8 * place[3]).tolist()]
    return [counts[16 * n:16 * n + 16] + links[at[n]:at[n + 1]] + spelled[n] for n in range(len(chunk_ends))]


def _aligned(path_a: str, path_b: str):
    def run(batches):
        """Blocks of texts: each text as the numbers of its chunks, the block's chunks, its id pairs and their documents."""
        aligner = Aligner(path_a, path_b)
        block, kind = TaskContext.get().partitionId() << 33, None
        keys, flat, lengths, held = [], [], [], 0

        def flush():
            found = pa.array(flat, pa.string()).dictionary_encode()
            known = found.dictionary.to_pylist()
            aligner.forget()
            aligner.learn(known)
            entries = [aligner.memo[c] for c in known]
            whole = np.array([len(e) > 0 for e in entries], bool)
            numbers = np.split(found.indices.to_numpy(zero_copy_only=False), np.cumsum(lengths)[:-1])
            texts = [n if whole[n].all() else np.empty(0, np.int32) for n in numbers]
            blank = bytes(16)
            stats = np.frombuffer(b"".join([e[:16] or blank for e in entries]), np.uint32).reshape(-1, 4).astype(np.int64)
            sizes = stats[:, 3]
            ends = (16 + 8 * sizes).tolist()
            pairs, at = np.unique(np.frombuffer(b"".join([e[16:n] for e, n in zip(entries, ends)]), np.int64), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            docs = np.zeros(len(pairs), np.int32)
            for n in texts:
                each = sizes[n]
                places = np.repeat(starts[n] - np.cumsum(each) + each, each) + np.arange(each.sum())
                docs[at[places]] += 1  # once a document, however often a pair stands in it
            blob = packed([np.array([*map(len, texts)], np.int64), np.concatenate([*texts, np.empty(0, np.int32)]), *stats.T, at], b"\n".join([e[n:] for e, n in zip(entries, ends)]))
            return pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([keys], pa.list_(kind)), pa.array([blob], pa.binary()), pa.array([pairs], pa.list_(pa.int64())),
                 pa.array([docs], pa.list_(pa.int32()))], ["block", "keys", "blob", "pairs", "docs"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                parts = aligner.chunks(text) if text else []
                keys.append(key)
                flat += parts
                lengths.append(len(parts))
                held += len(text)
                if held >= BLOCK:
                    yield flush()
                    keys, flat, lengths, held, block = [], [], [], 0, block + 1
        if keys:
            yield flush()

    return run


def _scored(batches):
    """For each block first its text row, then the counts of its pairs in order, run by run, to documents."""
    def finished(keys, blob, runs):
        (sizes, numbers, *stats, at), raw = unpacked(blob)
        counts, best = (np.concatenate([*x, np.empty(0, np.int64)]) for x in (zip(*runs) if runs else ([], [])))
        links = stats[3]
        stats += [summed(best[at], links), summed(counts[at], links)]
        names, cuts = raw.decode().split("\n"), np.cumsum(sizes).tolist()
        for first, last in slices_of(cuts, SLICE):
            lists = [numbers[s:e] for s, e in zip([0, *cuts][first:last], cuts[first:last])]
            flat = np.concatenate([*lists, np.empty(0, np.uint32)])
            spelled = [";".join([names[n] for n in x.tolist()]) for x in lists]
            sums = [pa.array(summed(s[flat], sizes[first:last])) for s in stats]
            yield pa.RecordBatch.from_arrays([keys[first:last], *sums, pa.array(spelled, pa.string())], ["key", *COUNTS, "n_best", "count_sum", "groups"])

    now, held, runs = None, None, []
    for batch in batches:
        for row, (block, run) in enumerate(zip(batch.column("block").to_pylist(), batch.column("run").to_pylist())):
            if block != now and held:
                yield from finished(*held, runs)
            if run < 0:
                now, held, runs = block, (batch.column("keys")[row].values, batch.column("blob")[row].as_py()), []
            else:
                runs.append([batch.column(c)[row].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("counts", "best")])
    if held:
        yield from finished(*held, runs)


def slices_of(cuts: list[int], most: int):
    """Runs of documents of about ``most`` chunks each, given where each document ends."""
    first, base = 0, 0
    for i, end in enumerate(cuts):
        if end - base >= most or i + 1 == len(cuts):
            yield first, i + 1
            first, base = i + 1, end


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, counts of tokens, groups and links, ``n_best``, ``count_sum`` and ``groups`` ('a1,a2|b1;a3|b2') of each whole text.

    ``path_a`` is a byte-level file of ``tokenizers`` and takes the text with a blank in front, ``path_b`` a
    ``sentencepiece`` model that adds the blank.  Offsets at which tokens of both end cut them into groups; tokens that
    overlap are linked; an id pair's count is how many documents hold it linked, and ``n_best`` counts the links whose
    count is the highest of their first id.  Special tokens are plain text.  A null or empty text, or one that the
    tokens of either side do not spell, has no tokens: zeros and ''.  Rows and null ids repeat as they stand, other columns are
    not returned, an empty table gives an empty one.

    Texts are stored once, in blocks of bounded size, as the numbers of their chunks; a block has a row per distinct
    pair, so a pair that every document holds costs one row a block when pairs are counted and return to their block."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    blocks = stored(rows.mapInArrow(_aligned(path_a, path_b), BLOCKS.format(kind=kind)))
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "p")).select("block", "at", "p.pairs", "p.docs")
    counts = pairs.groupBy("pairs").agg(F.sum("docs").alias("count"))
    first = F.shiftright("pairs", 32)
    # one row for each id of the first vocabulary
    highest = counts.groupBy(first.alias("first")).agg(F.max("count").alias("highest"))
    counts = counts.withColumn("first", first).join(highest, "first").select("pairs", "count", (F.col("count") == F.col("highest")).alias("best"))
    # counts return to their block in runs of bounded length
    back = pairs.select("block", "at", "pairs").join(counts, "pairs").groupBy("block", F.floor(F.col("at") / RUN).cast("int").alias("run"))
    back = back.agg(F.array_sort(F.collect_list(F.struct("at", "count", F.col("best").cast("int").alias("best")))).alias("c"))
    back = back.select("block", "run", F.lit(None).cast(f"array<{kind}>").alias("keys"), F.lit(None).cast("binary").alias("blob"),
                       F.col("c.count").alias("counts"), F.col("c.best").alias("best"))
    texts = blocks.select("block", F.lit(-1).alias("run"), "keys", "blob", F.lit(None).cast("array<long>").alias("counts"), F.lit(None).cast("array<int>").alias("best"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = texts.unionByName(back).repartition(parts, "block").sortWithinPartitions("block", "run")
    out = both.mapInArrow(_scored, f"key {kind}, {', '.join(c + ' long' for c in COUNTS)}, n_best long, count_sum long, groups string")
    return out.withColumnRenamed("key", id_col)
