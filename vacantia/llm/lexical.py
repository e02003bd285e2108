"""Ranked lexical search, exact: bounds from hashed max-sketches of the documents, rescoring by descending bound.

A term's share of a score is a weight, which depends on the term alone, times an impact, which depends on the document.
A document's impacts are folded into a short array, each coordinate keeping the highest of those that hash to it; so a
query's weights times the coordinates of its terms are never below its score.  The queries of a batch look up their
bounds in the sketches of a block together, and documents are scored exactly by descending bound until the next bound
is below the k-th score found."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import WIDE_ROWS, stored

# coordinates of a sketch; documents and distinct terms of a block; terms of a batch of queries
WIDTH, DOCUMENTS, TERMS, BATCH = 4096, 512, 1 << 18, 1 << 14
# lists one step of the merge takes together, blocks that one copy of a batch meets, documents scored between two looks at the bound
FAN_IN, BLOCKS_A_COPY, STEP = 64, 4, 32
# bytes of all queries together up to which they are sent to every task whole
BROADCAST = 8 << 20
# 0-9, A-Z (as a-z), a-z and all bytes of characters beyond ASCII form terms; other bytes become blanks
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
BLOCKS = "ids array<long>, lengths array<long>, sizes array<int>, terms array<string>, counts array<int>"


def _counted(text: str | None) -> Counter:
    return Counter((text or "").encode().translate(TABLE).split())


def _blocks(batches):
    """Rows of (id, text) to blocks of term counts; texts without a term go."""
    ids, lengths, sizes, terms, counts = [], [], [], [], []

    def flush():
        row = pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())),
             pa.array([terms], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int32()))],
            ["ids", "lengths", "sizes", "terms", "counts"])
        for held in (ids, lengths, sizes, terms, counts):
            held.clear()
        return row

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = _counted(text.as_py())
            if found:
                ids.append(key)
                lengths.append(found.total())
                sizes.append(len(found))
                terms.extend(found)
                counts.extend(found.values())
            if len(ids) >= DOCUMENTS or len(terms) >= TERMS:
                yield flush()
    if ids:
        yield flush()


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The term counts of whole texts in blocks of bounded size, stored; rows without id or term take no part."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull())
    return stored(rows.mapInArrow(_blocks, BLOCKS), WIDE_ROWS)


def _queries(queries: DataFrame, blocks: DataFrame, n_docs: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Batches of queries: batch, items array of (id, terms, weights); a weight counts the term's repeats.  And their size in bytes."""
    def counted(rows):
        for batch in rows:
            found = [(key, t.decode(), n) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                     for t, n in _counted(text).items()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()),
                                              pa.array([f[2] for f in found], pa.int64())], ["id", "term", "n"])

    asked = queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    asked = asked.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("text").alias("text"))
    terms = stored(asked.mapInArrow(counted, "id long, term string, n long"))
    held = blocks.select(F.explode("terms").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    weight = F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)))
    weights = held.groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("weight"))
    count, size = (int(x or 0) for x in terms.select(F.count("*"), F.sum(F.octet_length("term") + 32)).first())
    batches = max(1, -(-count // BATCH))
    items = terms.join(weights, "term").groupBy("id").agg(F.collect_list(F.struct("term", (F.col("n") * F.col("weight")).alias("weight"))).alias("t"))
    item = F.struct("id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))
    return stored(items.groupBy(F.pmod(F.xxhash64("id"), F.lit(batches)).alias("batch")).agg(F.collect_list(item).alias("items"))), size


class Batch:
    """A batch of queries, ready for blocks, with the best documents so far of each."""

    def __init__(self, items: list[dict], k: int, width: int):
        self.k, self.ids = k, [i["id"] for i in items]
        self.terms = {t: n for n, t in enumerate(dict.fromkeys(t for i in items for t in i["terms"]))}
        places = np.array([xxhash.xxh3_64_intdigest(t) % width for t in self.terms], np.int64)
        self.coordinates, at = np.unique(places, return_inverse=True)
        self.items, self.lookup = [], np.zeros((len(self.coordinates), len(items)))
        for n, i in enumerate(items):
            own = np.array([self.terms[t] for t in i["terms"]], np.int64)
            weights = np.array(i["weights"], np.int64)
            np.add.at(self.lookup[:, n], at[own], weights)
            self.items.append((own, weights))
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(items)

    def take(self, n: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Keep the k highest scores above 0 of query ``n``, ties to smaller ids."""
        scores, ids = np.concatenate([self.best[n][0], scores]), np.concatenate([self.best[n][1], ids])
        order = np.lexsort((ids, -scores))[:self.k]
        order = order[scores[order] > 0]
        self.best[n] = scores[order], ids[order]

    def edge(self, n: int) -> int:
        """The score below which a document cannot enter."""
        scores = self.best[n][0]
        return int(scores[-1]) if len(scores) == self.k else 1


class Block:
    """Impacts of a block's documents: all folded in the sketches, those of each document beside them."""

    def __init__(self, ids, lengths, sizes, terms: pa.Array, counts, n_docs: int, total: int, width: int):
        self.ids = ids
        m = [25 + 75 * n * n_docs // total for n in lengths.tolist()]
        m = np.array(m, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.doc = np.repeat(np.arange(len(ids)), sizes)
        self.impacts = 1_000_000_000 * counts // (1000 * counts + 8 * m[self.doc])
        coded = pc.dictionary_encode(terms)
        self.codes, self.distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        places = np.array([xxhash.xxh3_64_intdigest(t) % width for t in self.distinct], np.int64)
        self.sketch = np.zeros(len(ids) * width, np.int64)
        np.maximum.at(self.sketch, self.doc * width + places[self.codes], self.impacts)
        self.sketch = self.sketch.reshape(len(ids), width)

    def search(self, batch: Batch) -> int:
        """Let the block's documents into the lists of every query of the batch; how many were scored."""
        # sums stay below 2^53, where floating point is exact
        bounds = self.sketch[:, batch.coordinates].astype(np.float64) @ batch.lookup
        known = np.array([batch.terms.get(t, -1) for t in self.distinct], np.int64)[self.codes]
        own, weight, scored = known >= 0, np.zeros(len(batch.terms), np.int64), 0
        # only postings of the batch's terms are needed to score
        ends = np.concatenate([[0], np.cumsum(own)])[self.starts]
        terms, impacts = known[own], self.impacts[own]
        for n, (places, weights) in enumerate(batch.items):
            bound = bounds[:, n]
            docs = np.flatnonzero(bound >= batch.edge(n))
            docs = docs[np.argsort(-bound[docs], kind="stable")]
            weight[places] = weights
            for i in range(0, len(docs), STEP):
                part = docs[i:i + STEP]
                part = part[bound[part] >= batch.edge(n)]
                if not len(part):
                    break
                sizes = ends[part + 1] - ends[part]
                at = np.repeat(ends[part] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                scores = np.zeros(len(part), np.int64)
                np.add.at(scores, np.repeat(np.arange(len(part)), sizes), weight[terms[at]] * impacts[at])
                batch.take(n, scores, self.ids[part])
                scored += len(part)
            weight[places] = 0
        return scored


def _searched(k: int, n_docs: int, total: int, width: int, most: int = 32):
    def run(rows):
        """Blocks with a batch of queries each to the task's best documents of each query."""
        held, part = {}, TaskContext.get().partitionId()

        def flush():
            lists = [(i, *b) for batch in held.values() for i, b in zip(batch.ids, batch.best)]
            held.clear()
            scores = np.concatenate([x[1] for x in lists])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([x[0] for x in lists], [len(x[1]) for x in lists]), pa.int64()),
                 pa.array(np.concatenate([x[2] for x in lists]), pa.int64()), pa.array(scores, pa.int64()), pa.array(np.full(len(scores), part))],
                ["item_id", "doc_id", "score", "part"])

        for batch in rows:
            for row in range(batch.num_rows):
                name = batch.column("batch")[row].as_py()
                if name not in held:
                    if len(held) >= most:
                        yield flush()
                    held[name] = Batch(batch.column("items")[row].as_py(), k, width)
                column = lambda c: batch.column(c)[row].values
                flat = lambda c: column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                Block(flat("ids"), flat("lengths"), flat("sizes"), column("terms"), flat("counts"), n_docs, total, width).search(held[name])
        if held:
            yield flush()

    return run


def search(queries: DataFrame, blocks: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``item_id``, ``rank`` (int, from 1), ``doc_id`` and ``score`` of the k highest scores above 0 of each query, ties to the smaller id.

    ``blocks`` come from ``index``; counts of documents, of terms and of the documents of a term cover all of them.  A
    query or document without id or term has no result; a query id counts once (its least text), a repeated document
    row as often as it stands.  An empty side gives an empty table; other columns do not matter.

    Block and batch meet by an equality join on the batch's number, carried by each block: queries of at most
    ``BROADCAST`` bytes go to every task, more are shuffled, in copies for a few blocks each.  A task keeps k documents
    a query over all its blocks, so later blocks are cut by what earlier ones hold, and lists are merged in a tree."""
    sums = blocks.select(F.sum(F.size("ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda s, x: s + x)), F.count("*")).first()
    n_docs, total, n_blocks = (int(x or 0) for x in sums)
    batches, size = _queries(queries, blocks, n_docs, id_col, text_col)
    numbers = [r[0] for r in batches.select("batch").collect()]
    copies = max(1, -(-n_blocks // BLOCKS_A_COPY))
    spread = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)).cast("array<bigint>"))
    carried = F.explode(F.array(*map(F.lit, numbers)).cast("array<bigint>"))
    pairs = blocks.withColumn("copy", F.pmod(F.xxhash64("ids"), F.lit(copies))).withColumn("batch", carried)
    if size <= BROADCAST:
        pairs = pairs.join(F.broadcast(batches), "batch")
    else:
        pairs = pairs.join(batches.withColumn("copy", spread).hint("merge"), ["batch", "copy"])
    lists = pairs.mapInArrow(_searched(k, n_docs, total, width), "item_id long, doc_id long, score long, part long")
    groups = max(1, -(-n_blocks // FAN_IN))
    while groups > 1:
        lists = _merged(lists.withColumn("part", F.pmod(F.xxhash64("part", F.lit(groups)), F.lit(groups))), ["item_id", "part"], k)
        groups = -(-groups // FAN_IN)
    return _merged(lists.drop("part"), ["item_id"], k).select("item_id", "rank", "doc_id", "score")


def _merged(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    best_first = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    return lists.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
