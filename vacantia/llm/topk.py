"""Exact top-k inner products of integer vectors: tiled matrix products, partial selection, merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

# vectors of a shard, queries of a tile, shards whose lists one step of the merge takes together
SHARD, TILE, FAN_IN = 4096, 1024, 64
# most components of a shard or tile (8 MB); shards that one copy of a tile meets
COMPONENTS, SHARDS_A_COPY = 1 << 20, 4
FLAT = "n int, ids binary, matrix binary"


def quantised(vector: str, scale: int) -> Column:
    """floor(scale * x) of every component, computed in double; null where a component is null or not finite."""
    v = F.col(vector)
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(usable, F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _sharded(size: int):
    def run(batches):
        """Rows of (partition-free) shards: vectors of one length, at most ``size`` a shard."""
        held = {}

        def flush(width):
            ids, matrix = (np.concatenate(x) for x in zip(*held.pop(width)))
            return pa.RecordBatch.from_pydict({"n": pa.array([len(ids)], pa.int32()), "ids": [ids.tobytes()], "matrix": [matrix.tobytes()]})

        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            for width in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == width))
                ids = part.column(0).to_numpy(zero_copy_only=False)
                held.setdefault(width, []).append((ids, _matrix(part.column(1))))
                if sum(len(x[0]) for x in held[width]) * max(1, width) >= min(size * max(1, width), COMPONENTS):
                    yield flush(width)
        for width in list(held):
            yield flush(width)

    return run


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows; in floating point where no sum can leave its whole numbers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0 ** 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best(scores: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int):
    """The k best of each row of scores, ties to smaller ids, without the query's own id."""
    own = query_ids[:, None] == ids[None, :]
    floor = np.iinfo(np.int64).min
    hidden = np.where(own, floor, scores)
    edge = np.partition(hidden, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
    row, col = np.nonzero((hidden >= edge[:, None]) & ~own)
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, row, "left")
    keep = np.arange(len(row)) - first < k
    return query_ids[row[keep]], ids[col[keep]], scores[row[keep], col[keep]]


def _tiled(k: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                queries = np.frombuffer(r["q_matrix"], np.int64).reshape(len(q_ids), -1)
                vectors = np.frombuffer(r["matrix"], np.int64).reshape(len(ids), -1)
                if queries.shape[1] != vectors.shape[1]:
                    continue
                found = best(product(queries, vectors), q_ids, ids, k)
                columns = [*map(pa.array, found), pa.array(np.full(len(found[0]), r["shard"], np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score", "shard"])

    return run


def _flattened(rows: DataFrame, size: int) -> DataFrame:
    return rows.mapInArrow(_sharded(size), FLAT)


def search(queries: DataFrame, vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "vector",
           shard: int = SHARD, tile: int = TILE) -> DataFrame:
    """``query_id``, ``rank`` (int, from 1), ``vec_id`` and ``score`` of the k highest inner products of each query.

    Vectors are arrays of whole numbers; a vector that is or holds a null, or without id, takes no part, a query meets vectors of its own length.  Every
    vector row but those with the query's own id is a candidate, so a repeated row can stand twice in a list; a
    query id counts once (its least vector).  Ties go to the smaller id.  An empty side gives an empty table; other
    columns do not matter.

    Queries are gathered in tiles and vectors in shards, one row with a matrix each.  Tile and shard meet by an
    equality join on the tile's number, carried by each shard; a task multiplies, keeps k per query, and the lists
    are merged in a tree of ``FAN_IN``, so that no step holds more than FAN_IN * k rows of a query."""
    columns = [F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<bigint>").alias("v")]
    whole = F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull())
    asked = queries.select(*columns).filter(whole).groupBy("id").agg(F.min("v").alias("v"))
    flat = stored(_flattened(asked, tile).withColumn("tile", F.monotonically_increasing_id()))
    # tiles are numbered from 0 without gaps by the count of those in earlier partitions
    flat = flat.withColumn("part", F.shiftright("tile", 33)).withColumn("tile", F.col("tile").bitwiseAND((1 << 33) - 1))
    parts = flat.groupBy("part").count()
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    tiles = flat.join(before, "part").select((F.col("tile") + F.col("before")).alias("tile"),
                                             F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    n_tiles = flat.count()
    shards = _flattened(vectors.select(*columns).filter(whole), shard).withColumn("shard", F.monotonically_increasing_id())
    shards = stored(shards)
    steps = F.sequence(F.lit(0), F.lit(n_tiles - 1)) if n_tiles else F.array()
    # the copies of a tile part its shards, a few to each, so that few tiles still make many tasks
    n_shards = shards.count()
    copies = max(1, -(-n_shards // SHARDS_A_COPY))
    spread = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)).cast("array<bigint>"))
    pairs = shards.select("*", F.pmod(F.xxhash64("shard"), F.lit(copies)).alias("copy"), F.explode(steps.cast("array<bigint>")).alias("tile"))
    pairs = pairs.join(tiles.withColumn("copy", spread), ["tile", "copy"])
    lists = pairs.select("shard", "q_ids", "q_matrix", "ids", "matrix").mapInArrow(
        _tiled(k), "query_id long, vec_id long, score long, shard long")
    # shard numbers hold the partition above bit 33: hash them into groups that shrink by the fan-in at each step
    groups = max(1, -(-n_shards // FAN_IN))
    while groups > 1:
        group = F.pmod(F.xxhash64("shard", F.lit(groups)), F.lit(groups))
        lists = _merged(lists.withColumn("shard", group), ["query_id", "shard"], k)
        groups = -(-groups // FAN_IN)
    ranked = _merged(lists.drop("shard"), ["query_id"], k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _merged(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    best_first = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
