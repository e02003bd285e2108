"""Drop lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import BLANKS, ascii_lower, fresh, hash128, stored, without

# most rows of a table of frequent lines that is sent to every task (two hashes a row, under 64 MB built)
BROADCAST_ROWS = 500_000


def line_key(line: Column) -> Column:
    """The key under which lines count as equal: stripped of blanks at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines whose key stands in at least ``min_docs`` documents are dropped from every document.

    Documents are rows: a repeated row counts again.  A null or empty text is one empty line, and a line
    without a key is never dropped.  ``text_col`` gets the lines that stay, joined by newline (null becomes
    empty); ``n_lines`` and ``n_dropped`` are added and replace columns of these names.  A null id is an id
    like any other; other columns stay as they are.  An empty table gives an empty table.

    Keys are hashed to 128 bits.  Counting is an aggregate of one row per document and key, so a line in
    every document costs one row per task.  Positions of dropped lines come back by an equality join; the
    table of frequent keys is broadcast only after its rows were counted, and joined by shuffle beyond that."""
    docs = without(docs, "n_lines", "n_dropped")
    row, h1, h2, key, pos, drop, lines = fresh(docs, "_row", "_h1", "_h2", "_key", "_pos", "_drop", "_lines")
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    keyed = F.col(key).alias(key)
    slim = docs.select(id_col, text_col)
    distinct = F.array_distinct(F.transform(split, line_key))
    counted = slim.select(F.explode(distinct).alias(key)).filter(F.length(keyed) > 0)
    counted = counted.select(*[c.alias(n) for c, n in zip(hash128(F.col(key)), (h1, h2))])
    frequent = stored(counted.groupBy(h1, h2).count().filter(F.col("count") >= min_docs).select(h1, h2))
    if frequent.count() <= BROADCAST_ROWS:
        frequent = F.broadcast(frequent)

    # a document is found again by its id and whole text, which gives the same rows on every attempt
    same = F.struct(F.col(id_col).alias("id"), *[c.alias(n) for c, n in zip(hash128(F.col(text_col)), ("a", "b"))])
    placed = slim.select(same.alias(row), F.posexplode(split).alias(pos, key))
    placed = placed.select(row, pos, line_key(F.col(key)).alias(key)).filter(F.length(F.col(key)) > 0)
    placed = placed.select(row, pos, *[c.alias(n) for c, n in zip(hash128(F.col(key)), (h1, h2))])
    gone = placed.join(frequent, [h1, h2], "left_semi").groupBy(row).agg(F.collect_set(pos).alias(drop))

    whole = docs.withColumn(row, same)
    whole = whole.join(gone.withColumnRenamed(row, key), F.col(row) == F.col(key), "left").drop(row, key)
    return _reassembled(whole, split, text_col, lines, drop)


def _reassembled(whole: DataFrame, split: Column, text_col: str, lines: str, drop: str) -> DataFrame:
    """Texts from the lines whose position is not dropped."""
    n = F.size(lines)
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col(drop))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n")
    columns = [F.col(f"`{c}`") for c in whole.columns if c not in (lines, drop)]
    with_lines = whole.select(*columns, F.col(drop), split.alias(lines))
    text = F.when(F.col(drop).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(kept)
    out = [text.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in whole.columns if c not in (lines, drop)]
    return with_lines.select(*out, n.cast("bigint").alias("n_lines"),
                             F.coalesce(F.size(drop), F.lit(0)).cast("bigint").alias("n_dropped"))
