"""Group-wise building blocks that stay balanced when one group holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

def names(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def fence(df: DataFrame, columns) -> DataFrame:
    """Compute the columns here, once.

    A later filter on a derived column is normally pushed below the projection that derives it, which
    repeats the whole derivation inside the filter.  Emitting the columns through a one-row generator keeps
    such filters above; filters on source columns still reach the scan."""
    columns = list(columns)
    packed = F.inline(F.array(F.struct(*[F.col(x) for x in columns])))
    return df.select(*[x for x in df.columns if x not in columns], packed)


def first_by(df: DataFrame, keys, order, last: bool = False) -> DataFrame:
    """The first (or last) whole row of each group in a total order.

    An aggregate, not a window: every task reduces its own rows before the shuffle, so a group of a
    billion copies reaches the reducer as one row per task."""
    keys = names(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in (order if isinstance(order, (list, tuple)) else [order])]
    rest = [n for n in df.columns if n not in keys]
    pick = F.max_by if last else F.min_by
    grouped = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return grouped.select(*[F.col(k) if k in keys else F.col(f"_row.{k}") for k in df.columns])


def attach_group(rows: DataFrame, groups: DataFrame, keys) -> DataFrame:
    """Left join facts of a group, one row each, onto its rows; rows without a group, or with a null key, keep nulls.

    One join.  Small facts are broadcast by their measured size; otherwise a group that holds a large share of all rows
    is split at run time (adaptive skew join, which the session settings force), as the side of the facts has one row
    for it."""
    keys = names(keys)
    return rows.join(groups, keys, "left").select(*rows.columns, *[n for n in groups.columns if n not in keys])


def running_total(df: DataFrame, keys, order: str, values: dict[str, str], block: int = 4096, tie=()) -> DataFrame:
    """Running sums along an integral order (ties broken by ``tie``), in two levels.

    Sums run inside blocks of the order, block totals run over blocks; a single long group is therefore
    cut into many tasks instead of one."""
    keys = names(keys)
    cut = F.floor(F.col(order) / block).cast("bigint")
    df = df.withColumn("_block", cut)
    inner = Window.partitionBy(*keys, "_block").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "_block").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    before = totals.select(*keys, "_block", *[F.coalesce(F.sum(f"_t_{n}").over(outer), F.lit(0)).alias(f"_b_{n}")
                                              for n in values])
    local = df.select("*", *[F.sum(v).over(inner).alias(f"_l_{n}") for n, v in values.items()])
    known = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_block"])], *[f"_b_{n}" for n in values])
    met = F.lit(True)
    for i, k in enumerate([*keys, "_block"]):  # a null key is a group of its own, a null order the first block
        met = met & local[k].eqNullSafe(known[f"_k{i}"])
    out = local.join(known, met)
    plain = [n for n in df.columns if n != "_block"]
    return out.select(*plain, *[(F.col(f"_l_{n}") + F.col(f"_b_{n}")).alias(n) for n in values])


def top_k(df: DataFrame, keys, order, k: int) -> DataFrame:
    """Best k rows per group; each task keeps only its own best k before the shuffle."""
    w = Window.partitionBy(*names(keys)).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def modal(df: DataFrame, keys, value: str, ordinal: str | None = None) -> DataFrame:
    """Most frequent value per group and its count; ties go to the smallest ordinal (or value)."""
    keys = names(keys)
    first = F.min(ordinal if ordinal else value).alias("_o")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"), first)
    best = F.min_by(F.struct(F.col(value), F.col("_n")), F.struct((-F.col("_n")).alias("n"), F.col("_o")))
    out = counts.groupBy(*keys).agg(best.alias("_m"), F.sum("_n").alias("n_values"))
    return out.select(*keys, F.col(f"_m.{value}").alias(value), F.col("_m._n").alias("n"), "n_values")
