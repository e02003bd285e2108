"""Source planning: scopes, trusted values, alignment to a source spec, choice of source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab as V
from ..functions.text import c, strip
from .grouping import first_by, names


def _shape(x) -> Column:
    return F.lower(F.regexp_replace(c(x).cast("string"), "[-_]", ""))


def same_scope_value(a, b) -> Column:
    """Equal but for case, ``-``/``_`` and number form."""
    text = _shape(a) == _shape(b)
    number = c(a).cast("string").try_cast("double") == c(b).cast("string").try_cast("double")
    return F.coalesce(text | F.coalesce(number, F.lit(False)), F.lit(False))


def trusted_scope(values, detected) -> Column:
    """Request values with every key the page's own scope also states bound to the page's value."""
    known = F.transform_keys(F.map_filter(c(detected), lambda _, v: v != ""), lambda k, _: _shape(k))
    return F.transform_values(c(values), lambda k, v: F.when(
        F.try_element_at(known, _shape(k)).isNull() | same_scope_value(v, F.try_element_at(known, _shape(k))), v
    ).otherwise(F.try_element_at(known, _shape(k))))


def scope_identity(params) -> Column:
    """``k=v`` list of the request fields that define a separate collection."""
    kept = F.array_sort(F.map_entries(F.map_filter(c(params), lambda k, _: F.lower(k).isin(V.SCOPE_ID_KEYS))))
    return F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def scope_label(phase, hint, fallback) -> Column:
    """Tab name of the capture phase, else a sample value, else the fallback."""
    tab = F.when(c(phase).startswith("SCOPE_"), F.nullif(strip(F.regexp_replace(c(phase), "^SCOPE_", "")), F.lit("")))
    return F.coalesce(tab, F.nullif(strip(c(hint)), F.lit("")), c(fallback))


def apply_spec(exchanges: DataFrame, specs: DataFrame, on) -> DataFrame:
    """Give each exchange its source's field contract.  The spec table has one row per source contract;
    the optimizer broadcasts it while it is small and shuffles it otherwise."""
    return exchanges.join(specs, names(on), "inner")


def select_source(df: DataFrame, site: str) -> DataFrame:
    """Best plan per site: list-sufficient first, then tier, confidence, support; the first one on ties."""
    return first_by(df, site, [(~F.col("list_sufficient")).alias("a"), (-F.col("tier")).alias("b"),
                               (F.col("confidence") != "HIGH").alias("d"), (~F.col("supported")).alias("e"), F.col("ordinal")])


def plan_tier(mode, ready, review) -> Column:
    return (F.when(c(ready) & c(mode).isin("HTTP_API", "BROWSER_API", "SERIALIZED_STATE"), 5.0)
            .when(c(ready) & (c(mode) == "HTML"), 4.5).when(c(ready) & (c(mode) == "BROWSER_RUNTIME_DATA"), 4.0)
            .when(c(ready) & (c(mode) == "DOM"), 3.0).when(c(review), 2.0).otherwise(1.0))


def compatible_scopes(df: DataFrame, contract, identity: str, order: str) -> DataFrame:
    """Scopes that share one contract: one row per contract and identity, where the contract has two or more.

    Grouping replaces the self join: rows of a contract never meet pairwise."""
    contract = names(contract)
    distinct = first_by(df.filter(F.col(identity) != ""), contract + [identity], order)
    counts = distinct.groupBy(*contract).agg(F.count("*").alias("scopes"))
    return distinct.join(counts.filter("scopes > 1"), contract)


def latest_reusable(df: DataFrame, url: str, finished: str, version: str, now, tool_version: str,
                    max_age: int = V.REUSE_SECONDS) -> DataFrame:
    """Freshest artifact per normalised source address within the age limit and of the same tool version."""
    from ..functions.urls import normalized_source_url

    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col(finished).cast("timestamp"))
    fresh = df.filter((F.col(version) == tool_version) & age.between(0, max_age))
    keyed = fresh.withColumn("source_key", normalized_source_url(url))
    return keyed.groupBy("source_key").agg(F.max(finished).alias(finished), F.count("*").alias("candidates"))
