"""Where a posting's detail can be found: id and address evidence, candidate addresses, method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab as V
from ..functions import jd as J, records as R, urls as U
from ..functions.text import c, let, strip, words
from .grouping import fence


def first_scalar(record, keys) -> Column:
    """struct(value, key) of the first non-blank text or integer among the keys, spelling without case."""
    order = words([k.lower() for k in keys])

    def rank(e):
        at = F.array_position(order, F.lower(e["key"]))
        text = strip(R.as_text(e["value"]))
        return F.when((at > 0) & R.kind(e["value"]).isin("STRING", "BIGINT") & (text != ""), F.struct(at.alias("at"), text.alias("value")))

    return let(F.array_min(F.transform(F.map_entries(c(record)), rank)), lambda b: F.when(
        b.isNotNull(), F.struct(b["value"].alias("value"), F.get(words(keys), (b["at"] - 1).cast("int")).alias("key"))))


def with_detail_evidence(df: DataFrame, record: str) -> DataFrame:
    """Adds detail_id, detail_id_field (own level, then one level down) and direct_url."""
    inner = F.transform(F.filter(F.array_sort(F.map_keys(record)), lambda k: R.kind(F.try_element_at(record, k)).startswith("OBJECT")),
                        lambda k: first_scalar(R.as_record(F.try_element_at(record, k)), V.DETAIL_ID_KEYS))
    found = F.coalesce(first_scalar(record, V.DETAIL_ID_KEYS), F.get(F.filter(inner, lambda x: x.isNotNull()), F.lit(0)))
    urls = F.transform(words(V.DETAIL_URL_KEYS), lambda n: R.as_text(F.try_element_at(c(record), n)))
    direct = F.get(F.filter(urls, lambda u: u.rlike("^https?://")), F.lit(0))
    partial = F.get(F.filter(urls, lambda u: (F.length(u) > 0) & (F.length(u) < 200) & ~u.rlike("^https?://")
                             & (u.endswith(".html") | F.exists(words(V.DETAIL_FILE_HINTS), lambda h: u.contains(h)))), F.lit(0))
    df = df.withColumn("_id", found)
    return df.withColumns({"detail_id": F.col("_id.value"), "detail_id_field": F.col("_id.key"), "direct_url": direct, "partial_path": partial}).drop("_id")


def campaign_type(context, list_url) -> Column:
    """Campaign kind a context or the list path states in words."""
    text = F.lower(F.concat_ws(" ", c(context), U.path(list_url)))
    word = lambda w: text.rlike(rf"(?:^|[/_\s-])(?:{w})(?:$|[./_\s-])")
    return F.when(word("school|campus"), "campus").when(word("social"), "social").when(word("intern"), "intern")


def campaign_prefix(list_url) -> Column:
    return F.nullif(F.regexp_extract(U.path(list_url), "(?i)(?:^|/)listPosition/([^/?#]+)", 1), F.lit(""))


def detail_url_candidates(df: DataFrame, record: str, list_url: str, context: Column | None = None, prefix: Column | None = None) -> DataFrame:
    """Adds candidates: addresses a detail page may have, most trustworthy first, built from evidence only."""
    df = with_detail_evidence(df, record)
    context = context if context is not None else F.lit(None).cast("string")
    prefix = prefix if prefix is not None else F.lit(None).cast("string")
    carry = F.transform(words(V.CARRY_KEYS), lambda k: F.struct(k.alias("k"), strip(R.as_text(F.try_element_at(c(record), k))).alias("v")))
    df = df.withColumns({"_campaign": campaign_type(context, list_url), "_origin": F.concat(U.scheme(list_url), F.lit("://"), U.netloc(list_url)), "_path": U.path(list_url)})
    post = lambda s: F.lower(s["k"]).isin("posttype", "post_type")
    kept = F.filter(carry, lambda s: (F.length(s["v"]) > 0) & ~(post(s) & (s["v"].rlike(r"^\d+(?:/\d+)+$") | F.col("_campaign").isNotNull())))
    pair = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    empty = F.expr("cast(array() as array<struct<k:string,v:string>>)")
    df = df.withColumn("_query", U.encode_pairs(F.concat(
        F.array(pair(F.col("detail_id_field"), F.col("detail_id"))),
        F.when(F.col("_campaign").isNotNull(), F.array(pair(F.lit("postType"), F.col("_campaign")))).otherwise(empty), kept)))
    id_key = lambda k: ~k.rlike(V.DETAIL_ID_EXCLUDED) & F.lower(k).isin([x.lower() for x in V.DETAIL_ID_KEYS])
    pairs = U.pairs(U.query(list_url))
    swap_key = F.get(F.filter(F.transform(pairs, lambda s: s["k"]), id_key), F.lit(0))
    df = df.withColumns({"_pairs": pairs, "_swap": swap_key})
    swapped = U.unsplit(U.scheme(list_url), U.netloc(list_url), F.col("_path"), U.encode_pairs(F.transform("_pairs", lambda s: pair(
        s["k"], F.when(s["k"] == F.col("_swap"), F.col("detail_id")).otherwise(s["v"])))), U.fragment(list_url))
    base = F.regexp_replace(F.concat("_origin", F.when(prefix.isNotNull(), F.concat(F.lit("/"), prefix)).otherwise(F.col("_path"))), "/+$", "")
    spa = prefix.isNull() & F.lower("_path").startswith("/api/") & ~F.lower("_path").rlike(r"\.(html|htm|php|aspx)$")
    ask = F.concat(F.lit("?"), F.col("_query"))
    with_id = F.array(
        F.when(F.col("partial_path").isNotNull(), F.concat("_origin", F.lit("/"), F.regexp_replace("partial_path", "^/+", ""), ask)),
        *[F.when(spa, F.concat("_origin", F.lit("/" + h), ask)) for h in V.DETAIL_ROUTE_HINTS],
        *[F.concat(base, F.lit("/" + h), ask) for h in V.DETAIL_FILE_HINTS], F.when(F.col("_swap").isNotNull(), swapped))
    none = F.expr(R.NO_STRINGS)
    return df.withColumn("candidates", F.array_distinct(F.array_compact(F.concat(
        F.array(F.col("direct_url")), F.when(F.col("detail_id").isNotNull(), with_id).otherwise(none))))).drop(
        "_campaign", "_origin", "_path", "_query", "_pairs", "_swap")


def resolve_targets(df: DataFrame, full_jd: str, responsibilities: str, requirements: str, has_spec: Column) -> DataFrame:
    """Adds method: the list is enough, a detail request is known, a page can be opened, or the list is all."""
    method = (F.when(~J.needs_full_jd(full_jd, responsibilities, requirements), "LIST_SUFFICIENT")
              .when(has_spec & F.col("detail_id").isNotNull(), "AUTO_API").when(F.size("candidates") > 0, "RENDERED_PAGE").otherwise("LIST_ONLY"))
    return fence(df.withColumn("method", method), ["candidates", "detail_id", "detail_id_field", "method"])
