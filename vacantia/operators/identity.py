"""Identity operators: which posting is this, and which records are the same one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab as V
from ..functions import records as R, urls as U
from ..functions.text import c, canonical, matches_role, words
from .grouping import attach_group, fence, first_by, names


def find_key(entries, keys, infer: bool = False) -> Column:
    """struct(field, value) of the first non-blank named key: own level first, then nested objects depth-first.

    ``entries`` are the flattened members of the record, objects included."""
    order = words(keys)
    rows = F.filter(c(entries), lambda s: ~s["kind"].startswith("OBJECT"))
    parts = lambda s: F.split(s["path"], r"\.")
    leaf = lambda s: F.element_at(parts(s), -1)

    def rank(s):
        exact = F.array_position(order, F.lower(leaf(s)))
        at = F.when(exact > 0, exact)
        if infer:  # inferred names as in infer_field: vocabulary order, then the shortest
            name = canonical(leaf(s))
            listed = F.array_position(words(["id", *V.ROLE_TERMS["id"]]), name)
            at = at.when(matches_role(leaf(s), "id"), F.when(listed > 0, 1000 + listed).otherwise(10_000 + F.length(name)).cast("bigint"))
        return F.when(at.isNotNull() & ~R.is_blank_value(s["value"]), F.struct(
            F.slice(parts(s), F.lit(1), F.size(parts(s)) - 1).alias("parent"), at.alias("at"),
            leaf(s).alias("field"), R.as_text(s["value"]).alias("value")))

    best = F.array_min(F.transform(rows, rank))
    return F.when(best.isNotNull(), F.struct(best["field"].alias("field"), best["value"].alias("value")))


def job_identity(df: DataFrame, raw: str | None = None, url=None, title=None, location=None, department=None,
                 company=None) -> DataFrame:
    """Adds identity_source, identity_value, identity_field by the identity cascade.

    Requisition id, posting id, stable id of the record; id inside the detail address; else a digest of
    address, title, place, department and company."""
    blank = lambda x: F.coalesce(c(x).cast("string"), F.lit("")) if x is not None else F.lit("")
    tries = []
    if raw is not None:
        df = df.withColumn("_find_members", R.flat_entries(raw, 3, keep="all"))
        for keys, source, infer in ((V.REQUISITION_KEYS, "REQUISITION_ID", False), (V.POSTING_KEYS, "JOB_POSTING_ID", False),
                                    (V.STABLE_KEYS, "STABLE_API_ID", True)):
            column = f"_find_{source}"
            df = df.withColumn(column, find_key("_find_members", keys, infer=infer))
            tries.append(F.when(F.col(column).isNotNull(), F.struct(
                F.lit(source).alias("s"), F.col(column)["value"].alias("v"), F.col(column)["field"].alias("f"))))
    if url is not None:
        df = df.withColumn("_url_id", U.url_identifier(url))
        found = F.col("_url_id")
        tries.append(F.when(found.isNotNull(), F.struct(
            F.when(found["source"].startswith("query:"), "STRUCTURED_DETAIL_ID").otherwise("CANONICAL_URL_ID").alias("s"),
            found["value"].alias("v"), found["source"].alias("f"))))
    text = F.concat_ws("\x1f", F.coalesce(U.canonical_url(url), F.lit("")) if url is not None else F.lit(""),
                       blank(title), blank(location), blank(department), blank(company))
    tries.append(F.struct(F.lit("COMPOSITE_FINGERPRINT").alias("s"), F.substring(F.sha2(text, 256), 1, 24).alias("v"),
                          F.lit("url+title+location+department+company").alias("f")))
    df = df.withColumn("_id", F.coalesce(*tries))
    dropped = [n for n in df.columns if n.startswith("_find_") or n in ("_url_id", "_id")]
    df = df.withColumns({"identity_source": F.col("_id.s"), "identity_value": F.col("_id.v"), "identity_field": F.col("_id.f")})
    return fence(df.drop(*dropped), ["identity_source", "identity_value", "identity_field"])


def dedupe_first(df: DataFrame, keys, order) -> DataFrame:
    """Keep the first record of each stable id in (page first seen, position) order."""
    return first_by(df, keys, order)


def page_ranked(df: DataFrame, run: str, page: str, index: str) -> DataFrame:
    """Adds page_rank: when the page was first seen in the run; a row without a page has its own place."""
    ranks = df.filter(F.col(page).isNotNull()).groupBy(run, page).agg(F.min(index).alias("page_rank"), F.count("*").alias("_size"))
    out = attach_group(df, ranks, [run, page]).drop("_size")
    return out.withColumn("page_rank", F.coalesce("page_rank", index))


def duplicate_groups(df: DataFrame, keys, title: str, url: str, raw_id: str, fingerprint: str) -> DataFrame:
    """One row per identity seen twice or more, with the reason the copies exist."""
    keys = names(keys)
    stable = F.col("identity_source").isin(V.STABLE_IDENTITY)
    # distinct facts are counted from partial min/max where one or many is all that matters
    one = lambda name: F.coalesce(F.min(name) == F.max(name), F.lit(True))
    grouped = df.groupBy(*keys).agg(
        F.count("*").alias("records"), one(fingerprint).alias("_same_print"), one(title).alias("_one_title"),
        one(url).alias("_one_url"), one(raw_id).alias("_one_id"))
    reason = (F.when(F.col("_same_print"), "IDENTICAL_SOURCE_RECORD")
              .when(stable & F.col("_one_title"), "SAME_REQUISITION_DUPLICATE_PRESENTATION")
              .when(~F.col("_one_url") | ~F.col("_one_title") | ~F.col("_one_id"), "AMBIGUOUS_ID_COLLISION")
              .otherwise("UNEXPLAINED_DUPLICATE"))
    return grouped.filter("records >= 2").withColumn("reason", reason).select(*keys, "records", "reason")


def duplicate_audit(groups: DataFrame, run) -> DataFrame:
    """Collapsed and unexplained copies per run."""
    explained = F.col("reason").isin("IDENTICAL_SOURCE_RECORD", "SAME_REQUISITION_DUPLICATE_PRESENTATION")
    extra = F.col("records") - 1
    return groups.groupBy(*names(run)).agg(
        F.count("*").alias("groups"), F.sum(F.when(explained, extra).otherwise(0)).alias("collapsed_count"),
        F.sum(F.when(explained, 0).otherwise(extra)).alias("unexplained_count"))


def dedup_trace(df: DataFrame, keys, order: str, groups: DataFrame, fingerprint: str, valid: Column,
                invalid_reason: Column) -> DataFrame:
    """Fate of every record: kept, kept under a suffixed id, dropped as a copy, dropped as invalid.

    ``keys`` end with the identity value; ``order`` is unique within the run."""
    keys = names(keys)
    ambiguous = groups.filter(F.col("reason").isin("AMBIGUOUS_ID_COLLISION", "UNEXPLAINED_DUPLICATE"))
    firsts = df.filter(valid).groupBy(*keys).agg(F.min(order).alias("_first"), F.count("*").alias("_size"))
    facts = firsts.join(ambiguous.select(*keys, F.lit(True).alias("_amb")), keys, "left")
    rows = attach_group(df, facts, keys)
    suffixed = F.concat(F.col(keys[-1]), F.lit(":"), F.substring(F.sha2(F.col(fingerprint), 256), 1, 12))
    fate = (F.when(~valid, "DROPPED_INVALID").when(F.col("_amb"), "PRESERVED_COLLISION_SUFFIX")
            .when(F.col(order) > F.col("_first"), "DROPPED_DUPLICATE").otherwise("PRESERVED"))
    return rows.withColumns({
        "classification": fate,
        "job_id": F.when(~valid, None).when(F.col("_amb"), suffixed).otherwise(F.col(keys[-1])),
        "reason": F.when(~valid, invalid_reason).when(fate == "DROPPED_DUPLICATE", "IDENTITY_ALREADY_PRESENT"),
    }).drop("_first", "_size", "_amb")


def dom_collisions(df: DataFrame, keys, order: str, url: str, title: str) -> DataFrame:
    """Rendered cards sharing an id: same address and title is a repeated presentation, anything else is kept
    under a suffixed id."""
    keys = names(keys)
    facts = df.groupBy(*keys).agg(
        F.min_by(F.struct(F.col(url).alias("u"), F.col(title).alias("t")), order).alias("_f"),
        F.min(order).alias("_first"), F.count("*").alias("_size"))
    rows = attach_group(df, facts, keys)
    same = F.col(url).eqNullSafe(F.col("_f.u")) & F.col(title).eqNullSafe(F.col("_f.t"))
    fate = (F.when(F.col(order) == F.col("_first"), "PRESERVED")
            .when(same, "SAME_REQUISITION_DUPLICATE_PRESENTATION").otherwise("AMBIGUOUS_ID_COLLISION"))
    suffixed = F.concat(F.col(keys[-1]), F.lit(":"), F.substring(F.sha2(F.col(url), 256), 1, 12))
    return rows.withColumns({"classification": fate, "job_id": F.when(
        fate == "AMBIGUOUS_ID_COLLISION", suffixed).otherwise(F.col(keys[-1]))}).drop("_f", "_first", "_size")


def title_identity(df: DataFrame, page: str, title: str, explicit: str, order: str, has_sections: str) -> DataFrame:
    """Card identity: explicit attribute or route id, else the title when it is unique on its page."""
    facts = df.filter(F.col(title) != "").groupBy(page, title).agg(F.count("*").alias("title_count"))
    rows = attach_group(df, facts, [page, title])
    by_title = F.concat(F.lit("title:"), F.substring(F.sha2(F.col(title), 256), 1, 24))
    unique = (F.col(title) != "") & (F.col("title_count") == 1) & F.col(has_sections)
    return rows.withColumns({
        "identity": F.coalesce(F.col(explicit), F.when(unique, by_title)),
        "identity_source": F.when(F.col(explicit).isNotNull(), "attribute").when(unique, "unique_title"),
        "ambiguous": F.col(explicit).isNull() & ~F.coalesce(unique, F.lit(False)) & F.coalesce(F.col("title_count") > 1, F.lit(False)),
    })
