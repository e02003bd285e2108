"""Payload operators: business record, connections, nested detail, flattened rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from .. import vocab as V
from ..functions import jd as J, records as R
from ..functions.text import c, let
from .grouping import fence, first_by


def resolve_payload(v, steps: list[str]) -> Column:
    """struct(record, code): the object at an explicit path, or why there is none."""
    found = R.path_get(v, ".".join(steps)) if steps else c(v)
    code = F.when(found.isNull(), "DETAIL_PAYLOAD_PATH_MISSING").when(R.as_record(found).isNull(), "DETAIL_PAYLOAD_INVALID")
    return F.struct(F.when(code.isNull(), found).alias("record"), code.alias("code"))


def connection(df: DataFrame, v: str, depth: int = 7) -> DataFrame:
    """Adds list_path, records, item_path, has_more, cursor of a connection-shaped payload; edges hold nodes even when there are none."""
    df = df.withColumn("_flat", R.flat_entries(v, depth))
    df = df.withColumn("_conn", F.array_max(F.transform(
        F.filter("_flat", lambda s: s["kind"].startswith("ARRAY") & s["path"].rlike(V.CONNECTION_SUFFIX)),
        lambda s: F.struct(F.size(R.as_array(s["value"])).alias("n"), s["path"].alias("path"), R.as_text(s["value"]).alias("text")))))
    items = R.as_array(R.parse("_conn.text"))
    nodes = ((F.size(items) > 0) | F.lower("_conn.path").endswith(".edges")) & F.forall(items, lambda x: R.as_record(F.try_variant_get(x, "$.node", "variant")).isNotNull())
    info = F.concat(F.regexp_replace("_conn.path", r"\.[^.]*$", ""), F.lit(".pageInfo."))
    member = lambda name: R.as_text(F.get(F.filter("_flat", lambda s: s["path"] == F.concat(info, F.lit(name))), F.lit(0))["value"])
    return df.withColumns({
        "list_path": F.col("_conn.path"), "records": F.col("_conn.n"), "item_path": F.when(nodes, "node"),
        "has_more": member("hasNextPage") == "true", "cursor": member("endCursor"),
    }).drop("_flat", "_conn")


def flatten_rows(df: DataFrame, v: str, depth: int = 6) -> DataFrame:
    """One row per leaf path of a payload."""
    rest = [n for n in df.columns if n != v]
    out = df.select(*rest, F.explode(R.flat_entries(v, depth)).alias("_e"))
    return out.select(*rest, F.col("_e.path").alias("path"), F.col("_e.kind").alias("kind"), F.col("_e.value").alias("value"))


def _below(depth: int):
    """UDF over JSON texts: the objects more than ``depth`` levels down, as a JSON array of (at, path, value).

    Built inside a function, so executors receive the code itself and need no copy of this package."""
    def walk(texts):
        import json

        import pandas as pd

        def objects(root):
            found, left = [], [([], [], root)]
            while left:
                at, path, value = left.pop()
                named = [(k, k, x) for k, x in value.items()] if isinstance(value, dict) else [(f"{i:09}", f"{i:02}", x) for i, x in enumerate(value)]
                for a, p, x in named:
                    if isinstance(x, (dict, list)):
                        left.append(([*at, a], [*path, p], x))
                        if isinstance(x, dict) and len(at) >= depth:
                            found.append({"at": [*at, a], "path": [*path, p], "value": json.dumps(x, ensure_ascii=False)})
            return json.dumps(found, ensure_ascii=False)

        return pd.Series([None if t is None else objects(json.loads(t)) for t in texts])

    return F.pandas_udf(walk, StringType())


def _deep_text(v, depth: int) -> Column:
    """The JSON text of a payload with more than ``depth`` levels of brackets below its own, else null."""
    def deep(text):
        rest = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]++|\\.)*+"|[^\[\]{}"]++', ""), r"[^\[\]{}]", "")
        for _ in range(depth + 1):
            rest = F.regexp_replace(rest, r"\{\}|\[\]", "")
        return F.when(rest != "", text)

    return let(F.to_json(c(v)), deep)


def _objects(v, depth: int) -> Column:
    """array<struct<at,path,value>> of the objects of a payload, inside arrays as well, all items; ``at`` sorts depth-first.

    Levels up to ``depth`` are expressions; only payloads that go on below are walked to their end in Python."""
    none = F.expr(R.NO_STRINGS)
    root = F.array(F.struct(none.alias("at"), none.alias("path"), c(v).alias("value")))
    step = lambda n, at, name, value: F.struct(F.concat(n["at"], F.array(at)).alias("at"), F.concat(n["path"], F.array(name)).alias("path"), value.alias("value"))
    members = lambda n: let(R.as_record(n["value"]), lambda m: F.transform(
        F.coalesce(F.map_entries(m), F.expr("cast(array() as array<struct<key:string,value:variant>>)")), lambda e: step(n, e["key"], e["key"], e["value"])))
    items = lambda n: F.transform(
        F.coalesce(R.as_array(n["value"]), F.expr("cast(array() as array<variant>)")),
        lambda x, i: step(n, F.lpad(i.cast("string"), 9, "0"), F.lpad(i.cast("string"), F.greatest(F.length(i.cast("string")), F.lit(2)), F.lit("0")), x))
    nested = lambda n: let(R.kind(n["value"]), lambda k: k.startswith("OBJECT") | k.startswith("ARRAY"))
    inside = lambda level: F.filter(F.flatten(F.transform(level, lambda n: F.concat(members(n), items(n)))), nested)
    # each level is made from the one before it, once
    grown = lambda root: F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.struct(root.alias("level"), root.alias("all")), lambda acc, _: let(
        inside(acc["level"]), lambda level: F.struct(level.alias("level"), F.concat(acc["all"], level).alias("all"))))["all"]
    nodes = let(root, grown)
    below = F.from_json(F.coalesce(_below(depth)(_deep_text(v, depth)), F.lit("[]")), "array<struct<at:array<string>,path:array<string>,value:string>>")
    deeper = F.transform(below, lambda n: F.struct(n["at"].alias("at"), n["path"].alias("path"), R.parse(n["value"]).alias("value")))
    return F.concat(F.filter(nodes, lambda n: R.kind(n["value"]).startswith("OBJECT")), deeper)


def detail_record(v, depth: int = 6) -> Column:
    """struct(path, state, record_json) of the first nested object, depth-first, that carries a job description."""
    def first(nodes):
        found = F.transform(nodes, lambda n, i: F.struct(
            n["at"].alias("at"), n["path"].alias("path"), J.jd_state(R.as_record(n["value"])).alias("state"), i.alias("i")))
        return let(F.array_min(F.filter(found, lambda s: s["state"] != "ABSENT")), lambda b: F.struct(
            F.array_join(b["path"], ".").alias("path"), b["state"].alias("state"), R.as_text(F.get(nodes, b["i"])["value"]).alias("record_json")))

    return let(_objects(v, depth), first)


def embedded_detail(states: DataFrame, page: str, expected_title: str, depth: int = 6) -> DataFrame:
    """First job detail of a page's serialized states: credible text and a title that fits, inside arrays as well.

    States are rows; the first hit of a page is chosen by source index, then depth-first position."""
    df = states.withColumn("_o", F.explode(_objects("state", depth)))
    df = df.withColumn("_r", R.as_record(F.col("_o.value"))).withColumn("_jd", J.pick_jd("_r"))
    title = R.first_text("_r", V.EMBEDDED_TITLE_KEYS)
    good = fence(df, ["_r", "_jd"]).filter(F.col("_jd.description").isNotNull() & J.credible_jd(F.col("_jd.description")) & J.loose_title_match(expected_title, title))
    rows = good.select(page, "source_index", F.col("_o.at").alias("_at"), title.alias("title"), F.col("_jd.description").alias("full_jd"),
                       F.col("_jd.responsibilities").alias("responsibilities"), F.col("_jd.requirements").alias("requirements"))
    return first_by(rows, page, ["source_index", "_at"]).drop("_at")
