"""Expressions over dynamic records.

A record is ``map<string,variant>`` (one JSON object, top level split out); a payload is ``variant``.
Objects carry no key order once parsed, so wherever a rule says "first key", keys count alphabetically.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import vocab as V
from .text import blank_to_null, c, canonical, infer_field, let, matches_role, strip, words

RECORD = "map<string,variant>"
NO_STRINGS = "cast(array() as array<string>)"


def parse(json_text) -> Column:
    return F.try_parse_json(c(json_text))


def parse_strict(json_text) -> Column:
    """One whole JSON value, else null.

    The built-in parser stops after the first value, so the text is parsed as the only element of an array;
    a text with a bracket of its own must also parse as the only member of an object."""
    x = c(json_text)
    listed = F.try_parse_json(F.concat(F.lit("["), x, F.lit("]")))
    alone = F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1
    member = F.try_parse_json(F.concat(F.lit('{"v":'), x, F.lit("}"))).isNotNull()
    return F.when(alone & (~x.contains("]") | member), F.try_variant_get(listed, "$[0]", "variant"))


def as_record(v) -> Column:
    """The object as a record; null when the value is not an object."""
    return F.try_variant_get(c(v), "$", RECORD)


def as_array(v) -> Column:
    return F.try_variant_get(c(v), "$", "array<variant>")


def as_text(v) -> Column:
    """Any scalar (or JSON of a nested value) as text."""
    return F.try_variant_get(c(v), "$", "string")


def kind(v) -> Column:
    return F.schema_of_variant(c(v))


def is_text(v) -> Column:
    return kind(v) == "STRING"


def is_integer(v) -> Column:
    """A JSON integer; booleans are not integers."""
    return kind(v) == "BIGINT"


def only_text(v) -> Column:
    """The value when it is a JSON string, trimmed and not blank."""
    return F.when(is_text(v), blank_to_null(as_text(v)))


def get(record, key: str) -> Column:
    return F.try_element_at(c(record), F.lit(key))


def text_of(v) -> Column:
    """Text of a scalar string or of a labelled object."""
    labelled = F.coalesce(*[F.when(is_text(F.try_variant_get(c(v), f"$.{k}", "variant")),
                                   F.try_variant_get(c(v), f"$.{k}", "string")) for k in V.LABEL_KEYS])
    return F.when(is_text(v), blank_to_null(as_text(v))).otherwise(labelled)


def string_value(v) -> Column:
    """Non-blank text of a string, or of the first text-bearing member of an object; kept verbatim."""
    tries = F.array(c(v), *[F.try_variant_get(c(v), f"$.{k}", "variant") for k in V.TEXT_OBJECT_KEYS])
    return as_text(F.get(F.filter(tries, lambda x: is_text(x) & (strip(as_text(x)) != "")), F.lit(0)))


def is_blank_value(v) -> Column:
    """Missing for membership tests: null, empty text, empty array (also one spelled as text).

    Zero and false are values.  One read of the value decides."""
    return F.coalesce(as_text(v).isin("", "[]"), F.lit(True))


def path_get(v, path: str | None, type_: str = "variant") -> Column:
    """Dotted path into a payload; ``$`` is the root, a missing step is null."""
    steps = [p for p in (path or "").split(".") if p and p != "$"]
    return F.try_variant_get(c(v), "$" + "".join(f".{s}" if s.isidentifier() else f"['{s}']" for s in steps), type_)


def first_named(record, names) -> Column:
    """First non-blank value among exact names, in the given order, as text."""
    return F.coalesce(*[F.when(~is_blank_value(get(record, n)), as_text(get(record, n))) for n in names])


def first_text(record, names) -> Column:
    """First non-blank string among exact names, trimmed."""
    return F.coalesce(*[only_text(get(record, n)) for n in names])


def resolve(v, names) -> Column:
    """Dotted paths first, then flat keys, then one nested level by leaf name."""
    record = as_record(v)
    dotted = [F.when(~is_blank_value(path_get(v, n)), path_get(v, n, "string")) for n in names if "." in n]
    flat = [F.when(~is_blank_value(get(record, n)), as_text(get(record, n))) for n in names if "." not in n]
    leaves = words([n.split(".")[-1] for n in names])
    inner = F.transform(
        F.array_sort(F.map_keys(F.map_filter(record, lambda _, x: kind(x).startswith("OBJECT")))),
        lambda k: as_record(F.try_element_at(record, k)))
    nested = F.filter(
        F.flatten(F.transform(inner, lambda m: F.transform(
            leaves, lambda n: F.when(~is_blank_value(F.try_element_at(m, n)), as_text(F.try_element_at(m, n)))))),
        lambda x: x.isNotNull())
    return F.coalesce(*dotted, *flat, F.get(nested, F.lit(0)))


def _pick_named(entries, names) -> Column:
    """Best (field, value) among array<struct<base,at,key,value>>: lowest base, then exact spelling in alias
    order, then spelling without case."""
    exact, folded = words(names), words([n.lower() for n in names])

    def candidate(e):
        position = F.array_position(exact, e["key"])
        rank = F.when(position > 0, position).otherwise(F.array_position(folded, F.lower(e["key"])) + 1000)
        return F.struct((e["base"] + rank).alias("rank"), e["at"].alias("field"), string_value(e["value"]).alias("value"))

    named = F.filter(entries, lambda e: F.array_contains(folded, F.lower(e["key"])))
    found = F.filter(F.transform(named, candidate), lambda s: s["value"].isNotNull())
    return let(F.array_min(found), lambda best: F.struct(best["field"].alias("field"), best["value"].alias("value")))


def pick_jd_field(record, names) -> Column:
    """struct(field, value): exact spelling in alias order first, then spelling without case."""
    return _pick_named(F.transform(F.map_entries(c(record)), lambda e: F.struct(
        F.lit(0).alias("base"), e["key"].alias("at"), e["key"].alias("key"), e["value"].alias("value"))), names)


def pick_wrapped_field(record, wrappers, names) -> Column:
    """The same one level down, inside well-known wrapper objects, the first wrapper first."""
    members = F.flatten(F.transform(words(wrappers), lambda w, i: F.transform(
        F.coalesce(F.map_entries(as_record(F.try_element_at(c(record), w))), F.expr("cast(array() as array<struct<key:string,value:variant>>)")),
        lambda e: F.struct((i * 10000).alias("base"), F.concat(w, F.lit("."), e["key"]).alias("at"), e["key"].alias("key"), e["value"].alias("value")))))
    return _pick_named(members, names)


def deep_pick(v, role: str, depth: int = 3, blank: bool = False) -> Column:
    """struct(path, value): breadth-first, nearest level first; strings, ``*name`` keys and short keys win.

    An empty text or array is passed over, or with ``blank`` taken as the value it is."""
    missing = (lambda x: as_text(x).isNull()) if blank else is_blank_value

    def best(record):
        def rank(e):
            name = canonical(e["key"])
            return F.when(
                matches_role(e["key"], role) & ~missing(e["value"]),
                F.struct((~is_text(e["value"])).alias("a"), (~name.endswith("name")).alias("b"),
                         F.length(name).alias("n"), e["key"].alias("path"), as_text(e["value"]).alias("value")))
        return F.array_min(F.transform(F.map_entries(record), rank))

    level = F.array(F.struct(F.lit("").alias("p"), as_record(v).alias("m")))
    hits = []
    for _ in range(depth + 1):
        hits.append(F.filter(F.transform(level, lambda n: let(best(n["m"]), lambda b: F.struct(
            F.concat(n["p"], b["path"]).alias("path"), b["value"].alias("value")))),
            lambda s: s["path"].isNotNull()))
        level = F.flatten(F.transform(level, lambda n: F.transform(
            F.filter(F.array_sort(F.map_keys(F.coalesce(n["m"], F.expr(f"cast(map() as {RECORD})")))),
                     lambda k: kind(F.try_element_at(n["m"], k)).startswith("OBJECT")),
            lambda k: F.struct(F.concat(n["p"], k, F.lit(".")).alias("p"),
                               as_record(F.try_element_at(n["m"], k)).alias("m")))))
    return F.coalesce(*[F.get(h, F.lit(0)) for h in hits])


def keys_within(v, depth: int = 3, limit: int | None = None) -> Column:
    """Lower-case keys of an object and of its nested objects, distinct and sorted."""
    level = F.array(as_record(v))
    found = []
    for _ in range(depth + 1):
        found.append(F.flatten(F.transform(level, lambda m: F.map_keys(F.coalesce(m, F.expr(f"cast(map() as {RECORD})"))))))
        level = F.filter(F.flatten(F.transform(level, lambda m: F.transform(
            F.map_values(F.coalesce(m, F.expr(f"cast(map() as {RECORD})"))), as_record))), lambda m: m.isNotNull())
    return F.array_sort(F.array_distinct(F.transform(F.flatten(F.array(*found)), F.lower)))


def flat_entries(v, depth: int, keep: str = "leaf") -> Column:
    """array<struct<path,depth,kind,value>> of nested members; arrays are leaves.

    ``keep='leaf'`` drops the objects themselves, ``keep='all'`` lists them too."""
    level = F.array(F.struct(F.lit("").alias("p"), as_record(v).alias("m")))
    found = []
    for d in range(depth + 1):
        members = F.flatten(F.transform(level, lambda n: F.transform(
            F.array_sort(F.map_keys(F.coalesce(n["m"], F.expr(f"cast(map() as {RECORD})")))),
            lambda k: F.struct(F.concat(n["p"], k).alias("path"), F.lit(d).alias("depth"),
                               kind(F.try_element_at(n["m"], k)).alias("kind"),
                               F.try_element_at(n["m"], k).alias("value")))))
        found.append(members if keep == "all" else F.filter(members, lambda s: ~s["kind"].startswith("OBJECT")))
        level = F.transform(F.filter(members, lambda s: s["kind"].startswith("OBJECT")), lambda s: F.struct(
            F.concat(s["path"], F.lit(".")).alias("p"), as_record(s["value"]).alias("m")))
    return F.flatten(F.array(*found))


def arrays_in(v, depth: int = 4) -> Column:
    """array<struct<path,n,items>> of every array reached through objects only, items whole."""
    root = F.when(as_array(v).isNotNull(), F.array(F.struct(
        F.lit("$").alias("path"), F.size(as_array(v)).alias("n"), as_array(v).alias("items"))))
    inner = F.transform(
        F.filter(flat_entries(v, depth - 1), lambda s: s["kind"].startswith("ARRAY")),
        lambda s: F.struct(s["path"].alias("path"), F.size(as_array(s["value"])).alias("n"),
                           as_array(s["value"]).alias("items")))
    return F.coalesce(root, inner)


def find_total(v, list_length, depth: int = 4) -> Column:
    """struct(path, total): explicit total names before ``count``; never below the list it counts."""
    number = lambda s: F.when(
        s["kind"].isin("BIGINT") | (s["kind"].startswith("DECIMAL") & as_text(s["value"]).rlike(r"^-?\d+(\.0+)?$"))
        | ((s["kind"] == "STRING") & strip(as_text(s["value"])).rlike(r"^\d+$")),
        strip(as_text(s["value"])).try_cast("double").cast("bigint"))
    leaf = lambda s: F.lower(F.element_at(F.split(s["path"], r"\."), -1))
    tier = lambda s: F.when(leaf(s).isin(V.TOTAL_TIER1), 1).when(leaf(s).isin(V.TOTAL_TIER2), 2)
    rows = F.transform(flat_entries(v, depth), lambda s: F.struct(
        tier(s).alias("tier"), s["path"].alias("path"), number(s).alias("total")))
    good = F.filter(rows, lambda s: s["tier"].isNotNull() & s["total"].isNotNull()
                    & ~((c(list_length) > 0) & (s["total"] < c(list_length))))
    return let(F.array_min(good), lambda best: F.struct(best["path"].alias("path"), best["total"].alias("total")))


def json_keys(v) -> Column:
    """Every object key of a payload, at any depth and inside arrays: the strings of its text that a colon follows."""
    strings = F.regexp_extract_all(F.to_json(c(v)), F.lit(r'"(?:[^"\\]|\\.)*+":?'), F.lit(0))
    return F.transform(F.filter(strings, lambda s: s.endswith(":")), lambda s: F.substring(s, F.lit(2), F.length(s) - 3))


def contains_secret(v) -> Column:
    """Does any key, at any depth, look like a secret?"""
    from .redact import is_sensitive

    return F.coalesce(F.exists(json_keys(v), is_sensitive), F.lit(False))


def safe_business_data(v) -> Column:
    """A payload without anything under a secret key; only payloads that hold one are rewritten."""
    from .redact import without_secrets

    found = contains_secret(v)
    return F.when(found, parse(without_secrets(F.when(found, F.to_json(c(v)))))).otherwise(c(v))


def fingerprint(v, size: int = 16) -> Column:
    """Digest of a record without its secrets; equal records give equal digests whatever their key order."""
    return F.substring(F.sha2(F.to_json(safe_business_data(v)), 256), 1, size)


def stable_id(v, keys=V.CAPTURE_ID_ALIASES) -> Column:
    """struct(field, value): aliases in order by canonical name, else the first non-empty ``*code`` key."""
    record = as_record(v)
    order = words(keys)

    def rank(e):
        name = canonical(e["key"])
        position = F.array_position(order, name)
        return F.when(~is_blank_value(e["value"]), F.when(position > 0, F.struct(
            position.alias("r"), e["key"].alias("field"), as_text(e["value"]).alias("value"))).when(
            name.endswith("code"), F.struct(F.lit(1000).cast("bigint").alias("r"), e["key"].alias("field"),
                                            as_text(e["value"]).alias("value"))))

    return let(F.array_min(F.transform(F.map_entries(record), rank)),
               lambda best: F.struct(best["field"].alias("field"), best["value"].alias("value")))


def real_urls(v, base, depth: int = 3) -> Column:
    """Absolute addresses held by a record, preferred names first at each level, distinct."""
    from . import urls as U

    leaf = lambda s: F.element_at(F.split(s["path"], r"\."), -1)
    named = F.filter(flat_entries(v, depth), lambda s: leaf(s).isin(V.REAL_URL_FIELDS)
                     & (s["kind"] == "STRING") & (strip(as_text(s["value"])) != ""))
    urls = F.transform(named, lambda s: F.struct(s["depth"].alias("d"), s["path"].alias("p"),
                                                 U.resolve(base, as_text(s["value"])).alias("url")))
    good = F.filter(F.array_sort(urls), lambda s: U.scheme(s["url"]).isin("http", "https")
                    & (U.netloc(s["url"]) != "") & (s["url"] != c(base)))
    return F.array_distinct(F.transform(good, lambda s: s["url"]))


# --- small normalisers ---------------------------------------------------------------------------

def headcount(v) -> Column:
    """An integer, or up to four digits with an optional counter word; anything else is unknown."""
    digits = F.regexp_extract(as_text(v), r"^\s*(\d{1,4})\s*(?:人|名|个)?\s*$", 1)
    return F.when(is_integer(v), F.try_variant_get(c(v), "$", "bigint")).when(
        is_text(v) & (digits != ""), digits.try_cast("bigint"))


def positive_headcount(v) -> Column:
    number = F.when(is_integer(v), F.try_variant_get(c(v), "$", "bigint")).when(
        is_text(v) & strip(as_text(v)).rlike(r"^\d+$"), strip(as_text(v)).try_cast("bigint"))
    return F.when(number > 0, number)


def readable_list(v) -> Column:
    """Scalar or list to distinct trimmed strings."""
    items = F.coalesce(as_array(v), F.array(c(v)))
    return F.array_distinct(F.filter(F.transform(items, only_text), lambda x: x.isNotNull()))


def locations(record) -> Column:
    """Names of listed workplaces, else the first single workplace text."""
    places = as_array(get(record, "workPlaceList"))
    member = lambda p: F.coalesce(only_text(p), *[only_text(F.try_variant_get(p, f"$.{k}", "variant"))
                                                  for k in V.WORKPLACE_ITEM_KEYS])
    listed = F.array_distinct(F.filter(F.transform(places, member), lambda x: x.isNotNull()))
    single = first_text(record, V.WORKPLACE_KEYS)
    fallback = F.when(single.isNotNull(), F.array(single)).otherwise(F.expr(NO_STRINGS))
    return F.when(F.size(F.coalesce(listed, F.expr(NO_STRINGS))) > 0, listed).otherwise(fallback)


def district_locations(record) -> Column:
    rows = as_array(get(record, "district_list"))
    member = lambda p: F.coalesce(only_text(F.try_variant_get(p, "$.area_cn", "variant")),
                                  only_text(F.try_variant_get(p, "$.address", "variant")))
    return F.coalesce(F.array_distinct(F.filter(F.transform(rows, member), lambda x: x.isNotNull())),
                      F.expr(NO_STRINGS))


def raw_company(record) -> Column:
    info = get(record, "company_info")
    inside = F.coalesce(*[only_text(F.try_variant_get(info, f"$.{k}", "variant")) for k in ("show_name", "name")])
    return F.coalesce(only_text(get(record, "company_name")), inside)


def standard_field(record, field: str) -> Column:
    """One standard field by its alias list; headcount parses, the others take the first non-blank text."""
    names = V.STANDARD_FIELDS[field]
    if field == "headcount":
        return F.coalesce(*[headcount(get(record, n)) for n in names])
    return first_text(record, names)


def overlay(list_record, detail_record) -> Column:
    """Detail wins key by key, an explicit null included."""
    empty = F.expr(f"cast(map() as {RECORD})")
    return F.map_concat(F.coalesce(c(list_record), empty), F.coalesce(c(detail_record), empty))


def publish_date(text) -> Column:
    """Publish text, without the year-one placeholder."""
    value = blank_to_null(text)
    return F.when(~value.startswith("0001-"), value)


def epoch_millis_to_iso(ms) -> Column:
    return F.date_format(F.timestamp_millis(c(ms)), "yyyy-MM-dd'T'HH:mm:ss+00:00")


def i18n(v) -> Column:
    """Readable label of a plain or translated value."""
    def label(x):
        members = F.array(*[F.try_variant_get(x, f"$.{k}", "variant") for k in V.I18N_KEYS])
        texts = F.filter(members, lambda m: is_text(m) & (as_text(m) != ""))
        return F.when(is_text(x), as_text(x)).otherwise(as_text(F.get(texts, F.lit(0))))

    return let(c(v), label)


def alias_field(record, name: str) -> Column:
    """First non-blank alias value as a variant."""
    values = F.transform(words(V.ALIAS_FIELDS[name]), lambda n: F.try_element_at(c(record), n))
    return F.get(F.filter(values, lambda v: ~is_blank_value(v)), F.lit(0))


def decode_envelope(payload, iv, payload_field: str = "data", key_field: str = "key") -> Column:
    """Open an AES-CBC envelope: the external IV is put before the ciphertext; garbage gives null."""
    cipher = F.try_to_binary(F.try_variant_get(c(payload), f"$.{payload_field}", "string"), F.lit("base64"))
    key = F.try_variant_get(c(payload), f"$.{key_field}", "string")
    plain = F.try_aes_decrypt(F.concat(F.encode(c(iv), "UTF-8"), cipher), F.encode(key, "UTF-8"),
                              F.lit("CBC"), F.lit("PKCS"))
    opened = F.try_parse_json(F.decode(plain, "UTF-8"))
    return F.when(as_record(opened).isNotNull(), opened)
