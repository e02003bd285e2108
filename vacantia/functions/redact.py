"""Redaction expressions: secret keys, secret values, safe addresses, safe errors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from .. import vocab as V
from .text import c, contains_any

_WORDS = "|".join(V.SECRET_WORDS)
SENSITIVE = rf"^(?:{_WORDS})$|^(?:{_WORDS})_|_(?:{_WORDS})$"


def is_sensitive(key) -> Column:
    """A secret word as the whole key or as its first or last ``_``/``-`` part (camelCase is not split)."""
    return F.replace(F.lower(c(key)), F.lit("-"), F.lit("_")).rlike(SENSITIVE)


def is_secret_record_key(key) -> Column:
    """The stricter rule for whole captured records."""
    return is_sensitive(key) | c(key).rlike(V.SECRET_KEY_EXTRA)


def is_ephemeral(key) -> Column:
    return contains_any(F.regexp_replace(F.lower(c(key)), "[-_]", ""), V.EPHEMERAL_MARKERS)


def mask_secrets(text) -> Column:
    return F.regexp_replace(c(text), V.SECRET_IN_TEXT, "$1=[REDACTED]")


def _walker(mask: str | None):
    """UDF over JSON texts: members under a secret key are masked, or dropped where there is no mask.

    Built inside a function, so executors receive the code itself and need no copy of this package."""
    pattern = SENSITIVE

    def walk(texts):
        import json
        import re

        import pandas as pd

        secret = re.compile(pattern)

        def clean(value):
            if isinstance(value, list):
                return [clean(x) for x in value]
            if not isinstance(value, dict):
                return value
            hidden = {k for k in value if secret.search(k.lower().replace("-", "_"))}
            return {k: mask if k in hidden else clean(x) for k, x in value.items() if k not in hidden or mask is not None}

        return pd.Series([None if t is None else json.dumps(clean(json.loads(t)), ensure_ascii=False) for t in texts])

    return F.pandas_udf(walk, StringType())


def without_secrets(json_text) -> Column:
    """JSON text without members under secret keys, at any depth and inside arrays; null stays null."""
    return _walker(None)(c(json_text))


def drop_sensitive(record) -> Column:
    """A record (map<string,variant>) without secrets at any depth."""
    from . import records as R

    return R.as_record(R.safe_business_data(F.to_variant_object(c(record))))


def redact_record(record) -> Column:
    """Text of every member of a record, secrets at any depth masked; only records that hold one are rewritten."""
    from . import records as R

    whole = F.to_variant_object(c(record))
    found = R.contains_secret(whole)
    masked = R.parse(_walker("[REDACTED]")(F.when(found, F.to_json(whole))))
    return F.transform_values(R.as_record(F.when(found, masked).otherwise(whole)), lambda _, v: R.as_text(v))


def request_shape(record) -> Column:
    """Key to type name of a request object, secrets redacted; input is map<string,variant>."""
    def name(v):
        t = F.schema_of_variant(v)
        return (F.when(v.isNull() | F.is_variant_null(v), F.lit("null")).when(t == "BOOLEAN", F.lit("bool"))
                .when(t == "BIGINT", F.lit("int")).when(t.startswith("DECIMAL") | (t == "DOUBLE"), F.lit("float"))
                .when(t == "STRING", F.lit("string")).when(t.startswith("ARRAY"), F.lit("array"))
                .when(t.startswith("OBJECT"), F.lit("object")))
    return F.transform_values(c(record), lambda k, v: F.when(is_sensitive(k), F.lit("[REDACTED]")).otherwise(name(v)))


def safe_url(url) -> Column:
    """struct(url without query, redacted query text); short-lived trace parameters are dropped."""
    from . import urls as U

    kept = F.filter(U.pairs(U.query(url)), lambda s: ~is_ephemeral(s["k"]))
    shown = F.transform(kept, lambda s: F.concat(
        s["k"], F.lit("="), F.when(is_sensitive(s["k"]), F.lit("[REDACTED]")).otherwise(s["v"])))
    return F.struct(U.unsplit(U.scheme(url), U.netloc(url), U.path(url), F.lit(""), F.lit("")).alias("url"),
                    F.array_join(shown, "&").alias("query"))


def make_error(code, message, context) -> Column:
    """``CODE k=v ... reason=message`` with sorted, masked context; secret-looking keys are left out."""
    kept = F.array_sort(F.filter(F.map_entries(c(context)), lambda e: ~e["key"].rlike(V.CONTEXT_SECRET)))
    shown = F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), mask_secrets(e["value"])))
    return F.concat_ws(" ", c(code), F.when(
        F.size(shown) > 0, F.array_join(shown, " ")), F.concat(F.lit("reason="), mask_secrets(message)))


def parse_error(text) -> Column:
    """struct(code, context, reason) of an error line."""
    text = c(text)
    head = F.split_part(text, F.lit(" reason="), F.lit(1))
    reason = F.regexp_replace(F.regexp_extract(text, "(?s) reason=(.*)$", 1), "^$", "")
    context = F.regexp_extract(head, "(?s)^[^ ]* (.*)$", 1)
    return F.struct(F.split_part(head, F.lit(" "), F.lit(1)).alias("code"), F.nullif(context, F.lit("")).alias("context"),
                    F.when(reason != "", reason).otherwise(head).alias("reason"))


def protected_signal(status, body) -> Column:
    low = F.lower(F.coalesce(c(body), F.lit("")))
    return F.coalesce(F.when(c(status).isin(401, 403), F.concat(F.lit("HTTP_"), c(status).cast("string"))),
                      *[F.when(low.contains(w), F.lit(w)) for w in V.PROTECTED_WORDS])


def is_blocked(text) -> Column:
    return contains_any(F.lower(c(text)), V.BLOCKED_WORDS)
