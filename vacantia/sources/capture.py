"""Readers of captured material: network recordings, pages, response bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType

from .. import vocab as V
from ..functions import records as R, urls as U
from ..functions.text import c


RECORDING = """log struct<entries: array<struct<
  request: struct<method: string, url: string, postData: struct<text: string>>,
  response: struct<status: int, content: struct<text: string, encoding: string>>>>>"""


def har_entries(df: DataFrame, text: str) -> DataFrame:
    """One row per ``log.entries[]`` of a recording's text, order kept.

    Only what the import needs is taken out, by schema: headers and cookies never leave the text, and neither the
    recording nor a body has a limit but that of a string.  A recording that is no such document gives one row
    with ``import_error`` and nothing else."""
    rest = [n for n in df.columns if n != text]
    parsed = F.from_json(c(text), RECORDING, {"maxStringLen": str(2 ** 31 - 1), "mode": "PERMISSIVE"})
    out = df.select(*rest, F.posexplode_outer(parsed["log"]["entries"]).alias("entry_index", "_e"), parsed["log"]["entries"].isNull().alias("_bad"))
    at = lambda p: F.col(f"_e.{p}")
    whole = out.filter(F.col("_bad") | F.col("entry_index").isNotNull())
    return whole.select(
        *rest, F.col("entry_index").cast("bigint").alias("entry_index"), at("request.method").alias("method"), at("request.url").alias("url"),
        at("request.postData.text").alias("body_text"), at("response.status").alias("status"),
        at("response.content.text").alias("content_text"), at("response.content.encoding").alias("content_encoding"),
        F.when(F.col("_bad"), "HAR_FILE_INVALID").alias("import_error"))


def read_har(spark: SparkSession, path: str) -> DataFrame:
    """Network recordings under a path; a recording is read whole, recordings are read in parallel."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("run_id"), F.col("value").alias("_text"))
    return har_entries(files, "_text")


def decode_body(df: DataFrame, text: str, encoding: str) -> DataFrame:
    """Adds payload (variant) and decode_error of a response body, plain or base64."""
    raw = F.try_to_binary(c(text), F.lit("base64"))
    plain = F.when(c(encoding) == "base64", F.decode(F.make_valid_utf8(raw.cast("string")).cast("binary"), "UTF-8")).otherwise(c(text))
    payload = R.parse_strict(plain)
    missing = F.coalesce(c(text), F.lit("")) == ""
    error = (F.when(missing, "HAR_RESPONSE_BODY_MISSING").when((c(encoding) == "base64") & raw.isNull(), "HAR_RESPONSE_BODY_ENCODING_ERROR")
             .when(payload.isNull(), "HAR_RESPONSE_JSON_INVALID"))
    return df.withColumns({"payload": F.when(error.isNull(), payload), "decode_error": error})


def exchange_params(df: DataFrame, url: str, body: str) -> DataFrame:
    """Adds params, page, page_size of a request."""
    df = df.withColumn("params", U.request_params(url, body))
    return df.withColumn("_p", U.page_params("params")).withColumns({"page": F.col("_p.page"), "page_size": F.col("_p.size")}).drop("_p")


def _other_decoder():
    """UDF for bytes the JVM cannot decode: declared charset first, then GB18030.

    Built inside a function, so executors receive the code itself and need no copy of this package."""

    def decode(content, charset):
        import pandas as pd

        def one(data, declared):
            if data is None:
                return None
            for name in (declared, "utf-8-sig", "gb18030"):
                try:
                    return bytes(data).decode(name)
                except (UnicodeDecodeError, LookupError):
                    continue
            return None

        return pd.Series([one(d, n) for d, n in zip(content, charset)])

    return F.pandas_udf(decode, StringType())


def decode_charset(content, content_type) -> Column:
    """Text of response bytes: declared charset, UTF-8 (without its mark), GB18030; null when none fits.

    Valid UTF-8 stays in the JVM; only the remaining bytes travel to Python, in Arrow batches."""
    declared = F.lower(F.regexp_extract(c(content_type), r"(?i)charset\s*=\s*([\w.-]+)", 1))
    ours = declared.isin("", "utf-8", "utf8", "utf-8-sig") & F.is_valid_utf8(c(content).cast("string"))
    other = _other_decoder()(F.when(~ours, c(content)), F.when(~ours, F.when(declared != "", declared).otherwise("utf-8")))
    return F.when(ours, F.regexp_replace(F.decode(c(content), "UTF-8"), "^﻿", "")).otherwise(other)


def safe_text(content) -> Column:
    """Text of raw bytes without encoded lone surrogates; everything else is kept.

    A lone surrogate shows as three bytes ED A0..BF xx, which valid UTF-8 never contains."""
    return F.when(F.is_valid_utf8(c(content).cast("string")), F.decode(c(content), "UTF-8")).otherwise(
        F.decode(F.unhex(_without_surrogates(c(content))), "UTF-8"))


def _without_surrogates(content) -> Column:
    """Hex text of the bytes, byte pairs kept together by a separator while surrogates are cut."""
    spaced = F.regexp_replace(F.hex(content), "(..)", "$1 ")
    return F.replace(F.regexp_replace(spaced, "ED [AB][0-9A-F] [89AB][0-9A-F] ", ""), F.lit(" "), F.lit(""))


def page_texts(df: DataFrame, content: str, content_type: str | None = None) -> DataFrame:
    """Adds html, the text of a page's bytes: charset of the header, else the one that a ``meta`` tag of the first kilobyte names,
    else UTF-8, else GB18030; null when none fits."""
    header = c(content_type) if content_type else F.lit(None).cast("string")
    start = F.decode(F.substring(c(content), 1, 1024), "ISO-8859-1")
    meta = F.regexp_extract(start, r"""(?i)<meta[\s/][^>]{0,512}?charset\s*=\s*["']?\s*([\w.:-]+)""", 1)
    stated = F.when(F.coalesce(header, F.lit("")).rlike(r"(?i)charset\s*="), header).when(meta != "", F.concat(F.lit("text/html; charset="), meta)).otherwise("text/html")
    return df.withColumn("html", decode_charset(content, stated))


def read_pages(spark: SparkSession, path: str, format_: str = "parquet") -> DataFrame:
    """Captured pages: a table (bytes in a column ``content`` become ``html``), or files of which each is one page."""
    pages = spark.read.format(format_).load(path)
    if format_ == "binaryFile":
        pages = pages.select(F.col("path").alias("url"), "content")
    if "content" not in pages.columns:
        return pages
    return page_texts(pages, "content", "content_type" if "content_type" in pages.columns else None).drop("content")


def _state_scanner(names):
    """UDF for the JSON state texts of raw markup: JSON scripts in document order, then the named globals."""
    known = "|".join(names)

    def scan(html):
        import json
        import re

        import pandas as pd

        script = re.compile(r"<script\b([^>]*)>(.*?)</script>", re.S | re.I)
        assign = re.compile(r"window\.(" + known + r")\s*=\s*([^{\[]{0,4096})\{")
        decoder = json.JSONDecoder()

        def one(markup):
            found = []
            for attributes, body in script.findall(markup or ""):
                low = attributes.lower()
                if "application/json" in low or "__next_data__" in low:
                    try:
                        found.append(json.dumps(json.loads(body.strip()), ensure_ascii=False))
                    except ValueError:
                        continue
            for match in assign.finditer(markup or ""):
                try:
                    value, _ = decoder.raw_decode(markup, match.end() - 1)
                    found.append(json.dumps(value, ensure_ascii=False))
                except ValueError:
                    continue
            return found

        return pd.Series([one(m) for m in html])

    return F.pandas_udf(scan, ArrayType(StringType()))


def embedded_states(df: DataFrame, html: str) -> DataFrame:
    """One row per serialized state of a page: source_index and state (variant).

    Pages without any state marker are dropped in the JVM before the scan."""
    marked = df.filter(c(html).contains("window.__") | F.lower(c(html)).contains("application/json") | c(html).contains("__NEXT_DATA__"))
    rest = [n for n in df.columns if n != html]
    out = marked.select(*rest, _state_scanner(V.WINDOW_STATES)(c(html)).alias("_s")).select(*rest, F.posexplode("_s").alias("source_index", "_t"))
    return out.select(*rest, "source_index", R.parse("_t").alias("state"))
