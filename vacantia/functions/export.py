"""Export expressions: safe cells, lists, Markdown, labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import vocab as V
from .text import c, let


def is_formula(text) -> Column:
    """Does a text start like a formula?  Only its first character is read."""
    return F.substring(c(text), 1, 1).rlike(V.FORMULA_START)


def _quote_formula(x) -> Column:
    return let(x, lambda t: F.when(is_formula(t), F.concat(F.lit("'"), t)).otherwise(t))


def line_ends(text) -> Column:
    """Carriage returns, with or without a line feed, as line feeds; a text without any is not searched by pattern."""
    x = c(text)
    return F.when(x.contains("\r"), F.regexp_replace(x, "\r\n?", "\n")).otherwise(x)


def without_controls(text) -> Column:
    """A text without the control characters that no cell may hold."""
    return F.regexp_replace(c(text), V.ILLEGAL_CONTROL, "")


def cell_body(text) -> Column:
    """Control characters dropped and line ends normalised; no length cap yet."""
    return let(without_controls(text), line_ends)


def sanitize_cell(text, limit: int | None = None) -> Column:
    """Sheet cell: clean body, formula start quoted.  Only with a ``limit`` it is cut (before the quote) and ends with a marker."""
    cut = lambda body: F.when(F.length(body) > limit, F.concat(F.substring(body, 1, limit - len(V.CELL_MARKER)), F.lit(V.CELL_MARKER))).otherwise(body)
    return let(cell_body(text), lambda body: _quote_formula(cut(body) if limit else body))


def long_cell(text, limit: int | None = None) -> Column:
    """Sheet cell of a long value; with a ``limit`` it is cut and says where the whole text is."""
    x = F.coalesce(c(text), F.lit(""))
    if limit:
        cut = F.concat(F.substring(x, 1, limit - len(V.LONG_CELL_MARKER)), F.lit(V.LONG_CELL_MARKER))
        x = F.when(F.length(x) > limit, cut).otherwise(x)
    return sanitize_cell(x, limit)


def over_limit(*texts) -> Column:
    """Does any of the values exceed what a cell of a workbook file holds?"""
    return F.greatest(F.lit(0), *[F.coalesce(F.length(c(x)), F.lit(0)) for x in texts]) > V.CELL_LIMIT


def csv_cell(text) -> Column:
    """One visible line, formula start quoted, null as empty."""
    x = let(F.coalesce(c(text), F.lit("")), line_ends)
    return _quote_formula(F.replace(x, F.lit("\n"), F.lit(" ⏎ ")))


def csv_list(values) -> Column:
    return csv_cell(F.array_join(c(values), "\n"))


def numbered(values) -> Column:
    return F.array_join(F.transform(c(values), lambda v, i: F.concat((i + 1).cast("string"), F.lit(". "), v)), "\n")


def locations_text(values) -> Column:
    return F.array_join(F.filter(c(values), lambda v: v != ""), "；")


def _swap(text, old: str, new: str) -> Column:
    """Replace in the texts that hold it: to look for it first is cheaper than to replace nothing."""
    return let(text, lambda x: F.when(x.contains(old), F.replace(x, F.lit(old), F.lit(new))).otherwise(x))


def md_inline(text) -> Column:
    x = F.coalesce(c(text), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\\", "\\\\")):
        x = _swap(x, a, b)
    return _swap(F.regexp_replace(x, r"([|#*_`])", r"\\$1"), "\n", " ")


def row_completeness(full_jd, responsibilities, requirements) -> Column:
    return (F.when(F.coalesce(c(full_jd), F.lit("")) == "", "MISSING_JD")
            .when((F.size(c(responsibilities)) > 0) & (F.size(c(requirements)) > 0), "COMPLETE")
            .otherwise("STRUCTURE_PARTIAL"))


def scope_text(scope) -> Column:
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(c(scope))),
                                     lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return F.when(shown == "", "Unknown").otherwise(shown)


def translate_reason(error) -> Column:
    """Readable reason of an error line; an unknown code shows itself."""
    error = c(error)
    code = F.upper(F.substring_index(F.substring_index(F.trim(error), " ", 1), ":", 1))
    table = V.ERROR_REASONS
    known = F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in table.items()])
    return (F.when(code == "", F.when(error == "", "抓取失败").otherwise(error)).when(known.isNotNull(), known)
            .when(code.contains("TIMEOUT"), table["TIMEOUT"])
            .when(code.contains("CONNECTION") | code.contains("NETWORK"), table["CONNECTION_ERROR"])
            .when(code.contains("HTTP_5"), table["HTTP_5XX"]).when(code.startswith("HTTP_"), error)
            .when(code.contains("PARSE") | code.contains("JSON"), table["PARSING_ERROR"])
            .when(code.contains("NOT_FOUND"), table["DETAIL_NOT_FOUND"]).otherwise(error))
