"""Text expressions: trimming, squeezing, field-name roles, lines, HTML to lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .. import vocab as V


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value, body) -> Column:
    """Bind a value once for an expression that uses it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(x) -> Column:
    return F.btrim(c(x), F.lit(V.WHITESPACE))


def blank_to_null(x) -> Column:
    """Trimmed text, or null when nothing is left: empty and null both mean missing."""
    return F.nullif(strip(x), F.lit(""))


def squeeze(x) -> Column:
    """Runs of whitespace become one blank, ends are trimmed."""
    return strip(F.regexp_replace(c(x), V.WS + "+", " "))


def without_space(x) -> Column:
    return F.regexp_replace(c(x), V.WS + "+", "")


def words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def contains_any(x, terms) -> Column:
    x = c(x)
    return reduce(lambda a, b: a | b, [x.contains(t) for t in terms])


def hits(x, terms) -> Column:
    """How many of the terms occur in the text."""
    x = c(x)
    return reduce(lambda a, b: a + b, [F.when(x.contains(t), 1).otherwise(0) for t in terms])


def ends_with_any(x, terms) -> Column:
    x = c(x)
    return reduce(lambda a, b: a | b, [x.endswith(t) for t in terms])


def canonical(x) -> Column:
    return F.regexp_replace(F.lower(c(x)), "[^a-z0-9]", "")


def matches_role(name, role: str) -> Column:
    """Does a field name play the role?  Vocabulary terms match as suffixes of the canonical name."""
    value = canonical(name)
    exact = {"id": ["id"], "title": ["title", "name"], "url": ["path"]}.get(role, [])
    suffix = ends_with_any(value, V.ROLE_TERMS[role])
    return value.isin(exact) | suffix if exact else suffix


def infer_field(keys, role: str) -> Column:
    """Field of a key set that plays the role: exact names, vocabulary order, then shortest suffix match."""
    head = {"id": ["id"], "title": ["title", "name"]}.get(role, [])
    order = words(head + V.ROLE_TERMS[role])

    def rank(key, pos):
        name = canonical(key)
        exact = F.array_position(order, name)
        return F.when(
            exact > 0,
            F.struct(exact.cast("int").alias("r"), F.lit(0).alias("l"), F.lit("").alias("n"),
                     (-pos).alias("p"), key.alias("k")),
        ).when(
            matches_role(key, role),
            F.struct(F.lit(1000).alias("r"), F.length(name).alias("l"), name.alias("n"),
                     pos.alias("p"), key.alias("k")),
        )

    return F.array_min(F.transform(c(keys), rank))["k"]


def lines(x) -> Column:
    """Non-blank trimmed lines in order."""
    parts = F.split(F.replace(c(x), F.lit("\r"), F.lit("")), "\n")
    return F.filter(F.transform(parts, strip), lambda v: v != "")


def separated_lines(x) -> Column:
    """Lines that also break at semicolons."""
    return F.filter(F.transform(F.split(c(x), "[\n;；]+"), strip), lambda v: v != "")


def _character(code) -> Column:
    """The character of a code point; none for those that no text may hold."""
    good = ((c(code) > 0) & (c(code) < 0xD800)) | ((c(code) > 0xDFFF) & (c(code) < 0x110000))
    return F.when(good, F.decode(F.unhex(F.lpad(F.hex(c(code)), 8, "0")), "UTF-32"))


def _reference(name) -> Column:
    """Text of a character reference (without ampersand and semicolon); null for an unknown name."""
    name = c(name)
    number = F.when(name.rlike("^#[0-9]{1,7}$"), F.substring(name, F.lit(2), F.length(name)).cast("bigint")).when(
        name.rlike("^#[xX][0-9A-Fa-f]{1,6}$"), F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10).cast("bigint"))
    named = F.create_map(*[F.lit(x) for pair in V.ENTITIES.items() for x in pair])
    return F.when(name.startswith("#"), _character(number)).otherwise(F.try_element_at(named, name))


def unescape(x) -> Column:
    """Character references in text, numbered and named, each decoded once; an unknown one stays as it is."""
    x = c(x)
    pattern = "&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,15});"
    found = F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
    decoded = F.transform(found, lambda r: F.coalesce(_reference(F.substring(r, F.lit(2), F.length(r) - 2)), r))
    joined = F.array_join(F.zip_with(F.split(x, pattern, -1), decoded, lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")
    return F.when(x.contains("&") & x.rlike(pattern), joined).otherwise(x)


SKIPPED_TAGS = ["script", "style", "noscript", "svg", "header", "footer", "nav"]
BLOCK_TAGS = ["br", "p", "div", "li", "section", "article", "h1", "h2", "h3", "h4", "h5"]
_BREAK = "\x01"


def html_lines(html) -> Column:
    """Visible text lines of a page: skipped regions dropped, block tags break lines, entities decoded.

    A skipped region ends with its closing tag, or with the page."""
    from . import markup as M

    x = F.regexp_replace(M.without_raw_text(html), M.region("|".join(SKIPPED_TAGS[2:]), 1), _BREAK)
    x = F.regexp_replace(x, V.WS + "+", " ")
    breaks = rf"(?i:</?(?:{'|'.join(BLOCK_TAGS + SKIPPED_TAGS)})){M.NAME_END}{M.REST}{M.END}"
    x = M.without_tags(F.regexp_replace(x, breaks, _BREAK))
    return F.filter(F.transform(F.split(x, _BREAK), lambda v: strip(unescape(v))), lambda v: v != "")


def plain(html) -> Column:
    """Tags to blanks, entities decoded, whitespace squeezed."""
    return squeeze(unescape(F.regexp_replace(c(html), "<[^>]+>", " ")))


def heading(line) -> Column:
    """A line as a heading: trailing colons dropped, lower case."""
    return F.lower(strip(F.regexp_replace(c(line), r"[\s:：]+$", "")))


def distinct_ordered(values) -> Column:
    return F.array_distinct(c(values))


def bounded_sample(values, n: int) -> Column:
    return F.slice(c(values), 1, n)


