"""Markup in one pass and linear time: tags, attributes and regions by possessive patterns that never go back.

A quote counts only as the start of an attribute's value; a comment, a script or a tag that never ends takes the rest of
the text.  So every character is read once, whatever the markup, and no pattern recurses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import c, let

# the inside of a tag up to its end, quoted values whole
REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
END = r"(?:>|\z)"
COMMENT = r"<!--(?s:.*?)(?:-->|\z)"
# one attribute: a name and, if it has one, its value; a quote without its partner is part of a bare value
VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
NAME_END = r"(?=[\s/>]|\z)"


def tag(names: str, close: bool = False) -> str:
    """Pattern of a whole tag of the given names (alternatives)."""
    return rf"(?i:<{'/' if close else ''}(?:{names})){NAME_END}{REST}{END}"


def region(names: str, capture: int) -> str:
    """Pattern of a tag and all up to its closing tag, the name in group ``capture``."""
    return rf"<((?i:{names})){NAME_END}{REST}{END}(?s:.*?)(?i:</\{capture}\s*+>|\z)"


def attribute(markup, name: str) -> Column:
    """Value of the first attribute of that name in the tag that the text starts with; null without one.

    Names count whole (``data-href`` is not ``href``), a value may stand in double quotes, single quotes or none."""
    other = rf"""(?:[\s/]++(?!{name}[\s=/>])[^\s/>=][^\s/>=]*+(?:\s*+=\s*+{VALUE})?+)*+"""
    found = F.regexp_extract(c(markup), rf"(?i)^<[^\s/>]++{other}[\s/]++{name}\s*+=\s*+({VALUE})", 1)
    bare = let(found, lambda v: F.when(F.length(v) < 2, v).when(
        (v.startswith('"') & v.endswith('"')) | (v.startswith("'") & v.endswith("'")), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v))
    return F.when(c(markup).rlike(rf"(?i)^<[^\s/>]++{other}[\s/]++{name}\s*+="), bare)


def anchors(html) -> Column:
    """Anchors with their text, in order; not those in comments and scripts, and none that another anchor or the page's end cuts off."""
    body = rf"(?:[^<]++|{COMMENT}|<(?!/?[aA]{NAME_END})(?:[/!?]?[A-Za-z]{REST})?+)*+"
    found = F.regexp_extract_all(c(html), F.lit(rf"{COMMENT}|{region('script|style', 1)}|{tag('a')}{body}(?i:</a\s*+>)?+"), F.lit(0))
    return F.filter(found, lambda x: F.lower(F.left(x, F.lit(2))).eqNullSafe("<a") & x.rlike(r"(?i)</a\s*+>\z"))


def anchor_head(anchor) -> Column:
    """The attributes of an anchor, as written."""
    return F.regexp_extract(c(anchor), f"(?i)^<a({REST})>", 1)


def anchor_body(anchor) -> Column:
    """What stands between an anchor and its end."""
    return F.regexp_replace(c(anchor), rf"(?i)^<a{REST}>|</a\s*+>\z", "")


def heads(html, names: str) -> Column:
    """Opening tags of the given names, outside of comments, in order; scripts and styles with their text."""
    found = F.regexp_extract_all(c(html), F.lit(rf"{COMMENT}|{region('script|style', 1)}|{tag(names)}"), F.lit(0))
    return F.filter(found, lambda x: x.rlike(rf"(?i)^<(?:{names}){NAME_END}"))


def without_raw_text(html) -> Column:
    """Markup without comments and without the text of scripts and styles, whose opening tags stay."""
    raw = rf"(<((?i:script|style)){NAME_END}{REST}{END})(?s:.*?)(?i:</\2\s*+>|\z)"
    return F.regexp_replace(c(html), f"{raw}|{COMMENT}", "$1")


def without_tags(html, by: str = "") -> Column:
    """Text with every tag replaced; a lone angle bracket that starts no tag stays."""
    return F.regexp_replace(c(html), rf"<(?=[/!?]?[A-Za-z]){REST}{END}", by)
