"""Snippets for the oracle SQL (DuckDB dialect)."""

from __future__ import annotations

from .. import vocab as V

SPACE = V.WHITESPACE
SPACES = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def names(values) -> str:
    return ", ".join(q(v) for v in values)


def strip(x: str) -> str:
    return f"trim({x}, {q(SPACE)})"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, {q(SPACES + '+')}, ' ', 'g')")


def no_space(x: str) -> str:
    return f"regexp_replace({x}, {q(SPACES + '+')}, '', 'g')"


def any_of(x: str, values) -> str:
    return "(" + " or ".join(f"contains({x}, {q(v)})" for v in values) + ")"


def hits(x: str, values) -> str:
    return "(" + " + ".join(f"contains({x}, {q(v)})::int" for v in values) + ")"


def canonical(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


_GENERIC = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def piece(x: str, group: int) -> str:
    return f"regexp_extract({x}, {q(_GENERIC)}, {group})"


def scheme(x: str) -> str:
    return f"lower({piece(x, 1)})"


def netloc(x: str) -> str:
    return piece(x, 2)


def path(x: str) -> str:
    return piece(x, 3)


def query(x: str) -> str:
    return piece(x, 4)


def fragment(x: str) -> str:
    return piece(x, 5)


def host(x: str) -> str:
    return f"regexp_replace(lower(regexp_replace({netloc(x)}, '^.*@', '')), ':[0-9]*$', '')"


def param(x: str, key: str) -> str:
    """First value of a query parameter, null when absent."""
    return f"nullif(regexp_extract('&' || {query(x)}, '&{key}=([^&]*)', 1), '')"


def matches_role(x: str, role: str) -> str:
    value = canonical(x)
    exact = {"id": ["id"], "title": ["title", "name"], "url": ["path"]}.get(role, [])
    terms = " or ".join(f"{value} like {q('%' + t)}" for t in V.ROLE_TERMS[role])
    return f"({terms}" + (f" or {value} in ({names(exact)}))" if exact else ")")


def credible_body(x: str) -> str:
    hit = (f"({any_of(f'lower({x})', V.BODY_RESPONSIBILITY)}::int + {any_of(f'lower({x})', V.BODY_REQUIREMENT)}::int)")
    return f"(length({x}) >= 500 or {hit} >= 2 or (length({x}) >= 160 and {hit} >= 1))"


def credible_jd(x: str) -> str:
    s = squeeze(x)
    return (f"(length({s}) >= 160 and ({hits(f'lower({s})', V.JD_SIGNALS)} > {hits(f'lower({s})', V.JD_PENALTIES)} "
            f"or length({s}) >= 500))")
