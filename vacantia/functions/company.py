"""Company expressions: who is hiring, from hosts, titles and page metadata."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import vocab as V
from . import urls as U
from .text import c, contains_any, ends_with_any, let, squeeze, strip

_TRIM = "^(.+?)(?:" + "|".join(w for w in V.INFRA_LABELS if len(w) >= 3) + ")$"


def clean_token(token) -> Column:
    """Brand label of one host label: a trailing infrastructure word is cut, bare infrastructure is nothing."""
    return let(F.regexp_replace(c(token), _TRIM, "$1"), lambda t: F.when(
        (F.length(t) >= 2) & ~t.isin(V.INFRA_LABELS) & ~t.rlike(r"^\d+$"), t))


def display_name(token, registry=None) -> Column:
    """Verified name of a brand token, else the token with a capital first letter."""
    known = F.create_map(*[F.lit(x) for pair in (registry or V.KNOWN_COMPANIES).items() for x in pair])
    return let(token, lambda t: F.coalesce(F.try_element_at(known, t), F.concat(
        F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))))


def infer_site_company(source) -> Column:
    """Company label of a site from its host; null for reserved, opaque or bare platform hosts."""
    platforms = V.RECRUIT_PLATFORMS + list(V.PROVIDER_HOSTS.values())
    bare = [s.lstrip(".") for s in V.PROVIDER_HOSTS.values()]

    def from_labels(h, labels):
        n = F.size(labels)
        keep = F.when(F.concat_ws(".", F.get(labels, n - 2), F.get(labels, n - 1)).isin(V.MULTIPART_TLDS), 3).otherwise(2)
        sub = F.slice(labels, F.lit(1), F.greatest(n - keep, F.lit(0)))
        return let(F.struct(h.alias("h"), sub.alias("sub"), F.get(labels, F.greatest(n - keep, F.lit(0))).alias("root")), from_parts)

    def from_parts(p):
        h, sub, root = p["h"], p["sub"], p["root"]
        tenant = F.get(F.filter(F.transform(F.reverse(sub), clean_token), lambda t: t.isNotNull()), F.lit(0))
        own = F.get(F.filter(F.reverse(F.concat(sub, F.array(root))), lambda t: ~t.isin(V.INFRA_LABELS)), F.lit(0))
        return (F.when(~h.contains("."), None).when(root.isin(V.RESERVED_ROOTS), None)
                .when(ends_with_any(h, platforms) | h.isin(bare), tenant).when(root.startswith("example"), None)
                .otherwise(clean_token(own)))

    return display_name(let(U.host_of(source), lambda h: let(F.split(h, r"\."), lambda labels: from_labels(h, labels))))


def company_or_none(value) -> Column:
    cleaned = F.btrim(F.regexp_replace(c(value), V.WS + "+", " "), F.lit(" -|–—"))
    return F.when(~F.lower(cleaned).isin(V.GENERIC_COMPANY), F.nullif(cleaned, F.lit("")))


def title_brand(title) -> Column:
    value = strip(title)
    bare = F.btrim(F.regexp_replace(value, V.TITLE_TAIL, ""), F.lit(" -|–—·"))
    return F.when((value != "") & ~value.rlike(V.TITLE_SEPARATOR) & (bare != "") & (F.length(bare) <= 30)
                  & ~bare.rlike(V.TITLE_NOISE) & ~F.lower(bare).isin(V.GENERIC_BRANDS), bare)


def company_from_title(title) -> Column:
    value = strip(title)
    bare = F.regexp_replace(F.regexp_replace(value, V.TITLE_COMPANY_HEAD, ""), V.TITLE_COMPANY_TAIL, "")
    bare = F.btrim(bare, F.lit(" -|–—·"))
    return F.when((value != "") & ~value.rlike(V.TITLE_SEPARATOR) & (bare != "") & (F.length(bare) <= 30)
                  & ~bare.rlike(V.TITLE_COMPANY_NOISE), company_or_none(bare))


def page_title(html) -> Column:
    from .text import unescape

    return squeeze(unescape(F.regexp_extract(c(html), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def _meta(html, attribute: str, name: str) -> Column:
    from .text import unescape

    forward = F.regexp_extract(c(html), rf'(?is)<meta\b[^>]*\b{attribute}="{name}"[^>]*\bcontent="([^"]*)"', 1)
    backward = F.regexp_extract(c(html), rf'(?is)<meta\b[^>]*\bcontent="([^"]*)"[^>]*\b{attribute}="{name}"', 1)
    return company_or_none(unescape(F.when(forward != "", forward).otherwise(backward)))


def page_company(html) -> Column:
    """Structured organisation first, then site metadata, then the title."""
    blocks = F.regexp_extract_all(c(html), F.lit(r'(?is)<script\b[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    name = lambda j, p: company_or_none(F.get_json_object(j, p))
    listed = F.filter(F.flatten(F.transform(blocks, lambda j: F.array(
        *[name(j, f"$.{k}.name") for k in ("hiringOrganization", "organization")],
        *[name(j, f"$[0].{k}.name") for k in ("hiringOrganization", "organization")]))), lambda x: x.isNotNull())
    title = page_title(html)
    parts = F.split(title, V.TITLE_SEPARATOR)
    tail = lambda x: company_or_none(F.regexp_replace(strip(x), r"(?i)\s+(?:jobs|careers)$", ""))
    by_part = F.when(F.size(parts) > 1, F.coalesce(tail(F.element_at(parts, -1)), tail(F.get(parts, F.lit(0)))))
    return F.coalesce(F.get(listed, F.lit(0)), _meta(html, "property", "og:site_name"),
                      _meta(html, "name", "application-name"), by_part, company_from_title(title))


def formal_company(company, url, registry=None) -> Column:
    """Folder name of a run: verified name by token, else a plain name, else ``_unknown``."""
    name, h = strip(F.coalesce(c(company), F.lit(""))), U.host(F.coalesce(c(url), F.lit("")))
    known = F.coalesce(*[F.when(F.lower(name).contains(k) | h.contains(k), F.lit(v))
                         for k, v in (registry or V.KNOWN_COMPANIES).items()])
    own = F.when((name != "") & ~name.contains("."), safe_name(name))
    return F.coalesce(known, own, F.lit("_unknown"))


def safe_name(name) -> Column:
    """One folder name: reserved characters become underscores, edge dots and blanks go."""
    cleaned = F.btrim(F.regexp_replace(c(name), V.UNSAFE_NAME, "_"), F.lit(" ."))
    return F.when(cleaned == "", "_unknown").otherwise(cleaned)


def run_stamp(ts) -> Column:
    return F.date_format(c(ts), "yyyy-MM-dd_HHmmss")


def output_name(url, ts) -> Column:
    """File name of a run: the host with runs of other characters as underscores, then the time."""
    h = F.btrim(F.regexp_replace(F.when(U.host(url) != "", U.host(url)).otherwise("jobs"), "[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.concat(F.when(h == "", "jobs").otherwise(h), F.lit("_"), F.date_format(c(ts), "yyyyMMdd_HHmmss"), F.lit(".json"))


def platform_brand(name) -> Column:
    latin = F.regexp_replace(F.lower(c(name)), "[^a-z0-9]", "")
    return contains_any(latin, V.PLATFORM_TOKENS)


def host_provider(url) -> Column:
    h = U.host(url)
    return F.coalesce(*[F.when(h.endswith(s) | (h == s.lstrip(".")), F.lit(p)) for p, s in V.PROVIDER_HOSTS.items()])
