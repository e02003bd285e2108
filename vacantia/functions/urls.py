"""URL expressions.  Pieces are cut with the generic-syntax pattern, so any text is accepted."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import vocab as V
from .text import c, contains_any, strip, words

GENERIC = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def _piece(url, group: int) -> Column:
    return F.regexp_extract(c(url), GENERIC, group)


def scheme(url) -> Column:
    return F.lower(_piece(url, 1))


def netloc(url) -> Column:
    return _piece(url, 2)


def path(url) -> Column:
    return _piece(url, 3)


def query(url) -> Column:
    return _piece(url, 4)


def fragment(url) -> Column:
    return _piece(url, 5)


def host(url) -> Column:
    """Lower-case host name without user info or port; empty when there is none."""
    return F.lower(F.regexp_extract(c(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_of(source) -> Column:
    """Host of a full URL or of a bare host name; null when empty."""
    value = strip(source)
    return F.nullif(host(F.when(value.contains("//"), value).otherwise(F.concat(F.lit("//"), value))), F.lit(""))


def unquote(x) -> Column:
    plus = F.replace(c(x), F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(c(x)), plus)


def quote(x) -> Column:
    """Form encoding as a query string carries it."""
    return F.replace(F.replace(F.url_encode(c(x)), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def pairs(query_text, keep_blank: bool = True) -> Column:
    """array<struct<k,v>> of the decoded query pairs, in order."""
    parts = F.filter(F.split(c(query_text), "&"), lambda p: (p != "") & (p.contains("=") | F.lit(keep_blank)))
    decoded = F.transform(parts, lambda p: F.struct(
        unquote(F.substring_index(p, "=", 1)).alias("k"),
        unquote(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", ""))
                .otherwise(F.lit(""))).alias("v")))
    return decoded if keep_blank else F.filter(decoded, lambda s: s["v"] != "")


def encode_pairs(kv) -> Column:
    return F.array_join(F.transform(c(kv), lambda s: F.concat(quote(s["k"]), F.lit("="), quote(s["v"]))), "&")


def unsplit(scheme_, netloc_, path_, query_, fragment_) -> Column:
    return F.concat(
        F.when(scheme_ != "", F.concat(scheme_, F.lit(":"))).otherwise(F.lit("")),
        F.when(netloc_ != "", F.concat(F.lit("//"), netloc_)).otherwise(F.lit("")),
        F.when((netloc_ != "") & (path_ != "") & ~path_.startswith("/"), F.concat(F.lit("/"), path_)).otherwise(path_),
        F.when(query_ != "", F.concat(F.lit("?"), query_)).otherwise(F.lit("")),
        F.when(fragment_ != "", F.concat(F.lit("#"), fragment_)).otherwise(F.lit("")),
    )


def canonical_url(url) -> Column:
    """Lower scheme and host, no trailing slash, no tracking parameters, no fragment.

    The tracking pattern is searched anywhere in the key, so ``resource_id`` goes as well."""
    kept = F.filter(pairs(query(url)), lambda s: ~s["k"].rlike(V.TRACKING_PARAM))
    built = unsplit(scheme(url), F.lower(netloc(url)), F.regexp_replace(path(url), "/+$", ""),
                    encode_pairs(kept), F.lit(""))
    return F.when(F.length(c(url)) > 0, built)


def normalized_source_url(url) -> Column:
    """Sorted query, lower scheme and host, at least a root path, no fragment."""
    ordered = F.array_sort(pairs(query(url)))
    bare = F.regexp_replace(path(url), "/+$", "")
    return unsplit(scheme(url), F.lower(netloc(url)), F.when(bare == "", F.lit("/")).otherwise(bare),
                   encode_pairs(ordered), F.lit(""))


def clean_input_url(text) -> Column:
    """A pasted address: a Markdown link gives its target, surrounding blanks and brackets go, port kept."""
    value = strip(text)
    target = F.regexp_extract(value, r"^\[[^\]]*\]\((https?://[^)\s]+)\)$", 1)
    raw = F.when(target != "", target).otherwise(F.regexp_replace(value, "^<|>$", ""))
    return unsplit(scheme(raw), F.lower(netloc(raw)), path(raw), query(raw), fragment(raw))


def page_of(url) -> Column:
    """The page itself: no query, no fragment, no trailing slash."""
    return unsplit(scheme(url), netloc(url), F.regexp_replace(path(url), "/+$", ""), F.lit(""), F.lit(""))


def resolve(base, ref) -> Column:
    """Join a reference onto its base address."""
    base, ref = c(base), strip(ref)
    origin = F.concat(scheme(base), F.lit("://"), netloc(base))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    no_fragment = F.regexp_replace(base, "#.*$", "")
    no_query = F.regexp_replace(no_fragment, r"\?.*$", "")
    joined = F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), F.regexp_replace(ref, r"^(?:\./)+", ""))
    return (F.when(ref == "", base)
            .when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
            .when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref))
            .when(ref.startswith("/"), without_dots(F.concat(origin, ref)))
            .when(ref.startswith("#"), F.concat(no_fragment, ref))
            .when(ref.startswith("?"), F.concat(no_query, ref))
            .otherwise(without_dots(joined)))


def without_dots(url) -> Column:
    """The address without ``.`` and ``..`` segments in its path; query and fragment stay."""
    head = F.regexp_extract(url, r"^[^?#]*", 0)
    rest = F.substring(url, F.length(head) + 1, F.length(url))
    origin = F.regexp_extract(head, "^[^:/]+://[^/]*", 0)
    parts = F.split(F.substring(head, F.length(origin) + 2, F.length(head)), "/")
    kept = F.aggregate(parts, F.expr("cast(array() as array<string>)"), lambda done, s: F.when(s == ".", done).when(
        s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))))
    folder = F.element_at(parts, -1).isin(".", "..")
    path_ = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder & (F.size(kept) > 0), "/").otherwise(""))
    return F.when(head.rlike(r"/\.\.?(?:/|$)"), F.concat(origin, path_, rest)).otherwise(url)


def segments(text) -> Column:
    return F.filter(F.split(c(text), "/"), lambda s: s != "")


_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F-]{27,}$"


def url_identifier(url) -> Column:
    """struct(value, source) of the record id inside a detail address: fragment, job route, then query."""
    def found(value, source):
        return F.struct(value.alias("value"), F.lit(source).alias("source"))

    digits = lambda s: F.length(F.regexp_replace(s, "[^0-9]", ""))
    in_fragment = F.filter(F.transform(
        F.reverse(segments(fragment(url))),
        lambda s: F.when(s.rlike(_UUID), found(F.lower(s), "detail_url_fragment_uuid"))
        .when(s.rlike(r"^[A-Za-z0-9-]{5,}$") & (digits(s) >= 5), found(s, "detail_url_fragment_id"))),
        lambda x: x.isNotNull())
    parts = segments(path(url))
    in_path = F.filter(F.transform(
        parts,
        lambda s, i: F.when(
            F.lower(s).isin(V.JOB_ROUTES),
            F.when(F.get(parts, i + 1).rlike(_UUID), found(F.lower(F.get(parts, i + 1)), "detail_url_path_uuid"))
            .when(F.get(parts, i + 1).rlike(r"^(?=.*\d)[A-Za-z0-9-]{3,}$"),
                  found(F.get(parts, i + 1), "detail_url_path_id")))),
        lambda x: x.isNotNull())
    keys = V.REQUISITION_KEYS + V.POSTING_KEYS + V.STABLE_KEYS
    in_query = F.transform(
        F.filter(pairs(query(url), keep_blank=False), lambda s: F.lower(s["k"]).isin(keys)),
        lambda s: F.struct(s["v"].alias("value"), F.concat(F.lit("query:"), s["k"]).alias("source")))
    return F.coalesce(F.get(in_fragment, F.lit(0)), F.get(in_path, F.lit(0)), F.get(in_query, F.lit(0)))


def path_bound_ids(url) -> Column:
    """array<struct<name,value>> of ids an address is bound to: query, keyed path segment, job fragment."""
    pair = lambda n, v: F.struct(n.alias("name"), v.alias("value"))
    in_query = F.transform(
        F.filter(pairs(query(url), keep_blank=False), lambda s: F.lower(s["k"]).isin(V.PATH_ID_QUERY)),
        lambda s: pair(F.lower(s["k"]), s["v"]))
    parts = segments(path(url))
    in_path = F.filter(F.transform(parts, lambda s, i: F.when(
        F.lower(s).isin(V.PATH_ID_SEGMENTS) & F.get(parts, i + 1).isNotNull(),
        pair(F.lower(s), F.regexp_replace(F.get(parts, i + 1), r"\.html$", "")))), lambda x: x.isNotNull())
    frag = F.regexp_extract(c(url), "(?i)#/(?:job|jobs)/([^/?#]+)", 1)
    in_fragment = F.when(frag != "", F.array(pair(F.lit("job"), frag))).otherwise(F.expr(
        "cast(array() as array<struct<name:string,value:string>>)"))
    return F.concat(in_query, in_path, in_fragment)


def request_params(url, body_json=None) -> Column:
    """Query parameters, first key wins, overlaid by the top level of a JSON body."""
    first_wins = F.map_from_entries(F.reverse(F.transform(pairs(query(url)), lambda s: F.struct(s["k"], s["v"]))))
    if body_json is None:
        return first_wins
    from .records import parse_strict

    body = F.try_variant_get(parse_strict(body_json), "$", "map<string,string>")
    return F.when(body.isNull(), first_wins).otherwise(F.map_concat(first_wins, body))


def page_params(params) -> Column:
    """struct(page, size) by canonical alias, integer or null."""
    from .text import canonical

    by_name = F.transform_keys(c(params), lambda k, _: canonical(k))
    pick = lambda names: F.get(F.filter(F.transform(words(names), lambda n: F.struct(
        F.map_contains_key(by_name, n).alias("has"), F.try_element_at(by_name, n).alias("v"))),
        lambda s: s["has"]), F.lit(0))["v"]
    integer = lambda v: F.when(strip(v).rlike(r"^[+-]?\d+$"), strip(v).try_cast("bigint"))
    return F.struct(integer(pick(V.PAGE_ALIASES)).alias("page"), integer(pick(V.SIZE_ALIASES)).alias("size"))


def classify_request(url) -> Column:
    low = F.lower(c(url))
    expr = F
    for name, terms in V.REQUEST_CLASSES:
        expr = expr.when(contains_any(low, terms), F.lit(name))
    return expr.otherwise(F.lit("OTHER"))


def is_job_url(url) -> Column:
    return contains_any(F.lower(F.concat(path(url), F.lit("?"), query(url))), V.URL_JOB_TERMS)


def is_config_url(url) -> Column:
    return contains_any(F.lower(c(url)), V.URL_CONFIG_TERMS)


def route_in_scope(current, target) -> Column:
    """Same host and a recruitment word, but no foreign word, among the route tokens."""
    route = F.lower(F.when(fragment(target) != "", F.substring_index(fragment(target), "?", 1))
                    .otherwise(path(target)))
    tokens = F.split(route, "[^a-z0-9]+")
    return ((host(current) == host(target)) & ~F.arrays_overlap(tokens, words(V.NON_ROUTE_TERMS))
            & F.arrays_overlap(tokens, words(V.ROUTE_TERMS)))


def url_scope(url, text=None) -> Column:
    """struct(filters, recruitment_type, location) a listing address already narrows to."""
    from .redact import is_ephemeral, is_sensitive

    kept = F.filter(pairs(query(url)), lambda s: F.lower(s["k"]).isin(V.URL_FILTER_KEYS)
                    & ~is_sensitive(s["k"]) & ~is_ephemeral(s["k"]))
    low = F.lower(c(url))
    kind = F.coalesce(*[F.when(low.contains(t), F.lit(t)) for t in V.URL_SCOPE_TERMS])
    by_location = F.regexp_extract(path(url), r"(?i)/locations?/([^/]+?)(?:\.html)?/?$", 1)
    by_go = F.regexp_extract(path(url), r"(?i)/go/([^/]+)/\d+/?$", 1)
    place = strip(F.replace(F.when(by_location != "", by_location).otherwise(by_go), F.lit("-"), F.lit(" ")))
    if text is not None:
        place = F.when((place != "") & F.lower(c(text)).contains(F.lower(place)), place)
    return F.struct(F.array_join(F.transform(kept, lambda s: F.concat(s["k"], F.lit("="), s["v"])), "&").alias("filters"),
                    kind.alias("recruitment_type"), F.nullif(place, F.lit("")).alias("location"))


def brand_token(url) -> Column:
    """Tenant label of a hosted recruiting platform address."""
    h = host(url)
    out = F.lit(None).cast("string")
    for suffix in reversed(V.HOSTED_PLATFORMS):
        label = F.element_at(F.split(F.regexp_replace(F.substring(
            h, F.lit(1), F.length(h) - len(suffix)), r"\.+$", ""), r"\."), -1)
        good = (label != "") & (label != "www") & ~label.isin(V.PLATFORM_TOKENS)
        out = F.when(h.endswith(suffix) & good, label).otherwise(out)
    return out
