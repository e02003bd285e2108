"""Scoring expressions: is this array a job list, is this payload a job source?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .. import vocab as V
from . import records as R
from .text import c, contains_any, ends_with_any, words


def any_in(keys, vocab) -> Column:
    return F.arrays_overlap(c(keys), words(vocab))


def id_keys(keys) -> Column:
    """Keys of a lower-case key set that identify a posting."""
    keys = c(keys)
    titled = F.size(title_keys(keys)) > 0
    strong = F.filter(keys, lambda k: k.isin(V.SCORE_ID) | ends_with_any(k, V.ID_SUFFIXES)
                      | (titled & k.endswith("demandcode")))
    context = any_in(keys, V.SCORE_LOCATION + V.SCORE_CATEGORY + V.SCORE_JD + V.SCORE_LINK)
    return F.when((F.size(strong) == 0) & titled & context, F.filter(keys, lambda k: k == "code")).otherwise(strong)


def title_keys(keys) -> Column:
    return F.filter(c(keys), lambda k: k.isin(V.SCORE_TITLE) | ends_with_any(k, V.TITLE_SUFFIXES))


def job_prefixed(keys) -> Column:
    return F.exists(c(keys), lambda k: contains_any(k, ["job", "position", "requisition", "posting"])
                    | k.endswith("postcode"))


def is_job_record(keys) -> Column:
    """Identifier and title plus some job context."""
    context = any_in(keys, V.SCORE_LOCATION + V.SCORE_CATEGORY + V.SCORE_LINK + V.SCORE_JD) | job_prefixed(keys)
    return (F.size(id_keys(keys)) > 0) & (F.size(title_keys(keys)) > 0) & context


def sampled_records(items) -> Column:
    """Objects among the items; ``node`` wrappers are opened when every item has one."""
    items = F.filter(c(items), lambda v: R.as_record(v).isNotNull())
    node = lambda v: F.try_variant_get(v, "$.node", "variant")
    wrapped = (F.size(items) > 0) & F.forall(items, lambda v: F.coalesce(R.as_record(node(v)).isNotNull(), F.lit(False)))
    return F.when(wrapped, F.transform(items, node)).otherwise(items)


def key_sets(items) -> Column:
    return F.transform(sampled_records(items), lambda v: R.keys_within(v, 3))


def set_counts(sets) -> Column:
    """array<struct<s,n>> of the distinct key sets, first seen first, with how often each occurs."""
    from .text import let

    # as one text a set is compared by hash, so a long array costs a pass per distinct set
    spelled = F.transform(c(sets), lambda s: F.array_join(s, "\x1f"))
    return let(spelled, lambda all_: F.transform(F.array_distinct(all_), lambda t: F.struct(
        F.when(t == "", F.expr(R.NO_STRINGS)).otherwise(F.split(t, "\x1f")).alias("s"), F.size(F.filter(all_, lambda u: u == t)).alias("n"))))


def _total(counts, weight) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a + x["n"] * weight(x["s"]))


def homogeneity(counts) -> Column:
    """Mean overlap with the most common key set, the first one on ties, rounded to 4."""
    from .text import let

    def against(modal):
        overlap = lambda s: F.size(F.array_intersect(s, modal)) / F.greatest(F.size(F.array_union(s, modal)), F.lit(1))
        return F.round(_total(c(counts), overlap) / _total(c(counts), lambda s: F.lit(1.0)), 4)

    ranked = F.transform(c(counts), lambda x, i: F.struct(x["n"].alias("n"), (-i).alias("o"), x["s"].alias("s")))
    return F.when(F.size(c(counts)) > 0, let(F.array_max(ranked)["s"], against)).otherwise(0.0)


def density(counts) -> Column:
    """Share of job records among the key sets, rounded to 4."""
    return F.when(F.size(c(counts)) > 0, F.round(
        _total(c(counts), lambda s: F.when(is_job_record(s), 1.0).otherwise(0.0)) / _total(c(counts), lambda s: F.lit(1.0)), 4)).otherwise(0.0)


def is_job_array(items) -> Column:
    """At least two objects in the first eight whose keys include an id and a title."""
    head = F.filter(F.slice(c(items), 1, 8), lambda v: R.as_record(v).isNotNull())
    keys = F.flatten(F.transform(head, lambda v: F.map_keys(R.as_record(v))))
    return ((F.size(head) >= 2) & F.exists(keys, lambda k: k.rlike(V.ARRAY_ID_KEY))
            & F.exists(keys, lambda k: k.rlike(V.ARRAY_TITLE_KEY)))


def rejection_reasons(url, top_keys, fields, homogeneity_, density_) -> Column:
    """Why a payload is not a job list; the order is fixed, each reason once."""
    low, top, f = F.lower(c(url)), c(top_keys), c(fields)
    has = lambda vocab: any_in(f, vocab)
    prefixed = job_prefixed(f)
    tagged = has(["body", "tag", "createtime", "createdtime"]) & F.array_contains(f, "tag")
    reference = (has(["name", "label", "value"]) & has(["id", "code", "key", "value"])
                 & ~has([t for t in V.SCORE_TITLE if t != "name"]) & ~prefixed)
    weak = has(V.SCORE_REFERENCE) | ~has(V.SCORE_JD + V.SCORE_LINK + V.STRONG_CONTEXT)
    rules = [
        (contains_any(low, V.CONTENT_URL) | tagged, "CONTENT_PAYLOAD"),
        (contains_any(low, V.NAVIGATION_URL) | any_in(top, V.NAVIGATION_KEYS), "NAVIGATION_PAYLOAD"),
        (contains_any(low, V.CONFIG_URL) | any_in(top, V.CONFIG_KEYS), "CONFIG_PAYLOAD"),
        (contains_any(low, V.FACET_URL), "FACET_PAYLOAD"),
        (low.contains("widget"), "WIDGET_PAYLOAD"),
        (contains_any(low, V.SERVICE_URL) & (c(density_) < 0.8), "CONFIG_PAYLOAD"),
        (has(V.CONTENT_FIELDS) & ~prefixed & ~has(V.JOB_META), "CONTENT_LIST"),
        (has(V.PROGRAM_FIELDS) & ~prefixed & ~has(V.PROGRAM_TITLES), "PROGRAM_PAYLOAD"),
        (contains_any(low, V.NON_JOB_URL), "NON_JOB_SEMANTIC_SOURCE"),
        (~prefixed & ~has(V.REGION_EXEMPT)
         & (has(V.DICTIONARY_FIELDS) | has(V.REGION_FIELDS) | contains_any(low, V.REGION_URL)), "REGION_LIST"),
        (reference & weak, "REFERENCE_DATA_PAYLOAD"),
        ((c(homogeneity_) < 0.55) & (F.size(f) >= 4), "MIXED_CONTENT_PAYLOAD"),
        (c(density_) < 0.5, "LOW_JOB_ENTITY_DENSITY"),
    ]
    return F.array_distinct(F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in rules])))


def list_score(url, fields, homogeneity_, density_, length, has_total, rejected, empty_object) -> Column:
    """Weighted evidence that the payload is a job list; nine at most once rejected."""
    low, f = F.lower(c(url)), c(fields)
    titled, keyed = F.size(title_keys(f)) > 0, F.size(id_keys(f)) > 0
    weights = [
        (low.contains("job"), 2), (low.contains("position"), 2), (low.contains("search") | low.contains("list"), 1),
        (titled, 3), (keyed, 3), (any_in(f, V.SCORE_LOCATION), 2), (any_in(f, V.SCORE_CATEGORY), 1),
        (any_in(f, V.SCORE_LINK), 2), (any_in(f, V.SCORE_JD), 3),
        (any_in(f, V.SCORE_LOCATION + V.SCORE_CATEGORY) & titled & keyed, 2),
        (c(homogeneity_) >= 0.75, 2), (c(density_) >= 0.8, 4), (c(length) >= 5, 3), (c(has_total), 2),
        (c(empty_object), -3),
    ]
    score = reduce(lambda a, b: a + b, [F.when(cond, n).otherwise(0) for cond, n in weights])
    return F.when(c(rejected), F.least(score, F.lit(9))).otherwise(score)


def list_evidence(url, fields, homogeneity_, density_, length, total_path, reasons, empty_object) -> Column:
    low, f = F.lower(c(url)), c(fields)
    titled, keyed = F.size(title_keys(f)) > 0, F.size(id_keys(f)) > 0
    two = lambda x: F.format_string("%.2f", c(x))
    said = [
        (low.contains("job"), F.lit("URL contains job/jobs")), (low.contains("position"), F.lit("URL contains position")),
        (low.contains("search") | low.contains("list"), F.lit("URL contains search/list")),
        (titled, F.lit("records contain a title field")), (keyed, F.lit("records contain a stable id field")),
        (any_in(f, V.SCORE_LOCATION), F.lit("records contain location/city")),
        (any_in(f, V.SCORE_CATEGORY), F.lit("records contain department/category")),
        (any_in(f, V.SCORE_LINK), F.lit("records contain detail/apply links")),
        (any_in(f, V.SCORE_JD), F.lit("records contain JD fields")),
        (any_in(f, V.SCORE_LOCATION + V.SCORE_CATEGORY) & titled & keyed,
         F.lit("records combine stable ID, title, and job metadata")),
        (c(homogeneity_) >= 0.75, F.concat(F.lit("homogeneous record structure: "), two(homogeneity_))),
        (c(density_) >= 0.8, F.concat(F.lit("high job entity density: "), two(density_))),
        (c(length) >= 5, F.concat(F.lit("response contains "), c(length).cast("string"), F.lit(" records"))),
        (c(total_path).isNotNull(), F.concat(F.lit("response has total field: "), c(total_path))),
        (c(empty_object), F.lit("no list-shaped response")),
    ]
    plain = F.array_compact(F.array(*[F.when(cond, text) for cond, text in said]))
    return F.concat(plain, F.transform(c(reasons), lambda r: F.concat(F.lit("rejected: "), r)))


def confidence(score) -> Column:
    return F.when(c(score) >= 15, "HIGH").when(c(score) >= 10, "MEDIUM").otherwise("LOW")


def detail_score(url, keys) -> Column:
    low = F.lower(c(url))
    weights = [(contains_any(low, V.LOCALE_URL_TERMS), -8), (contains_any(low, V.DETAIL_URL_TERMS), 4),
               (any_in(keys, V.SCORE_JD), 7), (any_in(keys, V.SCORE_TITLE), 3), (any_in(keys, V.SCORE_ID), 2)]
    return reduce(lambda a, b: a + b, [F.when(cond, n).otherwise(0) for cond, n in weights])


def reliable(confidence_, reasons, density_, fields) -> Column:
    return ((c(confidence_) == "HIGH") & (F.size(c(reasons)) == 0) & (c(density_) >= 0.8)
            & (F.size(id_keys(fields)) > 0) & (F.size(title_keys(fields)) > 0))


# --- links and actions ---------------------------------------------------------------------------

def weighted(text, positive, negative, plus: int, minus: int) -> Column:
    from .text import hits

    low = F.lower(c(text))
    return hits(low, [t.lower() for t in positive]) * plus - hits(low, [t.lower() for t in negative]) * minus


def entry_score(text, url) -> Column:
    return weighted(F.concat_ws(" ", c(text), c(url)), V.ENTRY_SCORE_POSITIVE, V.ENTRY_SCORE_NEGATIVE, 3, 4)


def action_score(text, target, scope) -> Column:
    value = F.lower(F.concat_ws(" ", c(text), F.coalesce(c(target), F.lit(""))))
    bonus = (F.when((c(scope) == "CAMPUS") & contains_any(value, ["校园", "campus"]), 8)
             .when((c(scope) == "SOCIAL") & contains_any(value, ["社会", "social"]), 8).otherwise(0))
    return weighted(value, V.ACTION_POSITIVE, V.ACTION_NEGATIVE, 6, 8) + bonus


def route_score(text, target, current) -> Column:
    from . import urls as U
    from .text import hits

    low = F.lower(c(text))
    label = (F.when(contains_any(low, V.ROUTE_STRONG), 6).when(contains_any(low, V.ROUTE_SCOPE), 4)
             .when(contains_any(low, V.ROUTE_BARE), 2).otherwise(0))
    frag = U.fragment(target)
    route = F.lower(F.when(frag != "", F.substring_index(frag, "?", 1)).otherwise(U.path(target)))
    place = F.when(route.rlike(r"\bjobs?\b|\bpositions?\b"), 6).when(
        route.rlike("recruit|campus|social|intern|hiring"), 4).otherwise(0)
    foreign = F.when((F.length(c(target)) > 0) & (U.host(target) != U.host(current)), 100).otherwise(0)
    return label + place - hits(low, [t.lower() for t in V.ROUTE_NEGATIVE]) * 6 - foreign


def job_search_score(text, href) -> Column:
    from .text import hits

    return hits(F.lower(F.concat_ws(" ", c(text), c(href))), V.JOB_SEARCH_POSITIVE) * 4


def entry_type(text, url) -> Column:
    """Which kind of recruitment entry a link is; null for unlabelled or other links."""
    from .text import strip

    value = F.lower(F.concat_ws(" ", c(text), c(url)))
    kinds = F.coalesce(*[F.when(contains_any(value, terms), F.lit(name)) for name, terms in V.ENTRY_TERMS.items()])
    return F.when(strip(text) != "", kinds)


def source_intent(url, detected_type=None) -> Column:
    low = F.lower(c(url))
    known = [F.when(contains_any(low, terms), F.lit(name)) for name, terms in V.SOURCE_INTENT]
    if detected_type is not None:
        known.append(F.when(F.lower(c(detected_type)).isin("campus", "social", "intern"), F.upper(c(detected_type))))
    return F.coalesce(*known, F.lit("UNKNOWN"))


def scope_compatibility(intent, scope) -> Column:
    return (F.when(c(intent) == "UNKNOWN", F.when(c(scope) == "ALL_JOBS", 3).otherwise(0))
            .when(c(scope) == c(intent), 12).when(c(scope) == "ALL_JOBS", 6).otherwise(-20))


def company_continuity(source_url, target_url, company) -> Column:
    """Does the target still belong to the source's company, by name or by host core?"""
    from . import urls as U

    target = F.replace(F.lower(F.concat(U.host(target_url), U.path(target_url))), F.lit("-"), F.lit(""))
    token = F.regexp_replace(F.lower(F.coalesce(c(company), F.lit(""))), r"[^\p{L}\p{N}]", "")
    parts = F.split(U.host(source_url), r"\.")
    core = F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2)).otherwise(U.host(source_url))
    plain_target = F.replace(F.concat(U.host(target_url), U.path(target_url)), F.lit("-"), F.lit(""))
    return ((token != "") & target.contains(token)) | ((core != "") & plain_target.contains(core))
