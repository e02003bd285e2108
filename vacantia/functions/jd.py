"""Job-description expressions: credibility, field recognition, canonical text, splitting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import vocab as V
from . import records as R
from .text import c, contains_any, hits, html_lines, let, lines, squeeze, strip, without_space


def heading_hits(text) -> Column:
    low = F.lower(c(text))
    return (F.when(contains_any(low, V.BODY_RESPONSIBILITY), 1).otherwise(0)
            + F.when(contains_any(low, V.BODY_REQUIREMENT), 1).otherwise(0))


def credible_body(text) -> Column:
    """Long, or carries both heading kinds, or middling with one."""
    x = F.coalesce(c(text), F.lit(""))
    return (F.length(x) >= 500) | (heading_hits(x) >= 2) | ((F.length(x) >= 160) & (heading_hits(x) >= 1))


def credible_jd(text) -> Column:
    """The page-side rule: long enough once squeezed, more signals than penalties or long."""
    return let(squeeze(F.coalesce(c(text), F.lit(""))), lambda x: let(F.lower(x), lambda low: _credible_page(x, low)))


def _credible_page(x, low) -> Column:
    return (F.length(x) >= 160) & ((hits(low, V.JD_SIGNALS) > hits(low, V.JD_PENALTIES)) | (F.length(x) >= 500))


def teaser_only(body, has_sections) -> Column:
    size = F.length(without_space(body))
    return F.coalesce((size > 0) & (size < V.TEASER_FLOOR) & ~c(has_sections), F.lit(False))


def is_bot_challenge(html) -> Column:
    """Near-empty visible text behind a script that talks about cookies or verification."""
    visible = strip(F.regexp_replace(F.regexp_replace(c(html), "(?s)<script.*?</script>", ""), "<[^>]+>", ""))
    return F.coalesce((F.length(c(html)) > 0) & (F.length(c(html)) <= 5000) & (F.length(visible) < 200)
                      & c(html).rlike(V.CHALLENGE_WORDS), F.lit(False))


def pick_jd(record) -> Column:
    """struct(description, description_field, responsibilities(_field), requirements(_field), state)."""
    return _picked_jd(c(record))


def jd_state(record) -> Column:
    """The state of ``pick_jd``; a record without any field that may carry the text is not looked into."""
    return let(c(record), lambda r: F.when(
        ~F.exists(F.map_keys(r), lambda k: F.lower(k).isin(_JD_KEYS)), F.lit("ABSENT")).otherwise(_picked_jd(r)["state"]))


# lower-case names of all fields and wrappers that pick_jd reads
_JD_KEYS = sorted({n.lower() for n in V.JD_DESCRIPTION + V.JD_RESPONSIBILITY + V.JD_REQUIREMENT + V.JD_WRAPPERS})


def _picked_jd(record) -> Column:
    def wrapped(own, names):
        tries = F.array(own, R.pick_wrapped_field(record, V.JD_WRAPPERS, names))
        return F.get(F.filter(tries, lambda t: t["value"].isNotNull()), F.lit(0))

    def described(p):
        d, duty, need = p["d"], p["duty"], p["need"]
        short = ((F.lower(duty["field"]) == "duty") & (F.lower(need["field"]) == "require")
                 & (F.length(strip(duty["value"])) + F.length(strip(need["value"])) < V.MIN_SPLIT_CHARS))
        has_half = duty["value"].isNotNull() | need["value"].isNotNull()
        state = (F.when(d["value"].isNotNull(),
                        F.when(~has_half & ~credible_body(d["value"]), F.lit("SUMMARY")).otherwise(F.lit("FULL_TEXT")))
                 .when(has_half, F.when(short, F.lit("SUMMARY")).otherwise(F.lit("SPLIT")))
                 .otherwise(F.lit("ABSENT")))
        return F.struct(
            d["value"].alias("description"), d["field"].alias("description_field"),
            duty["value"].alias("responsibilities"), duty["field"].alias("responsibilities_field"),
            need["value"].alias("requirements"), need["field"].alias("requirements_field"), state.alias("state"))

    return let(F.struct(
        R.pick_jd_field(record, V.JD_DESCRIPTION).alias("d"),
        wrapped(R.pick_jd_field(record, V.JD_RESPONSIBILITY), V.JD_WRAPPED_RESPONSIBILITY).alias("duty"),
        wrapped(R.pick_jd_field(record, V.JD_REQUIREMENT), V.JD_WRAPPED_REQUIREMENT).alias("need")), described)


def needs_detail(picked, mode) -> Column:
    """Must the detail still be fetched for this record?"""
    p = c(picked)
    return (F.when(c(mode) == "LIST_SUFFICIENT", False).when(c(mode) == "DETAIL_REQUIRED", True)
            .when(p["state"].isin("SUMMARY", "ABSENT"), True).when(p["state"] == "FULL_TEXT", False)
            .otherwise(p["responsibilities"].isNull() | p["requirements"].isNull()))


def needs_full_jd(full_jd, responsibilities, requirements) -> Column:
    joined = F.array_join(F.concat(F.coalesce(c(responsibilities), F.expr(R.NO_STRINGS)),
                                   F.coalesce(c(requirements), F.expr(R.NO_STRINGS))), "\n")
    return ~(credible_body(full_jd) | credible_body(joined))


def _missing_from(text, part) -> Column:
    flat = F.lower(without_space(part))
    return (flat != "") & ~F.lower(without_space(text)).contains(flat)


def canonical_jd(picked) -> Column:
    """Whole text of the posting: the description plus halves it does not already contain."""
    p = c(picked)
    labelled = lambda head, x: F.concat(F.lit(head + "\n"), strip(x))
    duty, need = p["responsibilities"], p["requirements"]
    whole = F.concat_ws(
        "\n\n", strip(p["description"]),
        F.when(_missing_from(p["description"], duty), labelled("岗位职责", duty)),
        F.when(_missing_from(p["description"], need), labelled("任职要求", need)))
    split = F.concat_ws("\n\n", labelled("岗位职责", duty), labelled("任职要求", need))
    return (F.when(p["description"].isNotNull(), F.nullif(whole, F.lit("")))
            .when(p["state"] == "SPLIT", F.nullif(split, F.lit(""))))


def _tagged_sections(line_array, is_duty, is_need, norm=lambda line: line) -> Column:
    """Lines under each heading kind: heading positions first, then the spans between them.

    ``norm`` is applied once to a line, before both tests."""
    def cut(x):
        marks = F.filter(F.transform(F.transform(x, norm), lambda line, i: F.struct(
            i.alias("i"), F.when(is_duty(line), 1).when(is_need(line), 2).alias("k"))), lambda m: m["k"].isNotNull())
        return let(marks, lambda m: let(spans(x, m), lambda s: F.struct(
            part(x, s, 1).alias("responsibilities"), part(x, s, 2).alias("requirements"))))

    def spans(x, marks):
        return F.transform(marks, lambda m, j: F.struct(
            m["k"].alias("k"), (m["i"] + 2).alias("lo"),
            (F.coalesce(F.get(marks, j + 1)["i"], F.size(x)) - m["i"] - 1).alias("n")))

    def part(x, found, k):
        return F.flatten(F.transform(F.filter(found, lambda s: s["k"] == k), lambda s: F.slice(x, s["lo"], s["n"])))

    return let(line_array, cut)


def _starts(vocab):
    return f"(?s)^(?:{'|'.join(vocab)})(?: .*)?$"


def split_jd(text) -> Column:
    """struct(responsibilities, requirements): lines under heading lines; a heading may carry a tail."""
    norm = lambda x: F.btrim(F.regexp_replace(F.lower(x), r"[:：\s]+$", ""), F.lit("#* "))
    return _tagged_sections(lines(text), lambda x: x.rlike(_starts(V.SPLIT_RESPONSIBILITY)), lambda x: x.rlike(_starts(V.SPLIT_REQUIREMENT)), norm)


def jd_sections(text) -> Column:
    """Split either HTML or plain text."""
    flat = F.when(c(text).rlike("</?[a-zA-Z][^>]*>"), F.array_join(html_lines(text), "\n")).otherwise(c(text))
    return split_jd(flat)


def sections_from_text(text) -> Column:
    """Rendered page text to sections, footer and legal lines dropped."""
    body = F.filter(lines(text), lambda x: ~x.rlike(V.RENDERED_STOP))
    return _tagged_sections(body, lambda x: x.isin(V.RENDERED_RESPONSIBILITY), lambda x: x.isin(V.RENDERED_REQUIREMENT))


def card_sections(text) -> Column:
    """Two sections of a card by inline labels; a half below forty characters is dropped."""
    # a single blank is already what a run becomes
    return let(F.regexp_replace(c(text), r" [\t\r ]+|[\t\r][\t\r ]*", " "), _cut_card)


def _cut_card(value) -> Column:
    """Cuts at the first label of either kind; each label is looked for once."""
    trim = lambda x: F.btrim(x, F.lit(" \n:："))
    keep = lambda x: let(trim(x), lambda t: F.when(F.length(t) >= 40, t))
    parts = lambda label: F.split(value, label, 2)

    def cut(s):
        need, duty = s["need"], s["duty"]
        # texts before and after the first requirement label and the first responsibility label
        between = F.length(F.get(need, F.lit(0))) - F.length(value) + F.length(F.get(duty, F.lit(1)))
        return F.when((F.size(need) > 1) & (F.size(duty) > 1), F.struct(
            keep(F.substring(F.get(duty, F.lit(1)), F.lit(1), F.greatest(between, F.lit(0)))).alias("responsibilities"),
            keep(F.get(need, F.lit(1))).alias("requirements"))).otherwise(F.struct(
                F.lit(None).cast("string").alias("responsibilities"), F.lit(None).cast("string").alias("requirements")))

    return let(F.struct(parts(V.CARD_REQUIREMENT).alias("need"), parts(V.CARD_RESPONSIBILITY).alias("duty")), cut)


def split_items(text) -> Column:
    """One half as items: its lines, else an inline numbering after a semicolon or full stop."""
    return let(strip(F.coalesce(c(text), F.lit(""))), _items)


def _items(body) -> Column:
    by_line = lines(F.replace(body, F.lit("\r"), F.lit("\n")))
    by_number = F.filter(F.transform(F.split(body, r"(?<=[；;。])\s*(?=\d{1,2}[、.)．])"), strip), lambda x: x != "")
    return (F.when(body == "", F.expr(R.NO_STRINGS)).when(F.size(by_line) > 1, by_line)
            .when(F.size(by_number) > 1, by_number).otherwise(F.array(body)))


def jd_halves(list_record, detail_record, picked) -> Column:
    """struct of item lists: recognised halves, else work content / service condition of detail, then list."""
    p = c(picked)
    def half(value, key):
        tries = F.array(split_items(value), split_items(R.only_text(R.get(detail_record, key))),
                        split_items(R.only_text(R.get(list_record, key))))
        return F.coalesce(F.get(F.filter(tries, lambda t: F.size(t) > 0), F.lit(0)), F.expr(R.NO_STRINGS))
    return F.struct(half(p["responsibilities"], "workContent").alias("responsibilities"),
                    half(p["requirements"], "serviceCondition").alias("requirements"))


def loose_title_match(expected, actual) -> Column:
    a, b = without_space(expected), without_space(actual)
    return (F.when(F.coalesce(c(expected), F.lit("")) == "", True)
            .when(F.coalesce(c(actual), F.lit("")) == "", False).otherwise(b.contains(a) | a.contains(b)))


def enrich(responsibilities, requirements, source) -> Column:
    """struct(responsibilities, requirements, status): fill empty requirements, lengthen responsibilities."""
    return let(jd_sections(source), lambda found: _enriched(found, responsibilities, requirements, source))


def _enriched(found, responsibilities, requirements, source) -> Column:
    no_resp, no_req = F.size(found["responsibilities"]) == 0, F.size(found["requirements"]) == 0
    fill = ~no_req & (F.size(c(requirements)) == 0)
    grow = F.size(found["responsibilities"]) > F.size(c(responsibilities))
    status = (F.when(F.coalesce(strip(source), F.lit("")) == "", "SOURCE_REQUIREMENTS_ABSENT")
              .when(no_resp & no_req, "SOURCE_REQUIREMENTS_ABSENT").when(fill & grow, "ENRICHED")
              .when(fill, "REQUIREMENTS_FILLED").when(grow, "RESPONSIBILITIES_IMPROVED").otherwise("NO_CHANGE"))
    return F.struct(
        F.when(grow, found["responsibilities"]).otherwise(c(responsibilities)).alias("responsibilities"),
        F.when(fill, found["requirements"]).otherwise(c(requirements)).alias("requirements"), status.alias("status"))


def work_mode(text) -> Column:
    return F.nullif(F.regexp_extract(c(text), V.WORK_MODE, 1), F.lit(""))


def visible_totals(text) -> Column:
    """array<struct<value,confidence,evidence>> of totals in explicit result wording."""
    found = []
    for name, confidence, pattern in V.TOTAL_PATTERNS:
        numbers = F.regexp_extract_all(c(text), F.lit(pattern), F.lit(1))
        found.append(F.transform(F.array_distinct(numbers), lambda n: F.struct(
            F.replace(n, F.lit(","), F.lit("")).try_cast("bigint").alias("value"), F.lit(confidence).alias("confidence"),
            F.lit(name).alias("evidence"))))
    return F.concat(*found)


def block_score(text, title, order) -> Column:
    """Weight of a page block as the job description."""
    low = F.lower(c(text))
    bonus = F.when((F.length(c(title)) > 0) & low.contains(F.lower(c(title))), 300).otherwise(0)
    return (F.least(F.length(c(text)), F.lit(6000)) + hits(low, V.JD_SIGNALS) * 500
            - hits(low, V.JD_PENALTIES) * 700 + bonus - c(order))
