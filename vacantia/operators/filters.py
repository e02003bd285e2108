"""Row filters and trust rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls as U
from ..functions.text import c


def usable(status, success, n) -> Column:
    """2xx, not explicitly unsuccessful, and carrying records."""
    return c(status).between(200, 299) & F.coalesce(c(success), F.lit(True)) & (c(n) > 0)


def trusted_detail_url(url, source_host, hosts=(), observed: Column | None = None) -> Column:
    """http(s) and on the source, a trusted or an observed host."""
    h = U.host(url)
    known = (h == c(source_host))
    if hosts:
        known = known | h.isin([x.lower() for x in hosts])
    if observed is not None:
        known = known | observed
    return U.scheme(url).isin("http", "https") & known


def navigation_trust(source_host, target_host, final_host, redirects, credible) -> Column:
    return ((c(source_host) != "") & (c(target_host) != "") & (c(final_host) != "") & c(credible)
            & (c(redirects) <= 3) & ((c(final_host) == c(source_host)) | (c(final_host) == c(target_host))))


def is_pagination_control(label) -> Column:
    from .. import vocab as V

    return F.coalesce(c(label), F.lit("")).rlike(V.PAGINATION_CONTROL)


def scope_leaks(df: DataFrame, scopes: DataFrame, run: str, category: str) -> DataFrame:
    """Categories of a run that its requested scope does not contain, with their row counts.

    Counts come first, so only one row per run and category meets the scope table."""
    counts = df.groupBy(run, F.coalesce(F.col(category), F.lit("missing")).alias(category)).agg(F.count("*").alias("n"))
    return counts.join(scopes, [run, category], "left_anti")
