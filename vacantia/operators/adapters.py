"""Registry of provider adapters: which provider a source belongs to, as one routing expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab as V
from ..functions import urls as U
from ..functions.text import c, contains_any
from . import providers as P

FALLBACK = "generic"


@dataclass(frozen=True)
class Adapter:
    """A provider: hosts it serves (with their subdomains), marks that its pages must show, the mapper of its records.

    With ``marks`` a host alone proves nothing: the page decides, ahead of all adapters that go by host."""

    name: str
    hosts: tuple[str, ...] = ()
    marks: tuple[str, ...] = ()
    priority: int = 100
    mapper: Callable | None = None

    def on_host(self, host: Column) -> Column:
        """Is the host one of the adapter's, or below one?"""
        found = F.lit(False)
        for name in self.hosts:
            found = found | (host == name) | host.endswith("." + name)
        return F.coalesce(found, F.lit(False))


@dataclass
class Registry:
    """Adapters in the order they are asked: those proved by the page, then by priority, then by name; else the fallback."""

    adapters: dict[str, Adapter] = field(default_factory=dict)

    def register(self, adapter: Adapter) -> None:
        """Add an adapter, or replace the one of its name."""
        self.adapters[adapter.name] = adapter

    def ordered(self) -> list[Adapter]:
        return sorted(self.adapters.values(), key=lambda a: (not a.marks, a.priority, a.name))

    def known(self, url, html=None) -> Column:
        """Name of the adapter that an address, and its page where there is one, belong to; null when none does."""
        host = U.host(url)
        tests = []
        for adapter in self.ordered():
            if adapter.marks and html is None:
                continue
            shown = F.coalesce(contains_any(c(html), list(adapter.marks)), F.lit(False)) if adapter.marks else F.lit(True)
            tests.append(F.when(adapter.on_host(host) & shown, adapter.name))
        return F.coalesce(*tests, F.lit(None).cast("string"))

    def route(self, url, html=None, provider=None, confidence=None) -> Column:
        """Name of the adapter of a source: a provider recognised with HIGH confidence, else by page and address, else the fallback.

        An unknown provider, or one of lower confidence, decides nothing."""
        tests = [self.known(url, html), F.lit(FALLBACK)]
        if provider is not None:
            named = F.when((c(confidence) == "HIGH") & F.lower(c(provider)).isin(*self.adapters), F.lower(c(provider)))
            tests.insert(0, named)
        return F.coalesce(*tests)

    def map_records(self, rows: DataFrame, route: str, *columns: str) -> dict[str, DataFrame]:
        """The rows of each adapter that has a mapper, mapped: the mappers give different tables."""
        return {a.name: a.mapper(rows.filter(F.col(route) == a.name), *columns) for a in self.ordered() if a.mapper}


def standard() -> Registry:
    """The adapters the library knows; callers may register their own."""
    out = Registry()
    mappers = {"moka": P.map_moka, "feishu": P.map_feishu, "zhiye": P.map_zhiye}
    for name, (priority, hosts, marks) in V.ADAPTERS.items():
        out.register(Adapter(name, hosts, marks, priority, mappers.get(name)))
    return out
