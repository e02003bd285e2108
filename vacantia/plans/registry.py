"""Registered queries: a name, the operators it runs, a Spark plan and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import configure


class Tables:
    """The given tables of one data folder, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    operators: str
    plan: Callable[[Tables], DataFrame]
    oracle: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.plan(Tables(configure(spark), folder))


REGISTRY: dict[str, Query] = {}


def query(operators: str, oracle: str | None = None):
    """Register the decorated plan under its function name."""

    def wrap(plan):
        name = plan.__name__
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, operators, plan, oracle)
        return plan

    return wrap
