"""Registry of queries: name, Spark plan, the inventory lines it covers and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from barloom.session import use_utc

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    plan: Plan
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under ``name``; ``covers`` lists inventory ids separated by spaces."""

    def wrap(fn: Plan) -> Plan:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_utc(spark)
            return fn(spark, sf_dir)

        REGISTRY[name] = Query(name, tuple(covers.split()), run, sql)
        return fn

    return wrap
