"""Registration of queries: an operator applied to its view, beside an independent SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docgrowth.plans.views import Views, twin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, make: Callable[[Views], DataFrame], sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(Views(spark, sf_dir))

    QUERIES[name] = run
    if sql:
        ORACLE[name] = twin(sql)
