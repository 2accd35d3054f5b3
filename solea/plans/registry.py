"""Query registration: a Spark callable, its output columns and, where possible, a checking SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solea.views import VIEWS, check_text, read_table, read_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# further named sub-selects for the checking text, in order of dependence
EXTRA_CHECK_VIEWS: dict[str, str] = {}


CHECK_ONCE: set[str] = set()


class Inputs:
    """Lazy access to the tables and views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return read_view(self.spark, self.sf_dir, name)
        raise AttributeError(name)


def _spark_column(name: str, kind: str):
    c = F.col(name)
    if kind == "i":
        return c.cast("bigint").alias(name)
    if kind == "f":
        return (F.round(c.cast("double"), 6) + F.lit(0.0)).alias(name)
    if kind == "b":
        return c.cast("boolean").alias(name)
    return c.cast("string").alias(name)


def _check_column(name: str, kind: str) -> str:
    kinds = {"i": f"CAST({name} AS BIGINT)", "f": f"round(CAST({name} AS DOUBLE), 6) + 0.0",
             "b": f"CAST({name} AS BOOLEAN)", "s": f"CAST({name} AS VARCHAR)"}
    return f"{kinds[kind]} AS {name}"


def _with_views(body: str, columns: list[tuple[str, str]]) -> str:
    texts = {name: check_text(name) for name in VIEWS} | EXTRA_CHECK_VIEWS
    needed: list[str] = []
    pending = [body]
    while pending:
        text = pending.pop()
        for name in texts:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.append(name)
                pending.append(texts[name])
    ordered = [n for n in texts if n in needed]
    # a view that feeds a recursive one is computed once, not in every recursion step
    parts = [f"{n} AS {'MATERIALIZED ' if n in CHECK_ONCE else ''}({texts[n]})" for n in ordered] + [f"answer AS ({body})"]
    return f"WITH RECURSIVE {', '.join(parts)} SELECT {', '.join(_check_column(n, k) for n, k in columns)} FROM answer"


def query(name: str, columns: str, sql: str | None = None):
    """Register a query. ``columns`` is ``name:kind ...`` with kind i(nteger), f(loat, 6 places), s(tring), b(oolean)."""
    spec = [tuple(c.split(":")) for c in columns.split()]

    def wrap(build: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Inputs(spark, sf_dir)).select(*[_spark_column(n, k) for n, k in spec])

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _with_views(sql, spec)
        return build

    return wrap
