"""Registry of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.sources.fixtures import fixture, table, with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


#: Added before rounding on both sides: a value that ends in an exact half at the last
#: digit is apart by its last bits in two engines and would round either way.
NUDGE = 3e-8


def rounded(value: Column | str, digits: int) -> Column:
    return F.round((F.col(value) if isinstance(value, str) else value) + F.lit(NUDGE), digits)


def nudged(sql: str) -> str:
    """sql with NUDGE added inside every round(value, digits)."""
    out, at = [], 0
    while (i := sql.find("round(", at)) >= 0:
        depth, comma, j = 1, None, i + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            if sql[j] == "," and depth == 1:
                comma = j
            j += 1
        inner = sql[i + 6 : comma if comma else j - 1]
        tail = f" + {NUDGE}{sql[comma : j - 1]}" if comma else ""
        out.append(sql[at:i] + f"round(({nudged(inner)}){tail})")
        at = j
    return "".join(out) + sql[at:]


class Source:
    """Tables and derived views of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def view(self, name: str) -> DataFrame:
        return fixture(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, views: str = "") -> Callable:
    """Register fn(source) under name, with its SQL over the named views."""

    def add(fn: Callable[[Source], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: fn(Source(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(nudged(sql), *views.split()) if views else nudged(sql).strip()
        return fn

    return add
