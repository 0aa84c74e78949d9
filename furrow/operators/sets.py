"""Unions, differences, distinct rows and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_with_source(tables: dict[str, DataFrame], source: str = "source") -> DataFrame:
    """All rows with the name of their table; columns by name, absent ones NULL."""
    named = [d.withColumn(source, F.lit(name)) for name, d in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def subtract(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), keys, "left_anti")


def distinct_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct()


def to_long(df: DataFrame, keys: list[str], values: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(keys, values, name, value)


def to_wide(df: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """One column per listed name (the first value); the list spares a job that finds them."""
    return df.groupBy(*keys).pivot(name, names).agg(F.first(value))
