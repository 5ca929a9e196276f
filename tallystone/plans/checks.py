"""Invariants as queries that return the rows that break them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class BrokenInvariant(AssertionError):
    """A table breaks a rule that it is published under."""


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n: rows that break each rule. A null outcome breaks it."""
    counts = df.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()))
    return counts.select(F.explode(F.create_map(*(x for name in rules for x in (F.lit(name), F.col(name))))).alias("rule", "n")).filter("n > 0")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def require_none(broken: DataFrame, what: str) -> None:
    if rows := broken.take(5):
        raise BrokenInvariant(f"{what}: {rows}")
