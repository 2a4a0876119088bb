"""Constraints as queries that give the rows breaking them (C1-C5, C8-C11, C14). An empty table breaks nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, keys: list[str], where: Column | None = None, nulls_equal: bool = False) -> DataFrame:
    """keys, n: keys that occur more than once, among the rows the partial condition admits. A key with a null is unique unless nulls are equal."""
    d = df if where is None else df.where(where)
    if not nulls_equal:
        for k in keys:
            d = d.where(F.col(k).isNotNull())
    return d.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference is not null and leads nowhere."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(parent_key).alias("__p")).distinct(), F.col(column) == F.col("__p"), "left_anti")


def _set_count(columns: list[str]) -> Column:
    n = F.lit(0)
    for c in columns:
        n = n + F.col(c).isNotNull().cast("int")
    return n


def not_exactly(df: DataFrame, columns: list[str], allowed: list[int]) -> DataFrame:
    """Rows in which the number of columns set is none of the allowed ones: [1] exactly one, [0, 1] at most one, [0, 3] all of three or none."""
    return df.where(~_set_count(columns).isin(allowed))


def not_implied(df: DataFrame, premise: Column, conclusion: Column) -> DataFrame:
    """Rows in which the premise is true and the conclusion is false; as in SQL, an unknown conclusion breaks nothing."""
    return df.where(F.coalesce(premise, F.lit(False)) & ~F.coalesce(conclusion, F.lit(True)))


def outside_domain(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(values))


def self_links(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a) == F.col(b))


def not_positive(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) <= 0)


def malformed(df: DataFrame, ok: Column) -> DataFrame:
    return df.where(~F.coalesce(ok, F.lit(False)))


def unordered_pairs(df: DataFrame, low: list[str], high: list[str]) -> DataFrame:
    """Rows whose first composite key is not less than the second."""
    named = lambda cs: F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cs)])
    return df.where(~F.coalesce(named(low) < named(high), F.lit(True)))


def counts(checks: dict[str, DataFrame]) -> DataFrame:
    """rule, n_broken: one row a rule, also for those nothing breaks."""
    out = None
    for name, df in checks.items():
        one = df.agg(F.count("*").alias("n_broken")).select(F.lit(name).alias("rule"), "n_broken")
        out = one if out is None else out.unionAll(one)
    return out
