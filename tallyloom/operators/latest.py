"""One row, or one value, a key: the many forms of "the latest" (V1, V13, V21, A9, A10, A13, W1-W6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """The row of each key whose `newest` columns are greatest, compared in order, nulls as least.

    An aggregate and not a window: combined before the shuffle, so that a hot key is one row a
    task. Null keys form a key. Give a last column that is unique; of rows equal in all of them any
    one is kept, whole. An empty table stays empty.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*newest)).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def ranked_first(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first `n` rows of each key in any order, with their `rank` if it is named. Only as many rows as are kept leave a task for n rows a key where Spark can prune the window's groups."""
    r = rank or "__rank"
    out = df.withColumn(r, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(r) <= n)
    return out if rank else out.drop(r)


def first_known(df: DataFrame, keys: list[str], by: list[str], columns: list[str]) -> DataFrame:
    """For each column on its own, the latest value that is not null."""
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*by))).alias(c) for c in columns])


def most_common(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value that is not null, the smallest of several; two combined aggregates."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("__n")).alias("n"), F.col(value).alias("v"))).alias(value), F.max("__n").alias("n"))


def split_top(df: DataFrame, keys: list[str], order: list[Column], cap: int, unique: list[str], flag: str = "is_top") -> DataFrame:
    """Rows with a flag: within the first `cap` of their key, or in reserve; `unique` are columns that together name a row.

    The first rows are picked where they are, `cap` of a key in each task, before any shuffle; the
    others only meet them in an equi-join, so that a key with very many rows is no task of its own.
    """
    top = ranked_first(df, keys, order, cap).select(*unique, F.lit(True).alias("__top"))
    return df.join(top, unique, "left").withColumn(flag, F.coalesce("__top", F.lit(False))).select(*df.columns, flag)


def in_list_order(c: Column, values: list[str]) -> Column:
    """The place of a value in a list, after all of them where it is none."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, values)), c), F.lit(0)), F.lit(len(values) + 1))
