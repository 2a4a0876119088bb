"""Joins Spark would run as nested loops, written as equi-joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.lineage import cut


def any_key_join(left: DataFrame, right: DataFrame, left_id: list[str], right_id: list[str], keys: list[tuple[str, Column, Column]]) -> DataFrame:
    """left_id, right_id, matched_by: pairs that agree in at least one key, with the first key (in list order) they agree in.

    One equi-join a key, united, in place of an OR condition. Null keys match nothing.
    """
    out = None
    for i, (name, a, b) in enumerate(keys):
        x = left.select(*left_id, a.alias("__k")).where("__k is not null")
        y = right.select(*right_id, b.alias("__k")).where("__k is not null")
        j = x.join(y, "__k").select(*left_id, *right_id, F.struct(F.lit(i).alias("i"), F.lit(name).alias("n")).alias("__m"))
        out = j if out is None else out.unionAll(j)
    return out.groupBy(*left_id, *right_id).agg(F.min("__m").alias("__m")).select(*left_id, *right_id, F.col("__m.n").alias("matched_by"))


def prefix_join(left: DataFrame, text: str, right: DataFrame, prefix: str) -> DataFrame:
    """Pairs in which the left text begins with the right prefix.

    Texts are cut to every length that occurs among the prefixes (one small aggregate), and joined
    on the cut. A prefix is taken as it is, signs of LIKE included. Null and empty prefixes match nothing.
    """
    p = right.where(F.length(prefix) > 0)
    lens = p.agg(F.array_sort(F.collect_set(F.length(prefix))).alias("__lens"))
    l = left.crossJoin(F.broadcast(lens)).withColumn("__n", F.explode("__lens")).where(F.length(text) >= F.col("__n"))
    l = l.withColumn("__p", F.expr(f"left(`{text}`, __n)")).drop("__lens", "__n")
    return l.join(p.withColumnRenamed(prefix, "__p"), "__p").withColumnRenamed("__p", prefix)


def overlap_join(left: DataFrame, l_start: str, l_end: str, right: DataFrame, r_start: str, r_end: str, keys: list[str], width_s: int) -> DataFrame:
    """Pairs of one key whose half-open time intervals overlap.

    Intervals are laid over buckets of `width_s` seconds and meet in the bucket in which the later
    one starts, so that each pair comes once. Intervals that are empty or miss an end meet nothing.
    Choose the width near the usual length: an interval is copied once for each bucket it covers.
    """

    def spread(df: DataFrame, s: str, e: str) -> DataFrame:
        a, b = F.unix_seconds(F.col(s).cast("timestamp")), F.unix_micros(F.col(e).cast("timestamp"))
        first, last = F.floor(a / width_s).cast("bigint"), F.floor((b - 1) / (width_s * 1_000_000)).cast("bigint")
        return df.where(F.col(s) < F.col(e)).withColumn("__first", first).withColumn("__b", F.explode(F.sequence(first, last)))

    x, y = spread(left, l_start, l_end), spread(right, r_start, r_end).withColumnRenamed("__first", "__first_r")
    j = x.join(y, [*keys, "__b"]).where((F.col(l_start) < F.col(r_end)) & (F.col(r_start) < F.col(l_end)) & (F.col("__b") == F.greatest("__first", "__first_r")))
    return j.drop("__b", "__first", "__first_r")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys equal each other; the keys come once, from the left."""
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        on = c if on is None else on & c
    return left.join(r, on, how).drop(*[f"__r_{k}" for k in keys])


def pairs_within(df: DataFrame, bucket: list[str], key: str, most: int) -> DataFrame:
    """bucket, a, b (a < b): pairs of keys sharing a bucket of 2 to `most` keys.

    The size of a bucket says whether sharing it means anything, so larger ones are left out, which
    bounds the pairs. Null buckets and keys make no pair; repeated rows count once. A
    bucket column must not be named a or b.
    """
    d = df.select(*bucket, key).dropna().distinct()
    small = d.groupBy(*bucket).agg(F.count("*").alias("__n")).where(F.col("__n").between(2, most)).drop("__n")
    d = d.join(small, bucket)
    return d.withColumnRenamed(key, "a").join(d.withColumnRenamed(key, "b"), bucket).where("a < b")


def chain_roots(df: DataFrame, key: str, parent: str) -> DataFrame:
    """key, root: for each row, the row at the end of its chain of parents, itself where it has none.

    The distance covered doubles each round. A row whose chain ends in a circle has a null root; a
    parent that is no row ends the chain.
    """
    up = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(parent).alias("up"))
    top = up.where("up is null").select("id", F.col("id").alias("root"))
    links = cut(up.where("up is not null").select("id", "up", F.lit(True).alias("moved")), "links")
    n = links.df.count()
    for _ in range(math.ceil(math.log2(n + 1)) + 1 if n else 0):
        over = links.df.select(F.col("id").alias("up"), F.col("up").alias("next"))
        after = cut(links.df.join(over, "up", "left").select("id", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "links")
        links.drop()
        links = after
        if links.df.where("moved").isEmpty():
            break
    low = links.df.select("id", F.when(~F.col("moved"), F.col("up")).alias("root"))
    return top.unionAll(low).select(F.col("id").alias(key), "root")


def not_in(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """SQL's NOT IN: nothing at all if the other side holds a null, and never a null of this side unless the other is empty."""
    o = other.select(F.col(other_column).alias("__o"))
    facts = o.agg(F.count("*").alias("__n"), F.count_if(F.col("__o").isNull()).alias("__nulls"))
    left = df.join(o.where("__o is not null").distinct(), F.col(column) == F.col("__o"), "left_anti")
    return left.crossJoin(F.broadcast(facts)).where((F.col("__n") == 0) | ((F.col("__nulls") == 0) & F.col(column).isNotNull())).drop("__n", "__nulls")
