"""Stateful transforms as functions of an old and a new state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Policy = Callable[[Column, Column], Column]


def old_wins(old: Column, new: Column) -> Column:
    """Fill only what is null."""
    return F.coalesce(old, new)


def old_text_wins(old: Column, new: Column) -> Column:
    """Fill what is null or empty."""
    return F.coalesce(F.nullif(old, F.lit("")), new)


def new_wins(old: Column, new: Column) -> Column:
    """A null never erases."""
    return F.coalesce(new, old)


def overwrite(old: Column, new: Column) -> Column:
    return new


def keep(old: Column, new: Column) -> Column:
    return old


def greatest(old: Column, new: Column) -> Column:
    """Counts only grow; nulls are ignored."""
    return F.greatest(old, new)


def least(old: Column, new: Column) -> Column:
    return F.least(old, new)


def either(old: Column, new: Column) -> Column:
    """A flag once set stays set."""
    return F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False))


def union_of(old: Column, new: Column) -> Column:
    """Arrays united without repeats, nulls as empty."""
    return F.array_union(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], policies: dict[str, Policy], default: Policy = new_wins, action: str | None = None) -> DataFrame:
    """The state after writing `new` over `old`: for rows in both, each column by its policy; all others as they are.

    `new` must have one row a key (see `last_in_batch`). Columns that only one side has are filled
    with nulls for the other's rows and taken from where they are. With `action` named, each row
    says `insert`, `update` or `none`. Keys may be null; null keys equal each other. One shuffled
    full outer join; nothing is written in place.
    """
    cols = [c for c in old.columns if c not in keys] + [c for c in new.columns if c not in old.columns]
    o = old.select(*[F.col(k).alias(f"__ok_{k}") for k in keys], F.lit(True).alias("__o"), *[F.col(c).alias(f"__o_{c}") for c in old.columns if c not in keys])
    n = new.select(*[F.col(k).alias(f"__nk_{k}") for k in keys], F.lit(True).alias("__n"), *[F.col(c).alias(f"__n_{c}") for c in new.columns if c not in keys])
    on = None
    for k in keys:
        c = F.col(f"__ok_{k}").eqNullSafe(F.col(f"__nk_{k}"))
        on = c if on is None else on & c
    j = o.join(n, on, "full_outer")
    out = [F.when(F.col("__o"), F.col(f"__ok_{k}")).otherwise(F.col(f"__nk_{k}")).alias(k) for k in keys]
    for c in cols:
        if c not in new.columns:
            out.append(F.col(f"__o_{c}").alias(c))
        elif c not in old.columns:
            out.append(F.col(f"__n_{c}").alias(c))
        else:
            a, b = F.col(f"__o_{c}"), F.col(f"__n_{c}")
            out.append(F.when(F.col("__o") & F.col("__n"), policies.get(c, default)(a, b)).when(F.col("__o"), a).otherwise(b).alias(c))
    if action:
        out.append(F.when(F.col("__o").isNull(), "insert").when(F.col("__n").isNull(), "none").otherwise("update").alias(action))
    return j.select(*out)


def last_in_batch(new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last by `order`."""
    from tallyloom.operators.latest import latest_by

    return latest_by(new, keys, order)


def append_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and those new ones whose key is not there yet; null keys equal each other."""
    on = None
    n, o = new.alias("n"), old.select(*keys).distinct().alias("o")
    for k in keys:
        c = F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
        on = c if on is None else on & c
    return old.unionByName(n.join(o, on, "left_anti").select(*old.columns))


def mark_missing(state: DataFrame, live: DataFrame, key: str, flag: str, at: str, when: Column, among: Column | None = None) -> DataFrame:
    """Rows whose key is no longer among the live ones get the flag and the time; an empty live list changes nothing."""
    ids = live.select(F.col(key).alias("__live")).where("__live is not null").distinct()
    any_ = ids.agg((F.count("*") > 0).alias("__any"))
    j = state.join(ids, F.col(key) == F.col("__live"), "left").crossJoin(F.broadcast(any_))
    gone = F.col("__any") & F.col("__live").isNull() & ~F.coalesce(F.col(flag), F.lit(False))
    if among is not None:
        gone = gone & F.coalesce(among, F.lit(False))
    return j.withColumn("__gone", gone).withColumn(at, F.when(F.col("__gone"), when).otherwise(F.col(at))).withColumn(flag, F.col("__gone") | F.coalesce(F.col(flag), F.lit(False))).select(*state.columns)


def change_log(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, field, old_value, new_value: one row for each field that differs, nulls being values; of rows that are new, those with a value.

    Values are logged as strings. Rows that vanished log nothing.
    """
    o = old.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.lit(True).alias("__o"), *[F.col(f).cast("string").alias(f"__o_{f}") for f in fields])
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        on = c if on is None else on & c
    j = new.select(*keys, *[F.col(f).cast("string").alias(f) for f in fields]).join(o, on, "left")
    e = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__o_{f}").alias("old_value"), F.col(f).alias("new_value")) for f in fields]))
    return j.select(*keys, e.alias("e")).select(*keys, "e.*").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def removals(old: DataFrame, new: DataFrame, keys: list[str], actor: Column, reason: Column, at: Column) -> DataFrame:
    """What a removed row leaves behind: the row with who removed it, why and when."""
    on = None
    o, n = old.alias("o"), new.select(*keys).distinct().alias("n")
    for k in keys:
        c = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        on = c if on is None else on & c
    return o.join(n, on, "left_anti").withColumn("removed_by", actor).withColumn("removed_reason", reason).withColumn("removed_at", at)


def append_history(state: DataFrame, news: DataFrame, key: str, value: str, at: str, history: str) -> DataFrame:
    """State rows with the news' value, time and one more entry in their history, where the value really changes.

    `news` has one row a key: key, value, at. The history is an array of struct<value, at>.
    """
    n = news.select(F.col(key).alias("__k"), F.col(value).alias("__v"), F.col(at).alias("__at"))
    j = state.join(n, F.col(key) == F.col("__k"), "left")
    real = F.col("__k").isNotNull() & ~F.col(value).eqNullSafe(F.col("__v"))
    entry = F.array(F.struct(F.col("__v").alias("value"), F.col("__at").alias("at")))
    old = F.coalesce(F.col(history), F.array().cast(state.schema[history].dataType))
    return j.withColumn(history, F.when(real, F.concat(old, entry)).otherwise(F.col(history))).withColumn(at, F.when(real, F.col("__at")).otherwise(F.col(at))).withColumn(value, F.when(real, F.col("__v")).otherwise(F.col(value))).select(*state.columns)


def departures(listed: DataFrame, now: DataFrame, keys: list[str], left_at: str, at: Column) -> DataFrame:
    """A list of members with `left_at`: set when a member is no longer there, cleared when one is there again, kept otherwise; new members come in."""
    n = now.select(*keys).distinct().withColumn("__now", F.lit(True))
    on = None
    for k in keys:
        c = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        on = c if on is None else on & c
    j = listed.alias("o").join(n.alias("n"), on, "full_outer")
    ks = [F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys]
    rest = [F.col(f"o.{c}").alias(c) for c in listed.columns if c not in (*keys, left_at)]
    gone = F.when(F.col("__now"), F.lit(None)).otherwise(F.coalesce(F.col(f"o.{left_at}"), at))
    return j.select(*ks, *rest, gone.alias(left_at)).select(*listed.columns)
