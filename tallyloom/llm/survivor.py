"""Best representative of each duplicate group (problem 4): currency reasoning.

Rows with a timestamp tell which value came after which; over all groups these transitions are
counted, and the majority direction of each pair of values is its precedence; chains of precedences
count, those that lead back do not. Where a row of a group has no timestamp, the group's values are
partially ordered, by the group's own timestamps first and by precedences where those are silent,
and the topologically latest ones (no other value of the group follows them) compete; elsewhere the
latest row wins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.lineage import CutTable, cut
from tallyloom.operators.ordered import merge_versions

# What people type to say nothing.
FILLERS = ["n/a", "n.a.", "na", "none", "null", "nil", "nan", "unknown", "tbd", "tba", "xxx", "xx", "x", "(not set)", "not set", "(none)", "not specified", "not applicable", "undefined", "no data", "test", "empty", "(blank)", "blank", "k.a.", "k. a.", "s/o", "private", "to be defined"]


def real_text(c: Column) -> Column:
    """True where the text names something: neither blank, nor signs only, nor a filler."""
    t = F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))
    return F.coalesce(t.rlike(r"[\p{L}\p{N}]") & ~t.isin(FILLERS), F.lit(False))


def real_profile_url(c: Column) -> Column:
    """True where the URL points at one person's profile: `/in/<slug>` on a profile host, with or without a scheme."""
    return F.coalesce(F.trim(c).rlike(r"(?i)^(?:https?://)?(?:[a-z0-9-]+\.)*linkedin\.[a-z.]+/(?:in|pub)/[^/?#\s]+"), F.lit(False))


def merge_roots(df: DataFrame, key: str, parent: str) -> DataFrame:
    """`root`, `id`: every row of a group of at least two, with the row at the end of its chain.

    A root is a row whose `parent` is null; it is a row of its own group. Chains of any length are
    halved each round. Rows whose chain ends in a circle or at a missing row have no root and are
    left out, as are rows with a null key.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(parent).alias("up"))
    links = cut(rows.where(F.col("up").isNotNull()).distinct().select("id", "up", F.lit(True).alias("moved")), "links")
    n = links.df.count()
    for _ in range(math.ceil(math.log2(n + 1)) + 1 if n else 0):
        over = links.df.select(F.col("id").alias("up"), F.col("up").alias("next"))
        after = cut(links.df.join(over, "up", "left").select("id", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "links")
        links.drop()
        links = after
        if links.df.where("moved").isEmpty():
            break
    tops = rows.where(F.col("up").isNull()).select(F.col("id").alias("root")).distinct()
    low = links.df.where("not moved").select(F.col("up").alias("root"), "id").join(tops, "root", "left_semi")
    return low.unionAll(low.select("root", F.col("root").alias("id")).distinct())


def precedences(rows: DataFrame, group: str, field: str, value: str, time: str) -> DataFrame:
    """`field`, `earlier`, `later`, `net`: of each pair of values that followed one another in some group, the majority direction.

    Only rows with a timestamp teach. A pair seen as often either way has no precedence.
    """
    t = rows.where(F.col(time).isNotNull()).select(F.col(field).alias("field"), F.col(group).alias("grp"), F.col(time).alias("t"), F.col(value).alias("v"))
    steps = merge_versions([t], ["field", "grp"], "t", "v").where("prev_value is not null and value is not null")
    a, b = F.col("prev_value"), F.col("value")
    net = steps.groupBy("field", F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).agg(F.sum(F.when(a < b, 1).otherwise(-1)).alias("net")).where("net != 0")
    up = F.col("net") > 0
    return net.select("field", F.when(up, F.col("lo")).otherwise(F.col("hi")).alias("earlier"), F.when(up, F.col("hi")).otherwise(F.col("lo")).alias("later"), F.abs("net").alias("net"))


def _trimmed(edges: CutTable) -> CutTable:
    """Edges (field, a, b) that lie on or between circles: those whose start nothing leads to, or whose end leads nowhere, are taken off until none is left."""
    n = edges.df.count()
    while n:
        e = edges.df
        led, leads = e.select("field", F.col("b").alias("a")).distinct(), e.select("field", F.col("a").alias("b")).distinct()
        after = cut(e.join(led, ["field", "a"], "left_semi").join(leads, ["field", "b"], "left_semi").select("field", "a", "b"), "trimmed")
        edges.drop()
        edges, was = after, n
        n = edges.df.count()
        if n == was:
            break
    return edges


def circles(prec: DataFrame) -> DataFrame:
    """`field`, `v`, `circle`: the values that lie on a circle of precedences, with a value that names their strongly connected part.

    Values take on the greatest value that leads to them; those of one such colour that lead back
    to it are its part. What is left is trimmed and coloured again. Each round works on the
    distinct pairs of values that may still lie on a circle.
    """
    edges = _trimmed(cut(prec.select("field", F.col("earlier").alias("a"), F.col("later").alias("b")), "edges"))
    parts: list[CutTable] = []
    while not edges.df.isEmpty():
        e = edges.df
        # after the trim every value is the end of an edge
        colour = cut(e.select("field", F.col("b").alias("v")).distinct().withColumn("c", F.col("v")).withColumn("new", F.lit(True)), "colour")
        while not colour.df.where("new").isEmpty():
            told = colour.df.where("new").withColumnRenamed("v", "a").join(e, ["field", "a"]).groupBy("field", F.col("b").alias("v")).agg(F.max("c").alias("m"))
            up = F.coalesce(F.col("m") > F.col("c"), F.lit(False))
            after = cut(colour.df.join(told, ["field", "v"], "left").select("field", "v", F.when(up, F.col("m")).otherwise(F.col("c")).alias("c"), up.alias("new")), "colour")
            colour.drop()
            colour = after
        of = colour.df.select("field", "v", "c")
        own = cut(e.join(of.withColumnRenamed("v", "a"), ["field", "a"]).join(of.select("field", F.col("v").alias("b"), F.col("c").alias("cb")), ["field", "b"]).where("c = cb").select("field", "a", "b", "c"), "own")
        part = cut(of.where("v = c").withColumn("new", F.lit(True)), "part")
        while not part.df.where("new").isEmpty():
            back = own.df.join(part.df.where("new").select("field", F.col("v").alias("b"), "c"), ["field", "b", "c"]).select("field", F.col("a").alias("v"), "c").distinct()
            after = cut(part.df.withColumn("new", F.lit(False)).unionByName(back.join(part.df.select("field", "v"), ["field", "v"], "left_anti").withColumn("new", F.lit(True))), "part")
            part.drop()
            part = after
        parts.append(part)
        done = part.df.select("field", "v")
        rest = own.df.select("field", "a", "b").join(done.withColumnRenamed("v", "a"), ["field", "a"], "left_anti").join(done.withColumnRenamed("v", "b"), ["field", "b"], "left_anti")
        left = cut(rest, "edges")
        for t in (edges, colour, own):
            t.drop()
        edges = _trimmed(left)
    none = prec.select("field", F.col("earlier").alias("v"), F.col("later").alias("circle")).limit(0)
    for t in parts:
        none = none.unionAll(t.df.select("field", "v", F.col("c").alias("circle")))
    return none


def later_values(prec: DataFrame, start: DataFrame) -> DataFrame:
    """`field`, `v`, `w`: the values of `start` that chains of precedences lead to from each of its (field, v); values of one circle are in no order.

    Circles count as one value. One join a step along the chains, from the frontier of the step
    before, until it is empty; no row comes twice.
    """
    on = cut(circles(prec), "circles").df
    name = lambda df, c: df.join(on.select("field", F.col("v").alias(c), F.col("circle").alias(f"{c}_on")), ["field", c], "left").withColumn(c, F.coalesce(f"{c}_on", c)).drop(f"{c}_on")
    e = prec.select("field", F.col("earlier").alias("w"), F.col("later").alias("next"))
    edges = cut(name(name(e, "w"), "next").where("w <> next").select("field", "w", "next").distinct(), "precedences").df
    own = cut(start.select("field", "v").distinct().join(on, ["field", "v"], "left").select("field", "v", F.coalesce("circle", "v").alias("x")), "own").df
    front = own.select("field", "x").distinct().join(edges.withColumnRenamed("w", "x"), ["field", "x"]).select("field", "x", F.col("next").alias("w")).distinct()
    steps = []
    while True:
        steps.append(cut(front, "later"))
        if steps[-1].df.isEmpty():
            break
        front = steps[-1].df.join(edges, ["field", "w"]).select("field", "x", F.col("next").alias("w")).distinct()
    seen = steps[0].df
    for t in steps[1:]:
        seen = seen.unionAll(t.df)
    # only values that occur in a group to be ordered are of use
    seen = seen.join(own.select("field", F.col("x").alias("w")).distinct(), ["field", "w"], "left_semi").distinct()
    out = cut(seen.join(own, ["field", "x"]).select("field", "v", F.col("w").alias("y")).join(own.select("field", F.col("x").alias("y"), F.col("v").alias("w")), ["field", "y"]).select("field", "v", "w"), "order")
    for t in steps:
        t.drop()
    return out.df


def topologically_latest(vals: DataFrame, later: DataFrame) -> DataFrame:
    """The rows of `vals` (g, field, v, t: a group's values, each with its last time or null) that no other value of the group follows.

    A group's own times come first: of its timed values only the last ones remain, and an untimed
    value that precedes any timed one is past. Among the rest, precedences decide. `later` leads
    nowhere back, so that each group keeps a value.
    """
    v = vals.select("g", "field", "v", "t")
    top = v.groupBy("g", "field").agg(F.max("t").alias("top"), F.count("*").alias("n"))
    # a value alone is its group's latest
    one = v.join(top.where("n = 1"), ["g", "field"], "left_semi")
    many = v.join(top.where("n > 1"), ["g", "field"])
    ahead = many.join(later, ["field", "v"]).join(many.select("g", "field", F.col("v").alias("w"), F.col("t").alias("wt"), (F.col("t") == F.col("top")).alias("w_last")), ["g", "field", "w"])
    ahead = cut(ahead.select("g", "field", "v", "t", "w", "wt", "w_last"), "ahead").df
    past = ahead.where("t is null and wt is not null").select("g", "field", "v").distinct()
    left = many.where("t is null or t = top").join(past, ["g", "field", "v"], "left_anti").select("g", "field", "v", "t")
    # followed by a value that is itself still there
    still = ahead.where("wt is null or w_last").join(past.withColumnRenamed("v", "w"), ["g", "field", "w"], "left_anti").where("t is null or wt is null").select("g", "field", "v").distinct()
    return one.unionAll(left.join(still, ["g", "field", "v"], "left_anti"))


def survivors(rows: DataFrame, group: str, key: str, fields: dict[str, Column], time: str, then: list[str]) -> DataFrame:
    """`group`, `field_name`, `key`, `value`: the row each field of a group's surviving record is taken from.

    `fields` tells for each column what a real value is; only rows with one compete. With all
    timestamps there, the row with the latest wins; ties go by the columns `then` (greatest
    first), then by the greatest key. Where a competing row has no timestamp, only rows with a
    topologically latest value compete, those with a timestamp first; precedences that go round in
    a circle order none of its values. A group without a real value has no row. Rows with a null group or key
    are left out; repeated rows change nothing; other columns are ignored.
    """
    long = rows.where(F.col(group).isNotNull() & F.col(key).isNotNull()).select(
        F.col(group).alias("g"), F.col(key).alias("k"), F.col(time).alias("t"), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(then)], F.col(key).alias("k")).alias("rest"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.when(real, F.trim(F.col(f))).alias("v")) for f, real in fields.items()])).alias("e"),
    ).where("e.v is not null").select("g", "k", "t", "rest", "e.field", "e.v")
    long = cut(long, "values").df
    order = F.struct("t", "rest")
    best = cut(long.groupBy("g", "field").agg(F.max_by(F.struct("k", "v"), order).alias("b"), F.max(F.col("t").isNull()).alias("gap")), "best").df
    sure = best.where("not gap").select("g", "field", "b.k", "b.v")
    open_ = best.where("gap").select("g", "field")
    if not open_.isEmpty():
        rivals = long.join(open_, ["g", "field"], "left_semi")
        vals = cut(rivals.groupBy("g", "field", "v").agg(F.max("t").alias("t")), "rivals").df
        later = later_values(precedences(long, "g", "field", "v", "t"), vals)
        latest = topologically_latest(vals, later).select("g", "field", "v")
        won = rivals.join(latest, ["g", "field", "v"], "left_semi").groupBy("g", "field").agg(F.max_by(F.struct("k", "v"), order).alias("b"))
        sure = sure.unionAll(won.select("g", "field", "b.k", "b.v"))
    return sure.select(F.col("g").alias(group), F.col("field").alias("field_name"), F.col("k").alias(key), F.col("v").alias("value"))
