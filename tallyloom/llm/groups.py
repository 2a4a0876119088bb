"""Consolidating pairwise matches into groups (problem 3): seed-tree pruning.

Each round, every vertex points its neighbourhood at the neighbourhood's minimum. A vertex that is
nobody's minimum drops out of the graph and hangs below its own minimum in the propagation forest;
the others stay, linked to the least of the minima they heard of. When no edge is left, what never
dropped out is one seed a component, its smallest vertex, and the seeds' identifiers flow down the
forest, last round first. The number of rounds grows with the logarithm of the vertices. Once no
more than `rest` edges are left, one task joins them (a bound on its size, not on the result).

A round costs grouped minima (combined before the shuffle, so that a hub is one row a task) and
equi-joins whose other side has one row a key (AQE splits a hub's partition). Each round is written
to the shared folder, and of what a round told only the vertices that dropped out are kept; nothing
of the graph comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.lineage import CutTable, cut


REST = 20_000


def _joined(edges: DataFrame, kind: str) -> DataFrame:
    """`node`, `group_id` for all but the smallest vertex of each component, of few edges in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict = {}

        def top(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = up[x]
            return x

        for pdf in batches:
            for u, v in zip(pdf["u"], pdf["v"]):
                a, b = top(u), top(v)
                if a != b:
                    up[max(a, b)] = min(a, b)
        rows = [(x, g) for x in list(up) if (g := top(x)) != x]
        yield pd.DataFrame(rows, columns=["node", "group_id"])

    return edges.select("u", "v").coalesce(1).mapInPandas(run, f"node {kind}, group_id {kind}")


def connected_groups(pairs: DataFrame, a: str, b: str, rest: int = REST) -> DataFrame:
    """`node`, `group_id`: each node of at least one pair of two different nodes, with its group's smallest node.

    Rows with a null on either side and rows that pair a node with itself name no link and are
    left out. Repeated and reversed pairs change nothing. Other columns are ignored. No pairs, no
    rows. The order of nodes is that of their type (strings: by bytes).
    """
    x, y = F.col(a), F.col(b)
    live = cut(
        pairs.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")).distinct(), "pairs"
    )
    kind = dict(live.df.dtypes)["u"]
    forest: list[CutTable] = []
    while live.df.count() > (rest if kind in ("string", "int", "bigint") else 0):
        sym = live.df.select("u", "v").unionAll(live.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        told = sym.join(least, "u").select(F.col("v").alias("x"), "m").unionAll(least.select(F.col("u").alias("x"), "m")).distinct()
        low = told.groupBy("x").agg(F.min("m").alias("low"), F.max(F.col("m") == F.col("x")).alias("stays"))
        heard = cut(told.join(low, "x"), "heard")
        # one row a vertex has its minimum: those of vertices that drop out are this round's forest
        forest.append(cut(heard.df.where("m = low and not stays").select(F.col("x").alias("node"), F.col("low").alias("parent")), "forest"))
        after = cut(heard.df.where("m != low").select(F.col("low").alias("u"), F.col("m").alias("v")).distinct(), "pairs")
        live.drop()
        heard.drop()
        live = after
    done = cut(_joined(live.df, kind), "labels")
    live.drop()
    for tree in reversed(forest):
        up = done.df.select(F.col("node").alias("parent"), "group_id")
        step = tree.df.join(up, "parent", "left").select("node", F.coalesce("group_id", "parent").alias("group_id"))
        now = cut(step.unionAll(done.df), "labels")
        done.drop()
        tree.drop()
        done = now
    return done.df.unionAll(done.df.select(F.col("group_id").alias("node"), "group_id").distinct())
