"""Ordered scans over keys of any size.

Both operators send rows through ONE range exchange on (keys, order). A range exchange splits a hot
key over as many partitions as its rows need, which a hash exchange on the key cannot. Each
partition is then read once, in order, in constant memory; what crosses partition borders is at
most two rows a partition and is stitched in a second, tiny step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators.lineage import cut


def _partition() -> int:
    c = TaskContext.get()
    return c.partitionId() if c else 0


def _same(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Equal, where two nulls are equal as well."""
    return ((a == b) | (a.isna() & b.isna())).fillna(False).to_numpy(dtype=bool)


def range_sorted(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by keys, then order. Rows equal in all of these share a partition."""
    cols = [F.col(c) for c in [*keys, *order]]
    spread = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    return spread.sortWithinPartitions(*cols)


def with_previous(df: DataFrame, keys: list[str], order: list[str], carry: list[str], partitions: int | None = None) -> DataFrame:
    """Adds `prev_<c>` for each c in `carry`: its value in the row before, of the same keys, by `order`.

    The first row of a key gets nulls, and so does one whose predecessor holds nulls; `has_prev`
    tells the two apart. Null keys form a key of their own. Ties in `order` follow one another in
    no fixed order, so give an order that is unique where that matters. An empty table gives an
    empty table.
    """
    names = df.columns
    schema = T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in df.schema]
        + [T.StructField(f"prev_{c}", df.schema[c].dataType, True) for c in carry]
        + [T.StructField("has_prev", T.BooleanType()), T.StructField("__part", T.IntegerType()), T.StructField("__kind", T.IntegerType())]
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last = _partition(), None
        for pdf in batches:
            if not len(pdf):
                continue
            before = pdf.shift(1)
            if last is not None:
                before = before.astype(object)
                before.iloc[0] = last.iloc[0].to_numpy(dtype=object)
            same = np.ones(len(pdf), dtype=bool)
            for k in keys:
                same &= _same(pdf[k], before[k])
            first = last is None
            if first:
                same[0] = False
            out = pdf.copy()
            for c in carry:
                out[f"prev_{c}"] = before[c].where(same, None)
            out["has_prev"], out["__part"], out["__kind"] = same, part, 0
            if first:
                out.iloc[0, out.columns.get_loc("__kind")] = 1
            last = pdf.tail(1)
            yield out
        if last is not None:
            out = last.copy()
            for c in carry:
                out[f"prev_{c}"] = None
            out["has_prev"], out["__part"], out["__kind"] = False, part, 2
            yield out

    done = cut(range_sorted(df, keys, order, partitions).mapInPandas(scan, schema), "scan").df
    own = [f.name for f in df.schema]

    def stitch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Two rows a partition, in order: a partition's first row follows the last row of the one before."""
        before = None
        for pdf in batches:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            out = []
            for r in pdf.to_dict("records"):
                if r["__kind"] == 1:
                    same = before is not None and all(r[k] == before[k] for k in keys)
                    out.append({**{c: r[c] for c in own}, **{f"prev_{c}": before[c] if same else None for c in carry}, "has_prev": same})
                else:
                    before = r
            if out:
                yield pd.DataFrame(out, dtype=object)

    border = done.where("__kind >= 1").repartition(1).sortWithinPartitions("__part", "__kind")
    fixed = border.mapInPandas(stitch, T.StructType([f for f in schema if f.name not in ("__part", "__kind")]))
    rest = done.where("__kind = 0").drop("__part", "__kind")
    return rest.unionByName(fixed)


def merge_versions(sources: list[DataFrame], keys: list[str], time: str, value: str, tie: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Versions of a value per key, from any number of update or snapshot tables.

    The tables are sent through one exchange and sorted by (keys, time), so that the sorter's merge
    of their runs is the k-way merge by entity and time; each partition is then read once and a
    version is closed as soon as the payload changes. No history is held in memory.

    Result: the keys, `value`, `prev_value`, `valid_from`, `valid_to` (null while open). A version
    with a null value says that the value was cleared. Rows with a null key or time are left out.
    Of several rows of one key and time the last by `tie` (default: the value, nulls first) counts.
    Repeated rows change nothing. An empty table gives no rows.
    """
    names, keys = keys, [f"__k{i}" for i in range(len(keys))]
    pick = lambda s: s.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.col(time).alias("__t"), F.col(value).alias("__v"), *[F.col(t).alias(f"__tie{i}") for i, t in enumerate(tie or [])])
    rows = pick(sources[0])
    for s in sources[1:]:
        rows = rows.unionByName(pick(s))
    for c in [*keys, "__t"]:
        rows = rows.where(F.col(c).isNotNull())
    if dict(rows.dtypes)["__t"] != "bigint":
        rows = rows.withColumn("__t", F.unix_micros(F.col("__t").cast("timestamp")))
    ties = [f"__tie{i}" for i in range(len(tie or []))] or ["__v"]
    vt = dict(rows.dtypes)["__v"]
    kinds = {k: dict(rows.dtypes)[k] for k in keys}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", value {vt}, prev_value {vt}, t0 bigint, t1 bigint, head boolean, tail boolean, part int"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = _partition()
        held = None  # the last row seen: a later row of the same key and time overrides it
        run = None  # the open run: key, value, start, previous value, is it the partition's first
        first = True

        def close(r: dict, end: int | None, tail: bool) -> dict:
            return {**r["key"], "value": r["value"], "prev_value": r["prev"], "t0": r["t0"], "t1": end, "head": r["head"], "tail": tail, "part": part}

        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            after = pdf.shift(-1)
            dup = pdf["__t"].eq(after["__t"]).to_numpy()
            for k in keys:
                dup &= _same(pdf[k], after[k])
            dup[-1] = True  # held back: its successor is not known yet
            held = pdf.tail(1)
            pdf = pdf[~dup]
            out, run, first = _runs(pdf, keys, run, first, close)
            if out:
                yield pd.DataFrame(out)
        if held is not None:
            out, run, first = _runs(held, keys, run, first, close)
            out.append(close(run, None, True))
            yield pd.DataFrame(out)

    at = [F.col(c) for c in [*keys, "__t"]]
    spread = rows.repartitionByRange(partitions, *at) if partitions else rows.repartitionByRange(*at)
    done = cut(spread.sortWithinPartitions(*at, *ties).mapInPandas(scan, schema), "versions").df
    inner = done.where("not head and not tail").select(*keys, "value", "prev_value", F.col("t0").alias("valid_from"), F.col("t1").alias("valid_to"))

    def stitch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """At most two runs a partition, in order: equal neighbours of one key become one, others close each other."""
        out, cur = [], None
        for pdf in batches:
            for r in pdf.to_dict("records"):
                k = tuple(r[c] for c in keys)
                v = None if _null(r["value"]) else r["value"]
                if cur is not None and cur["k"] == k and not cur["closed"]:
                    if cur["v"] == v:
                        if not r["tail"]:
                            cur["t1"], cur["closed"] = _int(r["t1"]), True
                        continue
                    cur["t1"], prev = _int(r["t0"]), cur["v"]
                else:
                    prev = None if _null(r["prev_value"]) else r["prev_value"]
                if cur is not None:
                    out.append(cur)
                cur = {"k": k, "v": v, "prev": prev, "t0": _int(r["t0"]), "t1": _int(r["t1"]), "closed": not r["tail"]}
        if cur is not None:
            out.append(cur)
        if out:
            yield pd.DataFrame([{**dict(zip(keys, o["k"])), "value": o["v"], "prev_value": o["prev"], "valid_from": o["t0"], "valid_to": o["t1"]} for o in out])

    border_schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", value {vt}, prev_value {vt}, valid_from bigint, valid_to bigint"
    # at most two rows a partition; its first run comes before its last one
    border = done.where("head or tail").repartition(1).sortWithinPartitions("part", F.col("head").desc()).mapInPandas(stitch, border_schema)
    return inner.unionByName(border).select(*[F.col(k).alias(n) for n, k in zip(names, keys)], "value", "prev_value", "valid_from", "valid_to")


def _null(x: object) -> bool:
    return x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x))


def _int(x: object) -> int | None:
    return None if _null(x) else int(x)


def _runs(pdf: pd.DataFrame, keys: list[str], run: dict | None, first: bool, close) -> tuple[list[dict], dict | None, bool]:
    """Closed runs of a sorted batch, and the run left open."""
    out: list[dict] = []
    if not len(pdf):
        return out, run, first
    before = pdf.shift(1)
    same = _same(pdf["__v"], before["__v"])
    key = np.ones(len(pdf), dtype=bool)
    for k in keys:
        key &= _same(pdf[k], before[k])
    change = ~(same & key)
    change[0] = True  # compared with the open run below
    sub = pdf[change]
    ts, vs, ks = sub["__t"].tolist(), sub["__v"].tolist(), list(zip(*[sub[k].tolist() for k in keys]))
    for t, v, k in zip(ts, vs, ks):
        v = None if _null(v) else v
        if run is not None and run["k"] == k:
            if run["value"] == v:
                continue
            out.append(close(run, int(t), False))
            run = {"k": k, "key": dict(zip(keys, k)), "value": v, "prev": run["value"], "t0": int(t), "head": False}
        else:
            if run is not None:
                out.append(close(run, None, False))
            run = {"k": k, "key": dict(zip(keys, k)), "value": v, "prev": None, "t0": int(t), "head": first}
        first = False
    return out, run, first


def valid_text(c: Column) -> Column:
    """Trimmed, in lower case; null where nothing is left."""
    v = F.lower(F.regexp_replace(c, r"^[\s 　]+|[\s 　]+$", ""))
    return F.when(v != "", v)


def last_value(df: DataFrame, keys: list[str], order: list[str], value: str, into: str, partitions: int | None = None) -> DataFrame:
    """Adds `into`: the last non-null `value` at or before the row, of the same keys, by `order`.

    Null where there is none. Null keys form a key of their own. An empty table gives an empty table.
    """
    names, vt = df.columns, df.schema[value].dataType
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema] + [T.StructField(into, vt, True), T.StructField("__part", T.IntegerType()), T.StructField("__kind", T.IntegerType())])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, fill, opening = _partition(), None, None, True
        for pdf in batches:
            if not len(pdf):
                continue
            before = pdf.shift(1)
            if last is not None:
                before = before.astype(object)
                before.iloc[0] = last.iloc[0].to_numpy(dtype=object)
            same = np.ones(len(pdf), dtype=bool)
            for k in keys:
                same &= _same(pdf[k], before[k])
            if last is None:
                same[0] = True
            run = np.cumsum(~same)
            filled = pdf[value].astype(object).groupby(run).ffill()
            filled = filled.where(filled.notna(), None)
            if fill is not None:  # carried over from the batch before
                filled[(run == 0) & filled.isna().to_numpy()] = fill
            out = pdf.copy()
            out[into] = filled
            # kind 1: the partition's first key, and nothing was seen for it yet
            out["__part"], out["__kind"] = part, ((run == 0) & filled.isna().to_numpy() & opening).astype(int)
            yield out
            opening = opening and run[-1] == 0
            last, fill = pdf.tail(1), filled.iloc[-1]
            fill = None if _null(fill) else fill
        if last is not None:
            out = last.copy()
            out[into] = fill
            out["__part"], out["__kind"] = part, 3 if opening and fill is None else 2
            yield out

    done = cut(range_sorted(df, keys, order, partitions).mapInPandas(scan, schema), "filled").df
    kinds = dict(df.dtypes)

    def stitch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, state = [], None
        for pdf in batches:
            for r in pdf.to_dict("records"):
                k = tuple(None if _null(r[f"__k_{c}"]) else r[f"__k_{c}"] for c in keys)
                if state is not None:
                    out.append((r["__p"], *state[0], state[1]))
                v = None if _null(r["__v"]) else r["__v"]
                state = (k, state[1]) if r["__kind"] == 3 and state is not None and state[0] == k else (k, v)
        if out:
            yield pd.DataFrame(out, columns=["__p", *[f"__k_{c}" for c in keys], "__v"])

    tails = done.where("__kind >= 2").select(F.col("__part").alias("__p"), "__kind", *[F.col(k).alias(f"__k_{k}") for k in keys], F.col(into).alias("__v"))
    into_type = dict(done.dtypes)[into]
    # one row a partition
    came = tails.repartition(1).sortWithinPartitions("__p").mapInPandas(stitch, "__p int, " + ", ".join(f"`__k_{k}` {kinds[k]}" for k in keys) + f", __v {into_type}")
    open_ = done.where("__kind = 1")
    on = F.col("__part") == F.col("__p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    fixed = open_.join(came, on, "left").select(*names, F.col("__v").alias(into))
    return done.where("__kind = 0").select(*names, into).unionByName(fixed)
