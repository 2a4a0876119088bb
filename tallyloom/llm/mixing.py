"""Mixing sources to target weights (problem 9): a time-varying curriculum.

Each source's weight is a function of training time whose mean is its target. The total is the
largest one no source's cap on repeats forbids. A source's documents, in a fixed hashed order and
repeated as often as its demand asks, fill its demand; a document's place in that order, in tokens,
is turned into a training time by inverting the integral of the source's weight, and documents are
range-sorted by it. Running sums come from bucket totals; there are as many buckets as keep each
one small, so that a source of any size is spread.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.lineage import cut

BUCKETS, PER_BUCKET = 1024, 1 << 16


def default_tokenizer() -> str:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken")


def token_counts(docs: DataFrame, keep: list[str], text: str, vocabulary: str | None = None) -> DataFrame:
    """`keep` and `tokens`: the tokens of each text under a byte-level BPE vocabulary of ranks (a file path). Null texts have 0."""
    path = vocabulary or default_tokenizer()
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", tokens bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers as P
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding(os.path.basename(path), pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            out = pdf[keep].copy()
            out["tokens"] = [len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in pdf[text]]
            yield out

    return docs.select(*dict.fromkeys([*keep, text])).mapInPandas(run, schema)


def ramps(targets: list[dict], steepness: float = 0.5) -> dict[str, list[tuple[float, float]]]:
    """A weight schedule for each source, as (time, weight) knots: sources that may repeat more often grow, the others shrink.

    Every mean over time is the source's target, and the weights sum to one at any time.
    """
    if not targets:
        return {}
    w = np.array([t["target_weight"] for t in targets], dtype=float)
    r = np.array([t["max_repeats"] for t in targets], dtype=float)
    lean = r - (w * r).sum() / w.sum()
    lean = steepness * lean / max(1e-12, np.abs(lean).max())
    return {t["source"]: [(0.0, float(x * (1 - a))), (1.0, float(x * (1 + a)))] for t, x, a in zip(targets, w, lean)}


def invert(knots: list[tuple[float, float]], done: np.ndarray) -> np.ndarray:
    """The times at which a source has met the shares `done` of its demand, its weight being linear between knots."""
    t = np.array([k[0] for k in knots])
    w = np.array([k[1] for k in knots])
    area = np.concatenate([[0.0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(t))])
    need = np.clip(done, 0, 1) * area[-1]
    i = np.clip(np.searchsorted(area, need, side="right") - 1, 0, len(t) - 2)
    slope, w0, c = (w[i + 1] - w[i]) / (t[i + 1] - t[i]), w[i], need - area[i]
    root = np.sqrt(np.maximum(w0 * w0 + 2 * slope * c, 0))
    # (sqrt(w0^2 + 2 s c) - w0) / s, written so that it holds for s = 0 as well
    return t[i] + 2 * c / np.maximum(root + w0, 1e-300)


def plan(counted: DataFrame, targets: DataFrame) -> tuple[DataFrame, list[dict]]:
    """The bucketed documents of the target sources, and for each source (`targets` has one row each) its tokens, demand and whole repeats."""
    want = [r.asDict() for r in targets.where("source is not null and target_weight > 0 and max_repeats > 0").collect()]
    docs = counted.where((F.col("tokens") > 0) & F.col("source").isin([t["source"] for t in want]))
    docs = cut(docs.withColumn("place", F.xxhash64(F.col("doc_id").cast("string"))), "counted").df
    have = {r["source"]: (r["n"], r["d"]) for r in docs.groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("d")).collect()}
    most = max((d for _, d in have.values()), default=0)
    buckets = max(BUCKETS, 1 << math.ceil(math.log2(most / PER_BUCKET + 1)))
    docs = docs.withColumn("bucket", F.pmod(F.shiftright("place", 24), F.lit(buckets)))
    want = [t for t in want if t["source"] in have]
    scale = sum(t["target_weight"] for t in want)
    for t in want:
        t["tokens"], t["documents"] = have[t["source"]]
        t["share"] = t["target_weight"] / scale
    total = min((t["tokens"] * t["max_repeats"] / t["share"] for t in want), default=0.0)
    for t in want:
        t["demand"] = t["share"] * total
        t["total"] = total
    return docs, want


def mix(docs: DataFrame, targets: DataFrame, schedule: dict[str, list[tuple[float, float]]] | None = None, vocabulary: str | None = None) -> tuple[DataFrame, list[dict]]:
    """(uses of documents, plan by source). A use: doc_id, source, copy (from 0), tokens, at (training time, 0 to 1), position (in tokens).

    Uses come range-partitioned and sorted by position. A document is used when its tokens begin
    before the source's demand ends, and never more than `max_repeats` times: a source ends at most
    one document beyond its demand. Documents of no target source, and empty ones, are not used;
    targets without documents are dropped and the others' weights scaled up.
    """
    counted = token_counts(docs.where("source is not null and doc_id is not null"), ["doc_id", "source"], "text", vocabulary)
    placed, want = plan(counted, targets)
    spark = docs.sparkSession
    knots = schedule or ramps(want)
    facts = spark.createDataFrame([(t["source"], float(t["demand"]), int(t["tokens"]), int(t["max_repeats"]), float(t["total"])) for t in want], "source string, demand double, all_tokens bigint, most int, total double")
    # one row a bucket and source: running sums of bucket totals, then of the few documents within a bucket
    sums = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    w = "PARTITION BY source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    before = sums.selectExpr("source", "bucket", f"coalesce(sum(n) OVER ({w}), 0) AS before")
    inner = placed.selectExpr("*", "coalesce(sum(tokens) OVER (PARTITION BY source, bucket ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside")
    d = inner.join(before, ["source", "bucket"]).join(F.broadcast(facts), "source").withColumn("begin", F.col("before") + F.col("inside"))
    copies = F.least(F.col("most"), F.ceil((F.col("demand") - F.col("begin")) / F.col("all_tokens")).cast("int"))
    uses = d.where("begin < demand").select("doc_id", "source", "tokens", "demand", "total", "begin", "all_tokens", F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1)).alias("copy"))
    uses = uses.withColumn("done", (F.col("begin") + F.col("copy") * F.col("all_tokens") + F.col("tokens") / 2) / F.col("demand"))

    @F.pandas_udf("double")
    def at(source: pd.Series, done: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=source.index)
        for s in source.unique():
            here = source == s
            out[here] = invert(knots[s], done[here].to_numpy())
        return out

    uses = uses.withColumn("at", at("source", "done"))
    out = uses.select("doc_id", "source", "copy", "tokens", "at", (F.col("at") * F.col("total")).alias("position"))
    return out.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy"), want


def shares(uses: DataFrame, want: list[dict]) -> DataFrame:
    """One row a source: its target and the share really reached, in tokens, with uses, documents and the most uses of a document."""
    spark = uses.sparkSession
    per_doc = uses.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    got = per_doc.groupBy("source").agg(F.sum("tokens").alias("tokens_used"), F.sum("n").alias("n_uses"), F.count("*").alias("n_documents"), F.max("n").alias("most_uses"))
    facts = spark.createDataFrame([(t["source"], float(t["share"]), int(t["tokens"])) for t in want], "source string, target double, tokens_there bigint")
    # one row a source, so that a window over all of them is small
    got = got.withColumn("all_used", F.sum("tokens_used").over(Window.partitionBy(F.lit(1))))
    return facts.join(got, "source", "left").select("source", "target", F.coalesce(F.col("tokens_used") / F.col("all_used"), F.lit(0.0)).alias("share"), "tokens_there", "tokens_used", "n_uses", "n_documents", "most_uses")
