"""Incremental sync (U12, Q34, §2.12): the batch operators, fed by micro-batches.

Every micro-batch is brought to one row a key and written over the current snapshot by the same
column policies as in batch. A batch that is replayed after a failure changes nothing, as the
transforms are idempotent by the provider's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.operators.latest import latest_by
from tallyloom.operators.writes import Policy, new_wins, upsert
from tallyloom.sources.store import Store


def upsert_stream(stream: DataFrame, store: Store, table: str, keys: list[str], newest: list[str], policies: dict[str, Policy], checkpoint: str, default: Policy = new_wins, once: bool = True) -> StreamingQuery:
    """Write a stream over a stored table, by key; with `once`, all that is there, then stop."""

    def step(batch: DataFrame, number: int) -> None:
        new = latest_by(batch.where(" and ".join(f"`{k}` is not null" for k in keys)), keys, newest)
        store.write(table, upsert(store.read(table), new, keys, policies, default) if table in store.tables() else new)

    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()


def without_repeats(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, late: str | None, width: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """Counts by window and keys; a window is given out when the watermark has passed it. Without `late` the stream has a watermark already."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    marked = stream.withWatermark(time, late) if late else stream
    return marked.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def stale(records: DataFrame, fetched_at: str, days: Column, as_of: str) -> DataFrame:
    """Stored answers older than their source allows; a source without a limit never grows stale."""
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col(fetched_at).cast("timestamp"))
    return records.where(F.coalesce(age > days * 86_400_000_000, F.lit(False)))


def unsettled(records: DataFrame, made_at: str, fetched_at: str, settle_days: int, as_of: str) -> DataFrame:
    """Pages to fetch once more: old enough to have settled, but read before they had."""
    day = F.expr(f"INTERVAL {settle_days} DAYS")
    return records.where((F.lit(as_of).cast("timestamp_ntz") >= F.col(made_at) + day) & (F.col(fetched_at) < F.col(made_at) + day))
