"""Rebuilding conversations from message rows (problem 5): sessions with roles.

Rows fetched twice become one message; messages are sorted by channel and time through a
range-sorted scan (a channel of any size spreads over tasks), split where the silence is longer
than a gap calibrated on all rows, given roles, and summed up by session and channel. All sums are
combined before their shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.lineage import cut
from tallyloom.operators.ordered import last_value, with_previous

# Wordings of the two directions.
OUTBOUND = ["outbound", "out", "outgoing", "sent", "send", "operator", "from_us", "from us", "to_lead", "assistant"]
INBOUND = ["inbound", "in", "incoming", "received", "receive", "reply", "lead", "from_lead", "from lead", "user"]


def role_of(direction: Column) -> Column:
    """operator, lead, or null where the wording tells no side."""
    d = F.lower(F.regexp_replace(direction, r"^[\s ]+|[\s ]+$", ""))
    return F.when(d.isin(OUTBOUND), "operator").when(d.isin(INBOUND), "lead")


def real_time(at: Column) -> Column:
    """The time, null where it is missing or the zero of a clock (1970 or before)."""
    return F.when(F.year(at) > 1970, at)


def readable(body: Column) -> Column:
    """The text, null where nothing but blanks and invisible signs is in it."""
    return F.when(body.rlike(r"[^\s\p{Z}\p{Cc}\p{Cf}]"), body)


def messages(rows: DataFrame, bodies: bool = True) -> DataFrame:
    """One row a message: conversation_id, message_id, role, at, body (null where no copy has readable text).

    Without `bodies` there is `readable`, a flag, in the place of the text, which then never leaves its scan.

    Rows of one conversation and provider message id are copies; a value in any copy counts, of
    several the one fetched first (then the smallest row id). A row without a provider id is a message of its own.
    Rows without a conversation are left out. Extra columns are ignored.
    """
    first = F.struct("fetched_at", "id")
    r = rows.where(F.col("conversation_id").isNotNull()).select(
        "conversation_id", F.coalesce(F.col("provider_message_id"), F.concat(F.lit("row:"), F.col("id"))).alias("message_id"), "fetched_at", "id",
        role_of(F.col("direction")).alias("role"), real_time(F.col("sent_at")).alias("at"), (readable(F.col("body")) if bodies else readable(F.col("body")).isNotNull()).alias("text"),
    )
    known = [F.min_by(c, F.when(F.col(c).isNotNull(), first)).alias(c) for c in ("role", "at")]
    text = F.min_by("text", F.when(F.col("text").isNotNull(), first)).alias("body") if bodies else F.max("text").alias("readable")
    return r.groupBy("conversation_id", "message_id").agg(*known, text)


def calibrated_gap(gaps: DataFrame, col: str, least: float = 3600.0) -> float:
    """Seconds of silence that part two sessions: the split of all gaps' logarithms with the greatest variance between its sides.

    Computed from one count for each half power of two, so at most some 80 rows reach the driver.
    """
    hist = {r["b"]: r["n"] for r in gaps.where(F.col(col) > 0).groupBy(F.floor(F.log2(F.col(col)) * 2).alias("b")).agg(F.count("*").alias("n")).collect()}
    total, mass = sum(hist.values()), sum(b * n for b, n in hist.items())
    best, at, w, m = 0.0, None, 0, 0.0
    for b in sorted(hist)[:-1]:
        w, m = w + hist[b], m + b * hist[b]
        between = (mass * w / total - m) ** 2 / (w * (total - w))
        if between > best:
            best, at = between, b
    return max(least, 2.0 ** ((at + 1) / 2)) if at is not None else math.inf


def turns(msgs: DataFrame, gap_s: float | None = None, partitions: int | None = None) -> DataFrame:
    """Messages in order, with `new_session` where the silence before them is longer than the gap.

    Messages without a time come first in their conversation, in a session of their own.
    """
    m = with_previous(msgs.withColumn("__untimed", F.col("at").isNotNull()), ["conversation_id"], ["__untimed", "at", "message_id"], ["at"], partitions).drop("__untimed")
    m = cut(m.withColumn("gap_s", (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("prev_at").cast("timestamp"))) / 1e6), "turns").df
    limit = calibrated_gap(m, "gap_s") if gap_s is None else gap_s
    return m.withColumn("new_session", ~F.col("has_prev") | (F.col("prev_at").isNull() & F.col("at").isNotNull()) | F.coalesce(F.col("gap_s") > limit, F.lit(False))).drop("prev_at", "has_prev")


def sessions(turned: DataFrame, partitions: int | None = None) -> DataFrame:
    """Turns with `session_at`, the time of the message that opened their session (null for untimed messages)."""
    m = turned.withColumn("__untimed", F.col("at").isNotNull()).withColumn("__open", F.when(F.col("new_session"), F.col("at")))
    return last_value(m, ["conversation_id"], ["__untimed", "at", "message_id"], "__open", "session_at", partitions).drop("__untimed", "__open")


def session_summary(sess: DataFrame) -> DataFrame:
    """One row a session: counts by role and whether it is kept, that is, every message has a role and a time and both roles speak."""
    g = sess.groupBy("conversation_id", "session_at").agg(
        F.count("*").alias("n_messages"), F.count_if(F.col("role") == "operator").alias("by_operator"), F.count_if(F.col("role") == "lead").alias("by_lead"), F.count_if(F.col("role").isNull()).alias("n_no_role"),
        F.max("at").alias("last_at"), F.max_by("role", F.struct("at", "message_id")).alias("last_role"),
    )
    return g.withColumn("reciprocal", F.col("session_at").isNotNull() & (F.col("n_no_role") == 0) & (F.col("by_operator") > 0) & (F.col("by_lead") > 0))


def conversation_verdicts(summary: DataFrame) -> DataFrame:
    """One row a conversation, from its sessions: n_messages, n_sessions, by_operator, by_lead, n_no_role, n_no_time, last_role, kept.

    Kept are conversations in which every message has a role and a time, both roles speak, and the
    last session does not end with the lead's word.
    """
    untimed = F.col("session_at").isNull()
    v = summary.groupBy("conversation_id").agg(
        F.sum("n_messages").alias("n_messages"), F.count("*").alias("n_sessions"), F.sum("by_operator").alias("by_operator"), F.sum("by_lead").alias("by_lead"), F.sum("n_no_role").alias("n_no_role"),
        F.coalesce(F.sum(F.when(untimed, F.col("n_messages"))), F.lit(0)).alias("n_no_time"), F.max_by("last_role", "session_at").alias("last_role"), F.min("session_at").alias("first_at"), F.max("last_at").alias("last_at"),
    )
    kept = (F.col("n_no_role") == 0) & (F.col("n_no_time") == 0) & (F.col("by_operator") > 0) & (F.col("by_lead") > 0) & (F.col("last_role") != "lead")
    return v.withColumn("kept", F.coalesce(kept, F.lit(False)))


def left_out(rows: DataFrame, gap_s: float | None = None, partitions: int | None = None) -> DataFrame:
    """conversation_id, reason: conversations that are empty, broken or unanswered, by the summaries of their sessions."""
    msgs = cut(messages(rows, bodies=False), "messages").df
    v = conversation_verdicts(session_summary(sessions(turns(msgs.where("readable").drop("readable"), gap_s, partitions), partitions)))
    ids = msgs.select("conversation_id").distinct()
    reason = (
        F.when(F.col("kept").isNull(), "empty").when((F.col("n_no_role") > 0) | (F.col("n_no_time") > 0), "broken")
        .when((F.col("by_operator") == 0) | (F.col("by_lead") == 0), "one side").otherwise("unanswered")
    )
    return ids.join(v, "conversation_id", "left").where("kept is null or not kept").select("conversation_id", reason.alias("reason"))


def rebuilt(rows: DataFrame, gap_s: float | None = None, partitions: int | None = None) -> DataFrame:
    """The messages of kept conversations: conversation_id, session_at, at, message_id, role, body.

    Rows come range-sorted by conversation, time and message, so that files read one after the other
    are the conversations in order; a session begins at `session_at`. Conversations that
    `left_out` names, and messages without readable text, have no row.
    """
    msgs = cut(messages(rows).where("body is not null"), "messages").df
    sess = cut(sessions(turns(msgs.drop("body"), gap_s, partitions), partitions), "sessions").df
    kept = conversation_verdicts(session_summary(sess)).where("kept").select("conversation_id")
    own = ["conversation_id", "message_id"]
    out = sess.join(kept, "conversation_id", "left_semi").select(*own, "session_at", "at", "role").join(msgs.select(*own, "body"), own)
    order = ["conversation_id", "at", "message_id"]
    spread = out.repartitionByRange(partitions, *order) if partitions else out.repartitionByRange(*order)
    return spread.sortWithinPartitions(*order).select("conversation_id", "session_at", "at", "message_id", "role", "body")
