import datetime as dt

import pytest

pytest.importorskip("tallyloom.llm")
from tallyloom.llm import conversations as C  # noqa: E402

T0 = dt.datetime(2024, 5, 1)
SCHEMA = "id string, conversation_id string, provider_message_id string, direction string, sent_at timestamp_ntz, body string, fetched_at timestamp_ntz, role string"


def m(i, c, p, d, h, body, f=0):
    at = h if isinstance(h, dt.datetime) or h is None else T0 + dt.timedelta(hours=h)
    return (f"r{i}", c, p, d, at, body, T0 + dt.timedelta(days=f), "clash")


ROWS = [
    m(1, "good", "a", "outbound", 0, "hi"), m(2, "good", "b", "INBOUND ", 1, "yes"), m(3, "good", "c", "sent", 2, "fine"), m(4, "good", "d", "inbound", 3, "  \n"),
    m(5, "unanswered", "a", "out", 0, "hi"), m(6, "unanswered", "b", "received", 1, "well?"),
    m(7, "one side", "a", "out", 0, "hi"), m(8, "one side", "b", "out", 1, "hi again"),
    m(9, "no side", "a", "out", 0, "hi"), m(10, "no side", "b", "?", 1, "x"), m(11, "no side", "c", "in", 2, "x"), m(12, "no side", "d", "out", 3, "x"),
    m(13, "no time", "a", "out", dt.datetime(1970, 1, 1), "hi"), m(14, "no time", "b", "in", 2, "x"), m(15, "no time", "c", "out", 3, "x"),
    m(16, "empty", "a", "out", 0, None), m(17, "empty", "b", "in", 0, "​"),
    # a later copy of the same message brings the side and the time
    m(18, "copies", "a", None, None, "hi"), m(19, "copies", "a", "out", 0, None, 1), m(20, "copies", "b", "in", 1, "ok"), m(21, "copies", "c", "out", 2, "👍"),
    m(22, None, "a", "out", 0, "hi"), m(23, "no id", None, "out", 0, "hi"), m(24, "no id", None, "in", 1, "hi"), m(25, "no id", None, "out", 2, "x" * 100_000),
]


def test_left_out(spark):
    df = spark.createDataFrame(ROWS + ROWS[:4], SCHEMA)
    for parts in (None, 12):
        got = {(r[0], r[1]) for r in C.left_out(df, partitions=parts).collect()}
        assert got == {("unanswered", "unanswered"), ("one side", "one side"), ("no side", "broken"), ("no time", "broken"), ("empty", "empty")}
    assert C.left_out(df.limit(0)).count() == 0


def test_sessions_split_at_gaps(spark):
    rows = [m(i, "c", f"p{i}", "out" if i % 2 else "in", h, "x") for i, h in enumerate([0, 1, 2, 100, 101, 300])] + [m(50, "d", "q", "out", 5, "x"), m(51, "d", "q2", "in", None, "x")]
    msgs = C.messages(spark.createDataFrame(rows, SCHEMA))
    for parts in (None, 9):
        s = C.session_summary(C.sessions(C.turns(msgs, 3600 * 5, parts), parts)).collect()
        assert sorted(((r["conversation_id"], r["n_messages"], r["reciprocal"]) for r in s)) == [("c", 1, False), ("c", 2, True), ("c", 3, True), ("d", 1, False), ("d", 1, False)]


def test_gap_is_calibrated_between_two_kinds(spark):
    df = spark.createDataFrame([(float(60 * (1 + i % 5)),) for i in range(100)] + [(float(86400 * (5 + i % 9)),) for i in range(40)] + [(None,), (0.0,)], "g double")
    assert 3600 <= C.calibrated_gap(df, "g") <= 86400 * 5
    assert C.calibrated_gap(df.limit(0), "g") == float("inf")


def test_kept_conversations_come_in_order(spark):
    df = spark.createDataFrame(ROWS + ROWS[:4], SCHEMA)
    for parts in (None, 7):
        got = [(r["conversation_id"], r["role"], r["body"][:9]) for r in C.rebuilt(df, partitions=parts).collect()]
        assert got == [("copies", "operator", "hi"), ("copies", "lead", "ok"), ("copies", "operator", "👍"), ("good", "operator", "hi"), ("good", "lead", "yes"), ("good", "operator", "fine"), ("no id", "operator", "hi"), ("no id", "lead", "hi"), ("no id", "operator", "x" * 9)]
    assert C.rebuilt(df.limit(0)).count() == 0


def test_the_last_session_decides_who_had_the_last_word(spark):
    """However the sessions fall, the verdict on a conversation is that on all of its messages."""
    rows = [m(i, c, f"{c}{i}", d, h, "x") for i, (c, d, h) in enumerate([("a", "out", 0), ("a", "in", 1), ("a", "out", 500), ("b", "out", 0), ("b", "in", 1), ("b", "out", 2), ("b", "in", 900), ("c", "in", 0), ("c", "out", 700)])]
    df = spark.createDataFrame(rows, SCHEMA)
    for gap in (60.0, 3600.0 * 5, None):
        assert {tuple(r) for r in C.left_out(df, gap).collect()} == {("b", "unanswered")}
