import datetime as dt
import random

from tallyloom.operators.history import attribute_history
from tallyloom.operators.ordered import with_previous

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "membership_id string, field string, new_value string, observed_at timestamp_ntz, source string, value int"


def brute(rows):
    groups = {}
    for m, f, v, t, *_ in rows:
        if None in (m, f, t):
            continue
        v = (v or "").strip().lower() or None
        g = groups.setdefault((m, f), {})
        us = int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
        old = g.get(us, None)
        g[us] = max([x for x in (old, v) if x is not None], default=None)
    out = []
    for (m, f), g in groups.items():
        cur, start = None, None
        for us in sorted(g):
            if g[us] != cur:
                if cur is not None:
                    out.append((m, f, cur, start, us))
                cur, start = g[us], us
        if cur is not None:
            out.append((m, f, cur, start, -1))
    return sorted(out)


def some_rows(n, seed=1):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        m = "hot" if r.random() < 0.4 else f"m{r.randrange(12)}"
        rows.append((r.choice([m, m, m, None]) if r.random() < 0.02 else m, r.choice(["role", "state"]), r.choice(["A", " a", "b", "B ", "", "  ", None, "c"]),
                     None if r.random() < 0.01 else T0 + dt.timedelta(hours=r.randrange(400)), "s", 1))
    return rows + rows[: n // 10]


def test_history_equals_brute_force_over_many_partitions(spark):
    rows = some_rows(1500)
    df = spark.createDataFrame(rows, SCHEMA)
    for parts in (1, 3, 40):
        got = sorted(map(tuple, attribute_history([df], ["membership_id", "field"], "observed_at", "new_value", parts).collect()))
        assert got == brute(rows)


def test_history_of_several_sources_and_of_nothing(spark):
    rows = some_rows(300, 2)
    a, b = spark.createDataFrame(rows[:100], SCHEMA), spark.createDataFrame(rows[100:], SCHEMA)
    got = sorted(map(tuple, attribute_history([a, b], ["membership_id", "field"], "observed_at", "new_value", 7).collect()))
    assert got == brute(rows)
    assert attribute_history([a.limit(0)], ["membership_id", "field"], "observed_at", "new_value").count() == 0


def test_with_previous_over_many_partitions(spark):
    rows = [("k" if i % 3 else f"k{i % 5}", i, "v%d" % i) for i in range(400)] + [(None, 1, "x"), (None, 2, None), (None, 3, "y")]
    df = spark.createDataFrame(rows, "k string, t int, v string")
    expected = set()
    last = {}
    for k, t, v in sorted(rows, key=lambda x: (x[0] or "", x[1])):
        expected.add((k, t, v, last.get(k), k in last))
        last[k] = v
    for parts in (1, 60):
        got = {(r["k"], r["t"], r["v"], r["prev_v"], r["has_prev"]) for r in with_previous(df, ["k"], ["t"], ["v"], parts).collect()}
        assert got == expected
