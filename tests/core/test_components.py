import random

from tallyloom.operators.components import shared_key_groups


def brute(rows):
    up = {r: r for r, *_ in rows if r is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    seen = {}
    for r, *vals in rows:
        for i, v in enumerate(vals):
            if r is not None and v:
                if (i, v) in seen:
                    a, b = top(seen[i, v]), top(r)
                    up[max(a, b)] = min(a, b)
                else:
                    seen[i, v] = r
    return {(r, top(r)) for r in up}


def test_groups_over_shared_identifiers(spark):
    r = random.Random(4)
    rows = [(f"r{i:03d}", r.choice([None, "", *[f"u{k}" for k in range(60)]]), r.choice([None, *[f"u{k}" for k in range(60)]])) for i in range(70)]
    rows += [(f"s{i:03d}", f"c{i}", f"c{i + 1}" if i % 2 else None) for i in range(20)] + [(f"s{i + 1:03d}", f"c{i + 1}", f"c{i}" if i % 2 == 0 else None) for i in range(20)] + [(None, "u1", "u2"), rows[0]]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "id string, mail string, phone string, group_id string")
    assert {tuple(x) for x in shared_key_groups(df, "id", ["mail", "phone"]).collect()} == brute(rows)
    assert shared_key_groups(df.limit(0), "id", ["mail"]).count() == 0
