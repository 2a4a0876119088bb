import math

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.01"
WHOLE = {"monitoring_conflicts": "supplier", "target_posts": "customer", "match_states": "customer", "sql_classifier": "customer"}


def plain(rows):
    return sorted((tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else str(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", WHOLE)
def test_whole_target_tables(spark, name):
    con = duckdb.connect()
    for t in ("customer", "supplier", "orders", "lineitem", "nation", "region", "part", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    got = plain(map(tuple, entry.queries()[name](spark, DIR).select(cols).collect()))
    assert got == plain(want.fetchall()) and len(got) >= con.execute(f"SELECT count(*) FROM {WHOLE[name]}").fetchall()[0][0]
