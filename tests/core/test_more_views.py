import datetime as dt

from pyspark.sql import functions as F

from tallyloom.operators.latest import split_top
from tallyloom.plans import upkeep as K
from tallyloom.plans import views as V

T0 = dt.datetime(2025, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_vendor_links_in_the_older_form(spark):
    a = spark.createDataFrame([
        (1, "e1", "s1", "p1", "suspected", "n1", T0, "me", None), (2, "e1", "s2", "p1", "proven", "n2", T0, "me", None), (3, "e2", None, None, None, None, T0, "me", None), (4, "e1", "s1", "p1", "proven", "n", T0, "me", T0), (5, "gone", "s1", "p1", "proven", "n", T0, "me", None),
    ], "id int, subject_edge_id string, evidence_signal_id string, processor_id string, confidence string, notes string, asserted_at timestamp_ntz, asserted_by string, removed_at timestamp_ntz")
    e = spark.createDataFrame([("e1", 10, 20), ("e2", 11, 20)], "id string, from_company_id int, to_company_id int")
    s = spark.createDataFrame([("s1", '{"detection_method": "dns", "evidence_url": "u", "evidence_note": "x"}'), ("s2", "{}")], "id string, payload string")
    p = spark.createDataFrame([("p1", "owner")], "id string, method string")
    got = V.vendor_links(a, e, s, p).select("id", "customer_company_id", "vendor_company_id", "certainty", "detection_method", "evidence_url", "evidence_note")
    assert rows(got) == [(1, 10, 20, "probed", "dns", "u", "x"), (2, 10, 20, "confirmed", "owner", None, "n2"), (3, 11, 20, "confirmed", None, None, None)]


def test_current_plans_lists_and_meetings(spark):
    p = spark.createDataFrame([(1, "v", "a", True, T0), (2, "v", "b", False, T0 + dt.timedelta(1)), (3, None, "c", True, T0), (4, None, "d", True, T0)], "id int, vendor string, plan string, is_current boolean, enriched_at timestamp_ntz")
    assert rows(V.current_plans(p, ["vendor"]).select("vendor", "plan")) == sorted([("v", "a"), (None, "d")], key=str)
    leads = spark.createDataFrame([(1, "a", "u1"), (2, "b", None)], "id int, name string, linkedin_url string")
    src = spark.createDataFrame([(1, "x", None, T0), (1, None, None, T0), (1, "x", None, T0)], "lead_id int, source_type string, source_label string, recorded_at timestamp_ntz")
    got = {r["lead_id"]: r for r in V.provenance(leads, src).collect()}
    assert (got[1]["source_types"], got[1]["source_labels"], got[1]["source_count"]) == (["x", None], [None], 3) and (got[2]["source_types"], got[2]["source_count"]) == ([None], 1)
    m = spark.createDataFrame([(1, 7, T0, "cancelled"), (2, 7, T0 + dt.timedelta(1), "scheduled"), (3, 7, T0 + dt.timedelta(2), "scheduled")], "id int, lead_id int, scheduled_at timestamp_ntz, status string")
    assert rows(V.upcoming(m, "lead_id", "scheduled_at", "2025-01-01", "scheduled").select("lead_id", "id")) == [(7, 2)]


def test_top_rows_of_a_hot_key(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else None, i % 5) for i in range(300)], "id int, k string, s int")
    got = split_top(df, ["k"], [F.desc("s"), F.asc("id")], 4, ["id"])
    want = {i for k in (True, False) for i in sorted((x for x in range(300) if bool(x % 3) is k), key=lambda x: (-(x % 5), x))[:4]}
    assert {r["id"] for r in got.where("is_top").collect()} == want and got.count() == 300 and split_top(df.limit(0), ["k"], [F.asc("id")], 4, ["id"]).count() == 0


def test_voices_by_kind(spark):
    t = spark.createDataFrame([(1, None, 9), (2, 5, None), (3, 6, None), (4, 99, None)], "id int, company_id int, lead_id int")
    c = spark.createDataFrame([(5, "Acme", "acme", False), (6, "Acme Show", "acme-show", True)], "id int, name string, linkedin_slug string, is_showcase boolean")
    l = spark.createDataFrame([(9, "Ann", "https://x/in/ann")], "id int, name string, linkedin_url string")
    p = spark.createDataFrame([(1, 5, None, T0), (2, None, 9, T0), (3, None, 9, None)], "id int, poster_company_id int, poster_lead_id int, posted_at timestamp_ntz")
    got = V.voices(t, c, l, p).select("id", "kind", "name", "canonical_url", "posts_held")
    assert rows(got) == [(1, "person", "Ann", "https://x/in/ann", 2), (2, "company_page", "Acme", "https://www.linkedin.com/company/acme", 1), (3, "showcase_page", "Acme Show", "https://www.linkedin.com/showcase/acme-show", 0), (4, "company_page", None, None, 0)]


def test_costs_without_a_price(spark):
    u = spark.createDataFrame([("a", 3), ("b", 2)], "api string, calls bigint")
    p = spark.createDataFrame([("a", 0.5, T0, 1), ("a", 0.25, T0, 2)], "api string, price double, seen_at timestamp_ntz, id int")
    assert rows(K.usage_costs(u, p, ["api"])) == [("a", 3, 0.25, 0.75), ("b", 2, None, None)]
