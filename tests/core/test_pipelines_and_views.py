import datetime as dt
import json

from pyspark.sql import functions as F

from tallyloom.plans import pipelines as P
from tallyloom.plans import views as V

T0 = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_comments_with_replies(spark):
    df = spark.createDataFrame([(1, [("a", "x", [("b", "y")]), ("c", "z", [])]), (2, [])], "post int, cs array<struct<author: string, text: string, replies: array<struct<author: string, text: string>>>>")
    assert rows(P.flat_comments(df, "cs")) == [(1, "a", "x", False), (1, "b", "y", True), (1, "c", "z", False)]


def test_twins_stems_and_withdrawal(spark):
    c = spark.createDataFrame([("g1", "wa", "(N)YC Founders"), ("g2", "wa", "NYC founders!"), ("g3", "wa", "nyc  Founders"), ("g4", "wa", "Lonely One"), ("g5", "tg", "NYC Founders"), ("g6", "wa", "NYC Founders East")], "id string, provider string, name string")
    m = spark.createDataFrame([("g1", i) for i in range(25)] + [("g2", 1)] * 3 + [("g3", 1)] * 9, "collective_id string, x int")
    assert rows(P.twins(c, m)) == [("g1", "g2"), ("g3", "g2")]
    assert rows(P.stems(c)) == [("nyc founders", g) for g in ("g1", "g2", "g3", "g5", "g6")]
    t = spark.createDataFrame([("r", None, None), ("a", "r", "inferred"), ("b", "a", "inferred"), ("s", None, None), ("d", "s", "inferred"), ("e", "s", "decided")], "id string, parent_id string, parent_source string")
    got = {r["id"]: r["parent_id"] for r in P.withdrawn_links(t, spark.createDataFrame([("b",)], "id string")).collect()}
    assert got == {"r": None, "a": "r", "b": "a", "s": None, "d": None, "e": "s"}


def test_dossiers_and_seed_benches(spark):
    l = spark.createDataFrame([("1", '["u1","u2"]'), ("2", None)], "id string, seeds string")
    tags = spark.createDataFrame([("1", 2, "b"), ("1", 1, "a")], "lead_id string, at int, tag string")
    d = {r["id"]: json.loads(r["tags"]) for r in P.dossiers(l, {"tags": (tags, "lead_id", ["at", "tag"])}).collect()}
    assert d == {"1": [{"at": 1, "tag": "a"}, {"at": 2, "tag": "b"}], "2": []}
    b = spark.createDataFrame([("u1", "Ann"), ("u2", "Bob"), ("u2", "Ann"), ("u9", "Cy")], "url string, who string")
    assert [tuple(r) for r in P.bench_counts(l, "seeds", b, "url", "who").select("id", "values", "n_seeds").orderBy("id").collect()] == [("1", "Ann | Bob", 2), ("2", None, 0)]


def test_people_and_evidence(spark):
    m = spark.createDataFrame([("m1", "Ann", "p1", "+1"), ("m1", "+1 555", "p1", "+1"), ("m2", "+44", None, "+2"), ("m3", "Cy", None, None)], "member_id string, name string, provider string, phone string")
    i = spark.createDataFrame([("phone", "+1", "L9"), ("provider", "p1", "L1"), ("phone", "+2", "L2")], "kind string, value string, lead_id string")
    assert rows(P.chat_people(m, i, ["provider", "phone"])) == [("m1", "L1", "Ann"), ("m2", "L2", None), ("m3", None, "Cy")]
    f = spark.createDataFrame([("L1", "t1", "Ann Bee"), ("L2", "t2", "Zed"), ("L3", "t3", "Cy"), ("L3", "t4", "Cy")], "lead_id string, token string, answered_name string")
    l = spark.createDataFrame([("L1", "ann x"), ("L2", "Bob"), ("L3", "Cy")], "id string, name string")
    assert rows(P.sole_evidence(f, f.where("lead_id = 'L1'"), l)) == [("L1", "t1", "ann x", "Ann Bee")]
    c = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "chat_id string, changed_at int")
    assert [r["chat_id"] for r in P.to_sync(c, spark.createDataFrame([("a", 5), ("b", 4)], "chat_id string, last_synced_at int")).orderBy("chat_id").collect()] == ["b", "c"]


def test_state_pipelines(spark):
    old = spark.createDataFrame([("p1", "a"), ("p1", "b"), ("p2", "c")], "post string, who string")
    new = spark.createDataFrame([("p1", "b"), ("p1", "d")], "post string, who string")
    assert rows(P.replace_groups(old, new, "post")) == [("p1", "b"), ("p1", "d"), ("p2", "c")]
    l = spark.createDataFrame([("1", "", "Oslo"), ("2", "CTO", None)], "id string, title string, city string")
    v = spark.createDataFrame([("1", T0, "a", '{"title":"CEO","city":"Rome"}'), ("2", T0, "b", '{"city":"Bern"}'), ("2", T0 + dt.timedelta(1), "c", '{"city":""}')], "lead_id string, qualified_at timestamp, id string, full_result string")
    assert rows(P.fill_from_verdicts(l, v, {"title": "title", "city": "city"})) == [("1", "CEO", "Oslo"), ("2", "CTO", None)]
    a = spark.createDataFrame([("s", None, "x", None), ("t", "k", "y", None), ("u", "k", "z", None)], "subject string, key string, value string, removed_at string")
    n = spark.createDataFrame([("s", None, "x2"), ("t", "k", "y"), ("w", "k", "q")], "subject string, key string, value string")
    assert rows(P.supersede(a, n, ["subject", "key"], F.lit("now"))) == sorted([("s", None, "x", "now"), ("s", None, "x2", None), ("t", "k", "y", None), ("u", "k", "z", None), ("w", "k", "q", None)], key=str)


def test_text_pipelines(spark):
    df = spark.createDataFrame([('{"a":{"b":["x","y"]},"n":3}', "Acme Planning, Inc.")], "lead string, name string")
    assert df.select(P.render("Hi {{ lead.a.b[1] }} {{lead.n}}{{ lead.zz }}{{ nobody.x }}!", df, {"lead": "lead"}).alias("t")).first()["t"] == "Hi y 3!"
    sp = spark.createDataFrame([("p", "José Núñez", "CTO", "Acme"), ("p", "Nobody", "CTO", "Acme")], "page_id string, name string, title string, company string")
    pg = spark.createDataFrame([("p", "Speakers: josé núñez, CTO. " + "x" * 400 + " Acme")], "page_id string, text string")
    assert [tuple(r) for r in P.visible_speakers(sp, pg).select("name", "title", "company").collect()] == [("José Núñez", "CTO", None)]


def test_views_over_fixtures(spark):
    mk = spark.createDataFrame
    ids = mk([("li", "ann", "L1"), ("li", "bob", "L2"), ("op", "x", "L9")], "kind string, value string, lead_id string")
    leads = mk([("L1", "Ann", "u", "c", "t"), ("L2", "Bob", "u", "c", "t")], "id string, name string, linkedin_url string, current_company string, current_title string")
    assert V.identities_of(ids, leads).count() == 2
    intro = mk([("1", "li", "ann", "li", "bob", None, None, "Op"), ("2", "li", "zed", "li", "bob", "li", "ann", None)], "id string, by_kind string, by_value string, whom_kind string, whom_value string, to_kind string, to_value string, to_operator string")
    assert rows(V.introductions(intro, ids, leads).select("id", "by_name", "whom_name", "to_name")) == [("1", "Ann", "Bob", "Op"), ("2", None, "Bob", "Ann")]
    co = mk([("C1", "Acme"), ("C2", "Bolt")], "id string, name string")
    links = mk([("1", "li", "ann", "C1", "C2", None), ("2", "li", "bob", "C1", None, T0)], "id string, person_kind string, person_value string, company_id string, via_company_id string, retired_at timestamp")
    assert rows(V.company_links(links, ids, leads, co).select("id", "person_name", "company_name", "via_company")) == [("1", "Ann", "Acme", "Bolt")]
    a = mk([("1", "L1", None, "observation", None, "S1", None, None, T0, None), ("2", None, "C1", "observation", None, None, "E1", None, T0, None), ("3", "L1", None, "decision", "why", None, None, None, T0, None), ("4", "L1", None, "decision", "x", None, None, T0, T0, T0)],
           "id string, subject_lead_id string, subject_company_id string, kind string, notes string, evidence_signal_id string, evidence_enrichment_call_id string, decided_at timestamp, asserted_at timestamp, removed_at timestamp")
    s, e = mk([("S1", T0, "enr")], "id string, enriched_at timestamp, enricher_name string"), mk([("E1", T0, "api", "people")], "id string, fetched_at timestamp, api string, endpoint string")
    assert rows(V.observations(a, s, e, ["lead", "company"]).select("id", "subject_type", "subject_id", "evidence_source")) == [("1", "lead", "L1", "enr"), ("2", "company", "C1", "api people")]
    assert rows(V.decisions(a, ["lead", "company"]).select("id", "reason", "decided_at")) == [("3", "why", T0)]
    ch = mk([("c", "o", "T")], "id string, operator_id string, title string")
    d = mk([("1", "c", True, T0), ("2", "c", False, T0), ("3", "zz", True, T0)], "id string, chat_id string, monitor boolean, decided_at timestamp")
    assert rows(V.chat_monitoring(d, ch).select("chat_id", "monitor", "title")) == [("c", False, "T")]
    assert V.active(a).count() == 3
