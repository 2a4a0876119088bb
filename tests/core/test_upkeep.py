import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import identity
from tallyloom.plans import pipelines as P
from tallyloom.plans import upkeep as K
from tallyloom.plans import views as V

T0 = dt.datetime(2025, 1, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()), key=str)


def test_conditions_as_text(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, x string")
    assert rows(K.where_text(df, "x = 'a' or id > 5"), "id") == [(1,)] and K.where_text(df, " ").count() == 2
    for bad in ("id + 1", "1; drop table t", "nothing = 1"):
        with pytest.raises(Exception):
            K.where_text(df, bad)


def test_counts_where_something_exists(spark):
    df = spark.createDataFrame([("g", 1), ("g", 2), ("h", None), ("g", 1)], "g string, k int")
    m = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert rows(K.count_where_exists(df, ["g"], "k", m, "held")) == [("g", 3, 2), ("h", 1, 0)]


def test_classifier_with_a_callable(spark):
    df = spark.createDataFrame([(1, "cto", "x"), (2, None, "y"), (3, "boom", "z")], "lead_id int, title string, error string")

    def ask(row):
        if row["title"] == "boom":
            raise ValueError("no answer")
        return {"qualified": row["title"] is not None, "persona": row["title"]}

    assert rows(K.classified_by(df, ["title"], ask, "qualified boolean, persona string")) == [(1, True, "cto", None), (2, False, None, None), (3, None, None, "ValueError: no answer")]
    assert K.classified_by(df.limit(0), ["title"], ask, "qualified boolean, persona string").count() == 0


def test_names_from_stored_answers(spark):
    leads = spark.createDataFrame([("a", "https://x/in/ann"), ("b", None), ("c", "https://x/in/cid")], "id string, linkedin_url string")
    calls = spark.createDataFrame([
        ("1", "a", "", '{"person": {"full_name": "Ann Old"}}', True, day(1)), ("2", None, "u=https://x/in/ANN&z", '{"data": {"first_name": "Ann", "last_name": "New"}}', True, day(2)), ("3", "a", "", '{"full_name": "Ann None"}', True, day(3)), ("4", "a", "", '{"full_name": "Later"}', False, day(4)),
        ("5", "b", None, '{"data": {"name": " "}}', True, day(1)), ("6", "c", "", "no json", True, day(1)), ("7", "c", "", None, True, None),
    ], "id string, lead_id string, params string, response string, success boolean, fetched_at timestamp_ntz")
    assert rows(K.repaired_names(leads, calls)) == [("a", "Ann New", "2")]
    assert K.repaired_names(leads.limit(0), calls).count() == 0


def test_member_ids_and_canonical_urls(spark):
    tok = lambda c, n: f"AC{c}AA" + str(n) * 15
    i = spark.createDataFrame([(1, "linkedin_urn", tok("w", 1), True, day(1)), (1, "linkedin_urn", tok("o", 2), False, day(5)), (2, "linkedin_urn_search", tok("w", 3), None, None), (2, "linkedin_urn_search", tok("w", 4), None, day(3)), (3, "linkedin_url", "x", True, day(1))], "lead_id int, kind string, value string, is_primary boolean, created_at timestamp_ntz")
    assert rows(identity.member_ids(i, ["linkedin_urn", "linkedin_urn_search"])) == [(1, tok("o", 2)), (2, tok("w", 4))]
    assert rows(identity.member_ids(i, ["linkedin_urn"]), "lead_id") == [(1,)]
    leads = spark.createDataFrame([(1, "https://www.linkedin.com/in/ann", None, "ann"), (2, "", tok("o", 9), None), (4, "https://www.linkedin.com/in/dan", tok("o", 8), "dan")], "id int, linkedin_url string, member_urn string, public_id string")
    r = spark.createDataFrame([("https://www.linkedin.com/in/new", tok("o", 2)), ("https://www.linkedin.com/in/new", tok("o", 8)), ("https://www.linkedin.com/in/new", tok("o", 9)), ("https://www.linkedin.com/in/new", None), (None, tok("o", 8)), ("http://linkedin.com/in/dan/", None)], "url string, hint string")
    assert rows(identity.canonical_urls(r, "url", "hint", leads, i), "url", "hint", "canonical_url") == sorted([
        ("https://www.linkedin.com/in/new", tok("o", 2), "https://www.linkedin.com/in/ann"), ("https://www.linkedin.com/in/new", tok("o", 8), "https://www.linkedin.com/in/dan"), ("https://www.linkedin.com/in/new", tok("o", 9), "https://www.linkedin.com/in/new"),
        ("https://www.linkedin.com/in/new", None, "https://www.linkedin.com/in/new"), (None, tok("o", 8), None), ("http://linkedin.com/in/dan/", None, "https://www.linkedin.com/in/dan"),
    ], key=str)


def test_index_follows_merges(spark):
    leads = spark.createDataFrame([(1, None, "t1"), (2, 1, "t2"), (3, None, "t2"), (4, None, None)], "id int, merged_into int, member_urn string")
    i = spark.createDataFrame([("linkedin_urn", "t2", 2), ("email", "t9", 1), ("linkedin_urn", None, 4)], "kind string, value string, lead_id int")
    assert rows(K.member_index(i, leads)) == [("t1", 1), ("t2", 1)]


def test_touches_come_once(spark):
    urn = "urn:li:activity:716412978179607062"
    index = spark.createDataFrame([("m1", 1)], "value string, lead_id int")
    posts = spark.createDataFrame([("p1", day(1)), ("p1", None)], "post_key string, posted_at timestamp_ntz")
    e = spark.createDataFrame([("m1", None, "p1", "in", "like", "s", "x"), ("m1", day(5), "p1", "in", "like", "s", "x"), ("m1", None, urn, "in", "like", "s", "y"), ("m1", None, None, "in", "like", "s", None), ("m1", None, None, "in", "like", "s", None), ("m2", day(1), "p1", "in", "like", "s", "z"), ("m1", day(2), "p1", "out", "like", "s", "old")], "member_id string, at timestamp_ntz, post_key string, direction string, kind string, source string, external_id string")
    old = spark.createDataFrame([("s", "old"), ("s", None)], "source string, external_id string")
    got = rows(K.touches(e, posts, index, old), "external_id", "touched_at")
    assert [g[0] for g in got] == ["x", "y", None, None] and got[0][1] == day(1) and got[1][1].year == 1975


def test_short_committees(spark):
    m = spark.createDataFrame([("a", 1, "s1"), ("a", 2, "s1"), ("b", 3, "s2"), ("c", 4, None), ("c", 5, "s2"), ("c", 6, "s2")], "company string, lead_id int, seed string")
    held = spark.createDataFrame([(2,), (3,)], "lead_id int")
    assert rows(K.short_committees(m, held, 3)) == [("a", 1, 2)]
    seeds = spark.createDataFrame([("s1", day(1)), ("s2", day(9))], "seed string, sent_on timestamp_ntz")
    assert rows(K.short_committees(m, held, 4, seeds, "2025-01-05")) == [("c", 3, 3)]


def test_memberships_keep_their_identity(spark):
    m = spark.createDataFrame([("c1", 1, "phone", "+1"), ("c1", None, "phone", "+2")], "collective_id string, lead_id int, member_kind string, member_value string")
    r = spark.createDataFrame([("c1", 1, "urn", "u1"), ("c2", 1, "urn", "u1"), ("c1", 2, "urn", "u2")], "collective_id string, lead_id int, member_kind string, member_value string")
    assert rows(K.keep_earlier_identity(r, m)) == [("c1", 1, "phone", "+1"), ("c1", 2, "urn", "u2"), ("c2", 1, "urn", "u1")]


def test_deals_after_a_sync(spark):
    schema = "deal_id int, company_id int, company_name string, match_slug string, match_domain string, stage_name string, is_open boolean, is_won boolean, amount double, is_deleted boolean, deleted_at timestamp_ntz, synced_at timestamp_ntz"
    state = spark.createDataFrame([(1, 7, "Acme", "acme", None, "s1", True, False, 5.0, True, day(1), day(1)), (2, None, "B", None, None, "s1", True, False, 1.0, False, None, day(1))], schema)
    companies = spark.createDataFrame([(3, "Beta", "https://www.beta.example/about"), (4, None, "beta.example.org"), (5, "x_y", None)], "id int, linkedin_slug string, website string")
    deals = spark.createDataFrame([(1, None, None, None, None, False, True, None, 1), (2, "https://linkedin.com/company/BETA/", None, "B2", "s2", True, False, 2.0, 1), (3, None, "http://www.beta.example/x", "C", "s1", True, False, 3.0, 1), (3, None, "beta.example", "C", "s9", True, False, 4.0, 2), (4, None, "nobody.example", None, None, None, None, None, 1)], "deal_id int, page string, domain string, company_name string, stage_name string, is_open boolean, is_won boolean, amount double, seq int")
    got = {r["deal_id"]: r for r in K.sync_deals(state, deals, companies, F.lit(day(9))).collect()}
    assert (got[1]["company_id"], got[1]["stage_name"], got[1]["is_won"], got[1]["amount"], got[1]["is_deleted"], got[1]["deleted_at"]) == (7, "s1", True, None, False, None)
    assert got[2]["company_id"] == 3 and got[2]["company_name"] == "B2" and got[3]["company_id"] == 3 and got[3]["amount"] == 4.0 and got[4]["company_id"] is None


def test_effects_of_new_messages(spark):
    s = "lead_id int, provider_message_id string, sent_at timestamp_ntz, role string"
    new = spark.createDataFrame([(1, "m1", day(1), "lead"), (1, "m2", day(3), "lead"), (2, "old", day(4), "lead"), (3, "m3", day(5), "operator"), (4, "m4", day(6), "lead"), (None, "m5", day(6), "lead")], s)
    old = spark.createDataFrame([(2, "old", day(4), "lead")], s)
    tags = spark.createDataFrame([(4, "they:replied")], "lead_id int, tag string")
    members = spark.createDataFrame([(1, "staged", day(0)), (1, "meeting_booked", day(0)), (2, "staged", day(0)), (4, "completed", day(0)), (5, None, None)], "lead_id int, status string, last_status_at timestamp_ntz")
    add, after = K.message_effects(new, old, tags, members, over=("completed",))
    assert rows(add, "lead_id", "tagged_at") == [(1, day(1))]
    assert rows(after, "lead_id", "status") == [(1, "meeting_booked"), (1, "replied"), (2, "staged"), (4, "completed"), (5, None)]


def test_decisions_meetings_and_reminders(spark):
    cur = spark.createDataFrame([("a", True), ("b", None)], "chat_id string, monitor boolean")
    want = spark.createDataFrame([("a", True), ("b", None), ("b", True), ("c", None)], "chat_id string, monitor boolean")
    assert rows(K.changed_decisions(cur, want, "chat_id", "monitor")) == [("b", True), ("c", None)]
    m = spark.createDataFrame([(1, day(1), "scheduled", None), (1, day(2), "scheduled", "[]"), (1, day(3), "held", None), (2, day(1), "scheduled", '[{"kind":"a"}]')], "lead_id int, scheduled_at timestamp_ntz, status string, reminders_sent string")
    n = spark.createDataFrame([(1, day(2)), (3, day(9))], "lead_id int, scheduled_at timestamp_ntz")
    assert rows(K.reschedule(m, n), "lead_id", "scheduled_at", "status") == sorted([(1, day(1), "rescheduled"), (1, day(2), "scheduled"), (1, day(3), "held"), (2, day(1), "scheduled"), (3, day(9), "scheduled")], key=str)
    assert rows(K.cancel(m, n), "lead_id", "status") == [(1, "cancelled"), (1, "cancelled"), (1, "held"), (2, "scheduled")]
    r = K.with_reminder(m, spark.createDataFrame([(1, "24h", "t"), (2, "24h", "t")], "lead_id int, kind string, at string"))
    got = {(x["lead_id"], x["scheduled_at"]): x["reminders_sent"] for x in r.collect()}
    assert [len(json.loads(got[k])) for k in ((1, day(1)), (1, day(2)), (2, day(1)))] == [1, 1, 2] and got[1, day(3)] is None


def test_json_merge(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": [1]}}', '{"a": "x", "d": null}'), (None, '{"a": 1}'), ('{"a": 1}', None), ("broken", None)], "o string, n string")
    got = [json.loads(r[0]) for r in df.select(K.merged_json(F.col("o"), F.col("n"))).collect()]
    assert got == [{"a": "x", "b": {"c": [1]}, "d": None}, {"a": 1}, {"a": 1}, {}]


def test_records_operators_tokens_and_posts(spark):
    o = spark.createDataFrame([("i", None, "t")], "kind string, whom int, note string")
    n = spark.createDataFrame([("i", None, "again"), ("i", 2, "b"), ("i", 2, "a")], "kind string, whom int, note string")
    got = K.recorded_once(o, n, ["kind", "whom"], ["kind", "whom", "note"])
    assert rows(got) == sorted([("i", None, "t"), ("i", 2, "a")], key=str) and K.named_in(got, ["kind", "whom"], "2").count() == 1
    ops = spark.createDataFrame([("Ann", "mail", "a@x.example", False)], "name string, channel string, identifier string, active boolean")
    acc = spark.createDataFrame([("Ann", "MAIL", None, None, "A@x.example"), ("Bob", "whatsapp", "b", "+49 30 5550153", None), ("Cid", "mail", None, None, " ")], "name string, kind string, username string, phone string, mail string")
    assert rows(K.registered(ops, acc)) == [("Ann", "mail", "a@x.example", True), ("Bob", "whatsapp", "+49305550153", True)]
    leads = spark.createDataFrame([(1, None), (2, None), (3, "t3"), (4, None)], "id int, member_urn string")
    f = spark.createDataFrame([(1, "t1"), (2, "t1"), (4, "t3"), (3, "t9"), (4, None)], "lead_id int, token string")
    done, dup = K.token_backfill(f, leads)
    assert rows(done) == [(1, "t1")] and rows(dup) == [(2, 1, "t1"), (4, 3, "t3")]
    st = spark.createDataFrame([("u1", 9, 1)], "post_key string, likes int, comments_count int")
    w = spark.createDataFrame([(None, "u1", None, "5", 7, None, day(1)), ("", None, None, "5", 1, 1, day(1)), (None, None, None, None, 1, 1, day(1))], "urn string, post_urn string, share_urn string, activity_id string, likes int, comments_count int, fetched_at timestamp_ntz")
    assert rows(K.own_posts(st, w)) == [("u1", 7, 1), ("urn:li:activity:5", 1, 1)]


def test_imports_guests_followers(spark):
    leads = spark.createDataFrame([("https://www.linkedin.com/in/ann", "", "Old Co")], "linkedin_url string, name string, company string")
    r = spark.createDataFrame([("http://linkedin.com/in/ann/", "Ann", "New Co", 1), ("https://linkedin.com/in/bob", "Bob", None, 1), (None, "X", "Y", 1)], "url string, name string, company string, connected_on int")
    assert rows(K.imported_people(r, leads, ["name", "company"], "op"), "linkedin_url", "name", "company", "network_of") == [("https://www.linkedin.com/in/ann", "Ann", "Old Co", "op"), ("https://www.linkedin.com/in/bob", "Bob", None, "op")]
    l = spark.createDataFrame([(1, "A@x.example", None), (2, None, "https://www.linkedin.com/in/ann")], "id int, email string, linkedin_url string")
    i = spark.createDataFrame([("email", "Z@x.example", 9)], "kind string, value string, lead_id int")
    g = spark.createDataFrame([("z@x.example", None), ("a@X.example ", None), (None, "@ann"), (None, None)], "email string, url string")
    assert {x[1:] for x in rows(K.guests_matched(g, l, i), "email", "matched_id", "matched_by")} == {(2, "url"), (None, None), (1, "email"), (9, "email_identity")}
    people = spark.createDataFrame([(1, "Ann Bee"), (2, "Cid Dee"), (3, "Cid Dee"), (4, "Eve Fox")], "id int, name string")
    named = spark.createDataFrame([("ann bee", 5), ("Cid Dee", 6), ("Eve Fox", 7)], "name string, followers bigint")
    pay = spark.createDataFrame([(4, '{"follower_count": 50}'), (4, "x")], "lead_id int, payload string")
    assert rows(K.follower_counts(people, named, pay)) == [(1, 5), (4, 50)]


def test_tags_rewrites_chats_and_claims(spark):
    t = spark.createDataFrame([(1, "top"), (1, "other"), (2, "backup")], "lead_id int, tag string")
    n = spark.createDataFrame([(2, "top"), (3, "backup"), (3, "stray")], "lead_id int, tag string")
    assert rows(K.retagged(t, ["top", "backup"], n, spark.createDataFrame([(2,)], "lead_id int"))) == [(1, "other"), (2, "backup"), (3, "backup")]
    assert rows(K.rewritten(t.where("lead_id = 2"), {"tag": F.upper("tag")})) == [(2, "tag", "backup", "BACKUP")]
    c = spark.createDataFrame([("a", "group", day(0), True), ("b", "group", day(9), True), ("c", "direct", None, True), ("d", "group", day(9), False)], "chat_id string, kind string, last_read_at timestamp_ntz, history_complete boolean")
    d = spark.createDataFrame([("c", True), ("a", False)], "chat_id string, monitor boolean")
    assert rows(K.chats_to_read(c, d, {"group": True}, "2025-01-10 01:00:00", 24), "chat_id") == [("c",), ("d",)]
    tok = "ACoAA" + "x" * 15
    old = spark.createDataFrame([(1, "https://www.linkedin.com/in/a", None)], "id int, linkedin_url string, linkedin_urn string")
    new = spark.createDataFrame([(1, "https://www.linkedin.com/in/a", tok), (2, f"https://www.linkedin.com/in/{tok}", None), (3, "https://www.linkedin.com/in/c", "ACwAA1")], "id int, linkedin_url string, linkedin_urn string")
    assert rows(K.changed_identity_claims(old, new)) == [(1, "linkedin_urn", tok), (3, "linkedin_url", "https://www.linkedin.com/in/c"), (3, "linkedin_urn_search", "ACwAA1")]
    leads = spark.createDataFrame([(1, None, "https://www.linkedin.com/in/a", None), (2, 1, "https://www.linkedin.com/in/a", None), (3, None, None, tok)], "id int, merged_into int, linkedin_url string, member_urn string")
    i = spark.createDataFrame([("linkedin_url", "https://www.linkedin.com/in/a", 9), ("linkedin_urn", tok, 3)], "kind string, value string, lead_id int")
    assert rows(K.conflicts_backfilled(leads, i)) == [(1, "linkedin_url", "https://www.linkedin.com/in/a", 9)]


def test_related_companies_and_templates(spark):
    c = spark.createDataFrame([(1, "B"), (2, "A"), (3, "C")], "id int, name string")
    r = spark.createDataFrame([(1, "competitor", "eu"), (2, "competitor", None), (3, "partner", "eu")], "company_id int, relationship string, scope string")
    assert [tuple(x) for x in V.related_companies(c, r, "competitor").select("id", "scope").collect()] == [(2, None), (1, "eu")]
    df = spark.createDataFrame([('{"name": "Ann", "tags": ["x", "y"], "a b": 1}', "hi")], "lead string, word string")
    out = lambda t: df.select(P.render(t, df, {"lead": "lead", "word": "word"})).first()[0]
    assert out("{{ lead.name }}, {{lead.tags[1]}} {{ word }} {{ gone.x }}.{{ 1 + 1 }} {{lead['name']}} {{ open") == "Ann, y hi .{{ 1 + 1 }} Ann {{ open"
