import datetime as dt
import inspect
import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import merge
from tallyloom.operators.writes import greatest
from tallyloom.sources import files
from tallyloom.sources.store import Store, as_json_rows, run_report, status_matrix
from tallyloom.streaming import incremental

T0 = dt.datetime(2024, 1, 1)
LEADS = "id string, linkedin_url string, linkedin_urn string, member_urn string, public_id string, name string, headline string, current_title string, current_company string, current_company_url string, city string, country string, bio string, email string, last_enriched_at timestamp, merged_into string, created_at timestamp, updated_at timestamp"
URN = "https://www.linkedin.com/in/ACoAA" + "k" * 15


def lead(i, **kw):
    d = dict.fromkeys([x.split()[0] for x in LEADS.split(", ")])
    return tuple((d | {"id": i, "created_at": T0, "updated_at": T0} | kw).values())


def state(spark):
    mk = spark.createDataFrame
    return {
        "leads": mk([lead("K", linkedin_url=URN, name="Ann", email="ann@a.example"), lead("D", linkedin_url="https://www.linkedin.com/in/ann", public_id="ann", name="Ann B", city="Oslo", email="Ann2@a.example"), lead("D2", linkedin_url="https://www.linkedin.com/in/ann2", headline="hi"), lead("X", name="Else"), lead("M", merged_into="X")], LEADS),
        "lead_identities": mk([("i1", "K", "linkedin_urn", "u1", True, None), ("i2", "D", "linkedin_url", "ann", True, None), ("i3", "D2", "linkedin_urn", "u2", True, None)], "id string, lead_id string, kind string, value string, is_primary boolean, source string"),
        "lead_identity_conflicts": mk([("c1", "D", "linkedin_urn", "u1", "K", None), ("c2", "D2", "linkedin_urn", "u1", "K", None), ("c3", "X", "linkedin_url", "ann", "D", None), ("c4", "D", "email", "e", "X", None)], "id string, lead_id string, kind string, value string, owner_lead_id string, resolved_by_merge string"),
        "lead_tags": mk([("t1", "K", "a", None), ("t2", "D", "a", None), ("t3", "D", "b", None), ("t4", "D", "flag:duplicate_lead", None), ("t5", "D", "expansion:do_not_push", None), ("t6", "K", "flag:duplicate_lead", "same person as https://www.linkedin.com/in/ann."), ("t7", "K", "expansion:do_not_push", "see https://www.linkedin.com/in/annabel")], "id string, lead_id string, tag string, notes string"),
        "campaign_members": mk([("m1", "K", "c1"), ("m2", "D", "c1"), ("m3", "D", "c2"), ("m4", "D2", "c2")], "id string, lead_id string, campaign_id string"),
        "lead_sources": mk([("s1", "D"), ("s2", "D"), ("s3", "X")], "id string, lead_id string"),
    }


def test_merge_round(spark):
    s = state(spark)
    before = merge.row_counts(s)
    out = merge.merge_round(s, spark.createDataFrame([("D", "K")], "dup string, keeper string"), "tester", "2024-02-02 00:00:00")
    leads = {r["id"]: r for r in out["leads"].collect()}
    assert leads["D"]["merged_into"] == "K" and leads["D"]["linkedin_url"] is None and leads["D"]["email"] is None
    assert leads["K"]["linkedin_url"] == "https://www.linkedin.com/in/ann" and leads["K"]["city"] == "Oslo" and leads["K"]["name"] == "Ann" and leads["K"]["email"] == "ann@a.example"
    tags = {r["id"]: r["lead_id"] for r in out["lead_tags"].collect()}
    assert tags == {"t1": "K", "t2": "D", "t3": "K", "t4": "D", "t5": "D", "t7": "K"}
    assert [r["id"] for r in out["retired_flags"].collect()] == ["t6"]
    assert {r["id"]: r["lead_id"] for r in out["campaign_members"].collect()} == {"m1": "K", "m2": "D", "m3": "K", "m4": "D2"}
    assert {r["id"]: r["lead_id"] for r in out["lead_sources"].collect()} == {"s1": "K", "s2": "K", "s3": "X"}
    ids = {(r["kind"], r["value"]): (r["lead_id"], r["is_primary"]) for r in out["lead_identities"].collect()}
    assert ids[("linkedin_url", "ann")] == ("K", False) and ids[("email", "ann2@a.example")] == ("K", False) and ids[("linkedin_urn", "u1")] == ("K", True)
    c = {r["id"]: r for r in out["lead_identity_conflicts"].collect()}
    assert c["c1"]["resolved_by_merge"] is not None and c["c3"]["owner_lead_id"] == "K" and c["c4"]["lead_id"] == "K" and c["c2"]["resolved_by_merge"] is None
    led = out["lead_merges"].first()
    assert (led["dup_id"], led["keeper_id"], led["email_fate"]) == ("D", "K", "identity") and {x["value"] if "value" in x else x for x in json.loads(led["moved"])} == {"campaign_members.lead_id", "lead_sources.lead_id", "lead_tags.lead_id"}
    after = merge.row_counts({t: out[t] for t in before})
    assert {t: after[t] - n for t, n in before.items()} == {"leads": 0, "lead_identities": 1, "lead_identity_conflicts": 0, "lead_tags": -1, "campaign_members": 0, "lead_sources": 0}


def test_refusals(spark):
    p = spark.createDataFrame([("D", "K"), ("K", "K"), ("M", "K"), ("D", "X"), ("nobody", "K"), (None, "K")], "dup string, keeper string")
    why = {(r["dup"], r["keeper"]): r["refused"] for r in merge.refusals(state(spark), p).collect()}
    assert why == {("D", "K"): None, ("K", "K"): "the same row", ("M", "K"): "already merged", ("D", "X"): "no shared member token", ("nobody", "K"): "no such lead", (None, "K"): "both are required"}


def test_queue_and_rounds(spark):
    s = state(spark)
    score = spark.createDataFrame([("K", 9), ("D", 3), ("D2", 1)], "lead_id string, score int")
    q = merge.merge_queue_pairs(s, score)
    assert sorted((r["dup"], r["keeper"]) for r in q.collect()) == [("D", "K"), ("D2", "K")]
    out = merge.merge_all(s, q, "tester", "2024-02-02 00:00:00")
    assert {r["id"]: r["merged_into"] for r in out["leads"].collect()} == {"K": None, "D": "K", "D2": "K", "X": None, "M": "X"}
    # the second duplicate's membership collides with what the first one brought
    assert {r["id"]: r["lead_id"] for r in out["campaign_members"].collect()} == {"m1": "K", "m2": "D", "m3": "K", "m4": "D2"}
    assert out["lead_merges"].count() == 2


def test_pairs_left_after_the_last_round_are_reported(spark):
    pairs = spark.createDataFrame([("D", "K", 0), ("D2", "K", 1)], "dup string, keeper string, merge_order int")
    out = merge.merge_all(state(spark), pairs, "tester", "2024-02-02 00:00:00", most_rounds=1)
    assert [tuple(r) for r in out["lead_merges_refused"].select("dup", "keeper", "refused").collect()] == [("D2", "K", "not reached in 1 rounds")]
    assert inspect.signature(merge.merge_all).parameters["most_rounds"].default is None


def test_people_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Linkedin url,Linkedin Public URL,First Name,last name,Position,Location,Note\nhttps://www.linkedin.com/in/ACoAAx,http://linkedin.com/in/ann/,Ann,Bee,CTO,Oslo,\"x, \"\"y\"\"\"\n,linkedin.com/in/ann,Other,,CEO,Rome,\n,,No,Url,,,\n", encoding="utf-8")
    raw = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert raw.columns[0] == "Linkedin url"
    got = files.people(raw).collect()
    assert [(r["linkedin_url"], r["name"], r["current_title"], r["city"]) for r in got] == [("https://www.linkedin.com/in/ann", "Ann Bee", "CTO", "Oslo")]
    assert json.loads(got[0]["raw_data"])["Note"] == 'x, "y"'
    assert files.pick_column(["URL", "Title", "name"], ["full_name", "NAME"]) == "name" and files.pick_column(["a"], ["b"]) is None
    assert [r[0] for r in files.profile_urls(raw).collect()] == ["https://www.linkedin.com/in/ann"]
    files.write_csv(spark.createDataFrame([("a", None), ('q"', "b")], "x string, y string").coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert text.splitlines()[0] == '"x","y"' and '"a",""' in text


def test_logs(spark):
    raw = spark.createDataFrame([('{"Client":"a","n":1}', None), ('{"n":1,"Client":"a"}', None), ("junk", "7"), ('{"Client":"b"}', "9")], "qualification_results string, id string")
    good, bad = files.outcome_log(raw)
    ids = [r["_row_id"] for r in good.collect()]
    assert len(ids) == 3 and ids[0] == ids[1] and "9" in ids and bad.count() == 1
    w = files.webhook_log(spark.createDataFrame([("", "CTO at Acme", "", "2024-05-06 10:00")], "`Person Company` string, `Person Headline` string, `New Webhook Sent At` string, `Log Created At` string")).first()
    assert (w["company"], w["title"], str(w["sent_date"])) == ("Acme", "CTO", "2024-05-06")
    assert files.json_rows(spark.createDataFrame([('[{"a":1},{"a":2}]',), ("no",)], "p string"), "p", "a: int").count() == 2


def test_store_and_reports(spark, tmp_path):
    s = Store(spark, str(tmp_path / "one"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert s.write("t", df) == 2 and s.write("t", s.read("t").where("k = 1")) == 1 and s.append("t", df.where("k = 2")) == 2
    s.write("saved_reports", spark.createDataFrame([("r1", "SELECT count(*) AS n FROM t", None)], "name string, sql_query string, view_name string"))
    assert run_report(spark, s, "r1", "me", "2024-01-01").first()["n"] == 2
    run_report(spark, s, "r1", "me", "2024-01-02", str(tmp_path / "csv"))
    assert sorted((r["report"], r["row_count"]) for r in s.read("saved_report_runs").collect()) == [("r1", 1), ("r1", 1)]
    with pytest.raises(KeyError):
        run_report(spark, s, "none", "me", "x")
    assert s.tables() == ["saved_report_runs", "saved_reports", "t"]
    assert {json.loads(r["row"])["k"] for r in as_json_rows({"t": df}).collect()} == {1, 2}
    m = status_matrix(spark.createDataFrame([("f1", "a"), ("f1", "b"), ("f2", "a")], "file string, inst string"), "file", "inst", ["a", "b"])
    assert sorted(map(tuple, m.collect())) == [("f1", True, True), ("f2", True, False)]


def test_streamed_upsert_equals_batch(spark, tmp_path):
    src, s = tmp_path / "src", Store(spark, str(tmp_path / "store"))
    schema = "id string, likes int, text string, at int"
    part = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(str(src))
    part([("a", 5, "x", 1), ("a", 3, None, 2), ("b", 1, "y", 1), (None, 9, "n", 1)])
    go = lambda: incremental.upsert_stream(spark.readStream.schema(schema).parquet(str(src)), s, "posts", ["id"], ["at"], {"likes": greatest}, str(tmp_path / "cp")).awaitTermination()
    go()
    part([("a", 2, "z", 3), ("c", 7, "w", 1)])
    go()
    go()  # nothing new
    assert sorted(map(tuple, s.read("posts").collect())) == [("a", 3, "z", 3), ("b", 1, "y", 1), ("c", 7, "w", 1)]


def test_windows_and_ages(spark, tmp_path):
    src = tmp_path / "ev"
    spark.createDataFrame([(T0, "a"), (T0 + dt.timedelta(minutes=3), "a"), (T0 + dt.timedelta(minutes=11), "b"), (T0 + dt.timedelta(hours=9), "z")], "at timestamp, k string").write.parquet(str(src))
    st = spark.readStream.schema("at timestamp, k string").parquet(str(src))
    q = incremental.windowed_counts(incremental.without_repeats(st, ["k", "at"], "at", "10 minutes"), "at", None, "10 minutes", ["k"]).writeStream.format("memory").queryName("win").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["k"], r["n"]) for r in spark.table("win").collect()) == [("a", 2), ("b", 1)]
    r = spark.createDataFrame([(T0, 10, T0), (T0, None, T0 + dt.timedelta(days=1)), (T0, 400, T0 + dt.timedelta(days=3))], "got timestamp_ntz, days int, read timestamp_ntz")
    assert incremental.stale(r, "got", F.col("days"), "2024-02-01 00:00:00").count() == 1
    assert incremental.unsettled(r, "got", "read", 2, "2024-02-01 00:00:00").count() == 2
