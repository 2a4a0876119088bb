from pyspark.sql import functions as F

from tallyloom.operators import guards as G


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_discipline_and_basis(spark):
    a = spark.createDataFrame([
        ("1", "observation", None, None, None, "s", None, None), ("2", "observation", None, None, None, None, None, None), ("3", "observation", "me", None, None, "s", None, None), ("4", "decision", "me", "cli", "why", None, None, ["1"]), ("5", "decision", " ", "cli", "why", None, None, ["4"]),
        ("6", "decision", "me", None, "why", None, None, []), ("7", "decision", "me", "cli", "", None, None, None), ("8", "decision", "me", "cli", "why", None, "e", None), ("9", "guess", None, None, None, None, None, None), ("10", None, None, None, None, None, None, None),
    ], "id string, kind string, decided_by string, via string, notes string, evidence_signal_id string, evidence_enrichment_call_id string, basis array<string>")
    assert sorted((r["id"], r["broken"].split()[-1]) for r in G.undisciplined(a).collect()) == [("2", "evidence"), ("3", "decided"), ("5", "decider"), ("6", "way"), ("7", "reason"), ("8", "basis"), ("9", "kind")]
    assert rows(G.baseless(a)) == [("5", "4"), ("6", None)]


def test_tags_and_merged(spark):
    t = spark.createDataFrame([("a", "x:old", None), ("b", "new", None), ("c", "queue", "n"), ("c", "no", None), ("d", "yes", None)], "lead_id string, tag string, notes string")
    d = spark.createDataFrame([("x", "old", "use x:new"), ("", "new", None)], "namespace string, key string, retired_message string")
    assert [(r["lead_id"], r["retired_message"]) for r in G.refused_tags(t, d).collect()] == [("a", "use x:new")]
    v = spark.createDataFrame([("c", True), ("d", True), ("e", False), ("f", None)], "lead_id string, qualified boolean")
    assert rows(G.swap_tags(t, v, "yes", "no", "queue").select("lead_id", "tag")) == [("a", "x:old"), ("b", "new"), ("c", "yes"), ("d", "yes"), ("e", "no")]
    leads = spark.createDataFrame([("a", "b", "https://x/in/acoaa" + "b" * 15), ("b", None, "https://x/in/ACoAA" + "b" * 15)], "id string, merged_into string, linkedin_url string")
    assert rows(G.writes_to_merged({"tags": (t, "lead_id"), "none": (t.limit(0), "lead_id")}, leads)) == [("tags", 1)]
    assert [r["id"] for r in G.lowered_tokens(leads).collect()] == ["a"] and G.lowered_tokens(leads, leads).count() == 0


def test_outcomes_twice_are_once(spark):
    v = spark.createDataFrame([("r0", "a", 1, "lost")], "row_id string, lead_id string, at int, outcome string")
    t = spark.createDataFrame([("a", "outcome:lost"), ("a", "other"), ("z", "outcome:won")], "lead_id string, tag string")
    log = spark.createDataFrame([("r0", "a", 1, "lost"), ("r1", "a", 2, "won"), ("r2", "b", 1, "lost"), ("r2", "b", 1, "lost")], "row_id string, lead_id string, at int, outcome string")
    v1, t1 = G.import_outcomes(v, t, log, "outcome:")
    assert [r["row_id"] for r in v1.orderBy("row_id").collect()] == ["r0", "r1", "r2"]
    assert rows(t1) == [("a", "other"), ("a", "outcome:won"), ("b", "outcome:lost"), ("z", "outcome:won")]
    v2, t2 = G.import_outcomes(v1, t1, log, "outcome:")
    assert rows(v2) == rows(v1) and rows(t2) == rows(t1)


def test_registry_and_notes(spark):
    p = spark.createDataFrame([("c", "1", "old", 1)], "name string, version string, yaml_spec string, created_at int")
    n = spark.createDataFrame([("c", "1", "new", 9), ("c", "2", "x", 9)], "name string, version string, yaml_spec string, created_at int")
    assert rows(G.register(p, n)) == [("c", "1", "new", 1), ("c", "2", "x", 9)]
    d = spark.createDataFrame([("ignored:a", "category: timing; detail: freeze; via: upload"), ("ignored:a", "none"), ("ignored:a", None), ("other", None)], "tag string, notes string")
    assert [r[0] for r in d.select(G.ignored_note_ok(F.col("tag"), F.col("notes"))).collect()] == [True, False, False, True]
