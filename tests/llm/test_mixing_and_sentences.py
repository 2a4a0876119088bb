import numpy as np
import pytest

pytest.importorskip("tallyloom.llm")
from tallyloom.llm import mixing, sentences  # noqa: E402


def test_inverse_of_the_integrated_weight():
    knots = [(0.0, 0.2), (0.5, 0.6), (1.0, 0.0)]
    t = np.linspace(0, 1, 51)
    fine = np.linspace(0, 1, 200001)
    w = np.interp(fine, [k[0] for k in knots], [k[1] for k in knots])
    area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(fine))])
    done = np.interp(t, fine, area) / area[-1]
    assert np.abs(mixing.invert(knots, done) - t).max() < 1e-3
    assert np.allclose(mixing.invert([(0.0, 0.3), (1.0, 0.3)], np.array([0.0, 0.25, 1.0])), [0, 0.25, 1])


def test_ramps_keep_targets_and_sum_to_one():
    t = [{"source": "a", "target_weight": 0.5, "max_repeats": 1}, {"source": "b", "target_weight": 0.3, "max_repeats": 4}, {"source": "c", "target_weight": 0.2, "max_repeats": 2}]
    r = mixing.ramps(t)
    for x in t:
        k = r[x["source"]]
        assert abs((k[0][1] + k[1][1]) / 2 - x["target_weight"]) < 1e-12
    for at in (0, 1):
        assert abs(sum(k[at][1] for k in r.values()) - 1) < 1e-12


def test_mix(spark):
    docs = [(i, f"word number {i} " * (1 + i % 7), "big" if i % 3 else "small" if i % 2 else "tiny", "clash", 5) for i in range(600)] + [(9001, None, "big", "", 0), (9002, "", "tiny", "", 0), (9003, "x", None, "", 0), (9004, "y", "elsewhere", "", 0), (None, "z", "big", "", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, copy string, bucket int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("tiny", 0.2, 2), ("absent", 0.1, 5), (None, 0.1, 1)], "source string, target_weight double, max_repeats int")
    uses, want = mixing.mix(df, targets)
    rows = uses.collect()
    got = {r["source"]: r for r in mixing.shares(uses, want).collect()}
    assert set(got) == {"big", "small", "tiny"}
    for s, w in (("big", 0.5), ("small", 0.3), ("tiny", 0.2)):
        assert abs(got[s]["share"] - w) < 0.02 and abs(got[s]["target"] - w) < 1e-9
    caps = {"big": 1, "small": 3, "tiny": 2}
    seen = {}
    for r in rows:
        seen[(r["source"], r["doc_id"])] = seen.get((r["source"], r["doc_id"]), 0) + 1
    assert all(n <= caps[s] for (s, _), n in seen.items())
    assert all(0 <= r["at"] <= 1 for r in rows) and [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    # what may repeat more comes later on average
    mean = lambda s: np.mean([r["at"] for r in rows if r["source"] == s])
    assert mean("big") < mean("small")
    again = {(r["doc_id"], r["copy"]): r["position"] for r in mixing.mix(df, targets)[0].collect()}
    assert again == {(r["doc_id"], r["copy"]): r["position"] for r in rows}


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_weight double, max_repeats int")
    uses, want = mixing.mix(df, t)
    assert uses.count() == 0 and want == []


def cut(text):
    return [text[a:b + 1] for a, b in sentences.split_sentences(text)]


@pytest.mark.parametrize("units", [
    ["She met Dr. Gallowmere in Lindenau.", "Legal signed off at 5 p.m.", "Nobody noticed."], ["“Can we renew early?” asked the partner.", "The deck “Why tests? A guide” was opened 5 times."], ["It was late... and still open.", "Really?!", "36 days."],
    ["No. 28 on the agenda was lead routing.", "No.", "We can't.", "Now stage 7.", "Version 6.53.1 fixed it (see sec. 6, fig. 49)."], ["The price went from .5 to .67 of list.", "In his words: “We tried it. It broke.”", "Does it?"], ["Ask J. R. Harjunen-Aho about it.", "The U.S. team left."],
    ["Am 3. Oktober traf er Dr. Lindqvarn.", "„Wann verlängern wir?“, fragte sie.", "Er sagte: „Es klappt nicht. Wir warten.“", "Seit dem Umbau ist Ruhe."], ["Ca. 70 Firmen, u. a. Tarokuklu, haben zugesagt.", "Hezax GmbH & Co. KG prüft das seit d. J. erneut."],
    ["M. Kestenbrook a présenté, cf. p. 20.", "« Qui valide le budget ? » a demandé la directrice.", "On verra...", "Voir l'art. 3 du contrat !"], ["EE. UU. es el mercado n.º 5.", "La Sra. Wojtecka fue a las 10:30 a. m. y duró poco.", "¿Quién aprueba?", "«¿Cuándo?», preguntó.", "¡Sí!"],
])
def test_spaced_scripts(units):
    assert cut(" ".join(units)) == units
    assert cut("  " + "\n".join(units) + "\n") == units


@pytest.mark.parametrize("units", [
    ["She gave it to me.", "Then she left."], ["He won a gem.", "It shone."], ["I work for the rep.", "They pay well."], ["We chose plan B.", "Then we left."], ["So did I.", "Nobody knew why."], ["We met Rep. Harrow and J. Smith.", "The gen. manager left."], ["Das gilt gem. Vertrag, z. B. Die Halle.", "Hr. Vogt kam."], ["Me Durand est venu avec les autres.", "Il a vu Me. Morel."],
])
def test_abbreviations_are_those_of_the_language(units):
    assert cut(" ".join(units)) == units


def test_marks_without_a_blank():
    assert cut("Hello!World is here. See x.Y or https://a.example/?Q=1 now.") == ["Hello!", "World is here.", "See x.Y or https://a.example/?Q=1 now."]


def test_one_text_in_two_languages():
    assert cut("Er kam gem. Absprache zu den anderen.\n\nHe found the gem. It was of no use.") == ["Er kam gem. Absprache zu den anderen.", "He found the gem.", "It was of no use."]


@pytest.mark.parametrize("units", [
    ["“今年还续约吗？”采购经理问道。", "她回答：“太早了。再等等。”", "根据纪要，冻结了预算（见附件6）！", "客户没有回复……我们决定再等一周。"], ["「来期も更新しますか？」と尋ねた。", "彼女は「まだ早い。待って。」と答えた。", "資料はVer.3.52に更新済みです。"],
])
def test_dense_scripts(units):
    assert cut("".join(units)) == units


@pytest.mark.parametrize("units", [
    ["“क्या हम नवीनीकरण करेंगे?” खरीद प्रबंधक ने पूछा।", "उसने कहा, “अभी जल्दी है। रुकिए।”", "डॉ. ओकेम्बा ने कहा!", "ठीक है।"], ["سأل المدير: «هل نجدد العقد؟»", "لم يصل أي رد... لكننا ننتظر.", "التقى د. تسرين بالفريق!", "من المسؤول؟"], ["ก่อนสิ้นปีทีมบัญชี", "ก่อนสิ้นปีลูกค้า49.6%", "สรุป"],
])
def test_other_scripts(units):
    assert cut(" ".join(units)) == units


def test_units_and_edges():
    assert cut("Summary\n\nFirst one\nstill first. Second.\n \n2.3 Findings\r\n\r\n1. Background\n\n") == ["Summary", "First one\nstill first.", "Second.", "2.3 Findings", "1. Background"]
    assert cut("") == cut(None) == cut(" \n\n \t") == []
    assert cut("...") == ["..."] and cut("no end") == ["no end"] and cut("(unclosed. Next one.") == ["(unclosed.", "Next one."]


def test_rows_and_long_texts(spark):
    long = "One two three. " * 50_000
    rows = [(1, "One two. Three four."), (1, "One two. Three four."), (2, None), (3, " "), (4, long), (None, "X.")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, start_pos int")
    out = sentences.sentence_units(df, "doc_id", "text")
    n = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert n == {1: 4, 4: 50_000, None: 1}
    assert sorted(map(tuple, out.where("doc_id = 1").distinct().collect())) == [(1, 1, 8), (1, 10, 20)]
    assert sentences.sentence_units(df.limit(0), "doc_id", "text").count() == 0
