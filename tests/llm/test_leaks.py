import random

import pytest

pytest.importorskip("tallyloom.llm")
from tallyloom.llm import leaks  # noqa: E402


def brute_tiles(a, b, least):
    """Greedy string tiling by looking at every pair of positions."""
    ma, mb, out = [False] * len(a), [t < 0 for t in b], []
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k >= least:
                    found.append((i, j))
        if best < least:
            return out
        for i, j in sorted(found, key=lambda x: (x[1], x[0])):
            if not any(ma[i:i + best]) and not any(mb[j:j + best]):
                ma[i:i + best] = mb[j:j + best] = [True] * best
                out.append((i, j, best))


def test_tiles_cover_as_much_as_brute_force():
    r = random.Random(5)
    for _ in range(150):
        a = [r.randrange(8) for _ in range(r.randrange(1, 40))]
        b = [r.choice([*range(8), -1]) for _ in range(r.randrange(1, 60))]
        if r.random() < 0.6:
            cut = r.randrange(len(a))
            b[r.randrange(len(b)):0] = a[cut:] + a[:cut]
        got = leaks.tiles(a, b, 3)
        want = brute_tiles(a, b, 3)
        assert sorted(k for _, _, k in got) == sorted(k for _, _, k in want)
        for i, j, k in got:
            assert a[i:i + k] == b[j:j + k]
        assert len({x for i, _, k in got for x in range(i, i + k)}) == sum(k for _, _, k in got) == len({x for _, j, k in got for x in range(j, j + k)})


A = "The old harbour master counted forty blue lanterns before the winter fair began. Nobody asked why seven of them had already gone missing. Which clerk signed the first receipt and who paid for the oil?"
B = "Eight mountain guides carried copper kettles across the frozen river at dawn. The council later denied that any permit had been issued. How many kettles reached the northern hut?"
Z = "苔岭天文台在初雪前租出了两架旧望远镜，承租人却把它们改装成了测雨器。租约里没有一条写明禁止改装。"
ITEMS = [(1, A), (2, B), (3, Z), (4, None), (5, ""), (1, A)]
PAD = "Some unrelated words about pricing and pilots stand here. " * 30
DOCS = [
    (1, PAD + A + PAD), (2, PAD + A.upper().replace(" ", "\n")), (3, "quote: " + A[:45]), (4, A.replace("forty", "fifty").replace("seven", "nine").replace("clerk", "keeper")), (5, A[140:] + " " + A[80:140] + " " + A[:80]), (6, None), (7, ""), (8, PAD + Z + PAD), (9, A + PAD + B), (10, PAD * 300 + B), (11, A[:60] + PAD + A[60:110]), (None, A), (12, A.replace("o", "ó").replace("a", "а", 3)),
]


@pytest.mark.parametrize("most", [10_000, 1])
def test_found_with_items_everywhere_or_by_join(spark, most):
    docs = spark.createDataFrame([(*d, "clash") for d in DOCS], "doc_id long, text string, share string")
    items = spark.createDataFrame(ITEMS, "item_id long, item_text string")
    got = {(r[0], r[1]) for r in leaks.find_leaks(docs, "doc_id", "text", items, "item_id", "item_text", most_bytes=most).collect()}
    assert got == {(12, 1), (1, 1), (2, 1), (4, 1), (5, 1), (8, 3), (9, 1), (9, 2), (10, 2)}


def test_shared_wording_goes_to_the_item_that_covers_more(spark):
    common = "when the bells of the upper town rang at noon all traders closed their stalls and"
    items = spark.createDataFrame([(1, common + " walked home together singing about the harvest moon"), (2, common + " nothing")], "id long, text string")
    docs = spark.createDataFrame([(7, common + " walked home together singing about the harvest moon")], "id long, text string")
    assert [(r[0], r[1]) for r in leaks.find_leaks(docs, "id", "text", items, "id", "text").collect()] == [(7, 1)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, A)], "doc_id long, text string")
    items = spark.createDataFrame([(1, A)], "item_id long, item_text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0))):
        assert leaks.find_leaks(d, "doc_id", "text", i, "item_id", "item_text").count() == 0


@pytest.mark.parametrize("most", [10_000, 1])
def test_a_long_item_with_every_sixth_word_changed(spark, most):
    item = [f"w{i}" for i in range(500)]
    doc = " ".join("changed" if i % 6 == 5 else w for i, w in enumerate(item[:210]))
    items = spark.createDataFrame([(1, " ".join(item)), (2, B)], "item_id long, item_text string")
    docs = spark.createDataFrame([(7, PAD + doc + PAD)], "doc_id long, text string")
    assert [(r[0], r[1]) for r in leaks.find_leaks(docs, "doc_id", "text", items, "item_id", "item_text", most_bytes=most).collect()] == [(7, 1)]


def altered(words, every):
    return " ".join("changed" if i % every == every - 1 else w for i, w in enumerate(words))


@pytest.mark.parametrize(("n", "part", "every", "carried"), [(200, 0.5, 5, 0.49), (400, 0.6, 5, 0.59), (800, 0.5, 6, 0.49)])
@pytest.mark.parametrize("most", [1_000_000, 1])
def test_altered_passages_of_long_items(spark, most, n, part, every, carried):
    words = [f"w{i}" for i in range(n)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, B)], "item_id long, item_text string")
    docs = spark.createDataFrame([(7, PAD + altered(words[:int(n * part)], every) + " " + PAD)], "doc_id long, text string")
    got = leaks.find_leaks(docs, "doc_id", "text", items, "item_id", "item_text", most_bytes=most).collect()
    assert [(r[0], r[1]) for r in got] == [(7, 1)] and got[0]["share"] >= carried


def test_both_sizes_give_one_result(spark):
    r = random.Random(2)
    vocab = ["alpha", "beta", "gamma", "delta", "of", "the", "in"]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randrange(4, 30))) for _ in range(12)]
    rows = [(1, "a b c d e f g h " * 10), (2, texts[0] + " x y " + texts[3]), (3, texts[1]), (3, texts[2]), (3, texts[2])]
    rows += [(10 + i, " ".join(r.choice(vocab) for _ in range(60))) for i in range(20)]
    items = spark.createDataFrame([(0, "a b c d e f g h " * 14), *enumerate(texts, 1)], "item_id long, item_text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (sorted(map(tuple, leaks.find_leaks(docs, "doc_id", "text", items, "item_id", "item_text", most_bytes=m).collect())) for m in (1_000_000, 1))
    assert one == two and (1, 0) in {x[:2] for x in one}


def test_passages_are_those_of_all_stretches_of_shared_pairs():
    """Looking around seeds only, and the bound on what a stretch can carry, lose no passage."""
    r = random.Random(8)
    hits = 0
    for _ in range(400):
        item = [r.randrange(30) for _ in range(r.randrange(6, 60))]
        doc = [r.choice([-1, r.randrange(30)]) for _ in range(r.randrange(5, 40))]
        for _ in range(r.randrange(3)):
            a = r.randrange(len(item))
            doc += [t if r.random() < 0.85 else -1 for t in item[a:a + r.randrange(4, 40)]] + [-1] * r.randrange(12)
        pairs, seeds = set(zip(item, item[1:])), {tuple(item[i:i + 4]) for i in range(len(item) - 3)}
        at = [i for i in range(len(doc) - 3) if tuple(doc[i:i + 4]) in seeds]
        got = sorted(c for c, _ in leaks.passages(doc, item, pairs, at, 0.4, 8))
        stretches = []
        for j in range(len(doc) - 1):
            if (doc[j], doc[j + 1]) in pairs:
                if stretches and j - stretches[-1][1] <= 8:
                    stretches[-1][1] = j + 2
                else:
                    stretches.append([j, j + 2])
        want = []
        for lo, hi in stretches:
            part = []
            for x in [*sorted(leaks.tiles(item, doc[lo:hi], 2), key=lambda x: x[1]), None]:
                if x is not None and (not part or x[1] - part[-1][1] - part[-1][2] <= 8):
                    part.append(x)
                    continue
                if part and max(k for _, _, k in part) >= 4 and leaks.carried(part, len(item)) >= 0.4:
                    want.append(leaks.carried(part, len(item)))
                part = [x] if x is not None else []
        assert got == sorted(want)
        hits += bool(want)
    assert hits > 50
