"""Evaluation texts leaking into training text (problem 8): greedy string tiling.

Documents and test items meet in shared token seeds. Around a seed, the stretch of the document whose
shared pairs of tokens follow one another closely is looked at; in it the longest common token runs
are marked one after the other, none overlapping (running Karp-Rabin matching with a falling search
length), and the share of the item that the runs of one passage cover is measured; the order of the
runs does not matter, so reordered passages count. A run of a
document belongs to the item that covers most there, so wording shared by items counts once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.canonical import LOOKALIKE

SEED = 4
# scripts without blanks between words: each character is a token
_DENSE = "぀-ヿ㐀-䶿一-鿿豈-﫿฀-๿຀-໿က-႟ក-៿"
_TOKENS = re.compile(rf"[{_DENSE}]|[^\W_{_DENSE}]+")

_ACCENTS = re.compile("[\u0300-\u036f\u200b-\u200d\u00ad\ufeff]")
_MIXED = re.compile(r"[A-Za-z]+[\u0370-\u052f][A-Za-z\u0370-\u052f]*|[\u0370-\u052f]+[A-Za-z][A-Za-z\u0370-\u052f]*")


def tokens(text: str) -> list[str]:
    t = text
    if not t.isascii():
        # accents are no difference between words; look-alike letters inside Latin words are Latin
        t = unicodedata.normalize("NFC", _ACCENTS.sub("", unicodedata.normalize("NFKD", t)))
        t = _MIXED.sub(lambda m: m[0].translate(LOOKALIKE), t)
    return _TOKENS.findall(t.lower())


def tiles(a: list[int], b: list[int], least: int, start: int = 24) -> list[tuple[int, int, int]]:
    """Greedy string tiling of token lists: (position in a, position in b, length), longest runs first, none overlapping.

    Negative tokens match nothing. Runs shorter than `least` are not marked.
    """
    marked_a, marked_b = [False] * len(a), [t < 0 for t in b]
    out: list[tuple[int, int, int]] = []
    base, mod = 1_000_003, (1 << 61) - 1
    s = max(least, min(start, len(a), len(b)))
    while True:
        if len(a) < s or len(b) < s:
            found_longer = 0
            matches: list[tuple[int, int, int]] = []
        else:
            top = pow(base, s - 1, mod)

            def rolled(x: list[int], marked: list[bool]) -> Iterator[tuple[int, int]]:
                h, free = 0, 0
                for i, t in enumerate(x):
                    if marked[i]:
                        h, free = 0, 0
                        continue
                    if free >= s:
                        h = (h - (x[i - s] + 2) * top) % mod
                    h, free = (h * base + t + 2) % mod, free + 1
                    if free >= s:
                        yield i - s + 1, h

            index: dict[int, list[int]] = defaultdict(list)
            for i, h in rolled(a, marked_a):
                index[h].append(i)
            matches, found_longer = [], 0
            for j, h in rolled(b, marked_b):
                for i in index.get(h, ()):
                    if a[i:i + s] != b[j:j + s]:
                        continue
                    if i and j and not marked_a[i - 1] and not marked_b[j - 1] and a[i - 1] == b[j - 1]:
                        continue  # part of a run that began earlier
                    k = s
                    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not marked_a[i + k] and not marked_b[j + k]:
                        k += 1
                    if k > 2 * s:
                        found_longer = max(found_longer, k)
                    matches.append((k, i, j))
        if found_longer:
            s = found_longer
            continue
        again = False
        for k, i, j in sorted(matches, key=lambda m: (-m[0], m[2], m[1])):
            if any(marked_a[i:i + k]) or any(marked_b[j:j + k]):
                again = True
                continue
            marked_a[i:i + k] = [True] * k
            marked_b[j:j + k] = [True] * k
            out.append((i, j, k))
        if again:
            continue  # what is left of partly marked runs, at the same length
        if s > 2 * least:
            s //= 2
        elif s > least:
            s = least
        else:
            return out


Part = list[tuple[int, int, int]]
LEAST, ALTERED = 2, 3


def carried(part: Part, size: int) -> float:
    """Share of an item of `size` tokens: tokens in runs, and altered ones, those between two runs that follow one another in both texts with few tokens between."""
    n = sum(k for _, _, k in part)
    for (i, j, k), (i2, j2, _) in zip(part, part[1:]):
        a, b = i2 - i - k, j2 - j - k
        if 0 <= a <= ALTERED and 0 <= b <= ALTERED:
            n += a
    return n / size


def passages(doc: list[int], item: list[int], pairs: set[tuple[int, int]], hits: list[int], share: float, gap: int) -> list[tuple[float, Part]]:
    """(share carried, runs) of each passage of the item that carries enough of it, from the seeds at `hits`.

    Runs have two tokens or more, so that all of a passage lies where shared pairs of tokens follow
    one another at most `gap` apart; a stretch is tiled unless its pairs and what may be altered
    between them are too few for the share.
    """
    out: list[tuple[float, Part]] = []
    past, n = -1, len(doc)
    for h in hits:
        if h < past:
            continue
        lo, hi = h, h + SEED
        j = hi - 1
        while j + 1 < n and j <= hi + gap:
            if (doc[j], doc[j + 1]) in pairs:
                hi = j + 2
            j += 1
        j = lo
        while j > 0 and j + 1 >= lo - gap:
            if (doc[j - 1], doc[j]) in pairs:
                lo = j - 1
            j -= 1
        past = hi
        shared = [(doc[j], doc[j + 1]) in pairs for j in range(lo, hi - 1)]
        most = sum(x or y for x, y in zip([False, *shared], [*shared, False]))
        if most + ALTERED * (most // LEAST - 1) < share * len(item) - 1e-9:
            continue
        runs = sorted(((i, j + lo, k) for i, j, k in tiles(item, doc[lo:hi], LEAST)), key=lambda r: r[1])
        part: Part = []
        for r in [*runs, None]:
            if r is not None and (not part or r[1] - (part[-1][1] + part[-1][2]) <= gap):
                part.append(r)
                continue
            # short runs count only beside one of a seed's length
            if part and max(k for _, _, k in part) >= SEED and (c := carried(part, len(item))) >= share:
                out.append((c, part))
            part = [r] if r is not None else []
    return out


def owners(found: list[tuple[object, int, float, Part]], share: float) -> list[tuple[object, float]]:
    """Items a document leaks, of (item, its size, share, runs): what two items have in common there belongs to the one that covers more."""
    out: dict[object, float] = {}
    owned: set[int] = set()
    for key, size, _, part in sorted(found, key=lambda f: (-sum(k for _, _, k in f[3]), f[3][0][1], str(f[0]))):
        left = [r for r in part if sum(j in owned for j in range(r[1], r[1] + r[2])) * 2 <= r[2]]
        if left and (c := carried(left, size)) >= share:
            out[key] = max(out.get(key, 0.0), c)
            owned |= {j for r in part for j in range(r[1], r[1] + r[2])}
    return list(out.items())


def _pairs(item: list[int]) -> set[tuple[int, int]]:
    return set(zip(item, item[1:]))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _seed_keys(ids: np.ndarray) -> np.ndarray:
    """A number for each window of a seed's length; windows with an unknown token have one that means nothing."""
    x = ids.astype(np.uint64)
    n = len(x) - SEED + 1
    h = x[:n]
    for k in range(1, SEED):
        h = h * _MIX + x[k:k + n]
    return h ^ (h >> np.uint64(29))


class Items:
    """Test items with their seeds, for all documents of a task; `find_leaks` checks their size."""

    def __init__(self, items: list[tuple[object, str]], share: float, gap: int):
        self.share, self.gap = share, gap
        self.vocab: dict[str, int] = {}
        self.ids, self.toks, self.pairs = [], [], []
        self.seeds: dict[int, list[int]] = defaultdict(list)
        for key, text in items:
            t = [self.vocab.setdefault(w, len(self.vocab)) for w in tokens(text)]
            if len(t) < SEED:
                continue
            for s in set(_seed_keys(np.array(t)).tolist()):
                self.seeds[s].append(len(self.ids))
            self.ids.append(key)
            self.toks.append(t)
            self.pairs.append(_pairs(t))
        self.keys = np.array(sorted(self.seeds), dtype=np.uint64)

    def leaks(self, texts: list[str]) -> Iterator[tuple[int, object, float]]:
        """(place in the list, item, share) of the texts that leak, many texts at a time."""
        words: list[list[str]] = []
        size = first = 0
        for i, t in enumerate(texts):
            words.append(tokens(t))
            size += len(words[-1])
            if size >= 200_000 or i == len(texts) - 1:
                yield from ((first + k, item, c) for k, item, c in self._leaks(words))
                words, size, first = [], 0, i + 1

    def _leaks(self, words: list[list[str]]) -> Iterator[tuple[int, object, float]]:
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in chain.from_iterable(words)), dtype=np.int64, count=sum(map(len, words)))
        if len(ids) < SEED or not len(self.keys):
            return
        keys = _seed_keys(ids)
        at = np.searchsorted(self.keys, keys)
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        for k in range(SEED):
            hit &= ids[k:k + len(keys)] >= 0
        begin = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        where = np.flatnonzero(hit)
        doc_of = np.searchsorted(begin, where, side="right") - 1
        inside = where + SEED <= begin[doc_of + 1]
        per_doc: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for p, d in zip(where[inside].tolist(), doc_of[inside].tolist()):
            for n in self.seeds[int(keys[p])]:
                per_doc[d][n].append(p - int(begin[d]))
        for d, by_item in per_doc.items():
            doc = ids[begin[d]:begin[d + 1]].tolist()
            # one seed is enough to look: altered words and runs under a seed's length count as carried, but give no seeds
            found = [(n, len(self.toks[n]), c, part) for n, hits in by_item.items() for c, part in passages(doc, self.toks[n], self.pairs[n], hits, self.share, self.gap)]
            for n, c in owners(found, self.share):
                yield d, self.ids[n], c


_indexes: dict[tuple, Items] = {}


def _worker_index(items: list[tuple[object, str]], share: float, gap: int) -> Items:
    """One index a Python worker, kept over its tasks."""
    key = (hash(tuple(items)), share, gap)
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = Items(items, share, gap)
    return _indexes[key]


MOST_BYTES = 64 << 20


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, share: float = 0.4, gap: int = 8, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, item_id, share: documents that carry at least `share` of an item's tokens as one passage.

    A passage is a stretch of the document whose common runs lie at most `gap` tokens apart. Items
    whose texts have at most `most_bytes` bytes together go to every task with their seeds, and
    documents are read where they are; of more, a document meets those it shares a seed with through
    a join on seeds. Either way the same pairs are tiled and the result is the same.
    Null and blank texts and items carry nothing; repeated rows give repeated rows; texts of any
    length are read whole; an item shorter than a seed is never found. Where both
    ids have one name, the item's is given as `item_<name>`. Documents with a null id are left out.
    """
    if item_id == doc_id:
        items, item_id = items.withColumnRenamed(item_id, f"item_{item_id}"), f"item_{item_id}"
    if item_text == doc_id or item_text == text:
        items, item_text = items.withColumnRenamed(item_text, "__item_text"), "__item_text"
    kt, it = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    docs = docs.where(f"`{doc_id}` is not null").select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    ok = items.where(f"`{item_id}` is not null and `{item_text}` is not null").select(F.col(item_id).alias("i"), F.col(item_text).alias("x")).distinct()
    size = ok.agg(F.sum(F.octet_length("x") + 64)).first()[0] or 0

    if size <= most_bytes:
        few = sorted(((r[0], r[1]) for r in ok.collect()), key=lambda r: (str(r[0]), r[1]))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = _worker_index(few, share, gap)
            for pdf in batches:
                pdf = pdf[pdf["t"].notna()]
                keys = pdf["d"].tolist()
                yield pd.DataFrame([(keys[k], n, c) for k, n, c in index.leaks(pdf["t"].tolist())], columns=["d", "i", "share"])

        out = docs.mapInPandas(scan, f"d {kt}, i {it}, share double")
        return out.toDF(doc_id, item_id, "share")

    def seeds(key: str, body: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for k, t in zip(pdf[key], pdf[body]):
                    w = tokens(t)
                    own = {tuple(w[i:i + SEED]) for i in range(len(w) - SEED + 1)}
                    yield pd.DataFrame([(k, " ".join(s)) for s in own], columns=["key", "seed"])

        return run

    # rows of one id and text are one document
    docs = docs.where("t is not null").withColumn("key", F.sha2(F.concat_ws("\n", F.col("d").cast("string"), "t"), 256))
    texts = docs.select("key", "t").distinct()
    ok = ok.withColumn("ik", F.sha2(F.concat_ws("\n", F.col("i").cast("string"), "x"), 256))
    a = texts.mapInPandas(seeds("key", "t"), "key string, seed string").selectExpr("key", "xxhash64(seed) as s")
    b = ok.select("ik", "x").mapInPandas(seeds("ik", "x"), "key string, seed string").selectExpr("key as ik", "xxhash64(seed) as s")
    # a hot seed is one row of the test side and is joined in parts by AQE; pairs are combined before their shuffle
    meet = a.join(b, "s").select("key", "ik").distinct()
    rows = texts.join(meet.select("key").distinct(), "key", "left_semi").select("key", F.lit(0).alias("kind"), F.lit("").alias("ik"), F.col("t").alias("x"))
    rows = rows.unionAll(meet.join(ok, "ik").select("key", F.lit(1).alias("kind"), "ik", "x")).repartition("key").sortWithinPartitions("key", "kind")

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A document's text, then its items one after the other: one item is held at a time."""
        key, doc, vocab, found = None, [], {}, []
        at: dict[tuple, list[int]] = {}
        for pdf in batches:
            out = []
            for k, kind, i, x in zip(pdf["key"], pdf["kind"], pdf["ik"], pdf["x"]):
                if kind == 0:
                    out += [(key, n, c) for n, c in owners(found, share)]
                    key, vocab, found, at = k, {}, [], defaultdict(list)
                    doc = [vocab.setdefault(w, len(vocab)) for w in tokens(x)]
                    for p, s in enumerate(zip(*(doc[q:] for q in range(SEED)))):
                        at[s].append(p)
                    continue
                # words the document lacks become numbers it lacks
                item = [vocab.get(w, len(vocab) + q) for q, w in enumerate(tokens(x))]
                hits = sorted({p for s in zip(*(item[q:] for q in range(SEED))) for p in at.get(s, ())})
                found += [(i, len(item), c, part) for c, part in passages(doc, item, _pairs(item), hits, share, gap)]
            yield pd.DataFrame(out, columns=["key", "ik", "share"])
        yield pd.DataFrame([(key, n, c) for n, c in owners(found, share)], columns=["key", "ik", "share"])

    found = rows.mapInPandas(tile, "key string, ik string, share double").join(ok.select("ik", "i"), "ik")
    return docs.select("key", "d").join(found, "key").select("d", "i", "share").toDF(doc_id, item_id, "share")
