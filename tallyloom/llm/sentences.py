"""Sentence boundaries across languages and scripts (problem 10).

Boundaries follow the character properties of Unicode's sentence-break rules: every script's
sentence terminals, closing marks after them, what may follow. Three things come on top: quotations
and brackets inside a sentence stay whole, abbreviations of the language a unit is in (told by its own
function words, else by those of the whole text) are no ends, and Thai, which has no terminals, ends
at a blank. Blank lines end a unit whatever comes before them.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame

# Abbreviations by language, "" for all of them. Those of ALWAYS are followed by more of
# their sentence, those of TITLES as well if they are capitalised (else they are ordinary words), those
# of NUMBERED where a number follows, those of MAY_END unless a small letter follows.
ALWAYS = {
    "": ["dr", "prof", "mr", "mrs", "ms", "messrs", "vs", "e.g", "i.e", "cf", "viz", "u.s", "e.u", "u.k", "u.n"],
    "en": ["sgt", "capt"],
    "de": ["bzgl", "vgl", "bzw", "z", "z.b", "u", "u.a", "d", "d.h", "hr", "fr", "sog", "inkl", "exkl", "ggf", "evtl", "dipl", "ing", "o.ä", "s.o", "s.u", "insb", "allg", "gem", "st", "lt"],
    "fr": ["m", "mm", "mme", "mlle", "c.-à-d", "p.ex", "mgr", "cie", "bd", "av", "st"],
    "es": ["sr", "sra", "srta", "dra", "d", "dña", "p", "p.ej", "ej", "ee", "lic", "ing", "gral", "avda", "ud", "uds"],
    "hi": ["डॉ", "श्री", "प्रो", "सुश्री"],
    "ar": ["د", "أ", "م", "أ.د"],
}
TITLES = {"en": ["st", "rev", "hon", "gen", "col", "lt", "mt", "gov", "sen", "rep"], "fr": ["me"]}
NUMBERED = {
    "en": ["no", "nos", "fig", "figs", "sec", "secs", "vol", "ch", "p", "pp", "para", "art", "max", "min", "approx", "est", "eq", "ref", "ext", "dept", "tel"],
    "de": ["nr", "abschn", "abb", "bd", "kap", "s", "ca", "max", "min", "mind", "art", "abs", "ziff", "rd", "bl"],
    "fr": ["env", "art", "p", "pp", "n", "chap", "fig", "vol", "éd", "tél"],
    "es": ["aprox", "pág", "págs", "núm", "n", "art", "cap", "fig", "vol", "tel", "máx", "mín"],
}
MAY_END = ["ltd", "inc", "co", "corp", "llc", "plc", "bros", "jr", "etc", "usw", "usf", "a.m", "p.m", "uu", "s.a", "b.v", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec"]
# Words that tell a language, and that begin sentences.
FUNCTION = {
    "en": "the a an and or but of to in on at for with from by is are was were be been has have had will would can could should may not no this that these those it its he she they we you i his her their our your who what which when where why how if then than as so there here nobody everybody all any some each more most other after before because while my me him them us do does did",
    "de": "der die das den dem des ein eine einen einem einer und oder aber von zu zum zur im in am an auf für mit aus bei nach ist sind war waren wird werden hat haben hatte nicht kein keine dies diese dieser es er sie wir ihr ich sein ihre unser was wer wie wann wo warum wenn dann als so da hier niemand alle jeder mehr sich auch noch nur seit bis über unter vor dass",
    "fr": "le la les un une des du de et ou mais à au aux en dans sur pour avec par est sont était étaient a ont avait sera pas ne ce cette ces il elle ils elles nous vous je on son sa ses leur notre qui que quoi quand où comment pourquoi si alors puis personne tout tous plus aussi se",
    "es": "el la los las un una unos unas y o pero de del a al en con por para es son fue eran era ha han había será no este esta estos estas esto él ella ellos ellas nosotros usted yo su sus nuestro quien que qué cuando donde cómo si entonces nadie todo todos más también se lo le",
}
# Abbreviations that are words or letters of another language, or of their own; the others hold in any text.
ORDINARY = set("me gem rep gen col hon sen gov no nos art para est sec secs mind fig figs cap min max ing st mt lt hr fr av abs rd bl ref eq ch vol ext u d z m s n p".split())
# Words before a letter that is a label and no initial.
LABELS = set("plan option type class grade group team tier phase section part appendix exhibit series vitamin variant version case point typ klasse gruppe phase teil anhang variante fall punkt annexe groupe classe partie cas opción grupo clase parte anexo caso punto".split())
MONTHS = ["Januar", "Jänner", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"]
_function = {k: frozenset(v.split()) for k, v in FUNCTION.items()}
_may_end = set(MAY_END)


def _of(table: dict[str, list[str]], lang: str | None) -> frozenset[str]:
    """The words of a language and those that mean nothing else in another; all words where it is not known."""
    return frozenset(w for k, ws in table.items() for w in ws if lang is None or k in ("", lang) or w not in ORDINARY)


_always, _titles, _numbered = ({k: _of(t, k) for k in (None, *FUNCTION)} for t in (ALWAYS, TITLES, NUMBERED))
_short = _always[None] | _titles[None] | _numbered[None] | _may_end
_LATIN_WORD = regex.compile(r"\p{Latin}+")


def language(text: str) -> str | None:
    """The language most of whose function words are in the text; none where there are none, or as many of another."""
    words = _LATIN_WORD.findall(text.lower())
    n = sorted(((sum(w in f for w in words), k) for k, f in _function.items()), reverse=True)
    return n[0][1] if n[0][0] > n[1][0] else None


_PARAGRAPH = regex.compile(r"(?:\r\n|[\n\r \x85])[^\S\n\r  \x85]*(?:\r\n|[\n\r \x85])\s*| \s*")
_CLOSERS = r"[\p{Pe}\p{Pf}\"“»«]"
_END = regex.compile(rf"[\p{{STerm}}…⋯.．]+(?:[\s  ]?{_CLOSERS})*")
_MARK = regex.compile(r"[\p{Ps}\p{Pe}\p{Pi}\p{Pf}\"]")
_THAI = regex.compile(r"\p{Thai}")
_THAI_GAP = regex.compile(r"(?<=\p{Thai})\s+|\s+(?=\p{Thai})")
_OPENS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "“": "”", "„": "“", "‟": "”", "«": "»", "‹": "›", "»": "«", "‚": "‘"}
_NEXT, _LETTER = regex.compile(r"\S"), regex.compile(r"[^\p{P}\s]")
_RUN, _OTHER = regex.compile(r"[\p{STerm}…⋯.．]+"), regex.compile(r"\p{Lo}")
_FLAT = set("。！？．｡﹒﹗﹖")
_TOKEN = regex.compile(r"[^\s(\[“„«»\"‘]*$")
_ELIDED = regex.compile(r"(?:[ldnsmtcj]|qu)['’](.+)", regex.I)


def _pairs(t: str) -> list[tuple[int, int]]:
    """Outermost matched marks as (opening, closing), in order; marks without a partner count as text."""
    stack: list[tuple[int, str]] = []
    found: list[tuple[int, int]] = []
    for m in _MARK.finditer(t):
        c, i = m[0], m.start()
        at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][1] == c), None)
        if at is not None:
            found.append((stack[at][0], i))
            del stack[at:]
        elif c == '"':
            stack.append((i, '"'))
        elif c in _OPENS:
            stack.append((i, _OPENS[c]))
    found.sort()
    out: list[tuple[int, int]] = []
    for a, b in found:
        if not out or a > out[-1][1]:
            out.append((a, b))
    return out


class _Tongue:
    """The language around a place of a unit, else that of the unit, else that of its text; the latter two are told when first asked for."""

    def __init__(self, unit: str, whole: str):
        self.unit, self.whole, self.known = unit, whole, False

    def __call__(self, start: int, at: int) -> str | None:
        if near := language(self.unit[max(start, at - 200):at + 100]):
            return near
        if not self.known:
            self.lang, self.known = language(self.unit) or language(self.whole), True
        return self.lang


def _abbreviated(t: str, start: int, dot: int, nxt: str, after: int, tongue: _Tongue) -> bool:
    """Whether the full stop at `dot` belongs to a word that does not end its sentence."""
    word = _TOKEN.search(t[max(start, dot - 24):dot])[0]
    word = (_ELIDED.fullmatch(word) or [0, word])[1]
    low = word.lower().lstrip("¿¡")
    digit, upper = nxt.isdigit(), nxt.isupper()
    if not low:
        return digit  # .5 of a price
    if low.isdigit():
        head = not t[start:dot - len(word)].strip()
        return head or any(t.startswith(m, after) for m in MONTHS)
    if word == "m":  # a. m. and p. m.
        return not upper if regex.search(r"[ap]\.\s?$", t[max(0, dot - 4):dot - 1]) else True
    one = len(low) == 1 and low.isalpha() and low.upper() != low
    if one or low in _short:
        lang = tongue(start, dot)
        if low in _always[lang]:
            return True
        if low in _titles[lang] and word[0].isupper():
            return True
        if one:
            # an initial, unless it is a label or a sentence follows that begins with a function word
            before = t[max(start, dot - 40):dot - 1].split()
            if not before or word.islower() or (before[-1].endswith(".") and len(before[-1]) == 2):
                return True
            if before[-1].lower() in LABELS:
                return False
            follows = _LATIN_WORD.match(t, after)
            return not (follows and lang and follows[0].lower() in _function[lang])
        if low in _numbered[lang]:
            return digit
        if low in _may_end:
            return low == "co" and t.startswith("KG", after)
    parts = low.split(".")
    if len(parts) > 1 and all(len(p.strip("-")) <= 2 and p.strip("-").isalpha() for p in parts if p):
        return True
    return False


def _unit(t: str, base: int, whole: str) -> Iterator[tuple[int, int]]:
    """Sentences of one unit, as (first, last) character, counted from `base`."""
    tongue = _Tongue(t, whole)
    pairs = _pairs(t) if _MARK.search(t) else []
    opens = [a for a, _ in pairs]
    opening = set(opens)

    def around(i: int) -> tuple[int, int] | None:
        k = bisect.bisect_right(opens, i) - 1
        return pairs[k] if k >= 0 and pairs[k][1] > i else None

    cuts: list[int] = []
    start = len(t) - len(t.lstrip())
    thai = sorted(m.start() for m in _THAI_GAP.finditer(t) if not around(m.start())) if not t.isascii() and _THAI.search(t) else []
    k = 0
    for m in _END.finditer(t):
        while k < len(thai) and thai[k] < m.start():
            cuts.append(thai[k])
            start = thai[k] + 1
            k += 1
        i, e = m.start(), m.end()
        run = _RUN.match(m[0])[0]
        box, closed = around(i), None
        if box:
            # inside a quotation: only if it ends with it, the sentence may end
            if not i + len(run) <= box[1] < e:
                continue
            closed = box
            e = box[1] + 1
            while e < m.end() and around(e) is None and not t[e].isspace() and e not in opening:
                e += 1
        else:
            e = i + len(run)
            while e < m.end() and e not in opening and not t[e].isspace():
                e += 1
        word = _NEXT.search(t, e)
        if not word:
            cuts.append(len(t))
            start = len(t)
            break
        after = word.start()
        gap, nxt = after > e, t[after]
        seen = nxt
        if nxt in _OPENS or nxt in "\"¿¡":
            inner = _LETTER.search(t, after)
            seen = t[inner.start()] if inner else nxt
        flat = run[-1] in _FLAT
        if closed and not t[start:closed[0]].strip() and _OTHER.match(nxt):
            continue  # the quotation opens the sentence, who said it follows
        if closed and t[closed[1]] in "」』" and regex.match(r"\p{L}", nxt):
            continue
        if nxt in ",;:،؛，、；：-–—":
            continue
        if flat:
            cuts.append(e)
            start = e
            continue
        # a mark that ends any sentence does so without a blank, too, between a word and a capital; a full stop does not
        if not gap and not (run[-1] in "।॥۔؟!?" and (_OTHER.match(nxt) or (run[-1] in "!?" and nxt.isupper() and i and t[i - 1].isalpha()))):
            continue
        if seen.islower():
            continue
        if ("…" in run or "⋯" in run or ".." in run) and not (seen.isupper() or seen.isdigit() or (nxt in _OPENS and not _OTHER.match(seen))):
            continue
        if run == "." and not closed and e == i + 1 and _abbreviated(t, start, i, nxt, after, tongue):
            continue
        cuts.append(e)
        start = after
    cuts += thai[k:] if not cuts or cuts[-1] < len(t) else []
    last = 0
    for c in [*cuts, len(t)]:
        s = t[last:c]
        if s.strip():
            a = last + len(s) - len(s.lstrip())
            b = last + len(s.rstrip())
            yield base + a, base + b - 1
        last = max(last, c)


def split_sentences(text: str | None) -> list[tuple[int, int]]:
    """(first, last) character of each sentence, counted in code points from 0, without outer blanks."""
    if not text or not text.strip():
        return []
    out, at = [], 0
    for m in _PARAGRAPH.finditer(text):
        out += _unit(text[at:m.start()], at, text)
        at = m.end()
    return out + list(_unit(text[at:], at, text))


def sentence_units(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, start_pos, end_pos (int, code points from 1): one row a sentence.

    Null and blank texts have no row; repeated rows give repeated rows; other columns are ignored.
    A text of any length is cut in one pass; the rows are mapped where they are, without a shuffle.
    """
    kt = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, a, b = [], [], []
            for k, t in zip(pdf[key], pdf[text]):
                for x, y in split_sentences(t) if isinstance(t, str) else ():
                    ids.append(k)
                    a.append(x + 1)
                    b.append(y + 1)
            yield pd.DataFrame({key: pd.Series(ids, dtype=pdf[key].dtype), "start_pos": a, "end_pos": b})

    return docs.select(key, text).mapInPandas(run, f"`{key}` {kt}, start_pos int, end_pos int")
