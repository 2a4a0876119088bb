"""Personal information inside free text (problem 6): offset-preserving deobfuscation.

A text is first rewritten by small transducers: look-alike letters inside Latin words become Latin,
full-width signs plain, invisible signs vanish, spelled digits become digits, at/dot disguises
become `@` and `.`. Each rewritten character knows its source characters. Identifiers are detected
in the rewritten text, and their spans are mapped back, so that placeholders replace exactly the
source characters and the rest of the text stays as it is.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.canonical import LOOKALIKE

TYPES = ["email", "id_number", "street_address", "phone", "person_name"]
# Digit words.
DIGITS = {w: str(d) for d, ws in enumerate([
    "zero oh null zéro cero", "one eins un une uno", "two zwei zwo deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve",
]) for w in ws.split()}
_dw = "|".join(sorted(DIGITS, key=len, reverse=True))
_SPELLED = re.compile(rf"\b(?:{_dw})(?:[\s,.-]+(?:{_dw}))+\b", re.I)
_WORD = re.compile(rf"\b(?:{_dw})\b", re.I)
_DOT = r"\s*[(\[{<]\s*(?:dot|punkt|point|punto)\s*[)\]}>]\s*"
_AT = re.compile(r"[(\[{<]\s*(?:at|ät|arroba|à)\s*[)\]}>]|@|(?<=\s)at(?=\s)", re.I)
_HOST = re.compile(rf"[\w-]+(?:(?:{_DOT}|\s+dot\s+|\.)[\w-]+)+", re.I)
_SPELLED_HOST = re.compile(rf"[\w-]+(?:(?:{_DOT}|\s+dot\s+)[\w-]+)+", re.I)
_DOTS = re.compile(rf"{_DOT}|\s+dot\s+|\.", re.I)


def _local(t: str, at: int, done: int) -> int:
    """Where the run of signs of an address that ends before `at` begins."""
    while at > done and (t[at - 1].isalnum() or t[at - 1] in "_.+%-"):
        at -= 1
    return at


def _disguises(t: str) -> Iterator[tuple[int, int, re.Match]]:
    """(start and end of what stands for the at sign, host) of addresses written apart; each is built outwards from its at sign, so that the time is linear."""
    done, n = 0, len(t)
    for m in _AT.finditer(t):
        s, e = m.span()
        b = e
        while b < n and t[b].isspace():
            b += 1
        word = m[0].lower() == "at"
        if m[0] == "@" and b == e and not (s and t[s - 1].isspace()):
            continue
        host = (_SPELLED_HOST if word else _HOST).match(t, b)
        if not host:
            continue
        a = s
        while a > done and t[a - 1].isspace():
            a -= 1
        if _local(t, a, done) < a:
            yield a, b, host
            done = host.end()


_EMAIL_HOST = re.compile(r"@[^\W_][\w-]*(?:\.[^\W_][\w-]*)+")


def _emails(t: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = t.find("@")
    while at >= 0:
        if m := _EMAIL_HOST.match(t, at):
            a = _local(t, at, done)
            while a < at and not t[a].isalnum():
                a += 1
            if a < at:
                yield a, m.end()
                done = m.end()
        at = t.find("@", max(at + 1, done))


_TWO = re.compile(rf"\b(?:{_dw})[\s,.-]+(?:{_dw})[\s,.-]+(?:{_dw})\b", re.I)
_INVISIBLE = set("\u200b\u200c\u200d\u2060\ufeff\u00ad")


_ODD = re.compile(r"[\u00ad\u200b-\u200d\u2060\ufeff\uff01-\uff5e\u0370-\u052f\u0660-\u0669\u06f0-\u06f9\u0966-\u096f]")


def rewrite(text: str, disguised: bool = True, spelled: bool = True) -> tuple[str, list[int] | None, list[int] | None]:
    """(rewritten text, first source character of each character, one past its last); no lists where nothing changed.

    `disguised` and `spelled` tell whether the text can hold at/dot disguises and spelled digits at all.
    """
    out, first, last = text, None, None
    if not text.isascii() and _ODD.search(text):
        chars, at = [], []
        latin = [False] * len(text)
        for m in re.finditer(r"[^\W\d_]+", text):
            w = m[0]
            if not w.isascii() and any("a" <= c.lower() <= "z" for c in w):
                latin[m.start():m.end()] = [True] * len(w)
        for i, c in enumerate(text):
            if c in _INVISIBLE:
                continue
            d = c.translate(LOOKALIKE) if latin[i] else c
            if "！" <= d <= "～":
                d = chr(ord(d) - 0xFEE0)
            elif d.isdecimal() and not d.isascii():
                d = str(unicodedata.decimal(d))
            chars.append(d)
            at.append(i)
        if (new := "".join(chars)) != text:
            out, first, last = new, at, [i + 1 for i in at]
    edits: list[tuple[int, int, str]] = []
    if disguised:
        for a, b, host in _disguises(out):
            edits.append((a, b, "@"))
            edits += [(x.start(), x.end(), ".") for x in _DOTS.finditer(out, host.start(), host.end())]
    if spelled and _TWO.search(out):
        for m in _SPELLED.finditer(out):
            ws = list(_WORD.finditer(out, m.start(), m.end()))
            if len(ws) >= 5:
                edits += [(*w.span(), DIGITS[w[0].lower()]) for w in ws]
                edits += [(a.end(), b.start(), "") for a, b in zip(ws, ws[1:])]
    if edits:
        edits.sort()
        parts, f, l, at = [], [], [], 0
        src = (lambda i: first[i]) if first else (lambda i: i)
        end = (lambda i: last[i]) if last else (lambda i: i + 1)
        for a, b, s in [*edits, (len(out), len(out), "")]:
            if a < at:
                continue
            parts.append(out[at:a])
            f += [src(i) for i in range(at, a)]
            l += [end(i) for i in range(at, a)]
            if s:
                parts.append(s)
                f.append(src(a))
                l.append(end(b - 1))
            at = b
        out, first, last = "".join(parts), f, l
    return out, first, last


# No pattern has an open end before what it needs, so that any text takes linear time.
_ID = re.compile(
    r"\b\d{3}-\d{2}-\d{4}\b(?!-)"  # SSN
    r"|\b(?:my |his |her )?social(?: security)?(?: (?:no|number|nr)\.?)?(?:\s+is|[:=])?\s*\d{3}[ -]?\d{2}[ -]?\d{4}\b"
    r"|\b(?:SSN|TIN)\W{0,3}\d{3}[ -]?\d{2}[ -]?\d{4}\b"
    r"|\b(?:NI(?:NO)?(?: (?:no|number)\.?)?\W{0,3})?[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b"  # NINO
    r"|(?:Steuer-?ID(?:-?Nr)?|Steuernummer|IdNr|Tax[ -]?ID|TIN)\W{0,3}(?:\d[ /-]?){9,12}\b"
    r"|\b[A-Z]\d{3}-\d{4}-\d{4}\b"  # driver's licence
    r"|driver'?s? licen[cs]e\W{0,3}(?:no\.? ?|number ?)?[A-Z0-9][A-Z0-9 -]{5,30}\d"
    r"|(?<![\d-])\d{6}[-+]\d{4}\b(?!-)"  # personnummer
    r"|\bpersonnummer\W{0,3}\d{6,8}[-+ ]?\d{4}\b"
    r"|\b\d{3}\.\d{3}\.\d{3}-\d{2}\b"  # CPF
    r"|\bnational id(?:entity)?(?: (?:no|number)\.?)?\W{0,3}[A-Z0-9][A-Z0-9. -]{5,30}\d"
    r"|\baadhaar(?: (?:no|number)\.?)?\W{0,3}\d{4}[ -]?\d{4}[ -]?\d{4}\b"
    r"|\bpassport(?:\s+(?:no\.?|number|nr\.?|num\.?))?\W{0,3}[A-Z]{1,2}\d{6,9}\b"
    r"|(?:Reisepass|Pass-?Nr\.?|pasaporte|passeport)\W{0,3}(?:no\.?|n[.º°]*|nr\.?)?\s*[A-Z]{1,2}\d{6,9}\b"
    r"|(?<![\w-])\d{8}-?[A-HJ-NP-TV-Z]\b(?!-)|\b[XYZ]-?\d{7}-?[A-Z]\b"  # DNI, NIE
    r"|\b(?:DNI|NIF|NIE)\W{0,3}[XYZ]?\d{7,8}-?[A-Z]\b", re.I)
_cap = r"[A-ZÀ-ÖØ-Þ][\w'’.-]{0,60}"
_en = r"Close|Road|Lane|Street|Avenue|Ave|Terrace|Rise|Drive|Way|Court|Place|Square|Crescent|Gardens|Row|Hill|Boulevard|Blvd|Grove|Mews|Walk|Parade|Alley|Park|St|Rd|Ln|Dr"
_STREET = re.compile(
    rf"\b\d{{1,5}}[A-Za-z]?(?:/\d+)?,?\s+(?:{_cap}\s+){{1,4}}(?:{_en}|{_en.upper()})\b\.?(?:,\s*(?:Suite|Flat|Apt|Apartment|Unit|Floor|SUITE|FLAT)\.?\s*#?\w+)?(?:,\s*(?:{_cap}\s*){{1,3}}\d{{4,5}})?"
    rf"|\b\d{{1,5}}(?:\s*(?:bis|ter|quater))?,?\s+(?:rue|avenue|impasse|boulevard|bd|allée|chemin|place|quai|cours|route|square|passage|ruelle|RUE|AVENUE|IMPASSE)\s+(?:(?:de la|de l['’]|du|des|de|d['’]|l['’]|DES|DU|DE)\s*)?{_cap}(?:[\s-]{_cap}){{0,8}}(?:,\s*\d{{5}}\s+{_cap})?"
    rf"|\b(?:Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Auf der|Hinter dem|Unter den|Bei den)\s+(?:{_cap}\s+){{1,3}}\d{{1,4}}\s?[a-z]?\b(?:,\s*\d{{5}}\s+{_cap})?"
    rf"|\b(?:Calle|C/|Avda\.?|Avenida|Plaza|Paseo|Camino|Carrera|Ronda|Travesía|CALLE|AVENIDA|PLAZA)\s*(?:(?:de los|de las|de la|del|de)\s+)?{_cap}(?:\s+{_cap}){{0,8}},?\s+(?:n\.?º\s*)?\d{{1,4}}\b(?:,\s*\d{{1,2}}\s?[ºª°]\s*\w?)?"
    r"|\b(?:P\.?\s?O\.?\s?Box|PO\s?Box|p\.?o\.?\s?box|Post(?:al)? Box|Postfach|Apartado(?: de correos)?|Casilla|Boîte postale|B\.P\.)\s*(?:no\.?\s*)?\d{1,6}\b(?:,\s*[A-Z][\w-]+)?")
# streets named by their last word, with what may stand before it
_TAIL_STREET = re.compile(rf"(?:(?<=[\w-])(?:gasse|straße|strasse|str\.|weg|platz|allee|ring|ufer|damm|steig|pfad|markt)|\b(?:Straße|Strasse|Str\.|Gasse|Weg|Platz|Allee|Ring))\s+\d{{1,4}}\s?[a-z]?\b(?:,\s*\d{{5}}\s+{_cap}(?:\s+(?:am|an der|bei)\s+{_cap})?)?")
_CAP_BEFORE = re.compile(r"\b[A-ZÀ-ÖØ-Þ][\w'’.-]*\s+$")
_BLOCK = re.compile(r"[市区町村郡県都府][一-鿿ぁ-んァ-ヶー]{0,40}\d{1,3}(?:丁目\d{0,3}(?:番地?)?(?:\d{1,3}号?)?|番地?\d{0,3}号?|-\d{1,3}(?:-\d{1,3})?)")
_DENSE_RUN = re.compile(r"[一-鿿ぁ-んァ-ヶー]*$")


def _streets(t: str) -> Iterator[tuple[int, int]]:
    for m in _STREET.finditer(t):
        yield m.span()
    for m in _TAIL_STREET.finditer(t):
        a, e = m.span()
        if t[a].isupper():
            if before := _CAP_BEFORE.search(t, max(0, a - 64), a):
                a = before.start()
        else:
            run = a
            while run > 0 and a - run < 64 and (t[run - 1].isalnum() or t[run - 1] in "_-"):
                run -= 1
            # the first capital that begins a part of the word
            while run < a and not (t[run] in "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜ" and (run == 0 or not (t[run - 1].isalnum() or t[run - 1] == "_"))):
                run += 1
            if run == a:
                continue
            a = run
        yield a, e
    if not t.isascii():
        for m in _BLOCK.finditer(t):
            yield _DENSE_RUN.search(t, max(0, m.start() - 40), m.start()).start(), m.end()


_PHONE = re.compile(
    r"(?<![\w+.,/-])\+\d{1,3}(?:[\s./-]{0,2}\(?\d{1,5}\)?){2,6}(?:\s*(?:ext|extn|x|durchwahl|poste)\.?\s*\d{1,5})?(?![\w-])"
    r"|(?<![\w+])\(\d{2,5}\)\s?\d{3,4}[\s-]?\d{3,4}(?:\s*(?:ext|extn|x)\.?\s*\d{1,5})?(?![\w-])"
    r"|(?<![\w+.,/-])[2-9]\d{2}-\d{3}-\d{4}(?![\w-])"
    r"|(?<![\w+.,/-])[2-9]\d{2}\.\d{3}\.\d{4}(?![\w.-])"
    r"|(?<![\w+.,/-])(?<!\d )0(?!00)\d{1,4}(?:[ /]\d{2,8}){1,4}(?![\w/-])"
    r"|(?<![\w+.,/-])0\d{9,10}(?![\w-])", re.I)
_AMOUNT = re.compile(r"\d{1,3}(?: \d{3})* 000")
_CUED_PHONE = re.compile(r"(?:\b(?:tel|telefon|teléfono|téléphone|phone|phone_number|call|mobile|mobil|handy|cell|whatsapp|fax|ring me on|text|rückruf[\w ]{0,40})\b[\s.:=]*(?:is |me on |bitte unter )?)(\(?\+?\d[\d\s()./-]{5,18}\d)(?![\w-])", re.I)

# What stands before or after a person's name.
TITLES = r"(?:Dr|Mr|Mrs|Ms|Mx|Prof|Herr|Herrn|Frau|Sr|Sra|Srta|Mme|Mlle|Monsieur|Madame|Señor|Señora|Don|Doña|Sir|Dame)\b\.?"
_TITLED = re.compile(rf"\b{TITLES}\s+([^\W\d_][\w'’-]+(?:\s+(?:van der|van|von|de|[A-Z]\.)\s+[^\W\d_][\w'’-]+|\s+[A-ZÀ-Þ][\w'’-]+)?)")
_LEFT = (r"forwarding this to|send it to|you should talk to|talk to|spoke (?:with|to)|met|courier contact|my colleague|je travaille avec|pregunte por|bitte an|intro via|introduced by|cc|per|attn\.?:?|owner=|contact=|name=|name:|owner:|best,|thx|regards,|cheers,|gruß,?|saludos,?|hi|hey|hallo|hello|dear|hola|bonjour|with|via|--\s*\n")
_nonlatin = r"[Ͱ-᷿぀-￯][Ͱ-᷿぀-￯'’.-]*"
_FOREIGN = re.compile(rf"(?:(?P<l>{_LEFT})\s*|(?<!\S))(?P<n>{_nonlatin}(?:[  ]{_nonlatin}){{0,3}})(?P<r>\s*(?:,|\.|;|/|$|\n| [A-Za-zÀ-ÿ(]))", re.I)
_FOREIGN_RIGHT = re.compile(r"\s*(?:/|\(|,\s*tel|owns the|asked about|is on leave|will join|\n|$)", re.I)
_HAS_FOREIGN = re.compile(r"[Ͱ-᷿぀-￯]")
_INITIAL = re.compile(rf"(?:(?P<l>{_LEFT})\s*)?(?<![\w.])(?P<n>[A-Z]\.\s(?:[A-Z]\.\s)?(?:van der\s|van\s|von\s|de\s)?(?P<s>[^\W\d_][\w'’-]{{2,60}}))|(?<![\w.])(?P<n2>(?P<s2>[^\W\d_][\w'’-]{{2,60}}),\s[A-Z]\.)", re.I)
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_TAIL = re.compile(r"(?:\s+[A-Z]\.)?(?:\s+(?:van der|van|von|de|der|ter|al|bin)(?=\s))?\s+([^\W\d_]+(?:['’-][^\W\d_]+)*)")
_CUE_BEFORE = re.compile(rf"(?:{_LEFT})\s*$", re.I)


_RIGHT = re.compile(r"\s*(?:/\s|\(|<|,\s*tel\b|;|owns\b|asked\b|is on\b|will join|instead\b|at the booth|,\s*warm|,\s*wait|weiterleiten|en recepción|sur ce|\n|$|\.\s|\.$)")
_SURE = re.compile(r"\s*(?:/\s|\(|,\s*tel\b|owns\b|asked\b|is on\b|will join|instead\b|at the booth|,\s*warm|,\s*wait|weiterleiten|en recepción|sur ce)")
_DIGIT = re.compile(r"\d")
_CAP_DOT = re.compile(r"(?<![\w.])[A-Z]\.(?:\s|$)|,\s[A-Z]\.")
AT_HINT, STREET_HINT, ID_HINT, CUE_HINT, TITLE_HINT, WORD_HINT = 1, 2, 4, 8, 16, 32
# What must be in a text (in lower case) for the costly patterns to have a chance.
HINTS = {
    AT_HINT: ["@", "dot", "(", "[", "{", "<"],
    STREET_HINT: _en.lower().split("|") + "rue avenue impasse boulevard bd allée chemin quai cours route passage ruelle gasse straße strasse str. weg platz allee ring ufer damm steig pfad markt calle c/ avda avenida plaza paseo camino carrera ronda travesía 市 区 町 村 郡 県 都 府 box postfach apartado casilla postale b.p.".split() + ["am ", "an der ", "an den ", "im ", "in der ", "zum ", "zur ", "auf de", "hinter dem ", "unter den ", "bei den "],
    ID_HINT: "social ssn tin steuer idnr tax licen national passport pass pasaporte passeport personnummer dni nif nie".split(),
    CUE_HINT: "tel phone call mobile mobil handy cell whatsapp fax ring text rückruf".split(),
    WORD_HINT: list(DIGITS),
    TITLE_HINT: "dr mr mrs ms mx prof herr frau sr sra srta mme mlle monsieur madame señor don doña sir dame".split(),
}


def _hints() -> ahocorasick.Automaton:
    flags: dict[str, int] = {}
    for bit, words in HINTS.items():
        for w in words:
            flags[w] = flags.get(w, 0) | bit
    a = ahocorasick.Automaton()
    for w, f in flags.items():
        a.add_word(w, f)
    a.make_automaton()
    return a


# Capitalised words that begin a sentence after a name and are no surname.
STARTERS = set("i we you he she they it the a an this that these those how what who when where why which shall will would can could should do does did is are was were let please thanks thank sure no yes not next just our my your most great happy here understood interesting good hello hi hey dear hola bonjour guten pas sí si je nous il elle on le la les un une wir ich sie das der die ein eine passt bin el los las join room order lot ticket seats small three slides in at to for from with and or but as if".split())


class Taken:
    """Spans of which none overlap, with a quick test for a new one."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        k = bisect.bisect_right(self.starts, a)
        return (k == 0 or self.ends[k - 1] <= a) and (k == len(self.starts) or self.starts[k] >= b)

    def add(self, a: int, b: int) -> bool:
        if not self.free(a, b):
            return False
        k = bisect.bisect_right(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)
        return True


class Finder:
    """Finds personal information; names with the help of two sets of known given names and surnames (lower case)."""

    def __init__(self, given: set[str], surnames: set[str]):
        self.given, self.surnames = given, surnames
        self.known = given | surnames
        self.auto = _hints()

    def names(self, t: str, low: str, hints: int, taken: Taken) -> list[tuple[int, int]]:
        out = []
        if not self.known.isdisjoint(_TOKEN.findall(low)):
            for m in _TOKEN.finditer(t):
                w = m[0]
                k = w.lower()
                if k in self.given:
                    tail = _TAIL.match(t, m.end())
                    if tail is not None and tail[1].lower() in STARTERS:
                        tail = None
                    known = tail is not None and tail[1].lower() in self.surnames
                    guess = tail is not None and not known and (tail[1][0].isupper() == w[0].isupper())
                    cued = bool(_CUE_BEFORE.search(t, max(0, m.start() - 26), m.start()))
                    sure = guess and (bool(_SURE.match(t, tail.end())) or (cued and bool(_RIGHT.match(t, tail.end()))))
                    if w[0].isupper() or known or cued or sure:
                        full = known or sure or (guess and w[0].isupper() and tail[1][0].isupper() and tail[1].isupper() == w.isupper())
                        end = tail.end() if full else m.end()
                        back = re.search(r"[^\W\d_][\w'’-]+,\s$", t[max(0, m.start() - 40):m.start()])
                        start = m.start() - len(back[0]) if back and (back[0].rstrip(" ,").lower() in self.surnames or (back[0][0].isupper() and _CUE_BEFORE.search(t, max(0, m.start() - len(back[0]) - 26), m.start() - len(back[0])))) else m.start()
                        out.append((start, end))
                elif k in self.surnames and w[0].isupper():
                    out.append(m.span())
        if hints & TITLE_HINT:
            for m in _TITLED.finditer(t):
                ws = m[1].split()
                if ws[0][0].isupper() or ws[-1].lower() in self.surnames:
                    out.append((m.start(1), m.end(1) if ws[-1].lower() not in STARTERS else m.end(1) - len(ws[-1]) - 1))
        if _CAP_DOT.search(t):
            for m in _INITIAL.finditer(t):
                sur, k = (m["s"], "n") if m["n"] else (m["s2"], "n2")
                if not re.search(r"(?<!\w)[A-Z]\.", m[k]):
                    continue
                if sur.lower() in self.surnames or _SURE.match(t, m.end(k)) or (k == "n" and m["l"] and sur[0].isupper()):
                    out.append(m.span(k))
        if not t.isascii() and _HAS_FOREIGN.search(t):
            for m in _FOREIGN.finditer(t):
                if not re.search(r"[^\W\d_]", m["n"]) or re.search(r"[丁番号]", m["n"]):
                    continue
                if m["l"] or _FOREIGN_RIGHT.match(t, m.end("n")):
                    out.append(m.span("n"))
        return [s for s in out if taken.free(*s)]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(first, one past last, type) in the source text, in order, none overlapping."""
        t, first, last = rewrite(text, False, False)
        low, hints, words = t.lower(), 0, 0
        for _, f in self.auto.iter(low):
            hints |= f
            words += f & WORD_HINT
        if hints & AT_HINT or words >= 5 * WORD_HINT:
            t, first, last = rewrite(text, bool(hints & AT_HINT), words >= 5 * WORD_HINT)
            if t is not text:
                low = t.lower()
                for _, f in self.auto.iter(low):
                    hints |= f
        found: list[tuple[int, int, str]] = []
        taken = Taken()

        def add(a: int, b: int, kind: str) -> None:
            if taken.add(a, b):
                found.append((a, b, kind))

        for a, b in _emails(t):
            add(a, b, "email")
        digits = len(_DIGIT.findall(t))
        if digits >= 6:
            for m in _ID.finditer(t):
                add(*m.span(), "id_number")
        if digits and hints & STREET_HINT:
            for a, b in _streets(t):
                add(a, b, "street_address")
        if digits >= 7:
            for m in _PHONE.finditer(t):
                if 7 <= sum(c.isdigit() for c in m[0]) <= 18 and not _AMOUNT.fullmatch(m[0]):
                    add(*m.span(), "phone")
            if hints & CUE_HINT:
                for m in _CUED_PHONE.finditer(t):
                    if 7 <= sum(c.isdigit() for c in m[1]) <= 15:
                        add(*m.span(1), "phone")
            if t is not text and first and last:
                for m in re.finditer(r"\d{7,15}", t):  # spelled digits
                    if last[m.end() - 1] - first[m.start()] > (m.end() - m.start()) * 2:
                        add(*m.span(), "phone")
        for a, b in sorted(self.names(t, low, hints, taken), key=lambda s: (s[0], -s[1])):
            add(a, b, "person_name")
        if first:
            found = [(first[a], last[b - 1], k) for a, b, k in found]
        return sorted(found)

    def redact(self, text: str, spans: list[tuple[int, int, str]] | None = None) -> str:
        """The text with `[EMAIL]`, `[PHONE]`, ... in the place of what was found."""
        out, at = [], 0
        for a, b, k in self.spans(text) if spans is None else spans:
            out += [text[at:a], f"[{k.upper()}]"]
            at = b
        return "".join([*out, text[at:]])


def known_names(people: DataFrame, name: str) -> DataFrame:
    """word, given (true for a given name, false for a surname): every word of the people's names, as what it is more often.

    Read off the people we write to: the first and last word of a name, or the reverse where the
    surname comes first, before a comma. Credentials after a name are left out. A word seen as often
    as either counts as a given name. Null, blank and one-word names have none.
    """
    n = F.regexp_replace(F.trim(F.col(name)), r",\s*(?:[A-Z]{2,5}|PhD|Ph\.D\.|MSc|BSc|Dr)\s*$", "")
    comma = n.contains(",")
    parts = F.split(F.regexp_replace(n, ",", ""), r"\s+")
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    rows = people.where(F.col(name).isNotNull() & (F.size(parts) >= 2)).select(F.explode(F.array(
        F.struct(F.lit(1).alias("g"), F.lower(F.when(comma, last).otherwise(first)).alias("word")), F.struct(F.lit(-1).alias("g"), F.lower(F.when(comma, first).otherwise(last)).alias("word")))).alias("e")).select("e.*")
    return rows.where(F.col("word").rlike(r"^[\p{L}][\p{L}'’-]{2,}$")).groupBy("word").agg((F.sum("g") >= 0).alias("given"))


MOST_BYTES = 32 << 20
CACHED = 200_000
_finders: dict[tuple, Finder] = {}


def _worker_finder(key: tuple, given: frozenset[str], surnames: frozenset[str]) -> Finder:
    """One finder a Python worker, kept over its tasks."""
    if key not in _finders:
        _finders.clear()
        _finders[key] = Finder(given, surnames)
    return _finders[key]


def _scan(texts: DataFrame, keys: list[str], text: str, names: DataFrame, schema: str, emit, most_bytes: int) -> DataFrame:
    """Each row's keys with `emit` of its text and spans.

    Names whose words have at most `most_bytes` bytes together go to every task; of more, each text
    gets those it holds by a join on its words. Either way the same names are known.
    """
    size = names.agg(F.sum(F.octet_length("word") + 16)).first()[0] or 0
    kinds = dict(texts.dtypes)
    head = ", ".join(f"`{c}` {kinds[c]}" for c in keys)

    def rows(pdf: pd.DataFrame, found: list[list]) -> pd.DataFrame:
        at = [i for i, f in enumerate(found) for _ in f]
        out = pdf[keys].iloc[at].copy()
        flat = [x for f in found for x in f]
        for k, c in enumerate(emit.columns):
            # an empty list alone would have no type
            out[c] = pd.Series([x[k] for x in flat], dtype=object, index=out.index)
        return out

    if size <= most_bytes:
        known = sorted(map(tuple, names.collect()))
        given, surnames = frozenset(w for w, g in known if g), frozenset(w for w, g in known if not g)
        key = (len(known), hash(tuple(known)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            f, cache = _worker_finder(key, given, surnames), {}

            def one(t: object) -> list:
                if not isinstance(t, str):
                    return emit(f, None, [])
                if (got := cache.get(t)) is None:
                    got = emit(f, t, f.spans(t))
                    if len(t) < 1000:
                        if len(cache) >= CACHED:
                            cache.clear()
                        cache[t] = got
                return got

            for pdf in batches:
                yield rows(pdf, [one(t) for t in pdf[text]])

        return texts.select(*keys, text).mapInPandas(run, f"{head}, {schema}")

    t = texts.select(*keys, F.col(text).alias("__text")).withColumn("__hash", F.sha2("__text", 256))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(h, w) for h, x in zip(pdf["__hash"], pdf["__text"]) for w in set(_TOKEN.findall(rewrite(x, False, False)[0].lower()))]
            yield pd.DataFrame(found, columns=["__hash", "word"])

    distinct = t.where("__text is not null").select("__hash", "__text").distinct()
    own = distinct.mapInPandas(words, "__hash string, word string").join(names, "word").groupBy("__hash").agg(F.collect_list(F.when(F.col("given"), F.col("word"))).alias("__g"), F.collect_list(F.when(~F.col("given"), F.col("word"))).alias("__s"))
    empty = F.array().cast("array<string>")
    # no name is in a text that is not there
    t = t.join(own, "__hash", "left").select(*keys, "__text", F.coalesce("__g", empty).alias("__g"), F.coalesce("__s", empty).alias("__s"))

    def run_own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Finder(set(), set())
        for pdf in batches:
            found = []
            for x, g, s in zip(pdf["__text"], pdf["__g"], pdf["__s"]):
                f.given, f.surnames = set(g), set(s)
                f.known = f.given | f.surnames
                found.append(emit(f, x, f.spans(x)) if isinstance(x, str) else emit(f, None, []))
            yield rows(pdf, found)

    return t.mapInPandas(run_own, f"{head}, {schema}")


class _Types:
    columns = ("pii_type",)

    def __call__(self, f: Finder, text: str | None, spans: list[tuple[int, int, str]]) -> list[tuple]:
        return [(k,) for k in dict.fromkeys(k for _, _, k in spans)]


class _Redacted:
    columns = ("redacted", "n_found")

    def __call__(self, f: Finder, text: str | None, spans: list[tuple[int, int, str]]) -> list[tuple]:
        return [(None if text is None else f.redact(text, spans), len(spans))]


def find_types(texts: DataFrame, keys: list[str], text: str, names: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """`keys`, pii_type: one row for each type present in a row's text; `names` as `known_names` gives them. Null and blank texts have none; repeated rows give repeated rows; whole texts are read."""
    return _scan(texts, keys, text, names, "pii_type string", _Types(), most_bytes)


def redact(texts: DataFrame, keys: list[str], text: str, names: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """`keys`, redacted, n_found: each row's text with typed placeholders. Null stays null."""
    return _scan(texts, keys, text, names, "redacted string, n_found int", _Redacted(), most_bytes)
