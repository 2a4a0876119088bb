"""Mapping free-entered values to a canonical list (problem 1).

An automaton holds the canonical names and their aliases, given by the caller or made by rule from
tables of word forms; it finds all mentions embedded in a value, of which the longest that do not
overlap are kept. Values without a mention go to token-set similarity, in which a token may be a
known form of the entry's token or one typing slip away from it; an index of tokens tells which
entries can be meant. The tables in this module are those of job titles; other lists bring their own.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ways to write a word of a job title.
WORD_FORMS = {
    "manager": ["mgr", "mngr", "managerin", "mgmt"],
    "director": ["dir", "directrice", "direktor", "direktorin", "directora"],
    "chief": ["chf"],
    "officer": ["off", "ofc", "offcr"],
    "executive": ["exec", "executives"],
    "president": ["pres"],
    "vice": ["v"],
    "marketing": ["mktg", "mkt", "mkting"],
    "product": ["prod"],
    "development": ["dev", "devel"],
    "developer": ["dev", "devrel", "developer relations", "dev relations"],
    "business": ["bus", "biz"],
    "account": ["acct", "acc", "accounts"],
    "enterprise": ["ent"],
    "customer": ["cust", "client"],
    "solutions": ["solution", "soln"],
    "engineer": ["eng", "engr", "engineering"],
    "events": ["event"],
    "operations": ["ops", "operation"],
    "analyst": ["anlst"],
    "representative": ["rep"],
    "specialist": ["spec"],
    "consultant": ["cons"],
    "information": ["info"],
    "security": ["sec"],
    "information security": ["infosec", "it security", "cyber security"],
    "pre sales": ["presales"],
    "human resources": ["hr"],
    "public relations": ["pr", "public rel", "press relations"],
    "talent acquisition": ["ta", "talent acq", "recruiting"],
    "machine learning": ["ml"],
    "supply chain": ["sc", "supplychain"],
    "demand generation": ["demand gen", "demandgen"],
    "partner": ["partners", "partnership", "partnerships"],
    "financial": ["fin", "finance"],
    "revenue": ["rev"],
    "regional": ["reg", "area"],
    "general": ["gen"],
    "head": ["hd", "lead", "leiter", "leiterin", "team head", "chef de"],
    "controller": ["controllerin"],
    "counsel": ["counsellor"],
    "procurement": ["purchasing and procurement", "purchasing procurement"],
    "software": ["sw"],
    "channel": ["channels"],
    "sales": ["sls"],
}
# Whole titles that are no spelling of their entry's words.
PHRASES = {
    "chief marketing officer": ["cmo", "directeur marketing general", "directrice marketing general", "marketingvorstand", "director general de marketing", "director de marketing general"],
    "chief revenue officer": ["cro"],
    "chief financial officer": ["cfo", "finanzvorstand", "director financiero", "director financiero general", "directeur financier", "directrice financiere", "chief finance officer"],
    "chief information security officer": ["ciso", "chief infosec officer"],
    "founder and chief executive": ["ceo and founder", "founder and ceo", "ceo founder", "founder ceo", "founding ceo", "co founder and ceo", "founding chief executive", "grunder und geschaftsfuhrer", "fondateur et pdg", "fundador y director general"],
    "vice president of sales": ["vp sales", "vp of sales", "v p of sales", "v p sales", "sales vp", "vicepresidente de ventas", "vicepresidenta de ventas", "vice president ventes", "vertriebsvorstand"],
    "community manager": ["responsable de communaute", "responsable communaute", "gestor de comunidad", "community managerin"],
    "brand director": ["markenleiter", "markenleiterin", "directeur de marque", "director de marca"],
    "solutions engineer": ["ingenieur solutions", "losungsingenieur", "ingeniero de soluciones"],
    "events manager": ["gestor de eventos", "gestora de eventos", "responsable evenementiel", "veranstaltungsmanager"],
    "inside sales specialist": ["innendienst vertriebsspezialist", "vertriebsspezialist innendienst"],
    "financial controller": ["finanzcontroller", "finanzcontrollerin", "controleur financier", "controller financiero"],
    "partner manager": ["partnermanager", "partnermanagerin", "gestor de socios", "responsable partenaires"],
    "regional sales manager": ["gerente regional de ventas", "regionaler vertriebsleiter", "regionalvertriebsleiter", "responsable regional des ventes"],
    "human resources director": ["drh", "directeur rh", "directrice rh", "personalleiter", "personaldirektor", "director de recursos humanos", "directeur des ressources humaines"],
    "data engineer": ["dateningenieur", "dateningenieurin", "ingeniero de datos", "ingenieur de donnees", "ingenieur donnees"],
    "operations manager": ["betriebsleiter", "betriebsleiterin", "gerente de operaciones", "responsable des operations"],
    "procurement manager": ["responsable achats", "einkaufsleiter", "gerente de compras", "purchasing manager"],
    "general counsel": ["gc", "chefjustiziar", "chef justiziar", "chefsyndikus", "directeur juridique", "director juridico"],
    "software engineer": ["swe", "softwareentwickler", "softwareentwicklerin", "ingenieur logiciel", "ingeniero de software"],
    "machine learning engineer": ["mle"],
    "head of treasury": ["leiter treasury", "treasury lead"],
    "head of content": ["content lead", "leiter content"],
    "sales development representative": ["sdr"],
    "account executive": ["ae"],
    "customer success manager": ["csm"],
    "business development manager": ["bdm", "biz dev manager"],
    "product marketing manager": ["pmm", "produktmarketingmanager"],
    "talent acquisition partner": ["tap"],
    "sales operations analyst": ["soa"],
    "pre sales consultant": ["presales consultant"],
}
# Whoever helps the holder of a job, or learns it, has another job.
HELPERS = {"assistant", "assistants", "asst", "assistente", "assistentin", "assistenz", "assistante", "asistente", "secretary", "sekretar", "sekretarin", "secretaire", "secretaria", "intern", "praktikant", "praktikantin", "stagiaire", "trainee", "trainees", "apprentice", "azubi", "student", "studentin", "werkstudent", "volunteer", "pa", "aide", "becario"}
STOP = {"of", "and", "the", "for", "a", "an", "de", "des", "du", "und", "et", "y", "in", "at", "to", "la", "le", "der", "die", "fur"}
LOOKALIKE = str.maketrans("аеорсхуіјѕԁһкмтнвАЕОРСХУІЈЅКМТНВΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορνικτυ", "aeopcxyijsdhkmthbAEOPCXYIJSKMTHBABEZHIKMNOPTYXaopviktu")


@lru_cache(maxsize=200_000)
def plain(text: str) -> str:
    """Lower case, no accents, look-alike letters folded, words parted by single spaces."""
    t = unicodedata.normalize("NFKD", text.translate(LOOKALIKE)).casefold()
    t = "".join(c for c in t if not unicodedata.combining(c)).replace("ß", "ss").replace("&", " and ").replace("+", " and ")
    return " ".join(re.findall(r"[^\W_]+", t))


def one_slip(a: str, b: str) -> bool:
    """Equal, or one letter added, lost, changed or two neighbours swapped; words under four letters must be equal."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1 or min(la, lb) < 4:
        return False
    i = 0
    while i < min(la, lb) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i:] == b[i + 1:] or a[i + 1:] == b[i:] or (a[i:i + 2] == b[i:i + 2][::-1] and a[i + 2:] == b[i + 2:])


def slip_keys(w: str) -> set[str]:
    """Words that `one_slip` holds equal share one: the word, and with one letter less."""
    return {w} | ({w[:i] + w[i + 1:] for i in range(len(w))} if len(w) >= 4 else set())


MOST_COMBINATIONS = 4096


class Matcher:
    """Maps a value to one of the entries, or to none.

    Tokens of an entry are its words with multi-word units (`human resources`) kept whole. `forms`
    gives other ways to write a token, `aliases` other names of an entry (by its plain spelling);
    values with one of the words `helpers` name no entry.
    """

    def __init__(self, entries: list[str], forms: dict[str, list[str]] = WORD_FORMS, aliases: dict[str, list[str]] = PHRASES, helpers: set[str] = HELPERS):
        self.word_forms, self.helpers = forms, helpers
        self.entries = sorted(set(entries), key=lambda e: (plain(e), e))
        own = {plain(k): v for k, v in aliases.items()}
        self.auto = ahocorasick.Automaton()
        seen: dict[str, int] = {}
        self.units: list[list[str]] = []
        self.patterns: list[tuple[int, re.Pattern]] = []
        for i, e in enumerate(self.entries):
            self.units.append(self._units(plain(e)))
            for p in (plain(e), plain(e).replace(" ", ""), *map(plain, own.get(plain(e), []))):
                if p:
                    seen.setdefault(p, i)
            choices = [self._forms(u) for u in self.units[-1]]
            if math.prod(map(len, choices)) <= MOST_COMBINATIONS:
                for p in self._combined(choices):
                    seen.setdefault(p, i)
            else:  # the same ways to write it, as a pattern
                self.patterns.append((i, self._pattern(choices)))
        for p, i in seen.items():
            self.auto.add_word(f" {p} ", (i, len(p)))
        if seen:
            self.auto.make_automaton()
        self.seen = seen
        self.forms = [[set(self._forms(u)) for u in us] for us in self.units]
        # for each word of a form, near or exact, the units it may stand for
        self.index: dict[str, set[tuple[int, int]]] = defaultdict(set)
        for i, units in enumerate(self.forms):
            for u, fs in enumerate(units):
                for f in fs:
                    for k in slip_keys(f.split()[0]) if f else ():
                        self.index[k].add((i, u))

    def _units(self, e: str) -> list[str]:
        words, out = [w for w in e.split() if w not in STOP], []
        while words:
            n = 2 if " ".join(words[:2]) in self.word_forms and len(words) > 1 else 1
            out.append(" ".join(words[:n]))
            words = words[n:]
        return out

    def _forms(self, unit: str) -> list[str]:
        words = [[w, *self.word_forms.get(w, [])] for w in unit.split()] if " " in unit else [[unit]]
        return list(dict.fromkeys([*(" ".join(ws) for ws in itertools.product(*words)), *self.word_forms.get(unit, [])]))

    @staticmethod
    def _combined(choices: list[list[str]]) -> Iterator[str]:
        """Every way to write the units: in order, or with the last or first one moved to the other end, and with `of`."""
        if not choices:
            return
        for combo in itertools.product(*choices):
            for ws in (combo, (*combo[-1:], *combo[:-1]), (*combo[1:], combo[0])):
                yield " ".join(ws)
                yield f"{ws[0]} of {' '.join(ws[1:])}"
                yield f"{' '.join(ws[:-1])} of {ws[-1]}"

    @staticmethod
    def _pattern(choices: list[list[str]]) -> re.Pattern:
        alt = ["(?:" + "|".join(sorted(map(re.escape, c), key=len, reverse=True)) + ")" for c in choices]
        ways = []
        for ws in (alt, [alt[-1], *alt[:-1]], [*alt[1:], alt[0]]):
            ways += [" ".join(ws), f"{ws[0]} of {' '.join(ws[1:])}", f"{' '.join(ws[:-1])} of {ws[-1]}"]
        return re.compile("(?<= )(?:" + "|".join(ways) + ")(?= )")

    def mentions(self, text: str) -> list[tuple[int, int]]:
        """(length, entry) of the longest mentions that do not overlap, longest first."""
        s = f" {text} "
        found = [(n, end - n, i) for end, (i, n) in self.auto.iter(s)] if self.seen else []
        for i, p in self.patterns:
            found += [(m.end() - m.start(), m.start(), i) for m in p.finditer(s)]
        kept, marked = [], bytearray(len(s))
        for n, at, i in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if not any(marked[at:at + n]):
                marked[at:at + n] = b"\x01" * n
                kept.append((n, i))
        return kept

    def similar(self, words: list[str]) -> tuple[float, int] | None:
        """(score, entry) of the entry all of whose tokens are among the words, with known forms and single slips; the one that leaves the fewest words over."""
        bag = [w for w in words if w not in STOP]
        pairs = [" ".join(p) for p in zip(bag, bag[1:])]
        may: dict[int, set[int]] = defaultdict(set)
        for w in bag:
            for k in slip_keys(w):
                for i, u in self.index.get(k, ()):
                    may[i].add(u)
        best, score = None, 0.0
        for i in sorted(i for i, us in may.items() if len(us) == len(self.forms[i])):
            free, hit = list(bag), 0
            for fs in self.forms[i]:
                at = next((w for w in free if w in fs), None) or next((w for w in free for f in fs if " " not in f and len(f) > 4 and one_slip(w, f)), None)
                if at is not None:
                    free.remove(at)
                    hit += 1
                    continue
                two = next((p for p in pairs for f in fs if " " in f and (p == f or (len(f) > 8 and all(one_slip(x, y) for x, y in zip(p.split(), f.split()))))), None)
                if two is None:
                    break
                for w in two.split():
                    if w in free:
                        free.remove(w)
                hit += 1
            if hit == len(self.forms[i]) and (s := hit / (hit + len(free)) + hit) > score:
                best, score = i, s
        return None if best is None else (score, best)

    def rated(self, value: str | None) -> tuple[int, float, str] | None:
        """(1 for a mention and 0 for similarity, its length or score, entry) of the best entry."""
        text = plain(value) if value else ""
        words = text.split()
        if not text or self.helpers & set(words):
            return None
        if got := self.mentions(text):
            return 1, float(got[0][0]), self.entries[got[0][1]]
        s = self.similar(words)
        return s and (0, s[0], self.entries[s[1]])

    def match(self, value: str | None) -> str | None:
        got = self.rated(value)
        return got and got[2]


MOST_BYTES = 8 << 20


def map_to_entries(rows: DataFrame, key: str, value: str, entries: list[str], report_unmatched: bool = False, forms: dict[str, list[str]] = WORD_FORMS, aliases: dict[str, list[str]] = PHRASES, helpers: set[str] = HELPERS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """`key`, `entry`: each row whose value names an entry of the list, at most one entry a row.

    A list of at most `most_bytes` goes to every task inside the matcher, and rows are mapped where
    they are, without a shuffle; a longer one is cut into such parts, each distinct value is rated by
    every part, and the best rating counts. A value naming several entries gets the longest mention,
    then the first entry in the order of spelling. `forms`, `aliases` and `helpers` are as in `Matcher`.
    Null, blank or filler values and those that name a helper of the job name no entry. With
    `report_unmatched` such rows come with a null entry. Repeated rows give repeated rows.
    """
    kt = dict(rows.dtypes)[key]
    parts: list[list[str]] = [[]]
    size = 0
    for e in sorted(set(entries), key=lambda e: (plain(e), e)):
        size += len(e.encode())
        if size > most_bytes and parts[-1]:
            parts.append([])
            size = len(e.encode())
        parts[-1].append(e)
    own = rows.select(F.col(key).alias("__k"), F.col(value).alias("__v"))

    if len(parts) == 1:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = Matcher(entries, forms, aliases, helpers)
            known = lru_cache(maxsize=500_000)(m.match)
            for pdf in batches:
                out = pd.DataFrame({"__k": pdf["__k"], "entry": [known(v) if isinstance(v, str) else None for v in pdf["__v"]]})
                yield out if report_unmatched else out[out["entry"].notna()]

        return own.mapInPandas(run, f"__k {kt}, entry string").toDF(key, "entry")

    values = own.select("__v").where("__v is not null").distinct()

    def rated(part: list[str]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = Matcher(part, forms, aliases, helpers)
            for pdf in batches:
                found = [(v, *r) for v in pdf["__v"] if (r := m.rated(v))]
                yield pd.DataFrame(found, columns=["__v", "kind", "score", "entry"])

        return values.mapInPandas(run, "__v string, kind int, score double, entry string")

    every = rated(parts[0]).withColumn("part", F.lit(0))
    for n, part in enumerate(parts[1:], 1):
        every = every.unionAll(rated(part).withColumn("part", F.lit(n)))
    best = every.groupBy("__v").agg(F.max_by("entry", F.struct("kind", "score", -F.col("part"))).alias("entry"))
    return own.join(best, "__v", "left" if report_unmatched else "inner").select(F.col("__k").alias(key), "entry")
