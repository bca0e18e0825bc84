"""Words of names: what the corpus tells of them (`Lexicon`), and whole-span candidates for persons' names.

Every run of capitalised words, initials and particles gives candidates: all its parts of at most MAX_PARTS words. Nothing that the
lexicon knows decides what a candidate is; a word's class (listed given name, surname after titles, common word, unknown, ...) is a
feature of the span, like the words around it. Runs repeat, so what doesn't depend on their neighbours is worked out once per
distinct run.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut, spread

# Words around names, firms, laws, courts, streets and days in English, German and French.
TITLES = {
    *("mr", "mrs", "ms", "miss", "dr", "prof", "professor", "sir", "dame", "lady", "lord", "judge", "justice", "messrs"),
    *("herr", "herrn", "frau", "richter", "richterin", "rechtsanwalt", "rechtsanwältin"),
    *("mme", "mlle", "madame", "monsieur", "me", "maître", "mm"),
}
FIRM_WORDS = {
    *("ltd", "limited", "plc", "llp", "lp", "llc", "inc", "corp", "corporation", "co", "company", "gmbh", "mbh", "ag", "kg", "kgaa", "ohg", "e.k", "ug"),
    *("sarl", "sa", "sas", "sasu", "sci", "snc", "eurl", "cie", "spa", "srl", "bv", "nv", "holdings", "group", "brothers", "sons", "partners", "trust", "bank"),
}
LAW_WORDS = {"act", "acts", "code", "regulations", "rules", "directive", "convention", "treaty", "ordinance", "gesetz", "verordnung", "loi", "décret"}
COURT_WORDS = ("gericht", "court", "tribunal", "division", "cour", "conseil", "chambre", "senat", "kammer")
STREETS_EN = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Close|Cl|Terrace|Ter|Way|Drive|Dr|Boulevard|Blvd|Crescent|Cres|Square|Sq|Place|Pl|Court|Ct|Row|Gardens|Grove|Mews|Walk|Hill|Parade|Quay"
STREETS_DE = ("straße", "strasse", "str", "gasse", "weg", "platz", "brücke", "allee", "ufer", "ring", "damm", "steig", "hof", "markt", "chaussee", "pfad", "stieg")
MONTHS = {
    *("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"),
    *("januar", "februar", "märz", "mai", "juni", "juli", "oktober", "dezember"),
}
STOP_WORDS = {"en": (" the ", " of ", " was "), "de": (" der ", " die ", " und "), "fr": (" le ", " la ", " a été ")}

#: Elements of a name at most: the bound of a segment in the semi-Markov field.
MAX_PARTS = 8

_CAPS = "A-ZÀ-ÖØ-ÞŒ"
#: A class's part that holds all digits and what else is far from ASCII: searched several times faster than \d.
DIGITS = "0-9٠-\U0010ffff"
_LETTER = r"[^\W\d_]"
# what follows a word's capital: the usual letters in one leap each; backtracking could only drop whole parts after an apostrophe or hyphen
_REST = rf"[a-zß-öø-ÿ]*+{_LETTER}*+(?:['’‑-]{_LETTER}++(?:['’‑-]{_LETTER}++)*|)(?![\w█])"
_WORD = rf"[{_CAPS}]{_REST}"
_GOES_ON = rf"(?=[ ‑-]?[{_CAPS}]| (?:de|du|von|van|zu|d['’]))"
_SHORT = rf"(?:[{_CAPS}]|Mr|Mrs|Ms|Dr|Prof|St|Messrs|Hr|Hrn|Fr|Me|Mme|Mlle|MM)\.{_GOES_ON}"
_PART = r"de la|de|du|des|von der|von den|von|vom|van der|van den|van|zu|di|da|del|della|dos|bin|ben"
#: Legal forms that are written small, or that go on with another word: they close a run.
_FORM = r"(?:plc|llp|ltd|inc|co|sarl|sas|sa|e\.K|et Cie|et Fils|et Associés)(?!\w)|& [A-ZÀ-Þ]\w*"
_ELEMENT = re.compile(rf"{_SHORT}|{_WORD}|(?<= )(?:{_FORM})")
_NEXT = rf"(?:{_SHORT}|{_WORD})"
# the first word's capital comes first, so that the search leaps from capital to capital; every alternative is told by its first characters
RUN = re.compile(
    rf"[{_CAPS}](?<![\w█‑-].)(?:(?:rs?|s|rof|t|essrs|rn?|me|e|lle|M|)\.{_GOES_ON}|{_REST})"
    rf"(?: (?:{_NEXT}|(?:(?:{_PART}) (?:d['’]|)|d['’]){_NEXT})|, {_NEXT}|[‑-]?{_NEXT})*(?: (?:{_FORM}))*"
)
_POSSESSIVE = re.compile(r"['’][sS]$")
_PARTICLE_GAP = re.compile(rf" (?:(?:{_PART}) (?:d['’])?|d['’])$")
#: Last words of particles, in lower case.
PARTICLE_ENDS = {"de", "la", "du", "des", "von", "der", "den", "vom", "van", "zu", "di", "da", "del", "della", "dos", "bin", "ben", "d"}
_LEAD_PARTICLE = re.compile(rf"(?:^|(?<=[\s(\"“„]))(?:(?:{_PART}) |d['’])$", re.I)


def is_firm(low: str) -> bool:
    """Whether a word in lower case is a firm's form."""
    return low in FIRM_WORDS or low.startswith(("& ", "et "))


def collapse(text: str) -> str:
    """The text with each run of white space as one space; paragraphs (after blank lines) stay apart by a newline."""
    # of white space only the blank is printable
    return "\n".join([p if p.isprintable() and "  " not in p and p[:1] != " " and p[-1:] != " " else " ".join(p.split()) for p in text.replace("\r\n", "\n").split("\n\n")])


def tongue(t: str) -> str:
    """The language whose frequent words the text has most of."""
    return max(STOP_WORDS, key=lambda k: sum(map(t.count, STOP_WORDS[k])))


@dataclass
class Lexicon:
    """What names look like, counted over all documents: surnames, given names, endings, and words seen in lower case."""

    given: set[str] = field(default_factory=set)
    surnames: set[str] = field(default_factory=set)
    endings: dict[str, float] = field(default_factory=dict)
    common: set[str] = field(default_factory=set)
    towns: set[str] = field(default_factory=set)
    dotted: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self._kinds: dict[str, str] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_kinds": {}}

    def kind(self, word: str) -> str:
        """A word's class, cached: T title, G given name, I initial, P particle in capitals, F firm, A law, C court, R street, M month,
        D German street, S surname, E surname by its ending, c common word, t town, u unknown.
        """
        k = self._kinds.get(word)
        if k is None:
            if len(self._kinds) > 400_000:  # words of a stream never end
                self._kinds.clear()
            k = self._kinds[word] = self._find(word)
        return k

    def _find(self, word: str) -> str:
        base = _POSSESSIVE.sub("", word)
        low = base.lower()
        if len(base) == 1:
            return "I"
        if low in TITLES:
            return "T"
        if low in ("de", "du", "von", "van", "vom", "zu") or (base.isupper() and low in ("des", "la", "der", "den")):
            return "P"
        if low in self.given:
            return "G"
        if is_firm(low):
            return "F"
        if low in MONTHS:
            return "M"
        if low in LAW_WORDS or low.endswith(("gesetz", "ordnung")):
            return "A"
        if low not in self.surnames and any(low.endswith(s) and len(low) > len(s) + 2 for s in STREETS_DE):
            return "D"
        if low in self.surnames:
            return "S"
        if len(low) > 4 and low not in self.common and "-" not in low[1:-4] and max((self.endings.get(low[-n:], -9.0) for n in (3, 4, 5, 6)), default=-9.0) > 1.0:
            return "E"
        if base in self.towns:
            return "t"
        if any(c in low for c in COURT_WORDS):
            return "C"
        if base in _STREETS:
            return "R"
        return "c" if low in self.common else "u"


_STREETS = set(STREETS_EN.split("|"))


# ---------------------------------------------------------------- counting over all documents

_STRONG_TITLES = {"Mr", "Mrs", "Ms", "Dr", "Prof", "Sir", "Herr", "Herrn", "Frau", "Mme", "Madame", "Monsieur"}
KNOWN_CODE = r"(?:[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}|[A-Z]{2} \d{5}|\d{5}(?![ ‑-]?\d))"
CAPITALISED = r"[A-ZÀ-Þ][^\W\d_]*[a-zà-þ](?:['’\-][^\W\d_]+)*(?!\w)"
_CODE = re.compile(rf"[{DIGITS}](?<=\d)(?<!\d\d)" r"(?:\d{4}(?!\d)|[A-Z]{2}\b)")
_TOWN_AFTER = re.compile(rf" ({CAPITALISED}(?:[ -](?:{CAPITALISED}|le-{CAPITALISED}))?)")
_TOWN_BEFORE = re.compile(rf", ({CAPITALISED}(?: {CAPITALISED})?),? (?:[A-Z]{{1,2}}\d{{1,2}}[A-Z]? |[A-Z]{{2}} )?$")
_VERSUS = re.compile(r" (?:v\.?|gegen|c/) (?=[A-ZÀ-Þ])")
_STREET_END = re.compile(rf"(?:{STREETS_EN})\.?,")
_LOWER = re.compile(r"\b[a-zà-þ][\wà-þ]{2,}")
_CAP = re.compile(r"[A-ZÀ-ÖØ-ÞŒ](?:[\w'’]|[-‑](?=\w))*")
#: Distinct tokens and runs that a task holds before it hands its counts on.
HELD_COUNTS = 500_000
#: Shares of a word's capitalised occurrences: more lower-case ones make it a common word; fewer after titles or as sides make it no name.
LOWER_SHARE, NAME_SHARE = 0.25, 0.002


def _bare(word: str) -> str:
    return _POSSESSIVE.sub("", word)


class _Tally:
    """Counts of one task's texts: (tag, word, next word) -> occurrences. Words and runs are taken apart once per distinct one, not per text."""

    def __init__(self, given_names: list[str]) -> None:
        self.listed, self.low = set(given_names), {g.lower() for g in given_names}
        self.tokens, self.runs, self.rest = Counter(), Counter(), Counter()

    def add(self, t: str) -> None:
        self.tokens.update(t.split())
        self.runs.update(RUN.findall(t))
        for c in _CODE.finditer(t):
            five = c.end() - c.start() == 5
            m = _TOWN_AFTER.match(t, c.end()) if five else None
            m = m or _TOWN_BEFORE.search(t, max(0, c.start() - 64), c.start())
            if m:
                self.rest["town", m.group(1), ""] += 1
        for m in _VERSUS.finditer(t):
            a, b = self._ending(t, m.start()), _CAP.match(t, m.end())
            if a and b:
                self.rest.update([("side", a, ""), ("side", _bare(b.group()).lower(), "")])

    @staticmethod
    def _ending(t: str, at: int) -> str:
        """The capitalised word that ends at a place, in lower case."""
        token = t[max(t.rfind(" ", 0, at), t.rfind("\n", 0, at)) + 1 : at]
        return next((_bare(m.group()).lower() for m in _CAP.finditer(token) if m.end() == len(token)), "")

    def full(self) -> bool:
        return len(self.tokens) + len(self.runs) + len(self.rest) > HELD_COUNTS

    def rows(self) -> list[tuple[str, str, str, int]]:
        """The counts so far; counting starts anew."""
        out, caps, lower = self.rest, Counter(), Counter()
        for token, n in self.tokens.items():
            for w in _CAP.findall(token):
                caps[(w[:-2] if w[-2:] in _OWNED else w).lower()] += n
            if "@" not in token and "." not in token.strip(".,;:()[]"):
                for w in _LOWER.findall(token):
                    lower[w] += n
            m = _STREET_END.match(token)
            if m:
                out["street", m.group(), ""] += n
        for run, n in self.runs.items():
            parts = [(m.group().rstrip("."), run[: m.start()].endswith(", ")) for m in _ELEMENT.finditer(run)]
            words = [(w, comma) for w, comma in parts if len(w) > 1]  # initials may stand between
            for k in range(len(words) - 1):
                (first, _), (second, comma) = words[k], words[k + 1]
                if comma:
                    continue
                second = _bare(second)
                low, last = second.lower(), k + 2 == len(words) or words[k + 2][1]
                out["pair", first.lower(), low] += n
                if is_firm(low):
                    out["firm", _bare(first).lower(), ""] += n
                if last and (first in _STRONG_TITLES or first in self.listed) and len(second) > 3 and not second.isupper() and low not in self.low and not is_firm(low):
                    out["titled", low, ""] += n
        self.tokens, self.runs, self.rest = Counter(), Counter(), Counter()
        return [*[("caps", w, "", n) for w, n in caps.items()], *[("lower", w, "", n) for w, n in lower.items()], *[(*k, n) for k, n in out.items()]]


def build_lexicon(documents: DataFrame, given_names: list[str], least: int = 3) -> Lexicon:
    """Counts names in strong contexts over all documents: after a title, and after a listed given name (with or without an initial).

    Words are counted by Spark; the driver and the model hold what names need only: surnames, learnt given names, towns, endings, and of
    the common words those that have a surname's ending or stand in runs. What speaks against a name is measured by shares of a word's
    occurrences, so that the number of documents decides nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally = _Tally(given_names)
        for batch in batches:
            for text in batch["text"]:
                tally.add(collapse(text))
                if tally.full():
                    yield pd.DataFrame(tally.rows(), columns=["tag", "word", "next", "n"])
        yield pd.DataFrame(tally.rows(), columns=["tag", "word", "next", "n"])

    spark = documents.sparkSession
    counted = spread(documents.where("doc_id is not null and text is not null").select("text")).mapInPandas(run, "tag string, word string, next string, n bigint")
    counted = cut(counted.groupBy("tag", "word", "next").agg(F.sum("n").alias("n")), "lexicon")
    lex = Lexicon(given={g.lower() for g in given_names})
    ends = {r.word: r.n for r in counted.where("tag = 'street'").collect()}
    lex.dotted = {w[:-2] for w, n in ends.items() if w.endswith(".,") and n > ends.get(w[:-2] + ",", 0)}
    lex.towns = {r.word for r in counted.where((F.col("tag") == "town") & (F.col("n") >= least)).select("word").collect()}

    tags = ("titled", "lower", "caps", "side", "firm")
    sums = [F.sum(F.when(F.col("tag") == x, F.col("n")).otherwise(0)).alias(x) for x in tags]
    fixed = lambda words: F.col("word").isin(sorted(words)) if words else F.lit(False)
    # seen in lower case, more than names that are written so by mistake or in an address
    seen_low = (F.col("lower") >= 2) & (F.col("lower") >= LOWER_SHARE * F.col("caps")) & (F.col("lower") > F.col("titled"))
    # a capitalised word that (as good as) never has a title nor a side in a case is no name, whatever its ending
    no_name = (F.col("caps") >= 5) & (F.col("titled") <= NAME_SHARE * F.col("caps")) & ((F.col("side") <= NAME_SHARE * F.col("caps")) | (F.col("firm") >= F.greatest(F.lit(3), F.col("side") * 0.1)))
    words = counted.where(F.col("tag").isin(*tags)).groupBy("word").agg(*sums).withColumn("surname", (F.col("titled") >= least) & (F.col("titled") > NAME_SHARE * F.col("caps")) & ~seen_low & ~fixed(MONTHS))
    words = cut(words.withColumn("common", seen_low | no_name), "words")

    # given names that the list lacks: words that mostly stand before a surname, also where a title stands before them
    pairs = counted.where("tag = 'pair'").select("word", "next", "n")
    followed = pairs.join(words.where("surname").select(F.col("word").alias("next")), "next").groupBy("word").agg(F.sum("n").alias("followed"))
    known = followed.where(F.col("followed") >= least).join(words, "word").where((F.col("followed") >= 0.35 * F.col("caps")) & (F.col("followed") > F.col("titled")) & ~seen_low & ~fixed(TITLES))
    lex.given |= {r.word for r in known.select("word").collect() if not any(c in r.word for c in COURT_WORDS)}
    lex.surnames = {r.word for r in words.where("surname").select("word").collect()} - lex.given

    given = spark.createDataFrame([(w,) for w in sorted(lex.given)], "word string")
    unsure = F.col("caps").between(0, 1) | ((F.col("side") > NAME_SHARE * F.col("caps")) & (F.col("firm") < F.greatest(F.lit(3), F.col("side") * 0.1)))  # sides of cases are mostly names
    judged = words.where(F.col("surname") | ((F.col("caps") > 0) & ~unsure)).join(given, "word", "left_anti").where(F.length("word") > 4)
    ending = lambda low: F.array(*[F.when(F.length("word") > n + low, F.substring("word", -n, n)) for n in (3, 4, 5, 6)])
    split = judged.select(F.col("surname").cast("int").alias("s"), F.explode(ending(1)).alias("e")).where("e is not null").groupBy("e").agg(F.sum("s").alias("n"), F.sum(1 - F.col("s")).alias("other"))
    lex.endings = {r.e: math.log((r.n + 0.1) / (r.other + 0.5)) for r in split.where("n >= 4").collect()}

    high = spark.createDataFrame([(e,) for e, v in sorted(lex.endings.items()) if v > 1.0], "e string")
    common = words.where("common and not surname and caps > 0").select("word")
    alike = common.select("word", F.explode(ending(-1)).alias("e")).join(high, "e", "left_semi").select("word")
    reached = common.join(pairs.select(F.col("next").alias("word")).unionByName(pairs.select("word")), "word", "left_semi")
    often = words.where("common and not surname and caps >= 5").select("word")
    lex.common = {r.word for r in alike.union(reached).union(often).distinct().collect()}
    return lex


# ---------------------------------------------------------------- candidates


@dataclass(slots=True)
class Piece:
    """A part of a run: characters [start, end) of the run, its classes, what its features are but for its surroundings, whether it touches the run's ends, and its first and last element.

    With a model's scores, runs of one signature share their pieces: places and last words are then those of the elements.
    """

    start: int
    end: int
    seq: str
    last: str
    parts: int
    features: list[str]
    first: bool
    final: bool
    lead: str = ""
    opens: int = 0
    closes: int = 0
    score: float = 0.0
    tables: tuple = ()
    top: float = 0.0


@dataclass(slots=True, eq=False)
class Reading:
    """A run taken apart: its pieces, the names it introduces (with a title or given name), its words before a firm's form, and ends of German street words."""

    pieces: list[Piece]
    introduces: list[tuple[str, str]]
    firms: list[str]
    streets: list[tuple[int, int]]
    led: list[Piece] = field(default_factory=list)
    top: float = -99.0
    alone: bool = False
    busy: bool = False
    lasts: set[str] = field(default_factory=set)
    el: list[tuple] = field(default_factory=list)


_TOLD = set("cFACRMTtD")


def take_apart(run: str, lang: str, lex: Lexicon, unknown=None) -> tuple[list[tuple], list[str]]:
    """A run's elements, and by element how it is joined to the one before. unknown: as in `read_run`."""
    el, at = [], 0
    for m in _ELEMENT.finditer(run):
        w = m.group().rstrip(".")
        s, e = m.span()
        # "M." opens a French name, but is an initial within one
        k = "T" if w == "M" and lang == "fr" and run[s + 1 : s + 3] == ". " and (not el or run[s - 2 : s] == ", ") else lex.kind(w)
        owned = w[-2:] in _OWNED
        low = (w[:-2] if owned else w).lower()
        hidden = unknown is not None and k in "GSEctu" and unknown(low, k)
        poss = owned and e - s > 3
        el.append((s, e - 2 if poss else e, low, "u" if hidden else k, hidden, e, w, run[at:s] if el else "", poss))
        at = e
    return el, ["," if x[7] == ", " else "" if x[7] in ("", " ") else "p" if _PARTICLE_GAP.fullmatch(x[7]) else "" for x in el]


_OWNED = {"'s", "'S", "’s", "’S"}


def signature(lang: str, el: list[tuple]) -> tuple:
    """All that a run's pieces take from its elements but for their places and last words: runs that share it have the same pieces and features."""
    return (lang, *[(k, low if k in _TOLD else low[-4:] if k in "SEu" else "", len(w) > 3 and w.isupper(), len(w) < 2, len(w) < end - s, gap, poss) for s, _, low, k, _, end, w, gap, poss in el])


def read_run(run: str, lang: str, lex: Lexicon, unknown=None) -> Reading:
    """Takes a run apart. unknown(word, class) says which words are to be taken for ones that the corpus never had (in training)."""
    el, gaps = take_apart(run, lang, lex, unknown)
    return reading_of(el, gaps, pieces_of(lang, el, gaps))


def pieces_of(lang: str, el: list[tuple], gaps: list[str]) -> list[Piece]:
    """All parts of a run's elements that may be names, with their features."""
    n = len(el)
    firm = firm_ahead(el, gaps)
    law, street = [False] * (n + 1), [False] * (n + 1)
    for j in reversed(range(n)):
        open_ = j + 1 < n and gaps[j + 1] != "," and not el[j][8]
        law[j] = el[j][3] == "A" or (open_ and law[j + 1])
        street[j] = el[j][3] in "RD" or (open_ and street[j + 1])
    pieces: list[Piece] = []
    for i in range(n):
        seq, commas, after = "", 0, 0
        for j in range(i, min(n, i + MAX_PARTS)):
            s, e, low, k, hidden, end, w, gap, poss = el[j]
            if j > i:
                if el[j - 1][8]:  # nothing goes on after a possessive
                    break
                if gaps[j] == ",":
                    commas += 1
                    if commas > 1 or j - i > 3:
                        break
                seq += gaps[j]
            seq += k
            if len(w) < 2 or (k == "T" and len(w) < end - s):  # a name doesn't end with an initial or an abbreviated title
                continue
            f = [f"n:{lang}:{j - i + 1}", "n:last=" + k, "n:first=" + el[i][3], "n:case=" + ("U" if len(w) > 3 and w.isupper() else "m") + k]
            if not hidden and k in "SEu":
                f.append("n:end=" + low[-4:])
            f += ["n:id=" + x[2] for x in el[i : j + 1] if x[3] in _TOLD and not x[4]]
            if i and el[i - 1][3] in _TOLD and not el[i - 1][4]:
                f.append("n:d<" + el[i - 1][2])
            if j + 1 < n:
                q = el[j + 1]
                f += [f"n:i>{q[3]}{gaps[j + 1]}{'s' if poss else ''}", f"n:i>{q[3]}{gaps[j + 1]}|{seq}"]
                if q[3] in _TOLD and not q[4]:
                    f.append("n:d>" + q[2])
                if gaps[j + 1] != "," and not poss:
                    f += [x for x, ahead in (("n:firm", firm), ("n:law", law), ("n:street", street)) if ahead[j + 1]]
            for lead in ("", el[i][7].strip().lower()) if gaps[i] == "p" else ("",):
                whole = ("p" if lead else "") + seq
                more = ["n:seq=" + whole]
                if i:
                    x = f"n:i<{el[i - 1][3]}{'' if lead else gaps[i]}"
                    more += [x + ("s" if el[i - 1][8] else ""), f"{x}|{whole}"]
                if lead:
                    more.append("n:lead=" + lead)
                start = el[i - 1][5] + 1 if lead else el[i][0]
                pieces.append(Piece(start, e, whole, low, j - i + 1, f + more, i == 0, j + 1 == n, lead, i, j))
    return pieces


def firm_ahead(el: list[tuple], gaps: list[str]) -> list[bool]:
    """By element, whether a firm's form is it or follows it with no comma between."""
    n = len(el)
    firm = [False] * (n + 1)
    for j in reversed(range(n)):
        firm[j] = el[j][3] == "F" or (j + 1 < n and gaps[j + 1] != "," and not el[j][8] and firm[j + 1])
    return firm


def reading_of(el: list[tuple], gaps: list[str], pieces: list[Piece]) -> Reading:
    """What a run with these elements and pieces tells."""
    n, firm = len(el), firm_ahead(el, gaps)
    introduces, firms = [], []
    for i in range(n):
        if el[i][3] in "TGI" and not firm[i]:
            j = i
            while j + 1 < n and gaps[j + 1] != "," and not el[j][8] and (j == i or el[j][3] in "TGIPuSE"):
                j += 1
            if j > i and len(el[j][2]) > 1 and el[j][3] in ("SEutGDR" if el[i][3] != "T" else "SEuctGDR"):
                introduces.append((el[j][2], el[j][7] if gaps[j] == "p" else ""))
        if el[i][3] == "F":
            j = i - 1
            while j >= 0 and gaps[j + 1] != "," and not el[j][8]:
                firms.append(el[j][2])
                j -= 1
    streets = [(x[0], x[1]) for x in el if x[3] == "D" or (x[2].endswith(STREETS_DE) and len(x[2]) > 5)]
    return Reading(pieces, introduces, firms, streets, busy=bool(introduces or firms or streets), el=el)


_BEFORE_CLASS = {"(": "(", '"': "(", "“": "(", "„": "(", "«": "(", "[": "("}
_SIDES = {"v", "v.", "gegen", "c/"}


def before(chunk: str) -> tuple[str, str]:
    """(class, word) of what stands before a span: `chunk` is the text from the last blank but one (or line's start) to the span."""
    x = chunk.rstrip(" ")
    if not x or x[-1] == "\n":
        return "^", "^"
    if x[-1] in _BEFORE_CLASS:
        return "(", x[-1]
    if x in _SIDES:
        return "v", "v"
    if x[-1] in ".!?:;" and x.lower() not in _DOTTED:
        return ".", x[-1]
    if x[-1] in ",;–—-":
        return ",", ","
    low = x.lower().strip(".,;:()[]\"“”„’'")
    if low in TITLES:
        return "T", low
    if any(c.isdigit() for c in low):
        return "9", re.sub(r"\d", "9", low)[:12]
    return ("w" if x[0].islower() else "W" if x[0].isupper() else "o"), low[:24] or x[-1]


_DOTTED = {"tel.", "nr.", "no.", "art.", "abs.", "rn.", "v.", "vgl.", "cf.", "mr.", "dr.", "p."}


def after(chunk: str) -> tuple[str, str]:
    """(class, word) of what stands after a span: `chunk` is the text from the span to the second blank or the line's end."""
    if not chunk or chunk[0] == "\n":
        return "$", "$"
    if chunk[0] != " ":
        x = chunk[0]
        return ("'" if x in "'’" else ")" if x in ")]\"”“»" else x if x in ".,;:-" else "o"), chunk.split(" ", 1)[0][:6]
    x = chunk[1:]
    if x in _SIDES:
        return "v", "v"
    low = x.lower().rstrip(".,;:()[]\"“”’'")
    if x in ("&", "et", "und", "and"):
        return "&" if x == "&" else "w", x
    if any(c.isdigit() for c in low):
        return "9", re.sub(r"\d", "9", low)[:12]
    return ("w" if x[:1].islower() else "W" if x[:1].isupper() else "o"), low[:24] or x[:1]


def left_chunk(t: str, at: int) -> str:
    """What `before` reads: the word before a place, at most 40 characters of it."""
    if not at or t[at - 1] == "\n":
        return ""
    low = max(0, at - 41)
    k = t.rfind(" ", low, at - 1) + 1 or low
    k = t.rfind("\n", k, at - 1) + 1 or k
    return t[max(k, at - 40) : at]


def right_chunk(t: str, at: int) -> str:
    """What `after` reads."""
    if at >= len(t) or t[at] == "\n":
        return ""
    k = t.find(" ", at + 1, at + 40)
    k = at + 40 if k < 0 else k
    line = t.find("\n", at, k)
    return t[at : k if line < 0 else line]


# A reporter, a year in brackets or a volume and page: what follows the sides of a cited case.
_REPORTER = re.compile(r"\[\d{4}\]|\(\d{4}\) \d|, \d+ [A-Z][a-z]*\. |, [A-Z]\w{2,} \d+, \d|, Rec\. |L\.R\.")
_SENTENCE_END = re.compile(r";|(?<!\w)[a-zà-ÿ]{3,}[.] [A-ZÀ-Þ]")
_OPPONENT = re.compile(r" (?:v\.?|gegen|c/) ")
#: How a page header ends.
_HEADER = re.compile(r"(?:^| )(?:\|)? ?(?:/? ?|.*(?:Page|Seite|page|S\.|p\.) ?)\d{1,3}$")


def cited(t: str, s: int, e: int) -> str:
    """Whether a name is a side of a cited case: "sure" if a reporter follows the sides, "head" in a page header, "side" if it just has an opponent."""
    line = t.rfind("\n", 0, s) + 1
    stop = t.find("\n", e)
    ahead, back = t[e : stop if stop >= 0 else len(t)], t[line:s]
    v = _OPPONENT.match(ahead)
    w = None
    for w in _OPPONENT.finditer(back):
        pass
    if w and re.search(r"[,;.()]", back[w.end() :]):
        w = None
    if not v and not w:
        return "sure" if back.endswith(("re ", "affaire ")) else ""
    if len(back) + len(ahead) < 100 and _HEADER.search(ahead) and not re.search(r"\.(?<!v\.)", back):
        return "head"
    rest = ahead[v.end() : v.end() + 120] if v else ahead[:60]
    end = _SENTENCE_END.search(rest)
    if _REPORTER.search(rest[: end.start()] if end else rest):
        return "sure"
    return "side" + ("^" if not back.strip() else "")
