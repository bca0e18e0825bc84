"""Personal data in free text, found by a semi-Markov conditional random field.

Candidates are whole spans: an e-mail address, a telephone number, an identity number, a street address, a person's name. For
names these are all parts of at most `names.MAX_PARTS` words of every run of capitalised words, whatever the words are. A span's features
describe it as a whole (its form, the classes of its words, the words before and after), and a pair of near neighbours scores their kinds.
Dynamic programming over the candidates chooses boundaries and kinds together; text that no candidate covers scores 0. Weights maximise
the conditional likelihood of a bounded sample of documents that seed rules label (`seed_labels`), each read twice: as it is, and with
half of its words hidden from the lexicon, so that forms and surroundings must carry names that no document of the corpus has.
Decoding covers every character of every document.
"""

from __future__ import annotations

import gc
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import lru_cache, partial
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from tessera.llm import names
from tessera.llm.names import Lexicon, build_lexicon, collapse
from tessera.session import bounded, spread

KINDS = ("email", "phone", "id_number", "street_address", "person_name")

# Words around streets and numbers in English, German and French.
STREETS_FR = "rue|avenue|av\\.|boulevard|bd|bld|place|impasse|quai|chemin|allée|cours|passage|square|route|faubourg|ruelle|venelle|sentier|esplanade|montée"
ANNOUNCERS = (
    r"[Pp]assport|PASSPORT|[Pp]asseport|Reisepass|[Rr]esident (?:ID|card|permit)|[Cc]itizen card|[Ii]dentity (?:card|number)|ID card|"
    r"[Tt]ax(?:payer)? (?:ID|number|reference|file|no\.)|TIN\b|[Nn]ational [Ii]nsurance|NI (?=n)|[Ss]ocial [Ss]ecurity|SSN\b|NINO\b|[Dd]riv(?:ing|ers?|er['’]s) (?:licen[cs]e|permit)|[Ll]icen[cs]e n(?:o\.|umber)|"
    r"(?:Personal|Dienst)?[Aa]usweis\w*|Steuer-?(?:ID|IdNr|Id|nummer|identifikationsnummer)|Sozialversicherungs\w+|Versicherungsnummer|Führerschein\w*|Aufenthalts(?:titel|karte)|"
    r"[Cc]arte d['’]identité|[Cc]arte de (?:séjour|résident)|[Tt]itre de séjour|[Pp]ermis de conduire|n° fiscal|numéro fiscal|sécurité sociale|NIR\b|NIF\b"
)

_AT = re.compile(r"[@\[({](?:(?<=@)| ?(?:at|AT|At|arobase|AROBASE|ät) ?[\])}])")
_NOT_LOCAL = re.compile(r"[^\w.+\-%]")
_DOMAIN = re.compile(r"[A-Za-z0-9\-]+(?:(?:\.| ?[\[({] ?(?:dot|DOT|Dot|point|POINT|punkt|PUNKT|Punkt) ?[\])}] ?)[A-Za-z0-9\-]+)+")
_D = r"[ .\-‑–]"
_SPELLED = re.compile(r"(?<![\w.+\-])[\w.+\-]+ (?:at|AT|arobase|ät) [\w\-]+(?: (?:dot|DOT|punkt|PUNKT|point) [\w\-]+)+")
_SPELLED_DOTS, _SPELLED_ATS = (" dot ", " DOT ", " punkt ", " PUNKT ", " point "), (" at ", " AT ", " arobase ", " ät ")
_SPELLED_ENDS = tuple(x.rstrip() for x in _SPELLED_ATS)
_SPELLED_HOST = re.compile(r" (?:at|AT|arobase|ät) [\w\-]+ (?:dot|DOT|punkt|PUNKT|point) ")
_SEVEN = re.compile(r"(?:\D*\d){7}")
#: Where numbers are: at least five digits, with at most four signs and capitals between two of them.
_RUN = re.compile(rf"[+({names.DIGITS}](?:" r"(?<=[+(])\d|(?<=\d)(?<!\d\d))(?:[A-Z()/ .\-‑–]{0,4}\d){4,}\w?")
_PHONE = re.compile(
    r"(?<![\w+/(\-‑.,])(?:"
    rf"\+\d{{1,3}} ?(?:\(0\) ?)?\(?\d{{1,4}}\)?(?:[ .\-‑/]?\d{{2,5}}){{1,5}}"
    rf"|00\d{{2}}{_D}\d{{1,4}}(?:[ ./\-‑]\d{{2,8}}){{1,5}}"
    rf"|\(\d{{2,5}}\) ?\d{{3,5}}(?:{_D}\d{{2,4}}){{1,2}}"
    rf"|1{_D}\d{{3}}{_D}\d{{3}}{_D}\d{{4}}"
    rf"|\d{{3}}{_D}\d{{3}}{_D}\d{{4}}"
    rf"|0 \d\d ?/ ?\d(?: \d\d){{2}} \d{{3}}"
    rf"|0\d{{2}}{_D}\d{{4}}{_D}?\d{{4}}"
    rf"|0\d{{4}}{_D}?\d{{3}}{_D}?\d{{3}}"
    rf"|0\d{{3}}(?:{_D}\d\d){{3}}"
    rf"|0\d(?:{_D}?\d\d){{4}}"
    rf"|0\d{{2,4}} ?[ /\-‑] ?\d{{5,8}}(?:{_D}\d{{2,4}})?"
    rf"|\d{{3}}[ \-‑]\d{{4}}"
    rf"|(?P<other>\d{{2,6}}(?:{_D}\d{{2,8}}){{1,5}})"
    r")(?:,? ?(?:ext\.?|extension|x|poste|Durchwahl|App\.|Nebenstelle) ?\d{1,5})?(?![\w█]|[\-‑/.,]\w|[\-‑ ]?(?:█|[Xx]{2}))"
)
_ANNOUNCED = re.compile(rf"(?:{ANNOUNCERS})(?:[,\-‑]? ?(?:card|number|permit|ref\.?|reference|no\.|No\.|n°|nº|N°|Nr\.|Nummer|numéro|ID))*:? ?((?:[A-Z]{{1,3}}[ \-‑]?)?)$")
#: Of every announcer a part, in lower case.
_ANNOUNCER_PARTS = (
    *("passport", "passeport", "reisepass", "resident ", "citizen card", "identity ", "id card", "tax", "tin", "national ", "ni ", "social ", "ssn", "nino", "driv", "licen", "ausweis", "steuer"),
    *("sozialv", "versicherungsn", "führerschein", "aufenthalts", "carte d", "titre de", "permis de", "fiscal", "sécurité", "nir", "nif"),
)
#: What stands directly before an announced number.
_ANNOUNCE_ENDS = {
    *("passport", "Passport", "PASSPORT", "passeport", "Passeport", "Reisepass", "Personalausweis", "ID", "ID:", "card", "card:", "permit", "number", "number:", "no.", "No.", "no.:", "Nr.", "Nr.:", "n°", "nº", "N°", "n°:", "Nummer"),
    *("reference", "ref", "ref.", "file", "TIN", "SSN", "NINO", "NIR", "NIF", "licence", "license", "insurance", "Insurance", "security", "Security", "identité", "séjour", "résident", "conduire", "fiscal", "sociale", "numéro"),
}
_ANNOUNCE_STEMS = {"Steuer", "Sozial", "Person", "Auswei", "Dienst", "Führer", "Aufent", "Versic"}
_ID_VALUE = re.compile(r"(?:[A-Z]{1,3}[ \-‑]?)?\d[\dA-Z]*(?:(?: |/|-|‑)(?:\d[\dA-Z]*|[A-Z]{1,2}(?![\w.'’█])))*(?![\w█]|[\-‑/]\w)")
_CAPW = r"[A-ZÀ-Þ][\w.'’\-]*"
_CAPT = names.CAPITALISED
_UNIT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite) \w{1,5}"
_STREET = re.compile(
    rf"[{names.DIGITS}](?<![\w.,/‑-].)(?<=\d)" r"\d{0,4}(?: (?:bis|ter|quater)|[A-Za-z])?,? (?:"
    rf"(?:{_CAPW} ){{1,3}}(?:{names.STREETS_EN})\b\.?(?:, {_UNIT})?"
    rf"|(?:{STREETS_FR}) (?:(?:de la|de l['’]|du|des|de|d['’]|l['’]|la|le|les|en|sur|lez|aux|au|à) ?)*{_CAPW}(?:(?: (?:de la|de l['’]|du|des|de|d['’]))? ?{_CAPW})*"
    r")"
)
_STREET_LEAD_DE = re.compile(r"(?:(?<!\w)(?:Am|Im|Zum|Zur|Beim|Vom|An der|An den|Auf der|Auf dem|In der|In den|Hinter der|Hinter dem|Unter den|Vor dem|Alte|Neue|Alter|Neuer|Große|Kleine) )?$")
_STREET_LEAD = re.compile(rf"(?:{_UNIT}, )?(?:No\. ?)?$")
_TOWN_CODE = re.compile(rf", (?:D-|F-|CH-)?\d{{5}} {_CAPT}(?:[ -]{_CAPT})?|, {_CAPT}(?: {_CAPT})?(?:,? {names.KNOWN_CODE})?|,? {names.KNOWN_CODE}")
_HOUSE_DE = re.compile(r"\.? \d{1,4}(?: ?[a-z])?\b")
_WORD_BEFORE = re.compile(r"([\w.'’°§/#$]+|[^\w\s])\s*$")
_WORD_AFTER = re.compile(r"\s*([\w'’°]+|[^\w\s])")


@dataclass(slots=True)
class Span:
    """A candidate: characters [start, end) of the collapsed text, its kind, and its features, or its score where that is known."""

    start: int
    end: int
    kind: str
    features: list[str]
    score: float | None = None


def _before(t: str, at: int) -> str:
    if not at or t[at - 1] == "\n":
        return "^"
    m = _WORD_BEFORE.search(t, max(0, at - 24), at)
    return m.group(1).lower() if m else "^"


def _after(t: str, at: int) -> str:
    if t.startswith("\n", at):
        return "$"
    m = _WORD_AFTER.match(t, at, at + 30)
    return m.group(1).lower() if m else "$"


@lru_cache(50_000)
def _town_words(tail: str) -> str:
    return re.sub(r"^[ ,]*(?:D-|F-|CH-)?\d*\s*|,? [A-Z]{0,2}\d[\w ]*$|,? [A-Z]{2} \d{5}$", "", tail).strip(" ,")


def _town(tail: str, lex: Lexicon) -> str:
    """How an address ends: known (a known town), new (another capitalised word), code (only a post code)."""
    words = _town_words(tail)
    return "known" if words in lex.towns else "code" if not words else "new"


def _kind_of(word: str) -> str:
    """A neighbouring word as a feature: digits as 9, so that no number is a word of its own."""
    if word.isalpha():
        return word
    return re.sub(r"[\d9]+", "9", word)[:12] if any(c.isdigit() for c in word) else word


@lru_cache(50_000)
def _shape(s: str) -> str:
    return re.sub(r"(\D)\1+", r"\1", re.sub(r"\d+", lambda m: str(min(len(m.group()), 9)), re.sub(r"[A-Za-z]+", "a", s)))[:24]


def _finds(t: str, part: str) -> list[int]:
    """Places of a part in a text."""
    places, at = [], t.find(part)
    while at >= 0:
        places.append(at)
        at = t.find(part, at + 1)
    return places


def _local_start(t: str, end: int) -> int:
    """Where the local part of an address that ends at `end` begins, however long it is."""
    size = 64
    while True:
        piece = t[max(0, end - size) : end]
        stop = None
        for stop in _NOT_LOCAL.finditer(piece):
            pass
        if stop is not None:
            return end - len(piece) + stop.end()
        if size >= end:
            return 0
        size *= 4


def _ats(t: str) -> Iterator[re.Match]:
    """What _AT finds in a text. Plain finds of its signs pass over the text many times faster than a class of them."""
    for at in sorted([at for sign in "@[({" for at in _finds(t, sign)]):
        m = _AT.match(t, at)
        if m:
            yield m


def _spells(t: str) -> bool:
    """Whether a word for a dot follows a host and a word for @, as in every address that _SPELLED finds."""
    for word in _SPELLED_DOTS:
        for at in _finds(t, word) if word in t else ():
            host = t.rfind(" ", 0, at)
            if t.endswith(_SPELLED_ENDS, 0, max(0, host)):
                return True
    return False


def _spelled(t: str) -> Iterator[re.Match]:
    """What _SPELLED finds in a text, tried only where a word for @ stands between a blank and a host."""
    end = 0
    for at in sorted([at for word in _SPELLED_ATS for at in _finds(t, word)]):
        if not _SPELLED_HOST.match(t, at):
            continue
        start = at
        while start > end and (t[start - 1].isalnum() or t[start - 1] in "_.+-"):
            start -= 1
        m = _SPELLED.match(t, start) if start < at else None
        if m:
            end = m.end()
            yield m


def _emails(t: str, add) -> None:
    for m in _ats(t):
        plain = m.group() == "@"
        spaced = t[m.start() - 1 : m.start()] == " " and (not plain or t.startswith(" ", m.end()))  # "name @ host" as well, but no lone @
        stop = m.start() - (1 if spaced else 0)
        start = _local_start(t, stop)
        b = _DOMAIN.match(t, m.end() + (1 if t.startswith(" ", m.end()) and (not plain or spaced) else 0))
        while start < stop and t[start] in ".-+%":
            start += 1
        if b and start < stop and t[start - 1 : start] != "█" and t[b.end() : b.end() + 1] not in ("█", "@"):
            add(Span(start, b.end(), "email", ["email", "email:at=" + m.group().lower(), "email:<" + _before(t, start)]))
    if _spells(t):
        for m in _spelled(t):
            add(Span(m.start(), m.end(), "email", ["email", "email:at=word", "email:<" + _before(t, m.start())]))


def _announced(t: str, at: int) -> re.Match | None:
    """What announces the number at a place. Parts of the announcers are looked for first, since plain finds take a fraction of the pattern's time."""
    ahead = t[max(0, at - 64) : at].lower()
    return _ANNOUNCED.search(t, max(0, at - 64), at) if any(map(ahead.__contains__, _ANNOUNCER_PARTS)) else None


def _numbers(t: str, add) -> None:
    for run in _RUN.finditer(t):
        s0, e0 = run.span()
        if e0 - s0 >= 8 and not (e0 - s0 <= 12 and t[s0 + 2] in "/." and t[s0 + 5] == t[s0 + 2] and t[s0 + 6 : s0 + 10].isdigit()) and (e0 - s0 > 24 or _SEVEN.match(t, s0, e0)):  # no date
            for m in _PHONE.finditer(t, s0, e0 + 16):
                s, e = m.span()
                if s >= e0:
                    break
                digits = sum(map(str.isdigit, m.group()))
                if digits < 7 or (m.lastgroup == "other" and digits > 13):
                    continue
                kind = "phone:other" if m.lastgroup == "other" else "phone:known"
                add(Span(s, e, "phone", ["phone", kind, "phone:" + _shape(m.group()), "phone:<" + _kind_of(_before(t, s)), "phone:>" + _kind_of(_after(t, e)), "phone:lead=" + m.group()[:2], f"phone:d={digits}"]))
        word = t[max(0, s0 - 26) : s0].rstrip().rsplit(" ", 1)[-1]
        word = word.rstrip("-‑") if len(word) <= 4 else word
        announced = word in _ANNOUNCE_ENDS or (len(word) <= 3 and word.isalpha() and word.isupper()) or word[:6] in _ANNOUNCE_STEMS
        lead = _announced(t, s0) if announced else None
        if lead:
            m = _ID_VALUE.match(t, lead.start(1))
            if m:
                value = m.group()
                if sum(c.isdigit() for c in value) >= 5 and "XX" not in value:
                    add(Span(m.start(), m.end(), "id_number", ["id", "id:" + _shape(value), "id:by=" + t[lead.start() : lead.start() + 12].lower()]))


def _streets(t: str, lex: Lexicon, add) -> None:
    for m in _STREET.finditer(t):
        s, e = m.span()
        if t[e - 1] == "." and t[e : e + 1] != "," and t[s:e].rsplit(" ", 1)[-1][:-1] not in lex.dotted:
            e -= 1  # the sentence's
        if _after(t, e) in names.FIRM_WORDS:
            continue
        s = _STREET_LEAD.search(t, max(0, s - 22), s).start()
        fr = "fr" if any(w in _FR_WORDS for w in t[s:e].split(" ")) else "en"
        _address(t, s, e, fr, lex, add)


_FR_WORDS = set(STREETS_FR.replace("\\\\", "").replace("\\", "").split("|"))


def _address(t: str, s: int, e: int, tongue: str, lex: Lexicon, add) -> None:
    """Candidates of an address whose street part is [s, e): without and with the town and code that follow."""
    ends, tails = [e], ["-"]
    while not any(c.isdigit() for c in (tails[-1] if len(ends) > 1 else "")):
        m = _TOWN_CODE.match(t, ends[-1])
        if not m:
            break
        ends.append(m.end())
        tails.append(m.group())
    prev = _before(t, s)
    for k, (x, tail) in enumerate(zip(ends, tails)):
        add(
            Span(s, x, "street_address", [
                "street", "street:" + tongue, f"street:{tongue}:part{k}", "street:tail=" + (_shape(tail) if k else "-"), "street:town=" + (_town(tail, lex) if k else "-"),
                "street:next=" + (_town(tails[k + 1], lex) if k + 1 < len(ends) else "-"), "street:>" + _kind_of(_after(t, x)), "street:<" + _kind_of(prev),
            ])
        )


# ---------------------------------------------------------------- names


def _particle(t: str, at: int) -> tuple[int, str]:
    """A particle that stands directly before a place: where it begins, and itself."""
    if at and t[at - 1] in " '’":
        m = names._LEAD_PARTICLE.search(t, max(0, at - 9), at)
        if m:
            return m.start(), m.group().strip().lower()
    return at, ""


_CITING = {"re", "affaire"}
#: The two characters before what a particle leads.
_PARTICLE_TAILS = {x[-1] + mark for x in names.PARTICLE_ENDS for mark in " '’"}


def _surroundings(t: str, s: int, e: int, left: tuple[str, str, float], right: tuple[str, str, float], word: str, parts: int, lead: str, known: dict, firms: set) -> list[str]:
    """Features that need the document: citations, names that it introduced, firms that it named."""
    f = []
    if left[0] == "v" or right[0] == "v" or left[1] in _CITING:
        side = names.cited(t, s, e)
        if side:
            f.append("n:cited=" + side)
    if word in known:
        f.append(f"n:known{min(parts, 2)}{bool(lead)}{(lead in known[word]) if lead else ('' in known[word])}")
    elif word in firms:
        f.append(f"n:firmed{min(parts, 2)}")
    return f


def _edges(lang: str, seq: str, left: tuple[str, str, float], right: tuple[str, str, float]) -> list[str]:
    """Features of the words on either side, where these are outside the run."""
    f = []
    if left[0]:
        f += ["n:<" + left[1], f"n:L={lang}{left[0]}|{seq}"]
    if right[0]:
        f += ["n:>" + right[1], f"n:R={right[0]}|{seq}"]
    if left[0] and right[0]:
        f.append(f"n:B={lang}{left[0]}{right[0]}|{seq}")
    return f


class Reader:
    """Candidates for names of a model's documents. Runs, the words around them and their scores are kept once they are known.

    With weights, candidates get scores in place of features, and those that can't be in the best segmentation whatever else the
    document holds are left out: their score, with the most that a document or neighbours can add, isn't above 0.
    """

    def __init__(self, lexicon: Lexicon, weights: dict[str, float] | None = None, near: int = 6) -> None:
        self.lexicon, self.weights, self.near = lexicon, weights, near
        self.runs = {lang: _Readings(partial(self._read, lang)) for lang in names.STOP_WORDS}
        self.lefts: dict[str, tuple[str, str, float]] = {}
        self.rights: dict[str, tuple[str, str, float]] = {}
        self.tables: dict[tuple[str, str], tuple] = {}
        self.forms: dict[tuple, names.Reading] = {}
        if weights is not None:
            self._index(weights)

    def _index(self, w: dict[str, float]) -> None:
        """Weights of the words beside a run by form, and the most that anything can add."""
        self.beside: dict[str, dict[str, dict[str, float]]] = {"L": defaultdict(dict), "R": defaultdict(dict), "B": defaultdict(dict)}
        most = {"<": 0.0, ">": 0.0, "known": 0.0, "cited": 0.0, "in": 0.0, "out": 0.0, "between": 0.0, "lead": 0.0}
        for f, v in w.items():
            if f[:4] in ("n:L=", "n:R=", "n:B="):
                side, seq = f[4:].split("|", 1)
                self.beside[f[2]][seq][side] = v
            elif f.startswith(("n:<", "n:>")):
                most[f[2]] = max(most[f[2]], v)
            elif f.startswith(("n:known", "n:firmed")):
                most["known"] = max(most["known"], v)
            elif f.startswith("n:lead="):
                most["lead"] = max(most["lead"], v)
            elif f.startswith("n:cited"):
                most["cited"] = max(most["cited"], v)
            elif f.startswith("pair:"):  # a name may also come between two others whose pair counted against them
                for way, there in (("in", f.endswith("person_name")), ("out", f.startswith("pair:person_name")), ("between", True)):
                    most[way] = max(most[way], (-v if way == "between" else v) if there else 0.0)
        self.most, self.pairs = most, most["in"] + most["out"] + most["between"]

    def _tables(self, lang: str, seq: str) -> tuple:
        """By class of the words beside a form: weights of the left, the right and both, and the most of each."""
        x = self.tables.get((lang, seq))
        if x is None:
            cut_lang = lambda d: {k[len(lang) :]: v for k, v in d.items() if k.startswith(lang)}
            a, b, c = cut_lang(self.beside["L"].get(seq, {})), self.beside["R"].get(seq, {}), cut_lang(self.beside["B"].get(seq, {}))
            x = self.tables[lang, seq] = (a, b, c, *[max([0.0, *d.values()]) for d in (a, b, c)])
        return x

    def _top(self, p: names.Piece) -> float:
        """The most that a piece's score can come to where it has no neighbour and no opponent, and its document doesn't name its last word elsewhere."""
        _, _, _, a, b, c = p.tables
        at = p.score
        if p.first:
            at += self.most["<"] + a
        if p.final:
            at += self.most[">"] + b
        return at + (c if p.first and p.final else 0.0)

    def reading(self, lang: str, run: str, unknown=None) -> names.Reading:
        if unknown is not None:
            return names.read_run(run, lang, self.lexicon, unknown)
        return self.runs[lang][run]

    def _read(self, lang: str, run: str) -> names.Reading:
        if self.weights is None:
            return names.read_run(run, lang, self.lexicon)
        el, gaps = names.take_apart(run, lang, self.lexicon)
        form = names.signature(lang, el)
        same = self.forms.get(form)
        if same is None:
            r = names.reading_of(el, gaps, names.pieces_of(lang, el, gaps))
            self._score(lang, r)
            if len(self.forms) > 50_000:  # forms of a stream never end
                self.forms.clear()
            self.forms[form] = r
            return r
        r = names.reading_of(el, gaps, same.pieces)
        r.led, r.top, r.alone, r.lasts = same.led, same.top, same.alone, {el[p.closes][2] for p in r.pieces}
        return r

    def _score(self, lang: str, r: names.Reading) -> None:
        get = self.weights.get
        kept, r.led = [], []
        for p in r.pieces:
            p.score, p.tables = sum([get(f, 0.0) for f in p.features]), self._tables(lang, p.seq)
            p.top = top = self._top(p)
            r.top = max(r.top, top)
            if top + self.most["known"] + self.most["cited"] + self.pairs > 0:
                kept.append(p)
            if p.first:  # the same with a particle before it
                q = names.Piece(p.start, p.end, "p" + p.seq, p.last, p.parts, [], True, p.final, closes=p.closes)
                q.score, q.tables = p.score + get("n:seq=p" + p.seq, 0.0), self._tables(lang, q.seq)
                r.led.append(q)
            p.features = []
        r.pieces, r.lasts = kept, {p.last for p in kept}
        r.alone = not any("," in p.seq for p in kept) and len(kept) < 2  # pieces of one run may be neighbours
        for q in r.led:
            r.top = max(r.top, self._top(q) + self.most["lead"])
        if not kept:
            r.top = -math.inf

    def _side(self, held: dict, chunk: str, read, mark: str) -> tuple[str, str, float]:
        x = held.get(chunk)
        if x is None:
            if len(held) > 200_000:
                held.clear()
            kind, word = read(chunk)
            x = held[chunk] = (kind, word, self.weights.get(mark + word, 0.0) if self.weights is not None else 0.0)
        return x

    def _left(self, t: str, at: int) -> tuple[str, str, float]:
        return self._side(self.lefts, names.left_chunk(t, at), names.before, "n:<")

    def _right(self, t: str, at: int) -> tuple[str, str, float]:
        return self._side(self.rights, names.right_chunk(t, at), names.after, "n:>")

    def spans(self, t: str, out: list[Span], unknown=None) -> None:
        """Adds the names' candidates of a collapsed text, and those of German addresses, to the other candidates."""
        add = out.append
        lang = names.tongue(t)
        parts = _RUNS.split(t)  # gaps and runs by turns
        ends = list(accumulate(map(len, parts)))
        starts, ends, gaps = ends[0::2], ends[1::2], list(map(len, parts[0::2]))
        if unknown is None:
            readings = list(map(self.runs[lang].__getitem__, parts[1::2]))
        else:
            readings = [self.reading(lang, run, unknown) for run in parts[1::2]]
        known, firms = {}, set()
        for k, r in enumerate(readings):
            if not r.busy:
                continue
            for w, particle in r.introduces:
                known.setdefault(w, set()).add(particle.strip().lower())
            firms.update(r.firms)
            for s, e in r.streets:
                h = _HOUSE_DE.match(t, starts[k] + e)
                if h:
                    at = starts[k] + s
                    _address(t, _STREET_LEAD_DE.search(t, max(0, at - 12), at).start(), h.end(), "de", self.lexicon, add)
        if self.weights is None:
            for s0, r in zip(starts, readings):
                self._featured(t, s0, lang, r, known, firms, add)
            return
        # what isn't beside an opponent isn't cited, and what has no candidate near it has no pair
        sides = {at for word in (" v. ", " v ", " gegen ", " c/ ", " re ", " affaire ") for p in _finds(t, word) for at in (p, p + len(word))}
        reach, others, most, heard = self.near, set(), self.most, known.keys() | firms
        for c in out:
            others.update(range(c.start - reach, c.start + 1))
            others.update(range(c.end, c.end + reach + 1))
        gaps[0] = gaps[-1] = len(t) + 99
        far, told, cited = reach + 9, most["known"], 0.0  # 9: a particle before the next
        after, into, both = most["out"], most["in"], self.pairs  # who has one neighbour isn't between two
        for r, s, e, gap, ahead in zip(readings, starts, ends, gaps, gaps[1:]):
            if r.alone and s not in others and e not in others:
                pairs = (both if ahead <= far else into) if gap <= reach else after if ahead <= far else 0.0
            else:
                pairs = both
            top = r.top + pairs
            if sides:
                cited = most["cited"] if s in sides or e in sides else 0.0
                top += cited
            if top > 0 or (top + told > 0 and not r.lasts.isdisjoint(heard)):
                self._scored(t, s, r, known, firms, pairs, cited, add)

    def _scored(self, t: str, s0: int, r: names.Reading, known: dict, firms: set, pairs: float, cited: float, add) -> None:
        left, get, most, el = None, self.weights.get, self.most, r.el
        for p in r.pieces:
            last = el[p.closes][2]
            named = last in known or last in firms
            more = pairs + cited + most["known"] if named else pairs + cited
            if p.top + more <= 0:
                continue
            a, b, c, _, most_b, most_c = p.tables
            score = p.score
            le = ri = _NONE
            if p.first:
                if left is None:
                    left = self._left(t, s0)
                le = left
                score += le[2] + a.get(le[0], 0.0)
            if p.final:
                if score + more + most[">"] + most_b + most_c <= 0:
                    continue
                ri = self._right(t, s0 + el[p.closes][1])
                score += ri[2] + b.get(ri[0], 0.0)
                if p.first:
                    score += c.get(le[0] + ri[0], 0.0)
            if score + more > 0:
                s, e = s0 + (el[p.opens - 1][5] + 1 if p.lead else el[p.opens][0]), s0 + el[p.closes][1]
                if named or le[0] == "v" or ri[0] == "v" or le[1] in _CITING:
                    score += sum([get(f, 0.0) for f in _surroundings(t, s, e, le, ri, last, p.parts, p.lead, known, firms)])
                if score + pairs > 0:
                    add(Span(s, e, "person_name", (), score))
        if t[max(0, s0 - 2) : s0].lower() in _PARTICLE_TAILS and (left or self._left(t, s0))[1] in names.PARTICLE_ENDS:
            at, particle = _particle(t, s0)
            if particle:
                le, lead = self._left(t, at), get("n:lead=" + particle, 0.0)
                for p in r.led:
                    a, b, c, *_ = p.tables
                    e = s0 + el[p.closes][1]
                    ri = self._right(t, e) if p.final else _NONE
                    score = p.score + lead + le[2] + a.get(le[0], 0.0) + (ri[2] + b.get(ri[0], 0.0) + c.get(le[0] + ri[0], 0.0) if p.final else 0.0)
                    if score + self.pairs + most["known"] + most["cited"] > 0:
                        score += sum([get(f, 0.0) for f in _surroundings(t, at, e, le, ri, el[p.closes][2], p.parts, particle, known, firms)])
                        if score + self.pairs > 0:
                            add(Span(at, e, "person_name", (), score))

    def _featured(self, t: str, s0: int, lang: str, r: names.Reading, known: dict, firms: set, add) -> None:
        left = self._left(t, s0)
        at, particle = _particle(t, s0) if left[1] in names.PARTICLE_ENDS else (s0, "")
        for p in r.pieces:
            s, e = s0 + p.start, s0 + p.end
            le, ri = left if p.first else _NONE, self._right(t, e) if p.final else _NONE
            f = _edges(lang, p.seq, le, ri) + _surroundings(t, s, e, le, ri, p.last, p.parts, p.lead, known, firms)
            add(Span(s, e, "person_name", p.features + f))
            if p.first and particle:
                le = self._left(t, at)
                f = [f"n:lead={particle}", "n:seq=p" + p.seq, *_edges(lang, "p" + p.seq, le, ri), *_surroundings(t, at, e, le, ri, p.last, p.parts, particle, known, firms)]
                add(Span(at, e, "person_name", p.features + f))


_NONE = ("", "", 0.0)
_RUNS = re.compile(f"({names.RUN.pattern})")


class _Readings(dict):
    """Readings by run, made when first asked for."""

    def __init__(self, read) -> None:
        super().__init__()
        self.read = read

    def __missing__(self, run: str) -> names.Reading:
        r = self.read(run)
        if len(self) > 150_000:  # runs of a stream never end
            self.clear()
        self[run] = r
        return r


def candidates(t: str, reader: Reader, unknown=None) -> list[Span]:
    """Every candidate of a collapsed text, by start. Spans that touch a blacked-out character aren't candidates."""
    out: list[Span] = []
    _emails(t, out.append)
    _numbers(t, out.append)
    _streets(t, reader.lexicon, out.append)
    reader.spans(t, out, unknown)
    if "█" in t:
        out = [c for c in out if t[c.start - 1 : c.start] != "█" and t[c.end : c.end + 1] != "█"]
    out.sort(key=lambda c: (c.start, c.end))
    return out


# ---------------------------------------------------------------- the field itself


@dataclass
class Model:
    """Weights of features and of pairs of neighbouring kinds, with the lexicon they were trained on."""

    lexicon: Lexicon
    weights: dict[str, float] = field(default_factory=dict)
    near: int = 6

    def reader(self) -> Reader:
        r = self.__dict__.get("_reader")
        if r is None:
            r = self.__dict__["_reader"] = Reader(self.lexicon, self.weights, self.near)
        return r

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_reader"}


def _groups(spans: list[Span], near: int) -> Iterator[list[Span]]:
    """Candidates in groups that neither overlap nor are neighbours of each other's."""
    group: list[Span] = []
    end = -99
    for c in spans:
        if group and c.start - end > near:
            yield group
            group = []
        group.append(c)
        end = max(end, c.end) if len(group) > 1 else c.end
    if group:
        yield group


def _pair(a: Span, b: Span, near: int) -> str | None:
    gap = b.start - a.end
    return f"pair:{a.kind}{'>' if gap > 1 else '|'}{b.kind}" if 0 <= gap <= near else None


def _by_end(g: list[Span]) -> tuple[list[int], list[int]]:
    """Candidates by where they end, and these ends. Whatever ends before a candidate starts also stands before it in the group."""
    order = sorted(range(len(g)), key=lambda k: (g[k].end, k))
    return order, [g[k].end for k in order]


def decode(spans: list[Span], model: Model) -> list[Span]:
    """The best choice of spans that don't overlap: Viterbi over segments, exact, with a running best of the paths that have ended."""
    w, near = model.weights.get, model.near
    chosen: list[Span] = []
    for g in _groups(spans, near):
        scores = [sum([w(f, 0.0) for f in c.features]) if c.score is None else c.score for c in g]
        if len(g) == 1:
            if scores[0] > 0:
                chosen.append(g[0])
            continue
        best: list[tuple[float, int]] = []
        order, ends = _by_end(g)
        done, far = 0, (0.0, -1)  # the best path whose end is too far away for a pair, or none
        for i, c in enumerate(g):
            while ends[done] < c.start - near:  # c's own end is never before its start
                j = order[done]
                if best[j][0] > far[0]:
                    far = (best[j][0], j)
                done += 1
            top, at = far
            for k in range(done, bisect_right(ends, c.start, done)):
                j = order[k]
                v = best[j][0] + w(_pair(g[j], c, near), 0.0)
                if v > top:
                    top, at = v, j
            best.append((top + scores[i], at))
        i = max(range(len(g)), key=lambda k: best[k][0])
        if best[i][0] > 0:
            path = []
            while i >= 0:
                path.append(g[i])
                i = best[i][1]
            chosen.extend(reversed(path))
    return chosen


def _lse(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs))


#: The most that a single word beside a name, and a neighbour or an opponent, may speak for it. Small bounds let most runs be left out unseen.
MOST_BESIDE, MOST_PAIR = 1.5, 1.0


def train(samples: list[tuple[list[Span], set[tuple[int, int, str]]]], lexicon: Lexicon, epochs: int = 5, rate: float = 0.5, l2: float = 1e-4) -> Model:
    """Maximises the conditional likelihood of the labelled segmentations by AdaGrad. Groups that are alike are one, with their number as weight."""
    model = Model(lexicon)
    weights, squares = defaultdict(float), defaultdict(float)
    alike: Counter = Counter()
    for spans, gold in samples:
        for g in _groups(spans, model.near):
            at = g[0].start
            alike[tuple((c.start - at, c.end - at, c.kind, tuple(c.features), (c.start, c.end, c.kind) in gold) for c in g)] += 1
    work = [([Span(s, e, k, f) for s, e, k, f, _ in key], [x[4] for x in key], n) for key, n in alike.items()]
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for q in rng.permutation(len(work)):
            g, marks, times = work[q]
            sc = [sum([weights[f] for f in c.features]) for c in g]
            grad: dict[str, float] = defaultdict(float)
            if len(g) == 1:
                d = (1.0 if marks[0] else 0.0) - 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, sc[0]))))
                if abs(d) < 1e-4:
                    continue
                for f in g[0].features:
                    grad[f] += d
            else:
                _gradient(g, marks, sc, weights, model.near, grad)
            for f, d in grad.items():
                d = d * times - l2 * weights[f]
                squares[f] += d * d
                v = weights[f] + rate * d / (1e-6 + math.sqrt(squares[f]))
                bound = MOST_BESIDE if f[:3] in ("n:<", "n:>") else MOST_PAIR if f[:5] in ("pair:", "n:cit") else None
                weights[f] = v if bound is None else min(v, bound)
    model.weights = {f: round(v, 4) for f, v in weights.items() if abs(v) > 1e-2}
    return model


def _gradient(g: list[Span], marks: list[bool], sc: list[float], weights: dict[str, float], near: int, grad: dict[str, float]) -> None:
    """Adds what is observed less what is expected, by forward and backward sums over all segmentations of a group."""
    n = len(g)
    order, ends = _by_end(g)
    starts = [c.start for c in g]
    allowed = [[order[k] for k in range(bisect_left(ends, c.start - near), bisect_right(ends, c.start))] for c in g]
    pairs = [[_pair(g[j], g[i], near) for j in allowed[i]] for i in range(n)]
    tr = [[weights[p] for p in ps] for ps in pairs]
    fwd, done, far = [0.0] * n, 0, 0.0  # far: sum over the paths that ended too far away for a pair, or none
    for i in range(n):
        while ends[done] < starts[i] - near:
            far = _lse([far, fwd[order[done]]])
            done += 1
        fwd[i] = sc[i] + _lse([far, *[fwd[j] + x for j, x in zip(allowed[i], tr[i])]])
    total = _lse([0.0, *fwd])
    beta, rest, near_after = [0.0] * n, [0.0] * (n + 1), [[] for _ in range(n)]  # rest[k]: sum over the paths that start at k or later, or none
    for i in reversed(range(n)):
        beta[i] = _lse([rest[bisect_right(starts, g[i].end + near)], *near_after[i]])
        rest[i] = _lse([rest[i + 1], sc[i] + beta[i]])
        for j, x in zip(allowed[i], tr[i]):
            near_after[j].append(x + sc[i] + beta[i])
    for i in range(n):
        d = (1.0 if marks[i] else 0.0) - math.exp(min(0.0, fwd[i] + beta[i] - total))
        if abs(d) > 1e-4:
            for f in g[i].features:
                grad[f] += d
        for j, p, x in zip(allowed[i], pairs[i], tr[i]):
            together = marks[i] and marks[j] and not any(marks[q] for q in range(j + 1, i))
            grad[p] += (1.0 if together else 0.0) - math.exp(min(0.0, fwd[j] + x + sc[i] + beta[i] - total))


# ---------------------------------------------------------------- seed labels

#: Words before a number that is no telephone number's.
NUMBER_NOUNS = {
    *("exhibit", "invoice", "note", "parcel", "no.", "bundle", "tab", "case", "paragraph", "ground", "day", "page", "section"),
    *("rechnung", "nr.", "blatt", "flurstück", "anlage", "aktenzeichen", "rn.", "facture", "parcelle", "pièce", "cote", "n°", "rg", "§", "£", "€"),
}


#: Words that announce a telephone number, and words that do so before a long one.
PHONE_CUES = {"tel", "tel.", "telephone", "phone", "fax", "rufnummer", "telefon", "telefonnummer", "tél", "tél.", "téléphone", "mobile", "mobil", "portable", "natel"}
NUMBER_CUES = {"number", "numéro", "on", "unter", "au", "from"}


#: Classes of a name's words, as the seeds read them: anywhere, and after a title.
_SEED_NAME = re.compile(r"(?:p|(?:[GI]p?)*P*)[SE](?:,G[GI]*)?|(?:[GI]p?)+P*[uD]")
_SEED_TITLED = re.compile(r"(?:p|(?:[GIu]p?)*P*)[SEuDGR]")


def seed_labels(t: str, spans: list[Span], lex: Lexicon) -> set[tuple[int, int, str]]:
    """Labels of the training sample, by rules that read the features of the candidates: the field learns from these.

    E-mail addresses and announced identity numbers as they stand; numbers in a telephone's form that no noun claims; addresses
    up to the last known town or code; names with all their parts, unless a firm, court, street or citation owns them.
    """
    gold: list[Span] = []
    ids = [c for c in spans if c.kind in ("id_number", "email")]
    gold += ids
    taken = [(c.start, c.end) for c in ids]
    free = lambda c: not any(a < c.end and c.start < b for a, b in taken)
    streets: dict[int, Span] = {}
    for c in spans:
        if c.kind == "street_address":
            town = next(f for f in c.features if f.startswith("street:town="))
            if c.start not in streets or (not town.endswith("new") and c.end > streets[c.start].end):
                streets[c.start] = c
    picked_end = -1
    for c in sorted(streets.values(), key=lambda c: c.start):
        if c.start >= picked_end and free(c):
            gold.append(c)
            taken.append((c.start, c.end))
            picked_end = c.end
    for c in spans:
        if c.kind == "phone" and free(c):
            prev = _before(t, c.start)
            if "phone:other" in c.features and not (prev in PHONE_CUES or (prev in NUMBER_CUES and sum(x.isdigit() for x in t[c.start : c.end]) >= 9)):
                continue
            if prev not in NUMBER_NOUNS and not prev.endswith("$") and not re.search(r"(?:Exhibit|Invoice|note|Rechnung|facture|parcel|Flurst)[^.;]{0,12}$", t[max(0, c.start - 24) : c.start]):
                gold.append(c)
                taken.append((c.start, c.end))
    by_end: dict[int, Span] = {}
    for c in spans:
        if c.kind != "person_name" or not free(c):
            continue
        f = set(c.features)
        seq = max((x[6:] for x in c.features if x.startswith("n:seq=")), key=len)
        titled = any(x.startswith(("n:i<T", "n:L=enT", "n:L=deT", "n:L=frT")) for x in f)
        if not (_SEED_NAME.fullmatch(seq) or (titled and _SEED_TITLED.fullmatch(seq))):
            continue
        if f & {"n:firm", "n:law", "n:cited=sure", "n:>&", "n:<99999"} or any(x.startswith("n:i>F") for x in f):
            continue
        left = next((x.split("<", 1)[1] for x in c.features if x.startswith(("n:d<", "n:<"))), "")
        if any(w in left for w in names.COURT_WORDS):
            continue
        core = re.sub(r"['’][sS]$", "", t[c.start : c.end].split(",")[0].split()[-1]).lower()
        if (core in lex.towns or core.title() in lex.towns) and not (titled or set(seq) & set("GI")):
            continue
        if "," in seq and any(x.startswith("n:i>") and x[5:6] != "," for x in f):
            continue  # the given name belongs to the next name
        if seq.startswith("p") and any(x.startswith("n:known") and x.endswith("False") for x in f):
            continue  # a preposition: the document has the name without it
        old = by_end.get(c.end)
        if old is None or c.start < old.start:
            by_end[c.end] = c
    for c in sorted(by_end.values(), key=lambda c: (c.start, -c.end)):
        if free(c):
            gold.append(c)
            taken.append((c.start, c.end))
    return {(c.start, c.end, c.kind) for c in gold}


# ---------------------------------------------------------------- on Spark

#: Documents that the field is trained on.
TRAINING_DOCUMENTS = 600
#: Listed given names that reach the driver at most.
GIVEN_NAMES = 100_000
#: Shares of words that are hidden from the lexicon in a document's second reading: of names, and of common words, fewer of which are new in a new text.
HIDDEN_NAMES, HIDDEN_COMMON = 0.5, 0.2


def fit(documents: DataFrame, given_names: DataFrame, training_documents: int = TRAINING_DOCUMENTS) -> Model:
    """Fits the field: the lexicon on all documents, the weights on a bounded sample (those whose hashed id is least), whole texts.

    given_names: given_name, a short incomplete list. The sample's size doesn't grow with the corpus.
    """
    order = F.xxhash64("doc_id")
    ids = [r.doc_id for r in documents.select("doc_id").where("doc_id is not null").distinct().orderBy(order, "doc_id").limit(training_documents).collect()]
    rows = documents.select("doc_id", "text").where(F.col("doc_id").isin(ids) & F.col("text").isNotNull()).dropDuplicates(["doc_id"]).collect() if ids else []
    place = {d: k for k, d in enumerate(ids)}
    texts = [collapse(r.text) for r in sorted(rows, key=lambda r: place[r.doc_id])]
    listed = [r.given_name.strip() for r in bounded(given_names.select("given_name").where("given_name is not null"), GIVEN_NAMES, "given_names") if r.given_name.strip()]
    lex = build_lexicon(documents, listed)
    return learn(texts, lex)


@contextmanager
def _uncollected() -> Iterator[None]:
    """Leaves out the search for cycles: candidates and readings are many, and hold none."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


@_uncollected()
def learn(texts: list[str], lex: Lexicon) -> Model:
    """The field of a sample of collapsed texts."""
    reader, samples = Reader(lex), []
    for k, t in enumerate(texts):
        spans = candidates(t, reader)
        gold = seed_labels(t, spans, lex)
        hidden = lambda word, kind: xxh32_intdigest(word, seed=k) < (HIDDEN_COMMON if kind == "c" else HIDDEN_NAMES) * 2**32  # noqa: B023, E731
        samples += [(spans, gold), (candidates(t, reader, hidden), gold)]
    return train(samples, lex)


def find(text: str | None, model: Model) -> list[tuple[str, str, int, int]]:
    """(kind, value, start, end) of a text, in order; offsets are those of the collapsed text."""
    return _find(collapse(text), model) if text else []


def _find(t: str, model: Model) -> list[tuple[str, str, int, int]]:
    return [(c.kind, t[c.start : c.end].replace("\n", " "), c.start, c.end) for c in decode(candidates(t, model.reader()), model)]


_SOLID = re.compile(r"\S+")


def _placer(text: str, t: str):
    """Where a character (no blank) of the collapsed text t stands in text: both hold the same words in the same order."""
    if text.replace("\n\n", "\n") == t:  # only paragraph ends differ
        return lambda x: x + t.count("\n", 0, x)
    own, short = [m.start() for m in _SOLID.finditer(text)], [m.start() for m in _SOLID.finditer(t)]
    if len(own) != len(short):  # can't be: both hold the same characters
        raise AssertionError("collapse changed characters")

    def place(x: int) -> int:
        k = bisect_right(short, x) - 1
        return own[k] + x - short[k]

    return place


def redact_counted(text: str | None, model: Model) -> tuple[str | None, int]:
    """`redact`, and how many values were replaced: one decoding for both."""
    if not text:
        return text, 0
    t = collapse(text)
    hits = _find(t, model)
    if not hits:
        return text, 0
    place, out, at = _placer(text, t), [], 0
    for kind, _, s, e in hits:
        out += [text[at : place(s)], f"[{kind.upper()}]"]
        at = place(e - 1) + 1
    return "".join([*out, text[at:]]), len(hits)


def redact(text: str | None, model: Model) -> str | None:
    """The text with every value replaced by its kind in brackets, e.g. [PERSON_NAME]; every other character stays.

    A value that is written over several lines is replaced with its line breaks. Null stays null.
    """
    return redact_counted(text, model)[0]


def find_pii(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, pii_kind, pii_text: distinct values of each document. Texts of null or no characters give no rows.

    Extra columns are ignored, and only doc_id and text reach Python. A document is a row of its own, so none can be a hot group;
    a repeated doc_id gives its values once.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for batch in batches:
            with _uncollected():
                rows = [(d, k, v) for d, text in zip(batch["doc_id"], batch["text"]) for k, v in dict.fromkeys((k, v) for k, v, _, _ in find(text, m))]
            yield pd.DataFrame(rows, columns=["doc_id", "pii_kind", "pii_text"])

    rows = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    return spread(rows).mapInPandas(run, "doc_id bigint, pii_kind string, pii_text string").distinct()


def redacted(documents: DataFrame, model: Model) -> DataFrame:
    """Every row of documents: doc_id, text with placeholders, n_found (values replaced)."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for batch in batches:
            with _uncollected():
                done = [redact_counted(x, m) for x in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [x for x, _ in done], "n_found": [n for _, n in done]})

    return spread(documents.select("doc_id", "text")).mapInPandas(run, "doc_id bigint, text string, n_found bigint")
