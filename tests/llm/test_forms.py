"""Runs of one signature are scored once, and quick scans find what plain ones find."""

import random
import re

from tessera.llm import names, pii


def test_runs_of_one_signature_are_scored_once_and_alike(monkeypatch):
    lex = names.Lexicon(given={"anna", "grace", "rowan"}, surnames={"fennsley", "hollinsley"})
    weights = {"n:last=S": 1.0, "n:end=sley": 0.5, "n:i<T": 0.7, "n:seq=GS": 0.3, "n:d<mrs": 0.2, "n:id=claimant": -0.4, "n:lead=de": 0.1, "n:L=en^|GS": 0.2}
    runs = ["Mrs. Anna Fennsley", "Mrs. Grace Hollinsley", "Mrs. Rowan Fennsley's", "Anna de Fennsley", "Rowan de Hollinsley", "Anna, Grace Fennsley", "Grace, Anna Hollinsley", "ANNA Fennsley", "A. Fennsley", "G. Hollinsley"]
    scored = []
    score = pii.Reader._score
    monkeypatch.setattr(pii.Reader, "_score", lambda self, lang, r: (scored.append(r), score(self, lang, r)))
    shared = pii.Reader(lex, weights)
    for run in runs:
        got = shared.reading("en", run)
        want = pii.Reader(lex, weights).reading("en", run)  # a reader that knows no other run
        place = lambda r, p: (r.el[p.opens - 1][5] + 1 if p.lead else r.el[p.opens][0], r.el[p.closes][1], p.seq, p.score, p.top)
        assert [place(got, p) for p in got.pieces] == [place(want, p) for p in want.pieces]
        assert [(q.seq, q.score) for q in got.led] == [(q.seq, q.score) for q in want.led]
        assert (got.top, got.alone, got.lasts, got.introduces, got.firms) == (want.top, want.alone, want.lasts, want.introduces, want.firms)
    assert len(scored) == len(runs) + 6  # all fresh ones; of the shared reader's runs, four have another's signature


def test_quick_scans_find_what_plain_ones_find():
    rng = random.Random(2)
    parts = [
        *("Anna", "O'Brien", "O’B5", "D-", "Mary‑Ann", "Dr.", "Mr", "M.", "As.", "MM.", "Jean-", "Ärger", "Œuvre", "ǅ", "x", "É", "de la ", "d'", "van der ", ", ", " ", " ", "-", ".", "█", "plc", " & Co", " ltd", "S. A", "ß", "'s"),
        *("1", "12", "12345", "٣", "٣٤", "𝟗", "(0", "+4", "/", "„", "\n", "12 Hollin Terrace", "9, rue de la Paix", "KX8", " AB", "²", "\xa0", "\t", "  ", "\n\n", "\r\n"),
    ]
    caps, letter = names._CAPS, names._LETTER
    word = rf"[{caps}](?:{letter}|['’‑-](?={letter}))*(?![\w█])"
    short = rf"(?:[{caps}]|Mr|Mrs|Ms|Dr|Prof|St|Messrs|Hr|Hrn|Fr|Me|Mme|Mlle|MM)\.{names._GOES_ON}"
    run = re.compile(
        rf"[{caps}](?<![\w█‑-].)(?:(?:rs?|s|rof|t|essrs|rn?|me|e|lle|M)?\.{names._GOES_ON}|(?:{letter}|['’‑-](?={letter}))*(?![\w█]))"
        rf"(?:(?: (?:(?:{names._PART}) )?(?:d['’])?|, |[‑-]?)(?:{short}|{word}))*(?: (?:{names._FORM}))*"
    )
    wide = f"[{names.DIGITS}]"
    number = re.compile(pii._RUN.pattern.replace(f"[+({names.DIGITS}](?:(?<=[+(])\\d|(?<=\\d)(?<!\\d\\d))", r"(?:[+(]\d|\d(?<!\d\d))"))
    street = re.compile(pii._STREET.pattern.replace(wide + r"(?<![\w.,/‑-].)(?<=\d)", r"\d(?<![\w.,/‑-]\d)"))
    code = re.compile(names._CODE.pattern.replace(wide + r"(?<=\d)", r"\d"))
    assert all(names.DIGITS not in p.pattern for p in (number, street, code))
    found = 0
    for _ in range(20000):
        t = "".join(rng.choices(parts, k=rng.randrange(14)))
        for quick, plain in ((names.RUN, run), (pii._RUN, number), (pii._STREET, street), (names._CODE, code)):
            spans = [m.span() for m in quick.finditer(t)]
            assert spans == [m.span() for m in plain.finditer(t)], t
            found += len(spans)
        assert "".join(pii._RUNS.split(t)) == t and pii._RUNS.split(t)[1::2] == names.RUN.findall(t)
        assert names.collapse(t) == "\n".join([" ".join(p.split()) for p in t.replace("\r\n", "\n").split("\n\n")])
        assert {a for a in t if a.isdecimal()} <= {a for a in t if re.match(wide, a)}
    assert found > 20000


def test_announcers_are_looked_for_by_parts():
    for x in ["Passport no. ", "PASSPORT AB ", "Reisepass Nr. ", "resident card: ", "Citizen card ", "identity number ", "ID card ", "Taxpayer reference ", "TIN ", "national insurance ", "NI number ", "Social Security ", "SSN ", "NINO ", "driver's license ", "Licence no. ", "Dienstausweis ", "Steuer-ID ", "Sozialversicherungsnummer ", "Versicherungsnummer ", "Führerschein ", "Aufenthaltstitel ", "carte d’identité ", "carte de séjour ", "Titre de séjour ", "permis de conduire ", "n° fiscal ", "numéro fiscal ", "sécurité sociale ", "NIR ", "NIF "]:
        assert pii._ANNOUNCED.search(x) and pii._announced(x + "12345", len(x)), x
    assert pii._announced("the court's 12345", 12) is None
