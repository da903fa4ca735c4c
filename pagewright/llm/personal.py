"""Personal information in free text, by a semi-Markov conditional random field.

Whole spans, not words, are scored: every span that could be an entity (bounded in length by its shape) is a segment
with features of its whole text, of the words around it and of the lexicon, and two segments in a row have a feature of
their types and of the gap between them; dynamic programming over the segments of a sentence chooses boundaries and
types jointly, what lies between is outside. Weights maximise the likelihood of
sentences made here from invented values, entities and their confusable counterparts alike; given names are
learnt from the column of names. Sentences are judged once for each form with masked figures.
"""
from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.lookalike import visible_form
from pagewright.session import written

KINDS = ("email", "phone", "idnum", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "idnum": "[IDNUM]", "address": "[ADDRESS]", "name": "[NAME]"}
LEXICON = 50_000  # given names that are sent to every executor, the most frequent; rarer ones are joined with the texts' words

# Legal forms and other words of which a firm's name holds one.
FIRM = ("GmbH|mbH|AG|KG|KGaA|OHG|eG|SE|SA|UG|GbR|B\\.V\\.|e\\. ?V\\.|Ltd|Inc|plc|LLC|Stiftung|Holding|Bank|Versicherungs?|"
        "Treuhand|Logistik|Immobilien|Hausverwaltung|Wohnungsgenossenschaft|Genossenschaft|Partner|Söhne|Sons|Bau|Gruppe|Verein|"
        "Trading|Mutual|Sparkasse|Kasse|Gesellschaft|Gemeinde|Stadt|Kanzlei")
TITLE = r"(?:Herrn?|Frau|Hr\.|Fr\.|Dr\.|Prof\.|Dipl\.-?\w+\.?|Mr\.?|Mrs\.?|Ms\.?|M\.|Mme|Notarin?|RAin|RA)"
PARTICLE = r"(?:von|van|vom|zu|zum|zur|de|der|den|del|di|da|du|le|la|ter|ten)"
CAP = r"[A-ZÀ-ÖØ-ÞĀ-Ž][a-zß-öø-ÿā-ž’']+(?:-[A-ZÀ-ÖØ-ÞĀ-Ž][a-zß-öø-ÿā-ž’']+)*"
UP = r"[A-ZÀ-ÖØ-ÞẞĀ-Ž]{2,}(?:-[A-ZÀ-ÖØ-ÞẞĀ-Ž]{2,})*"
BAR = r"\-‐–"

SHAPES = {
    "email": [r"(?:mailto:)?[\w+][\w.+-]*\s?(?:@|\(at\)|\[at\]|\{at\})\s?[\w-]+(?:\s?(?:\.|\[dot\]|\(dot\)|\{dot\})\s?[\w-]+)+"],
    "phone": [rf"(?<![\w.,/+-])(?:\+|00)\d{{1,3}}[ ./-]?(?:\(0\) ?)?\d[\d ./{BAR}()]{{5,16}}\d(?![\w])",
              rf"(?<![\w.,/+-])\(0\d{{1,5}}\)[ ./-]?\d[\d ./{BAR}]{{3,12}}\d(?!\w)",
              rf"(?<![\w.,/+-])0\d{{1,5}} ?[/. {BAR}] ?\d[\d ./{BAR}]{{3,13}}\d(?!\w)", r"(?<![\w.,/+-])0\d{8,13}(?![\w/-])"],
    "idnum": [r"(?<![\w-])[A-Z](?=[A-Z]*\d)[A-Z0-9]{7,9}[<D]?\d?(?![\w-])", r"(?<![\w.,/+-])\d{2}\s?\d{3}\s?\d{3}\s?\d{3}(?![\w/-])",
              r"(?<![\w.,/+-])\d{3}[- ]\d{2}[- ]\d{4}(?![\w/-])", r"(?<![\w.,/+-])\d{2}\s?\d{6}\s?[A-Z]\s?\d{2,3}(?![\w/-])",
              r"(?<![\w.,/+-])\d{2,3}/\d{3}/\d{4,5}(?![\w/-])", r"(?<![\w-])[CFGHJKLMNPRTVWXYZ]{9}(?![\w-])"],
    "address": [r"(?<!\w)(?:[A-ZÄÖÜ][\wäöüß.-]*\s)?[A-ZÄÖÜ][\wäöüß-]*(?:[Ss]tra(?:ß|ss)e|[Ss]tr\.|[Ww]eg|[Pp]latz|[Pp]l\.|[Gg]asse|[Aa]llee|[Uu]fer|[Rr]ing|[Gg]rund|[Ww]inkel|"
                r"[Gg]raben|[Dd]amm|[Ss]teig|[Pp]fad|[Hh]of|[Mm]arkt|[Cc]haussee|[Pp]romenade) \d{1,3}(?:\s?[a-z](?!\w))?(?:\s?[-–]\s?\d{1,3}(?:\s?[a-z](?!\w))?)?(?![\d.]*\d)",
                r"(?<!\w)(?:Am|An\sde[rnm]|Auf\sde[rm]|Im|In\sde[rn]|Zum|Zur|Hinter\sde[rmn]|Unterer|Oberer|Alter|Alte|Neue|Neuer|Großer|Kleine|Straße\sde[sr]|"
                r"Platz\sde[rs])\s(?:[A-ZÄÖÜ][\wäöüß]+\s)?[A-ZÄÖÜ][\wäöüß]+ \d{1,3}(?:\s?[a-z](?!\w))?(?:\s?[-–]\s?\d{1,3}(?:\s?[a-z](?!\w))?)?(?![\d.]*\d)",
                r"(?<!\w)[A-ZÄÖÜ][\wäöüß-]+ \d{1,3}(?:\s?[a-z](?!\w))?(?:\s?[-–]\s?\d{1,3})?(?=,?\s(?:in\s)?\d{5}\s[A-ZÄÖÜ])",
                r"(?<![\w.,])\d{1,4}[a-z]?\s(?:[A-Z][a-z]+\s){1,3}(?:Street|St|Road|Rd|Lane|Ln|Close|Terrace|Avenue|Ave|Drive|Court|Square|Way|Row|Hill|Crescent|Gardens|Place)(?!\w)",
                r"(?<!\w)\d{1,4},?\s(?:bis\s|ter\s)?(?:rue|avenue|boulevard|place|allée|chemin|impasse|quai)\s(?:(?:de|du|des|la|le|l’)\s?)*[A-ZÀ-Þ]?[\w'’-]+"],
}
_lead_title = re.compile(rf"(?:(?<!\w){TITLE}\s)+$").search
_rest = re.compile(rf"(?:[ -](?:{CAP}|{UP}|[A-ZÀ-Þ]\.))??(?:\s(?:{PARTICLE}|{PARTICLE.upper()}))*\s(?:{CAP}|{UP})(?![\w@])").match
_turned = re.compile(rf"(?:(?<!\w)(?:{PARTICLE}|{PARTICLE.upper()})\s)*(?<![\w-])(?:{CAP}|{UP}),\s$").search
_titled = re.compile(rf"(?<!\w)(?:Herrn?|Frau)\s(?:{TITLE}\s)*{CAP}(?:\s{PARTICLE})*\s{CAP}(?![\w@])")
_initial = re.compile(rf"(?<![\w.])(?<!\w\.\s)(?<!\w\.)[A-ZÀ-Þ]\.(?:\s(?:{PARTICLE}|{PARTICLE.upper()}))*\s(?:{CAP}|{UP})(?![\w@])"
                      rf"|(?<![\w-])(?:{CAP}|{UP}),\s[A-ZÀ-Þ]\.(?![\w])")
_words = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_token = re.compile(r"[\w’']+(?:-[\w’']+)*\.?|\S")
_stop = re.compile(r"\.\s").split
_date = re.compile(r"[01]?1\.[01]?1\.1[01]{3}|[0-3]?\d\.[01]?\d\.(?:19|20)\d\d").match
_firm = re.compile(rf"(?<!\w)(?:{FIRM})(?!\w)|&")
_title = re.compile(rf"(?:{TITLE}\s)+$|^(?:{TITLE}\s)")
CUES = {  # fixed values: words that tell what follows
    "phone": "tel telefon fon fax mobil handy phone call ruf rufnummer telefonisch gemeldet unter at",
    "idnum": "tin ssn steuer-id idnr steuer-identnummer identifikationsnummer identnummer sv-nr rv-nummer ausweisnummer ausweis reisepass pass-nr "
             "passnummer pass personalausweis personalausweis-nr ausweis-nr security rentenversicherungsnummer versicherungsnummer steuernummer "
             "sozialversicherungsnummer id-nr steuer-idnr steueridentifikationsnummer",
    "address": "wohnhaft anschrift sitz geschäftsanschrift c/o grundstück anwesen objekt adresse address wohnort",
    "name": "herr herrn frau durch von ehegattin ehegatte kind erschienen ist nach to notices angaben ansprechpartner rückfragen dr",
    "other": "hrb hra gnr aktenzeichen police artikelnummer schadennummer mandatsnummer vorgangsnummer kundengruppe kundennummer vertragsnummer "
             "vertrag register registerblatt blatt anlage plan din nr abs satz ziff ziffer art seite az ur-nr bezug formel faktor eur euro "
             "vom geb iban konto kontonummer rechnungsnummer angebot",
}
_cues = {w: k for k, ws in CUES.items() for w in ws.split()}


# Where a shape may stand at all. Each hint begins with a set or a sign, which the search can skip to, and holds wherever its
# shapes do, which may ask for more; some shapes need a figure.
_streets = ("traße", "trasse", "tr.", "weg", "Weg", "latz", "pl.", "Pl.", "asse", "llee", "ufer", "Ufer", "ring", "Ring", "rund", "inkel", "raben",
            "amm", "teig", "fad", "hof", "Hof", "arkt", "haussee", "omenade")
_shape = lambda kind, *of: [(kind, f"{kind}:{n}", re.compile(SHAPES[kind][n])) for n in of]
_gates = [(re.compile(x, re.S).search, figure, shapes) for x, figure, shapes in (
    (r"[@\]})]\s?[\w-]+\s?(?:\.|\[dot|\(dot|\{dot)", False, _shape("email", 0)),
    (r"[+(0](?:(?<=\+)\d|(?<=\()0\d|(?<=0)(?<![\w.,/+-].)(?:0\d|\d{4}|\d{0,5} ?[/. ‐–-]{1,3}\d[\d ./‐–-]{3}))", True, _shape("phone", 0, 1, 2, 3)),
    (r"[A-Z\d](?<![\w-].)(?:(?<=[A-Z])[A-Z0-9]{7}|(?<=\d)(?:\d{10}|\d\s?\d{3}\s?\d{3}\s?\d{3}|\d\d[- ]\d\d[- ]\d{4}|\d\s?\d{6}\s?[A-Z]|\d{1,2}/\d{3}/\d{4}))",
     True, _shape("idnum", 0, 1, 2, 3, 4)),
    (r"[CFGHJKLMNPRTVWXYZ]{9}", False, _shape("idnum", 5)),
    (r" (?=\d)(?:" + "|".join(f"(?<={re.escape(x)} )" for x in _streets) + ")", True, _shape("address", 0)),
    (r"(?:Am|An\sde[rnm]|Auf\sde[rm]|Im|In\sde[rn]|Zum|Zur|Hinter\sde[rmn]|Unterer|Oberer|Alter|Alte|Neue|Neuer|Großer|Kleine|Straße\sde[sr]|Platz\sde[rs])\s(?:[A-ZÄÖÜ][\wäöüß]+\s)?[A-ZÄÖÜ][\wäöüß]+ \d",
     True, _shape("address", 1)),
    (r"\d[a-z]?(?:\s[A-Z][a-z]+){1,3}\s(?:Street|St|Road|Rd|Lane|Ln|Close|Terrace|Avenue|Ave|Drive|Court|Square|Way|Row|Hill|Crescent|Gardens|Place)(?!\w)|\d,?\s(?:bis\s|ter\s)?(?:rue|avenue|boulevard|place|allée|chemin|impasse|quai)\s",
     True, _shape("address", 3, 4)),
    (r"\s\d{5}(?<=[,\w].{6})\s[A-ZÄÖÜ]", True, _shape("address", 2)),
    (r"[HF](?:errn?|rau)\s[A-ZÀ-ÞĀ-Ž]", False, [("name", "name:titled", _titled)]),
    (rf"[A-ZÀ-Þ]\.(?<![\w.]..)(?<!\w\.\s..)\s(?:{PARTICLE}\s|{PARTICLE.upper()}\s)*[A-ZÀ-ÞẞĀ-Ž][\w’']|,\s[A-ZÀ-Þ]\.(?<=[\w’']....)(?!\w)", False,
     [("name", "name:initial", _initial)]))]
_figure = re.compile(r"\d").search
_parts = re.compile(r"[^\W\d_]+").findall


def _fold(s: str) -> str:
    return s.lower().rstrip(".:,;(")


class Lexicon:
    """Given names, and rare ones besides that only one text has to know."""

    def __init__(self, given: set[str], rare: frozenset[str] = frozenset()):
        self.given, self.rare = given, rare
        self.first = {g.split("-")[0] for g in given}

    def with_rare(self, rare: list[str]) -> Lexicon:
        out = Lexicon.__new__(Lexicon)
        out.given, out.first, out.rare = self.given, self.first, frozenset(rare)
        return out

    def may_hold(self, words: list[str]) -> bool:
        """Whether one of the words, in small letters, is a part of a given name."""
        return not self.first.isdisjoint(words) or any(g.split("-")[0] in words for g in self.rare)

    def has(self, word: str) -> bool:
        w = word.lower().strip(".,")
        return any(w in names or ("-" in w and w.split("-")[0] in names) for names in (self.given, self.rare))


def _spots(s: str, lex: Lexicon):
    """(start, end, kind, shape) of every segment that could be an entity; the shapes of a kind are looked for where their
    hint is."""
    figures = _figure(s) is not None
    for hint, needs_figure, shapes in _gates:
        if (figures or not needs_figure) and hint(s):
            for kind, n, p in shapes:
                for m in p.finditer(s):
                    a, b = m.span()
                    yield a, a + len(_stop(m.group())[0].rstrip("./- ")) if kind == "phone" else b, kind, n
    if not lex.may_hold(_parts(s.lower())):
        return
    for m in _words.finditer(s):
        if m.group()[0].isupper() and lex.has(m.group()):
            a, b = m.span()
            lead = _lead_title(s[:a])
            start = lead.start() if lead else a
            if rest := _rest(s, b):
                yield start, rest.end(), "name", "name:given"
            if turned := _turned(s[max(0, a - 60):a]):
                yield max(0, a - 60) + turned.start(), b, "name", "name:turned"


def candidates(s: str, lex: Lexicon) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, kind, features) of every segment that could be an entity."""
    spots = set(_spots(s, lex))
    if not spots:
        return []
    out = []
    shapes = defaultdict(list)
    for a, b, kind, shape in sorted(spots):
        shapes[a, b, kind].append(shape)
    for (a, b, kind), own in shapes.items():
        text = s[a:b]
        if kind == "phone" and (_date(text) or sum(c.isdigit() for c in text) < 7):
            continue
        before, after = s[max(0, a - 60):a], s[b:b + 30]
        f = [*own, kind]
        for w in _token.findall(before)[-4:]:
            c = _cues.get(_fold(w))
            if c:
                f.append(f"{kind}<{c}")
        near = _token.findall(before)
        last = next((_fold(w) for w in reversed(near) if w not in ":.,;()-–|"), "")
        f.append(f"{kind}<<{_cues.get(last, '-' if last else '^')}")
        if kind == "name":
            if _firm.search(text) or re.match(rf"\s?(?:&|(?:{FIRM})(?!\w))", after) or re.search(rf"(?:&\s|(?<!\w)(?:{FIRM})\s)$", before):
                f.append("name:firm")
            ws = [w for w in _token.findall(text) if w[0].isupper()]
            f += [f"name:words{min(4, len(ws))}", "name:upper" if text.isupper() else "name:mixed"]
            if re.match(r"\s?[@(]\s?(?:at\))?", after) and after.lstrip()[:1] == "@":
                f.append("name:mail")
            if a == 0 and b == len(s):
                f.append("name:whole")
            if re.match(r"\s\d", after):
                f.append("name:number")
        if kind == "address":
            f.append("address>code" if re.match(r",?\s(?:in\s)?\d{5}", after) else "address>town" if re.match(r",\s[A-Z]", after) else "address>-")
        if kind in ("phone", "idnum"):
            n = sum(c.isdigit() for c in text)
            if re.search(r"\d\s?$", before):
                f.append(f"{kind}:behind")
            f.append(f"{kind}:digits{'<7' if n < 7 else '7-8' if n < 9 else '9-11' if n < 12 else '12+'}")
            if re.search(r"\d{1,2}\.\d{1,2}\.(?:19|20|11|10)\d\d$", text) or re.match(r"\s?(?:EUR|€|%|m²)", after):
                f.append(f"{kind}:amount")
        out.append((a, b, kind, f))
    return out


def _pair(before, after) -> str | None:
    """Feature of two segments next to each other in a sequence, null if they overlap; the first has none before it."""
    if before is None:
        return f"^>{after[2]}"
    gap = after[0] - before[1]
    return None if gap < 0 else f"{before[2]}>{after[2]}:{'near' if gap <= 12 else 'far'}"


def decode(cands: list, weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """The best sequence of segments that don't overlap, by the scores of segments and of neighbours in the sequence."""
    get = weights.get
    cands = sorted((a, b, k, sum(get(x, 0.0) for x in f)) for a, b, k, f in cands)
    best: list[tuple[float, int]] = []  # score of the best sequence that ends here, its segment before
    for i, c in enumerate(cands):
        top = (get(_pair(None, c), 0.0), -1)
        for j in range(i):
            if pair := _pair(cands[j], c):
                score = best[j][0] + get(pair, 0.0)
                if score > top[0]:
                    top = (score, j)
        best.append((top[0] + c[3], top[1]))
    out = []
    i = max(range(len(best)), key=lambda i: best[i][0], default=-1)
    if i >= 0 and best[i][0] > 0:
        while i >= 0:
            out.append(cands[i][:3])
            i = best[i][1]
    return out[::-1]


def _sum(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def _expected(cands: list, chosen: set[int], weights: dict[str, float]) -> dict[str, float]:
    """For each feature how often the wanted sequence has it less how often a sequence has it by the model: forward and
    backward sums over all sequences of segments that don't overlap. cands are in order."""
    get, n = weights.get, len(cands)
    own = [sum(get(x, 0.0) for x in c[3]) for c in cands]
    pairs = {(j, i): p for i in range(n) for j in range(-1, i) if (p := _pair(cands[j] if j >= 0 else None, cands[i]))}
    into, onto = defaultdict(list), defaultdict(list)
    for j, i in pairs:
        into[i].append(j)
        onto[j].append(i)
    fore, back = [0.0] * n, [0.0] * n
    for i in range(n):
        fore[i] = own[i] + _sum([(fore[j] if j >= 0 else 0.0) + get(pairs[j, i], 0.0) for j in into[i]])
    for j in range(n - 1, -1, -1):
        back[j] = _sum([0.0, *(get(pairs[j, i], 0.0) + own[i] + back[i] for i in onto[j])])
    total = _sum([0.0, *fore])
    out: dict[str, float] = defaultdict(float)
    for i in range(n):
        p = math.exp(fore[i] + back[i] - total)
        for x in cands[i][3]:
            out[x] += (i in chosen) - p
    for (j, i), x in pairs.items():
        out[x] -= math.exp((fore[j] if j >= 0 else 0.0) + get(x, 0.0) + own[i] + back[i] - total)
    last = -1
    for i in sorted(chosen):
        if (last, i) in pairs:
            out[pairs[last, i]] += 1
            last = i
    return out


# Invented names and words of the training sentences.
_GIVEN = "Arno Britta Carla Dennis Elif Fjodor Greta Hanno Imke Jonas Karin Levin Maren Nuri Olga Piotr Rosa Sven Tilda Ulf".split()
_LAST = "Ackerhof Bergfeld Dahlmann Erlbach Fichtner Gernhardt Hollerbeck Imhofen Kesselring Lindqvist Moosbrand Neuhauser Pohlkamp Rietmüller Sandvoss".split()
_STREETS = ["Gartenstraße", "Birkenweg", "Marktgasse", "Lindenallee", "Schillerplatz", "Bahnhofstr.", "Am Brunnen", "An der Mühle", "Zum Hafen", "Im Winkel", "Seeufer",
            "Rosengrund", "Hinter der Kirche", "Unterer Markt", "Straße der Arbeit", "Zum Alten Turm", "Feldwinkel", "Kirchpl.", "Hohlgraben"]
_TOWNS = ["Nordhafen", "Altbruck", "Steinfeld", "Weidenau"]
_FIRMS = ["{l} & Söhne Bau GmbH", "{l} Immobilien GmbH & Co. KG", "{l} Holding B.V.", "{g} {l} Logistik SE", "{l} Versicherungs-AG", "{l} Treuhand mbH", "{l} & Partner Bank eG", "{l} Mutual Ltd."]


def _example(r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """An invented sentence and its entities."""
    d = lambda n: "".join(r.choice("123456789" if not i else "0123456789") for i in range(n))
    g, last = r.choice(_GIVEN), r.choice(_LAST)
    if r.random() < .2:
        last += "-" + r.choice(_LAST)
    full = r.choice([f"{g} {last}"] * 4 + [f"{g} von {last}", f"{g} zur {last}", f"{g[0]}. {last}", f"{last}, {g}", f"{g} {last}".upper(), f"{g}-{r.choice(_GIVEN)} de {last}", f"von {last}, {g}"])
    if r.random() < .25 and "," not in full:
        full = r.choice(["Herr ", "Frau ", "Dr. ", "Dipl.-Ing. ", "Frau Dr. ", "Herrn "]) + full
    host = r.choice(["post.example", "mail.haus.test", "büro-nord.example", "firma.invalid"])
    box = r.choice([f"{g}.{last}", f"{g[0]}-{last}+x", f"info", f"{last}{d(2)}"]).lower()
    mail = r.choice(["{}@{}", "{} @ {}", "{}(at){}", "mailto:{}@{}", "{} [at] {}"]).format(box, host)
    if "[at]" in mail:
        mail = mail.replace(".", " [dot] ")
    phone = r.choice([f"0{d(3)}-{d(4)}-{d(3)}", f"+49 {d(2)} {d(5)} {d(3)}", f"(0{d(2)}) {d(5)}-{d(3)}", f"0{d(3)}/{d(7)}", f"+49{d(10)}", f"0{d(2)}.{d(5)}.{d(3)}", f"0{d(2)}–{d(5)}–{d(3)}",
                      f"0{d(2)} / {d(2)} {d(2)} {d(2)} {d(2)}", f"0049 {d(2)} {d(8)}", f"+44 20 {d(4)} {d(4)}", f"+49 (0){d(2)} {d(5)}-{d(3)}"])
    z = lambda n: "".join(r.choice("0012345678") for _ in range(n))
    ident = r.choice([d(11), f"{d(2)} {z(3)} {z(3)} {z(3)}", f"{d(3)}-{d(2)}-{d(4)}", f"C{r.choice('FGHJK')}{d(2)}{r.choice('RTVWX')}{d(4)}", f"L{d(2)}X{r.choice('CFG')}{d(4)}", f"{d(2)} {d(6)} {r.choice('ABCK')} {d(3)}"])
    idcue = r.choice(["TIN", "SSN", "Steuer-ID", "IdNr.", "Steuer-Identnummer", "steuerliche Identifikationsnummer", "SV-Nr.", "RV-Nummer", "Ausweisnummer", "Reisepass", "Pass-Nr.",
                      "Passnummer", "Personalausweis-Nr.:", "U.S. Social Security No.", "Ausweisnummer:", "TIN:", "SSN:"])
    house = r.choice([f"{d(1)}", f"{d(2)}", f"{d(2)}{r.choice('abc')}", f"{d(2)} {r.choice('abc')}", f"{d(2)}-{d(2)}", f"{d(3)}"])
    street = r.choice([f"{r.choice(_STREETS)} {house}"] * 4 + [f"{d(2)} {r.choice(['Mill Lane', 'Old Bridge Road', 'Harbour Street', 'Oak Terrace', 'Fern Close'])}"])
    firm = r.choice(_FIRMS).format(l=r.choice(_LAST), g=g)
    town = r.choice([f", {d(5)} {r.choice(_TOWNS)}", f" in {d(5)} {r.choice(_TOWNS)}", "", f", {r.choice(_TOWNS)}", f"\n{d(5)} {r.choice(_TOWNS)}".replace("\n", " ")])
    date = f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{r.randint(1950, 2023)}"
    N, M, P, I, A = ("name", full), ("email", mail), ("phone", phone), ("idnum", ident), ("address", street)
    parts = r.choice([
        [N], [N], [A], [A], [firm], [N, ", geb. " + date], ["Erschienen ist ", N, f", ausgewiesen durch {idcue} ", I, "."],
        ["Nach Angaben von ", N, ", wohnhaft ", A, town, ", E-Mail ", M, ", blieb das Tor zu."], [r.choice(["Anschrift: ", "Sitz: ", "c/o ", "wohnhaft ", ""]), A, town],
        [r.choice(["Tel. ", "Fon ", "mobil ", "Telefon: ", "", "Fax "]), P], [idcue + " ", I], [r.choice(["E-Mail: ", "Mail ", "erreichbar über ", ""]), M],
        [r.choice(["Tel. ", "Fon "]), P, "; ", idcue + " ", I, "; ", A, town], ["Sitz: ", A, town, f" | HRB {d(5)} Amtsgericht {r.choice(_TOWNS)}"],
        [f"{firm}, vertreten durch ", N], [f"Mandatsnummer {d(6)}, Anteil 2/6"], [f"Die Akte {d(2)} UR {d(3)}/2014, Schadennummer 20{d(2)}-{d(6)}, bleibt offen."],
        [f"Artikelnummer {d(2)} {d(3)} {d(2)} mit Faktor H2"], [f"Das Haus an der {r.choice(['Gartenstraße', 'Marktgasse'])} liegt im Plan {d(2)}."], [f"Zum {date} wurden {d(2)} Wohnungen fertig."],
        [f"Die {firm} ist unter HRB {d(5)} eingetragen."], [f"Vertrag Nr. KV-{d(9)} vom {date}"], [f"Am {r.randint(1, 28)}. Mai {d(4)} gegen Zahlung von {d(2)}.{d(3)} EUR"],
        ["Die Anzeige ging telefonisch ein (", P, "), die Sache liegt auf dem Grundstück ", A, "."], ["Bedacht ist die Ehegattin, ", N, ", danach das Kind ", ("name", f"{r.choice(_GIVEN)} {last}"), "."],
        ["Send notices to ", N, " at ", M, " or call ", P, "."], [N, " bewilligt den Eintrag."], ["Ansprechpartner ist ", N, ", erreichbar unter ", P, "."],
        [f"Im Grundbuch von {r.choice(_TOWNS)}, Blatt {d(3)}, lfd. Nr. 2"], [f"Prüfung nach DIN {d(4)}-{d(2)} bis {date}"], ["Erbengemeinschaft nach ", N], [N, " (", M, ")"],
        [f"Rechnungen, Fotos u. Ä. {r.choice(['Zum', 'Die', 'Hierzu'])} {d(2)}. Mai"], [f"um {d(2)},{d(2)} v. H. Die Bank zahlt."], [f"gilt Art. {d(1)} i. V. Blatt {d(1)}"],
        [f"{r.choice(['Unter der', 'Auf dem', 'Bei', 'Zur', 'Im'])} {r.choice(['Vorgangsnummer', 'Formblatt', 'Vertrag', 'Haus', 'Plan'])} {d(2)} gilt {r.choice(['Absatz', 'Satz'])} 2"],
        [f"Zum {r.choice(['Stichtag', 'Termin'])} {d(2)} Einheiten"], [f"Stand {r.randint(1, 12):02d}/{d(4)}"],
        [f"Kundennummer {d(8)}, Konto {d(10)}"], [f"Police PH-{d(9)} der {firm}"]])
    if r.random() < .2:  # values in any order
        bits = [[r.choice(["", "Sitz: ", "wohnhaft "]), A, town], [r.choice(["", "vertreten durch ", "durch Frau ", "Kontakt: "]), N], [r.choice(["Tel. ", "mobil ", ""]), P], [r.choice(["E-Mail ", ""]), M], [idcue + " ", I],
                [f"HRB {d(5)} Amtsgericht {r.choice(_TOWNS)}"], [f"Mandatsnummer {d(6)}"]]
        sign = r.choice([", ", "; ", " | "])
        parts = [x for k, bit in enumerate(r.sample(bits, r.randint(2, 5))) for x in ([sign] if k else []) + bit]
    text, gold = "", []
    for p in parts:
        if isinstance(p, tuple):
            gold.append((len(text), len(text) + len(p[1]), p[0]))
            text += p[1]
        else:
            text += p
    return text, gold


def fit(lex: Lexicon, examples: int = 1500, epochs: int = 4, rate: float = 0.3, seed: int = 11) -> dict[str, float]:
    """Weights by gradient steps on the likelihood of invented sentences; a sentence's gold segments are the candidates
    of the gold kind that cover the entity best."""
    r = random.Random(seed)
    lex = Lexicon(lex.given | {g.lower() for g in _GIVEN})
    data = []
    for _ in range(examples):
        text, gold = _example(r)
        cands = sorted(candidates(text, lex))
        chosen = set()
        for a, b, kind in gold:
            over = [(min(b, y) - max(a, x) - 0.1 * (max(0, a - x) + max(0, y - b)), n) for n, (x, y, k, _) in enumerate(cands) if k == kind and x < b and y > a]
            if over:
                chosen.add(max(over)[1])
        data.append((cands, chosen))
    weights: dict[str, float] = defaultdict(float)
    for epoch in range(epochs):
        r.shuffle(data)
        step = rate / (1 + epoch)
        for cands, chosen in data:
            if cands:
                for x, g in _expected(cands, chosen, weights).items():
                    if abs(g) > 1e-3:
                        weights[x] += step * g
    return dict(weights)


class Model:
    def __init__(self, given: set[str], weights: dict[str, float]):
        self.lex, self.weights = Lexicon(given), weights
        self.cache: dict[str, list] = {}
        self.rest: DataFrame | None = None  # (g): given names beyond the lexicon; stays with the driver

    def with_rare(self, rare: list[str]) -> Model:
        """The same for one text that holds rare given names."""
        out = Model.__new__(Model)
        out.lex, out.weights, out.cache, out.rest = self.lex.with_rare(rare), self.weights, {}, None
        return out

    def __getstate__(self):
        return self.lex.given, self.weights

    def __setstate__(self, state):
        self.__init__(*state)

    def sentence(self, masked: str) -> list[tuple[int, int, str]]:
        """Entities of a sentence with masked figures."""
        got = decode(candidates(masked, self.lex), self.weights)
        if len(masked) < 1000:
            if len(self.cache) > 250_000:
                self.cache.clear()
            self.cache[masked] = got
        return got

    def entities(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) in a text with plain spaces, in order. Sentences are cut at line ends only where a full stop stands."""
        flat = masked(text)
        out, at, get = [], 0, self.cache.get
        for part in _sentences(flat):
            got = get(part)
            if got is None:
                got = self.sentence(part)
            if got:
                out += [(a + at, b + at, k) for a, b, k in got]
            at += len(part) + 1
        return out


def masked(text: str) -> str:
    """All figures 1, but for one or two leading 0, which tell area and country codes. Which digit stands where decides
    nothing else, so that sentences recur."""
    return _digit.sub("1", _lead.sub("\1", text).replace("0", "1")).replace("\1", "0")


_wrapped = re.compile(r"[\t  -  　]")
_lead = re.compile(r"0(?:(?<!\d0)|(?<=(?<!\d)00))")  # two of them lead to a country
_digit = re.compile("[2-9]")
_sentences = re.compile(r"\s(?<=[a-zäöüß“)»][a-zäöüß“)»1][.!?]\s)(?=[A-ZÄÖÜ„»])").split


def _plain(text: str) -> tuple[str, list[int] | None]:
    """The visible form of a text and, where its length differs, the place of each of its characters."""
    form = visible_form(text)
    if len(form) == len(text):
        return form, None
    chars, places = [], []
    for k, ch in enumerate(text):
        if " " <= ch < "\x7f":  # stands for itself and joins nothing before it
            chars.append(ch)
            places.append(k)
            continue
        v = visible_form(ch)
        joined = visible_form(chars[-1] + v) if chars and v else ""
        if chars and v and len(joined) == 1:
            chars[-1] = joined
        else:
            for c in v:
                chars.append(c)
                places.append(k)
    return "".join(chars), places


_odd = re.compile("[^\x00-ɏ‐-‧‰-›€ ]|\xad").search


def analyse(text: str, model: Model) -> list[tuple[int, int, str]]:
    if not _odd(text):
        text = text.replace("\xa0", " ").replace("\t", " ")  # of those in _wrapped the others are odd
        return model.entities(text)
    plain, places = _plain(text)
    found = model.entities(_wrapped.sub(" ", plain))
    if places is None:
        return found
    places = [*places, len(text)]
    return [(places[a], places[b - 1] + 1, k) for a, b, k in found]


def redact(text: str, model: Model) -> str:
    out, at = [], 0
    for a, b, k in analyse(text, model):
        out += [text[at:a], PLACEHOLDER[k]]
        at = b
    return "".join([*out, text[at:]])


def learn(names: DataFrame, col: str) -> Model:
    """Given names: first words of names without a firm's word, and words behind a comma. The LEXICON most frequent are the
    model's own, the others its rest. The model's weights don't depend on the data otherwise."""
    x = F.trim(F.regexp_replace(F.col(col), rf"^(?:{TITLE}\s)+", ""))
    person = names.select(x.alias("x")).where(~F.col("x").rlike(FIRM.replace("Bau|", "") + r"|&|\p{N}|@"))
    first = F.when(F.col("x").contains(","), F.regexp_extract("x", r",\s*([\p{L}-]{2,})", 1)).otherwise(F.regexp_extract("x", r"^([\p{L}-]{2,})\s", 1))
    given = (person.select(F.lower(first).alias("g")).where("g <> ''").groupBy("g").agg(F.count("*").alias("n"))
                   .where(~F.col("g").isin("von zu zur zum de der die das erbengemeinschaft nachlass eheleute familie".split())))
    top = given.orderBy(F.desc("n"), "g").limit(LEXICON + 1).collect()
    lex = {r.g for r in top[:LEXICON]}
    model = Model(lex, fit(Lexicon(lex)))
    if len(top) > LEXICON:
        least = top[LEXICON - 1]
        model.rest = written(given.where((F.col("n") < least.n) | ((F.col("n") == least.n) & (F.col("g") > least.g))).select("g"))
    return model


def _known(rows: DataFrame, model: Model) -> DataFrame:
    """rows (field, row_id, text) with the rare given names that stand in the texts of a field's id, where there are any: the
    capitalised words are joined with the names of the rest, so that no name is lost however many there are. Without a
    rest the column is left out, as lists of nothing cost as much as the texts."""
    src = rows.select("field", F.col("row_id").cast("bigint").alias("row_id"), F.col("text").cast("string").alias("text"))
    if model.rest is None:
        return src
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\p{Lu}[\p{L}-]+"), F.lit(0)), F.lower))
    w = src.select("field", "row_id", F.explode(words).alias("w"))
    w = w.select("field", "row_id", F.explode(F.array_distinct(F.array("w", F.split_part("w", F.lit("-"), F.lit(1))))).alias("g"))
    rare = w.join(model.rest, "g").groupBy("field", "row_id").agg(F.collect_set("g").alias("rare"))
    return src.join(rare, ["field", "row_id"], "left")


def _rare(b: pa.RecordBatch) -> list:
    return b.column(3).to_pylist() if b.num_columns > 3 else [None] * b.num_rows


def found(rows: DataFrame, model: Model) -> DataFrame:
    """(field STRING, row_id BIGINT, kind STRING) of rows (field, row_id, text): each kind a text holds, once for each row.
    Null, empty and blank texts hold nothing; equal rows give equal rows; texts are read whole, however long; other
    columns of rows are not read."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            out = []
            for f, i, t, rare in zip(*(b.column(k).to_pylist() for k in range(3)), _rare(b)):
                found = analyse(t, m.with_rare(rare) if rare else m)
                if found:
                    out += [(f, i, k) for k in {k for _, _, k in found}]
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
                                             names=["field", "row_id", "kind"])

    return _known(rows, model).where(r"text RLIKE '\\S'").mapInArrow(run, "field STRING, row_id BIGINT, kind STRING")


def redacted(rows: DataFrame, model: Model) -> DataFrame:
    """(field, row_id, text): the texts with every value replaced by its placeholder, the rest unchanged; null stays null."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            texts = [t if t is None else redact(t, m.with_rare(rare) if rare else m) for t, rare in zip(b.column(2).to_pylist(), _rare(b))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["field", "row_id", "text"])

    return _known(rows, model).mapInArrow(run, "field STRING, row_id BIGINT, text STRING")
