"""Personal information in free text, found through disguises and replaced in place.

A text first passes a transducer: characters that look like Latin letters or
digits become those, invisible ones vanish, digits spelled out become digits,
and a map leads each place of the result back to the source. Detection runs on the
normalised text; spans come back through the map, so the source keeps every other
character. Plain texts, nearly all, need no map: places stay where they are.

What tells a candidate from its look-alikes:

* email: a mailbox whose host ends in letters; ``@`` may be written ``(at)``,
  ``[at]`` or `` at ``, a dot ``[dot]`` or `` dot ``. A lone `` at `` needs a spelled dot behind it.
* phone: a plus sign or 00 with a country code, a bracketed or leading-zero area
  code, or ten digits of the North American plan, none of them behind a word that
  announces an order, part, meter or lot number.
* id_number: a number shape behind the label of a personal paper.
* address: number and street name in English order, street name and number in
  German and Spanish order, with a unit before it.
* name: given and family name in any order or with initials, or title and family name.
  Three things tell a name. Parts: given names, and stems and endings of family names
  that combine freely, learned from the directory. Words: a capitalised word that the
  documents do not also write in lower case. Place: behind a title or a given name,
  or as a pair behind a greeting, a label for persons or a closing, or before a mailbox.
  The directory is one sign among these; nobody has to be in it.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "name")

#: Characters that pass for Latin letters, by look.
LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТУХЅІЈавекмнорстухѕіјԁԛԝɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορτυχι‐‑‒–—−’‘ʼ＇",
        "ABEKMHOPCTYXSIJabekmhopctyxsijdqwgABEZHIKMNOPTYXavoptuxi------''''",
    )
)
#: Digits as words.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Forms of address, in English, German and Spanish.
TITLES = ("mr", "mrs", "ms", "mx", "miss", "dr", "prof", "professor", "herr", "herrn", "frau", "sr", "sra", "srta", "señor", "señora", "señorita", "don", "doña")
#: Titles that are also words, which need a known family name or ending behind them.
WEAK_TITLES = ("don", "doña", "miss", "sr", "ms", "prof")
#: What begins and ends a letter, and labels of persons, in English, German and Spanish.
GREETINGS = ("dear", "hello", "hi", "hallo", "liebe", "lieber", "hola", "estimado", "estimada", "querido", "querida", "guten tag")
CLOSINGS = ("regards", "wishes", "sincerely", "yours", "thanks", "thank you", "cheers", "grüße", "grüßen", "gruß", "grüssen", "saludo", "saludos", "atentamente", "gracias")
PERSONS = (
    "name", "full name", "contact", "employee", "applicant", "patient", "tenant", "customer", "caller", "author", "attn", "attention", "signed", "signed by",
    "prepared by", "reported by", "approved by", "written by", "kontakt", "ansprechpartner", "ansprechpartnerin", "antragsteller", "antragstellerin", "mitarbeiter",
    "mitarbeiterin", "kunde", "kundin", "unterzeichnet", "nombre", "contacto", "empleado", "empleada", "solicitante", "cliente", "firmado",
)
#: Capitalised words that are no part of a person's name: bodies, places, roles and the calendar.
NO_NAMES = frozenset(
    """team group board desk hub index relay ltd limited inc gmbh ag kg corp company department division office unit section committee council
    service services system systems portal platform centre center institute university school clinic hospital bank street road avenue lane way drive court
    square place park room floor hall wing building house site station airport north south east west manager director officer president chair secretary
    engineer analyst clerk supervisor coordinator assistant lead steward planner inspector captain doctor nurse
    monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december
    montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz mai juni juli oktober dezember
    lunes martes miércoles jueves viernes sábado domingo enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre
    leiter leiterin abteilung gruppe amt stelle gerente directora equipo the this that and for all team-lead""".split()
)
#: Particles before a family name.
PARTICLES = ("van der", "van den", "van", "von der", "von", "de la", "de los", "de las", "del", "de", "di", "da", "dos", "la", "le", "ter", "ten", "zu")
#: Labels of personal papers.
PAPERS = (
    "social security", "ssn", "personal code", "national id", "national insurance", "passport", "driving licence", "driving license",
    "driver's license", "driver's licence", "licence number", "license number", "tax id", "tax number", "tax no", "taxpayer", "insurance no", "insurance number",
    "identity card", "identity no", "identity number", "id card", "id number", "personal id", "ausweis", "reisepass", "versicherungsnummer", "versicherungs-nr",
    "steuer-id", "steuernummer", "steuer-nr", "identifikationsnummer", "führerschein", "pasaporte", "documento", "dni", "nie", "nif", "seguridad social", "carné", "permiso de conducir",
    "health card", "health insurance", "nhs", "afiliación", "cédula", "personnummer", "krankenversicher", "sozialversicher", "rentenversicher", "residence permit", "permit no",
)
#: Words that announce some other number.
OTHER_NUMBERS = (
    "order", "part", "meter", "lot", "ticket", "build", "checksum", "reference", "ref", "invoice", "serial", "item", "case", "batch", "version", "total",
    "bestellung", "teil", "zähler", "charge", "rechnung", "pedido", "pieza", "contador", "lote", "factura",
)
#: Kinds of street.
STREETS = (
    "street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "way", "close", "terrace", "ter", "boulevard", "blvd", "drive", "court", "ct", "place", "pl",
    "square", "sq", "crescent", "cres", "row", "walk", "gardens", "grove", "parkway", "pkwy", "highway", "hwy", "mews", "quay",
    "rise", "broadway", "hill", "circle", "trail", "loop", "alley", "vale", "wharf", "heights", "path", "promenade", "esplanade", "strand", "passage", "embankment", "view", "mount",
)

_S = r"(?:[^\S\n]+|[^\S\n]*\n[^\S\n]*)"  # blanks or one line end: hard-wrapped lines break anywhere
_INVISIBLE = {"Cf", "Mn", "Me"}
_ODD = re.compile(r"[^\x00-ɏ‐-‧]|[\xad̀-ͯ]|[‐-’]")


def _alternatives(words: Iterable[str]) -> str:
    return "|".join(re.escape(w).replace(r"\ ", _S) for w in sorted(words, key=len, reverse=True))


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int


class Normal:
    """A normalised text and the way back to its source."""

    __slots__ = ("text", "back")

    def __init__(self, text: str, back: list[int] | None):
        self.text, self.back = text, back

    def source(self, start: int, end: int) -> tuple[int, int]:
        if self.back is None:
            return start, end
        return self.back[start], self.back[end - 1] + 1 if end > start else self.back[start]


_RUN = re.compile(rf"(?i)\b(?:plus[\s,.-]+)?(?:{'|'.join(sorted(SPELLED, key=len, reverse=True))})(?:[\s,.-]+(?:{'|'.join(sorted(SPELLED, key=len, reverse=True))})\b){{4,}}")
_WORD = re.compile(r"[^\W\d_]+")


def normalise(text: str, spelled: bool = True) -> Normal:
    """Look-alikes to Latin, invisible characters out, runs of five or more spelled digits to digits.

    ``spelled`` false says that the text is known to hold no such run.
    """
    out, back = text, None
    if not text.isascii() and _ODD.search(text):
        chars: list[str] = []
        back = []
        for i, ch in enumerate(text):
            if ch.isascii():
                new = ch
            elif ch in LOOKALIKES:
                new = LOOKALIKES[ch]
            elif unicodedata.category(ch) in _INVISIBLE:
                if unicodedata.category(ch) == "Mn" and chars:
                    joined = unicodedata.normalize("NFC", chars[-1] + ch)
                    if len(joined) == 1:
                        chars[-1] = joined
                continue
            else:
                flat = unicodedata.normalize("NFKC", ch)
                new = flat if len(flat) == 1 else ch
            chars.append(new)
            back.append(i)
        out = "".join(chars)
    if spelled and _RUN.search(out):
        parts, places, at = [], [], 0
        for m in _RUN.finditer(out):
            parts.append(out[at : m.start()])
            places.extend(range(at, m.start()))
            words = list(_WORD.finditer(m.group()))
            for w in words:
                parts.append("+" if w.group().lower() == "plus" else SPELLED[w.group().lower()])
                # The last digit stands for the end of its word, so that spans cover all of it.
                places.append(m.start() + (w.start() if w is not words[-1] else w.end() - 1))
            at = m.end()
        parts.append(out[at:])
        places.extend(range(at, len(out)))
        out = "".join(parts)
        back = [back[p] for p in places] if back is not None else places
    return Normal(out, back)


class Lexicon:
    """Given names, and stems and endings of family names, learned from a directory; ``common``, words of the documents."""

    def __init__(self, given: Iterable[str], family: Iterable[str], common: Iterable[str] = ()):
        self.common = frozenset(common)
        self.given = {g.strip().lower() for g in given if g and g.strip()}
        bare = {re.sub(rf"^(?:(?:{_alternatives(PARTICLES)})\s+)?(?:al-|el-|[od]['’])?", "", f.strip().lower()) for f in family if f and f.strip()}
        self.family = {b for b in bare if b}
        stems, endings = defaultdict(set), defaultdict(set)
        for f in self.family:
            for i in range(4, len(f) - 1):
                stems[f[:i]].add(f[i:])
                endings[f[i:]].add(f[:i])
        cuts = [max((len(stems[f[:i]]) * len(endings[f[i:]]), f[:i], f[i:]) for i in range(4, len(f) - 1)) for f in self.family if len(f) > 5]
        often = lambda k: {x for x, n in Counter(c[k] for c in cuts).items() if n >= 2}
        self.stems, self.endings = often(1), often(2)


def _email_patterns():
    local = r"[^\W_](?:[\w.+'-]*[\w])?"
    label = r"[^\W_](?:[\w-]*[^\W_])?"
    at = rf"(?:@|{_S}@{_S}|{_S}?[(\[{{]\s?(?:at|ät|arroba)\s?[)\]}}]{_S}?)"
    dot = rf"(?:\.|{_S}?[(\[{{]\s?(?:dot|punkt|punto)\s?[)\]}}]{_S}?|{_S}(?:dot|punkt|punto){_S})"
    spelled_dot = rf"(?:{_S}?[(\[{{]\s?(?:dot|punkt|punto)\s?[)\]}}]{_S}?|{_S}(?:dot|punkt|punto){_S})"
    host = re.compile(rf"(?i){at}(?P<host>{label}(?:{dot}{label})*)")
    word_host = re.compile(rf"(?i){_S}at{_S}(?P<host>{label}(?:{spelled_dot}{label})+)")
    bracket_dot = rf"{_S}?[(\[{{]\s?(?:dot|punkt|punto)\s?[)\]}}]{_S}?"
    before = re.compile(rf"(?i)(?:^|(?<=[^\w.+'-]))({local}(?:{bracket_dot}{local})*)\Z")
    before_words = re.compile(rf"(?i)(?:^|(?<=[^\w.+'-]))({local}(?:(?:{bracket_dot}|{_S}(?:dot|punkt|punto){_S}){local})*)\Z")
    return host, word_host, before, before_words, re.compile(rf"(?i){spelled_dot}")


_HOST, _WORD_HOST, _LOCAL, _LOCAL_WORDS, _SPELLED_DOT = _email_patterns()
#: A mailbox name has at most 64 characters; spelled dots and look-alikes make it longer.
_LOCAL_REACH = 160

_PHONE = re.compile(
    r"""(?x)(?<![\w@.,/-])(?:
      (?:\+[ ]?\d{1,3}|00[1-9]\d?(?=[ \n.-])|00[1-9]\d\d(?=[ .-]))(?:(?:[ \n/-]|\.(?=\d)){0,2}\(?\d{1,8}\)?){2,6}  # country code
    | \(\d{2,5}\)[ \n.-]{0,2}\d{2,4}(?:[ \n.-]\d{2,4}){1,3}                              # bracketed area
    | (?:1[ .-])?\d{3}([.-])\d{3}\1\d{4}                                              # 212-555-0100
    | 0[1-9]\d{1,3}[ \n/-]\d{3,8}(?:[ \n-]\d{2,4}){0,2}                                   # leading zero; 00 begins a post code
    | 0\d(?:[. \n-]\d{2}){4}                                                             # pairs
    | [2-9]\d{2}[2-9]\d{6}                                                              # ten digits
    | 0\d{9,11}                                                                        # leading zero, unbroken
    )(?![\w@]|[.,/-]\d)"""
)
#: Where a phone can be at all: first a cheap look for long runs of digits and marks.
_DIGITS = re.compile(r"[+(\d][\d\s().+/-]{6,}")
_OTHER = re.compile(rf"(?i)(?:\b(?:{'|'.join(OTHER_NUMBERS)})s?\.?|\#){_S}?(?:no\.?|nr\.?|number|id|:|\#)?{_S}?\Z")

_PAPER_TAIL = re.compile(
    rf"""(?ix)[\w-]{{0,20}}?\.?(?:{_S}?(?:number|no\.?|nr\.?|num\.?|núm\.?|n[º°]\.?|code|card|id|\#|:|-nr\.?|-id|-nummer|is|lautet|es)){{0,3}}{_S}?[:\#]?{_S}?(?-i:
    (?P<id>\d{{3}}[- ]\d{{2}}[- ]\d{{4}} | \d{{6}}-\d{{4}} | \d{{4}}\.\d{{3}}\.\d{{3}}-[\dA-Z] | \d{{2}}\.\d{{3}}\.\d{{3}}-[\dA-Z]
      | \d{{2}}(?:\s\d{{3}}){{3}} | [A-Za-z]{{2}}(?:\s\d{{2}}){{3}}\s[A-Za-z] | [A-Za-z]{{1,5}}-?\d{{6,7}}(?:[A-Za-z]\d|[A-Za-z]{{0,2}}) | \d{{8}}[A-Za-z]
      | \d{{3}}\s\d{{3}}\s\d{{3}} | \d{{9,11}} | \d{{3}}\s\d{{2}}\s\d{{4}}))(?![\w]|[.-]\d)""".replace("\\s", _S)
)

_UNIT = r"(?:(?:unit|flat|apt|apartment|suite|ste|room|floor|no)\.?" + _S + r"?#?" + _S + r"?\d{1,5}[a-z]?,?" + _S + r"|\#" + _S + r"?\d{1,5},?" + _S + r")"
_EN_TAIL = re.compile(rf"(?P<unit>(?i:{_UNIT}))?(?<![\w.,/-])(?P<no>\d{{1,5}}[A-Za-z]?),?{_S}(?P<name>(?:(?:[A-ZÀ-Þ][\w'’]*\.?|\d+(?:st|nd|rd|th)){_S}){{1,4}})\Z")
_EN_KIND = re.compile(rf"(?i)\b(?:{'|'.join(STREETS)})\b")
_DE = re.compile(rf"(?P<name>(?:\b(?:Alte[rn]?|Neue[rn]?|Große|Kleine|Obere|Untere|Am|An{_S}der|Im|Zum|Zur|[A-ZÄÖÜ][\wäöüß]+er|ALTE|NEUE|[A-ZÄÖÜ]+ER){_S})?\b[A-ZÄÖÜ][\wäöüß]*(?:-[A-Za-zÄÖÜäöüß]*)?)\Z")
_DE_APART = re.compile(rf"(?:\b(?:Alte|Neue|Große|Kleine|ALTE|NEUE){_S})?\b[A-ZÄÖÜ][\wäöüß-]+{_S}\Z")
_DE_ER = re.compile(rf"\b(?:[A-ZÄÖÜ][a-zäöüß]+er|[A-ZÄÖÜ]+ER){_S}\Z")
_DE_KIND = re.compile(rf"(?i)(?:straße|strasse|str\.|gasse|weg|platz|allee|damm|ufer|steig)(?P<no>{_S}\d{{1,4}}(?:{_S}?[a-z]\b)?(?![\d.:/-]))")
_ES = re.compile(
    rf"(?:\b(?i:calle|plaza|avenida|avda\.|paseo|camino|ronda|carrera|pza\.|travesía)|\b(?i:c/)){_S}?(?P<name>(?:(?:[A-ZÀ-Þ][\wÀ-ÿ]*|de|del|la|las|los|el|y){_S}){{1,6}}?),?{_S}?(?i:n\.?º{_S}?|núm\.?{_S}?)?\d{{1,4}}\b"
)


#: Digits that a number has after these beginnings, prefix included.
_LENGTHS = (("+44", 12), ("0044", 14), ("+1", 11), ("+33", 11), ("0033", 13), ("+61", 11), ("+34", 11), ("+49", 13))


def _whole_number(found: str) -> int:
    """Where a phone number ends, if more digits follow that belong to something else."""
    most = next((n for p, n in _LENGTHS if found.startswith(p)), 11 if found[0] in "(0" else 15)
    seen = 0
    for i, c in enumerate(found):
        if c.isdigit():
            seen += 1
            if seen == most and not found[i + 1 : i + 2].isdigit():
                return i + 1
        elif c == "\n" and seen >= 10:
            return i
    return len(found)


def _crowded(hits) -> bool:
    """Five words for digits, one close behind the other."""
    run, last = 0, -99
    for a, b in hits:
        run = run + 1 if a - last <= 6 else 1
        if run >= 5:
            return True
        last = b
    return False


#: What may follow a street: a unit, then a town if it has a post code.
_AFTER = re.compile(
    rf"(?:,{_S}?(?:(?i:apt|flat|unit|suite|apartment){_S}?#?{_S}?\d{{1,5}}[a-z]?|\#{_S}?\d{{1,5}}|\d{{1,2}}\.?[ºª](?:{_S}[A-Z])?|(?i:bajo|piso{_S}\d{{1,2}}))\b)?"
    rf"(?:,{_S}?(?:\d{{4,5}}{_S}[^\W\d_][\w'-]+|[^\W\d_][\w'-]+(?:{_S}[^\W\d_][\w'-]+)?{_S}(?:\d{{5}}|[A-Z]{{1,2}}\d{{1,2}}{_S}\d[A-Z]{{2}}))\b)?"
)


class Finder:
    """Finds spans in one text. Built once for each task from the lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        given = _alternatives(lexicon.given) or r"(?!)"
        stems, ends = "|".join(sorted(map(re.escape, lexicon.stems), key=len, reverse=True)) or r"(?!)", "|".join(sorted(map(re.escape, lexicon.endings), key=len, reverse=True)) or r"(?!)"
        whole = "|".join(sorted(map(re.escape, lexicon.family), key=len, reverse=True)) or r"(?!)"
        lead = rf"(?:\b(?:{_alternatives(PARTICLES)}){_S})?(?:\b(?:al-|el-|[od]['’]))?"
        initial = r"[^\W\d_]\."
        self._lead = re.compile(rf"(?i){lead}\Z")
        self._rest = re.compile(rf"(?i)(?:(?:{stems})(?:{ends})|(?:{whole}))(?![\w@])")
        self._left = re.compile(rf"(?i)(?<![\w@.+-])(?:{given}|{initial})(?:{_S}{initial})*{_S}\Z")
        self._title = re.compile(rf"(?i)(?<![\w@.+-])(?:{'|'.join(TITLES)})\.?{_S}\Z")
        self._right = re.compile(rf"(?i)(?:,{_S}?(?:{given}|{initial})|{_S}(?:{given}))(?![\w@+]|[-.]\w)")
        # A given name before a family name that the directory has no part of.
        any_family = rf"(?:{initial}{_S})*(?:(?:{_alternatives(PARTICLES)}){_S}(?:al-|[od]['’])?|(?:al-|[od]['’]))[^\W\d_][\w'’-]+"
        self._given_then = re.compile(rf"(?i)(?:{_S}{initial})*{_S}(?:{any_family}|(?-i:[A-ZÀ-Þ][\w'’-]*)(?:{ends}))(?![\w@])")
        self._title_then = re.compile(rf"\.?{_S}(?:{initial}{_S})*(?P<family>(?i:{lead})[A-ZÀ-Þ][^\W\d_]*(?i:{ends}))(?![\w@])")
        # Names by their place: the words are checked one by one.
        cap = r"[A-ZÀ-ÞŁŚŻČŠŽĀĒĪŌŪ][^\W\d_]*(?:['’-][^\W\d_]+)*"
        blank = r"(?:[ \u00a0]+|[ \u00a0]*\n[ \u00a0]*)"
        pair = lambda b: rf"(?:{cap}|{initial})(?:{b}(?:{initial}))*{b}(?:(?i:{_alternatives(PARTICLES)}){b})?(?i:al-|el-|[od]['’])?{cap}(?:{b}{cap})?"
        some = pair(blank)
        self._behind_title = re.compile(rf"\.?{_S}(?P<name>(?:{initial}{_S})*(?:(?P<first>{cap}){_S}(?={cap}|(?i:{_alternatives(PARTICLES)}){_S}))?(?:(?i:{_alternatives(PARTICLES)}){_S})?(?i:al-|el-|[od]['’])?{cap})(?![\w@])")
        self._behind_given = re.compile(rf"(?:{_S}{initial})*{_S}(?P<family>{cap})(?![\w@]|[-.]\w)")
        end = r"(?=[^\S\n]*(?:[,;:!|()<\[\t\n]|$))"
        self._placed = {
            "greeting": re.compile(rf"{_S}(?P<name>{some}){end}"),
            "closing": re.compile(rf"[,.!]?[^\S\n]*\n+[^\S\n]*(?P<name>{some})[^\S\n]*(?=\n|$)"),
            "person": re.compile(rf"[^\S\n]*[:=][^\S\n]*(?P<name>{some}){end}"),
        }
        self._before_mail = re.compile(rf"(?<![\w.@-])(?P<name>{pair('[ ]')})[ ][(<\[][ ]?\Z")
        words: dict[str, set[str]] = defaultdict(set)
        for what, keys in (
            ("@", ("@", "(at)", "[at]", "{at}", "( at )", "[ at ]", "(arroba)", "[arroba]")),
            ("dot", (" at ", " at\n", "\nat ")),
            ("paper", (*PAPERS, *(p.replace(" ", "\n") for p in PAPERS))),
            ("digit", tuple(SPELLED)),
            ("de", ("straße", "strasse", "str.", "gasse", "weg", "platz", "allee", "damm", "ufer", "steig")),
            ("es", ("calle", "plaza", "avenida", "avda.", "paseo", "camino", "ronda", "carrera", "pza.", "c/", "travesía")),
            ("en", tuple(f"{b}{k}" for k in STREETS for b in (" ", "\n"))),
            ("stem", tuple(lexicon.stems) + tuple(lexicon.family)),
            ("given", tuple(lexicon.given)),
            ("title", tuple(f"{t}{e}" for t in TITLES for e in (".", " ", "\n"))),
            ("greeting", GREETINGS),
            ("closing", CLOSINGS),
            ("person", PERSONS),
        ):
            for k in keys:
                words[k].add(what)
        self._auto = ahocorasick.Automaton()
        for k, whats in words.items():
            self._auto.add_word(k, (len(k), tuple(sorted(whats))))
        self._auto.make_automaton()

    def find(self, text: str | None) -> list[Span]:
        """All mentions in order; none for null or empty text. Spans of one kind do not overlap."""
        if not text:
            return []
        normal = normalise(text, spelled=False)
        low, hits = self._scan(normal.text)
        if _crowded(hits.get("digit", ())):
            normal = normalise(text)
            low, hits = self._scan(normal.text)
        t = normal.text
        found: list[Span] = []
        found += self._emails(t, low, hits)
        taken = [(s.start, s.end) for s in found]
        ids = self._papers(t, hits.get("paper", ()))
        found += ids
        phones = self._phones(t, sorted(taken + [(s.start, s.end) for s in ids]))
        found += phones
        blocked = sorted(taken + [(s.start, s.end) for s in ids + phones])
        found += self._addresses(t, hits, blocked)
        found += self._names(t, hits, taken)
        if normal.back is not None:
            found = [Span(s.kind, *normal.source(s.start, s.end)) for s in found]
        return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))

    def _scan(self, t: str) -> tuple[str, dict[str, list[tuple[int, int]]]]:
        """The lowered text and where its keywords lie."""
        low = t.lower()
        if len(low) != len(t):  # a few letters grow when lowered; keep places
            low = "".join(c if len(c.lower()) > 1 else c.lower() for c in t)
        hits: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for end, (n, whats) in self._auto.iter(low):
            for w in whats:
                hits[w].append((end - n + 1, end + 1))
        return low, hits

    def _emails(self, t: str, low: str, hits) -> list[Span]:
        out, last = [], -1
        tries = [(a, _HOST) for a, _ in hits.get("@", ())] + [(a, _WORD_HOST) for a, _ in hits.get("dot", ())]
        for a, pattern in sorted(tries, key=lambda x: x[0]):
            start = a
            while start > 0 and t[start - 1].isspace() and a - start < 3:
                start -= 1
            m = pattern.match(t, start) or (pattern.match(t, a) if start != a else None)
            if not m or m.start() < last:
                continue
            end = self._host_end(t, m)
            # A dot written as a word counts before the sign only if the host has one too.
            local = _LOCAL_WORDS if _SPELLED_DOT.search(m.group("host")) else _LOCAL
            b = local.search(t, max(0, m.start() - _LOCAL_REACH), m.start())
            if end and b:
                s = b.start(1)
                if low.startswith("mailto:", s):
                    s += 7
                out.append(Span("email", s, end))
                last = end
        return out

    @staticmethod
    def _host_end(t: str, m: re.Match) -> int:
        """End of the host; 0 if its last label is no name of letters."""
        end = m.end("host")
        while end > m.start("host"):
            label = re.search(r"[^\W_][\w-]*$", t[m.start("host") : end])
            if not label:
                return 0
            if label.group().isalpha() and len(label.group()) > 1 and label.start() > 0:
                return end
            return 0
        return 0

    @staticmethod
    def _papers(t: str, hits) -> list[Span]:
        out, last = [], -1
        for a, b in hits:
            if a < last or (a and t[a - 1].isalnum()):
                continue
            m = _PAPER_TAIL.match(t, b)
            if m:
                out.append(Span("id_number", m.start("id"), m.end("id")))
                last = m.end("id")
        return out

    @staticmethod
    def _phones(t: str, taken: list[tuple[int, int]]) -> list[Span]:
        out, i = [], 0
        runs = (m for r in _DIGITS.finditer(t) for m in _PHONE.finditer(t, r.start(), min(len(t), r.end() + 3)))
        for m in runs:
            s, e = m.span()
            if out and s < out[-1].end:
                continue
            while i < len(taken) and taken[i][1] <= s:
                i += 1
            if i < len(taken) and taken[i][0] < e:
                continue
            e = s + _whole_number(m.group())
            digits = sum(c.isdigit() for c in t[s:e])
            if not 7 <= digits <= 15 or t.count("\n", s, e) > 1 or _OTHER.search(t, max(0, s - 24), s):
                continue
            out.append(Span("phone", s, e))
        return out

    def _addresses(self, t: str, hits, blocked: list[tuple[int, int]]) -> list[Span]:
        spans: list[tuple[int, int]] = []
        for a, b in hits.get("en", ()):
            if b < len(t) and (t[b].isalnum() or t[b] in "-'’"):
                continue
            if not t[a + 1].isupper():
                continue
            m = _EN_TAIL.search(t, max(0, a - 60), a + 1)
            if not m or m.group("name").split()[0].lower() == "the":
                continue
            start = m.start("unit") if m.group("unit") else m.start("no")
            if start and t[start - 1] in "#" or (start > 1 and t[start - 1] == "." and t[start - 2].isdigit()):
                continue
            spans.append((start, b + (b < len(t) and t[b] == ".")))
        for a, b in hits.get("de", ()):
            k = _DE_KIND.match(t, a)
            if not k:
                continue
            m = _DE.search(t, max(0, a - 50), a)
            if m and (m.group("name")[-1] not in " \n"):
                spans.append((m.start("name"), k.end()))
            elif t[a].isupper():
                m = _DE_APART.search(t, max(0, a - 50), a)
                if m:
                    spans.append((m.start(), k.end()))
            elif m := _DE_ER.search(t, max(0, a - 50), a):
                spans.append((m.start(), k.end()))
        for a, _ in hits.get("es", ()):
            if a and (t[a - 1].isalnum()):
                continue
            if m := _ES.match(t, a):
                spans.append(m.span())
        out, last, i = [], -1, 0
        for s, e in sorted(set(spans), key=lambda x: (x[0], -x[1])):
            while i < len(blocked) and blocked[i][1] <= s:
                i += 1
            if s < last or (i < len(blocked) and blocked[i][0] <= s):
                continue
            stop = blocked[i][0] if i < len(blocked) else len(t)
            more = _AFTER.match(t, e)
            if more and more.end() <= stop:
                e = more.end()
            out.append(Span("address", s, e))
            last = e
        return out

    def _may_be_name(self, word: str) -> bool:
        """A word that the documents do not use as any other, and that names no body, place, role or day."""
        low = word.lower()
        return len(low) > 2 and low not in self.lexicon.common and low not in NO_NAMES and not low.rstrip("s") in NO_NAMES

    def _titled(self, m: re.Match, title: str) -> int:
        """The end of a name behind a title, 0 if there is none. A second word counts if the first can be a given name."""
        name, first = m.group("name"), m.group("first")
        last = re.split(r"\s+", name)[-1]
        if first is None:
            return m.end("name") if self._may_be_name(last) else 0
        known = first.lower() in self.lexicon.given
        # German writes nouns with capitals too, so that a word behind a family name is often none of it.
        two = known or (title not in ("herr", "herrn", "frau") and self._may_be_name(first)) or re.search(r"\s[a-z]", name)
        if two and self._may_be_name(last):
            return m.end("name")
        return m.end("first") if self._may_be_name(first) else 0

    def _pair(self, m: re.Match) -> int:
        """The end of a given and a family name that stand where names stand, 0 if a word of them cannot be one."""
        words = [w for w in re.split(r"\s+", m.group("name")) if len(w) > 2 and w[0].isupper()]
        if not words or not all(map(self._may_be_name, words)):
            return 0
        return m.end("name")

    def _names(self, t: str, hits, mails: list[tuple[int, int]]) -> list[Span]:
        spans: dict[int, int] = {}
        anchored: list[tuple[int, int]] = []
        seen = turned = -1
        for a, _ in hits.get("stem", ()):
            if a < seen or (a and (t[a - 1].isalnum() or t[a - 1] in "_@")):
                continue
            m = self._rest.match(t, a)
            if not m:
                continue
            seen = e = m.end()
            lead = self._lead.search(t, max(0, a - 16), a)
            s = lead.start()
            if s and (t[s - 1].isalnum() or t[s - 1] in "_@.+-") and s == a:
                continue
            back = max(0, s - 40)
            left = self._left.search(t, back, s)
            if left and left.start() < turned:  # that given name belongs to the family name before it
                left = None
            if left:
                spans[left.start()] = e
            elif self._title.search(t, back, s):
                spans[s] = e
            elif right := self._right.match(t, e):
                spans[s] = turned = right.end()
            else:
                continue
            anchored.append((min(s, left.start() if left else s), spans.get(left.start() if left else s, e)))
        anchored.sort()
        i = 0
        for a, b in hits.get("given", ()):
            if (a and (t[a - 1].isalnum() or t[a - 1] in "_@.+-'")) or (b < len(t) and (t[b].isalnum() or t[b] in "@_+")):
                continue
            while i < len(anchored) and anchored[i][1] <= a:
                i += 1
            if i < len(anchored) and anchored[i][0] <= a:
                continue
            if m := self._given_then.match(t, b):
                spans.setdefault(a, m.end())
            elif t[a].isupper() and (m := self._behind_given.match(t, b)) and self._may_be_name(m.group("family")):
                spans.setdefault(a, m.end())
        for a, b in hits.get("title", ()):
            if a and (t[a - 1].isalnum() or t[a - 1] in "_@.+-'"):
                continue
            if m := self._title_then.match(t, b - 1):
                spans.setdefault(re.match(rf"\.?{_S}", t[b - 1 :]).end() + b - 1, m.end())
            elif t[a].isupper() and t[a : b - 1].lower() not in WEAK_TITLES and (m := self._behind_title.match(t, b - 1)):
                found = self._titled(m, t[a : b - 1].lower())
                if found:
                    spans.setdefault(m.start("name"), found)
        # Pairs told by their place alone stand back behind names told by their parts.
        told = sorted(spans.items())
        starts = [a for a, _ in told]
        placed = []
        for kind, pattern in self._placed.items():
            for a, b in hits.get(kind, ()):
                if not (a and (t[a - 1].isalnum() or t[a - 1] in "_-@")) and b < len(t) and not t[b].isalnum() and (m := pattern.match(t, b)):
                    placed.append(m)
        placed += [m for a, _ in mails if (m := self._before_mail.search(t, max(0, a - 160), a))]
        for m in placed:
            i = bisect.bisect_left(starts, m.end("name"))
            if (not i or told[i - 1][1] <= m.start("name")) and (end := self._pair(m)):
                spans.setdefault(m.start("name"), end)
        out, last, i = [], -1, 0
        for s in sorted(spans):
            e = spans[s]
            while i < len(mails) and mails[i][1] <= s:
                i += 1
            if s < last or (i < len(mails) and mails[i][0] <= s):
                continue
            out.append(Span("name", s, e))
            last = e
        return out


def redact(text: str | None, spans: list[Span]) -> str | None:
    """``text`` with ``[EMAIL]`` and the like in place of each span; where spans overlap the first stands."""
    if text is None:
        return None
    out, at = [], 0
    for s in spans:
        if s.start < at:
            continue
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join(out) + text[at:]


#: Words kept of the documents at most, the most frequent; documents in which a word must stand in lower case.
MOST_WORDS, LEAST_DOCS = 200_000, 3
_ANY_WORD = re.compile(r"[^\W\d_]{3,}(?:['’-][^\W\d_]+)*")


def _word_counts(texts: Iterable[str | None]) -> dict[str, list[int]]:
    """Of each word in how many texts it stands in lower case, and in how many capitalised."""
    counts: dict[str, list[int]] = {}
    for t in texts:
        for w in set(_ANY_WORD.findall(t)) if t else ():
            low = w.lower()
            counts.setdefault(low, [0, 0])[w != low] += 1
    return counts


def common_words_of(texts: Iterable[str | None]) -> set[str]:
    return {w for w, (low, high) in _word_counts(texts).items() if low >= LEAST_DOCS and low >= high / 4}


def common_words(docs: DataFrame, text: str = "text") -> set[str]:
    """Words that documents use in lower case, in three or more of them and not rarely against capitals.

    Every task counts its own texts first; at most ``MOST_WORDS`` come to the driver, by frequency.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = _word_counts(b.column(0).to_pylist())
            low, high = zip(*got.values()) if got else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["word", "low", "high"])

    seen = docs.select(text).mapInArrow(count, "word string, low bigint, high bigint")
    seen = seen.groupBy("word").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    rows = seen.where((F.col("low") >= LEAST_DOCS) & (F.col("low") >= F.col("high") / 4)).orderBy(F.desc("low"), "word").limit(MOST_WORDS)
    return {r["word"] for r in rows.select("word").collect()}


def lexicon_of(staff: DataFrame, docs: DataFrame | None = None, most: int = 200_000) -> Lexicon:
    """The directory's names, and the words of ``docs``.

    The directory is a list of people, not a corpus: above ``most`` distinct names this refuses.
    """
    names = staff.select("given_name", "family_name").distinct().limit(most + 1).collect()
    if len(names) > most:
        raise ValueError(f"the directory has more than {most} names")
    return Lexicon((r[0] for r in names), (r[1] for r in names), common_words(docs) if docs is not None else ())


def mentions(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, kind, start_at, end_at``: one row for each mention, offsets in code points.

    One pass without a shuffle. Null and empty texts give no rows; repeated rows
    give repeated mentions; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(lexicon)
        for b in batches:
            rows: list[int] = []
            spans: list[Span] = []
            for i, t in enumerate(b.column(1).to_pylist()):
                got = finder.find(t)
                spans += got
                rows += [i] * len(got)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(rows, pa.int64())), pa.array([s.kind for s in spans], pa.string()),
                    pa.array([s.start for s in spans], pa.int32()), pa.array([s.end for s in spans], pa.int32()),
                ],
                names=["key", "kind", "start_at", "end_at"],
            )

    kind = dict(docs.dtypes)[key]
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        work, f"key {kind}, kind string, start_at int, end_at int"
    )
    return out.withColumnRenamed("key", key)


def redacted(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text, mentions``: each text with placeholders, and how many it holds; null stays null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(lexicon)
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [finder.find(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(list(map(redact, texts, found)), pa.string()), pa.array([len(f) for f in found], pa.int32())],
                names=["key", "text", "mentions"],
            )

    kind = dict(docs.dtypes)[key]
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(work, f"key {kind}, text string, mentions int")
    return out.withColumnRenamed("key", key)
