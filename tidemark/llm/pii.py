"""Personal information in free text: found by voting labelers and replaced by placeholders.

Patterns propose spans. Labelers of three sorts vote on each (+1, 0, -1): how the span is
written (regular expressions), what lists know of its parts (gazetteers), and what stands
around it (context). Votes of all spans of the corpus are counted by pattern; a pattern is a
handful of votes, so there are at most 3^labelers of them per kind, whatever the corpus.
Expectation-maximisation estimates from these counts how reliable each labeler is, and a
logistic span classifier is trained on the resulting beliefs. Spans it accepts are items;
of overlapping ones the longer, then the more certain one stays.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}
NAME_KIND = KINDS.index("name")
LABELERS = 6
ACCEPT = 0.5

# Given names of many countries. The lists only vote; none is needed for a name to be found.
GIVEN_NAMES = """
Ada Adam Agnes Ahmed Aisha Alan Albert Alejandro Alexander Alice Alvaro Amaru Amina Ana Anders Andrea Andres Andrew
Angela Anita Anna Anne Anneliese Anthony Antonio Arthur Astrid Aurelien Barbara Bastien Belen Benoit Bjorn Brian Camille
Carlos Carmen Carol Caroline Catherine Charles Chiara Chloe Claire Clara Colin Daniel Dariush David Deborah Dennis Diana
Diego Dmitri Dominik Donald Dorothy Dylan Edith Edward Elena Elisabeth Elizabeth Elodie Emil Emily Emma Emre Erik Eva
Fatima Felix Fernando Fiona Francesca Francisco Frank Fritz Gabriel Gaspard George Giulia Gotz Grace Graham Greta Hannah
Hans Harold Heike Helen Helene Helga Henry Hugo Ibrahim Ilze Ines Ingrid Inigo Irene Iris Isabel Jack Jacob Jakub James
Jane Janet Jean Jennifer Joan Joaquin Johann John Jonas Jose Joseph Juan Julia Jurgen Karen Karl Kathe Katrin Kenji
Kevin Kofi Lars Laura Lena Lenka Leon Linda Lisa Louis Lucas Lucia Lucy Luigi Lukas Luis Maelle Maeve Manuel Marek
Margaret Maria Marie Marisol Mark Marta Martin Mary Mateo Matias Matthew Matthias Michael Miguel Mohammed Monika Nadia
Nancy Natalia Ngozi Nicole Nikolai Nina Noemie Olga Oliver Oksana Omar Oscar Otto Owen Pablo Patricia Paul Pavel Pedro
Peter Philip Pierre Piotr Priya Rachel Rafael Raj Rebecca Richard Robert Rocio Rosa Ruth Sabine Samuel Sandra Sarah
Sergei Simon Sofia Solene Sonia Stefan Stephen Steven Susan Tessa Thandi Theresa Thierry Thomas Tilman Tomas
Ulrike Ursula Vera Victor Viktor Walter Wei William Wolfgang Yuki Yusuf Zoe Zsofia
""".split()
# Endings of family names.
FAMILY_ENDINGS = """
son sen mann berg stein feld field dale wick wright smith ford worth ley ski sky ska cki ov ova ev eva enko ienko chuk ez
az etti elli ini ucci eau ault ard ois rick by gard gaard sted stad shvili dze yan ian oglu wyn wood man ton ham ström strom
lund gren qvist
""".split()
# Words that announce a person's name: titles, roles, and verbs.
NAME_BEFORE = """
mr mrs ms miss dr prof professor sir frau herr herrn mme mlle madame mademoiselle monsieur sr sra srta señor señora señorita don doña
reach attention attn applicant signed author dear by contactez appelez selon según laut ansprechpartner ansprechpartnerin sprechen
""".split()
# The same in two words, the last one first.
NAME_BEFORE_TWO = {("for", "ask"), ("to", "according"), ("to", "thanks"), ("to", "attention"), ("to", "speak"), ("a", "pertenece"), ("a", "llame"), ("mit", "sprechen"), ("von", "unterschrieben")}
# Words after a person's name.
NAME_AFTER = """
told moved signed at or wohnt war ist a had was said el le la au al telefon has for and liegt wrote lives took perdu last in hat
""".split()
# Verbs that have a person for their subject, mostly.
PERSON_DOES = """
told said says asked answered replied wrote writes read knew knows thought thinks felt believes believed went goes came comes left arrived moved lives lived
signed took takes gave gives got made makes met saw sees heard called calls rang phoned emailed sent sends paid bought sold lost found wants wanted
needs needed works worked plays played won joined retired died married agreed refused claimed claims admitted denied explained noted added smiled laughed nodded
spoke speaks taught teaches studied wohnt sagte schrieb perdu habite vive dijo
""".split()
# What closes a letter, before the name below it.
CLOSING = "regards wishes sincerely faithfully truly yours thanks grüße grüßen gruß cordialement saludos atentamente".split()
# Roles that stand before a person's name, with a colon or a comma between.
ROLE = """
name patient applicant author contact tenant client customer witness manager director driver winner owner neighbour neighbor colleague teacher editor
president chairman chairwoman secretary coach sister brother mother father wife husband son daughter friend student guest speaker attention
""".split()
# Capitalised words that are no part of a person's name.
NO_NAME = """
Street St Road Rd Avenue Ave Lane Close Terrace Blvd Boulevard Court Hall Market Harbour Harbor Foods Ensemble Works Bridge Ridge
Port Apt Flat Unit Suite The This That Order Batch Part Ref Version Step Page Tracking Code Meter Call Last From What Then Only Yesterday Today Tomorrow And But So When While Because After Before Since If As For With At On To By Of Now Here There Each Every Some All Her His Their Its Prices
Don It In Reader See Don't It's Follow Nobody However How Your We We'd People Our Please Lost Passport SSN Invoice Posted Dial Mix
Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec Monday Tuesday Wednesday Thursday Friday Saturday Sunday Company Ltd Inc GmbH
Coordinates Opening Dr Mr Mrs Ms Frau Herr Mme Der Die Das Ein Eine Im Am Wer Bitte Le La Les Un Une El Los Las Quien Selon Según Laut
Contactez Back Home News Search About Contact Help Archive Careers Shop Sitemap FAQ Log Grand Old New North South East West
Applicant Thanks According You My Ring Tenant Adresse Dirección Anschrift Écrire Correo Rufen Telefon Depuis Ouverture Abre Espere Attendez Llame Ausweis Nr
""".split()
# Words that introduce a number of each sort.
PHONE_BEFORE = "tel phone call ring telefon number mobile fax ☎ téléphone teléfono handy rufen sie au al is or text whatsapp".split()
ID_BEFORE = "ssn passport passeport id dni nif nie ausweis kept insurance social tax steuer identity national license licence pasaporte".split()
NO_PERSON = "order batch part ref reference tracking code isbn version coordinates serial invoice model table item sku parcel shipment receipt ticket".split()
ADDRESS_BEFORE = "to at in address adresse anschrift dirección direccion tenant knock lives forms moved wohnt der die visit / residence domicilio".split()
# Endings of place names.
PLACE_ENDINGS = """
wick ham mont ville stadt brück brueck burg bourne haven water ora ton town ford bury field hausen heim dorf berg feld bridge
mouth port land by dale chester cester pool stead worth hurst minster city stad vik grad pur abad
""".split()

_GIVEN = {g.upper() for g in GIVEN_NAMES}
_FAMILY_END = tuple(e.upper() for e in FAMILY_ENDINGS)
_PLACE_END = tuple(e.upper() for e in PLACE_ENDINGS)
_BEFORE_NAME, _AFTER_NAME, _PERSON_DOES = set(NAME_BEFORE), set(NAME_AFTER), set(PERSON_DOES)
_CLOSING, _ROLE = set(CLOSING), set(ROLE)
_BEFORE_PHONE, _BEFORE_ID, _NO_PERSON, _BEFORE_ADDRESS = set(PHONE_BEFORE), set(ID_BEFORE), set(NO_PERSON), set(ADDRESS_BEFORE)

# One step between two parts of an item: a blank, or the break of a line.
_GAP = r"(?:[  ]|\r?\n)"
# Characters of a word, also of a garbled one: letters, apostrophe, and what wrong decoding leaves.
# The cases exclude each other: where two take the same character, a failed match would try all combinations.
_ODD = r"['’­�\u0080-¿‘-›ˆ˜ƒ€™Š‹ŒŽ]"
_IN = rf"[^\W\d_]|{_ODD}|(?<=[ÃÅ])(?!{_ODD})[^\s\w]|\?(?=[a-zà-ÿ])"
_UPPER = r"[A-ZÀ-ÖØ-ÞĀŁŚŻŽŠČ]|�{1,2}(?=[A-Za-z])|\?(?=[a-z])"
#: A word of an item is no longer, and no part of it is given back, so that text without any blank costs no
#: more than its length.
LONGEST = 40
_CAP = rf"(?:{_UPPER})(?:{_IN}){{1,{LONGEST}}}+"

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}[A-Za-z0-9])?"
_DOT = r"(?:\.|\s?[\[(]dot[\])]\s?|\s(?:DOT|dot)\s)"
_AT = r"(?:\s?@\s?|\s?＠\s?|\s?[\[({]at[\])}]\s?|\s(?:AT|at)\s(?=[A-Za-z0-9-]+\s(?:DOT|dot)\s)|ï¼ ?|�{1,3}|\?)"
EMAIL = re.compile(rf"(?<![\w.+@-])[A-Za-z0-9_](?:[\w.+-]{{0,63}}\w)?{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}(?![\w@])")

_S = r"[ .\-/ ]"
_SN = r"(?:[ .\-/ ]|\r?\n)"
PHONE = re.compile(
    r"(?<![\w+])(?<![\d][.,:\-/])(?:"
    rf"(?:\+|00)\d{{1,3}}{_SN}?(?:\(0\){_SN}?)?(?:\(\d{{1,5}}\){_SN}?)?\d(?:{_SN}?\d){{5,12}}"
    rf"|(?:1{_SN})?(?:\(\d{{3}}\){_SN}?|\d{{3}}{_SN})\d{{3}}{_SN}\d{{4}}"
    rf"|\(0\d{{1,4}}\){_SN}?\d{{2,8}}(?:{_SN}\d{{2,8}}){{0,3}}"
    rf"|0\d{{1,4}}{_SN}\d{{2,8}}(?:{_SN}\d{{2,8}}){{0,4}}"
    r"|0\d{9,10}"
    r")(?![\w])(?![.,:\-/]\d)"
)
ID = re.compile(
    r"(?<![\w])(?<![\d][.,\-/])(?:"
    r"\d{3}[- ]\d{2}[- ]\d{4}|\d{2} \d{3} \d{3} \d{3}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{8}-?[A-Z]|[A-Z]-?\d{7}-?[A-Z]|[A-Z]{1,2}\d{7,9}|\d{9,12}"
    r")(?!\w)(?![.,\-/]\d)"
)

_COMMA = r"(?:, ?|,?\r?\n|,?[  ])"
_TOWN = rf"(?:{_IN}){{1,{LONGEST}}}+(?:-(?:{_IN}){{1,{LONGEST}}}+){{0,4}}"
_EN_KIND = r"(?:street|st\b\.?|road|rd\b\.?|avenue|ave\b\.?|lane|ln\b\.?|close|terrace|blvd\b\.?|boulevard|drive|dr\b\.?|court|ct\b\.?|place|pl\b\.?|way|square|sq\b\.?|crescent|gardens|grove)"
_EN_CODE = r"(?:[A-Z]{2} \d{5}(?:-\d{4})?|[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2})"
ADDRESS_EN = re.compile(
    rf"(?<![\w-])(?:(?i:flat|apt|apartment|unit|suite)\.? \d+\w?{_COMMA})?\d{{1,5}}[a-zA-Z]?{_GAP}(?:(?:{_IN}){{1,{LONGEST}}}+{_GAP}){{1,3}}?(?i:{_EN_KIND})(?!\w)"
    rf"(?:,?{_GAP}?#\s?\d+\w?|,?{_GAP}(?i:apt|apartment|unit|flat|suite)\.?{_GAP}\d+\w?)?"
    rf"(?P<town>(?:,{_GAP}?|\r?\n)(?!\s){_TOWN})?(?P<code>{_COMMA}{_EN_CODE}(?!\w))?"
)
_ZIP_TOWN = rf"(?P<code>{_COMMA}\d{{4,5}}{_GAP}{_TOWN})?"
# A German street is found by its end, and read back from there to the begin of its word.
_DE_BEGIN = re.compile(rf"(?<!\w)(?:{_UPPER})(?:{_IN}){{0,{LONGEST}}}+\Z")
ADDRESS_DE = re.compile(
    rf"(?i:stra(?:ß|ss|Ã.|�{{1,2}}|\?)e|str\.|weg|platz|gasse|allee|ring|damm|ufer)"
    rf"{_GAP}\d{{1,4}}(?:{_GAP}?[a-z](?!\w))?(?!\d){_ZIP_TOWN}"
)
_FR_WORD = rf"(?:[^\s,\d]{{1,{LONGEST}}})"
ADDRESS_FR = re.compile(
    rf"(?<![\w-])\d{{1,4}}(?:{_GAP}?(?:bis|ter|quater))?,?{_GAP}(?i:rue|bd|boulevard|avenue|av\.|place|quai|chemin|impasse|allée|route|cours){_GAP}"
    rf"{_FR_WORD}(?:{_GAP}{_FR_WORD}){{0,4}}?(?:(?P<code>{_COMMA}\d{{5}}{_GAP}{_TOWN})|(?=[,.\n]|$))"
)
ADDRESS_ES = re.compile(
    rf"(?<!\w)(?:Calle|C/|Avda\.|Avenida|Av\.|Plaza|Pza\.|Paseo|Camino|Ronda){_GAP}{_FR_WORD}(?:{_GAP}{_FR_WORD}){{0,4}}?,?{_GAP}(?:n\.?º{_GAP})?\d{{1,4}}(?!\d)"
    rf"(?P<code>{_COMMA}\d{{5}}{_GAP}{_TOWN})?"
)
ADDRESS_IT = re.compile(
    rf"(?<!\w)(?:Via|Viale|Piazza|Corso|Largo|Vicolo){_GAP}{_FR_WORD}(?:{_GAP}{_FR_WORD}){{0,3}}?,?{_GAP}\d{{1,4}}[a-z]?(?![\w])(?P<code>{_COMMA}\d{{5}}{_GAP}{_TOWN})?"
)
ADDRESS_PL = re.compile(
    rf"(?<!\w)(?:ul\.|al\.|pl\.|os\.){_GAP}{_FR_WORD}(?:{_GAP}{_FR_WORD}){{0,2}}?{_GAP}\d{{1,4}}[a-z]?(?:/\d{{1,4}})?(?!\w)(?P<code>{_COMMA}\d\d-\d{{3}}{_GAP}{_TOWN})?"
)
# Patterns that begin with one of a few words, of which a text has to hold one to be searched.
ADDRESSES = {
    ADDRESS_EN: None,
    ADDRESS_FR: None,
    ADDRESS_ES: ("Calle", "C/", "Avda.", "Avenida", "Av.", "Plaza", "Pza.", "Paseo", "Camino", "Ronda"),
    ADDRESS_IT: ("Via", "Piazza", "Corso", "Largo", "Vicolo"),
    ADDRESS_PL: ("ul.", "al.", "pl.", "os."),
}
# What stands before the number of a German street: its last letter, or the point of "str."
_NUMBER_AFTER = re.compile(rf"(?<=[eEgGzZmMrR.]){_GAP}\d")


def _german(text: str) -> Iterator[re.Match]:
    """Ends of German streets, looked for at the numbers behind them."""
    done = 0
    for n in _NUMBER_AFTER.finditer(text):
        for a in range(max(done, n.start() - 8), n.start() - 2):
            if m := ADDRESS_DE.match(text, a):
                done = m.end()
                yield m
                break

_INITIAL = r"[A-ZÀ-ÖØ-Þ]\."
_MIDDLE = rf"(?:{_GAP}{_INITIAL}){{0,2}}"
_PARTICLE = rf"(?:{_GAP}(?:van der|van den|van|von|de la|de|del|der|di|da|le|la|el|al|bin|ter|VAN|VON|DE))?"
_FAMILY = rf"{_CAP}(?:-{_CAP})*"
_GIVEN_WORD = rf"{_CAP}(?:-{_CAP})?"
NAME = re.compile(rf"(?<![\w@.\-])(?P<g>{_INITIAL}|{_GIVEN_WORD})(?P<m>{_MIDDLE}){_PARTICLE}{_GAP}(?P<f>{_FAMILY})(?![\w@])")
NAME_REVERSED = re.compile(rf"(?<![\w@.\-])(?P<f>(?:(?:van|von|de|VAN) )?{_FAMILY}),{_GAP}(?P<g>{_GIVEN_WORD}|{_INITIAL})(?P<m>{_MIDDLE})(?![\w@])")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|☎|/")
_PLAIN = str.maketrans("ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕØÚÙÛÜÇÑÝŁŚŻŽŠČ", "AAAAAAEEEEIIIIOOOOOOUUUUCNYLSZZSC")


@lru_cache(1 << 16)
def plain(word: str) -> str:
    """A word in upper case without accents; a garbled one is decoded again if it can be."""
    if "Ã" in word or "Å" in word:
        for charset in ("cp1252", "latin-1"):
            try:
                word = word.encode(charset).decode("utf-8")
                break
            except UnicodeError:
                continue
    return word.upper().translate(_PLAIN)


_NO_NAME = {plain(w) for w in NO_NAME}
# An article or pronoun run into the next word, as in "L'autre" or "It's".
_ELIDED = re.compile(r"\w{1,3}['’][a-zà-ÿ]")


@lru_cache(1 << 16)
def _known_given(word: str) -> bool:
    w = plain(word)
    if w in _GIVEN:
        return True
    if "-" in w:
        return all(p in _GIVEN for p in w.split("-"))
    if ("�" in w or "?" in w) and sum(c.isalpha() for c in w) >= 3:
        form = re.compile(re.sub(r"[�?]+", ".{1,2}", re.escape(w).replace("\\?", "?")) + r"\Z")
        return any(form.match(g) for g in _GIVEN)
    return False


def _words_before(text: str, at: int, n: int = 3, reach: int = 40) -> list[str]:
    """The last words before a span in the same sentence, nearest first, lower case."""
    near = text[max(0, at - reach) : at]
    return [w.lower() for w in _WORD.findall(near)][: -n - 1 : -1]


def _words_after(text: str, at: int, n: int = 2, reach: int = 30) -> list[str]:
    return [w.lower() for w in _WORD.findall(text[at : at + reach])[:n]]


def _vote(yes: bool, no: bool = False) -> int:
    return 1 if yes else -1 if no else 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def label_email(text: str, a: int, b: int) -> tuple[int, ...]:
    s = text[a:b]
    bare = "@" in s and " " not in s
    words = re.search(r"[\[({]at[\])}]|＠|ï¼|\sAT\s|\sat\s", s) is not None
    last = re.split(r"[^A-Za-z]+", s)[-1]
    odd = "?" in s or "�" in s
    tld = 2 <= len(last) <= 12 and (last.islower() or last.isupper())
    return (
        _vote(bare or words, odd and not bare),
        _vote(tld, not tld),
        _vote("@" in s or words),
        _vote(any(w in ("mail", "e-mail", "write", "correo", "courriel", "écrire", "at", "escriba", "by", "✉") for w in _words_before(text, a))),
        _vote(not odd, odd and not re.search(r"[._+-]|\d", s.split("?")[0].split("�")[0]) and "." not in s[-9:]),
        0,
    )


def _labelled(before: list[str], words: set[str]) -> bool:
    """Whether one of the words stands right before a number, or before its "no."."""
    return bool(before) and (before[0] in words or (before[0] in ("no", "nr", "number", "nummer", "numéro", "número") and len(before) > 1 and before[1] in words))


_PLAN = re.compile(
    r"\+\d.*|00[1-9]\d.*|(?:1\D)?\(?[2-9]\d\d\)?\D{1,2}\d{3}\D\d{4}|\(?0[1-9]\d{1,3}\)?\D{1,2}\d{4}\D?\d{4}|\(?0\d{4}\)?\D?\d{6}|\(?0\d{2,3}\)?\D{1,2}\d{5}\D?\d{3}|0[1-9](?:\D?\d\d){4}|0\d{10}",
    re.S,
)


def label_phone(text: str, a: int, b: int) -> tuple[int, ...]:
    s, before = text[a:b], _words_before(text, a)
    n = len(_digits(s))
    near = before[:1]
    bad = bool(near) and near[0] in _NO_PERSON
    return (
        _vote(n >= 9 and bool(_PLAN.fullmatch(s)), n < 9 or not _PLAN.fullmatch(s)),
        _vote(9 <= n <= 14, n < 9 or n > 15),
        _vote(any(w in _BEFORE_PHONE for w in before[:2]) and not bad, bad),
        _vote(s[0] in "+(" or bool(re.match("00[1-9]", s)), n < 9),
        _vote(bool(re.search(r"(?:[|·✉☎(:]\s?|â˜Ž\s?)\Z", text[max(0, a - 4) : a]))),
        _vote(False, _labelled(before, _NO_PERSON)),
    )


def label_id(text: str, a: int, b: int) -> tuple[int, ...]:
    s, before = text[a:b], _words_before(text, a)
    near = before[:2]
    good = any(w in _BEFORE_ID for w in near)
    bad = not good and any(w in _NO_PERSON for w in near)
    digits_only = s.isdigit()
    return (
        _vote(bool(re.fullmatch(r"\d{3}[- ]\d\d[- ]\d{4}|\d\d \d{3} \d{3} \d{3}|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|\d{8}-?[A-Z]|[A-Z]\d{8}|[A-Z]-?\d{7}-?[A-Z]", s)), digits_only),
        _vote(good, bad),
        _vote(any(w in _BEFORE_ID or w == "nr" or w == "no" and "id" in before for w in before) and not bad, bad),
        _vote(any(c.isalpha() for c in s) or s.count(" ") + s.count("-") >= 2, digits_only),
        _vote(False, bool(before) and before[0] in ("tel", "call", "ring", "telefon", "phone")),
        _vote(False, _labelled(before, _NO_PERSON)),
    )


def label_address(text: str, a: int, b: int, m: re.Match) -> tuple[int, ...]:
    before = _words_before(text, a)
    code = m.groupdict().get("code")
    town = m.groupdict().get("town")
    place = town is not None and plain(town).rstrip(".").endswith(_PLACE_END)
    return (
        _vote(bool(code)),
        _vote(bool(before) and any(w in _BEFORE_ADDRESS for w in before[:2])),
        _vote(place or bool(code), town is None and not code),
        _vote(m.re is not ADDRESS_EN or bool(re.search(r"#|(?i:flat|apt|unit)", m.group(0)))),
        _vote(False, bool(before) and before[0] in _NO_PERSON),
        _vote(False, any(w in ("works", "market", "foods") for w in _words_after(text, b, 1))),
    )


# Of a number such as "QQ 12 34 56 C." the letter is the last part and no initial.
_ID_BEFORE = re.compile(r"(?<!\w)[A-Z]{2} ?\d\d ?\d\d ?\d\d \Z")
# A capitalised word right before or after a pair: the pair is then part of a longer phrase.
_CAP_BEFORE = re.compile(rf"(?<!\w)({_CAP})[  ]\Z")
_CAP_AFTER = re.compile(rf"[  ](?:{_UPPER})(?:{_IN})")
# As a word of a menu "Contact" announces nobody, at the head of a sentence it does.
_CONTACT = re.compile(r"(?<!\w)(?:contact |(?:Contact|Name): ?)\Z")
_CONTACT_HEAD, _GOES_ON = re.compile(r"(?:\A|[.!?]\s|\n)Contact \Z"), re.compile(r" (?:for|at|to|if|about|by|on|or|before|and|directly|via)\b")
# A role or a closing before a name: "Patient: ", "Our driver, ", "Kind regards, " also above it.
_INTRO = re.compile(r"([^\W\d_]+)(?::[  ]?|,[  ]|,?\r?\n{1,2})\Z")
_SMALL = re.compile(r"(?<!\w)(?:for|by|to|with|from|of|and|that|if|when|where|names|named|is|was|met|saw|asked|told|thank|thanked|invited|called|see|only|then) \Z", re.I)
# A number or e-mail address beside the name, with a sign between.
_NEXT_ITEM, _ITEM_BEFORE = re.compile(r" ?[—–/|·(,-] ?(?:[+(]?\d|[\w.+-]{1,64}@)"), re.compile(r"\d\)? ?[(/|—–·] ?\Z")
_LOWER_BEFORE = re.compile(r"(?<!\w)[a-zà-ÿ]+[  ]\Z")
_AFTER_SIGN = re.compile(r" ?[/—(|)]| â(?:€”|\x80\x94)|,? \(")


def label_name(text: str, a: int, b: int, given: str, middle: str, family: str) -> tuple[int, ...]:
    g, f = plain(given.rstrip(".")), plain(family)
    initial = len(g) == 1
    known = not initial and _known_given(given)
    parts = [p for p in re.split(r"[-\s]", f) if p]
    ending = all(p.endswith(_FAMILY_END) and len(p) >= 5 for p in parts)
    before, after = _words_before(text, a, 2, 24), _words_after(text, b, 1)
    head, tail = text[max(0, a - 24) : a], text[b : b + 4]
    intro = _INTRO.search(head)
    told = intro is not None and (intro.group(1).lower() in _ROLE and "\n" not in intro.group(0) or intro.group(1).lower() in _CLOSING)
    told |= bool(_CONTACT.search(head)) or bool(_CONTACT_HEAD.search(head) and _GOES_ON.match(text, b))
    introduced = told or bool(before) and (before[0] in _BEFORE_NAME or tuple(before) in NAME_BEFORE_TWO)
    no_given = g in _NO_NAME or bool(_ELIDED.match(given))
    # Hall, Lane or West after "Mrs" is a family name
    no_family = (any(p in _NO_NAME for p in parts) and not introduced) or bool(_ELIDED.match(family))
    within = _CAP_BEFORE.search(head)
    loose = initial and not introduced and bool(re.search(r"\w\s\Z", head))
    does = bool(after) and after[0] in _PERSON_DOES and "\n" not in text[a:b]
    # "Le" on the line below begins a sentence of its own
    followed = does or (bool(after) and after[0] in _AFTER_NAME and "\n" not in text[b : b + 2])
    odd = not known and ("\n" in text[a:b] or (given.isupper() != family.isupper() and not initial))
    beside = bool(_NEXT_ITEM.match(text, b) or _ITEM_BEFORE.search(head))
    person = introduced or does or beside or (not odd and bool(_LOWER_BEFORE.search(head) or _SMALL.search(head)))
    return (
        _vote(known, no_given or not initial and ("�" in given or "?" in given)),
        _vote(ending and not no_family, no_family),
        _vote(introduced, within is not None and plain(within.group(1)) not in _NO_NAME),
        _vote(followed or bool(_AFTER_SIGN.match(tail)), bool(_CAP_AFTER.match(tail))),
        _vote(bool(middle) and not initial and not no_given, loose),
        _vote(person, odd),
    )


def _name_spans(text: str) -> Iterator[tuple[int, int, tuple[int, ...]]]:
    """Every pair of capitalised words, or initial and word, in either order; the votes decide."""
    at = 0
    # "Contactez Ada Berg": the first word may belong to the sentence, so each word begins a pair
    while m := NAME.search(text, at):
        a, b = m.span()
        if not _ID_BEFORE.search(text[max(0, a - 12) : a]) or len(m.group("g")) > 2:
            yield a, b, label_name(text, a, b, m.group("g"), m.group("m"), m.group("f"))
        at = m.end("g")
    for m in NAME_REVERSED.finditer(text):
        a, b = m.span()
        yield a, b, label_name(text, a, b, m.group("g"), m.group("m"), m.group("f").split(" ")[-1])


def _town_end(text: str, m: re.Match) -> int:
    """Where an English address ends: a town without postcode counts if it follows a comma or is named like one."""
    if m.group("code") or not m.group("town"):
        return m.end()
    town = m.group("town").lstrip(", \r\n ")
    named = plain(town).endswith(_PLACE_END)
    comma = m.group("town").startswith(",")
    stop = plain(town) in _NO_NAME or town.lower() in ("last", "kept", "attention", "and", "or")
    return m.end() if named or (comma and not stop and "\n" not in m.group("town")) else m.start("town")


def candidates(text: str) -> list[tuple[int, int, int, tuple[int, ...]]]:
    """(start, end, kind, votes) of all proposed spans."""
    out = []
    for m in EMAIL.finditer(text):
        out.append((*m.span(), 0, label_email(text, *m.span())))
    for m in PHONE.finditer(text):
        out.append((*m.span(), 1, label_phone(text, *m.span())))
    for m in ID.finditer(text):
        out.append((*m.span(), 2, label_id(text, *m.span())))
    addresses: list[re.Match] = []
    for p, begins in ADDRESSES.items():
        if begins is None or any(w in text for w in begins):
            addresses += p.finditer(text)
    for m in (*addresses, *_german(text)):
        a, b = m.span()
        if m.re is ADDRESS_EN:
            b = _town_end(text, m)
        if m.re is ADDRESS_DE:
            begin = _DE_BEGIN.search(text, max(0, a - LONGEST - 2), a)
            if not begin:
                continue
            a = begin.start()
        while b > a and text[b - 1] in "?�,;":
            b -= 1
        out.append((a, b, 3, label_address(text, a, b, m)))
    out.extend((a, b, 4, v) for a, b, v in _name_spans(text))
    return out


@dataclass(frozen=True)
class SpanClassifier:
    """Probability that a span with these votes is an item, by kind and votes."""

    table: dict[tuple[int, tuple[int, ...]], float]
    weights: tuple[np.ndarray, ...]

    def __call__(self, kind: int, votes: tuple[int, ...]) -> float:
        known = self.table.get((kind, votes))
        return known if known is not None else float(_probability(_features(np.array([votes])), self.weights[kind])[0])


def _features(votes: np.ndarray) -> np.ndarray:
    """One indicator per labeler and vote, and a constant."""
    return np.hstack([np.ones((len(votes), 1)), votes == 1, votes == -1]).astype(float)


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


#: What is expected of a labeler before any data: P(vote | item), P(vote | no item) for -1, 0, +1.
PRIOR = np.array([[0.02, 0.28, 0.70], [0.45, 0.40, 0.15]])
#: The same for a list of names, which holds few of all there are: it says nothing of most names.
PRIOR_LIST = np.array([[0.02, 0.78, 0.20], [0.45, 0.40, 0.15]])
LISTS = {NAME_KIND: (0, 1)}
PRIOR_SHARE = 0.1


def fit_kind(votes: np.ndarray, counts: np.ndarray, rounds: int = 60, lists: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(belief per vote pattern, classifier weights) by EM over counted patterns, then regression.

    lists are the labelers that look a span up in lists of names.
    """
    n, belief = counts.sum(), 1 / (1 + np.exp(-1.5 * (votes.sum(axis=1) - 1)))
    shares = [(PRIOR_LIST if j in lists else PRIOR) * PRIOR_SHARE * n + 1e-3 for j in range(votes.shape[1])]
    for _ in range(rounds):
        mass = np.stack([belief * counts, (1 - belief) * counts])
        rate = np.clip((mass.sum(axis=1) + 1) / (n + 2), 0.02, 0.98)
        log = np.log(rate)[:, None] * np.ones(len(votes))
        for j in range(votes.shape[1]):
            got = np.stack([[m[votes[:, j] == v].sum() for v in (-1, 0, 1)] for m in mass]) + shares[j]
            theta = got / got.sum(axis=1, keepdims=True)
            log += np.log(theta)[:, votes[:, j] + 1]
        belief = 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))
    x = _features(votes)
    w, share = np.zeros(x.shape[1]), counts / max(n, 1)
    for _ in range(200):  # Newton steps with a small ridge
        p = _probability(x, w)
        gradient = x.T @ (share * (p - belief)) + 1e-4 * w
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return belief, w


def fit(patterns: list[tuple[int, tuple[int, ...], int]]) -> SpanClassifier:
    """The classifier of counted patterns (kind, votes, count)."""
    table, weights = {}, []
    for kind in range(len(KINDS)):
        own = sorted((v, n) for k, v, n in patterns if k == kind)
        votes = np.array([v for v, _ in own], int).reshape(-1, LABELERS)
        belief, w = fit_kind(votes, np.array([n for _, n in own], float), lists=LISTS.get(kind, ())) if own else (np.zeros(0), np.zeros(1 + 2 * LABELERS))
        weights.append(w)
        table |= {(kind, v): float(p) for (v, _), p in zip(own, _probability(_features(votes), w) if own else belief, strict=True)}
    return SpanClassifier(table, tuple(weights))


def _apart(spans: list[tuple[int, int, int, float]], order) -> list[tuple[int, int, int, float]]:
    """Spans without overlaps: each is kept, in the order given, if it crosses none that is kept. Kept
    ones are looked up by their begin, so the cost is that of sorting."""
    begins: list[int] = []
    ends: list[int] = []
    kept = []
    for s in sorted(spans, key=order):
        i = bisect_left(begins, s[1])
        if i == 0 or ends[i - 1] <= s[0]:
            begins.insert(i, s[0])
            ends.insert(i, s[1])
            kept.append(s)
    return kept


def choose(spans: list[tuple[int, int, int, tuple[int, ...]]], model: SpanClassifier) -> list[tuple[int, int, int]]:
    """Accepted spans without overlaps in order: an item inside another is none, and of two that
    cross the longer one stays. Names that share a word are told apart first, by certainty."""
    good = [(a, b, k, p) for a, b, k, v in spans if (p := model(k, v)) > ACCEPT]
    names = _apart([s for s in good if s[2] == NAME_KIND], lambda s: (-s[3], -(s[1] - s[0]), s[0]))
    others = [s for s in good if s[2] != NAME_KIND]
    kept = _apart(others + names, lambda s: (-(s[1] - s[0]), -s[3], s[0], s[2]))
    return sorted((a, b, k) for a, b, k, _ in kept)


def encode_votes(votes: tuple[int, ...]) -> int:
    code = 0
    for v in votes:
        code = code * 3 + v + 1
    return code


def decode_votes(code: int) -> tuple[int, ...]:
    out = []
    for _ in range(LABELERS):
        out.append(code % 3 - 1)
        code //= 3
    return tuple(reversed(out))


_SPANS = "array<struct<a:int,b:int,kind:int,votes:int,item:string>>"
_SPAN_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("kind", pa.int32()), ("votes", pa.int32()), ("item", pa.string())]))


def propose(df: DataFrame, doc_id: str, text: str, with_text: bool = False) -> DataFrame:
    """(doc_id, spans): the candidates of each text that has any; with_text (doc_id, spans, text) of every row. Narrow; whole texts."""
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, spans = [], []
            texts = pc.cast(batch.column(1), pa.string())
            for i, t in enumerate(texts.to_pylist()):
                found = candidates(t) if t else []
                if found or with_text:
                    at.append(i)
                    spans.append([{"a": a, "b": b, "kind": k, "votes": encode_votes(v), "item": t[a:b]} for a, b, k, v in found])
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(spans, _SPAN_TYPE)]
            yield pa.record_batch([*columns, texts] if with_text else columns, names=["doc_id", "spans", "text"][: 2 + with_text])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, spans {_SPANS}" + (", text string" if with_text else ""))


def train(proposed: DataFrame) -> SpanClassifier:
    """The classifier fitted to the votes on all spans of the corpus.

    The counts that come to the driver have at most 3^LABELERS rows per kind.
    """
    s = proposed.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").count()
    return fit([(r["kind"], decode_votes(r["votes"]), r["count"]) for r in s.collect()])


def find(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, kind, found_text): the distinct items of each row's text, exactly as they stand in it.

    Null, empty and blank texts have none. Rows with equal ids are searched each for itself.
    """
    proposed = stage(propose(df, doc_id, text), "pii")
    model = train(proposed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, items = [], [], []
            for i, spans in enumerate(batch.column(1).to_pylist()):
                item = {(s["a"], s["b"]): s["item"] for s in spans}
                chosen = choose([(s["a"], s["b"], s["kind"], decode_votes(s["votes"])) for s in spans], model)
                for kind, found in dict.fromkeys((k, item[a, b]) for a, b, k in chosen):
                    at.append(i)
                    kinds.append(KINDS[kind])
                    items.append(found)
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(items, pa.string())], names=["doc_id", "kind", "found_text"])

    out = proposed.mapInArrow(run, f"doc_id {dict(proposed.dtypes)['doc_id']}, kind string, found_text string")
    return out.withColumnRenamed("doc_id", doc_id)


def _replaced(text: str, chosen: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, b, k in chosen:
        out += [text[at:a], PLACEHOLDER[KINDS[k]]]
        at = b
    return "".join([*out, text[at:]])


def redact_text(text: str, model: SpanClassifier) -> str:
    return _replaced(text, choose(candidates(text), model))


def redact(df: DataFrame, doc_id: str, text: str, model: SpanClassifier | None = None) -> DataFrame:
    """(doc_id, text) with every item replaced by the placeholder of its kind; null stays null.

    Candidates are proposed once, and staged with the texts where the classifier is yet to be trained.
    """
    rows = propose(df, doc_id, text, with_text=True)
    if model is None:
        rows = stage(rows, "pii-texts")
        model = train(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                _replaced(t, choose([(s["a"], s["b"], s["kind"], decode_votes(s["votes"])) for s in spans], model)) if spans else t
                for spans, t in zip(batch.column(1).to_pylist(), pc.cast(batch.column(2), pa.string()).to_pylist(), strict=True)
            ]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    out = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
    return out.toDF(doc_id, text)
