"""Personal information in free text: found, and replaced by typed placeholders or surrogates.

E-mail addresses, telephone numbers, identity numbers, postal addresses and names are found by
grammars of how they are written (also disguised, spelled out or in other case), by a list of given
names, by titles, and by the phrases in which statements introduce a person. A surname once found
is found again in the same text.

Replacements are keyed. Surrogates are permutations: all words of one form (script, length, vowels and consonants,
digits, case) are permuted by a keyed Feistel network, listed given names within their gender. So one entity gets the same
surrogate in every text (coreference), two entities never the same one in the whole corpus, nothing stays as it was, and
without the key nobody gets back. Within a text this is checked once more. Placeholders carry the kind and 64 keyed bits.

Each text is handled where it is read; nothing is shuffled but the found rows.

Defined cases: null and empty texts have none; each distinct text of a kind in a field value is one row; of overlapping
findings the earlier kind of email, id_number, phone, address, name wins; unreadable JSON gives no texts; repeated deliveries give one row.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Given names, by gender.
FEMALE = (
    "Adele Aisha Alice Amara Amelia Amina Ana Andrea Angela Anna Anne Annika Antonia Beatriz Bianca Birgit Camille Carla Carmen Caroline Catherine Charlotte Chloe Claire Clara Claudia Daniela Deborah Diana Elena Elif "
    "Elisabeth Elizabeth Ella Emily Emma Erika Esther Eva Fatima Fiona Francesca Freya Gabriela Giulia Grace Greta Hana Hanna Hannah Heather Heidi Helen Helena Ines Ingrid Irene Isabel Jane Jasmine Jennifer Jessica Johanna "
    "Judith Julia Karen Katarina Katherine Kirsten Laila Lara Laura Lea Leila Lena Linda Lisa Louise Lucia Lucy Magdalena Margaret Maria Marie Marta Martha Mary Maya Megan Michelle Mia Monica Nadia Naomi Natalia Nicole Nina "
    "Nora Olga Olivia Patricia Paula Petra Priya Rachel Rebecca Renata Rosa Ruth Sabine Samira Sandra Sara Sarah Silvia Simone Sofia Sophie Stefanie Susan Svetlana Tamara Tara Teresa Theresa Ursula Valentina Vera Veronica Victoria Yasmin Zara Zoe")
MALE = (
    "Adam Adrian Ahmed Alan Alejandro Alexander Ali Andreas Andrew Anthony Antonio Arjun Arthur Benjamin Bernd Boris Brian Bruno Carlos Charles Christian Christopher Colin Daniel David Diego Dmitri Edward Edwin Emil Enrique Eric Ethan "
    "Felix Fernando Francis Frank Franz Frederic Gabriel Gareth George Giovanni Graham Gregor Guido Hamza Hans Harold Harry Hassan Henry Hugo Ian Ibrahim Igor Isaac Ivan Jack Jacob James Jan Javier Joel Johannes John Jonah Jonas Jonathan Jorge "
    "Jose Joseph Juan Julian Karl Kevin Klaus Kofi Kwame Lars Leo Leon Liam Louis Luca Lucas Luis Luke Manuel Marco Marcus Mario Mark Martin Mateo Matthew Max Michael Miguel Mohammed Nathan Nicholas Nikolai Noah Oliver Omar Oscar Otto Pablo Patrick Paul "
    "Pedro Peter Philip Pierre Quentin Rafael Rajesh Raymond Richard Robert Roberto Roland Samir Samuel Sanjay Sebastian Sergei Simon Stefan Stephen Steven Thomas Tim Tobias Tomas Ulrich Victor Viktor Vincent Walter Werner William Yusuf")
NEUTRAL = "Alex Casey Dana Jamie Jordan Kim Morgan Robin Sam Taylor"
# Titles and ranks before a name.
TITLES = "Dr Mr Mrs Ms Miss Mx Prof Professor Sir Dame Rev PC WPC PCSO DC DS DI DCI Sgt Sergeant Inspector Constable Officer Detective Captain Lieutenant Nurse Paramedic Doctor Herr Frau Madame Mme Monsieur Mlle Señor Señora Sr Sra Signor Signora".split()
# Kinds of streets.
STREETS = "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Close|Crescent|Hill|Way|Walk|Row|Parade|Court|Place|Terrace|Gardens|Square|Boulevard|Blvd|Grove|Mews|Rise|View|Green|Park|Yard"
STREET_ENDS = "weg|straße|strasse|str\\.|gasse|allee|platz|ufer|damm|ring"
_GIVEN = frozenset(f"{FEMALE} {MALE} {NEUTRAL}".lower().split())
_TITLE = r"(?:" + "|".join(TITLES) + r")\b\.?"
_L = r"[^\W\d_]"
_TLD = r"(?:[^\W\d_]{2,12})"
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\s+dot\s+)"
_JOIN = r"(?:\s+(?:underscore|dot|dash|hyphen|plus|minus)\s+|\s?[\[({](?:dot|underscore|plus)[\])}]\s?)"
EMAIL = re.compile(
    rf"(?<![\w.+-])\w[\w.+%'-]*?(?:{_JOIN}[\w+-]+)*(?:(?:\s?@\s?|\s?[\[({{]\s?at\s?[\])}}]\s?)[\w-]+(?:{_DOT}[\w-]+)*{_DOT}{_TLD}|\s+at\s+[\w-]+(?:{_DOT}[\w-]+)*(?:\s+dot\s+|\s?[\[({{]\s?dot\s?[\])}}]\s?){_TLD})\b(?!\s+dot\s+\w)", re.I)
_AT = re.compile(r"[\[({]\s?at\s?[\])}]")
_DIGIT = "zero|one|two|three|four|five|six|seven|eight|nine|oh|double|triple|null|eins|zwei|zwo|drei|vier|fünf|sechs|sieben|acht|neun|zéro|un|deux|trois|quatre|cinq|sept|huit|neuf|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|plus"
_DIGITS = _DIGIT.split("|")
SPELLED = re.compile(rf"\b(?:{_DIGIT})(?:[\s,-]+(?:{_DIGIT})){{6,}}\b", re.I)
PHONE = re.compile(r"(?<![\w@.+:-])(?:\+\s?\d|\(?0|\(\d{3}\)|\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)|\d{2}[ .]\d{2}[ .]\d{2}[ .]\d{2}[ .]\d{2})[\d ().\-/]*\d(?![\w@])")
IDS = re.compile(
    r"\b(?:[A-CEGHJ-TW-Z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-D]|\d{3}-\d{2}-\d{4}|[A-Z9]{5}[ -]?\d{6}[ -]?[A-Z9]{1,2}\d{1,2}[A-Z0-9]{1,3}|\d[A-Z]\d{7}|[A-Z]\d{8}|999 \d{3} \d{4})\b")
_NUMBERED = re.compile(
    r"\b(?:national insurance|NI|NHS|social security|SSN|patient|passport|passeport|pasaporte|driving licen[cs]e|driver'?s? licen[cs]e|insurance|Sozialversicherungs?|Reisepass|Führerschein|Personalausweis)[ -]?(?:(?:number|nummer|no\.?|nr\.?|num\.?|id)\s*)?(?:is |was |:|#)?\s*((?-i:(?=[A-Z\d -]*\d)[A-Z\d]{2,}(?:[ -][A-Z\d]{1,7}){0,4}))\b", re.I)
_UNIT = r"(?:Flat|Apt|Apartment|Unit|Suite|Studio|Room|Wohnung|Appt)\.?\s(?:\d{1,4}[A-Za-z]?|[A-Z])\b"
_POSTCODE = r"[A-Za-z]{1,2}\d{1,2}[A-Za-z]?\s?\d[A-Za-z]{2}\b|[A-Z]{2}\s\d{5}\b|\d{5}(?:-\d{4})?\b"
_TOWN = rf"(?!(?:which|or|so|and|but|the|in|on|at|i|my|we|who)\b){_L}{{3,}}(?:-{_L}+)*"
ADDRESS = re.compile(
    rf"(?<![\w.:/-])(?:{_UNIT},?\s)?\d{{1,5}}[A-Za-z]?,?\s(?:(?!(?:metres?|minutes?|seconds?|miles?|people|years?|times?|of|in|on|at|the|and)\b)(?-i:[A-ZÀ-Þ])[\w'’-]*\s){{1,2}}(?:{STREETS})\b(?:,\s{_UNIT})?(?:,\s(?-i:(?=[A-Z]))(?!(?-i:[A-Z]{{2}}\s\d)){_TOWN})?(?:,?\s(?:{_POSTCODE}))?"
    rf"|(?<![\w.:/-])(?:{_UNIT},?\s)?(?-i:[A-ZÄÖÜ])[\w-]*(?:{STREET_ENDS})\s\d{{1,4}}[a-z]?\b(?:,\s{_UNIT})?(?:,\s(?:\d{{5}}\s)?(?-i:(?=[A-ZÄÖÜ])){_TOWN})?"
    rf"|(?<![\w.:/-])\d{{1,4}}(?:\s(?:bis|ter))?,?\s(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai)\s[\w' -]{{2,40}}?(?:,\s\d{{5}}\s{_TOWN})"
    rf"|(?<![\w.:/-])(?:calle|avenida|plaza|paseo|via|viale|piazza)\s[\w' -]{{2,40}}?,?\s\d{{1,4}}\b(?:,\s\d{{5}}\s{_TOWN})?", re.I)
_SURNAME = rf"{_L}[^\W\d_’']*(?:['’]{_L}+)?(?:-{_L}{{2,}})*"
_NAMEWORD = rf"{_L}{{2,}}(?:['’-]{_L}+)*"
_PERSON = rf"(?:{_NAMEWORD}|{_L}\.)(?:\s(?:{_L}\.|{_NAMEWORD})){{0,3}}?"
# A literal that the text must hold, and the phrases that stand right before and after a person's name in statements.
_CUES = (
    ("my name is", r"\bmy name is ", r"(?= and\b|[.,;!]|$)"), ("i was with", r"\bI was with ", r"(?=,| and\b|[.;!]|$| when\b)"), ("or so ", r"(?<![\w-])(?:or so )", r"(?= told\b)"),
    ("said ", r"\bsaid (?:s?he|they) (?:was|were) ", r"(?= of\b|[.,;!]| and\b)"), ("addressed to", r"\baddressed to ", r"(?=[,.;])"), ("signed:", r"\bsigned: ?", r"(?=[,.;\n]|$)"),
    ("driver:", r"\bdriver: ", r"(?=;|,|$)"), ("contact:", r"\bcontact: ", r"(?= ?/|,|;|$)"), ("saying that", r"\bsaying that ", r"(?= would\b| was\b| is\b)"), ("ask for", r"\bask for ", r"(?= next\b| at\b|[,.])"),
    ("hired by", r"\bhired by ", r"(?= on\b|[,.])"), ("rather you", r"\brather you asked ", r"(?=,|[.])"), ("only know", r"\bonly know that ", r"(?= spoke\b| was\b| had\b)"),
    ("the owner", r"\bthe owner \(", r"(?=,)"), ("my ", r"\bmy (?:sister|brother|mother|father|wife|husband|son|daughter|friend|colleague|neighbour|partner) ", r"(?= was\b| is\b|,)"),
    ("i gave", r"\bI gave (?:the|my|his|her) (?:\w+ ){1,4}?to ", r"(?= at\b|[,.])"), ("mein name", r"\bMein Name ist ", r"(?=[.,;]| und\b)"), ("heiße", r"\bIch heiße ", r"(?=[.,;]| und\b)"), ("neben mir", r"\bneben mir stand ", r"(?=,)"),
    ("me llamo", r"\bMe llamo ", r"(?=[.,;]| y\b)"), ("mi nombre", r"\bMi nombre es ", r"(?=[.,;]| y\b)"), ("estaba conmigo", r"\bestaba conmigo ", r"(?=,)"), ("estaba con ", r"\bestaba con ", r"(?=,)"), ("m'appelle", r"\bje m'appelle ", r"(?=[.,;]| et\b)"), ("étais avec", r"\bj'étais avec ", r"(?= ce\b|[,.])"), ("mi chiamo", r"\bmi chiamo ", r"(?=[.,;]| e\b)"), ("ero con", r"\bero con ", r"(?=[.,;])"),
    ("it was ", r"\bit was ", r"(?=, my (?:neighbour|colleague|friend|landlord|boss))"),
)
_CUED = [(literal, re.compile(rf"(?P<cue>{a})(?:{_TITLE}\s+)*(?P<name>{_PERSON}){b}", re.I)) for literal, a, b in _CUES]
_LED = re.compile(rf"(?:^|(?<=[.!?\n]\s)|(?<=[\n])|(?<=\s\s)|(?<=\s))(?:{_TITLE}\s+)*(?P<name>{_PERSON})(?=(?: took my details\b| pulled the \w+(?: \w+)? out of\b|, and after (?:\w+) on\b))", re.I)
_BOTH = re.compile(rf"\bthen (?:{_TITLE}\s+)*(?P<a>{_PERSON}) and (?:{_TITLE}\s+)*(?P<b>{_PERSON}) came\b", re.I)
_TITLED = re.compile(rf"\b(?-i:{_TITLE})\s+(?:{_TITLE}\s+)*(?P<name>(?-i:(?=[A-ZÀ-Þ]))(?:{_L}\.\s?)*{_SURNAME}(?:\s(?-i:(?=[A-ZÀ-Þ]))(?:{_L}\.\s)*{_SURNAME})?)", re.I)
_WORD = re.compile(rf"(?<![\w@-])(?P<given>{_L}{{2,}})\s(?:(?P<mid>{_L})\.\s)?(?P<sur>{_SURNAME})(?![\w@])")
_INITIAL = re.compile(rf"(?<![\w.])(?P<name>(?:[A-ZÀ-Þ]\.\s?){{1,2}}[A-ZÀ-Þ]{_L}{{2,}}(?:-[A-ZÀ-Þ]{_L}+)*)(?![\w@])")
# Words that are never part of a person's name in the phrases above.
_NOT_NAMES = frozenset(
    "a an the and or but so then i we you he she they it my your his her their our this that these those who which what when where there here some any no one two someone somebody nobody anybody everybody people person driver owner man woman boy girl teenager courier cyclist neighbour passenger officer "
    "caretaker cleaner shopkeeper witness colleague nurse crew caller bus car van lorry truck was were is are had has have been be said told asked saw heard went came took ran pulled at in on of to from by with for near about after before while because if as not only just very also "
    "der die das ein eine und ich war le la les un une el los una y e il lo old older young short tall slim broad middle-aged off-duty second first next door both unit street road lane avenue drive close crescent hill way walk row parade".split())
_TRIM_LEFT = frozenset("then and but so later first yes no well also".split())


def _name_span(text: str, a: int, b: int, strict: bool) -> tuple[int, int] | None:
    """The words of [a, b) that are a name; None where they are none."""
    words = [(m.group(), a + m.start(), a + m.end()) for m in re.finditer(r"\S+", text[a:b])]
    while words and (words[0][0].lower() in _TRIM_LEFT or re.fullmatch(_TITLE, words[0][0], re.I)):
        words.pop(0)
    if not words or len(words) > 4:
        return None
    plain = [w.strip(".,").lower() for w, _, _ in words]
    if any(w in _NOT_NAMES and len(w) > 1 for w in plain) or any(c.isdigit() for w in plain for c in w):
        return None
    if strict and not all(w[0].isupper() for w, _, _ in words) and plain[0] not in _GIVEN:
        return None
    if len(plain[-1]) < 3 and not (len(plain[-1]) == 2 and words[-1][0][0].isupper() and words[-1][0][1].islower()):
        return None
    return words[0][1], words[-1][2]


def find_pii(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what is personal in a text, in order and without overlap."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y, _ in found)

    def add(a: int, b: int, kind: str) -> None:
        if a < b and free(a, b):
            found.append((a, b, kind))

    low = text.lower()
    if "@" in text or "dot" in low or _AT.search(low):
        for m in EMAIL.finditer(text):
            add(*m.span(), "email")
    if any(c.isdigit() for c in text):
        for m in IDS.finditer(text):
            before = text[max(0, m.start() - 30):m.start()].lower()
            if re.search(r"(?:badge|exhibit|log|order|plate|reg(?:istration)?|ref(?:erence)?|case|build|serial)\W*(?:no\.?|number)?\W*$", before):
                continue
            add(*m.span(), "id_number")
        for m in _NUMBERED.finditer(text):
            if sum(c.isdigit() for c in m.group(1)) >= 5:
                add(*m.span(1), "id_number")
        for m in ADDRESS.finditer(text):
            add(*m.span(), "address")
        for m in PHONE.finditer(text):
            a, b = m.span()
            digits = sum(c.isdigit() for c in m.group())
            before = text[max(0, a - 30):a].lower()
            if 9 <= digits <= 15 and not re.search(r"\b(?:exhibit|log|order|plate|ref|badge|case (?:no\.?|number))(?: no\.?| number)?[ :#]*$", before):
                add(a, b, "phone")
    for m in SPELLED.finditer(text) if sum(map(low.count, _DIGITS)) >= 7 else ():  # as many words as the pattern asks for
        add(*m.span(), "phone")
    for literal, pattern in _CUED:
        for m in pattern.finditer(text) if literal in low else ():
            if span := _name_span(text, *m.span("name"), strict=True):
                add(*span, "name")
    for m in _BOTH.finditer(text) if "then " in low else ():
        for k in "ab":
            if span := _name_span(text, *m.span(k), strict=True):
                add(*span, "name")
    for m in _LED.finditer(text) if "took my" in low or "pulled the" in low or ", and after" in low else ():
        a, b = m.span("name")
        while not free(a, b) and " " in text[a:b]:  # the words before belong to something else
            a = text.index(" ", a) + 1
        if span := _name_span(text, a, b, strict=True):
            add(*span, "name")
    for m in _TITLED.finditer(text):
        words = m.group("name").split()
        b = m.end("name")
        if len(words) > 1 and words[0].lower() not in _GIVEN and not words[0].endswith("."):
            b = m.start("name") + len(words[0])
        if span := _name_span(text, m.start("name"), b, strict=True):
            add(*span, "name")
    at = 0
    while m := _WORD.search(text, at):
        given, sur = m.group("given"), m.group("sur")
        named = given.lower() in _GIVEN and sur.lower() not in _NOT_NAMES and len(sur) >= 2 and given[0].isupper() and sur[0].isupper()
        if named:
            add(*m.span(), "name")
        at = m.end() if named else m.end("given")  # what is no given name may stand before one
    for m in _INITIAL.finditer(text):
        if span := _name_span(text, *m.span("name"), strict=True):
            add(*span, "name")
    # a surname that is known here is the same person's wherever else it stands
    surnames = {w for a, b, k in found if k == "name" for w in [text[a:b].split()[-1]] if len(w) > 1 and w[0].isupper() and w.lower() not in _NOT_NAMES}
    for s in surnames:
        for m in re.finditer(rf"(?<![\w@.-]){re.escape(s)}(?![\w@-])", text):
            if not re.match(rf"\s(?:{STREETS})\b", text[m.end():]):
                add(*m.span(), "name")
    return sorted(found)


# Letters that stand for each other, by script: vowels and consonants.
ALPHABETS = ("aeiouy", "bcdfghjklmnpqrstvwxz", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ")
_CLASS = {c: letters for letters in (*ALPHABETS, "0123456789") for c in letters}
# Words of addresses and written-out e-mails that stay.
_KEPT = frozenset(f"{STREETS}|flat|apt|apartment|unit|suite|studio|room|wohnung|appt|rue|calle|avenida|plaza|paseo|via|viale|piazza|chemin|allée|impasse|quai|bis|ter|de|la|le|du|des|del|at|dot|underscore|dash|hyphen|minus".lower().split("|"))
_DIGIT_WORDS = {w: tuple(ws.split()) for ws in (
    "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve") for w in ws.split()}


def _letters(c: str) -> str:
    """The letters among which ``c``, a letter or digit without case, may be changed: of its alphabet, else those of its block of the same kind."""
    if c not in _CLASS:
        start = ord(c) & ~0x7F
        kind = unicodedata.category(c)
        block = "".join(x for x in map(chr, range(start, start + 0x80)) if unicodedata.category(x) == kind and x == x.lower() and x not in _CLASS and len(unicodedata.normalize("NFD", x)) == 1 and len(x.upper()) == 1)
        _CLASS[c] = block if c in block else c
    return _CLASS[c]


class Surrogates:
    """Keyed replacements: a permutation of all words of one form, so what differs stays different over the whole corpus.

    Each letter or digit may become one of its class (vowel or consonant of its script, digit); the word is a number in the mixed base of these
    classes, and a keyed Feistel network permutes those numbers. Conjugated with a step by one it leaves no word as it was. Listed
    given names are permuted among those of their gender, other words never become one of them.
    """

    def __init__(self, key: bytes) -> None:
        if not key:
            raise ValueError("a key is needed")
        self.key, self.known = key, {}
        self.given = {n: tuple(names) for names in (FEMALE.lower().split(), MALE.lower().split(), NEUTRAL.lower().split()) for n in names}

    def _round(self, tweak: str, i: int, x: int, size: int) -> int:
        need = size.bit_length() // 8 + 9
        return int.from_bytes(hashlib.shake_256(self.key + f"\0{tweak}\0{i}\0{x}".encode()).digest(need), "big") % size

    def _permuted(self, x: int, size: int, tweak: str, back: bool = False) -> int:
        """A keyed permutation of range(size): a Feistel network over a little more, walked until it is inside."""
        a = math.isqrt(size - 1) + 1
        while True:
            left, right = divmod(x, a)
            for i in range(7, -1, -1) if back else range(8):
                left, right = ((right - self._round(tweak, i, left, a)) % a, left) if back else (right, (left + self._round(tweak, i, right, a)) % a)
            x = left * a + right
            if x < size:
                return x

    def moved(self, x: int, size: int, tweak: str) -> int:
        """Another number below ``size``: a permutation without fixed points."""
        return x if size < 2 else self._permuted((self._permuted(x, size, tweak) + 1) % size, size, tweak, back=True)

    def _word(self, text: str, kind: str) -> str:
        """Letters and digits of a word or number replaced; marks, other characters and case stay where they are."""
        plain = unicodedata.normalize("NFD", text)
        low = [c.lower() if len(c.lower()) == 1 else c for c in plain]
        at = [i for i, c in enumerate(low) if (c.isalpha() or c.isdigit()) and len(_letters(c)) > 1]
        classes = [_letters(low[i]) for i in at]
        size, x = 1, 0
        for i, letters in zip(at, classes):
            size, x = size * len(letters), x * len(letters) + letters.index(low[i])
        kept = set(at)
        form = kind + "".join(c[0] for c in classes) + "\0" + "".join(c for i, c in enumerate(low) if i not in kept)
        while True:
            x = self.moved(x, size, form)
            n, out = x, list(plain)
            for i, letters in zip(reversed(at), reversed(classes)):
                n, r = divmod(n, len(letters))
                out[i] = letters[r].upper() if plain[i].isupper() else letters[r]
            new = unicodedata.normalize("NFC", "".join(out))
            if size < 2 or kind != "name" or new.lower() not in self.given:
                return new

    def _name(self, word: str) -> str:
        pool = self.given.get(word.lower())
        if not pool:
            return self._word(word, "name")
        new = pool[self.moved(pool.index(word.lower()), len(pool), "given" + pool[0])].capitalize()
        return new.upper() if word.isupper() and len(word) > 1 else new.lower() if word.islower() else new

    def of(self, kind: str, value: str) -> str:
        """The surrogate of a personal text: same kind, gender, script, length of words and format."""
        if (kind, value) not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            if kind == "name":
                new = re.sub(r"[^\W\d_]+", lambda m: self._name(m.group()), value)
            elif kind in ("address", "email"):
                new = re.sub(r"[^\W_]+", lambda m: m.group() if m.group().lower() in _KEPT else self._word(m.group(), kind), value)
                if kind == "email":  # a domain that can belong to nobody; the whole of the old one is still told apart
                    new += " dot example" if re.search(r"\sdot\s", value) else ".example"
            elif kind == "phone" and not any(c.isdigit() for c in value):
                new = self._spelled(value)
            else:  # the country or trunk code of a number stays
                keep = re.match(r"\+\s?\d|\(?0", value).end() if kind == "phone" and re.match(r"\+\s?\d|\(?0", value) else 0
                new = value[:keep] + self._word(value[keep:], kind)
            self.known[kind, value] = new
        return self.known[kind, value]

    def _spelled(self, value: str) -> str:
        words = re.findall(r"\w+", value)
        pools = [_DIGIT_WORDS.get(w.lower()) for w in words]
        size, x = 1, 0
        for w, pool in zip(words, pools):
            if pool:
                size, x = size * 10, x * 10 + pool.index(w.lower())
        x = self.moved(x, size, "spelled" + " ".join(p[0] if p else w.lower() for w, p in zip(words, pools)))
        new = []
        for w, pool in zip(reversed(words), reversed(pools)):
            if pool:
                x, r = divmod(x, 10)
                w = pool[r].upper() if w.isupper() else pool[r].capitalize() if w[0].isupper() else pool[r]
            new.append(w)
        last = iter(reversed(new))
        return re.sub(r"\w+", lambda m: next(last), value)

    def mark(self, kind: str, value: str) -> str:
        """A typed placeholder with 64 keyed bits of the entity."""
        whole = f"{kind}\0{' '.join(value.casefold().split())}".encode()
        return f"[{kind.upper()}_{hmac.new(self.key, whole, hashlib.sha256).hexdigest()[:16]}]"

    def replace(self, text: str | None, placeholders: bool = False) -> str | None:
        """The text with its personal information replaced."""
        spans = find_pii(text)
        if not spans:
            return text
        out, last, given = [], 0, {}
        for a, b, kind in spans:
            value = text[a:b]
            new = self.mark(kind, value) if placeholders else self.of(kind, value)
            if given.setdefault((kind, new), value.casefold()) != value.casefold() and " ".join(given[kind, new].split()) != " ".join(value.casefold().split()):
                raise ValueError("two entities met in one surrogate")  # a permutation cannot do that
            out += [text[last:a], new]
            last = b
        return "".join(out) + text[last:]


STATE = "raw_statement string, original_statement string, user_answers array<string>"


def state_texts(states: DataFrame) -> DataFrame:
    """(thread_id, step, field, item, text) of the free texts of all states."""
    s = states.select("thread_id", F.col("step").cast("int").alias("step"), F.from_json("state", STATE).alias("s"))
    single = lambda f: F.struct(F.lit(f).alias("field"), F.lit(0).alias("item"), F.col(f"s.{f}").alias("text"))
    answers = F.transform(F.coalesce("s.user_answers", F.array().cast("array<string>")), lambda t, i: F.struct(F.lit("user_answers").alias("field"), i.alias("item"), t.alias("text")))
    return s.where("s is not null").select("thread_id", "step", F.explode(F.concat(F.array(single("raw_statement"), single("original_statement")), answers)).alias("x")).select("thread_id", "step", "x.*").where("text is not null and text <> ''")


def pii_rows(texts: DataFrame) -> DataFrame:
    """(thread_id, step, field, item, kind, pii): each distinct personal text of each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, t[x:y]) for i, t in enumerate(b.column(4).to_pylist()) for x, y, k in find_pii(t)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[:4]), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["thread_id", "step", "field", "item", "kind", "pii"])

    return texts.select("thread_id", "step", "field", "item", "text").mapInArrow(run, "thread_id string, step int, field string, item int, kind string, pii string").distinct()


def pii_replaced(texts: DataFrame, key: bytes) -> DataFrame:
    """(thread_id, step, field, item, masked, surrogate): placeholders and surrogates in place of what is personal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key)
        for b in batches:
            values = b.column(4).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([made.replace(t, True) for t in values], pa.string()), pa.array([made.replace(t) for t in values], pa.string())], ["thread_id", "step", "field", "item", "masked", "surrogate"])

    return texts.select("thread_id", "step", "field", "item", "text").mapInArrow(run, "thread_id string, step int, field string, item int, masked string, surrogate string")
