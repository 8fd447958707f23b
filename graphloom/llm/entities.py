"""The same real things across sources that share no key.

Each Person, Vehicle or Object node is read into partial attributes (street, town, name, clothing, colour family,
kind, plate ...). Nodes of one source, minute and street make a report, which knows town and crossing street from any of its nodes.
Reports of different sources become candidates when they share a half of the street's name within ``WINDOW_H`` hours or,
whatever their time, a street together with a surname, a plate or both attributes of a thing; so late and undated reports meet
the rest. All nodes of one label in two such reports are candidate pairs.

How each pair agrees is a pattern of levels. Weights are not set by hand: the patterns are counted over all candidates (a
bounded table, whatever the size of the data), and expectation maximisation splits match from non-match frequencies. The
evidence of all things in two reports then says how likely both tell of one incident, with priors counted in the same way by
gap of time, town and crossing street. Over the pairs runs loopy belief propagation: a node can be the same as at most
one node of each other report, so every (node, report) is a one-to-one factor. A factor lies within two reports, so messages are exchanged where
all pairs of these are, until none changes by ``tolerance``; the marginal of each pair is its confidence.

All reports of a block meet, whatever its size and their towns; a block of many is dealt over places where two parts of it meet, each pair
in one of them. Keys are 64-bit hashes; reports that share one by collision are told apart by
their streets and towns. Tables of each stage are written to the shared folder.

Defined cases: repeated rows (same id) count once, by their least content; a node without description or source,
or with neither street nor plate, gives no pair; null and empty attributes neither agree nor conflict; a local time of a source
without zone counts as UTC, which is near enough for windows of days; pairs are of one label and of different sources; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.store import discard, materialize, small_enough
from graphloom.operators.instants import with_first_reading

LABELS = ("Person", "Vehicle", "Object")
WINDOW_H = 72
# Words for one colour, kind, role, height, build or gender.
COLOURS = {
    "black": "black|blk|very dark|jet black|ebony|charcoal", "white": "white|wht|cream|off-white|ivory|pearl", "grey": "grey|gray|silver|silvery|metallic grey|gunmetal|slate", "red": "red|rd|crimson|maroon|dark red|scarlet|burgundy|cherry",
    "blue": "blue|navy|dark blue|bluish|light blue|azure|turquoise|teal", "green": "green|grn|dark green|olive|khaki|lime", "yellow": "yellow|bright yellow|mustard|gold|golden", "orange": "orange|burnt orange|amber|copper", "brown": "brown|tan|bronze|beige|chocolate", "purple": "purple|violet|plum|lilac|mauve", "pink": "pink|rose|magenta",
}
VEHICLES = {
    "pickup": "pickup|pick-up truck|pick-up|flatbed", "hatch": "hatchback|hatch|five-door|small car", "estate": "estate|estate car|station wagon", "saloon": "saloon|sedan|four-door car|four-door",
    "van": "van|panel van|delivery van|minivan|people carrier", "truck": "truck|lorry|hgv|tanker|articulated lorry", "suv": "suv|4x4|off-roader|jeep", "bike": "motorbike|motorcycle|bike|moped|scooter", "bus": "bus|coach|minibus", "coupe": "coupe|coupé|convertible|cabriolet|sports car", "taxi": "taxi",
}
ROLES = {
    "witness": "witness|eyewitness|onlooker|observer", "victim": "victim|injured person|casualty|injured party|patient", "suspect": "suspect|alleged driver|driver who left|offender|perpetrator|accused", "bystander": "bystander|pedestrian|passer-by|passerby", "reporter": "reporter|reporting party|caller|person who rang it in|informant", "driver": "driver|motorist", "passenger": "passenger|occupant",
}
HEIGHTS = {"short": "short|not tall|five foot three|1.60 m", "tall": "tall|over six feet|about 6ft 2|1.88 m", "medium": "medium height|average height|about 5ft 9|1.74 m"}
BUILDS = {"heavy": "heavy-set|stocky|broad|heavy|large|overweight", "slim": "slim|thin|slender|skinny|lean", "average": "average build|medium build", "muscular": "muscular|athletic"}
GENDERS = {"f": "f|female|woman|lady|girl|ms|mrs|miss", "m": "m|male|man|gentleman|boy|mr"}
CLOTHES = "raincoat tracksuit waistcoat cardigan overalls overall hoodie anorak fleece jacket jumper sweatshirt sweater coat parka blazer dress skirt suit tunic vest top t-shirt shirt blouse".split()
THINGS = "guitar case|torch|crowbar|suitcase|umbrella|shopping bag|toolbox|skateboard|pushchair|mobile phone|cycle helmet|walking stick|wallet|laptop case|rucksack|backpack|handbag|briefcase|purse|camera|hammer|screwdriver|baseball bat|phone|laptop|tablet|scooter|bottle|box|bag|helmet|knife|bicycle".split("|")
STREETS = "street road lane avenue drive close crescent hill way walk row parade court place terrace gardens square grove mews rise".split()
TITLES = frozenset("dr mr mrs ms miss prof pc sgt sergeant the".split())


def _inverse(table: dict[str, str]) -> dict[str, str]:
    return {w: k for k, ws in table.items() for w in ws.split("|")}


_COLOUR, _VEHICLE, _ROLE, _HEIGHT, _BUILD, _GENDER = map(_inverse, (COLOURS, VEHICLES, ROLES, HEIGHTS, BUILDS, GENDERS))
_COLOUR_WORDS = frozenset(w for words in _COLOUR for w in words.split())
_ROLE_WORDS = frozenset(w for words in _ROLE for w in words.split())
_alternatives = lambda words: "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
_KINDS = {"colour": _COLOUR, "vehicle": _VEHICLE, "role": _ROLE, "height": _HEIGHT, "build": _BUILD, "gender": [w for w in _GENDER if len(w) > 2], "clothes": CLOTHES, "thing": THINGS}
_FIND = {n: re.compile(rf"(?<![\w-])(?:{_alternatives(t)})(?![\w-])") for n, t in _KINDS.items()}
_TOKEN = re.compile(r"[\w-]+")
# the tokens with which words of a kind begin; those that begin no other word of the kind are found when they are seen
_HEADS = {n: frozenset(_TOKEN.match(w).group() for w in t) for n, t in _KINDS.items()}
_ALONE = {n: frozenset(w for w in t if w in _HEADS[n] and sum(_TOKEN.match(x).group() == w for x in t) == 1) for n, t in _KINDS.items()}
_STREET = re.compile(rf" (?:{'|'.join(STREETS)})\b")
_PLACED = re.compile(r"(?:\b(?:near|at|on|by|of)|,)\s+([^\W\d_]{3,}) ?([^\W\d_]{2,9}?)(?=,| in\b| and\b| with\b|$)")
_ROLE_TAIL = re.compile(rf"[\s,(-]+(?:the )?(?:{_alternatives(_ROLE)}).*$")
_NAME_END = re.compile(r"\(|, - | - |, (?:the\b|near|at|on|by)|near\b(?<!\wnear)|at\b(?<!\wat)|by\b(?<!\wby)")  # begins with letters and signs, so that a search skips to them
_MARK = re.compile(r"\b(?:with|,) (?:an? |one )?([a-z][a-z -]{5,40}?)(?= \(| near\b| at\b| on\b| by\b|,|$)")
_THING_MARK = re.compile(r"\b(with|bearing|tied with|missing|having)\b (.*?)(?= \(| near\b| at\b| on\b| by\b|,|$)")
_TOWN = re.compile(r"\W*(?:,|\bin\b)\W*(?:in\s+)?([^\W\d_]{4,})")
_AGE = re.compile(r"(\d{1,3})(s?)")
_MERGED = re.compile(rf"([^\W\d_]{{4,}}?)({'|'.join(STREETS)})(?![a-z])")
_PLATE = re.compile(r"\b(?:plate|reg(?:\.|istration)?)\s+([a-z0-9?*]{2,4}[ -]?[a-z0-9?*]{3})\b")
_STARTS = re.compile(r"\breg\. starting ([a-z0-9]{2,4})\b")
_TITLE = re.compile(r"\b(mr|mrs|ms|miss)\b")
_TYPED = str.maketrans("015862", "oisbgz")


def near(a: str, b: str) -> bool:
    """Equal, or one insertion, deletion, change or swap of neighbours apart."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    return abs(la - lb) <= 1 and min(la, lb) >= 4 and _slip(a, b)


def _slip(a: str, b: str) -> bool:
    la, lb = len(a), len(b)
    i = 0
    while i < min(la, lb) and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1:] == b[i + 1:] or (a[i:i + 2] == b[i:i + 2][::-1] and a[i + 2:] == b[i + 2:])
    return abs(la - lb) == 1 and (a[i + 1:] == b[i:] if la > lb else a[i:] == b[i + 1:])


def _first(kind: str, text: str, tokens: list[str]) -> str:
    """The first word of a kind in the text, whose tokens are given; empty without one. Only words of several tokens are searched for."""
    heads = _HEADS[kind]
    if heads.isdisjoint(tokens):
        return ""
    head = next(t for t in tokens if t in heads)
    if head in _ALONE[kind]:
        return head
    m = _FIND[kind].search(text)
    return m.group() if m else ""


def _streets(text: str) -> tuple[list[str], int]:
    """Street names in a description (single blanks), without case, and where the last one ends."""
    found = []
    for m in _STREET.finditer(text):
        before = text[text.rfind(" ", 0, m.start()) + 1:m.start()]
        if len(before) > 2 and before.isalpha():
            found.append((before + m.group(), m.end()))
    if not found:
        found = [(f"{m.group(1)} {m.group(2)}", m.end()) for m in _MERGED.finditer(text)]
    if not found:  # the kind of street is misspelled, or its first letter stands before the blank
        for m in _PLACED.finditer(text):
            name, way = m.groups()
            if {name, way} & _ROLE_WORDS or way in _COLOUR_WORDS:
                continue
            kind = next((s for s in STREETS if _slip(way, s)), None)
            whole = name + way
            if kind or (kind := next((s for s in STREETS if whole.endswith(s) and len(whole) > len(s) + 2), None)):
                found.append((f"{name if not whole.endswith(kind) else whole[:-len(kind)]} {kind}", m.end()))
    return [a for a, _ in found], found[-1][1] if found else -1


#: What one node is compared by, in a few columns that mean another thing for each kind.
PACKED = {"n": ("gender", "role", "height", "build", "surname", "given"), "d": ("gender", "role", "height", "build", "clothes", "colour"), "v": ("type", "colour", "make", "model", "mark", "plate"), "o": ("type", "colour", "mark")}
SLOTS = tuple(f"x{i}" for i in range(6))
PLACE = ("kind", "street", "crossing", "town")


def read_node(label: str, props: dict[str, str]) -> dict[str, str] | None:
    """The attributes of a node, by what its description and properties say; None without a description."""
    raw = props.get("name_or_description") or props.get("description") or ""
    text = " ".join(raw.lower().split())
    if not text:
        return None
    streets, end = _streets(text)
    out: dict[str, str] = {"street": streets[0] if streets else "", "crossing": next((s for s in streets[1:] if s != streets[0]), "")}
    if end >= 0 and (m := _TOWN.match(text, end)) and m.group(1) not in _VEHICLE:
        out["town"] = m.group(1)
    what = text
    if streets and (at := text.find(streets[0].split()[0])) > 0:
        what = text[:at]
    tokens = _TOKEN.findall(what)

    def seen(kind: str, table: dict[str, str] | None, *keys: str) -> str:
        for k in keys:
            v = (props.get(k) or "").strip().lower()
            if v:
                return table.get(v, v) if table else v
        if kind == "vehicle":
            word = m.group() if (m := _FIND[kind].search(text)) else ""
        else:
            word = _first(kind, what, tokens)
        return table[word] if table and word else word

    if label == "Person":
        out["role"], out["height"] = seen("role", _ROLE, "role"), seen("height", _HEIGHT, "height")
        out["gender"], out["build"] = seen("gender", _GENDER, "gender"), seen("build", _BUILD)
        if not out["gender"] and ("mr" in what or "ms" in what or "miss" in what) and (m := _TITLE.search(what)):
            out["gender"] = _GENDER[m.group(1)]
        if m := _AGE.search(props.get("age_estimate") or ""):
            out["age"] = int(m.group(1)) + (5 if m.group(2) else 0)
            out["tolerance"] = 6 if m.group(2) else 4 if "about" in props["age_estimate"] else 2
        clothes = _first("clothes", what, tokens)
        if clothes:
            out["kind"], out["clothes"], out["colour"] = "d", clothes, seen("colour", _COLOUR)
        else:
            name = (props.get("name") or "").lower() or (what[:m.start()].rstrip() if (m := _NAME_END.search(what)) else what)
            name = _ROLE_TAIL.sub("", name)
            if "," in name:
                last, _, rest = name.partition(",")
                name = f"{rest.strip()} {last.strip()}"
            words = [w for w in (w.strip(".,") for w in name.split()) if w and w not in TITLES]
            if words and len(words) <= 4 and len(words[-1]) > 2:
                out["kind"], out["surname"] = "n", words[-1]
                out["given"] = words[0] if len(words) > 1 else ""
            else:
                out["kind"] = "d"
                out["colour"] = seen("colour", _COLOUR)
    elif label == "Vehicle":
        plate = (props.get("registration") or "").lower()
        if not plate and ("plate" in text or "reg" in text) and (m := _PLATE.search(text)):
            plate = m.group(1)
        plate = re.sub(r"[^a-z0-9?]", "", plate.replace("*", "?"))
        if not plate and "reg. starting" in text and (m := _STARTS.search(text)):
            plate = m.group(1)
        out |= {"kind": "v", "type": seen("vehicle", _VEHICLE, "type"), "colour": seen("colour", _COLOUR, "colour"), "plate": plate.translate(_TYPED)}
        make, model = (props.get("make") or "").lower(), (props.get("model") or "").lower()
        if not make:
            made = (m.group(1).lower() for m in _MAKE.finditer(" ".join(raw.split())[:len(what)]))
            make = next((w for w in made if w not in _COLOUR_WORDS), "")
        out["make"], out["model"] = make, model
        if m := _MARK.search(what):
            out["mark"] = m.group(1).split()[-1]
    else:
        out |= {"kind": "o", "type": seen("thing", None, "type"), "colour": seen("colour", _COLOUR, "colour")}
        if m := _THING_MARK.search(what):
            out["mark"] = m.group(2).split()[-1] if m.group(2) else ""
    return out


_MAKE = re.compile(r"(?:^|[ ,])([A-Z][a-z]{3,})(?= [A-Z0-9]| on| near| at| by|,)")

#: The properties that say something of a node of a label, beside what describes it.
PROPERTIES = {"Person": ("name", "role", "height", "gender", "age_estimate"), "Vehicle": ("registration", "type", "colour", "make", "model"), "Object": ("type", "colour")}
_GIVEN = tuple(f"p{i}" for i in range(5))
_NUMBERS = ("age", "tolerance")
_FIELDS = {kind: (*PLACE, *packed, *[""] * (len(SLOTS) - len(packed)), *_NUMBERS) for kind, packed in PACKED.items()}
_SCHEMA = "id bigint, source string, label string, hours double, " + ", ".join(f"{f} string" for f in (*PLACE, *SLOTS)) + ", age int, tolerance int"


def node_features(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, source, label, hours, PLACE, SLOTS, age, tolerance) of the rows that say something, repeated rows included; unknown attributes are null."""
    # single properties as columns, which Python reads faster than maps; each column is another property for each label, so that maps are searched for few
    key = lambda i: functools.reduce(lambda c, x: c.when(F.col("label") == x, F.lit(PROPERTIES[x][i])) if len(PROPERTIES[x]) > i else c, PROPERTIES, F)
    said = F.coalesce(F.nullif(F.col("props")["name_or_description"], F.lit("")), F.col("props")["description"]).alias("said")
    wanted = nodes.where(F.col("label").isin(*LABELS) & F.col("id").isNotNull() & F.col("source").isNotNull()).select("id", "label", "source", "extracted_at", said, *[F.col("props")[key(i)].alias(c) for i, c in enumerate(_GIVEN)])
    zones = sources.groupBy(F.col("source_id").alias("source")).agg(F.min(F.struct(F.coalesce("tz", F.lit("UTC")).alias("tz"), "locale")).alias("z")).select("source", "z.*")
    # the cheapest reading is near enough for a window of days
    timed = with_first_reading(wanted.join(zones, "source", "left").withColumn("tz", F.coalesce("tz", F.lit("UTC"))), "extracted_at", "tz", "locale")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, told = [], []
            for i, (label, said, *given) in enumerate(zip(*(b.column(c).to_pylist() for c in ("label", "said", *_GIVEN)))):
                n = read_node(label, {"description": said, **dict(zip(PROPERTIES[label], given))})
                if n and (n["street"] or n.get("plate")):
                    kept.append(i)
                    told.append([n.get(f) or None for f in _FIELDS[n["kind"]]])
            at, columns = pa.array(kept, pa.int64()), zip(*told) if told else [()] * (len(PLACE) + len(SLOTS) + len(_NUMBERS))
            fields = [pa.array(c, pa.int32() if f in _NUMBERS else pa.string()) for f, c in zip((*PLACE, *SLOTS, *_NUMBERS), columns)]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("id", "source", "label", "hours")), *fields], ["id", "source", "label", "hours", *PLACE, *SLOTS, *_NUMBERS])

    return timed.select("id", "label", "source", (F.col("micros") / 3.6e9).alias("hours"), "said", *_GIVEN).mapInArrow(run, _SCHEMA)


def variants(word: str) -> set[str]:
    """The word and what one letter less leaves of it: two words that are ``near`` share at least one."""
    return {word} | {word[:i] + word[i + 1:] for i in range(len(word))}


def _same_but_a_slip(a: Column, b: Column) -> Column:
    """Equal, or one letter more, less or other."""
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= 4) & (F.levenshtein(a, b, 1) >= 0))


def _near(a: Column, b: Column) -> Column:
    """``near`` in the JVM; of two changed letters any swap counts."""
    letters = lambda c: F.array_sort(F.split(c, ""))
    return _same_but_a_slip(a, b) | ((F.least(F.length(a), F.length(b)) >= 4) & (F.length(a) == F.length(b)) & (F.levenshtein(a, b, 2) == 2) & (letters(a) == letters(b)))


def spellings(features: DataFrame, ratio: int = 5) -> DataFrame:
    """(what, word, right): words of streets, towns and surnames that are slips of a word which is ``ratio`` times as frequent, counted over all nodes.

    A word seen once or twice gives way to any near one at least as frequent (of equals to the last in order).
    """
    words = F.array(*[F.struct(F.lit(w).alias("what"), c.alias("word")) for w, c in (("s", F.col("street")), ("s", F.col("crossing")), ("t", F.col("town")), ("n", _slot("surname", "n")))])
    counts = features.select(F.explode(words).alias("x")).select("x.*").where("word is not null").groupBy("what", "word").agg(F.count("*").alias("n"))
    counts = materialize(counts, "words")
    name = F.when(F.col("what") == "s", F.substring_index("word", " ", 1)).otherwise(F.col("word"))
    way = F.when(F.col("what") == "s", F.substring_index("word", " ", -1)).otherwise(F.lit(""))
    less = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.concat(F.substring(F.col("name"), F.lit(1), i - 1), F.substring(F.col("name"), i + 1, F.length("name"))))
    written = counts.withColumns({"name": name, "way": way}).where("length(name) >= 4").select("what", "word", "n", "name", "way", F.explode(F.array_distinct(F.concat(F.array("name"), less))).alias("v"))
    # the hash decides most comparisons of the sorts before the texts are read
    written = written.withColumn("h", F.xxhash64("what", "way", "v"))
    # a slip is rare beside its word: of all that share a variant the most frequent one is enough
    better = written.groupBy("h", "what", "way", "v").agg(F.max(F.struct("n", "word", "name")).alias("b"))
    found = written.join(better, ["h", "what", "way", "v"]).where((F.struct("b.n", "b.word") > F.struct("n", "word")) & ((F.col("b.n") >= ratio * F.col("n")) | (F.col("n") <= 2)) & _near(F.col("name"), F.col("b.name")))
    return found.groupBy("what", "word").agg(F.max(F.struct("b.n", "b.word")).alias("b")).select("what", "word", F.col("b.word").alias("right"))


def _corrected(features: DataFrame, right: DataFrame, small: int = 200_000) -> DataFrame:
    """``features`` with slips put right. The table of slips is broadcast only if it has ``small`` rows at most."""
    hint = F.broadcast if small_enough(right, small) else (lambda t: t)
    for what, c in (("s", "street"), ("s", "crossing"), ("t", "town"), ("n", SLOTS[PACKED["n"].index("surname")])):
        table = right.where(F.col("what") == what).select(F.col("word").alias("_word"), F.col("right").alias("_right"))
        on = (F.col(c) == F.col("_word")) & (F.col("kind") == "n") if what == "n" else F.col(c) == F.col("_word")
        features = features.join(hint(table), on, "left").withColumn(c, F.coalesce("_right", c)).drop("_word", "_right")
    return features


def reports(features: DataFrame) -> DataFrame:
    """(id, source, label, kind, hours, report, street, town, crossing, age, tolerance, SLOTS), repeated rows once: nodes of one source, minute and street
    make a report, named by its least node id; it has the town and crossing of any of its nodes (of several the last in order). Undated nodes stand alone."""
    alone = F.col("hours").isNull() | F.col("street").isNull()
    keys = {"_minute": F.when(~alone, F.floor(F.col("hours") * 60)).otherwise(F.lit(-1)), "_alone": F.when(alone, F.col("id")).otherwise(F.lit(-1))}
    # the hash decides most comparisons of the sort before the texts are read
    rows = features.withColumns(keys).withColumn("_hash", F.xxhash64("source", "_minute", "street", "_alone"))
    by = Window.partitionBy("_hash", "source", "_minute", "street", "_alone").orderBy("id")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = rows.withColumns({"_before": F.lag("id").over(by), "report": F.first("id").over(whole), "town": F.max("town").over(whole), "crossing": F.max("crossing").over(whole), "hours": F.min("hours").over(whole)})
    return told.where("_before is null or _before <> id").drop("_before", "_minute", "_alone", "_hash")


def _slot(attribute: str, kind: str) -> Column:
    """The attribute of a node of a kind; null for other kinds."""
    return F.when(F.col("kind") == kind, F.col(SLOTS[PACKED[kind].index(attribute)]))


def _keyed(*parts: Column | str) -> Column:
    """64 bits of the parts, null where one is unknown."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    known = cols[0].isNotNull()
    for c in cols[1:]:
        known = known & c.isNotNull()
    return F.when(known, F.xxhash64(*cols))


def block_keys(nodes: DataFrame) -> DataFrame:
    """(key, report): of reports by street and window of time, and of nodes by street and what identifies a thing."""
    at = F.floor(F.col("hours") / WINDOW_H)
    seen = nodes.where("id = report").select(F.explode(F.array_compact(F.array(_keyed(F.lit("at"), "street", at), _keyed(F.lit("at"), "street", at + 1)))).alias("key"), "report")
    clothes, plate, kind = _slot("clothes", "d"), _slot("plate", "v"), F.coalesce(_slot("type", "v"), _slot("type", "o"))
    readable = lambda c: F.when(~c.contains("?"), c)
    keys = F.array(
        _keyed(F.lit("name"), "street", _slot("surname", "n")), _keyed(F.lit("worn"), "street", F.when(clothes != "top", clothes), _slot("colour", "d")),
        # a top, too, is worn by whoever is seen undated in anything
        _keyed(F.lit("worn"), "street", F.when((clothes == "top") | F.col("hours").isNull() & (F.col("kind") == "d"), F.lit("top")), _slot("colour", "d")),
        _keyed(F.lit("type"), "label", "street", kind, F.coalesce(_slot("colour", "v"), _slot("colour", "o"))),
        _keyed(F.lit("start"), "street", F.when(F.length(plate) >= 3, readable(F.left(plate, F.lit(3))))), _keyed(F.lit("end"), "street", F.when(F.length(plate) >= 6, readable(F.right(plate, F.lit(3))))),
        _keyed(F.lit("plate"), F.when(F.length(plate) >= 6, readable(F.right(plate, F.lit(5))))))
    return seen.unionByName(nodes.select(F.explode(F.array_compact(keys)).alias("key"), "report"))


def _asked(nodes: DataFrame, small: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(ra, rb), and the written table that they are read from: undated reports that lack an attribute, with those that agree in street and the other attribute. What they ask is broadcast only if it has ``small`` rows at most."""
    clothes = _slot("clothes", "d")
    first = F.coalesce(F.when(clothes != "top", clothes), _slot("type", "v"), _slot("type", "o"))
    colour = F.coalesce(*[_slot("colour", k) for k in "dvo"])
    n = nodes.where("kind <> 'n' and street is not null").select("report", "hours", first.alias("first"), colour.alias("colour"), F.array(_keyed(F.lit("one"), "label", "street", first), _keyed(F.lit("other"), "label", "street", colour)).alias("keys"))
    asks = materialize(n.where(F.col("hours").isNull() & (F.col("first").isNull() | F.col("colour").isNull())).select(F.explode("keys").alias("key"), F.col("report").alias("ra")).where("key is not null"), "asks")
    told = n.select(F.explode("keys").alias("key"), F.col("report").alias("rb")).where("key is not null")
    met = told.join(F.broadcast(asks) if small_enough(asks, small) else asks, "key").where("ra <> rb")
    return met.select(F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb")), asks


def report_pairs(nodes: DataFrame, block: int = 200) -> DataFrame:
    """(ra, rb), ra < rb: distinct pairs of reports that may tell of one incident: all that share a key, however many do.

    ``block`` says how many reports of a key meet in one place at once; it does not change the result.
    """
    # most keys are of one report only
    keys = materialize(block_keys(nodes).withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").select("key", "report", "n"), "keys")
    # the reports of a block fall into parts of about ``block``, and each two parts meet in a place of their own, so that a hot key is many tasks
    parts = F.ceil(F.col("n") / block)
    placed = keys.withColumn("part", F.pmod(F.xxhash64("report"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    side = lambda s: placed.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), F.col("part").alias(f"part_{s}"), F.col("report").alias(f"r{s}"))
    met = side("a").join(side("b"), ["key", "low", "high"]).where("ra < rb and (low = high or part_a <> part_b)").select("ra", "rb")
    asked, asks = _asked(nodes)
    pairs = materialize(met.unionByName(asked).distinct(), "pairs")
    discard(keys)
    discard(asks)
    return pairs


def _setting() -> Column:
    """How gap, town, street and crossing of two reports agree."""
    level = lambda c: F.when(F.col(f"{c}_a").isNull() | F.col(f"{c}_b").isNull(), "-").when(_same_but_a_slip(F.col(f"{c}_a"), F.col(f"{c}_b")), "1").otherwise("0")
    gap = F.abs(F.col("hours_a") - F.col("hours_b"))
    return F.concat(F.when(gap.isNull(), "-").when(gap <= 24, "a").when(gap <= WINDOW_H, "b").otherwise("c"), level("town"), level("street"), level("crossing"))


#: The levels of agreement in each class of pairs, by attribute, with what a match and a non-match give before anything is counted.
CLASSES = {
    "nn": {"surname": ((0.02, 0.98), (0.97, 0.03)), "given": ((0.03, 0.17, 0.1, 0.7), (0.88, 0.08, 0.02, 0.02))},
    "dd": {"clothes": ((0.02, 0.98), (0.9, 0.1)), "colour": ((0.02, 0.98), (0.9, 0.1))},
    "dn": {},
    "v": {"type": ((0.02, 0.98), (0.85, 0.15)), "colour": ((0.02, 0.98), (0.9, 0.1)), "make": ((0.03, 0.97), (0.85, 0.15)), "model": ((0.03, 0.97), (0.6, 0.4)), "mark": ((0.4, 0.6), (0.85, 0.15)), "plate": ((0.01, 0.03, 0.36, 0.6), (0.96, 0.02, 0.015, 0.005))},
    "o": {"type": ((0.02, 0.98), (0.93, 0.07)), "colour": ((0.02, 0.98), (0.9, 0.1)), "mark": ((0.4, 0.6), (0.9, 0.1))},
}
#: What all pairs of persons share, counted over the three classes together.
PERSON = {"gender": ((0.02, 0.98), (0.5, 0.5)), "role": ((0.05, 0.95), (0.75, 0.25)), "height": ((0.04, 0.96), (0.65, 0.35)), "build": ((0.04, 0.96), (0.65, 0.35)), "age": ((0.06, 0.14, 0.8), (0.8, 0.1, 0.1))}
PERSONS = ("nn", "dd", "dn")
FIRST_SHARE = 0.3  # of pairs within one incident that are matches, before anything is counted
AGAIN = 0.002  # that a thing of one incident is in another one, too
UNKNOWN = "-"


def _attributes(kind: str) -> dict[str, tuple]:
    return (PERSON if kind in PERSONS else {}) | CLASSES[kind]


def _places(kind: str) -> list[tuple[str, int]]:
    """Each attribute of a class with its place in a pattern: its slot, and the age after the slots."""
    return [(c, len(SLOTS) if c == "age" else PACKED[kind[0]].index(c)) for c in _attributes(kind)]


def _pattern() -> Column:
    """One character for each slot and one for the age, over columns named x_a and x_b; short, so that it is compiled as one method."""
    one, kind = F.col("kind_a") == F.col("kind_b"), F.col("kind_a")
    digit = lambda cond: F.when(cond, "1").otherwise("0")

    def level(i: int) -> Column:
        a, b = F.col(f"{SLOTS[i]}_a"), F.col(f"{SLOTS[i]}_b")
        if i in (0, 1, 3):
            return digit(a == b)
        if i == 2:
            return digit((a == b) | ((kind == "v") & _same_but_a_slip(a, b)))
        if i == 4:  # a top can be any of the other clothes
            return F.when((kind == "d") & ((a == "top") | (b == "top")), UNKNOWN).otherwise(digit((a == b) | ((kind != "d") & _same_but_a_slip(a, b))))
        least = F.least(F.length(a), F.length(b))
        short = (F.left(a, F.lit(3)) == F.left(b, F.lit(3))) | ((F.right(a, F.lit(3)) == F.right(b, F.lit(3))) & (least == 3))
        given = F.when(least == 1, digit(F.left(a, F.lit(1)) == F.left(b, F.lit(1)))).when(_same_but_a_slip(a, b), "3").when(short, "2").otherwise("0")
        # letters that agree in the low 32 bits and letters that differ in the high ones, counted once for all branches
        both = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when((x == "?") | (y == "?"), 0).when(x == y, 1).when(x != y, 1 << 32).otherwise(0).cast("bigint"))
        counts = F.array(F.aggregate(both, F.lit(0).cast("bigint"), lambda n, x: n + x))

        def counted(n: Column) -> Column:
            right, wrong = n.bitwiseAND(0xFFFFFFFF), F.shiftright(n, 32)
            return F.when(right + wrong < 2, UNKNOWN).when(wrong == 0, F.when(right >= 5, "3").otherwise("2")).when((wrong == 1) & (right >= 4), "1").otherwise("0")

        plate = F.when((a == b) & (F.length(F.replace(a, F.lit("?"))) >= 5), "3").otherwise(F.get(F.transform(counts, counted), F.lit(0)))
        return F.when(kind == "n", given).when(kind == "v", plate).otherwise(digit(a == b))

    known = lambda i: F.col(f"{SLOTS[i]}_a").isNotNull() & F.col(f"{SLOTS[i]}_b").isNotNull() & (one if i >= 4 else F.lit(True))
    gap, near_by = F.abs(F.col("age_a") - F.col("age_b")), F.greatest("tolerance_a", "tolerance_b")
    age = F.when(gap <= near_by, "2").when(gap <= 2 * near_by + F.least("tolerance_a", "tolerance_b"), "1").when(gap.isNotNull(), "0").otherwise(UNKNOWN)
    return F.concat(*[F.when(known(i), level(i)).otherwise(UNKNOWN) for i in range(len(SLOTS))], age)


def compared(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ra, rb, setting, a, b, kind, pattern) of all nodes of one label in two reports of different sources."""
    cols = [c for c in nodes.columns if c not in ("report", "id")]
    side = lambda s: nodes.select(F.col("report").alias(f"r{s}"), F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in cols])
    # both sides by report alone, so that one shuffle of nodes serves both: labels that are equal as a range are no key
    one_label = F.col("label_b").between(F.col("label_a"), F.col("label_a"))
    both = pairs.join(side("a"), "ra").join(side("b"), "rb").where(one_label & (F.col("source_a") != F.col("source_b")))
    kind = F.when(F.col("label_a") == "Person", F.concat(F.least("kind_a", "kind_b"), F.greatest("kind_a", "kind_b"))).otherwise(F.col("kind_a"))
    return both.select("ra", "rb", _setting().alias("setting"), "a", "b", kind.alias("kind"), _pattern().alias("pattern"))


class Weights:
    """Match and non-match frequencies by expectation maximisation over counted patterns: rows (kind, pattern, pairs)."""

    def __init__(self, counted: list[tuple[str, str, int]], strength: float = 20.0, tolerance: float = 1e-4, rounds: int = 500) -> None:
        self.share = dict.fromkeys(CLASSES, FIRST_SHARE)
        self.tables = {(self._group(k, c), c): [list(side) for side in first] for k in CLASSES for c, first in _attributes(k).items()}
        first = {key: [list(side) for side in t] for key, t in self.tables.items()}
        moved, n = 1.0, 0
        while moved > tolerance and n < rounds:
            n += 1
            sums = {key: [[strength * x for x in side] for side in t] for key, t in first.items()}
            matched = {k: [strength * FIRST_SHARE, strength] for k in CLASSES}
            for kind, pattern, count in counted:
                p = self.chance(kind, pattern)
                matched[kind][0] += p * count
                matched[kind][1] += count
                for c, i in _places(kind):
                    if (level := pattern[i]) != UNKNOWN:
                        table = sums[self._group(kind, c), c]
                        table[0][int(level)] += p * count
                        table[1][int(level)] += (1 - p) * count
            share = {k: min(0.9, max(0.001, x / y)) for k, (x, y) in matched.items()}
            moved = max(abs(share[k] - self.share[k]) for k in share)
            self.share = share
            self.tables = {key: [[x / sum(side) for x in side] for side in t] for key, t in sums.items()}

    @staticmethod
    def _group(kind: str, attribute: str) -> str:
        return "P" if attribute in PERSON and kind in PERSONS else kind

    def evidence(self, kind: str, pattern: str) -> float:
        """Log of how much more likely the pattern is among matches than among others."""
        w = 0.0
        for c, i in _places(kind):
            if (level := pattern[i]) != UNKNOWN:
                m, u = self.tables[self._group(kind, c), c]
                w += max(-9.0, min(9.0, math.log(m[int(level)] / u[int(level)])))
        return w

    def chance(self, kind: str, pattern: str) -> float:
        return _sure(self.evidence(kind, pattern) + math.log(self.share[kind] / (1 - self.share[kind])))


def _sure(x: float) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def _first_chance(setting: str) -> float:
    """That two reports tell of one incident, before anything is counted."""
    gap, town, street, crossing = setting
    x = {"a": 2.5, "b": 2.0, "c": -3.0, "-": -2.0}[gap] + {"1": 1.5, "-": 0.0, "0": -7.0}[town] + {"1": 0.0, "-": -2.0, "0": -6.0}[street] + {"1": 1.0, "-": 0.0, "0": -2.0}[crossing]
    return _sure(x)


class Settings:
    """How often two reports of a setting tell of one incident, by expectation maximisation over rows (setting, evidence in tenths, pairs)."""

    def __init__(self, counted: list[tuple[str, int, int]], strength: float = 500.0, tolerance: float = 1e-5, rounds: int = 500) -> None:
        by = defaultdict(list)
        for s, e, n in counted:
            by[s].append((math.exp(e / 10), n))
        self.chance = {}
        for s, rows in by.items():
            p, first, moved, i = _first_chance(s), _first_chance(s), 1.0, 0
            while moved > tolerance and i < rounds:
                i += 1
                new = (strength * first + sum(n * p * e / (p * e + 1 - p) for e, n in rows)) / (strength + sum(n for _, n in rows))
                moved, p = abs(new - p), new
            self.chance[s] = min(0.9999, max(1e-6, p))


def scored_pairs(nodes: DataFrame, block: int = 200, least: float = -8.0) -> DataFrame:
    """(a, b, source_a, source_b, w): candidates with their log odds; source_a < source_b hold the reports of a and b.

    A pair at ``least`` can move the log odds of a rival by exp(least) at most, so those below are left out.
    """
    spark = nodes.sparkSession
    pairs = materialize(compared(nodes, report_pairs(nodes, block)), "compared")
    near_ = F.left("setting", F.lit(1)).isin("a", "b")
    # as many rows as there are patterns, whatever the number of pairs
    patterns = [tuple(r) for r in pairs.groupBy("kind", "pattern").agg(F.sum(near_.cast("int")).alias("near")).collect()]
    weights = Weights([r for r in patterns if r[2]])
    table = spark.createDataFrame([(k, p, weights.evidence(k, p), weights.chance(k, p)) for k, p, _ in patterns] or [("", "", 0.0, 0.5)], "kind string, pattern string, evidence double, chance double")
    pair, one = Window.partitionBy("ra", "rb"), Window.partitionBy("ra", "rb", "a")
    # for each node one of the things that the other report can mean, or none of them; the same thing may also turn up in another incident
    told = pairs.where("a <> b").join(F.broadcast(table), ["kind", "pattern"]).repartition("ra", "rb").withColumns({"like": F.avg(F.exp("evidence")).over(one), "of_a": F.count("*").over(one)})
    e = (F.log(0.5 + 0.5 * F.col("like")) - F.log(1 - AGAIN + AGAIN * F.col("like"))) / F.col("of_a")
    told = told.withColumns({"of_pair": F.count("*").over(pair), "tenths": F.round(F.least(F.greatest(F.sum(e).over(pair), F.lit(-30.0)), F.lit(30.0)) * 10).cast("int")})
    told = materialize(told.select("ra", "rb", "a", "b", "setting", "chance", "tenths", "of_pair"), "incidents")
    discard(pairs)
    counted = told.groupBy("setting", "tenths").agg(F.sum(1 / F.col("of_pair")).alias("n"))
    settings = Settings([tuple(r) for r in counted.collect()])
    chances = spark.createDataFrame(list(settings.chance.items()) or [("", 0.5)], "setting string, before double")
    odds = F.col("before") / (1 - F.col("before")) * F.exp(F.col("tenths") / 10)
    both = told.join(F.broadcast(chances), "setting").withColumn("p", odds / (1 + odds) * F.col("chance"))
    return both.select("a", "b", F.col("ra").alias("source_a"), F.col("rb").alias("source_b"), F.log(F.col("p") / (1 - F.col("p") + 1e-12)).alias("w")).where(F.col("w") > least)


def propagate(scored: DataFrame, rounds: int = 200, tolerance: float = 0.05) -> DataFrame:
    """(a, b, confidence) by loopy belief propagation over (a, b, source_a, source_b, w), source_a < source_b.

    ``from_a`` is the message of the factor (a, source_b) to the pair, ``from_b`` that of (b, source_a); what a pair tells one
    factor is its evidence with the message of the other. Reports are ``source_a`` and ``source_b``, as of ``scored_pairs``.
    A factor with one pair sends nothing, so only pairs in a factor of two or more exchange messages; the others keep their own evidence.
    Steps become shorter from the tenth round on, so that what swings comes to rest; if messages still move by ``tolerance`` after ``rounds``, it is an error.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            a, b, ra, rb, w = (t.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "source_a", "source_b", "w"))
            group = np.cumsum(np.r_[False, (ra[1:] != ra[:-1]) | (rb[1:] != rb[:-1])])  # pairs stand in order of their reports
            factor_a, factor_b = _numbered(group, a), _numbered(group, b)
            busy = (np.bincount(factor_a)[factor_a] > 1) | (np.bincount(factor_b)[factor_b] > 1)
            belief = w.copy()
            belief[busy] = _beliefs(_numbered(group[busy]), _numbered(factor_a[busy]), _numbered(factor_b[busy]), w[busy], rounds, tolerance)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(belief)], ["a", "b", "belief"])

    # every factor lies within two reports, so its messages do, too: they are exchanged where the pairs of both are
    state = scored.select("a", "b", "source_a", "source_b", "w").repartition("source_a", "source_b").sortWithinPartitions("source_a", "source_b", "a", "b")
    kinds = dict(scored.dtypes)
    settled = state.mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}, belief double")
    return settled.select("a", "b", (1 / (1 + F.exp(-F.col("belief")))).alias("confidence"))


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int = 50_000) -> Iterator[pa.Table]:
    """Tables of about ``least`` rows from batches in order of their reports; no two reports are split."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) < least:
            continue
        t = pa.concat_tables(held)
        ra, rb = (t.column(c).to_numpy(zero_copy_only=False) for c in ("source_a", "source_b"))
        last = int(np.argmax((ra == ra[-1]) & (rb == rb[-1])))
        if last:
            yield t.slice(0, last)
        held = [t.slice(last)]
    if sum(t.num_rows for t in held):
        yield pa.concat_tables(held)


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """The number of each row's combination of values."""
    out = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        values = np.unique(c, return_inverse=True)[1]
        out = np.unique(out * (values.max(initial=0) + 1) + values, return_inverse=True)[1]
    return out


def _beliefs(group: np.ndarray, factor_a: np.ndarray, factor_b: np.ndarray, w: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    """Log odds after all messages: each group of pairs goes on until its own messages rest, whatever stands beside it, so parting rows otherwise changes nothing.

    Rest is a 50th of ``tolerance``; only what moves by ``tolerance`` after all rounds is an error.
    """
    from_a, from_b = np.zeros(len(w)), np.zeros(len(w))
    at = np.arange(len(w))  # the pairs whose messages still move

    def rest(told: np.ndarray, factor: np.ndarray) -> np.ndarray:
        return -np.log1p(np.maximum(np.bincount(factor, told)[factor] - told, 0.0))

    for n in range(rounds):
        step = 0.5 if n < 10 else 5.0 / n
        old_a, old_b = from_a[at], from_b[at]
        new_a = rest(np.exp(np.minimum(w[at] + old_b, 50.0)), factor_a[at]) * step + old_a * (1 - step)
        new_b = rest(np.exp(np.minimum(w[at] + old_a, 50.0)), factor_b[at]) * step + old_b * (1 - step)
        from_a[at], from_b[at] = new_a, new_b
        moved = np.zeros(group.max(initial=-1) + 1)
        np.maximum.at(moved, group[at], np.maximum(np.abs(new_a - old_a), np.abs(new_b - old_b)))
        at = at[moved[group[at]] >= tolerance / 50]
        if not len(at):
            break
    if len(at) and moved.max() >= tolerance:
        raise RuntimeError(f"beliefs still move by {moved.max()} after {rounds} rounds")
    return w + from_a + from_b


def told_nodes(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Every node's attributes with its report, slips put right; written."""
    features = materialize(node_features(nodes, sources), "features")
    slips = materialize(spellings(features), "slips")
    told = materialize(reports(_corrected(features, slips)), "told")
    discard(features)
    discard(slips)
    return told


def same_things(nodes: DataFrame, sources: DataFrame, least_confidence: float = 0.5) -> DataFrame:
    """(id_a, id_b, confidence): pairs of nodes that are one real thing."""
    found = propagate(scored_pairs(told_nodes(nodes, sources))).where(F.col("confidence") >= least_confidence)
    return found.groupBy(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).agg(F.max("confidence").alias("confidence"))
