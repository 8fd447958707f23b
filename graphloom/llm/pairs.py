"""Defective question and answer pairs: empty, copied, refusal, wrong_language, truncated.

Copies are found by compression: the answer is compressed by zstandard with its question as a raw
dictionary, and a copy leaves next to nothing. Languages and refusals go by dictionaries. Whether an answer
without a final stop breaks off is decided by a terminal-context model: over all answers of the
corpus it counts, for each two words in a row, how often an answer ends there, how often it goes on,
and how often the second word is only the beginning of a longer one in that place. The counts are
combined per batch before the shuffle, so that a context in a third of all answers is one counter;
only answers without a final stop look theirs up.

Defined cases: null, blank or filler answers are empty, whatever the question; a null question has no copy and no
language; a pair gets the first of empty, copied, refusal, wrong_language, truncated that holds; repeated deliveries of a
(thread_id, step) give one row a defect; unreadable JSON gives no pairs; questions and answers pair by position, a missing answer is
null; very short answers have no language; quoted words do not count for language.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.store import materialize

STATE = "question string, answer string, questions array<struct<question:string>>, user_answers array<string>"

# Answers that only say that nothing was entered.
FILLERS = frozenset(
    "n a|na|none|null|nil|nan|no answer|not answered|unanswered|no response|no reply|not provided|not given|not entered|nothing entered|left blank|blank|empty|tbc|tbd|unspecified|missing|"
    "no data|no entry|no input|no text|not available|not applicable|undefined|keine angabe|keine antwort|k a|leer|ohne angabe|pas de réponse|aucune réponse|vide|non renseigné|sin respuesta|vacío|sin contestar|ninguna|nessuna risposta|vuoto".split("|"))
# How speakers decline, by language; matched in texts without case and with plain apostrophes.
REFUSALS = (
    r"\b(?:can ?not|can'?t|could not|couldn'?t|won'?t|will not|unable to|not able to|not allowed to|not permitted to|not at liberty to|must not|may not|not going to|not willing to|not authori[sz]ed to|refuse to|decline to|rather not|not wish to|not want to|don'?t want to|prefer not to|chose not to|choose not to) (?:\w+ ){0,2}?(?:help|assist|answer|respond|reply|comment|discuss|say anything|share|disclose|provide|give (?:\w+ ){0,2}?(?:details|information|answer)|talk|speak|tell you)\b",
    r"\brather not say\b|\bprefer not to say\b|\bdecline to (?:answer|comment)\b|\b(?:must|have to|i) decline\b|\bno comment\b|\bnothing to say\b|\bremain silent\b|\bstay silent\b|\bkeep that to myself\b|\bget no answer from me\b|\bpass on th(?:is|at) question\b",
    r"\bnot something i (?:can|may|will) (?:\w+ )?(?:talk|speak|answer|discuss|comment|help)|\boutside (?:of )?what i can\b|\bbeyond what i can\b|\bi refuse\b|\bnot to say anything about\b|\bi am not allowed\b|\bi'?m not allowed\b|\bagainst (?:my|the) (?:guidelines|policy)\b|\bi plead the fifth\b",
    r"\bkein(?:en)? kommentar\b|\bkeine (?:auskunft|angaben?|antwort|aussage)\b.{0,20}\b(?:geben|machen)|\b(?:kann|darf|möchte|will|werde|dürfen|können)\b.{0,40}\b(?:keine (?:auskunft|angaben?|aussage)|nicht (?:\w+ )?(?:beantworten|antworten|äußern|helfen|sprechen|sagen|aussagen))|\bverweigere\b.{0,20}\baussage|\bdazu (?:sage|äußere) ich (?:mich )?nicht",
    r"\bsans commentaire\b|\bpas de commentaire\b|\brefuse de (?:répondre|commenter|parler)|\bpréfère ne (?:pas|rien)\b|\bne (?:peux|puis|souhaite|veux|suis)\b.{0,30}\b(?:répondre|aider|parler|commenter|communiquer|donner|autorisée?)|\bje n'ai rien à (?:dire|déclarer)|\bje garde le silence",
    r"\bsin comentarios\b|\bme niego a\b|\bprefiero no\b|\bno (?:puedo|debo|quiero|deseo|voy a|se me permite|me está permitido|estoy autorizad[oa] a)\b.{0,30}\b(?:responder|contestar|ayudar|hablar|comentar|decir|dar|compartir|revelar)|\bno tengo nada que (?:decir|declarar)|\bguardar? silencio",
    r"\bno comment\b|\bnessun commento\b|\bpreferisco non\b|\bnon (?:posso|voglio|intendo|desidero)\b.{0,30}\b(?:rispondere|aiutare|parlare|commentare|dire|fornire)|\bmi rifiuto\b",
)
# Words that tell the languages apart.
LANGUAGE_WORDS = {
    "en": "the and was were with it that this there is are had have has not but of to in on at from for who what which how did do does you your my me we they he she him her his i could would about because after before near where when then no one just so very am be been an or if out right nobody somebody saw close went more".split(),
    "de": "der die das und ist war waren nicht ein eine einen einem einer dem den des im von mit auf für zu zur zum sich dann nach noch auch bei am es er sie ich wir ihr hatte hat habe haben wie was wer wo wohin wann welche welcher gab weil denn kenne aber schon um uhr eben kam kamen aus dort niemand weiß genau bog fuhr weiter konnte wurde jemand keine".split(),
    "fr": "le les des du et est était une un ne pas dans qui sur pour il elle elles au aux avec je mais très j'ai c'est c'était quand où comment quelle quel avez vous nous deux sont sorties venait venais parce sur dans l'heure l'arrière d'autre personne moi tout suite après être a-t-il y avait de la".split(),
    "es": "el los las del y era es no con por para su al lo estaba que una un en más muy pero porque cuando dónde cómo quién qué cuál había hubo usted yo mi me se fue hacia todo nada nadie después unos sobre iba tenía salieron llamó recuerdo diría ningún de la".split(),
    "it": "il lo gli una uno di è era non che con per del della nel sono ho ha alla dopo verso quando dove come chi cosa perché anche ma molto più si le un la".split(),
}
_WORDS_OF = {k: frozenset(v) for k, v in LANGUAGE_WORDS.items()}
_REFUSAL = re.compile("|".join(f"(?:{p})" for p in REFUSALS))
_TOKEN = re.compile(r"[^\W_]+(?:['-][^\W_]+)*")
_QUOTED = re.compile(r"[\"“„«»‘‚](?:[^\"”“«»’\n]{1,120})[\"”“»«’]")
_STOPPED = re.compile(r"[.!?…。！？][\"'”’»)\]]*\s*$")
_SAID_MORE = re.compile(r"\b(?:but|however|aber|mais|pero)\b")


def plain(text: str) -> str:
    """Without case, with plain apostrophes and single blanks."""
    return " ".join(unicodedata.normalize("NFC", text).casefold().replace("’", "'").replace("‘", "'").split())


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    words = _TOKEN.findall(answer.casefold())
    return not words or " ".join(words) in FILLERS


LEVEL, FRAME = 19, 9  # of zstandard, and the bytes of its empty frame


def compressed_rest(question: str, answer: str) -> int:
    """Bytes that zstandard needs for the answer beyond an empty frame when it knows the question."""
    import zstandard as z

    known = z.ZstdCompressionDict(question.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
    codec = z.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(codec.compress(answer.encode())) - FRAME


def is_copy(question: str | None, answer: str) -> bool:
    """Nothing but the question again: next to nothing left after compression, and no words of its own."""
    if not question:
        return False
    q, a = " ".join(_TOKEN.findall(plain(question))), " ".join(_TOKEN.findall(plain(answer)))
    if not q or not a:
        return False
    # the dictionary must hold more than a few bytes to be searched
    if compressed_rest((q + " ") * 4, a) > 18 + len(a) // 5:
        return False
    asked, said = Counter(q.split()), Counter(a.split())
    # the question said twice is still nothing else
    own, gone = [w for w in said.elements() if w not in asked], list((asked - said).elements())
    lead = [w for w in own if w not in ("q", "question", "frage", "pregunta", "you", "asked", "sie", "fragten")]
    if not lead:
        return sum(map(len, gone)) <= max(4, len(q) // 6)
    # what is left over on both sides may be slips of the pen only
    return len(lead) <= 2 and abs(len(q) - len(a)) <= 3 and sum(_slip(w, gone) for w in lead) == len(lead)


def _slip(word: str, others: list[str]) -> bool:
    import difflib

    return any(difflib.SequenceMatcher(None, word, o, autojunk=False).ratio() >= 0.6 or sorted(word) == sorted(o) for o in others) or any(word in o or o in word for o in others)


def is_refusal(answer: str) -> bool:
    text = plain(answer)
    hit = _REFUSAL.search(text)
    if not hit:
        return False
    # declining one thing and then stating another is an answer
    after = _SAID_MORE.search(text, hit.end())
    return not (after and len(text) - after.end() > 12 and not _REFUSAL.search(text, after.end()))


def language(text: str | None, least: int = 2) -> tuple[str | None, Counter]:
    """The language with most dictionary words, if it leads, and the counts."""
    words = _TOKEN.findall(plain(_QUOTED.sub(" ", text))) if text else []
    counts = Counter({k: sum(w in known for w in words) for k, known in _WORDS_OF.items()})
    (best, n), (_, second) = counts.most_common(2)
    return (best if n >= least and n > second else None), counts


def is_other_language(question: str | None, answer: str) -> bool:
    asked, _ = language(question)
    said, counts = language(answer, 3)
    return bool(asked and said and asked != said and counts[asked] <= 0.5 * counts[said])


NAMED = "*"  # any word with a capital, for names that are too rare to be counted each


def contexts(answer: str) -> list[tuple[str, str]]:
    """(event, context) of every word of an answer: goes on, ends, or begins a longer word."""
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+", answer.strip()):
        written = _TOKEN.findall(sentence.replace("’", "'"))
        words = [_shape(w) for w in written]
        for i, w in enumerate(words):
            before = words[i - 1] if i else "^"
            event = "end" if i + 1 == len(words) else "on"
            out.append((event, f"{before} {w}"))
            if i > 1:
                out.append((event, f"{words[i - 2]} {before} {w}"))
                if written[i][0].isupper():
                    out.append((event, f"{words[i - 2]} {before} {NAMED}"))
            out += [("part", f"{before} {w[:k]}") for k in range(1, min(len(w), 12)) if not w[0].isdigit()]
    return out


def _shape(word: str) -> str:
    return re.sub(r"\d+", "9", word.casefold())


def last_context(answer: str) -> str | None:
    """The context of the last word, or None where the answer ends as a sentence, number or address ends."""
    text = answer.rstrip()
    if _STOPPED.search(text):
        return None
    if text[-1] in ",;:(\"„“«-–—" or text.endswith(" '"):
        return "!"
    words = re.split(r"(?<=[.!?])\s+", text)[-1].replace("’", "'")
    if "@" in words.split()[-1] or re.search(r"[\d)\]] ?(?:please)?$", text) and re.search(r"\d[\d ()+./-]{6,}$|@", text):
        return None
    found = _TOKEN.findall(words)
    if not found:
        return None
    words = [_shape(w) for w in found[-3:]]
    return " ".join(["^"] * (len(found) == 1) + words + [NAMED] * (len(found) > 2 and found[-1][0].isupper()))


def defect_of(question: str | None, answer: str | None) -> tuple[str | None, str | None]:
    """(defect, context to look up where no other defect holds)."""
    if is_empty(answer):
        return "empty", None
    if is_copy(question, answer):
        return "copied", None
    if is_refusal(answer):
        return "refusal", None
    if is_other_language(question, answer):
        return "wrong_language", None
    context = last_context(answer)
    return ("truncated", None) if context == "!" else (None, context)


def answer_pairs(states: DataFrame) -> DataFrame:
    """(thread_id, step, item, question, answer) of all states with questions."""
    s = states.select("thread_id", "step", "node", F.from_json("state", f"{STATE}, _unread string", {"columnNameOfCorruptRecord": "_unread"}).alias("s")).where("s is not null and s._unread is null")
    none = F.array().cast("array<string>")
    both = F.arrays_zip(F.coalesce(F.transform("s.questions", lambda q: q["question"]), none).alias("question"), F.coalesce("s.user_answers", none).alias("answer"))
    single = F.array(F.struct(F.col("s.question").alias("question"), F.col("s.answer").alias("answer")))
    pairs = F.when(F.col("node") == "ask_user", both).when(F.col("node") == "answer", single)
    return s.select("thread_id", "step", F.posexplode(pairs).alias("item", "p")).select("thread_id", "step", "item", "p.question", "p.answer")


def _judged(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [defect_of(q, a) for q, a in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([d for d, _ in out], pa.string()), pa.array([c for _, c in out], pa.string())], ["thread_id", "step", "item", "defect", "context"])

    return pairs.mapInArrow(run, "thread_id string, step int, item int, defect string, context string")


def context_counts(answers: DataFrame) -> DataFrame:
    """(context, ends, goes_on, part) over all answers (one string column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, list[int]] = {}
            for a in b.column(0).to_pylist():
                for event, c in contexts(a):
                    seen.setdefault(c, [0, 0, 0])[("end", "on", "part").index(event)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *[pa.array([v[i] for v in seen.values()], pa.int64()) for i in range(3)]], ["context", "ends", "goes_on", "part"])

    rows = answers.mapInArrow(run, "context string, ends bigint, goes_on bigint, part bigint")
    return rows.groupBy("context").agg(*[F.sum(c).alias(c) for c in ("ends", "goes_on", "part")])


def defective_pairs(pairs: DataFrame, least_end_share: float = 0.3) -> DataFrame:
    """(thread_id, step, item, defect) of the defective ones of (thread_id, step, item, question, answer)."""
    judged = materialize(_judged(pairs.select("thread_id", F.col("step").cast("int"), F.col("item").cast("int"), "question", "answer")), "judged")
    known = judged.where("defect is not null").select("thread_id", "step", "item", "defect")
    open_ = judged.where("defect is null and context is not null").select("thread_id", "step", "item", "context")
    counts = context_counts(pairs.where("answer is not null and answer <> ''").select("answer"))
    # three words where the corpus has them often enough, else the last two, else the two before with any name in the last one's place
    named = F.endswith("context", F.lit(f" {NAMED}"))
    words = F.split(F.when(named, F.expr("left(context, length(context) - 2)")).otherwise(F.col("context")), " ")
    before = F.when(named, F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1)), F.lit(NAMED)))
    forms = F.array_compact(F.array_distinct(F.array(F.array_join(words, " "), F.array_join(F.slice(words, -2, 2), " "), before)))
    asked = open_.select("thread_id", "step", "item", F.explode(forms).alias("context"))
    n = F.col("ends") + F.col("goes_on")
    often, size = n >= 4, F.size(F.split("context", " "))
    rank = F.when(F.endswith("context", F.lit(f" {NAMED}")), F.when(often, 1)).when(size > 2, F.when(often, 3)).otherwise(F.when(often, 2).otherwise(0))
    broken = (F.col("ends") < least_end_share * n) | (F.col("part") > 4 * n)
    told = asked.join(counts, "context").where(rank.isNotNull()).groupBy("thread_id", "step", "item").agg(F.max_by(broken, rank).alias("broken"))
    late = told.where("broken").select("thread_id", "step", "item", F.lit("truncated").alias("defect"))
    return known.unionByName(late).distinct()
