"""Defective pairs, personal information and entity matching: cases, held-out accuracy, and brute force for propagation."""

import itertools
import json
import math
import random
import re
from collections import Counter

import pytest

from graphloom.llm import entities, pairs, privacy

SOUND = [("What colour was the vehicle?", "What colour was the vehicle? It was red, and the roof looked lighter."), ("Where did it go?", "I am unable to walk far, so I watched from the bench."), ("Which way did it go?", "I can't say which way it went after that, a van blocked my view, but the car was red."),
         ("What did you hear?", 'He shouted "Vorsicht, zurück!" and then the van hit the pushchair.'), ("When?", "14:10, give or take a few minutes"), ("Was it dark?", "Yes."), ("Who was it?", "I don't know, it was too dark to see."), ("Welche Farbe hatte das Fahrzeug?", "Der Wagen war dunkel, vermutlich blau."), (None, "It was red.")]
BAD = [("Where?", None, "empty"), ("Where?", "  \n", "empty"), ("Where?", "[no answer]", "empty"), ("Where?", "n/a", "empty"), (None, "-", "empty"), ("What did the man look like?", "WHAT DID THE MAN LOOK LIKE", "copied"), ("What did the man look like?", "Q: What did th man look like?", "copied"),
       ("Who?", "I'm sorry, but I can't help with that.", "refusal"), ("Who?", "Kein Kommentar.", "refusal"), ("Qui ?", "Je préfère ne pas répondre à cette question.", "refusal"), ("Who else saw what happened?", "Era azul oscuro, lo recuerdo porque estaba debajo de la farola.", "wrong_language"),
       ("Wer hat den Vorfall noch gesehen?", "It was a little after nine, because the bus had just left.", "wrong_language")]


def rows_of(spark, items):
    return spark.createDataFrame([("t", i, 0, q, a, "x") for i, (q, a) in enumerate(items)], "thread_id string, step int, item int, question string, answer string, defect string")


def test_pair_cases(spark):
    filler = [("Where did it go?", "It went south and turned into Tandry Road at the end.")] * 6 + [("How far?", "14:10, give or take a few minutes")] * 3
    items = SOUND + [b[:2] for b in BAD] + filler + [("Where did it go?", "It went south and turned into"), ("Where did it go?", "It went so"), ("Where did it go?", "It went south, ("), ("Where did it go?", "It went south and turned into Tandry Road at the end")]
    got = {r["step"]: r["defect"] for r in pairs.defective_pairs(rows_of(spark, items)).collect()}
    n = len(SOUND) + len(BAD) + len(filler)
    assert got == {len(SOUND) + i: b[2] for i, b in enumerate(BAD)} | {n: "truncated", n + 1: "truncated", n + 2: "truncated"}
    assert pairs.defective_pairs(rows_of(spark, items).limit(0)).count() == 0


def test_states_are_read_by_position(spark):
    states = [("a", 0, "answer", '{"question": "Who?", "answer": null}'), ("a", 1, "ask_user", json.dumps({"questions": [{"gap_id": "g", "question": "Who?"}, {"gap_id": "g", "question": "When?"}], "user_answers": ["", None]})), ("a", 1, "ask_user", '{"questions":[{"question":"Who?"},{"question":"When?"}],"user_answers":["",null]}'),
              ("b", 0, "answer", "{broken"), ("b", 1, "load", "{}"), ("b", 2, "ask_user", '{"questions": null}'), ("b", 3, "answer", None)]
    found = pairs.defective_pairs(pairs.answer_pairs(spark.createDataFrame([(*s, 1) for s in states], "thread_id string, step int, node string, state string, item int")))
    assert {tuple(r) for r in found.collect() if r["thread_id"] == "a"} == {("a", 0, 0, "empty"), ("a", 1, 0, "empty"), ("a", 1, 1, "empty")}


TOLD = [("You can mail me under rosa underscore wexl at quickpost dot example, I read it daily.", {("email", "rosa underscore wexl at quickpost dot example")}), ("cc: a.b+c@x-y.test; d [at] e.example", {("email", "a.b+c@x-y.test"), ("email", "d [at] e.example")}),
        ("Call +44 (0)7700 900-230 or zero seven seven zero zero nine zero zero six six one.", {("phone", "+44 (0)7700 900-230"), ("phone", "zero seven seven zero zero nine zero zero six six one")}), ("Somebody had rung 999 at 14:01:12, log INC-4436, order 155-854.", set()),
        ("Driver: Dr Corvinard; NI no. QQ559790A; 130 Delmere Way, Drevunholm.", {("name", "Corvinard"), ("id_number", "QQ559790A"), ("address", "130 Delmere Way, Drevunholm")}), ("My social security number 979-33-3323 is on the form.", {("id_number", "979-33-3323")}),
        ("I live at Flat 12, 149 Corridge Parade, Grisunmouth, CA3 5ZK, which looks out.", {("address", "Flat 12, 149 Corridge Parade, Grisunmouth, CA3 5ZK")}), ("I walked along Tandry Road near number 6.", set()), ("Vivo en Pellerweg 119, 40123 Farathdale.", {("address", "Pellerweg 119, 40123 Farathdale")}),
        ("I was with P. Tarnolan, who saw it as well.", {("name", "P. Tarnolan")}), ("The van was hired by ADELE RENDLOVA on Monday.", {("name", "ADELE RENDLOVA")}), ("The Corvane Pilot stopped in Bramunminster.", set()), ("J'étais avec Omar Teskeather ce jour-là.", {("name", "Omar Teskeather")})]


@pytest.mark.parametrize("text,want", TOLD)
def test_personal_information(text, want):
    assert {(k, text[a:b]) for a, b, k in privacy.find_pii(text)} == want


def test_replacing_keeps_form_and_coreference(spark):
    made = privacy.Surrogates(b"key")
    text = "My name is Rosa Wexlova. Ms Wexlova can be reached on 07700 900230 or rosa@x.example. KEVIN TARNBY took my details at 9:10. Rosa Wexlova left."
    out = made.replace(text)
    spans = privacy.find_pii(text)
    assert not any(text[a:b] in out for a, b, _ in spans)
    first = out.split("My name is ")[1].split(".")[0]
    assert out.count(first) == 2 and first.split()[0] in privacy.FEMALE.split() and "@" in out and made.replace(text) == out != privacy.Surrogates(b"other").replace(text)
    assert " took my details" in out and out.split(" took my")[0].split(". ")[-1].isupper()
    masked = made.replace(text, True)
    assert masked.count("[NAME_") == 4 and "[PHONE_" in masked and "[EMAIL_" in masked and "took my details at 9:10" in masked
    many = " ".join(f"I was with Rosa Wexl{x}{y}va, who saw it." for x, y in itertools.product("aeiou", "bdfgk"))
    names = [many[a:b] for a, b, _ in privacy.find_pii(many)]
    got = made.replace(many)
    assert len(names) == 25 and len({got.split("I was with ")[i + 1].split(",")[0] for i in range(25)}) == 25
    states = spark.createDataFrame([("t", 1, "ask_user", json.dumps({"user_answers": ["I was with P. Tarnolan, who saw it.", None, "", "I was with P. Tarnolan, who saw it. P. Tarnolan left."], "raw_statement": None}), 1), ("t", 1, "ask_user", "{", 1), ("u", 0, "x", None, 1)], "thread_id string, step int, node string, state string, pii int")
    found = privacy.pii_rows(privacy.state_texts(states))
    assert {tuple(r) for r in found.collect()} == {("t", 1, "user_answers", 0, "name", "P. Tarnolan"), ("t", 1, "user_answers", 3, "name", "P. Tarnolan")}
    assert privacy.pii_replaced(privacy.state_texts(states), b"k").count() == 2
    assert privacy.find_pii(None) == privacy.find_pii("") == [] and privacy.find_pii("x " * 100_000) == []


NODE = "id bigint, labels array<string>, label string, props map<string,string>, source string, extracted_at string, hours int"


def person(i, source, text, at="2024-05-01T10:00:00Z", label="Person", **props):
    return (i, [label], label, {"name_or_description" if label == "Person" else "description": text, **props}, source, at, 1)


def test_entities(spark):
    rows = [
        person(1, "a", "Tara Ludwolan, the eyewitness near Rasridge Hill, Narbelport", role="witness", age_estimate="41"), person(2, "b", "Ludwolan, Tara (onlooker) at Rasrige Hill in Narbelport", "2024-05-01T20:00:00Z", role="witness", age_estimate="40s"), person(3, "b", "Colin Teskick, victim at Rasridge Hill, Narbelport", role="victim"),
        person(4, "a", "Short man in navy anorak at Rasridge Hill, Narbelport", gender="m"), person(5, "c", "Male, not tall, slim, bluish top near Rasridge Hill in Narbelport", gender="male"), person(6, "c", "Woman in a red coat (1.88 m), Rasridge Hill", gender="f"),
        person(7, "a", "Black pickup, plate LY24 LNX near Rasridge Hill", label="Vehicle", colour="black"), person(8, "b", "very dark flatbed with a tow bar at Rasridge Hill, Narbelport", label="Vehicle", registration="??24 LNX"), person(9, "d", "Black pickup, plate LY24 LNX near Corner Lane, Oskasholm", "2025-01-01T00:00:00Z", label="Vehicle"),
        person(10, "a", "a suitcase with a torn strap (violet) on Fenton Parade", label="Object"), person(11, "b", "plum suitcase with mud on it at Fenton Parade", label="Object"), person(12, "a", "plum suitcase with mud on it at Fenton Parade", label="Object"), person(1, "a", "Tara Ludwolan, the eyewitness near Rasridge Hill, Narbelport", role="witness", age_estimate="41"),
        (20, None, "Person", None, "a", None, 1), (21, [], "Person", {"name_or_description": ""}, "a", None, 1), (22, [], "Person", {"name_or_description": "x" * 50_000}, None, None, 1), (23, [], "Vehicle", {"description": None}, "b", "never", 1)]
    sources = spark.createDataFrame([(s, "UTC", "en-GB") for s in "abcd"], "source_id string, tz string, locale string")
    got = {(r["id_a"], r["id_b"]) for r in entities.same_things(spark.createDataFrame(rows, NODE), sources).collect()}
    assert {(1, 2), (4, 5), (7, 8)} <= got and (7, 9) not in got and not any(3 in p or 6 in p for p in got)
    assert len({(10, 11), (11, 12)} & got) == 1  # 10 and 12 are of one source, so 11 can be only one of them
    assert entities.same_things(spark.createDataFrame([], NODE), sources).count() == 0


def test_propagation_against_enumeration(spark):
    """On a tree of factors the marginals are exact."""
    pairs_ = [(1, 11, "a", "b", 1.0), (1, 12, "a", "b", 2.0), (2, 12, "a", "b", 0.5)]
    ok = lambda x: not (x[0] and x[1]) and not (x[1] and x[2])
    weights = {x: math.exp(sum(p[4] for p, on in zip(pairs_, x) if on)) for x in itertools.product((0, 1), repeat=3) if ok(x)}
    total = sum(weights.values())
    want = [sum(w for x, w in weights.items() if x[i]) / total for i in range(3)]
    got = {(r["a"], r["b"]): r["confidence"] for r in entities.propagate(spark.createDataFrame(pairs_, "a bigint, b bigint, source_a string, source_b string, w double"), rounds=40, tolerance=1e-6).collect()}
    for p, w in zip(pairs_, want):
        assert got[p[0], p[1]] == pytest.approx(w, abs=1e-3)


def test_near():
    rnd = random.Random(1)
    for _ in range(300):
        w = "".join(rnd.choices("abcd", k=6))
        i = rnd.randrange(5)
        for v in (w[:i] + w[i + 1:], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1:], w[:i] + w[i + 1] + w[i] + w[i + 2:]):
            assert entities.near(w, v)
    assert not entities.near("abcdef", "abxyef") and not entities.near("abc", "abd") and Counter() == Counter()


def test_late_and_undated_nodes_meet_the_rest(spark):
    """p4_found: months after, without time or attribute, and with another spelling of the street."""
    rows = [
        person(1, "a", "Tara Ludwolan, the eyewitness near Ingvane Drive, Narbelport", role="witness", age_estimate="41", gender="f"), person(2, "b", "Ludwolen, Tara (onlooker) at Ingbane Drive in Narbelport", "2024-07-01T20:00:00Z", role="witness", age_estimate="40s", gender="f"),
        person(3, "a", "Short man in navy anorak at Ingvane Drive, Narbelport", gender="m", role="witness", age_estimate="52"), person(4, "c", "not tall man in anorak at Ingbane Drive in Narbelport", None, gender="male", role="witness", age_estimate="52"),
        person(5, "a", "Black pickup, plate LY24 LNX near Rasridge Hill, Narbelport", label="Vehicle", colour="black", type="pickup"), person(6, "b", "very dark saloon, plate LY24 L?X at Rasidge Hill, Narbelport", "2024-09-01T20:00:00Z", label="Vehicle", colour="black"),
        person(7, "d", "crimson tracksuit on a man at Corner Lane, Narbelport", None, gender="male")]
    sources = spark.createDataFrame([(s, "UTC", "en-GB") for s in "abcd"], "source_id string, tz string, locale string")
    told = entities.told_nodes(spark.createDataFrame(rows, NODE), sources)
    met = {tuple(sorted((r["a"], r["b"]))) for r in entities.compared(told, entities.report_pairs(told)).collect()}
    assert {(1, 2), (3, 4), (5, 6)} <= met and not any(7 in p for p in met)
    got = {(r["id_a"], r["id_b"]) for r in entities.same_things(spark.createDataFrame(rows, NODE), sources).collect()}
    assert {(1, 2), (3, 4)} <= got


def test_blocks_over_the_limit_lose_no_pair_of_a_town(spark):
    """p4_found: a block of many reports is parted by town, and reports without a town meet all."""
    rnd = random.Random(6)
    towns = ["Narbelport", "Narbelprt", "Oskasholm", "Kessomport", None]
    rows = [person(i, f"s{i % 40}", f"Man in a red coat at Fenton Road{', ' + t if t else ''}", f"2024-05-01T{i % 24:02d}:{i % 60:02d}:00Z") for i in range(120) for t in [towns[rnd.randrange(5)]]]
    sources = spark.createDataFrame([(f"s{i}", "UTC", "en-GB") for i in range(40)], "source_id string, tz string, locale string")
    told = entities.materialize(entities.told_nodes(spark.createDataFrame(rows, NODE), sources), "told")
    met = lambda block: {(r["a"], r["b"]) for r in entities.compared(told, entities.report_pairs(told, block=block)).collect() if r["setting"][1] != "0"}
    assert met(10_000) and met(10_000) == met(5)


def test_candidates_do_not_depend_on_the_size_of_a_block(spark):
    """p4_found: reports of one block meet whatever their towns, however many share it."""
    towns = ["Narbelport", "Oskasholm", "Kessomport", None]
    rows = [person(i, f"s{i % 20}", f"Man in a red coat at Fenton Road{', ' + t if t else ''}", f"2024-05-01T{i % 24:02d}:{i % 60:02d}:00Z") for i in range(60) for t in [towns[i % 4]]]
    sources = spark.createDataFrame([(f"s{i}", "UTC", "en-GB") for i in range(20)], "source_id string, tz string, locale string")
    told = entities.materialize(entities.told_nodes(spark.createDataFrame(rows, NODE), sources), "told")
    met = lambda block: sorted(tuple(r) for r in entities.report_pairs(told, block=block).collect())
    whole = met(10_000)
    assert len(whole) == len(set(whole)) == 60 * 59 // 2 and met(7) == met(40) == whole


def test_weights_are_learnt_from_counts():
    """p4_found: frequencies of a made-up population come back from the patterns alone."""
    rnd = random.Random(3)
    counted = Counter()
    for _ in range(40_000):
        same = rnd.random() < 0.4
        counted["o", "".join("1" if rnd.random() < (m if same else u) else "0" for m, u in ((0.97, 0.2), (0.9, 0.1), (0.6, 0.3)))] += 1
    w = entities.Weights([(k, p, n) for (k, p), n in counted.items()])
    assert w.share["o"] == pytest.approx(0.4, abs=0.03)
    (m, u) = w.tables["o", "type"]
    assert m[1] == pytest.approx(0.97, abs=0.02) and u[1] == pytest.approx(0.2, abs=0.03)


def test_one_to_one_factors_decide_contested_pairs(spark):
    """p4_found: two described persons could each be the named one; the one whose twin is named there as well gives way."""
    rows = [
        person(1, "a", "Tara Ludwolan, the witness near Rasridge Hill, Narbelport", role="witness", gender="f", age_estimate="41"), person(2, "b", "Tara Ludwolan, the witness near Rasridge Hill, Narbelport", role="witness", gender="f", age_estimate="41"),
        person(3, "b", "Woman in a red coat at Rasridge Hill, Narbelport", role="witness", gender="f", age_estimate="42")]
    sources = spark.createDataFrame([(s, "UTC", "en-GB") for s in "ab"], "source_id string, tz string, locale string")
    scored = entities.materialize(entities.scored_pairs(entities.told_nodes(spark.createDataFrame(rows, NODE), sources)), "scored")
    alone = {(r["a"], r["b"]): r["w"] for r in scored.collect()}
    settled = {tuple(sorted((r["a"], r["b"]))): r["confidence"] for r in entities.propagate(scored).collect()}
    (third,) = [p for p in alone if 3 in p]
    assert settled[tuple(sorted(third))] < 0.3 * 1 / (1 + math.exp(-alone[third])) and settled[1, 2] > 0.9


def test_near_words_share_variants():
    rnd = random.Random(4)
    words = {"".join(rnd.choices("abcd", k=k)) for k in range(4, 10) for _ in range(60)}
    for w in sorted(words):
        for i in range(len(w)):
            for v in (w[:i] + w[i + 1:], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1:], w[:i] + w[i + 1:i + 2] + w[i] + w[i + 2:]):
                if entities.near(w, v):
                    assert entities.variants(w) & entities.variants(v), (w, v)


def test_names_that_stand_in_a_row_are_all_found():
    """p2_found: the word before a name may look like a given name's follower."""
    assert [x[2] for x in privacy.find_pii("I spoke to James Barton and Mary Barton")] == ["name", "name"]
    made = privacy.Surrogates(b"k")
    for masked in (True, False):
        assert not {"James", "Mary", "Barton"} & set(re.findall(r"\w+", made.replace("I spoke to James Barton and Mary Barton", masked)))


def test_surrogates_are_permutations():
    """p2_replaced: no two entities share a surrogate, none stays, and script, gender, case and format are kept."""
    made = privacy.Surrogates(b"k")
    rnd = random.Random(5)
    names = {"".join(rnd.choice(a) for a in ("bcdfglmnprst", "aeiou", "lmnrst", "aeio", "nrst")).capitalize() for _ in range(4000)}
    out = {n: made.of("name", n) for n in names}
    assert len(set(out.values())) == len(names) and not any(a == b for a, b in out.items())
    phones = {f"+44 7700 {i:06d}" for i in range(0, 60_000, 29)}
    assert len({made.of("phone", p) for p in phones}) == len(phones) and all(re.fullmatch(r"\+4\d \d{4} \d{6}", made.of("phone", p)) for p in phones)
    cyrillic = made.of("name", "Иван Петров")
    assert re.fullmatch(r"[А-ЯЁ][а-яё]{3} [А-ЯЁ][а-яё]{5}", cyrillic) and cyrillic != "Иван Петров"
    assert made.of("name", "Mary Barton").split()[0].lower() in privacy.FEMALE.lower().split() and made.of("name", "JAMES BARTON").split()[0].lower() in privacy.MALE.lower().split()
    assert made.of("name", "MARY BARTON") == made.of("name", "Mary Barton").upper()
    assert made.of("email", "jane.doe@gmail.com").endswith(".example") and made.of("email", "a@x.com") != made.of("email", "a@x.org")
    assert privacy.Surrogates(b"other").of("name", "Mary Barton") != made.of("name", "Mary Barton")
    for size in (2, 3, 10, 97):
        moved = [made.moved(x, size, "t") for x in range(size)]
        assert sorted(moved) == list(range(size)) and all(a != b for a, b in enumerate(moved))
    with pytest.raises(ValueError):
        privacy.Surrogates(b"")


def test_compression_finds_copies_that_equality_does_not():
    """p6_found: the question twice, with a lead or with slips; short answers out of the question's words are sound."""
    q = "Which way did the red van go after the crash?"
    for a in (f"{q} {q}", f"Q: {q}", f"You asked: {q.upper()}", "Which way did the red van go aftr the crash", q + " " + q + " " + q):
        assert " ".join(a.split()) != q and pairs.is_copy(q, a), a
    for a in ("After the crash.", "The red van?", f"{q} It went north, past the school.", "no", "Which way did the red van go after the crash? North"):
        assert not pairs.is_copy(q, a), a


def test_states_without_answers_have_empty_ones(spark):
    """p6_found: null or short user_answers leave questions without answers, which are empty."""
    rows = [("t", 1, "ask_user", json.dumps({"questions": [{"question": "Who?"}, {"question": "When?"}], "user_answers": None})), ("t", 2, "ask_user", json.dumps({"questions": [{"question": "Who?"}, {"question": "When?"}], "user_answers": ["It was Ann."]})), ("t", 3, "answer", json.dumps({"question": "Who?", "answer": "It was Ann."})), ("t", 4, "answer", "not json")]
    found = pairs.defective_pairs(pairs.answer_pairs(spark.createDataFrame(rows, "thread_id string, step int, node string, state string")))
    assert {(r["step"], r["item"], r["defect"]) for r in found.collect()} == {(1, 0, "empty"), (1, 1, "empty"), (2, 1, "empty")}


def test_rare_names_are_judged_by_what_stands_before_them(spark):
    """p6_found: a broken name that occurs once is told by the words before it."""
    states = [("t", i, "answer", json.dumps({"question": "Which way?", "answer": f"The car went on towards Town{chr(97 + i % 26)}{chr(97 + i // 26)} without a stop."})) for i in range(200)]
    states.append(("t", 999, "answer", json.dumps({"question": "Which way?", "answer": "The car went on towards Yeldamins"})))
    found = pairs.defective_pairs(pairs.answer_pairs(spark.createDataFrame(states, "thread_id string, step int, node string, state string")))
    assert {(r["step"], r["defect"]) for r in found.collect()} == {(999, "truncated")}


def test_gates_let_through_all_that_the_patterns_match():
    """p2_found: spelled numbers without the common words, bracketed at-signs with blanks and braces, short surnames alone."""
    kinds = lambda t: [(k, t[a:b]) for a, b, k in privacy.find_pii(t)]
    for mail in ("jan{at}mail.de", "jan [ at ] mail.de", "jan (at) mail.de"):
        assert kinds(f"Write to {mail} please.") == [("email", mail)]
    for phone in ("seis uno dos tres cuatro cinco seis ocho", "oh one two three four five six eight"):
        assert kinds(f"Ring {phone} today.") == [("phone", phone)]
    assert kinds("I met James Cole, and later Cole left.") == [("name", "James Cole"), ("name", "Cole")]
    assert kinds("I met Mary Ng there.") == [("name", "Mary Ng")]


def test_pages_of_numbers_share_their_phrases():
    """p10_found: phrases that differ in prices only are one."""
    from graphloom.llm.spam import Shingler

    made = Shingler()
    a, b = made.of("cheap mattress local from 80.99 buy now"), made.of("cheap mattress local from 7.50 buy now")
    assert len(a) and set(a.tolist()) == set(b.tolist())


def test_one_shuffle_of_nodes_serves_both_reports(spark):
    """p4_found: reports a and b meet the same shuffled nodes, and what asks are few or many gives the same pairs."""
    streets = ("Rasridge Hill", "Fenton Parade")
    rows = [person(i, "abcd"[i % 4], f"{'Short man in navy anorak' if i % 3 else 'Tara Ludwolan'} at {streets[i % 2]}, Narbelport", None if i % 5 == 0 else f"2024-05-0{1 + i % 3}T10:00:00Z") for i in range(30)]
    rows += [person(30 + i, "abcd"[i % 4], f"someone in a coat at {streets[i % 2]}", None) for i in range(6)]
    sources = spark.createDataFrame([(s, "UTC", "en-GB") for s in "abcd"], "source_id string, tz string, locale string")
    told = entities.told_nodes(spark.createDataFrame(rows, NODE), sources)
    few, many = (sorted(map(tuple, entities._asked(told, small=n)[0].distinct().collect())) for n in (100_000, 0))
    assert few == many and few
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = entities.compared(told, entities.report_pairs(told))
        assert both.count() and both.collect()
        assert "ReusedExchange" in both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_plates_agree_letter_by_letter(spark):
    rnd = random.Random(7)

    def level(a, b):
        if a == b and len(a.replace("?", "")) >= 5:
            return "3"
        same = [x == y for x, y in zip(a, b) if "?" not in (x, y)]
        right, wrong = sum(same), len(same) - sum(same)
        return "-" if right + wrong < 2 else ("3" if right >= 5 else "2") if not wrong else "1" if wrong == 1 and right >= 4 else "0"

    plates = []
    for _ in range(400):
        a = "".join(rnd.choices("ab7?", k=rnd.randint(2, 8)))
        plates.append((a, "".join(c if rnd.random() < 0.8 else rnd.choice("ab7?") for c in a)[:rnd.randint(1, 8)]))
    none = ", ".join(f"cast(null as string) x{i}_{s}" for i in range(5) for s in "ab") + ", " + ", ".join(f"cast(null as int) {c}_{s}" for c in ("age", "tolerance") for s in "ab")
    frame = spark.createDataFrame(plates, "x5_a string, x5_b string").selectExpr("*", "'v' kind_a", "'v' kind_b", *none.split(", "))
    got = {(r["x5_a"], r["x5_b"]): r["p"] for r in frame.select("x5_a", "x5_b", entities._pattern().alias("p")).collect()}
    assert {p: x[5] for p, x in got.items()} == {p: level(*p) for p in plates} and set("0123-") == {x[5] for x in got.values()}


@pytest.mark.parametrize("kind", [k for k in entities._FIND if k != "vehicle"])
def test_words_of_a_kind_are_found_by_their_tokens(kind):
    rnd = random.Random(kind)
    words = [w for k in entities._KINDS.values() for w in k] + ["x", "a-", "_red", "navy-", "foot", "1", "60 m", "very", "dark", "off"]
    for _ in range(3000):
        text = "".join(rnd.choice(words) + rnd.choice((" ", " ", ", ", "-", ".", "", "(")) for _ in range(5))
        m = entities._FIND[kind].search(text)
        assert entities._first(kind, text, entities._TOKEN.findall(text)) == (m.group() if m else ""), text
