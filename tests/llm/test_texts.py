"""Splitting, encoding, leaks and spam against round trips, a reference tokenizer and brute force."""

import base64
import random
import re

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import encode, leaks, spam
from graphloom.llm.split import split_texts

WORDS = "the van turned left and stopped near a lamp post before anybody came out of house number nine".split()


def pieces(spark, texts, limit=1200, overlap=150):
    rows = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "id int, body string, piece int")
    out = {}
    for r in split_texts(rows, "body", limit, overlap).orderBy("id", "piece_no").collect():
        out.setdefault(r["id"], []).append((r["piece"], r["overlap_chars"], r["n_pieces"]))
    return out


def check(text, parts, limit, overlap):
    assert "".join(p[o:] for p, o, _ in parts) == text
    assert all(len(p) <= limit and n == len(parts) for p, _, n in parts)
    for (a, _, _), (b, o, _) in zip(parts, parts[1:]):
        assert o <= overlap and a.endswith(b[:o])


def test_splitting_loses_nothing(spark):
    rnd = random.Random(1)
    prose = lambda n, seps: "".join(" ".join(rnd.choices(WORDS, k=rnd.randrange(4, 30))).capitalize() + rnd.choice(seps) for _ in range(n))
    texts = [prose(80, [". ", "! ", "? "]), prose(80, [".\n\n", ".\r\n\r\n", ". "]), "x" * 5000, "救急車は9分後に到着しました。" * 300, "🚑" * 1201, "a" * 1200, "a" * 1201, "", None, " " * 3000, "\n" * 2500, prose(900, [". ", ".\n"]), "é" * 1500]
    got = pieces(spark, texts)
    assert 7 not in got and 8 not in got and len(got[5]) == 1 and len(got[6]) == 2
    for i, t in enumerate(texts):
        if t:
            check(t, got[i], 1200, 150)
    # text with sentences is cut at sentence ends, text with words never inside one
    assert all(re.search(r"[.!?]\s*$", p) for p, _, _ in got[0][:-1])
    assert all(p[-1].isspace() for p, _, _ in got[11][:-1])
    assert not any(p[-1] == "e" for p, _, _ in got[12][:-1])


def test_small_limits(spark):
    for limit, overlap in ((10, 0), (10, 9), (40, 15)):
        for i, parts in pieces(spark, ["one two three four five six", "abcdefghijklmnopqrstuvwxyz"], limit, overlap).items():
            check(["one two three four five six", "abcdefghijklmnopqrstuvwxyz"][i], parts, limit, overlap)
    with pytest.raises(ValueError):
        pieces(spark, ["x"], 5, 5)


RANKS = encode.read_ranks(encode.VOCABULARY)
REFERENCE = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(encode.VOCABULARY, "rb"))}, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoding_equals_the_reference(text):
    text = text.encode("utf-8", "ignore").decode()
    assert encode.Encoder(RANKS).text(text) == REFERENCE.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é漢", min_size=1, max_size=300))
def test_heap_and_scan_merge_alike(text):
    raw = text.encode()
    assert encode.merge_scan(raw, RANKS) == encode.merge_heap(raw, RANKS)


def test_encoded_table(spark):
    texts = ["Hello  world", "", None, "   ", "<|endoftext|>", "a" * 20_000, "naïve 🚑 " * 50]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode.encode_texts(rows, "doc_id", "text").collect()}
    assert got == {i: REFERENCE.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert encode.encode_texts(rows.limit(0), "doc_id", "text").count() == 0


def brute(docs, items, n):
    out = set()
    for d, t in docs:
        w = leaks.words_of(t)
        grams = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
        for i, s in items:
            v = leaks.words_of(s)
            if any(tuple(v[k:k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    rnd = random.Random(2)
    item = lambda k: " ".join(rnd.choices(WORDS, k=k))
    items = [(i, item(rnd.randrange(5, 30))) for i in range(20)] + [(50, None), (51, ""), (3, "another text under a known id " * 3)]
    docs = []
    for d in range(120):
        t = item(rnd.randrange(0, 40))
        if d % 3 == 0:
            w = (rnd.choice(items[:20])[1]).split()
            k = rnd.randrange(len(w))
            t += " " + rnd.choice([" ", " -- ", "\n> ", " *"]).join(w[k:k + rnd.randrange(10, 15)]).upper() + " " + item(3)
        docs.append((d, t))
    docs += [(900, None), (901, ""), (902, "word " * 50_000)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, item_id int")
    e = spark.createDataFrame(items, "item_id bigint, text string")
    got = {tuple(r) for r in leaks.leaked_items(d, e).collect()}
    assert got == brute(docs, items, 12) and got
    clean = leaks.without_leaks(d, e)
    assert leaks.leaked_items(clean, e).count() == 0 and clean.count() == len(docs)
    assert leaks.leaked_items(d.limit(0), e).count() == 0 and leaks.leaked_items(d, e.limit(0)).count() == 0
    with pytest.raises(ValueError):
        leaks.leaked_items(d, e, max_items=3)


STUFFED = [
    "cheap tyre; tyre Oxford; best tyre; tyre; dashcam deals; dashcam; buy dashcam; tyre near me; tyre; dashcam", "Our solar loan is the best solar loan for every solar loan in Orlomford. Looking for solar loan? Choose solar loan, the cheap solar loan. " * 3,
    "Home » Shop » Login » Tyre Oxford » Dashcam » Sitemap » Home » More dashcam » Login", "\n".join(f"dashcam {i} https://www.shop{i}.test/dashcam?id={i}" for i in range(9)), "Tags: SKU12345, size M, red torch, size L, SKU99999, best, review, blue torch, size S", "#CheapTyre #BestTyre #TyreDeals #Dashcam #DashcamSale #TyreOxford",
    "We waited for the ambulance.\n\n" + "tyre discount from 42.99 buy now dashcam\n" * 9, '<a href="http://a.test/x">dashcam</a> [tyre](http://b.test/y) <a href="www.c.test">loan</a> [loan](www.d.test/z)',
]
SOUND = [
    "I was walking along Tandry Road at about 9:25 when I heard a loud crash behind me. The driver was a slim man in a red coat.", "CAMERA LOG — junction of A Street / B Road\nCamera: EX-1\n\n" + "10:45:42 — No movement in frame for 4 seconds.\n" * 12, "(Person: red van) -[DROVE]-> (Vehicle: Tandry Road)\n" * 9,
    "Q: What colour was the vehicle?\nA: It was red, with a roof rack.\n" * 5, "List of exhibits\nEX-1: a yellow torch with a cracked screen, found at Delmond Street on Friday by the second unit.\nEX-2: a blue torch tied with string, found at Corner Lane on Monday by the second unit.",
    "Before you buy a dashcam, measure the space and read the small print. A dashcam is only as useful as the place where it is fitted. Nobody needs a dashcam every day, but it helps when something goes wrong.", "Price list of Palegate Data, valid from Tuesday.\nBrisk Node\t27.00\tdelivered within 19 days to Quarelwold\nLumen Desk\t881.00\tdelivered within 13 days to Drevunholm", "救急車は9分後に到着しました。車は止まらずにそのまま走り去りました。" * 4,
]


def test_spam_pages(spark):
    docs = [(i, t, f"host{i % 4}", "x") for i, t in enumerate(STUFFED + SOUND)] + [(100, None, None, "x"), (101, "", "h", "x"), (102, "  \n", "h", "x"), (103, "dashcam", "h", "x"), (0, STUFFED[0], "host0", "x")]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string, source string, density string")
    assert sorted(r["doc_id"] for r in spam.spam_pages(rows).collect()) == list(range(len(STUFFED)))
    assert spam.spam_pages(rows.limit(0)).count() == 0
