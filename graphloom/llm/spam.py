"""Keyword-stuffed pages, link lists, menus and product tags among crawled texts.

Two kinds of evidence are joined. List density: the share of a page's words that stand in links,
hashtags, bare enumerations, menu lines, offers or sentences that repeat their own keyword, found by
one pass over the text. Replication: every text is exploded into shingles of five words, the distinct
hosts of each shingle are counted over the whole corpus, and the share of a page's shingles that other
hosts carry too says how far it is stitched together from phrases replicated elsewhere. A page is
flagged on dense lists alone, or on medium density together with replication.

Shingles travel as 64-bit hashes with a hash of their host, distinct per batch of pages and combined before the shuffle;
a shingle on every page, or a host with a third of all pages, is one counter after that. Only pages with
some list density look their shingles up, so all others are left out by a bit filter of fixed size
before the shuffle; the join after it is exact, and a full filter only saves nothing.

Defined cases: null, empty and blank texts are never spam; pages of fewer than ``least_words`` words neither; a null host is
one host; hash collisions of shingles (64 bits) can only add to a count; exact repeats of a row (same doc_id) count once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.store import materialize

SHINGLE = 5
# Words that advertise, and words of menus and tag lists.
ADVERTISING = frozenset("buy cheap best top deals deal online price prices review reviews free sale discount near local offer offers more 2024 2025 2026 home login sitemap shop sku size cart checkout menu".split())
# Frequent function words of the languages of the corpus; sentences have them, enumerations have not.
FUNCTION_WORDS = frozenset(
    "the a an of and to in is was were that which it i on at for with as not but so by from had he she they we you your there this when where who what be been after before then if or our their his her has have"
    " der die das und ist war ich nicht ein eine einen dem den des im von mit auf für zu sich dann nach noch als auch bei am es er sie"
    " le la les de du un une et est était je ne pas dans en que qui sur pour il elle au aux plus se par"
    " el los las del y es era no con por para su al lo estaba ya"
    " lo gli uno di e è non che per della i sono ho ha alla dopo verso".split())
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_LINK = re.compile(r"<a\s[^>]*>|\]\([^)\s]*\)|(?:https?://|www\.)\S+|(?:(?<=\s)|^)#[^\W\d_][\w-]*", re.I)
_SEGMENT = re.compile(r"[\r\n  ]+|(?<=[.!?。！？])(?:\s+|(?=[^\s\d\x00-\x7f]))")
_ITEM = re.compile(r"[,;·|»›>•/\t]|\s[-–—]\s|\s\*\s")
_NUMBER = re.compile(r"\d+")
_UNSPACED = re.compile("[\u3040-\u30ff\u4e00-\u9fff\u0e00-\u0e7f]")  # scripts whose words are not parted
_RECORD = re.compile(r"\d{1,2}:\d{2}|-\[|\]->|^\s*[\[{(\"}]|^\s*[QA]:|\t|^\s*[\w -]{2,30}:\s")


class _Page:
    """How often each word of a page occurs, counted when first asked."""

    def __init__(self, text: str) -> None:
        self.text, self.counts = text, None

    def keeps_using(self, word: str) -> bool:
        if self.counts is None:
            self.counts = Counter(_WORD.findall(self.text.casefold()))
        return self.counts[word] > 2


def _stuffed_words(segment: str, page: _Page) -> tuple[int, int]:
    """(words in stuffing, words) of one line or sentence."""
    links = _LINK.findall(segment) if "#" in segment or "/" in segment or "<" in segment or "." in segment[:-1] else ()
    rest = _LINK.sub(" ", segment).replace("</a>", " ").replace("</A>", " ") if links else segment
    words = _WORD.findall(rest.casefold())
    n, tokens = len(words), len(words) + 2 * len(links)
    function, repeated = sum(map(FUNCTION_WORDS.__contains__, words)), n - len(set(words))
    if links and function <= 0.2 * n:
        return tokens, tokens
    if not n or n > 4 and function > 0.3 * n and 8 * repeated < n:  # prose fits none of what follows
        return 0, tokens
    adverts = sum(map(ADVERTISING.__contains__, words))
    content = [w for w in words if len(w) > 2 and w not in FUNCTION_WORDS]
    own = Counter(content) if len(set(content)) < len(content) else {}
    again = sum(c for c in own.values() if c > 1)
    tagged = segment.lstrip()[:5].lower() == "tags:"
    if not tagged and _RECORD.search(segment):
        return 0, tokens
    if n <= 40 and again >= 0.25 * n and n >= 4:
        return tokens, tokens  # a sentence that repeats its keyword
    if n > 40 and again >= 0.5 * n and sum(c for c in own.values() if c >= 4) >= 0.4 * n:
        return tokens, tokens  # a keyword over and over without a stop
    if n >= 3 and adverts >= 0.2 * n and function <= 0.3 * n:
        return tokens, tokens
    items = [x for x in _ITEM.split(rest) if x.strip()]
    if len(items) >= 5 and n <= 4 * len(items) and function <= 0.12 * n:
        return tokens, tokens  # an enumeration
    ended = segment.rstrip()[-1:] in ".!?。！？:"
    if n <= 7 and not ended and function <= 0.2 * n and sum(map(page.keeps_using, words)) >= 0.5 * n:
        return tokens, tokens  # a bare line of words that the page keeps using
    if n <= 4 and ended and not _UNSPACED.search(segment) and all(w in FUNCTION_WORDS or w == "looking" or page.keeps_using(w) for w in words):
        return tokens, tokens  # what is left of a stuffed question
    return 0, tokens


def page_evidence(text: str | None) -> tuple[int, float]:
    """(words, share of words in lists, links and stuffing)."""
    if not text:
        return 0, 0.0
    page, stuffed, total = _Page(text), 0, 0
    for segment in _SEGMENT.split(text):
        if segment and not segment.isspace():
            a, b = _stuffed_words(segment, page)
            stuffed, total = stuffed + a, total + b
    return total, stuffed / total if total else 0.0


_STEP = 0x9E3779B97F4A7C15
_WORDS_KEPT = 500_000
FILTER_BITS = 1 << 26


class Shingler:
    """64-bit hashes of five words in a row, rolled over the hashes of the words; of all words where there are fewer."""

    def __init__(self) -> None:
        import numpy
        import xxhash

        self.np, self.hash, self.known = numpy, xxhash.xxh64_intdigest, {}

    def of(self, text: str | None):
        np, known = self.np, self.known
        words = _WORD.findall(_NUMBER.sub("9", text.casefold())) if text else []  # prices and counts do not make another phrase
        if not words:
            return np.empty(0, np.uint64)
        if len(known) > _WORDS_KEPT:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(SHINGLE, len(words))
        rolled = codes[:len(codes) - k + 1].copy()
        for i in range(1, k):
            rolled = rolled * np.uint64(_STEP) + codes[i:len(codes) - k + 1 + i]
        return np.unique(rolled)


def page_features(documents: DataFrame, suspect: float) -> DataFrame:
    """(doc_id, words, density, shingles); shingles only of pages with at least ``suspect`` density."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            texts = b.column(1).to_pylist()
            seen = [page_evidence(t) for t in texts]
            own = [shingler.of(t).astype("int64") if d >= suspect else None for t, (_, d) in zip(texts, seen)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s[0] for s in seen], pa.int32()), pa.array([s[1] for s in seen], pa.float64()), pa.array(own, pa.list_(pa.int64()))], ["doc_id", "words", "density", "shingles"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, words int, density double, shingles array<bigint>")


def asked_filter(asked: DataFrame):
    """A bit for each asked shingle, by its low bits: FILTER_BITS bits (8 MB) however many there are."""
    import numpy as np

    bit = F.col("shingle").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = asked.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast((shingle & {FILTER_BITS - 1}) % 64 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.toLocalIterator():  # at most FILTER_BITS / 64 rows
        bits[r["w"]] = r["m"]
    return bits.view(np.uint64)


def host_shingles(documents: DataFrame, bits) -> DataFrame:
    """(shingle, host) of all pages, distinct per batch, for shingles whose bit is set; host is a hash of the source."""
    shared = documents.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        shingler, bits = Shingler(), shared.value
        for b in batches:
            found, hosts = [], []
            for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = shingler.of(t)
                low = x & np.uint64(FILTER_BITS - 1)
                x = x[(bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) == 1]
                found.append(x)
                hosts.append(np.full(len(x), h, np.int64))
            x, h = (np.concatenate(found), np.concatenate(hosts)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
            first = np.unique(np.stack([x, h.view(np.uint64)], axis=1), axis=0, return_index=True)[1] if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[first].view(np.int64)), pa.array(h[first])], ["shingle", "host"])

    return documents.select(F.xxhash64(F.coalesce("source", F.lit(""))).alias("host"), "text").mapInArrow(run, "shingle bigint, host bigint")


def spam_pages(documents: DataFrame, dense: float = 0.6, medium: float = 0.4, suspect: float = 0.25, hosts: int = 3, replicated: float = 0.5, least_words: int = 8) -> DataFrame:
    """(doc_id, density, replication) of the flagged pages."""
    features = materialize(page_features(documents, suspect), "pages")
    suspects = features.where("shingles is not null and words > 0")
    asked = suspects.select("doc_id", F.explode("shingles").alias("shingle"))
    spread = host_shingles(documents, asked_filter(asked)).groupBy("shingle", "host").agg(F.lit(1).alias("one")).groupBy("shingle").agg(F.count("*").alias("hosts")).where(F.col("hosts") >= hosts)
    shared = asked.join(spread, "shingle", "left_semi").groupBy("doc_id").agg(F.count_distinct("shingle").alias("shared"))
    scored = suspects.groupBy("doc_id").agg(F.max("words").alias("words"), F.max("density").alias("density"), F.max(F.size("shingles")).alias("n")).join(shared, "doc_id", "left")
    share = F.coalesce("shared", F.lit(0)) / F.col("n")
    flagged = (F.col("density") >= dense) | ((F.col("density") >= medium) & (share >= replicated))
    return scored.withColumn("replication", share).where(flagged & (F.col("words") >= least_words)).select("doc_id", "density", "replication")
