"""Evaluation passages inside training texts.

All n-grams of normalised words of the evaluation items go into one broadcast hash set. Each training
text is scanned once, window by window: words outside the evaluation vocabulary break a run at
once, so only runs of n known words are looked up, and a hit is verified against the item's own words
(the set holds the words themselves, not only a hash of them). Spans or documents can then be removed.

The evaluation set is held-out material of fixed size (hundreds of items); ``max_items`` and ``MAX_CHARS`` state the bounds that are
proven before it is collected and broadcast. The training table is neither shuffled nor collected, so a source
with a third of all rows is just more splits.

Defined cases: a word is a run of letters or digits, case is ignored, whatever stands between words does not matter;
null texts have no words; items of fewer than n words cannot leak; repeated items (same item_id) count once; each item that shares a passage is reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Words without case. Case is taken away after parting, as folding can make letters of one."""
    return [w.casefold() for w in WORD.findall(text)] if text else []


class GramIndex:
    """The n-grams of the evaluation items, by word ids."""

    def __init__(self, items: list[tuple[int, str | None]], n: int) -> None:
        self.n, self.vocabulary, self.grams = n, {}, {}
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            for i in range(len(words) - n + 1):
                self.grams.setdefault(tuple(words[i:i + n]), set()).add(item)

    def spans(self, text: str | None) -> list[tuple[int, int, set[int]]]:
        """(first word, word after the last, items) of each window that is in the set."""
        if not text:
            return []
        get, n, found, run = self.vocabulary.get, self.n, [], []
        for i, w in enumerate(words_of(text)):
            k = get(w)
            if k is None:
                run = []
                continue
            run.append(k)
            if len(run) >= n and (items := self.grams.get(tuple(run[-n:]))):
                found.append((i - n + 1, i + 1, items))
        return found

    def items(self, text: str | None) -> list[int]:
        return sorted(set().union(*(s[2] for s in self.spans(text))))

    def without(self, text: str | None) -> str | None:
        """The text without the leaked spans."""
        spans = self.spans(text)
        if not spans:
            return text
        at = [m.span() for m in WORD.finditer(text)]
        out, last = [], 0
        for first, after, _ in spans:
            a, b = at[first][0], at[after - 1][1]
            if a > last:
                out.append(text[last:a])
            last = max(last, b)
        return "".join(out) + text[last:]


MAX_CHARS = 20_000_000  # of all evaluation texts together, as each becomes words and grams in every Python worker


def _index(items: DataFrame, n: int, max_items: int) -> GramIndex:
    size = items.select("item_id", "text").where("item_id is not null").distinct().agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > MAX_CHARS:
        raise ValueError(f"more than {MAX_CHARS} characters of evaluation texts; part them")
    rows = items.select("item_id", "text").where("item_id is not null").distinct().limit(max_items + 1).collect()
    if len(rows) > max_items:
        raise ValueError(f"more than {max_items} evaluation items; raise max_items if the driver can hold them")
    return GramIndex([(r[0], r[1]) for r in rows], n)


def leaked_items(documents: DataFrame, items: DataFrame, n: int = 12, max_items: int = 100_000) -> DataFrame:
    """(doc_id, item_id): documents that contain n consecutive words of an item."""
    shared = documents.sparkSession.sparkContext.broadcast(_index(items, n, max_items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            pairs = [(d, i) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i in index.items(t)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["doc_id", "item_id"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, item_id bigint").distinct()


def without_leaks(documents: DataFrame, items: DataFrame, n: int = 12, max_items: int = 100_000) -> DataFrame:
    """(doc_id, text) of all documents, leaked spans taken out."""
    shared = documents.sparkSession.sparkContext.broadcast(_index(items, n, max_items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([index.without(t) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, text string")
