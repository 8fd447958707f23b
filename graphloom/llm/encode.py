"""Token ids of whole texts by a public byte-level BPE vocabulary.

A text is parted by the vocabulary's pattern; each part is merged over a contiguous array of rank entries:
the boundaries of its pieces and the rank of each adjacent pair. The least rank is found by a scan,
its boundary deleted, and the two ranks beside it are computed anew, until no pair has a rank. Long
parts, where scans would be quadratic, take the same merges from a heap. A worker keeps the ids of
parts it has met, up to a fixed number.

The vocabulary has a fixed size (under 1 MB) and is read once on the driver from a path that is a
parameter, then broadcast, so workers need no file. No shuffle: each document is encoded where it is read.

Defined cases: null and empty texts give an empty list; blank text is encoded as it is; text that looks like a
special token is ordinary text; lone surrogates cannot occur in UTF-8 columns.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that parts text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCAN_LIMIT, KEPT_PARTS = 96, 200_000
_NONE = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 and rank a line."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def merge_scan(part: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one part, by repeated scans of the rank array."""
    bounds = list(range(len(part) + 1))
    get = ranks.get
    pair = [get(part[i:i + 2], _NONE) for i in range(len(part) - 1)]
    while pair:
        least = min(pair)
        if least == _NONE:
            break
        i = pair.index(least)
        del bounds[i + 1], pair[i]
        if i < len(pair):
            pair[i] = get(part[bounds[i]:bounds[i + 2]], _NONE)
        if i:
            pair[i - 1] = get(part[bounds[i - 1]:bounds[i + 1]], _NONE)
    return [ranks[part[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_heap(part: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for long parts: least rank first, leftmost among equals."""
    n, get = len(part), ranks.get
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), [i + 1 for i in range(n)]
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(part[i:i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\x01") * n
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or mid >= n or not alive[mid] or end[mid] != stop:
            continue
        alive[mid], end[i] = 0, stop
        j = after[i] = after[mid]
        if j < n:
            before[j] = i
            if (r := get(part[i:end[j]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[j]))
        h = before[i]
        if h >= 0 and (r := get(part[h:stop])) is not None:
            heapq.heappush(heap, (r, h, i, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[part[i:end[i]]])
        i = end[i]
    return out


class Encoder:
    """Ids of texts, with a bounded memory of parts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import regex

        self.ranks, self.parts, self.known = ranks, regex.compile(pattern).findall, {}

    def part(self, text: str) -> list[int]:
        raw = text.encode("utf-8")
        whole = self.ranks.get(raw)
        if whole is not None:
            ids = [whole]
        else:
            ids = merge_scan(raw, self.ranks) if len(raw) <= SCAN_LIMIT else merge_heap(raw, self.ranks)
        if len(raw) <= SCAN_LIMIT:
            if len(self.known) >= KEPT_PARTS:
                self.known.clear()
            self.known[text] = ids
        return ids

    def text(self, text: str | None) -> list[int]:
        out: list[int] = []
        get, extend = self.known.get, out.extend
        for p in self.parts(text) if text else ():
            extend(get(p) or self.part(p))
        return out


def encode_texts(rows: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, ids array<int>) of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for b in batches:
            lists = pa.array([encoder.text(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], [key, "ids"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
