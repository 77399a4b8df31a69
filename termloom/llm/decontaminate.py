"""Benchmark decontamination by the q-gram lemma.

A document region within k edits of an item of m characters shares at least m - q + 1 - k q of its
q-grams with it, on diagonals that differ by at most k. q is 8, for an item for which that leaves no bound
the largest smaller one that does, so no length of items is missed. Shared q-grams are counted in
overlapping bands of 2 (k + 1) diagonals, of each item's own width; bands that reach the bound are verified
by an alignment that fills the band's cells only, so an item costs about 2 k m a band.

Documents are scanned in one map-only pass against an index of the items. Items are taken in blocks of at
most ``block_chars`` characters, one pass a block, so an index never outgrows a worker's memory.

Texts are compared in lower case with every white-space character as a space, one code point for one, so
spans are code points of the document's own text. Defined cases: null or empty texts and items have no
hits; an item shorter than q is found where it occurs with no edit; ids of any type are carried as they are;
of an item's occurrences in a document the one of fewest edits is given, then the first end, then the last
start; repeated rows give repeated hits; extra columns of any name are ignored, ``keep_clean`` keeps them; an
empty benchmark gives no hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Q = 8
EDITS = 0.1
BLOCK_CHARS = 4_000_000
BATCH_CHARS = 200_000
PAIRS = 2_000_000
_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hits_type(benchmark: DataFrame) -> T.ArrayType:
    """Hits carry the items' ids as they are."""
    kinds = [("item_id", benchmark.schema["item_id"].dataType), ("start", T.LongType()), ("end", T.LongType()), ("edits", T.IntegerType())]
    return T.ArrayType(T.StructType([T.StructField(*k) for k in kinds]))


_ALL_SPACES = np.zeros(0x3001, bool)
_ALL_SPACES[[c for c in range(0x3001) if chr(c).isspace()]] = True


def codes_of(text: str) -> np.ndarray:
    """Code points in lower case with plain spaces, without a change of length."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    c[_ALL_SPACES[np.minimum(c, 0x3000)] & (c <= 0x3000)] = 32
    return c


def hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each window of q characters (injective up to q = 8 for characters under 256)."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = codes[:n].astype(np.uint64)
        for k in range(1, q):
            h *= np.uint64(0x100000001B3)
            h += codes[k : n + k]
        h *= _MIX
    return h


def align(item: np.ndarray, text: np.ndarray, lows: np.ndarray, width: int, limit: int) -> tuple[int, int, int] | None:
    """Least edits of the item against any stretch of the text, along bands of diagonals: (edits, start, end).

    Band b holds the diagonals (place in the text less place in the item) from ``lows[b]`` to below
    ``lows[b] + width``; no cell outside of a band is filled. Rows are the item's characters, a row is a
    matrix of bands by diagonals. Among equal edits the first end wins, then the last start; None beyond
    the limit.
    """
    n, m = len(text), len(item)
    steps = np.arange(width)
    big = n + m + width + 2
    far = n + m + 1  # edits of a cell that can't be reached
    place = lows[:, None] + steps  # characters of the text before the cell
    inside = (place >= 0) & (place <= n)
    row = np.where(inside, 0, far)
    begin = np.clip(place, 0, n)
    padded = np.append(text, np.uint32(0xFFFFFFFF))
    edge = np.full((len(lows), 1), far)
    none = np.zeros((len(lows), 1), begin.dtype)
    for c in item:
        place = place + 1
        before = np.where((place >= 1) & (place <= n), place - 1, n)
        sub = row + (padded[before] != c)
        up = np.hstack([row[:, 1:], edge]) + 1
        take = sub <= up
        best = np.where(take, sub, up)
        first = np.where(take, begin, np.hstack([begin[:, 1:], none]))
        best[(place < 0) | (place > n)] = far
        # a gap in the item: running minimum along the row, with the place it came from
        shifted = (best - steps) * big + (big - 1 - steps)  # ties: the latest
        low = np.minimum.accumulate(shifted, axis=1)
        row = np.minimum(low // big + steps, far)
        row[place > n] = far
        begin = np.take_along_axis(first, big - 1 - low % big, axis=1)
        alive = row.min(1) <= limit
        if not alive.all():
            if not alive.any():
                return None
            row, begin, place, edge, none = row[alive], begin[alive], place[alive], edge[alive], none[alive]
    good = np.flatnonzero(row.ravel() == row.min())
    ends, starts = place.ravel()[good], begin.ravel()[good]
    at = np.lexsort((-starts, ends))[0]
    return int(row.min()), int(starts[at]), int(ends[at])


def gram_size(size: int, limit: int, q: int) -> int:
    """The largest q up to the given one for which the lemma asks at least one common q-gram."""
    while q > 1 and size - q + 1 - limit * q < 1:
        q -= 1
    return q


class _Grams:
    """The q-grams of some items, sorted by hash, with a bit table before them."""

    def __init__(self, numbers: list[int], items: list[np.ndarray], limits: np.ndarray, q: int):
        self.q = q
        self.numbers = np.array(numbers, np.int64)
        self.sizes = np.array([len(items[k]) for k in numbers], np.int64)
        limits = limits[self.numbers]
        self.least = np.maximum(1, self.sizes - q + 1 - limits * q)
        #: Bands overlap by half, so any limit + 1 neighbouring diagonals lie within one.
        self.half = limits + 1
        grams = [hashes(items[k], q) for k in numbers]
        h = np.concatenate(grams)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        offset = np.concatenate([np.arange(len(g)) for g in grams]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        self.item, self.offset = item[order], offset[order]
        self.keys, self.starts = np.unique(h[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(h)).astype(np.int64)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.keys >> np.uint64(64 - _BITS)] = True

    def bands(self, flat: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item number, least diagonal) of every band that holds enough of an item's q-grams."""
        h = hashes(flat, self.q)
        at = np.flatnonzero(self.seen[h >> np.uint64(64 - _BITS)])
        key = np.searchsorted(self.keys, h[at])
        key[key == len(self.keys)] = 0
        same = self.keys[key] == h[at]
        at, key = at[same], key[same]
        if not len(at):
            return
        doc = np.searchsorted(starts, at, "right") - 1
        n = self.ends[key] - self.starts[key]
        most = int(self.sizes.max())
        span = (len(flat) + most) // int(self.half.min()) + 3
        every, tally = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # Pieces of bounded size: a q-gram may be in many items and at many places.
        for piece in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1):
            k, times = key[piece], n[piece]
            entry = np.repeat(self.starts[k], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            item = self.item[entry]
            place = np.repeat(at[piece] - starts[doc[piece]], times)
            band = (place - self.offset[entry] + most) // self.half[item] + 1
            code = (np.repeat(doc[piece], times) * len(self.sizes) + item) * span + band
            for shift in (0, 1):  # a band holds the diagonals [b, b + 2) * half
                codes, counts = np.unique(code - shift, return_counts=True)
                every.append(codes)
                tally.append(counts)
        codes, where = np.unique(np.concatenate(every), return_inverse=True)
        counts = np.bincount(where, np.concatenate(tally)).astype(np.int64)
        item = codes // span % len(self.sizes)
        for g in np.flatnonzero(counts >= self.least[item]):
            k = int(item[g])
            yield int(codes[g] // span // len(self.sizes)), int(self.numbers[k]), (int(codes[g] % span) - 1) * int(self.half[k]) - most


class Index:
    """The items and their q-grams, each item with the largest q for which the lemma leaves a bound."""

    def __init__(self, items: list[tuple[object, str]], q: int = Q, edits: float = EDITS):
        self.q = q
        self.ids = [i for i, t in items if t]
        self.items = [codes_of(t) for _, t in items if t]
        self.limits = np.array([int(edits * len(c)) if len(c) >= q else 0 for c in self.items], np.int64)
        self.short = [k for k, c in enumerate(self.items) if len(c) < q]
        by_q: dict[int, list[int]] = {}
        for k, c in enumerate(self.items):
            if len(c) >= q:
                by_q.setdefault(gram_size(len(c), int(self.limits[k]), q), []).append(k)
        self.grams = [_Grams(numbers, self.items, self.limits, size) for size, numbers in sorted(by_q.items())]

    def search(self, texts: list[str | None]) -> list[list[tuple[object, int, int, int]]]:
        out: list[list] = [[] for _ in texts]
        at, batch = 0, []
        for n, t in enumerate(texts):
            if t:
                batch.append((n, codes_of(t)))
                at += len(t)
            if batch and (at > BATCH_CHARS or n == len(texts) - 1):
                self._batch(batch, out)
                at, batch = 0, []
        return out

    def _batch(self, batch, out) -> None:
        gap = np.zeros(self.q, np.uint32)
        flat = np.concatenate([x for _, c in batch for x in (c, gap)])
        starts = np.cumsum([0] + [len(c) + self.q for _, c in batch])
        found: dict[tuple[int, int], list[int]] = {}
        for grams in self.grams:
            for doc, k, low in grams.bands(flat, starts):
                found.setdefault((doc, k), []).append(low)
        for (doc, k), lows in sorted(found.items()):
            n, text = batch[doc]
            if best := self._verify(k, text, lows):
                out[n].append((self.ids[k], best[1], best[2], best[0]))
        for k in self.short:
            for n, text in batch:
                p = _find(self.items[k], text)
                if p >= 0:
                    out[n].append((self.ids[k], p, p + len(self.items[k]), 0))

    def _verify(self, k: int, text: np.ndarray, lows: list[int]) -> tuple[int, int, int] | None:
        """The best alignment within the bands; a verbatim occurrence saves it."""
        item, limit = self.items[k], int(self.limits[k])
        p = _find(item, text)
        if p >= 0:
            return 0, p, p + len(item)
        if not limit:
            return None
        width = 2 * (limit + 1)
        step = max(1, PAIRS // (8 * width))
        every = (align(item, text, np.array(lows[i : i + step], np.int64), width, limit) for i in range(0, len(lows), step))
        return min(filter(None, every), key=lambda x: (x[0], x[2], -x[1]), default=None)


def _find(item: np.ndarray, text: np.ndarray) -> int:
    hay, needle, p = text.tobytes(), item.tobytes(), -1
    while (p := hay.find(needle, p + 1)) >= 0 and p % 4:
        pass
    return p if p < 0 else p // 4


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size; one block at a time is on the driver."""
    block, size = [], 0
    rows = benchmark.select("item_id", F.col("text").cast("string")).where("text is not null and text != ''")
    for i, t in rows.distinct().orderBy("item_id", "text").toLocalIterator():
        if block and size + len(t) > block_chars:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += len(t)
    if block:
        yield block


_latest: dict[str, Index] = {}


def _index(name: str, block, q: int, edits: float) -> Index:
    """The index of a block; a worker keeps the latest from task to task."""
    if name not in _latest:
        _latest.clear()
        _latest[name] = Index(block, q, edits)
    return _latest[name]


def _searcher(packed, kind: T.ArrayType, q: int, edits: float):
    """The search of one block of items, given as a broadcast."""
    name = uuid.uuid4().hex

    @F.pandas_udf(kind)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = _index(name, packed.value, q, edits)
        names = ("item_id", "start", "end", "edits")
        for s in batches:
            yield pd.Series([[dict(zip(names, h)) for h in hits] for hits in index.search(s.tolist())], dtype=object)

    return search


def hits_column(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, block_chars: int = BLOCK_CHARS) -> Column:
    """An array of hits (item_id, start, end, edits) for the column ``text``: the best of each item."""
    context = docs.sparkSession.sparkContext
    text, kind = F.col("text").cast("string"), hits_type(benchmark)
    found = [_searcher(context.broadcast(block), kind, q, edits)(text) for block in item_blocks(benchmark, block_chars)]
    return reduce(F.concat, found) if found else F.array().cast(kind)


def matches(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, item_id, start, end, edits`` for every document and item that it holds."""
    hits = hits_column(docs, benchmark, **options)
    return docs.select("doc_id", "text").select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows without a hit, with their own columns."""
    return docs.where(F.size(hits_column(docs, benchmark, **options)) == 0)
