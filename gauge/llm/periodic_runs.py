"""Periodic runs of words: suffix array, longest previous factors, block boundaries, copies.

The suffix array of a chunk of documents comes from prefix doubling; the ranks of each doubling stay, so the
longest common extension of two places, to the right or to the left, is read off by halving steps. Neighbours in
the suffix array that stand earlier in the text give the longest previous factor of each word, and the factors
cut a text into blocks. A run either touches a boundary of blocks, where extensions to both sides find it, or
lies inside a block and is a copy of a run in the block's earlier occurrence; those are taken from buckets of
runs by start, from left to right.

A run has an exponent of 4 at least. If it ends in a block and starts before that, a third of the two blocks'
length bounds its period: else the words from the earlier block's start to the run's end would have occurred one
period before, and the earlier block would be longer. So the candidates of all boundaries number at most two
thirds of the words.

Defined results: null and empty texts have no words and no runs, and the digests of nothing; a document without
doc_id stays as it is; repeated rows repeat their result; an empty table gives an empty result; further columns
of the input pass by unread. Memory grows with a chunk of words, or with one longer document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gauge.llm.common import binary_column, text_bytes, trimmed

#: Least exponent and length of a run; words of the documents that are worked on together, or of one longer one.
EXPONENT, LEAST, CHUNK_WORDS = 4, 6, 1 << 17


class Suffixes:
    """Suffix array of numbers in several texts, and longest common extensions; nothing is common across texts."""

    def __init__(self, key: np.ndarray, end: np.ndarray):
        """``key`` differs between texts; ``end`` is where each place's text ends."""
        n = len(key)
        order = np.argsort(key, kind="stable")
        rank, active, k = self._ranked(np.zeros(n, np.int32), order, key[order], np.arange(n)), np.arange(n), 1
        self.ranks = []
        active = active[self._shared]
        while len(active):
            self.ranks.append(np.append(rank, np.int32(-1)))
            at = order[active]
            after = at + k
            second = np.where(after < end[at], rank[np.minimum(after, n - 1)], -1)
            both = rank[at] * np.int64(n + 1) + second + 1
            by = np.argsort(both, kind="stable")
            order[active] = at = at[by]
            rank = self._ranked(rank.copy(), at, both[by], active)
            active = active[self._shared]
            k *= 2
        self.order = order

    def _ranked(self, rank: np.ndarray, at: np.ndarray, value: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Ranks of suffixes in order: the first slot of their equals."""
        new = np.ones(len(value) + 1, bool)
        new[1:-1] = value[1:] != value[:-1]
        self._shared = ~(new[:-1] & new[1:])
        rank[at] = np.maximum.accumulate(np.where(new[:-1], slots, 0))
        return rank

    def ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many values from x on equal those from y on; x < y, and y may be its text's end."""
        x, y, start = x.copy(), y.copy(), x
        for level in range(len(self.ranks) - 1, -1, -1):
            step = (self.ranks[level][x] == self.ranks[level][y]).astype(np.int64) << level
            x += step
            y += step
        return x - start

    def behind(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many values that end before x equal those that end before y; x < y, and x may be its text's start."""
        x, y, start = x.copy(), y.copy(), x
        for level in range(len(self.ranks) - 1, -1, -1):
            a, b = x - (1 << level), y - (1 << level)
            step = ((a >= 0) & (self.ranks[level][a] == self.ranks[level][b])).astype(np.int64) << level
            x -= step
            y -= step
        return start - x


def previous_factors(suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of the longest stretch from it that also starts earlier, and where it does."""
    order = suffixes.order
    n = len(order)
    before, after, stack = [-1] * n, [-1] * n, [-1]
    for at in order.tolist():  # the nearest neighbours in suffix order that stand earlier in the text
        while stack[-1] > at:
            after[stack.pop()] = at
        before[at] = stack[-1]
        stack.append(at)
    here = np.arange(n)
    lengths, places = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for found in (np.array(before, np.int64), np.array(after, np.int64)):
        some = here[found >= 0]
        common = suffixes.ahead(found[some], some)
        better = common > lengths[some]
        lengths[some[better]], places[some[better]] = common[better], found[some[better]]
    return lengths, places


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each text its runs (start, length, period) by start, then period; texts are arrays of small numbers, one a word."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    n = int(ends[-1]) if len(ends) else 0
    if n < LEAST:
        return found
    word = np.concatenate(texts).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    end, start = ends[text], (ends - sizes)[text]
    suffixes = Suffixes(text * (int(word.max()) + 1) + word, end)
    factor, place = previous_factors(suffixes)
    steps, b, at = np.maximum(factor, 1).tolist(), [], 0
    while at < n:
        b.append(at)
        at += steps[at]
    block = np.array(b, np.int64)
    # a boundary at each block's start, and at each text's end
    own, length = text[block], np.maximum(factor[block], 1)
    first = np.append(True, own[1:] != own[:-1])
    earlier = np.where(first, 0, np.append(0, length[:-1]))
    last = np.append(own[1:] != own[:-1], True)
    border = np.concatenate([block, ends[own[last]]])
    most = np.concatenate([np.where(first, 0, earlier + length), length[last]]) // (EXPONENT - 1)
    low = np.concatenate([start[block], start[block[last]]])
    high = np.concatenate([end[block], end[block[last]]])
    x = np.repeat(border, most)
    q = np.arange(len(x)) - np.repeat(np.cumsum(most) - most, most) + 1
    low, high = np.repeat(low, most), np.repeat(high, most)
    spans = []
    # a run reaches one period beyond the boundary, or ends less than that behind it
    right = x + q < high
    right[right] = word[x[right]] == word[(x + q)[right]]
    left = x - q - 1 >= low
    left[left] = word[(x - q - 1)[left]] == word[x[left] - 1]
    for c, base in ((np.flatnonzero(right), x), (np.flatnonzero(left), x - q)):
        u, v, p = base[c], base[c] + q[c], q[c]
        back = suffixes.behind(u, v)
        total = back + suffixes.ahead(u, v) + p
        good = (total >= EXPONENT * p) & (total >= LEAST)
        spans.append(np.stack([u - back, total, p])[:, good])
    s, total, p = np.concatenate(spans, axis=1)
    by = np.lexsort((p, total, s))
    s, total, p = s[by], total[by], p[by]
    keep = np.append(True, (s[1:] != s[:-1]) | (total[1:] != total[:-1]))[: len(s)]  # the smallest period
    s, total, p = s[keep], total[keep], p[keep]
    which = text[s]
    bounds = np.searchsorted(which, np.arange(len(texts) + 1))
    block_of = np.searchsorted(own, np.arange(len(texts) + 1))
    for t in np.unique(which).tolist():
        offset = int(ends[t] - sizes[t])
        buckets: dict[int, set[tuple[int, int]]] = {}
        for k in range(bounds[t], bounds[t + 1]):
            buckets.setdefault(int(s[k]), set()).add((int(total[k]), int(p[k])))
        for k in range(block_of[t], block_of[t + 1]):
            a, size = int(block[k]), int(length[k])
            if size < LEAST + 2:
                continue
            shift = a - int(place[a])
            for i in range(a + 1, a + size - LEAST):  # strictly inside the block
                if i - shift in buckets:
                    inside = {r for r in buckets[i - shift] if i + r[0] < a + size}
                    if inside:
                        buckets.setdefault(i, set()).update(inside)
        found[t] = sorted((i - offset, size, period) for i, group in buckets.items() for size, period in group)
        found[t].sort(key=lambda r: (r[0], r[2]))
    return found


def planted(words: list[bytes], h: int | None) -> list[bytes]:
    """The words with a stretch repeated, as the document's number says."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds beyond its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def _chunks(data: np.ndarray, offsets: np.ndarray, numbers: list[int | None]) -> Iterator[list[list[bytes]]]:
    chunk: list[list[bytes]] = []
    words = 0
    for i, h in enumerate(numbers):
        own = planted(data[offsets[i] : offsets[i + 1]].tobytes().split(), h)
        if chunk and words + len(own) > CHUNK_WORDS:
            yield chunk
            chunk, words = [], 0
        chunk.append(own)
        words += len(own)
    if chunk:
        yield chunk


_COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(documents: DataFrame) -> DataFrame:
    """A row a document: the number of runs, its greatest one, and digests of all runs and of the words that stay."""

    @trimmed
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            data, offsets = binary_column(batch.column(2))
            for chunk in _chunks(data, offsets, batch.column(1).to_pylist()):
                names: dict[bytes, int] = {}
                numbered = [np.array([names.setdefault(w, len(names)) for w in words], np.int64) for words in chunk]
                for words, runs in zip(chunk, runs_of(numbered), strict=True):
                    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                    lines = "".join([f"{a},{n},{q}\n" for a, n, q in runs]).encode()
                    rows.append((len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.string()) for c in columns[5:])], names=[c.split()[0] for c in _COLUMNS.split(", ")])

    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), number.alias("number"), text_bytes().alias("text")).mapInArrow(find, _COLUMNS)
