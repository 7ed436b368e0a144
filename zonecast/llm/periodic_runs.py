"""Periodic runs of words by an enhanced suffix array with the branching-tandem test.

Texts are taken in batches.  A batch's words get a suffix array by prefix
doubling, whose ranks of every level are kept: they compare any two places of a
text, forwards and backwards, in a logarithmic number of look-ups.  Suffixes of
different texts never share a first symbol.

A square that its next word does not continue shows in one interval of common
prefixes, whose depth is the period: its two halves begin in different child
intervals.  So the suffixes of all but the largest child ask the inverse suffix
array whether the place one depth before or after them lies in the interval.
Each square found is rotated to the left as far as the period holds, and squares
with the same ends are one run with the smallest of their periods.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .common import slices, table, utf8
from .hashing import hash_words

#: Bytes of text that share a suffix array; a longer text has one of its own.
BATCH_BYTES = 1 << 19


class SuffixArray:
    """Sorted suffixes of several texts laid end to end; ``first`` and ``end`` bound the text of each word."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        n = len(words)
        ends = np.cumsum(counts)
        self.n = n
        self.first, self.end = np.repeat(ends - counts, counts), np.repeat(ends, counts)
        codes, distinct = pd.factorize(words)
        key = np.repeat(np.arange(len(counts), dtype=np.int64), counts) * max(len(distinct), 1) + codes
        self.order = np.argsort(key, kind="stable")
        slots, rank = np.arange(n), np.empty(n, np.int64)
        head = self._heads(key[self.order])
        rank[self.order] = slots[head]
        self.levels = [rank]
        width = 1
        while True:
            shared = self._shared(head)
            slots, head = slots[shared], head[shared]
            if not len(slots):
                break
            at = self.order[slots]
            follow = np.full(len(at), -1, np.int64)
            inside = at + width < self.end[at]
            follow[inside] = rank[at[inside] + width]
            key = rank[at] * (n + 1) + follow + 1
            new = np.argsort(key, kind="stable")
            self.order[slots] = at[new]
            head = self._heads(key[new])
            rank = rank.copy()
            rank[at[new]] = slots[head]
            self.levels.append(rank)
            width *= 2
        self.rank = rank

    @staticmethod
    def _heads(key: np.ndarray) -> np.ndarray:
        """For each place of a sorted array, the first place with its value."""
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
        return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))

    @staticmethod
    def _shared(head: np.ndarray) -> np.ndarray:
        """Which places share their value with another one."""
        return np.bincount(head, minlength=len(head))[head] > 1

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``a`` and ``b``, different places of one text, have in common."""
        length = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            rank = self.levels[k]
            x, y = a + length, b + length
            inside = np.maximum(x, y) < self.end[a]
            x, y = np.where(inside, x, 0), np.where(inside, y, 0)
            length += (inside & (rank[x] == rank[y])).astype(np.int64) << k
        return length

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words before ``a`` and ``b`` (``a`` < ``b``) that are the same, counted backwards within the text."""
        length = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            rank = self.levels[k]
            x, y = a - length - (1 << k), b - length - (1 << k)
            inside = x >= self.first[a]
            x, y = np.where(inside, x, 0), np.where(inside, y, 0)
            length += (inside & (rank[x] == rank[y])).astype(np.int64) << k
        return length

    def prefixes(self) -> np.ndarray:
        """Common words of each suffix with the one sorted before it; 0 at both ends."""
        out = np.zeros(self.n + 1, np.int64)
        ranks = self.levels[0][self.order]
        k = np.flatnonzero(ranks[1:] == ranks[:-1]) + 1
        out[k] = self.common(self.order[k - 1], self.order[k])
        return out


def _enclosing(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the nearest one before it and after it with a smaller depth."""
    before, after = np.zeros(len(depth), np.int64), np.zeros(len(depth), np.int64)
    stack: list[int] = []
    base, left, right, values = 0, before.tolist(), after.tolist(), depth.tolist()
    for k, v in enumerate(values):
        if not v:
            for t in stack:
                right[t] = k
            stack, base = [], k
            continue
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = k
        left[k] = base if not stack else left[stack[-1]] if values[stack[-1]] == v else stack[-1]
        stack.append(k)
    return np.array(left), np.array(right)


def _squares(sa: SuffixArray, copies: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of every square that the next word does not continue, of runs of ``copies`` periods or more."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    depth = sa.prefixes()
    # A run's interval holds a suffix for each of its whole periods.
    zero = np.flatnonzero(depth == 0)
    depth[np.flatnonzero(np.repeat(np.diff(zero, append=len(depth)) < copies, np.diff(zero, append=len(depth))))] = 0
    if not depth.any():
        return none
    left, right = _enclosing(depth)
    k = np.flatnonzero(depth)
    at = sa.order[k]
    k = k[(right[k] - left[k] >= copies) & (depth[k] * copies <= sa.end[at] - sa.first[at])]
    if not len(k):
        return none
    # Boundaries of one interval side by side; with the interval's ends they bound its children.
    key = left[k] * (sa.n + 1) + right[k]
    by = np.argsort(key, kind="stable")
    k, key = k[by], key[by]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    tails = np.append(heads[1:], len(k))
    starts, ends = np.insert(k, heads, left[k[heads]]), np.insert(k, tails, right[k[heads]])
    per = tails - heads + 1
    low, high, period = (np.repeat(x[k[heads]], per) for x in (left, right, depth))
    size, own = ends - starts, np.repeat(np.arange(len(per)), per)
    largest = np.lexsort((-size, own))[np.cumsum(per) - per]
    small = np.ones(len(size), bool)
    small[largest] = False
    starts, ends, low, high, period, size = (x[small] for x in (starts, ends, low, high, period, size))
    total = np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())
    starts, ends, low, high, period = (np.repeat(x, size) for x in (starts, ends, low, high, period))
    i = sa.order[total]
    found = []
    for j, inside in ((i + period, i + period < sa.end[i]), (i - period, i - period >= sa.first[i])):
        r = np.where(inside, sa.rank[np.where(inside, j, 0)], -1)
        hit = (r >= low) & (r < high) & ((r < starts) | (r >= ends))
        found.append((np.minimum(i, j)[hit], period[hit]))
    start, period = (np.concatenate(x) for x in zip(*found, strict=True))
    pair = np.unique(start * (sa.n + 1) + period)
    return pair // (sa.n + 1), pair % (sa.n + 1)


def runs_of(sa: SuffixArray, copies: int, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of at least ``copies`` periods and ``shortest`` words, by start, then period."""
    start, period = _squares(sa, copies)
    end = start + 2 * period
    start = start - sa.common_before(start, start + period)
    long = end - start >= np.maximum(copies * period, shortest)
    start, end, period = start[long], end[long], period[long]
    # A square of a repeated root has the ends of its root's run.
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


#: Given an id and a number of words, which word stands at each place.
Places = Callable[[int | None, int], np.ndarray | None]
RUN = "struct<start:long,length:long,period:long>"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    ids, texts, size = [], [], 0
    for part in slices(batches, 512):
        for doc, text in zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True):
            if texts and size + len(text or b"") > BATCH_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc)
            texts.append(text or b"")
            size += len(texts[-1])
    if ids:
        yield ids, texts


def periodic_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", copies: int = 4, shortest: int = 6, places: Places | None = None
) -> DataFrame:
    """For each row: doc_id, n_words, runs (start, length, period, in words), collapsed_text.

    A run is a stretch of words with smallest period q, of at least ``copies``
    times q and ``shortest`` words, that no neighbouring word continues.  The
    collapsed text keeps the first q words of each run and the words in no run,
    joined by one space.  A null or empty text has no words, no runs and an empty
    collapsed text.  Rows that repeat an id are documents of their own; other
    columns are not read.  ``places`` lets a caller rearrange the words first.
    ``copies`` is 2 or more.
    """
    if copies < 2:
        raise ValueError("a run repeats its period at least twice")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batches(batches):
            words, counts = hash_words(texts)
            ends = np.cumsum(counts)
            moved = [places(doc, n) if places and n else None for doc, n in zip(ids, counts.tolist(), strict=True)]
            for m, to in zip(moved, ends.tolist(), strict=True):
                if m is not None:
                    words[to - len(m) : to] = words[to - len(m) : to][m]
            start, end, period = runs_of(SuffixArray(words, counts), copies, shortest)
            edge = np.bincount(start + period, minlength=len(words) + 1) - np.bincount(end, minlength=len(words) + 1)
            kept = np.cumsum(edge)[: len(words)] == 0
            cut = np.searchsorted(start, np.append(ends - counts, len(words)))
            collapsed = []
            for t, m, to, n, has in zip(texts, moved, ends.tolist(), counts.tolist(), np.diff(cut).tolist(), strict=True):
                own = t.split()
                if m is not None:
                    own = [own[x] for x in m.tolist()]
                if has:
                    own = [w for w, k in zip(own, kept[to - n : to].tolist(), strict=True) if k]
                collapsed.append(b" ".join(own))
            local = start - np.repeat(ends - counts, np.diff(cut))
            fields = [pa.array(x, pa.int64()) for x in (local, end - start, period)]
            found = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), found),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed_text"],
            )

    ship_package(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed_text string")


def planted(doc: int | None, n: int) -> np.ndarray | None:
    """In one document of ten, by the id, the words from some place on repeat a stretch from there on."""
    h = 1 if doc is None else zlib.crc32(str(doc).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + np.arange(n - a) % p
    return out


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), places=planted)
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    )
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    shown = found.withColumn("top", longest)
    length, period = F.col("top.length"), -F.col("top.period")
    return shown.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )
