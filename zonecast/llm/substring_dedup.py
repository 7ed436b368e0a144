"""Repeated passages: difference-cover anchors, then extension to whole windows.

``COVER`` is a difference cover modulo ``PERIOD``: for any two positions there
is a shift below the period that puts both on the cover.  Two equal windows of
``window`` words therefore share an aligned anchor of ``window - PERIOD + 1``
words.  Pass one hashes anchors at cover positions only; pass two extends each
repeated anchor to the windows that hold it and hashes those; pass three removes
the words that repeated windows cover.

Documents travel in blocks of compressed texts.  What a block asks about is one
sorted array of distinct hashes, cut into ranges of the hash space; a range
answers with one bit for each hash, so a passage in every document is asked
about once a block, and no list of its places is ever built.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, stage
from .blocks import block_texts, each_row, text_blocks
from .common import table
from .hashing import U, by_range, hash_words, windows

WINDOW = 35
#: A perfect difference set, every difference modulo 21 occurs.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
#: Words of text for each range of the hash space, about 8 MB of anchors.
RANGE_WORDS = 4_000_000

#: Hash with its check bits: 80 bits tell windows apart.
KEY = np.dtype([("hash", "<u8"), ("check", "<u2")])


def _keys(words: np.ndarray, width: int) -> np.ndarray:
    keys = np.empty(max(len(words) - width + 1, 0), KEY)
    keys["hash"] = windows(words, width, 1)
    keys["check"] = windows(words, width, 2) >> U(48)
    return keys


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, which of them occur twice, and where each key went."""
    order = np.lexsort((keys["check"], keys["hash"]))
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    group = np.cumsum(new) - 1
    place = np.empty(len(s), np.int64)
    place[order] = group
    return s[new], np.bincount(group, minlength=int(new.sum())) > 1 if len(s) else np.empty(0, bool), place


class _Block:
    """Anchors and candidate windows of one block, the same each time they are computed.

    The words of all its documents lie end to end; ``first`` and ``last`` bound
    the document of each word.
    """

    def __init__(self, texts: bytes, sizes: list[int], window: int):
        self.window, self.width = window, window - PERIOD + 1
        self.texts = block_texts(texts, sizes)
        self.hashes, self.counts = hash_words(self.texts)
        ends = np.cumsum(self.counts)
        self.first, self.last = np.repeat(ends - self.counts, self.counts), np.repeat(ends, self.counts)
        place = np.arange(len(self.hashes))
        fits = (self.last - self.first >= window) & (place + self.width <= self.last)
        self.places = np.flatnonzero(fits & np.isin((place - self.first) % PERIOD, COVER))

    def anchors(self) -> np.ndarray:
        return _keys(self.hashes, self.width)[self.places] if len(self.places) else np.empty(0, KEY)

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a repeated anchor."""
        hit = self.places[repeated]
        low = np.maximum(hit - PERIOD + 1, self.first[hit])
        high = np.minimum(hit, self.last[hit] - self.window)
        return np.flatnonzero(_covered(low, high + 1, len(self.hashes)))

    def window_keys(self, starts: np.ndarray) -> np.ndarray:
        return _keys(self.hashes, self.window)[starts] if len(starts) else np.empty(0, KEY)


def _covered(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a range from ``low`` up to but not including ``high``."""
    edge = np.bincount(low, minlength=n + 1) - np.bincount(high, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def _ask(block: int, keys: np.ndarray, ranges: int) -> Iterator[tuple]:
    """(range, block, hashes, twice): what one block asks of each range."""
    distinct, twice, _ = _distinct(keys)
    for r, lo, hi in by_range(distinct["hash"], ranges):
        yield r, block, distinct[lo:hi].tobytes(), np.packbits(twice[lo:hi]).tobytes()


def _answered(keys: np.ndarray, replies: list[dict] | None) -> np.ndarray:
    """For each key, whether its range found it repeated."""
    distinct, _, place = _distinct(keys)
    bits = [
        np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"])
        for r in sorted(replies or [], key=lambda r: r["range"])
    ]
    known = np.concatenate(bits).astype(bool) if bits else np.empty(0, bool)
    assert len(known) == len(distinct)
    return known[place]


ASKED = "range int, block long, hashes binary, twice binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["range", "block", "hashes", "twice"])


def _answers(asked: DataFrame) -> DataFrame:
    """(block, replies): for each block the bits of all ranges."""

    def run(tables: pa.Table) -> pa.Table:
        keys = [np.frombuffer(b, KEY) for b in tables.column("hashes").to_pylist()]
        own = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(k)) for b, k in zip(tables.column("twice").to_pylist(), keys, strict=True)]
        distinct, twice, place = _distinct(np.concatenate(keys))
        known = twice | (np.bincount(place, np.concatenate(own), minlength=len(distinct)) > 0)
        bits, at = [], 0
        for k in keys:
            bits.append(np.packbits(known[place[at : at + len(k)]]).tobytes())
            at += len(k)
        return pa.table(
            {
                "block": tables.column("block"),
                "range": tables.column("range"),
                "n": pa.array([len(k) for k in keys], pa.int64()),
                "bits": pa.array(bits, pa.binary()),
            }
        )

    told = asked.groupBy("range").applyInArrow(run, "block long, range int, n long, bits binary")
    return told.groupBy("block").agg(F.collect_list(F.struct("range", "n", "bits")).alias("replies"))


def _map_blocks(blocks: DataFrame, one: Callable[[dict], list[tuple]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            yield _rows(one(row))

    return blocks.mapInArrow(run, ASKED)


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = False
) -> DataFrame:
    """For each row: doc_id, n_words, n_removed, kept_sha256, and kept_text if asked for.

    A word goes when it lies in a window whose words also start anywhere else in
    the table, the same document included.  A null text has no words.  Rows that
    repeat an id are documents of their own, so their passages repeat.  Other
    columns are not read.
    """
    if window < PERIOD + 5:
        raise ValueError(f"a window holds at least {PERIOD + 5} words")
    spark = docs.sparkSession
    packed = stage(text_blocks(docs, key, text), "blocks")
    total = packed.agg(F.sum("n_words")).first()[0] or 0
    ranges = max(8, -(-total // RANGE_WORDS))

    def ask_anchors(row: dict) -> list[tuple]:
        return list(_ask(row["block"], _Block(row["texts"], row["sizes"], window).anchors(), ranges))

    def ask_windows(row: dict) -> list[tuple]:
        b = _Block(row["texts"], row["sizes"], window)
        starts = b.candidates(_answered(b.anchors(), row["anchors"]))
        return list(_ask(row["block"], b.window_keys(starts), ranges))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            b = _Block(row["texts"], row["sizes"], window)
            starts = b.candidates(_answered(b.anchors(), row["anchors"]))
            hit = starts[_answered(b.window_keys(starts), row["windows"])]
            gone = _covered(hit, hit + window, len(b.hashes))
            out, at = [], 0
            for doc, text, n in zip(row["docs"], b.texts, b.counts.tolist(), strict=True):
                words, out_of = text.split(), gone[at : at + n]
                at += n
                removed = int(out_of.sum())
                if removed:
                    words = [w for w, g in zip(words, out_of.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                out.append((doc, n, removed, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            arrays[4] = arrays[4].cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    ship_package(spark)
    body = packed.select("block", "docs", "texts", "sizes")
    anchors = _answers(_map_blocks(body, ask_anchors)).withColumnRenamed("replies", "anchors")
    anchors = stage(anchors, "anchors")
    with_anchors = body.join(anchors, "block", "left")
    found = stage(_answers(_map_blocks(with_anchors, ask_windows)).withColumnRenamed("replies", "windows"), "windows")
    done = with_anchors.join(found, "block", "left").mapInArrow(
        finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
    return done if with_text else done.drop("kept_text")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
