"""Language-model scores of whole documents.

Texts are hashed once: blocks are written with numbers for tokens, beside the
distinct hashes that the numbers stand for.

Word counts: each block asks every range of the hash space for its
distinct words and brings its own training counts along; a range adds them up
and answers with the corpus count of each word asked for.  So every count covers
all training documents, and no vocabulary is broadcast.

The recurrent model knows the most frequent words (``SYMBOLS``, a bounded table);
a rarer word is its class's share times the word's share in that class.  It is
trained side by side in all tasks on every training document, each in the round
that a hash of its id picks; after each round the weights are averaged.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, stage
from . import gru
from .blocks import block_texts, each_row, text_blocks
from .common import table
from .hashing import U, by_range, hash_words

SYMBOLS = 4096
#: Rounds of averaging; every training document is in one of them.
ROUNDS = 2
BLOCK_BYTES = 8 << 20
#: Texts that train side by side in a task, and the tokens that are gathered for them (texts stay whole).
LANES, LANE_TOKENS = 256, 4_000_000
#: Words of text for each range of the hash space.
RANGE_WORDS = 4_000_000
#: Stands for the end of a text among the word hashes.
END = U(0)


def held_out(doc: int | None) -> bool:
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0


def _picked(doc: int | None, round_: int) -> bool:
    return not held_out(doc) and xxhash.xxh3_64_intdigest(str(doc).encode()) % ROUNDS == round_


def _whole_texts(row: dict, symbols: _Symbols, round_: int) -> list[np.ndarray]:
    """Symbols of the block's documents of this round, each from its first token to its end."""
    chosen = [_picked(d, round_) for d in row["docs"]]
    if not any(chosen):
        return []
    texts = _Block(row).texts(symbols)
    return [t for t, c in zip(texts, chosen, strict=True) if c]


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts end to end, and how many each text has; every text closes with its end."""
    words, counts = hash_words(texts, lower=True)
    return np.insert(words, np.cumsum(counts), END), counts + 1


def _numbered(texts: list[bytes]) -> tuple[list[int], bytes, bytes]:
    """Tokens of each text, the sorted distinct hashes, and every token as a number into those, a plane of bytes after the other."""
    hashes, sizes = _tokens(texts)
    codes, distinct = pd.factorize(hashes)
    order = np.argsort(distinct, kind="stable")
    place = np.empty(len(order), "<u4")
    place[order] = np.arange(len(order))
    planes = place[codes].view(np.uint8).reshape(-1, 4).T
    return sizes.tolist(), distinct[order].tobytes(), zstandard.compress(planes.tobytes(), 1)


NUMBERED = "block long, docs array<long>, sizes array<long>, n_tokens long, hashes binary, codes binary"


def _number_blocks(blocks: DataFrame) -> DataFrame:
    """``text_blocks`` with numbers for tokens: no later step hashes a text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            sizes, hashes, codes = _numbered(block_texts(row["texts"], row["sizes"]))
            many, large = pa.list_(pa.int64()), pa.binary()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["block"]], pa.int64()), pa.array([row["docs"]], many), pa.array([sizes], many),
                    pa.array([sum(sizes)], pa.int64()), pa.array([hashes], large), pa.array([codes], large),
                ],
                ["block", "docs", "sizes", "n_tokens", "hashes", "codes"],
            )

    return blocks.select("block", "docs", "texts", "sizes").mapInArrow(run, NUMBERED)


class _Block:
    """A block's words as numbers into its sorted distinct hashes."""

    def __init__(self, row: dict):
        self.docs, self.sizes = row["docs"], np.array(row["sizes"], np.int64)
        self.distinct = np.frombuffer(row["hashes"], U)
        planes = np.frombuffer(zstandard.decompress(row["codes"]), np.uint8).reshape(4, -1)
        self.codes = np.ascontiguousarray(planes.T).view("<u4").ravel()
        self.train = np.array([not held_out(d) for d in self.docs])

    def texts(self, symbols: _Symbols) -> list[np.ndarray]:
        return np.split(symbols.of(self.distinct).astype(np.int32)[self.codes], np.cumsum(self.sizes)[:-1])

    def counts(self) -> np.ndarray:
        return np.bincount(self.codes[np.repeat(self.train, self.sizes)], minlength=len(self.distinct))


def _ask(row: dict, ranges: int) -> Iterator[tuple]:
    b = _Block(row)
    counts = b.counts().astype("<u4")
    for r, lo, hi in by_range(b.distinct, ranges):
        yield r, row["block"], b.distinct[lo:hi].tobytes(), zstandard.compress(counts[lo:hi].tobytes(), 1)


def _counted(blocks: DataFrame, ranges: int, top: int) -> DataFrame:
    """(block, range, counts, tokens, distinct, words, word_counts); the last four once a range."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            columns = zip(*_ask(row, ranges), strict=True)
            types = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["range", "block", "hashes", "counts"]
            )

    def add(t: pa.Table) -> pa.Table:
        keys = [np.frombuffer(b, U) for b in t.column("hashes").to_pylist()]
        own = [np.frombuffer(zstandard.decompress(b), "<u4") for b in t.column("counts").to_pylist()]
        codes, distinct = pd.factorize(np.concatenate(keys))
        total = np.bincount(codes, np.concatenate(own), minlength=len(distinct)).astype("<u8")
        out, at = [], 0
        for k in keys:
            out.append(zstandard.compress(total[codes[at : at + len(k)]].tobytes(), 1))
            at += len(k)
        best = np.lexsort((distinct, -total.astype(np.int64)))[:top]
        best = best[total[best] > 0]
        rest = len(keys) - 1
        once = lambda x, empty: [x] + [empty] * rest
        return pa.table(
            {
                "block": t.column("block"),
                "range": t.column("range"),
                "counts": pa.array(out, pa.binary()),
                "tokens": pa.array(once(int(total.sum()), 0), pa.int64()),
                "distinct": pa.array(once(int((total > 0).sum()), 0), pa.int64()),
                "words": pa.array(once(distinct[best].astype(np.int64).tolist(), None), pa.list_(pa.int64())),
                "word_counts": pa.array(once(total[best].astype(np.int64).tolist(), None), pa.list_(pa.int64())),
            }
        )

    asked = blocks.mapInArrow(ask, "range int, block long, hashes binary, counts binary")
    return asked.groupBy("range").applyInArrow(
        add,
        "block long, range int, counts binary, tokens long, distinct long, words array<long>, word_counts array<long>",
    )


class _Symbols:
    """Which words the model knows: hashes by symbol, sorted for the search."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        n = len(self.sorted)
        if not n:
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, hashes), n - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], n)


def _train_round(blocks: DataFrame, symbols: _Symbols, classes: gru.Classes, weights: dict, round_: int) -> dict:
    """Each task trains a copy on its blocks; copies are averaged by their tokens, ``FAN`` at a time."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast((symbols, classes, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, classes, start = shared.value
        w = {k: v.copy() for k, v in start.items()}
        squares, tokens = gru.fresh_squares(w), 0
        own: list[np.ndarray] = []
        for row in each_row(batches):
            own += _whole_texts(row, symbols, round_)
            if sum(map(len, own)) >= LANE_TOKENS:
                tokens += gru.train(w, classes, own, squares, lanes=LANES)
                own = []
        tokens += gru.train(w, classes, own, squares, lanes=LANES)
        if tokens:
            flat = np.frombuffer(gru.pack(w), np.float32).astype(np.float64) * tokens
            yield _weights_row(flat, tokens)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens = None, 0
        for row in each_row(batches):
            flat = np.frombuffer(row["weights"], np.float32).astype(np.float64) * row["tokens"]
            total = flat if total is None else total + flat
            tokens += row["tokens"]
        if tokens:
            yield _weights_row(total, tokens)

    schema = "weights binary, tokens long"
    copies = blocks.mapInArrow(run, schema)
    parts = copies.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN)
        copies = copies.repartition(parts).mapInArrow(add, schema)
    rows = copies.collect()
    return gru.unpack(rows[0].weights, weights) if rows else weights


#: Weight copies that one task averages.
FAN = 16


def _weights_row(total: np.ndarray, tokens: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary()), pa.array([tokens], pa.int64())],
        ["weights", "tokens"],
    )


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    A null or empty text is its end token alone.  A null id counts as the empty
    text in the hash, which makes its row held out.  Rows that repeat an id are
    documents of their own.  Without training documents the base score of every
    token is log10 of one, and so is the score.
    """
    spark = docs.sparkSession
    ship_package(spark)
    blocks = stage(_number_blocks(text_blocks(docs, key, text, BLOCK_BYTES, 1 << 16)), "numbered-blocks")
    size = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    ranges = max(8, -(-size // RANGE_WORDS))
    body = blocks.drop("n_tokens")
    # Words fall evenly on the ranges, so a few times its share of the symbols holds a range's frequent ones.
    counted = stage(_counted(body, ranges, 4 * SYMBOLS // ranges + 100), "word-counts")
    n, v = (x or 0 for x in counted.agg(F.sum("tokens"), F.sum("distinct")).first())
    word = F.explode(F.arrays_zip("words", "word_counts"))
    best = counted.where("words is not null").select(word.alias("w")).select("w.*")
    best = best.orderBy(F.desc("word_counts"), "words").limit(SYMBOLS).collect()
    hashes = np.array([r.words for r in best], np.int64).view(U)
    known = np.array([float(r.word_counts) for r in best])
    rest = float(n - known.sum())
    classes, symbols = gru.Classes(known, rest), _Symbols(hashes)
    weights = gru.initial(classes)
    if n:
        for round_ in range(ROUNDS):
            weights = _train_round(body, symbols, classes, weights, round_)
    shared = spark.sparkContext.broadcast((symbols, classes, weights))
    rare_types = v - len(best)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, classes, weights = shared.value
        rows, texts, tokens = [], [], 0

        def scored() -> pa.RecordBatch:
            docs, train, sizes, known, base, rare = (np.concatenate(x) for x in zip(*rows, strict=True))
            model = gru.scores(weights, classes, texts) / math.log(10) + rare
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(docs, pa.int64()),
                    pa.array(~train.astype(bool), pa.bool_()),
                    pa.array(sizes, pa.int64()),
                    pa.array(known.astype(np.int64), pa.int64()),
                    pa.array(np.full(len(docs), n), pa.int64()),
                    pa.array(base, pa.float64()),
                    pa.array(model, pa.float64()),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        for row in each_row(batches):
            b = _Block(row)
            parts = sorted(row["replies"], key=lambda r: r["range"])
            c = np.concatenate([np.frombuffer(zstandard.decompress(p["counts"]), "<u8") for p in parts]).astype(np.float64)
            base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
            symbol = symbols.of(b.distinct)
            rare = np.where(symbol == classes.n, np.log10((c + 0.1) / (rest + 0.1 * (rare_types + 1))), 0.0)
            owner = np.repeat(np.arange(len(b.docs)), b.sizes)
            total = lambda x: np.bincount(owner, x[b.codes], minlength=len(b.docs))
            ids = np.array(b.docs, object)
            rows.append((ids, b.train, b.sizes, total((c > 0).astype(float)), total(base), total(rare)))
            texts += b.texts(symbols)
            tokens += int(b.sizes.sum())
            # Texts of several blocks run side by side.
            if tokens >= LANE_TOKENS:
                yield scored()
                rows, texts, tokens = [], [], 0
        if rows:
            yield scored()

    replies = counted.groupBy("block").agg(F.collect_list(F.struct("range", "counts")).alias("replies"))
    return body.join(replies, "block").mapInArrow(
        finish,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
