"""Packing pieces into sequences by minimum bin slack.

Documents are cut into whole windows and one remainder each.  Only the
histogram of the remainders' lengths (at most one row for each length up to the
window) comes to the driver.  There a bitset subset-sum picks, for the longest
length left, the multiset of lengths that fills the window closest to capacity;
the pattern is repeated as often as the counts allow, which uses up a length
each time, so the plan has at most as many patterns as lengths.  Pieces find
their place by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, stage
from .common import prefix_sums, slices, small_batches, table
from .encode import default_vocabulary, encoder

WINDOW = 2048
#: Ranges of the piece's hash in which pieces of one length are ranked.
RANGES = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """Whole windows and one remainder of each document, without their ids.

    A null text is empty: its document is the end id alone.  Rows that repeat
    an id are documents of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), end_id.to_bytes(4, "little")
        for batch in slices(batches, 512):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.ids(text or "") + end
                n = len(ids) // 4
                for at in range(0, n, window):
                    part = ids[4 * at : 4 * (at + window)]
                    rows.append((doc, at, len(part) // 4, zlib.crc32(part), n))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths whose sum comes closest to ``room`` from below.

    Bit s of ``reach`` tells whether a sum s can be made.  Each step adds 1, 2,
    4, ... copies of one length; the bitsets before the steps are kept and
    walked backwards for the counts.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left:
            k = min(copies, left)
            steps.append((length, k, reach))
            reach |= (reach << (k * length)) & mask
            left, copies = left - k, copies * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            total -= k * length
            used[length] = used.get(length, 0) + k
    return used


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first_rank, pieces, first_sequence, each, base).

    Pieces of ``length`` with ranks from ``first_rank`` go ``each`` to a sequence
    from ``first_sequence`` on, side by side from offset ``base``.
    """
    counts = {n: c for n, c in histogram.items() if c}
    used = dict.fromkeys(counts, 0)
    runs, sequence = [], 0
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        pattern = fill(counts, window - longest)
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in pattern.items())
        base = 0
        for n, k in sorted(pattern.items(), reverse=True):
            runs.append((n, used[n], times * k, sequence, k, base))
            used[n] += times * k
            base += n * k
            counts[n] -= times * k
            if not counts[n]:
                del counts[n]
        sequence += times
    return runs


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces (doc_id, start, length, ...).

    Lengths lie in 1..window.  Columns named sequence_id or offset are replaced.
    """
    spark = pieces.sparkSession
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = spark.createDataFrame(
        plan(histogram, window),
        "length long, first_rank long, pieces long, first_sequence long, each long, base long",
    )
    spread = F.pmod(F.xxhash64("doc_id", "start"), F.lit(RANGES)).cast("int")
    ones = pieces.drop("sequence_id", "offset").withColumn("__one", F.lit(1)).withColumn("__range", spread)
    order = [c for c in pieces.columns if c not in ("sequence_id", "offset", "length")]
    ranked = prefix_sums(ones, ["length"], "__range", order, "__one", "__rank")
    behind = F.col("__rank") - F.col("first_rank")
    # At most one run for each pattern and length: a few thousand rows, whatever the corpus.
    found = ranked.join(F.broadcast(runs), "length").where((behind >= 0) & (behind < F.col("pieces")))
    place = {
        "sequence_id": F.col("first_sequence") + F.floor(behind / F.col("each")),
        "offset": F.col("base") + F.pmod(behind, F.col("each")) * F.col("length"),
    }
    return found.withColumns(place).select(*order, "length", *place)


def packed_documents(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = stage(cut_pieces(docs, vocabulary or default_vocabulary(), window=window), "pieces")
    return pack(pieces, window)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
