"""Exact duplicates: a two-pass Bloom filter keeps unique texts out of the shuffle.

Pass one sets bits for every digest and keeps the bits that were set at least
twice.  A digest all of whose bits were set twice is possibly repeated; only
those rows are grouped, the rest pass straight through.

The filter has ``BITS_PER_ROW`` bits a row, up to ``MAX_BITS`` (a broadcast of
at most 64 MB).  A fuller filter lets more unique rows into the grouping and
changes no result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .common import SPACE

BITS_PER_ROW = 16
MAX_BITS = 1 << 29
#: Bits of one piece of the filter, as ``bitmap_construct_agg`` makes them (fixed by Spark).
PIECE = 32768


def normalised(text: Column) -> Column:
    """The text without its white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def filter_bits(rows: int) -> int:
    """A power of two of at least one piece."""
    return min(MAX_BITS, 1 << max(15, math.ceil(math.log2(max(rows, 1) * BITS_PER_ROW))))


def _positions(digest: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(seed)), F.lit(bits)) for seed in (1, 2)]


def repeat_filter(digests: DataFrame, bits: int, times: int = 2) -> DataFrame:
    """The bits set at least ``times`` times, as (piece, bitmap); at most ``bits / PIECE`` rows of 4 KB."""
    at = digests.select(F.explode(F.array(*_positions(F.col("digest"), bits))).alias("bit"))
    twice = at.groupBy("bit").count().where(F.col("count") >= times)
    return twice.groupBy((F.col("bit") / PIECE).cast("long").alias("piece")).agg(
        F.expr(f"bitmap_construct_agg(bit % {PIECE})").alias("bitmap")
    )


def flag_possible(df: DataFrame, digest: str, repeats: DataFrame, bits: int, out: str) -> DataFrame:
    """Add a flag: may the digest of this row occur more than once?"""
    hit = F.lit(True)
    for k, at in enumerate(_positions(F.col(digest), bits)):
        piece = F.broadcast(repeats.select(F.col("piece").alias(f"__p{k}"), F.col("bitmap").alias(f"__m{k}")))
        df = df.withColumn(f"__at{k}", at).join(
            piece, (F.col(f"__at{k}") / PIECE).cast("long") == F.col(f"__p{k}"), "left"
        )
        byte = F.expr(f"conv(hex(substring(__m{k}, cast((__at{k} % {PIECE}) / 8 as int) + 1, 1)), 16, 10)")
        bit = F.expr(f"cast(__at{k} % 8 as int)")
        shifted = F.call_function("shiftright", byte.cast("int"), bit)
        hit = hit & F.coalesce(shifted.bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return df.withColumn(out, hit).drop(*(f"__{n}{k}" for n in ("at", "p", "m") for k in (0, 1)))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after deleting white space; a null
    text counts as empty, so null, empty and blank texts are one group.  Of a
    group the row with the most code points stays, then the smallest id (a null
    id sorts last).  Of rows that also repeat the id, exactly one is marked
    kept.  An empty table gives no rows; other columns are not read.
    """
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        F.sha2(normalised(F.col(text)), 256).alias("digest"),
        F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n"),
        F.monotonically_increasing_id().alias("row"),
    )
    return _groups(stage(narrow, "digests"))


def _groups(rows: DataFrame) -> DataFrame:
    """``rows`` is a written table: it is read once for the filter and twice for the groups."""
    bits = filter_bits(rows.count())
    flagged = flag_possible(rows, "digest", repeat_filter(rows, bits), bits, "maybe")
    single = flagged.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"),
    )
    # The rows of a group are only combined map-side; a huge group stays divisible in the join.
    maybe = flagged.where("maybe")
    first = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    best = maybe.groupBy("digest").agg(F.min(first).alias("best"), F.count(F.lit(1)).alias("group_size"))
    grouped = maybe.join(best, "digest").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), F.col("digest").alias("text_sha256"),
    )
    return single.unionByName(grouped)


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    Rows whose digest is not possibly repeated pass without a shuffle.  Of the
    rest, the rows that lost are found on narrow columns; a row stays when it is
    the best of its digest.
    """
    names = docs.columns
    digest = F.sha2(normalised(F.col(text)), 256)
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    rows = stage(docs.select(F.col(key).alias("doc_id"), digest.alias("digest"), n.alias("n")), "digests")
    bits = filter_bits(rows.count())
    repeats = repeat_filter(rows, bits)
    whole = docs.select(F.struct(*names).alias("__row"), digest.alias("__digest"))
    whole = flag_possible(whole, "__digest", repeats, bits, "__maybe")
    single = whole.where(~F.col("__maybe")).select("__row.*")
    first = F.struct(
        (-F.coalesce(F.length(F.col("__row")[text]), F.lit(0))).alias("n"),
        F.col("__row")[key].isNull().alias("no_id"),
        F.col("__row")[key].alias("doc_id"),
    )
    # A group's best row is chosen map-side first, so that a huge group sends one row a task.
    best = whole.where("__maybe").groupBy("__digest").agg(F.min_by("__row", first).alias("__row"))
    return single.unionByName(best.select("__row.*"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
         length(coalesce(text, '')) AS n
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
