"""Helpers that several operators share: words, internal columns, prefix sums."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words; ``bytes.split()`` uses the same six bytes.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.string()).cast(pa.binary()).to_pylist()


#: Rows that Spark hands to Python at once.
BATCH = 512


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands Python at most ``BATCH`` rows at once, or fewer if it says so.

    With Spark's 10,000 rows a batch holds all texts of a split, once in the task
    and once in its worker.  The setting stays, as it is read when a plan runs.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what Python makes of a batch of texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def prefix_sums(
    df: DataFrame,
    group: Sequence[str],
    bucket: str,
    order: Sequence[str],
    value: str,
    out: str,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Add the sum of ``value`` over the rows before each one in its group.

    Rows are ordered by ``bucket``, then by ``order``.  A window runs over one
    bucket of one group only, so a group with a third of all rows is spread over
    its buckets; the buckets' totals (one row each) give the offsets.
    ``group`` and ``bucket`` hold no nulls.  Rows equal in ``order`` are
    interchangeable.  ``totals`` (group, bucket, __total) saves a pass over ``df``.
    """
    keys = [*group, bucket]
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    if totals is None:
        totals = df.groupBy(*keys).agg(F.sum(value).alias("__total"))
    offsets = totals.select(*keys, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(offsets, keys).withColumn(out, F.col("__offset") + F.col("__inside")).drop(
        "__offset", "__inside"
    )
