"""Mixing sources to target weights with DataFrame functions only.

Each document gets a hash-random key.  Within a source the documents are sorted
by that key in 4,096 ranges of its first three hexadecimal digits, their word counts are summed up to a running position, and the
source is cut at its exact budget; a budget beyond the source's size takes whole
epochs first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import prefix_sums, table, word_count


@dataclass(frozen=True)
class Mix:
    """Weights repeat over the sources by code point, null last; ``share`` of all words is
    taken; no source gives more than ``cap`` times its size."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    cap: float = 2.0


def source_targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``sizes``: __source, source_size.  Returns them with ``target``.

    Sources are ranked by range partitions and offsets, not in one task.  What a
    source cannot take is shared among the others by weight, round after round,
    each round one small aggregate, until none is above its cap.
    """
    spark = sizes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("__source").asc_nulls_last()
    # Written, so that a row's partition cannot change between its two uses.
    sorted_ = stage(
        sizes.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id()), "sources"
    )
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sorted_.groupBy("__part").count().select(
        "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first")
    )
    place = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    ranked = sorted_.withColumn("__in", place).join(offsets, "__part")
    weight = F.element_at(
        F.array(*map(F.lit, mix.weights)), (F.pmod(F.col("__first") + F.col("__in"), F.lit(len(mix.weights))) + 1).cast("int")
    )
    ranked = ranked.select("__source", "source_size", weight.cast("double").alias("__weight"))
    ranked = stage(ranked, "source_weights")
    most = F.col("source_size") * mix.cap
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * mix.share
    level = 0.0
    while True:
        full = most <= level * F.col("__weight")
        row = ranked.agg(
            F.sum(F.when(full, most)).alias("full"), F.sum(F.when(~full, F.col("__weight"))).alias("weight")
        ).first()
        if not row.weight:
            break
        new = (total - (row.full or 0.0)) / row.weight
        if new <= level:
            break
        level = new
    target = F.when(most <= level * F.col("__weight"), most).otherwise(level * F.col("__weight"))
    return ranked.select("__source", "source_size", target.alias("target"))


def random_key(key: Column) -> Column:
    """Hash-random, the same in every run."""
    return F.md5(F.coalesce(key.cast("string"), F.lit("")))


def mix(docs: DataFrame, size: Column, plan: Mix = Mix(), key: str = "doc_id", source: str = "source") -> DataFrame:
    """Rows with size, source_size, target, taken added (columns of these names are replaced).

    ``size`` is the words of a row.  ``taken`` counts the words that the mix
    takes of a row: whole epochs, then the part below the cut, so that a source's
    taken words are its target to the nearest word.  A null source is a source of
    its own.  Documents of size 0 take nothing.  Rows that repeat an id count
    as separate documents; equal ones are interchangeable.
    """
    added = ["size", "source_size", "target", "taken"]
    rest = [c for c in docs.columns if c not in added]
    tagged = docs.select(
        F.struct(*rest).alias("__row"),
        F.col(source).alias("__source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("")).alias("__name"),
        random_key(F.col(key)).alias("__key"),
        F.col(key).alias("__id"),
        size.alias("size"),
    ).withColumn("__range", F.conv(F.substring("__key", 1, 3), 16, 10).cast("int"))
    sums = tagged.groupBy("__name", "__range").agg(
        F.first("__source").alias("__source"), F.sum("size").alias("__total")
    )
    sums = stage(sums, "range_sums")
    sizes = sums.groupBy("__name").agg(F.first("__source").alias("__source"), F.sum("__total").alias("source_size"))
    targets = source_targets(sizes.drop("__name"), plan)
    targets = targets.withColumn("__name", F.coalesce(F.concat(F.lit("s"), F.col("__source")), F.lit(""))).drop("__source")
    placed = prefix_sums(tagged, ["__name"], "__range", ["__key", "__id", "size"], "size", "__at", sums)
    placed = placed.join(targets, "__name")
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = F.least(F.greatest(budget - epochs * F.col("source_size") - F.col("__at"), F.lit(0)), F.col("size"))
    taken = (F.col("size") * epochs + left).cast("long")
    return placed.withColumn("taken", taken).select("__row.*", *added)


def mixed_documents(docs: DataFrame, plan: Mix = Mix()) -> DataFrame:
    """The mix as documents: a row for each epoch that takes words of it.

    Documents stay whole: the one that crosses the cut is kept, so a source
    exceeds its target by less than one document.
    """
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("doc"), "doc_id", "source", word_count(F.col("text")).alias("words"))
    mixed = mix(rows, F.col("words"), plan)
    copies = F.ceil(F.col("taken") / F.greatest(F.col("words"), F.lit(1))).cast("int")
    taken = mixed.where("taken > 0").select("doc", F.explode(F.sequence(F.lit(1), copies)))
    return taken.select("doc.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")), "sizes")
    return mix(sized, F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         1.5 * sum(source_size) OVER () AS total
  FROM s
), l AS (
  SELECT *, (total::DOUBLE - coalesce(sum(2.0 * source_size) OVER f, 0)::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
  FROM w WINDOW f AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least((2.0 * source_size)::DOUBLE, weight * (
           SELECT level FROM l WHERE 2.0 * source_size > weight * level
           ORDER BY 2.0 * source_size / weight, source NULLS LAST LIMIT 1)) AS target
  FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source
           ORDER BY md5(d.doc_id::VARCHAR), d.doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (budget // greatest(source_size, 1))
        + least(greatest(budget - (budget // greatest(source_size, 1)) * source_size - pos, 0), size))::BIGINT AS taken
FROM p
"""
