"""Exact length histogram of encoded documents, and what follows from its suffix sums."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package, stage
from .common import prefix_sums, slices, table
from .encode import default_vocabulary, encoder

#: Lengths in one block of the suffix sums.
BLOCK = 1024


def lengths(docs: DataFrame, vocabulary: str, group: str = "source") -> DataFrame:
    """(group, length) of every document; a null text has length 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in slices(batches, 512):
            counts = [len(enc.ids(t or "")) // 4 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), pa.array(counts, pa.int64())], ["group", "length"]
            )

    ship_package(docs.sparkSession)
    return docs.select(F.col(group).cast("string").alias("group"), "text").mapInArrow(
        run, "group string, length long"
    )


def histogram(docs: DataFrame, vocabulary: str | None = None, group: str = "source") -> DataFrame:
    """(group, length, n_docs), written once; a null group is a group of its own."""
    each = lengths(docs, vocabulary or default_vocabulary(), group)
    return stage(each.groupBy("group", "length").agg(F.count(F.lit(1)).alias("n_docs")), "lengths")


def context_table(hist: DataFrame) -> DataFrame:
    """One row for each group and length that occurs, with that length as the context limit.

    n_docs: documents of this length; docs_below: shorter ones; docs_longer:
    longer ones; tokens_to: tokens of documents that fit; truncated_total:
    tokens left when every document is cut at the limit; quantile: share of the
    group's documents that fit.  An empty table gives no rows.
    """
    named = hist.withColumn("__name", F.coalesce(F.concat(F.lit("g"), F.col("group")), F.lit("")))
    named = named.withColumn("__block", (F.col("length") / BLOCK).cast("long"))
    named = named.withColumn("__tokens", F.col("n_docs") * F.col("length"))
    below = prefix_sums(named, ["__name"], "__block", ["length"], "n_docs", "docs_below")
    below = prefix_sums(below, ["__name"], "__block", ["length"], "__tokens", "tokens_below")
    all_docs = hist.groupBy("group").agg(
        F.sum("n_docs").alias("__docs"), F.sum(F.col("n_docs") * F.col("length")).alias("total_tokens")
    )
    joined = below.join(
        all_docs.withColumnRenamed("group", "__g"), F.col("group").eqNullSafe(F.col("__g"))
    )
    longer = F.col("__docs") - F.col("docs_below") - F.col("n_docs")
    fits = F.col("tokens_below") + F.col("__tokens")
    return joined.select(
        "group", "length", "n_docs", "docs_below", longer.alias("docs_longer"), fits.alias("tokens_to"),
        (fits + longer * F.col("length")).alias("truncated_total"), "total_tokens",
        ((F.col("docs_below") + F.col("n_docs")) / F.col("__docs")).alias("quantile"),
    )


def at_limit(contexts: DataFrame, limit: int) -> DataFrame:
    """Per group: tokens kept and documents cut at any limit, from the last length that fits."""
    last = contexts.where(F.col("length") <= limit).groupBy("group").agg(
        F.max_by(F.struct("docs_longer", "tokens_to"), "length").alias("at")
    )
    totals = contexts.groupBy(F.col("group").alias("__g")).agg(
        F.max("total_tokens").alias("total_tokens"), F.sum("n_docs").alias("n_docs")
    )
    joined = totals.join(last, F.col("__g").eqNullSafe(F.col("group")), "left")
    longer = F.coalesce(F.col("at.docs_longer"), F.col("n_docs"))
    kept = F.coalesce(F.col("at.tokens_to"), F.lit(0)) + longer * limit
    return joined.select(F.col("__g").alias("group"), longer.alias("docs_cut"), kept.alias("tokens_kept"), "total_tokens")


def quantile(contexts: DataFrame, q: float) -> DataFrame:
    """Per group: the smallest length that at least a share ``q`` of the documents does not exceed."""
    return contexts.where(F.col("quantile") >= q).groupBy("group").agg(F.min("length").alias("length"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_table(histogram(table(spark, sf_dir, "documents"))).withColumnRenamed("group", "source")
