"""Documents in blocks of compressed texts, for operators that read whole texts several times.

A block has a number that is fixed once the blocks are written, so answers about
its words can be joined to it by that number, and texts are shuffled compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import utf8

#: A block closes at this many bytes of text or documents; a longer document is a block of its own.
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 4096


def text_blocks(
    docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS
) -> DataFrame:
    """(block, docs, texts, sizes, n_words): texts joined and compressed, ids and byte sizes beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal made
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 40 | made], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([zstandard.compress(b"".join(texts), 1)], pa.binary()),
                    pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                    pa.array([sum(t.count(b" ") + 1 for t in texts)], pa.int64()),
                ],
                ["block", "docs", "texts", "sizes", "n_words"],
            )
            made += 1
            return row

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                ids.append(doc)
                texts.append(text or b"")
                size += len(texts[-1])
                if size >= block_bytes or len(ids) >= block_docs:
                    yield close()
                    ids, texts, size = [], [], 0
        if ids:
            yield close()

    ship_package(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "block long, docs array<long>, texts binary, sizes array<long>, n_words long"
    )


def block_texts(texts: bytes, sizes: list[int]) -> list[bytes]:
    """The texts of a block."""
    text, out, at = zstandard.decompress(texts) if sum(sizes) else b"", [], 0
    for size in sizes:
        out.append(text[at : at + size])
        at += size
    return out


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]
