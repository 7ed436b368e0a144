"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length (geometric steps), long groups are cut into
blocks.  A first comparison with the longest block gives each query a lower
bound of its k-th score.  For a block, that bound over the lengths of query and
block is the cosine a vector must reach: above 1 the block is skipped, a high one
prunes by coordinates, a low one by length; what is left is multiplied out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package, stage
from .common import table

#: Vectors in one block, and the ratio of lengths in one bucket.
BLOCK, STEP = 4096, 1.05
#: From this cosine on a block is pruned by coordinates, on so many of the query's largest ones.
COORDINATES_FROM, FOCUS = 0.7, 4
BLOB = "ids binary, rows binary, norms binary, vectors binary, dim long"


def integers(table_: DataFrame, key: str, vector: str, factor: float) -> DataFrame:
    """(row, vec_id, norm, vector): floor(factor * x) of every valid vector; vectors that are null or
    hold a null or non-finite component, and rows with a null id, take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, key_, v in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if v is None or key_ is None or any(x is None for x in v):
                    continue
                x = np.array(v, np.float64)
                if np.isfinite(x).all():
                    whole = np.floor(factor * x).astype(np.int64)
                    rows.append((row, key_, float(np.sqrt((whole.astype(float) ** 2).sum())), whole.tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = [pa.int64(), pa.int64(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["row", "vec_id", "norm", "vector"]
            )

    ship_package(table_.sparkSession)
    rows = table_.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long"), F.col(vector).cast("array<double>"))
    return rows.mapInArrow(run, "row long, vec_id long, norm double, vector binary")


def blocks(vectors: DataFrame) -> DataFrame:
    """(block, top, ids, rows, norms, vectors, dim): at most about ``BLOCK`` vectors of like length a row."""
    bucket = F.when(F.col("norm") > 0, F.ceil(F.log("norm") / F.log(F.lit(STEP)))).otherwise(F.lit(-10_000)).cast("int")
    tagged = vectors.withColumn("bucket", bucket)
    # Buckets are steps of the logarithm of a double: some thousands at most.
    sizes = tagged.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("cuts"))
    before = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("first", F.coalesce(F.sum("cuts").over(before), F.lit(0)))
    number = F.col("first") + F.pmod(F.xxhash64("row"), F.col("cuts"))
    tagged = tagged.join(F.broadcast(sizes), "bucket").select(number.cast("long").alias("block"), "row", "vec_id", "norm", "vector")

    def pack(t: pa.Table) -> pa.Table:
        vecs = [np.frombuffer(v, np.int64) for v in t.column("vector").to_pylist()]
        dim = max(map(len, vecs))
        m = np.zeros((len(vecs), dim), np.int64)
        for k, v in enumerate(vecs):
            m[k, : len(v)] = v
        norms, ids = t.column("norm").to_numpy(), t.column("vec_id").to_numpy()
        order = np.lexsort((ids, -norms))
        small = m.astype(np.int32) if np.abs(m).max(initial=0) < 1 << 31 else m
        blobs = [ids[order], t.column("row").to_numpy()[order], norms[order], small[order]]
        return pa.table(
            {
                "block": pa.array([t.column("block")[0].as_py()], pa.int64()),
                "top": pa.array([float(norms.max())], pa.float64()),
                **{n: pa.array([b.tobytes()], pa.binary()) for n, b in zip(("ids", "rows", "norms", "vectors"), blobs, strict=True)},
                "dim": pa.array([dim], pa.int64()),
            }
        )

    return tagged.groupBy("block").applyInArrow(pack, f"block long, top double, {BLOB}")


class _Block:
    def __init__(self, row: dict, prefix: str):
        get = lambda n: row[f"{prefix}{n}"]
        self.ids = np.frombuffer(get("ids"), np.int64)
        self.rows = np.frombuffer(get("rows"), np.int64)
        self.norms = np.frombuffer(get("norms"), np.float64)
        n, dim = len(self.ids), get("dim")
        kind = np.int32 if n * dim * 4 == len(get("vectors")) else np.int64
        self.vectors = np.frombuffer(get("vectors"), kind).reshape(n, dim)


def _aligned(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared coordinates only; in doubles when every product sum is exact in them."""
    d = min(q.shape[1], c.shape[1])
    q, c = q[:, :d], c[:, :d]
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(d, 1)
    kind = np.float64 if most < 2**53 else np.int64
    return q.astype(kind), c.astype(kind)


def search_block(q: _Block, c: _Block, bounds: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, candidates, scores) of the scores of one block that can be among the best k."""
    qv, cv = _aligned(q.vectors, c.vectors)
    top = c.norms[0] if len(c.norms) else 0.0
    slack = 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(q.norms * top > 0, bounds / (q.norms * top), np.where(bounds > 0, np.inf, -np.inf))
    unit = cv / np.maximum(c.norms, 1e-300)[:, None]
    for at in range(0, len(q.ids), 256):
        part = np.arange(at, min(at + 256, len(q.ids)))
        part = part[cosine[part] <= 1 + slack]
        by_place = part[cosine[part] >= COORDINATES_FROM]
        by_length = part[cosine[part] < COORDINATES_FROM]
        for i in by_place:
            t = min(cosine[i], 1.0)
            unit_q = qv[i] / q.norms[i]
            alive = np.arange(len(c.ids))
            for f in np.argsort(-np.abs(unit_q), kind="stable")[:FOCUS]:
                # The angle to an axis differs from the query's by at most the angle of the cosine.
                u = unit_q[f]
                reach = np.sqrt(max(1 - t * t, 0) * max(1 - u * u, 0)) + 1e-7
                low = -2.0 if u <= -t else u * t - reach
                high = 2.0 if u >= t else u * t + reach
                x = unit[alive, f]
                alive = alive[(x >= low) & (x <= high)]
            yield from _best(q, c, i, alive, cv[alive] @ qv[i], bounds[i], k)
        if len(by_length):
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(q.norms[by_length] > 0, bounds[by_length] / q.norms[by_length], -np.inf)
            most = int(np.searchsorted(-c.norms, -(need.min() - slack * abs(need.min()) - slack), side="right")) if np.isfinite(need.min()) else len(c.ids)
            products = qv[by_length] @ cv[:most].T
            for i, row in zip(by_length, products, strict=True):
                yield from _best(q, c, i, np.arange(most), row, bounds[i], k)


def _best(q: _Block, c: _Block, i: int, alive: np.ndarray, scores: np.ndarray, bound: float, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    hit = np.flatnonzero((scores >= bound) & (c.rows[alive] != q.rows[i]))
    if len(hit) > k:
        kth = np.partition(scores[hit], len(hit) - k)[len(hit) - k]
        hit = hit[scores[hit] >= kth]
        hit = hit[np.lexsort((c.ids[alive[hit]], -scores[hit]))[:k]]
    if len(hit):
        yield i, alive[hit], scores[hit].astype(np.int64)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for n in range(batch.num_rows):
            yield batch.slice(n, 1).to_pylist()[0]


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", factor: float = 64.0
) -> DataFrame:
    """(query_row, query_id, rank, vec_id, score): each query's k highest integer products, ties to the smaller id.

    ``queries`` is a condition on (row, vec_id) applied to the valid rows: the
    stated query set.  A query is not its own candidate; other rows that repeat
    its id are.  Shorter vectors count as padded with zeros.  Sums of products
    must fit 64 bits.  Without k other valid rows all of them are returned.
    """
    spark = vectors.sparkSession
    valid = stage(integers(vectors, key, vector, factor), "vectors")
    c = stage(blocks(valid), "candidate-blocks")
    q = stage(blocks(valid.where(queries)), "query-blocks")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            one, other = _Block(row, ""), _Block(row, "c_")
            low = np.full(len(one.ids), -np.inf)
            for i, _, s in search_block(one, other, low.copy(), k):
                if len(s) == k:
                    low[i] = s.min()
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(one.norms > 0, low / one.norms, np.where(low > 0, np.inf, -np.inf)).min()
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["block"]], pa.int64()), pa.array([low.tobytes()], pa.binary()), pa.array([float(need)], pa.float64())],
                ["block", "bounds", "need"],
            )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            one, other = _Block(row, "q_"), _Block(row, "")
            found = list(search_block(one, other, np.frombuffer(row["bounds"], np.float64), k))
            if not found:
                continue
            sizes = [len(s) for _, _, s in found]
            i = np.repeat([f[0] for f in found], sizes).astype(np.int64)
            at, s = (np.concatenate([f[part] for f in found]) for part in (1, 2))
            columns = [one.rows[i], one.ids[i], other.rows[at], other.ids[at], s]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in columns], ["query_row", "query_id", "row", "vec_id", "score"]
            )

    names = ("ids", "rows", "norms", "vectors", "dim")
    # One block: the longest one.
    longest = c.orderBy(F.desc("top"), "block").limit(1).select(*(F.col(n).alias(f"c_{n}") for n in names), F.lit(1).alias("one"))
    first = q.withColumn("one", F.lit(1)).join(F.broadcast(longest), "one").drop("one")
    bounds = stage(first.mapInArrow(bound, "block long, bounds binary, need double"), "bounds")
    last = c.agg(F.max("block")).first()[0]
    if last is None:
        return spark.createDataFrame([], "query_row long, query_id long, rank int, vec_id long, score long")
    # Pairs of block numbers; those whose lengths cannot reach the bound are dropped before any vector moves.
    pairs = bounds.select(F.col("block").alias("q_block"), "need", F.explode(F.sequence(F.lit(0), F.lit(last).cast("long"))).alias("block"))
    pairs = pairs.join(c.select("block", "top"), "block").where(F.col("top") * (1 + 1e-9) + 1e-9 >= F.col("need"))
    left = q.join(bounds, "block").select(F.col("block").alias("q_block"), "bounds", *(F.col(n).alias(f"q_{n}") for n in names))
    both = pairs.select("q_block", "block").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "q_block", "block")
    found = both.join(left, "q_block").join(c.select("block", *names), "block").mapInArrow(
        search, "query_row long, query_id long, row long, vec_id long, score long"
    )
    place = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_row", "query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0").drop("query_row")


OP1_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
