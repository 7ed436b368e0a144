"""Nearest neighbours by cosine: a block matrix join on quantised vectors.

Every vector is scaled to unit length and rounded to int8 with a step of its
own; the length of what the rounding lost is kept beside it.  Queries and
candidates are put in blocks, and each tile of the block matrix is one product
of small integers, exact in floats.  With the lost lengths it bounds each cosine
from both sides.  Pairs whose upper bound reaches the query's k-th best are
computed again from the original doubles, and go into the query's heap.  So the
answer is exact, ties included.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package, stage
from .common import table

#: Vectors of a candidate block and of a query block, and candidate blocks that a heap goes through in one task.
BLOCK, QUERIES, STRIP = 4096, 512, 8
#: Pairs that are computed again at once.
CHUNK = 1 << 15
#: Added to every bound, far above the rounding of doubles and far below the quantisation.
SLACK = 1e-9


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices, summed from the first coordinate to the last."""
    total = np.zeros(len(a))
    for d in range(min(a.shape[1], b.shape[1])):
        total += a[:, d] * b[:, d]
    return total


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows padded with zeros, and which of them are whole: not null, no null or non-finite component."""
    n = len(column)
    flat = column.flatten()
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    m = np.zeros((n, int(sizes.max(initial=0))))
    row = np.repeat(np.arange(n), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    m[row, place] = x
    good = np.asarray(column.is_valid()) & np.isfinite(m).all(1)
    return m, good


def quantise(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors, their step, the length of what was lost, and the length of what is left."""
    unit = m / np.sqrt(_dot(m, m))[:, None]
    step = np.abs(unit).max(1, initial=0) / 127
    codes = np.rint(unit / step[:, None]).astype(np.int8)
    left = codes * step[:, None]
    return codes, step, np.sqrt(((unit - left) ** 2).sum(1)), np.sqrt((left**2).sum(1))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(row, vec_id, vector, dim): the vectors that take part, as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, good = _matrix(batch.column(2))
            with np.errstate(over="ignore"):
                length = _dot(m, m)
            good &= np.asarray(batch.column(1).is_valid()) & (length > 0) & np.isfinite(length)
            at = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    batch.column(1).take(pa.array(at)),
                    pa.array([m[k].tobytes() for k in at], pa.binary()),
                ],
                ["row", "vec_id", "vector"],
            )

    ship_package(vectors.sparkSession)
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long"), F.col(vector).cast("array<double>"))
    return rows.mapInArrow(run, "row long, vec_id long, vector binary")


BLOB = "ids binary, rows binary, codes binary, scales binary, vectors binary, dim int"


def blocks(vectors: DataFrame, size: int, rows: int) -> DataFrame:
    """(block, ids, rows, codes, scales, vectors, dim): about ``size`` vectors a row, dealt by a hash of the row."""
    cuts = max(1, -(-rows // size))

    def pack(t: pa.Table) -> pa.Table:
        own = [np.frombuffer(v, np.float64) for v in t.column("vector").to_pylist()]
        dim = max(map(len, own))
        m = np.zeros((len(own), dim))
        for k, v in enumerate(own):
            m[k, : len(v)] = v
        codes, *scales = quantise(m)
        # Floats stay floats: they are doubles again when a pair is computed.
        single = m.astype(np.float32)
        blobs = {
            "ids": t.column("vec_id").to_numpy(), "rows": t.column("row").to_numpy(), "codes": codes,
            "scales": np.stack(scales), "vectors": single if (single == m).all() else m,
        }
        columns = {n: pa.array([np.ascontiguousarray(b).tobytes()], pa.binary()) for n, b in blobs.items()}
        return pa.table({"block": t.column("block").slice(0, 1), **columns, "dim": pa.array([dim], pa.int32())})

    number = F.pmod(F.xxhash64("row"), F.lit(cuts)).cast("long")
    return vectors.withColumn("block", number).groupBy("block").applyInArrow(pack, f"block long, {BLOB}")


class _Block:
    def __init__(self, row: dict, prefix: str):
        get = lambda n: row[f"{prefix}{n}"]
        self.ids, self.rows = np.frombuffer(get("ids"), np.int64), np.frombuffer(get("rows"), np.int64)
        n, dim = len(self.ids), get("dim")
        self.codes = np.frombuffer(get("codes"), np.int8).reshape(n, dim)
        self.step, self.lost, self.left = np.frombuffer(get("scales"), np.float64).reshape(3, n)
        kind = np.float32 if len(get("vectors")) == n * dim * 4 else np.float64
        self.vectors = np.frombuffer(get("vectors"), kind).reshape(n, dim)

    def doubles(self, at: np.ndarray) -> np.ndarray:
        return self.vectors[at].astype(np.float64)


def tile(q: _Block, c: _Block) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of all pairs of two blocks, and how far off each may be."""
    d = min(q.codes.shape[1], c.codes.shape[1])
    kind = np.float32 if d * 127 * 127 < 1 << 24 else np.float64
    cosine = (q.codes[:, :d].astype(kind) @ c.codes[:, :d].astype(kind).T).astype(np.float64)
    cosine *= q.step[:, None]
    cosine *= c.step
    # u.v - u'v' = u'(v - v') + (u - u')v, where v has length one.
    return cosine, q.left[:, None] * c.lost + q.lost[:, None] + SLACK


def exact(q: _Block, c: _Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs, from the original vectors."""
    out = np.empty(len(i))
    for at in range(0, len(i), CHUNK):
        a, b = q.doubles(i[at : at + CHUNK]), c.doubles(j[at : at + CHUNK])
        out[at : at + CHUNK] = _dot(a, b) / (np.sqrt(_dot(a, a)) * np.sqrt(_dot(b, b)))
    return out


class Heaps:
    """The k best candidates of each query of a block, as min-heaps of (cosine, -vec_id, -row)."""

    def __init__(self, n: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n)]
        self.floor = np.full(n, -np.inf)

    def search(self, q: _Block, c: _Block) -> None:
        cosine, off = tile(q, c)
        low = cosine - off
        same = q.rows[:, None] == c.rows
        low[same] = -np.inf
        # The k-th lower bound of this tile bounds the query's k-th best from below, like the heap's least.
        floor = self.floor
        if low.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(low, low.shape[1] - self.k, axis=1)[:, -self.k])
        hit = cosine + off >= floor[:, None]
        hit &= ~same
        i, j = np.nonzero(hit)
        score = exact(q, c, i, j)
        order = np.lexsort((c.rows[j], c.ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        best = place < self.k
        for query, s, id_, row in zip(i[best].tolist(), score[best].tolist(), c.ids[j[best]].tolist(), c.rows[j[best]].tolist(), strict=True):
            own, new = self.heaps[query], (s, -id_, -row)
            if len(own) < self.k:
                heapq.heappush(own, new)
            elif new > own[0]:
                heapq.heapreplace(own, new)
            if len(own) == self.k:
                self.floor[query] = own[0][0]

    def rows(self, q: _Block) -> pa.RecordBatch:
        found = [(r, i, -row, -id_, s) for r, i, own in zip(q.rows.tolist(), q.ids.tolist(), self.heaps, strict=True) for s, id_, row in own]
        columns = list(zip(*found, strict=True)) or [()] * 5
        types = [pa.int64()] * 4 + [pa.float64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["query_row", "query_id", "row", "vec_id", "score"]
        )


FOUND = "query_row long, query_id long, row long, vec_id long, score double"


def nearest(vectors: DataFrame, queries: str, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_row, query_id, rank, vec_id, score): each query's k nearest rows by cosine, ties to the smaller id.

    ``queries`` is a condition on (row, vec_id).  A query is not its own
    candidate; other rows that repeat its id or its vector are.  Vectors that are
    null or hold a null or non-finite component, rows with a null id, and vectors
    whose squared length is zero or no finite double take no part.  Shorter
    vectors count as padded with zeros.  With fewer than k other rows all of them
    are returned.  The score is the sum of products from the first coordinate on
    over the product of the two lengths, in doubles.
    """
    spark = vectors.sparkSession
    valid = stage(usable(vectors, key, vector), "vectors")
    asked = valid.where(queries)
    c = stage(blocks(valid, BLOCK, valid.count()), "candidate-blocks")
    q = stage(blocks(asked, QUERIES, asked.count()), "query-blocks")
    names = [n.split()[0] for n in BLOB.split(", ")]
    last = c.agg(F.max("block")).first()[0]
    if last is None:
        return spark.createDataFrame([], "query_row long, query_id long, rank int, vec_id long, score double")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, one, heaps = None, None, None
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                if at != (row["q_block"], row["strip"]):
                    if heaps:
                        yield heaps.rows(one)
                    at, one = (row["q_block"], row["strip"]), _Block(row, "q_")
                    heaps = Heaps(len(one.ids), k)
                heaps.search(one, _Block(row, ""))
        if heaps:
            yield heaps.rows(one)

    # Numbers of blocks are paired and dealt first; the blocks follow them.
    numbers = F.explode(F.sequence(F.lit(0), F.lit(last).cast("long")))
    pairs = q.select(F.col("block").alias("q_block"), numbers.alias("block")).withColumn("strip", F.floor(F.col("block") / STRIP))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    queried = q.select(F.col("block").alias("q_block"), *(F.col(n).alias(f"q_{n}") for n in names))
    tiles = pairs.join(c.select("block", *names), "block").join(queried, "q_block")
    tiles = tiles.repartition(parts, "q_block", "strip").sortWithinPartitions("q_block", "strip", "block")
    found = tiles.mapInArrow(search, FOUND)
    place = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_row", "query_id", "rank", "vec_id", "score")


def op12_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0").drop("query_row")


OP12_SQL = """
WITH v AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS length
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
  WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_dot_product(e, e) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.length * c.length) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
