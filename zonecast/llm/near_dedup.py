"""Near duplicates: one-permutation MinHash, banded buckets, star-shaped candidate edges.

1. A document's shingles are hashed once; the smallest hash of each of ``BINS``
   ranges is its sketch.  Empty ranges copy the value of a filled one, chosen by
   a hash of (range, attempt) alone, so that two sketches choose alike.
2. Equal shingle sets are one node.  Nodes share a bucket when ``ROWS`` sketch
   values of one of the ``BANDS`` agree: at similarity 0.8 all bands miss with a
   chance of 5e-8.
3. Star rounds: in each bucket every node is compared with one centre, on the
   full sets of both, then with a member of the bucket's main component, which
   joins most of what belongs together at one comparison a node.
4. What is left are nodes outside the main component of a bucket.  A bucket's
   main component is a unit; its outsiders are compared with all members of the
   unit and each other, in tasks of bounded size that hold a share of the
   outsiders and a share of the members.  So no link is lost, pairs are never
   rows, and a group of n copies costs n comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, stage
from .common import slices, small_batches, table, utf8
from .exact_dedup import filter_bits, flag_possible, repeat_filter
from .hashing import U, hash_words, mix, shingles

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
WIDTH = 4


def _sets(texts: list[bytes | None], width: int) -> Iterator[np.ndarray]:
    hashes, counts = hash_words([t or b"" for t in texts], lower=True)
    for own in np.split(hashes, np.cumsum(counts)[:-1]) if texts else ():
        yield shingles(own, width)


def _set_of(text: bytes | None, width: int) -> np.ndarray:
    return next(_sets([text], width))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One value for each range of the hash space; ``hashes`` is sorted and not empty."""
    bins = (hashes >> U(64 - 7)).astype(np.int64)
    filled, first = np.unique(bins, return_index=True)
    values = np.zeros(BINS, U)
    values[filled] = hashes[first]
    has = np.zeros(BINS, bool)
    has[filled] = True
    empty, attempt = np.flatnonzero(~has), 0
    while len(empty):
        at = (mix(empty.astype(U) * U(1_000_003) + U(attempt)) % U(BINS)).astype(np.int64)
        hit = has[at]
        values[empty[hit]] = values[at[hit]]
        empty, attempt = empty[~hit], attempt + 1
    return values


def bands(values: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=U)
    for row in values.reshape(BANDS, ROWS).T:
        key = mix(key * U(0x9E3779B97F4A7C15) + row)
    return key.view(np.int64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, pick, n, node, bands): node is a 128-bit digest of the shingle set, null if that is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            n, node, keys = [], [], []
            for s in _sets(utf8(batch.column(2)), width):
                n.append(len(s))
                node.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(bands(sketch(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "pick", "n", "node", "bands"],
            )

    ship_package(docs.sparkSession)
    return docs.select("doc_id", "pick", "text").mapInArrow(
        run, "doc_id long, pick long, n long, node binary, bands array<long>"
    )


def _linked(one: int, two: int, both: np.ndarray | int, share: int) -> np.ndarray | bool:
    return 100 * both >= share * (one + two - both)


def verified(pairs: DataFrame, texts: DataFrame, width: int, share: int) -> DataFrame:
    """Of pairs (a, b) those with 100 * intersection >= share * union, on the full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, np.ndarray] = (None, np.empty(0, U))
        for batch in slices(batches, 512):
            keep = []
            for b, x, y in zip(batch.column(1).to_pylist(), utf8(batch.column(2)), utf8(batch.column(3)), strict=True):
                if b != last[0]:
                    last = (b, _set_of(y, width))
                one, two = _set_of(x, width), last[1]
                small, large = sorted((one, two), key=len)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                keep.append(bool(_linked(len(one), len(two), int((large[at] == small).sum()), share)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


#: Shingles of the outsiders and of the members that one task of a unit holds.
OUTSIDERS, MEMBERS = 200_000, 1_000_000


def unit_links(outsiders: DataFrame, inside: DataFrame, texts: DataFrame, width: int, share: int) -> DataFrame:
    """Links between outsiders (unit, node, label, n) and all nodes of their unit (outsiders and ``inside``).

    Nodes are dealt to parts by a hash; a task gets one part of the outsiders and
    one of the members, about ``OUTSIDERS`` and ``MEMBERS`` shingles, and counts
    intersections over the members' sorted shingles.
    """
    members = outsiders.unionByName(inside)
    parts = outsiders.groupBy("unit").agg(F.ceil(F.sum("n") / OUTSIDERS).alias("os")).join(
        members.groupBy("unit").agg(F.ceil(F.sum("n") / MEMBERS).alias("ms")), "unit"
    )
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    asks = outsiders.join(parts, "unit").select("unit", own("os").alias("o"), upto("ms").alias("m"), "node", "label", F.lit(True).alias("asks"))
    told = members.join(parts, "unit").select("unit", upto("os").alias("o"), own("ms").alias("m"), "node", "label", F.lit(False).alias("asks"))

    def run(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy()
        node, label = t.column("node").to_pylist(), t.column("label").to_pylist()
        sets = list(_sets(utf8(t.column("text").combine_chunks()), width))
        known = np.flatnonzero(~asks)
        sizes = np.array([len(sets[k]) for k in known])
        codes = {x: i for i, x in enumerate(dict.fromkeys(label))}
        group = np.array([codes[x] for x in label])
        if not len(known):
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        values = np.concatenate([sets[k] for k in known])
        owner = np.repeat(np.arange(len(known)), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        a, b = [], []
        for k in np.flatnonzero(asks):
            lo, hi = np.searchsorted(values, sets[k]), np.searchsorted(values, sets[k], side="right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(known))
            hit = _linked(len(sets[k]), sizes, both, share) & (group[known] != group[k])
            for j in known[np.flatnonzero(hit)]:
                a.append(node[k])
                b.append(node[j])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    rows = asks.unionByName(told).join(texts, "node").select("unit", "o", "m", "node", "label", "asks", "text")
    return rows.groupBy("unit", "o", "m").applyInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node with a link; the label is the smallest node reachable.

    Each round a node takes the smallest label among its neighbours and itself,
    then the label of its label; a round is one written table.
    """
    both = stage(
        links.select("a", "b").union(links.select("b", "a")).distinct().where("a != b"), "links"
    )
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("near")
        )
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        # A node also hands the label it found to the node that labelled it until now.
        told = lower.groupBy(F.col("label").alias("node")).agg(F.min("new").alias("told"))
        heard = lower.join(told, "node", "left").select("node", "label", F.least("new", "told").alias("new"))
        jump = heard.select(F.col("node").alias("new"), F.col("new").alias("far"))
        after = stage(
            heard.join(jump, "new", "left").select("node", F.col("label").alias("old"), F.least("new", "far").alias("label")),
            "labels",
        )
        labels = after.select("node", "label")
        if after.where("old != label").isEmpty():
            return labels


def near_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, share: int = 80
) -> DataFrame:
    """For each row: doc_id, n_shingles, component_id, kept.

    Words are split at white space, A-Z in lower case.  A row's set is its
    distinct runs of ``width`` words, or all words as one run if there are fewer.
    Rows without words (null, empty, blank) have an empty set and are linked with
    nothing.  component_id is the smallest id reachable over links; null ids are
    passed over, and are the component's id only if it has no other.  Rows that
    repeat an id keep a row each.
    """
    return _groups(docs, key, text, width, share).drop("pick")


def _groups(docs: DataFrame, key: str, text: str, width: int, share: int) -> DataFrame:
    small_batches(docs.sparkSession)
    picked = docs.select(
        F.col(key).alias("doc_id"), F.xxhash64(F.col(key), F.col(text)).alias("pick"), F.col(text).alias("text")
    )
    rows = stage(sketches(picked, width), "sketches")
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.min("pick").alias("pick"), F.first("bands").alias("bands"), F.first("n").alias("n")
    )
    nodes = stage(nodes, "nodes")
    flat = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = flat.groupBy("bucket").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stage(flat.join(shared, "bucket").select("bucket", "node", "centre"), "members")
    involved = members.groupBy("node").agg(F.min("centre").alias("centre"))
    involved = stage(involved.join(nodes.select("node", "pick"), "node"), "involved")
    texts = stage(_texts_of(involved, picked, width), "texts")
    links = stage(
        verified(involved.where("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b")), texts, width, share),
        "links",
    )
    labels = components(links)
    known = _mixed_buckets(members, labels)
    for round_ in range(STAR_ROUNDS):
        if known.isEmpty():
            break
        chosen = known.where("label = main").groupBy("bucket", "main").agg(
            F.min_by("node", F.xxhash64("node", F.lit(round_))).alias("b")
        )
        pairs = known.where("label != main").join(chosen.select("bucket", "b"), "bucket").select(F.col("node").alias("a"), "b")
        links = links.union(stage(verified(pairs.distinct(), texts, width, share), "links"))
        labels = components(links)
        known = _mixed_buckets(members, labels)
    if not known.isEmpty():
        units = known.join(nodes.select("node", "n"), "node").select(F.col("main").alias("unit"), "node", "label", "n")
        units = stage(units.distinct(), "units")
        more = unit_links(units.where("label != unit"), units.where("label = unit"), texts, width, share)
        labels = components(links.union(stage(more, "links")))
    found = nodes.join(labels, "node", "left").select(
        "node", "first_id", F.coalesce("label", "node").alias("label")
    )
    least = found.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_node = found.join(least, "label").select("node", "component_id")
    joined = rows.select("doc_id", "pick", "n", "node").join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"), "pick",
    )


#: Rounds in which outsiders are compared with a member of their bucket's main component.
STAR_ROUNDS = 2


def _mixed_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, node, label, main) of buckets with several components; ``main`` is the most frequent one."""
    known = members.join(labels, "node", "left").select(
        "bucket", "node", F.coalesce("label", "node").alias("label")
    )
    counts = known.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("size"))
    mains = counts.groupBy("bucket").agg(
        F.max(F.struct("size", "label")).alias("top"), F.count(F.lit(1)).alias("several")
    )
    mains = mains.where("several > 1").select("bucket", F.col("top.label").alias("main"))
    return stage(known.join(mains, "bucket"), "mixed")


def _texts_of(involved: DataFrame, picked: DataFrame, width: int) -> DataFrame:
    """(node, text) of the involved nodes; a bounded filter keeps most other texts out of the shuffle."""
    bits = filter_bits(involved.count())
    wanted = repeat_filter(involved.select(F.col("pick").alias("digest")), bits, times=1)
    near = flag_possible(picked.select("pick", "text"), "pick", wanted, bits, "maybe").where("maybe")
    return near.join(involved.select("pick", "node"), "pick").select("node", "text").dropDuplicates(["node"])


def drop_near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, share: int = 80
) -> DataFrame:
    """One row of each group, with all its columns: the smallest id, of rows that repeat it the smallest hash.

    Rows without words stay.  Rows equal in id and text stay or go together.
    Only hashes of the rows that go travel to the join, and a bounded filter lets
    the other rows pass without a shuffle.
    """
    rows = stage(_groups(docs, key, text, width, share), "near-groups")
    group = ["component_id", "doc_id"]
    several = rows.where("kept and n_shingles > 0").groupBy(*group).agg(F.min("pick").alias("best"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in group]
    others = rows.alias("r").join(several.alias("s"), same).where("r.pick != s.best and r.n_shingles > 0").select("r.pick")
    gone = stage(rows.where(~F.col("kept")).select("pick").union(others).distinct(), "near-copies")
    bits = filter_bits(gone.count())
    wanted = repeat_filter(gone.select(F.col("pick").alias("digest")), bits, times=1)
    names = docs.columns
    whole = docs.select(F.struct(*names).alias("__row"), F.xxhash64(key, text).alias("__pick"))
    whole = flag_possible(whole, "__pick", wanted, bits, "__maybe")
    left = whole.where("__maybe").join(gone, F.col("__pick") == F.col("pick"), "left_anti")
    return whole.where(~F.col("__maybe")).select("__row.*").unionByName(left.select("__row.*"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
