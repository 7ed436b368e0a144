"""Merkle manifest: hash trees over the rows of each language, proofs for every row.

A row's place in its language is written in digits of the fan-out.  Within a
block of ``FAN ** DIGITS`` rows the digits are grouped away one after the other,
the lowest first: the nodes of one run are collected as structs into their
parent's struct, which gets their hash.  All groupings share the hash
partitioning by block.  What is left is one nested struct a block; blocks are
rows of the next tier, until each language has one node, and the languages are
rows of the last tree.

Proofs come out of the nested structs: at each level, top down, an explode walks
into the children and notes the hashes left and right of the one it enters.  A
tier hands its rows' paths to the tier below by the block's number; inside a
block there is no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import table

#: Children of a node, and digits grouped away in one block of FAN ** DIGITS rows.
FAN, DIGITS = 8, 4
#: Inputs of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def leaf(*values: Column) -> Column:
    """Hash of values in order, each as its byte count, a colon and the value; a null is a hyphen."""
    parts = []
    for v in values:
        v = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda x: x["hash"]), "")


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank`` from 0 within the group, and ``size``, the rows of the group.

    ``rows`` are dealt to ranges of (group, order), so that a group with most of
    the rows is spread over many tasks; the counts of the ranges give the
    offsets.  The dealt table is written, so a row's range cannot change.
    """
    dealt = stage(rows.repartitionByRange(_parts(rows), "group", *order).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range of a group.
    counts = dealt.groupBy("group", "part").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select(
        "group", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
        F.sum("n").over(Window.partitionBy("group")).alias("size"),
    )
    place = F.row_number().over(Window.partitionBy("group", "part").orderBy(*order)) - 1
    placed = dealt.withColumn("inside", place).join(first, ["group", "part"])
    return placed.withColumn("rank", F.col("first") + F.col("inside")).drop("part", "inside", "first")


def _parts(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def _real(digit: int) -> Column:
    """Is there a level above the ``digit``-th of ``size`` nodes?  A single node left is passed up as it is."""
    return F.col("size") > FAN**digit


def _roll_up(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """``nodes`` (group, rank, size, hash, carried) to (group, size, rank, hash, tree), ``rank`` counting blocks.

    ``size`` is the number of nodes of the group in this tier.
    """
    block = F.floor(F.col("rank") / FAN**DIGITS)
    level = nodes.select("group", "size", block.alias("block"), F.struct("rank", "hash", *carried).alias("node"))
    level = level.repartition(_parts(nodes), "group", "block")
    for digit in range(DIGITS):
        up = F.floor(F.col("node.rank") / FAN)
        # Compared by place alone: the default order would go through the whole nested struct.
        children = F.array_sort(F.collect_list("node"), lambda a, b: (a["rank"] - b["rank"]).cast("int"))
        level = level.groupBy("group", "size", "block", up.alias("up")).agg(children.alias("children"))
        made = F.when(_real(digit), F.sha2(_joined(F.col("children")), 256)).otherwise(F.col("children")[0]["hash"])
        node = F.struct(F.col("up").alias("rank"), made.alias("hash"), "children")
        level = level.select("group", "size", "block", node.alias("node"))
    return level.select("group", "size", F.col("block").alias("rank"), "node.hash", F.col("node").alias("tree"))


def _unfold(trees: DataFrame, carried: list[str], passed: list[str]) -> DataFrame:
    """The nodes of a tier with the path of each to the top: ``trees`` has group, size, tree, path and ``passed``."""
    now = trees.select("group", "size", "path", *passed, F.col("tree").alias("node"))
    for digit in reversed(range(DIGITS)):
        all_ = F.col("node.children").alias("all")
        now = now.select("group", "size", "path", *passed, all_, F.posexplode("node.children").alias("at", "node"))
        left = _joined(F.slice("all", F.lit(1), F.col("at")))
        right = _joined(F.slice("all", F.col("at") + 2, F.size("all")))
        step = F.when(_real(digit), F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(F.lit([]).cast(PATH))
        now = now.select("group", "size", F.concat(step, "path").alias("path"), *passed, "node")
    return now.select("group", *passed, "path", "node.rank", "node.hash", *(f"node.{c}" for c in carried))


def grow(nodes: DataFrame, carried: list[str]) -> list[DataFrame]:
    """The tiers of the trees of all groups, lowest first; the last one has one row a group."""
    tiers = [stage(_roll_up(nodes, carried), "tier")]
    while (tiers[-1].agg(F.max("rank")).first()[0] or 0) > 0:
        size = F.ceil(F.col("size") / FAN**DIGITS).alias("size")
        tiers.append(stage(_roll_up(tiers[-1].select("group", "rank", size, "hash"), []), "tier"))
    return tiers


def paths(tiers: list[DataFrame], above: DataFrame, carried: list[str], passed: list[str]) -> DataFrame:
    """(group, passed, path, rank, hash, carried) of all lowest nodes; ``above`` is (group, path, passed) of the tops."""
    now = above
    for k in reversed(range(len(tiers))):
        on = ["group"] if k == len(tiers) - 1 else ["group", "rank"]
        below = tiers[k].select("group", "rank", "size", "tree").join(now.select(*on, "path", *passed), on)
        now = _unfold(below, carried if k == 0 else [], passed)
    return now


def fold(hash_: Column, path: Column) -> Column:
    """The top that follows from a node's hash and its path."""
    return F.aggregate(path, hash_, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", **more: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, more): each row's leaf, the tops over it, and its proof.

    ``path`` lists, from the leaf upwards, the joined hashes left and right of the
    own node in its run.  A level is hashed while more than one node remains, also
    a last run of one node; a group's only leaf is its subroot, and the only
    subroot is the root.  Groups are ordered by UTF-8 bytes, the null group first;
    rows of a group by ``key``, a null key first.  Rows that repeat a key are
    ordered by their leaf, equal rows arbitrarily.  An empty table has no rows.
    ``more`` adds columns computed from the row.
    """
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("")).alias("group"),
        F.col(key).alias("doc_id"),
        leaf(*map(F.col, fields)).alias("hash"),
        F.monotonically_increasing_id().alias("row"),
        *(c.alias(n) for n, c in more.items()),
    )
    carried = ["doc_id", *more]
    # Written first: the ranges are sampled from narrow rows, and texts are hashed once.
    tiers = grow(ranked(stage(leaves, "leaves"), ["doc_id", "hash", "row"]), carried)
    tops = tiers[-1].select("group", "hash")
    named = tops.select(F.lit("").alias("group"), F.col("group").alias("name"), "hash")
    crown = grow(ranked(named, ["name"]), ["name"])
    root = crown[-1].select("group", F.lit([]).cast(PATH).alias("path"), F.col("hash").alias("root"))
    above = paths(crown, root, ["name"], ["root"])
    above = above.select(F.col("name").alias("group"), "path", "root", F.col("hash").alias("subroot"))
    found = paths(tiers, above, carried, ["root", "subroot"])
    return found.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", "path", *more)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = leaf(*(F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lowered)
    found = manifest(docs, tampered=tampered).withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _sql() -> str:
    """Levels are spelled out: eight within a language, four above them."""
    field = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
    leaf_of = lambda text: "sha256(" + " || ".join(field(x) for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    bit = "(lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    byte = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], {bit[1:-1]})"
    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), "
        f"lambda x: ord(x)::BIGINT)), lambda c, b: {byte}))"
    )
    parts = [
        f"""d AS (SELECT doc_id, lang, {leaf_of("text")} AS leaf, {leaf_of(lowered)} AS lowered, {crc} AS crc FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r FROM d),
        l0 AS (SELECT lang AS g, r, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM r)"""
    ]

    def levels(prefix: str, count: int) -> None:
        for k in range(count):
            parts.append(f"""{prefix}{k + 1} AS (
              SELECT *, count(*) OVER (PARTITION BY g) AS n FROM (
                SELECT g, r // 8 AS r, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY r)) ELSE any_value(h) END AS h
                FROM {prefix}{k} GROUP BY g, r // 8, n)),
            s{prefix}{k} AS (
              SELECT g, r, n, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
                     coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z
              FROM {prefix}{k} WINDOW w AS (PARTITION BY g, r // 8 ORDER BY r))""")

    levels("l", 8)
    parts.append("""t AS (SELECT g AS lang, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS t FROM l8),
        m0 AS (SELECT 0 AS g, t AS r, subroot AS h, count(*) OVER () AS n FROM t)""")
    levels("m", 4)
    steps = [("l", k, f"sl{k}.g IS NOT DISTINCT FROM r.lang AND sl{k}.r = r.r // {8**k}") for k in range(8)]
    steps += [("m", k, f"sm{k}.r = t.t // {8**k}") for k in range(4)]
    joins = " ".join(f"JOIN s{p}{k} ON {on}" for p, k, on in steps)
    proof = " || ".join(f"s{p}{k}.a || s{p}{k}.z" for p, k, _ in steps)
    columns = ", ".join(f"s{p}{k}.{c} AS {c}{p}{k}" for p, k, _ in steps for c in "naz")
    query = f"""SELECT r.doc_id, r.leaf, t.subroot, m4.h AS root, sha256({proof}) AS proof_sha256,
        CASE WHEN crc % 3 = 0 THEN lowered ELSE leaf END AS f, {columns}
      FROM r JOIN t ON t.lang IS NOT DISTINCT FROM r.lang CROSS JOIN m4 {joins}"""
    # One step of the fold a level of subqueries: an alias of an alias would be written out twice each time.
    for p, k, _ in steps:
        query = f"SELECT * REPLACE (CASE WHEN n{p}{k} > 1 THEN sha256(a{p}{k} || f || z{p}{k}) ELSE f END AS f) FROM ({query})"
    ctes = ", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in parts)
    return f"""WITH {ctes}
    SELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM ({query})"""


OP11_SQL = _sql()
