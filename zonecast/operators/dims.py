"""Zone dimension: building it, joining it, and finding rows it does not know."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, MAX_BROADCAST_ROWS


def zone_map(zones: DataFrame, order: str = "row_pos", n_zones: int = DEFAULT.n_zones) -> DataFrame:
    """One row per hash: the last one by ``order``, the position that ``read_zones`` gives.

    An id outside 1..n_zones fails the job: no grid has a cell for it.
    """
    last = zones.groupBy("zone_hash").agg(F.max_by("zone_id", order).alias("zone_id"))
    wrong = F.raise_error(F.concat(F.lit("zone id out of range: "), F.col("zone_id").cast("string")))
    inside = F.when(F.col("zone_id").between(1, n_zones), F.col("zone_id")).otherwise(wrong.cast("int"))
    return last.withColumn("zone_id", inside)


def broadcast_if_small(dim: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast after counting the dimension (one small job); else return it as it is.

    Without the hint the join is planned by size: AQE then splits hot keys of the
    shuffled side.
    """
    counted = dim.limit(max_rows + 1).count()
    return F.broadcast(dim) if counted <= max_rows else dim


def attach_zone(
    df: DataFrame,
    zones: DataFrame,
    hash_col: str,
    out: str,
    default: int | None = None,
    strict: bool = True,
) -> DataFrame:
    """Replace a zone hash by its id.

    ``default`` given: left join, unknown hashes get the default.  Else unknown
    hashes fail the job (``strict``) or drop out (inner join).
    """
    dim = zones.select(F.col("zone_hash").alias("_hash"), F.col("zone_id").alias(out))
    on = F.col(hash_col) == F.col("_hash")
    if default is not None:
        joined = df.join(dim, on, "left").withColumn(out, F.coalesce(out, F.lit(default)))
    elif strict:
        unknown = F.raise_error(F.concat(F.lit("unknown zone hash: "), F.col(hash_col)))
        joined = df.join(dim, on, "left").withColumn(
            out, F.coalesce(F.col(out), unknown.cast("int"))
        )
    else:
        joined = df.join(dim, on, "inner")
    return joined.drop("_hash", hash_col)


def split_known(df: DataFrame, zones: DataFrame, hash_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose hash is known, rows whose hash is not)."""
    dim = zones.select(F.col("zone_hash").alias("_hash"))
    on = F.col(hash_col) == F.col("_hash")
    return df.join(dim, on, "left_semi"), df.join(dim, on, "left_anti")


def known_and_rejected(df: DataFrame, zones: DataFrame, hash_col: str, out: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their zone id, rejected rows with a reason), written side by side in one pass over ``df``.

    The table at ``path`` has a folder for either kind, so reading one does not
    read the other.
    """
    dim = zones.select(F.col("zone_hash").alias("_hash"), F.col("zone_id").alias(out))
    flagged = df.join(dim, F.col(hash_col) == F.col("_hash"), "left").drop("_hash")
    reason = F.when(F.col(hash_col).isNull(), "no zone hash").when(F.col(out).isNull(), "unknown zone hash")
    flagged = flagged.withColumn("reason", reason).withColumn("kind", F.when(reason.isNull(), "known").otherwise("rejected"))
    flagged.write.mode("overwrite").partitionBy("kind").parquet(path)
    back = df.sparkSession.read.schema(flagged.schema).parquet(path)
    known = back.where("kind = 'known'").drop("kind", "reason", hash_col)
    return known, back.where("kind = 'rejected'").drop("kind", out)
