"""Row filters and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..config import DEFAULT


def drop_all_null(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """A row goes only when every field (of those named) is missing."""
    return df.na.drop(how="all", subset=fields)


def audit_slots(df: DataFrame, slot: Column | str, n_slots: int = DEFAULT.n_slots) -> DataFrame:
    """One row: how many rows there are, and how many lie outside slots 1..n_slots."""
    slot = F.col(slot) if isinstance(slot, str) else slot
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if((slot < 1) | (slot > n_slots)).alias("n_invalid"),
    )


def count_stages(**stages: DataFrame) -> DataFrame:
    """Row count of each stage as (stage, n_rows)."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows")
        for name, df in stages.items()
    ]
    return reduce(DataFrame.unionAll, counts)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows while another action runs them: no job of its own."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("n_rows")), obs


def constant_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """(name, is_const) per column, from one min/max pass.  NULLs alone count as constant."""
    aggs = [f(c).alias(f"{f.__name__}_{i}") for i, c in enumerate(cols) for f in (F.min, F.max)]
    flags = [
        F.struct(F.lit(c).alias("name"), F.expr(f"min_{i} <=> max_{i}").alias("is_const"))
        for i, c in enumerate(cols)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*flags)))


def drop_constant(df: DataFrame, cols: list[str]) -> DataFrame:
    """Run ``constant_columns`` (one row per column comes back) and drop what it flags."""
    names = [r["name"] for r in constant_columns(df, cols).where("is_const").collect()]
    return df.drop(*names)
