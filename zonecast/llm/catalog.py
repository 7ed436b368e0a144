"""The package's registered queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    ann, exact_dedup, lm, merkle, mixing, near_dedup, packing, periodic_runs, pii, quality, substring_dedup, token_counts, topk
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_topk": topk.op1_topk,
    "op2_packing": packing.op2_packing,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_lm_scoring": lm.op4_lm_scoring,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_pii": pii.op6_pii,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_quality": quality.op8_quality,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_mixing": mixing.op10_mixing,
    "op11_merkle": merkle.op11_merkle,
    "op12_ann": ann.op12_ann,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}
SQL: dict[str, str] = {
    "op1_topk": topk.OP1_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op12_ann": ann.OP12_SQL,
}
