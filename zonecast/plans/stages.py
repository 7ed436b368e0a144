"""Runs of several written steps that go on where a run before them ended."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.writers import write_daily

MANIFEST = "name string, fingerprint string, n_rows bigint, first_day string, last_day string"


class Stages:
    """Steps written below ``out_dir``, and a manifest of those that have ended.

    A step that the manifest lists under the same fingerprint of the settings is
    not done again.  Its line is added after its table is whole, so a step that was
    interrupted is done anew.  Rows and days are counted by observing the write
    itself: the audit costs no job and no scan.
    """

    def __init__(self, spark: SparkSession, out_dir: str, settings: str):
        self.spark, self.out_dir = spark, out_dir.rstrip("/")
        self.fingerprint = hashlib.sha256(settings.encode()).hexdigest()
        # One line a step.
        self._done = {r.name for r in self.audit().where(F.col("fingerprint") == self.fingerprint).collect()}

    def audit(self) -> DataFrame:
        """The manifest: every finished step with its rows and its first and last day."""
        try:
            return self.spark.read.schema(MANIFEST).json(f"{self.out_dir}/_finished")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def finished(self, name: str) -> bool:
        return name in self._done

    def _finish(self, name: str, counts: dict) -> None:
        line = (name, self.fingerprint, counts.get("n_rows"), counts.get("first_day"), counts.get("last_day"))
        self.spark.createDataFrame([line], MANIFEST).coalesce(1).write.mode("append").json(f"{self.out_dir}/_finished")
        self._done.add(name)

    def step(self, name: str, do: Callable[[], None]) -> None:
        """Do something that writes below ``out_dir`` itself."""
        if not self.finished(name):
            do()
            self._finish(name, {})

    def written(self, name: str, make: Callable[[], DataFrame], daily: bool = True) -> DataFrame:
        """The table of a step: made, counted and written now, or read if it is there."""
        path = f"{self.out_dir}/{name}"
        if not self.finished(name):
            df, seen = make(), Observation(name)
            day = F.col("date").cast("string") if "date" in df.columns else F.lit(None).cast("string")
            df = df.observe(
                seen, F.count(F.lit(1)).alias("n_rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day")
            )
            if daily:
                write_daily(df, path)
            else:
                df.write.mode("overwrite").parquet(path)
            self._finish(name, seen.get)
        return self.spark.read.parquet(path)
