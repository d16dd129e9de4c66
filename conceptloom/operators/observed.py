"""Runs that count while they run: rows, skipped inputs, rejected kinds, and rows a second."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources import storage


@dataclass
class Run:
    """A plan whose metrics are known once an action has run it: finish() runs one and returns all counts."""

    df: DataFrame
    observation: Observation
    skipped: list[str] = field(default_factory=list)
    seconds: float = 0.0

    def finish(self, write: Callable[[DataFrame], None] | None = None) -> dict[str, float]:
        """Runs the plan (write, or a run whose rows go nowhere) and returns its metrics, the skipped inputs and rows a second."""
        began = time.time()
        (write or (lambda d: d.write.format("noop").mode("overwrite").save()))(self.df)
        self.seconds = time.time() - began
        got = dict(self.observation.get)
        return got | {"skipped": len(self.skipped), "rows_per_second": got["rows"] / max(self.seconds, 1e-9)}


def counted(df: DataFrame, kind: Column | None = None, known: list[str] | None = None, skipped: list[str] | None = None, **metrics: Column) -> Run:
    """df, of which rows of unknown kinds are left out, and counts of it: rows read, rejected by kind, and other aggregates.

    Counts come with the run itself; no row is read twice. Rows of a null kind are rejected as "null".
    """
    tests = {"rows": F.count("*")} | metrics
    keep = F.lit(True)
    if kind is not None:
        name = F.coalesce(kind, F.lit("null"))
        keep = name.isin(*(known or []))
        tests |= {"rejected": F.count_if(~keep), "rejected_kinds": F.array_sort(F.collect_set(F.when(~keep, name)))}
    seen = Observation()
    return Run(df.observe(seen, *(c.alias(k) for k, c in tests.items())).where(keep), seen, list(skipped or []))


def read_existing(spark: SparkSession, paths: list[str], read: Callable[[str], DataFrame]) -> tuple[DataFrame | None, list[str]]:
    """The union of the inputs that exist, and those that do not, each with a warning; None if none does."""
    found, skipped = [], []
    for path in paths:
        if storage.exists(spark, path):
            found.append(read(path))
        else:
            warnings.warn(f"{path} does not exist and is skipped", stacklevel=2)
            skipped.append(path)
    return (reduce(DataFrame.unionByName, found) if found else None), skipped
