"""Table and aggregate functions in Python for use from SQL; :func:`register` makes a session know them.

``grid_counts(TABLE(t), key, value, low, high, steps)`` gives for each key that a task meets, and each of ``steps`` + 1 equal
thresholds from ``low`` to ``high``, how many rows have at most that value.  It holds counts, not rows, and is not partitioned:
every task counts its own rows, so that a key with a third of them is no hot group; the counts add up in SQL.

``log_sum_exp(x)`` is a grouped aggregate in pandas.  It takes its own results again: groups of any size are aggregated by
salt first and then by key, so that no batch holds a whole group.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Keys whose counts a task holds before it gives them out.
HELD_KEYS = 100_000


class GridCounts:
    """``key``, ``threshold``, ``n_rows``; null and NaN values count for no threshold, null keys are one key."""

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, value: AnalyzeArgument, low: AnalyzeArgument, high: AnalyzeArgument, steps: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument must be a table")
        kinds = {f.name: f.dataType for f in table.dataType.fields}
        missing = [a.value for a in (key, value) if a.value not in kinds]
        if missing:
            raise ValueError(f"the table has no column {missing[0]}")
        if int(steps.value) < 1 or not float(low.value) < float(high.value):
            raise ValueError("a grid needs a step and low below high")
        return AnalyzeResult(T.StructType().add(key.value, kinds[key.value]).add("threshold", "double").add("n_rows", "long"))

    def __init__(self) -> None:
        self.grid: list[float] = []
        self.counts: dict[object, list[int]] = {}

    def _out(self) -> Iterator[tuple]:
        for key, counts in self.counts.items():
            for threshold, n in zip(self.grid, np.cumsum(counts[:-1]).tolist(), strict=True):
                yield key, threshold, n
        self.counts = {}

    def eval(self, row: Row, key: str, value: str, low: float, high: float, steps: int) -> Iterator[tuple]:
        if not self.grid:
            self.grid = [float(low) + (float(high) - float(low)) * i / int(steps) for i in range(int(steps) + 1)]
        x = row[value]
        own = self.counts.setdefault(row[key], [0] * (len(self.grid) + 1))
        own[len(self.grid) if x is None or x != x else bisect.bisect_left(self.grid, float(x))] += 1
        if len(self.counts) > HELD_KEYS:
            yield from self._out()

    def terminate(self) -> Iterator[tuple]:
        yield from self._out()


def log_sum_exp(x: pd.Series) -> float:
    """log of the sum of exp(x) without overflow; null for no value."""
    known = x.dropna().to_numpy(float)
    if not known.size:
        return None
    top = known.max()
    return float(top + np.log(np.exp(known - top).sum())) if np.isfinite(top) else float(top)


def register(spark: SparkSession) -> None:
    """Make ``grid_counts`` and ``log_sum_exp`` known to the session's SQL."""
    spark.udtf.register("grid_counts", F.udtf(GridCounts))
    spark.udf.register("log_sum_exp", F.pandas_udf(log_sum_exp, "double"))
