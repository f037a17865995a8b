"""Which columns and features count as signals: policies over a table's schema and over long features."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def plain_name(name: str) -> str:
    return re.sub("[^a-z0-9]+", "_", name.lower())


def select_signals(table: DataFrame, policy: str, *, measured: Sequence[str] = (), keywords: Sequence[str] = (), explicit: Sequence[str] = (), metadata: Sequence[str] = ()) -> list[str]:
    """Names of the columns that a policy selects; only the schema is read.

    ``all``: numeric and no metadata; ``measured``: of these, what one of the patterns ``measured`` matches in full;
    ``keyword``: what contains a keyword; ``explicit``: the named ones in the given order, each known, numeric, no
    metadata and named once.  A policy that selects nothing is an error.
    """
    numeric = {c for c, kind in table.dtypes if kind.startswith(NUMERIC)}
    meta = {plain_name(m) for m in metadata}
    candidates = [c for c in table.columns if c in numeric and plain_name(c) not in meta]
    if policy == "explicit":
        faults = {
            "repeated": [c for c in explicit if list(explicit).count(c) > 1], "unknown": [c for c in explicit if c not in table.columns],
            "not numeric": [c for c in explicit if c in table.columns and c not in numeric], "metadata": [c for c in explicit if plain_name(c) in meta],
        }
        for fault, names in faults.items():
            if names:
                raise ValueError(f"{fault} columns: {sorted(set(names))}")
        found = list(explicit)
    elif policy == "measured":
        found = [c for c in candidates if any(re.fullmatch(p, c) for p in measured)]
    elif policy == "keyword":
        found = [c for c in candidates if any(k in plain_name(c) for k in keywords)]
    elif policy == "all":
        found = candidates
    else:
        raise ValueError(f"unknown policy {policy}")
    if not found:
        raise ValueError(f"policy {policy} selects no column")
    return found


def representations(long: DataFrame, feature: str, groups: dict[str, Sequence[str]], joint: str = "MS") -> DataFrame:
    """Long features once for each representation that has them: every group of features, and all groups together."""
    names = {**groups, joint: [f for g in groups.values() for f in g]}
    in_which = F.array_compact(F.array(*[F.when(F.col(feature).isin(*fs), F.lit(name)) for name, fs in names.items()]))
    return long.withColumn("representation", F.explode(in_which))


def select_requested(table: DataFrame, key: str, wanted: Sequence, require_all: bool = True) -> DataFrame:
    """Rows of the wanted keys with ``place``, their place in the request; missing keys are an error if all are required."""
    spark = table.sparkSession
    asked = spark.range(1).select(F.posexplode(F.array(*[F.lit(w) for w in wanted])).alias("place", "wanted"))
    found = table.join(F.broadcast(asked), F.col(key) == F.col("wanted")).drop("wanted")  # as many rows as are named
    if require_all:
        missing = asked.join(found.select(key), F.col("wanted") == F.col(key), "left_anti").collect()
        if missing:
            raise ValueError(f"missing keys: {sorted(r['wanted'] for r in missing)}")
    return found


def ladder(rows: DataFrame, rungs: Sequence[tuple[str, str]], otherwise: str, name: str = "decision") -> DataFrame:
    """``rows`` with the label of the first rung whose condition (an SQL expression) holds; a null condition does not hold."""
    column = F
    for condition, label in rungs:
        column = column.when(F.expr(condition), F.lit(label))
    return rows.withColumn(name, column.otherwise(F.lit(otherwise)))
