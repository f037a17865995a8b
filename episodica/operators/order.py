"""Exact ranks and quantiles of groups of any size, hot groups included.

Equal values are counted first, so a window never sees more rows than there are distinct values.  Approximate quantiles
then cut each group into ``CUTS`` ranges; the counts of the ranges give every range its start, and the windows that
remain are one for each range.  The cuts only spread the work: ranks and quantiles are exact whatever they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

CUTS = 64
#: Ranks of at most so many values go to every executor; values are then as frequent as they like.
FEW_VALUES = 50_000


def cumulated(rows: DataFrame, keys: list[str], value: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """``keys`` and, for each value, ``value_at``, ``rows_at`` (its rows), ``rows_below`` and ``rows_in_group``.

    ``extra`` names further counts: for each a column of its sum over the value's rows and, with ``low_``, over all below.
    """
    extra = extra or {}
    # Read four times below: the rows are scanned for it once.
    counted = cut(rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value_at")).agg(F.count(F.lit(1)).alias("rows_at"), *[c.alias(k) for k, c in extra.items()]))
    sketch = F.percentile_approx("value_at", F.array(*[F.lit(k / CUTS) for k in range(1, CUTS)]), F.lit(2000))
    cuts = counted.groupBy(*keys).agg(sketch.alias("cuts"))
    # One row for each group; equal null keys are one group.
    same = [F.col(k).eqNullSafe(F.col(f"cut_{k}")) for k in keys]
    renamed = cuts.select(*[F.col(k).alias(f"cut_{k}") for k in keys], "cuts")
    both = counted.join(renamed, same) if keys else counted.crossJoin(renamed)
    ranged = both.withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("value_at")))).drop("cuts", *[f"cut_{k}" for k in keys])
    names = ["rows_at", *extra]
    sums = ranged.groupBy(*keys, "range").agg(*[F.sum(c).alias(f"r_{c}") for c in names])
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(k).alias(f"cut_{k}") for k in keys], F.col("range").alias("cut_range"), *[F.coalesce(F.sum(f"r_{c}").over(before), F.lit(0)).alias(f"s_{c}") for c in names], F.sum("r_rows_at").over(Window.partitionBy(*keys)).alias("rows_in_group"))
    inside = Window.partitionBy(*keys, "range").orderBy("value_at").rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"i_{c}") for c in names])
    placed = running.join(starts, [*same, F.col("range") == F.col("cut_range")])
    low = {"rows_at": "rows_below"} | {c: f"low_{c}" for c in extra}
    return placed.select(*keys, "value_at", *names, *[(F.col(f"s_{c}") + F.col(f"i_{c}")).alias(low[c]) for c in names], "rows_in_group")


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``keys`` and a column for each share: the quantile with linear interpolation between neighbouring rows."""
    c = cumulated(rows, keys, value)
    at = lambda q: F.lit(float(q)) * (F.col("rows_in_group") - 1)
    # The row of each place: a value covers the places from low to low + n - 1.
    holds = lambda place: F.max(F.when((F.col("rows_below") <= place) & (place < F.col("rows_below") + F.col("rows_at")), F.col("value_at").cast("double")))
    found = c.groupBy(*keys).agg(F.max("rows_in_group").alias("rows_in_group"), *[x for k, q in shares.items() for x in (holds(F.floor(at(q))).alias(f"{k}__l"), holds(F.ceil(at(q))).alias(f"{k}__u"))])
    return found.select(*keys, *[(F.col(f"{k}__l") + (F.col(f"{k}__u") - F.col(f"{k}__l")) * (at(q) - F.floor(at(q)))).alias(k) for k, q in shares.items()])


def average_ranks(rows: DataFrame, keys: list[str], value: str, name: str, method: str = "average") -> DataFrame:
    """``rows`` with the rank of tied values in their group as ``name``: their ``average``, ``min`` or ``max``; null values have none."""
    place = {"average": F.col("rows_below") + (F.col("rows_at") + 1) / 2.0, "min": F.col("rows_below") + 1, "max": F.col("rows_below") + F.col("rows_at")}[method]
    c = cut(cumulated(rows, keys, value).select(*[F.col(k).alias(f"rank_{k}") for k in keys], F.col("value_at").alias("rank_x"), place.alias(name)))
    # A written table is counted without being read again; a few values that all rows have would be a few hot partitions.
    c = F.broadcast(c) if c.count() <= FEW_VALUES else c
    return rows.join(c, [F.col(k).eqNullSafe(F.col(f"rank_{k}")) for k in keys] + [F.col(value) == F.col("rank_x")], "left").drop("rank_x", *[f"rank_{k}" for k in keys])
