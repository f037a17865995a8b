"""Spans of rows: an inventory of episodes as [first_row, stop_row) within files, its guards, and reads of the rows in it.

A span of length n belongs to the least power of two that is not smaller, and lies in at most two buckets of that width.  A
row is looked up once for each power that occurs, so that the join is by equality whatever the lengths are; a giant span
costs no more than a short one.  The rows' scan gets the inventory's least and largest row as its own bounds, which skip
files and row groups by their statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: Rows whose spans begin in one window of the guards.
RANGE = 1 << 16


def _power(length: Column) -> Column:
    """The least k with 2^k >= length, in integers."""
    return F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1))).cast("int")


def inventory(rows: DataFrame, keys: list[str], episode: str, row: str) -> DataFrame:
    """``first_row``, ``stop_row``, ``n_rows`` of each episode, and whether these are all rows of the span."""
    found = rows.groupBy(*keys, episode).agg(F.min(row).alias("first_row"), (F.max(row) + 1).alias("stop_row"), F.count(F.lit(1)).alias("n_rows"))
    return found.withColumn("contiguous", F.col("n_rows") == F.col("stop_row") - F.col("first_row"))


def neighbours(spans: DataFrame, keys: list[str], episode: str, range_rows: int = RANGE) -> DataFrame:
    """``spans`` with ``gap`` from what all spans before reach (negative: shared rows; null: the first) and ``overlaps``.

    Ranges of first rows are windows of their own; how far the ranges before reach comes from one row for each range.
    """
    ranged = spans.withColumn("range", F.floor(F.col("first_row") / range_rows))
    reach = ranged.groupBy(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("range").alias("of_range")).agg(F.max("stop_row").alias("top"))
    before = F.max("top").over(Window.partitionBy(*[f"of_{k}" for k in keys]).orderBy("of_range").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.max("stop_row").over(Window.partitionBy(*keys, "range").orderBy("first_row", episode).rowsBetween(Window.unboundedPreceding, -1))
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys] + [F.col("range") == F.col("of_range")]
    joined = ranged.withColumn("inside", inside).join(reach.withColumn("before", before).drop("top"), same)
    gap = F.col("first_row") - F.greatest("inside", "before")
    return joined.select(*spans.columns, gap.alias("gap"), F.coalesce(gap < 0, F.lit(False)).alias("overlaps"))


def read_spans(rows: DataFrame, spans: DataFrame, keys: list[str], row: str, episode: str, columns: list[str]) -> DataFrame:
    """``keys``, ``episode``, ``row`` and ``columns`` of every row in every span; a row in several spans comes for each.

    Empty spans have no rows.  Null keys match each other.
    """
    used = cut(spans.where("stop_row > first_row").select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col(episode).alias("in_episode"), "first_row", "stop_row").withColumn("power", _power(F.col("stop_row") - F.col("first_row"))))
    bounds = used.agg(F.min("first_row").alias("low"), F.max("stop_row").alias("high"), F.collect_set("power").alias("powers")).first()
    if bounds["low"] is None:
        return rows.where("false").select(*keys, F.lit(None).cast(spans.schema[episode].dataType).alias(episode), row, *columns)
    bucket = lambda r: F.expr(f"shiftright({r}, power)")
    buckets = used.withColumn("last_row", F.col("stop_row") - 1).withColumn("bucket", F.explode(F.sequence(bucket("first_row"), bucket("last_row"))))
    wanted = rows.where((F.col(row) >= bounds["low"]) & (F.col(row) < bounds["high"])).select(*keys, F.col(row).cast("long").alias("at_row"), *columns)
    asked = wanted.withColumn("at_power", F.explode(F.array(*[F.lit(p) for p in sorted(bounds["powers"])]))).withColumn("at_bucket", F.expr("shiftright(at_row, at_power)"))
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys] + [F.col("at_power") == F.col("power"), F.col("at_bucket") == F.col("bucket")]
    found = asked.join(buckets, same).where((F.col("at_row") >= F.col("first_row")) & (F.col("at_row") < F.col("stop_row")))
    return found.select(*keys, F.col("in_episode").alias(episode), F.col("at_row").alias(row), *columns)
