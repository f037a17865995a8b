"""Contracts over tables: each returns the violating rows, so that a caller can count, show or raise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def not_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a null, NaN or infinity in any of the columns."""
    bad = [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c)) == float("inf")) for c in columns]
    return df.where(reduce(lambda a, b: a | b, bad))


def require_none(violations: DataFrame, message: str) -> None:
    """Raise if there is a violation; looks at one row only."""
    found = violations.limit(1).collect()
    if found:
        raise ValueError(f"{message}: {found[0]}")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def not_constant(df: DataFrame, episode: str, columns: list[str]) -> DataFrame:
    """Episodes in which a column takes several values, null counting as one."""
    distinct = [(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns]
    counted = df.groupBy(episode).agg(*distinct)
    return counted.where(reduce(lambda a, b: a | b, [F.col(c) != 1 for c in columns]))


def overlaps(membership: DataFrame, entity: str, partition: str, within: list[str]) -> DataFrame:
    """Entities in several partitions of one run."""
    return membership.groupBy(*within, entity).agg(F.count_distinct(partition).alias("partitions")).where("partitions > 1")


def overlap_counts(membership: DataFrame, entity: str, partition: str) -> DataFrame:
    """How many entities each pair of partitions shares."""
    sets = membership.groupBy(entity).agg(F.array_sort(F.collect_set(partition)).alias("p"))
    pairs = sets.select(F.explode("p").alias("partition_a"), "p").select("partition_a", F.explode("p").alias("partition_b")).where("partition_a <= partition_b")
    return pairs.groupBy("partition_a", "partition_b").agg(F.count(F.lit(1)).alias("shared"))


def not_nested(membership: DataFrame, entity: str, run: list[str], size: str) -> DataFrame:
    """Members of a size that the next larger size of the run lacks."""
    sizes = membership.select(*run, size).distinct().withColumn("larger", F.lead(size).over(Window.partitionBy(*run).orderBy(size))).where("larger is not null")
    wanted = membership.join(sizes, [*run, size]).select(*run, F.col("larger").alias(size), entity)
    return wanted.join(membership.select(*run, size, entity), [*run, size, entity], "left_anti")


def missing_and_unexpected(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Completeness of a grid: keys that lack, repeat or should not be there."""
    counted = observed.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    both = expected.select(*keys).distinct().withColumn("wanted", F.lit(1)).join(counted, keys, "full_outer")
    status = F.when(F.col("wanted").isNull(), "unexpected").when(F.col("copies").isNull(), "missing").when(F.col("copies") > 1, "duplicate")
    return both.withColumn("status", status).where("status is not null").select(*keys, "status")
