"""Leakage-safe partitions of episodes: a seeded order that every engine can repeat, nested prefixes of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import seeded_order


#: Hexadecimal digits of the order's hash that name a range: 4096 ranges, whatever the number of entities.
RANGE_DIGITS = 3


def seeded_rank(entities: DataFrame, entity: str, seed: int) -> DataFrame:
    """``entity``, its ``rank`` from 1 in the seed's order, and ``n`` entities.

    The hash is uniform, so its first digits cut the order into even ranges, each a window of its own.
    """
    hashed = entities.select(entity, seeded_order(F.col(entity), F.lit(seed)).alias("h")).withColumn("range", F.substring("h", 1, RANGE_DIGITS))
    counts = hashed.groupBy(F.col("range").alias("of")).agg(F.count(F.lit(1)).alias("c"))
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("of", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"), F.sum("c").over(Window.partitionBy()).alias("n"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy("h", entity))
    return hashed.withColumn("inside", inside).join(F.broadcast(starts), F.col("range") == F.col("of")).select(entity, (F.col("start") + F.col("inside")).alias("rank"), "n")


def seeded_ranks(entities: DataFrame, entity: str, seeds: Sequence[int], most: int | None = None) -> DataFrame:
    """``seed``, ``entity``, ``rank`` from 1 in each seed's order; with ``most`` only the first ones.

    As in :func:`seeded_rank`, the hash's first digits cut every seed's order into windows of their own; ranges that begin
    behind ``most`` are dropped before any window.
    """
    seeded = entities.select(entity, F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    hashed = seeded.withColumn("h", seeded_order(F.col(entity), F.col("seed"))).withColumn("range", F.substring("h", 1, RANGE_DIGITS))
    counts = hashed.groupBy(F.col("seed").alias("of_seed"), F.col("range").alias("of")).agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("of_seed").orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("of_seed", "of", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    if most is not None:
        starts = starts.where(F.col("start") < most)
    # At most 4096 ranges for each seed.
    held = hashed.join(F.broadcast(starts), (F.col("seed") == F.col("of_seed")) & (F.col("range") == F.col("of")))
    inside = F.row_number().over(Window.partitionBy("seed", "range").orderBy("h", entity))
    ranked = held.select("seed", entity, (F.col("start") + inside).alias("rank"))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def fixed_partitions(episodes: DataFrame, entity: str, calibration_share: float, evaluation_share: float, seed: int = 42) -> DataFrame:
    """``partition`` calibration, evaluation or reservoir by the rank under the master seed."""
    ranked = seeded_rank(episodes, entity, seed)
    first = F.floor(F.col("n") * F.lit(calibration_share))
    second = first + F.floor(F.col("n") * F.lit(evaluation_share))
    return ranked.select(entity, "rank", F.when(F.col("rank") <= first, "calibration").when(F.col("rank") <= second, "evaluation").otherwise("reservoir").alias("partition"))


def nested_commissioning(reservoir: DataFrame, entity: str, seeds: Sequence[int], sizes: Sequence[int]) -> DataFrame:
    """``seed``, ``commissioning_n``, ``selection_rank``: for each seed one order, for each size its prefix."""
    ranked = seeded_ranks(reservoir, entity, seeds, max(sizes)).withColumnRenamed("rank", "selection_rank")
    return ranked.withColumn("commissioning_n", F.explode(F.array(*[F.lit(s) for s in sizes]))).where("selection_rank <= commissioning_n").select("seed", "commissioning_n", "selection_rank", entity)


def budget_split(pool: DataFrame, entity: str, seeds: Sequence[int], allocations: Sequence[tuple[int, int]]) -> DataFrame:
    """Fixed budgets: of a seed's order the first ``fit`` rows train and the next ``cal`` calibrate."""
    ranked = nested_commissioning(pool, entity, seeds, [max(f + c for f, c in allocations)])
    grid = F.explode(F.array(*[F.struct(F.lit(f).alias("fit"), F.lit(c).alias("cal")) for f, c in allocations]))
    role = F.when(F.col("selection_rank") <= F.col("a.fit"), "fit").otherwise("calibration")
    return ranked.withColumn("a", grid).where("selection_rank <= a.fit + a.cal").select("seed", F.col("a.fit").alias("fit"), F.col("a.cal").alias("cal"), "selection_rank", entity, role.alias("role"))


def kfold(df: DataFrame, entity: str, folds: int, seed: int) -> DataFrame:
    """``fold`` of each row: places in the seeded order of its entities, dealt in turn."""
    places = seeded_rank(df.select(entity).distinct(), entity, seed).select(F.col(entity).alias("folded"), F.pmod(F.col("rank") - 1, F.lit(folds)).cast("int").alias("fold"))
    return df.join(places, F.col(entity).eqNullSafe(F.col("folded"))).drop("folded")


def split_folds(df: DataFrame, entity: str, folds: int, seed: int) -> DataFrame:
    """``fold`` of each row: consecutive parts of the seeded order of its entities, the first ones larger by one if any."""
    ranked = seeded_rank(df.select(entity).distinct(), entity, seed).select(F.col(entity).alias("folded"), (F.col("rank") - 1).alias("at"), F.expr(f"n div {folds}").alias("q"), (F.col("n") % folds).alias("more"))
    large = F.col("more") * (F.col("q") + 1)
    fold = F.when(F.col("at") < large, F.floor(F.col("at") / (F.col("q") + 1))).otherwise(F.col("more") + F.floor((F.col("at") - large) / F.greatest("q", F.lit(1))))
    return df.join(ranked.select("folded", fold.cast("int").alias("fold")), F.col(entity).eqNullSafe(F.col("folded"))).drop("folded")


def remaining_runs(grid: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of the grid that no result row has yet."""
    return grid.join(results.select(*keys).distinct(), keys, "left_anti")


def set_hash(members: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """SHA-256 of each group's ids in ascending order, so equal sets hash alike whatever their row order."""
    ids = F.array_sort(F.collect_list(F.col(entity)))
    return members.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(ids, lambda x: x.cast("string")), "\n"), 256).alias("members_sha256"), F.count(F.lit(1)).alias("members"))


def legacy_split(healthy: DataFrame, entity: str, seeds: Sequence[int], size: int, pool: int, calibration: int, evaluation: int) -> DataFrame:
    """One order of all healthy entities for each seed: commissioning from a pool, then calibration, then evaluation."""
    if not 0 < size <= pool or calibration <= 0 or evaluation <= 0:
        raise ValueError("sizes must be positive, and the commissioning size within its pool")
    ranked = seeded_ranks(healthy, entity, seeds, pool + calibration + evaluation)
    r = F.col("rank")
    return ranked.select("seed", entity, "rank", F.when(r <= size, "commissioning").when(r <= pool, "pool").when(r <= pool + calibration, "calibration").otherwise("evaluation").alias("partition"))


def extended_calibration(healthy: DataFrame, entity: str, seeds: Sequence[int], pool: int, calibration: int, evaluation: int) -> DataFrame:
    """``place`` of each calibration member: those of the legacy split first, then all that it leaves unused."""
    used = pool + calibration + evaluation
    ranked = seeded_ranks(healthy, entity, seeds).where((F.col("rank") > pool) & ((F.col("rank") <= pool + calibration) | (F.col("rank") > used)))
    return ranked.select("seed", entity, (F.when(F.col("rank") > used, F.col("rank") - evaluation).otherwise(F.col("rank")) - pool).alias("place"))


def frozen_split(healthy: DataFrame, entity: str, seeds: Sequence[int], most: int, calibration: int, evaluation: int, evaluation_seed: int = 42) -> DataFrame:
    """Calibration and evaluation fixed by one seed (``seed`` null); each seed orders what remains for commissioning."""
    if min(most, calibration, evaluation) <= 0:
        raise ValueError("sizes must be positive")
    ranked = seeded_rank(healthy, entity, evaluation_seed)
    fixed = ranked.where(F.col("rank") <= calibration + evaluation)
    named = fixed.select(F.lit(None).cast("int").alias("seed"), entity, "rank", F.when(F.col("rank") <= calibration, "calibration").otherwise("evaluation").alias("partition"))
    rest = seeded_ranks(ranked.where(F.col("rank") > calibration + evaluation), entity, seeds, most)
    return named.unionByName(rest.select("seed", entity, "rank", F.lit("commissioning").alias("partition")))


def stratified_limit(entities: DataFrame, stratum: str, entity: str, most: int) -> DataFrame:
    """The first ``most`` entities of each stratum by id."""
    if most <= 0:
        raise ValueError("limits must be positive")
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(entity))
    return entities.select(stratum, entity).withColumn("place", place).where(F.col("place") <= most).drop("place")
