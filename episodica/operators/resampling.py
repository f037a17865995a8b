"""Resampling that is dealt over tasks: bootstrapped correlations and the simulated power of a two-sample test.

Random numbers are counters put through a hash, so that a row, a replicate and a place have the same number wherever and
however often they are computed, in any engine.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.linalg import ks_exact
from .moments import _by_key, _types, resample_counts
from .order import average_ranks

#: Counts of rows in replicates that are held at once, which a core's own cache holds; replicates that one task simulates
#: together, and the tasks that replicates or rows are dealt to.
HELD_COUNTS, CHUNK, TASKS = 32_000, 25, 240
#: Both sizes up to this one get an exact p-value.
EXACT = 10_000


def bootstrap_sums(rows: DataFrame, keys: list[str], x: str, y: str, entity: str, replicates: int, seed: int = 0, centers: DataFrame | None = None) -> DataFrame:
    """``keys``, ``replicate`` (0: the rows themselves) and the weighted sums ``w``, ``sx``, ``sy``, ``sxx``, ``syy``, ``sxy``.

    Rows with a null in x or y do not count.  Values are taken about their group's ``mean_x`` and ``mean_y`` (``centers``),
    which keeps the sums exact enough; a task adds up its own rows for every replicate, and only these sums are shuffled.
    """
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(entity).cast("long").alias("entity"))
    means = known.groupBy(*keys).agg(F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y")) if centers is None else centers
    # A task holds sums of all replicates for each group, beside which a group's means are little.
    means = F.broadcast(means.select(*[F.col(k).alias(f"of_{k}") for k in keys], "mean_x", "mean_y"))
    both = known.join(means, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]) if keys else known.crossJoin(means)
    used = both.select(*keys, (F.col("x") - F.col("mean_x")).alias("x"), (F.col("y") - F.col("mean_y")).alias("y"), "entity")
    names = ["w", "sx", "sy", "sxx", "syy", "sxy"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds = None
        for batch in batches:
            kinds = batch.schema.types[: len(keys)]
            a, b, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "entity"))
            terms = np.stack([np.ones(len(a)), a, b, a * a, b * b, a * b], axis=1)
            for key, at in _by_key(batch, len(keys)):
                total = held.setdefault(key, np.zeros((replicates + 1, 6)))
                total[0] += terms[at].sum(axis=0)
                size = max(1, HELD_COUNTS // max(1, replicates))
                for i in range(0, len(at), size):
                    part = at[i : i + size]
                    total[1:] += (terms[part].T @ resample_counts(ids[part], replicates, seed)).T
        for key, total in held.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(total), t) for k, t in zip(key, kinds, strict=True)), pa.array(np.arange(len(total), dtype=np.int32)), *(pa.array(c) for c in total.T)], names=[*keys, "replicate", *names])

    # A row costs as many hashes as there are replicates, so that rows are dealt evenly whatever files they come from.
    parts = used.repartition(TASKS, "entity").mapInArrow(add, f"{_types(rows, keys) + ', ' if keys else ''}replicate int, " + ", ".join(f"{c} double" for c in names))
    return parts.groupBy(*keys, "replicate").agg(*[F.sum(c).alias(c) for c in names])


def bootstrap_correlation(rows: DataFrame, keys: list[str], x: str, y: str, entity: str, replicates: int = 1000, level: float = 0.95, ranks: bool = False, seed: int = 0) -> DataFrame:
    """``n_rows``, ``correlation``, ``ci_low`` and ``ci_high`` of each group, null without three rows and two values a side.

    Replicates count each row a Poisson number of times by its ``entity``; those in which a side does not vary are left
    out.  With ``ranks`` the values are the mean ranks in the whole group (Spearman); replicates weigh these ranks and do
    not rank anew.
    """
    centers = None
    if ranks:
        given = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        middle = (F.count(F.lit(1)) + 1) / 2.0
        centers = given.groupBy(*keys).agg(middle.alias("mean_x"), middle.alias("mean_y"))  # ranks are not joined twice for their mean
        rows, x, y = average_ranks(average_ranks(given, keys, x, "rank_of_x"), keys, y, "rank_of_y"), "rank_of_x", "rank_of_y"
    sums = bootstrap_sums(rows, keys, x, y, entity, replicates, seed, centers).where("w > 0")
    over = lambda a, b, ab: F.col(ab) - F.col(a) * F.col(b) / F.col("w")
    vx, vy = over("sx", "sx", "sxx"), over("sy", "sy", "syy")
    varies = (vx > F.col("sxx") * 1e-12) & (vy > F.col("syy") * 1e-12)
    r = F.when(varies & (F.col("w") >= 3), over("sx", "sy", "sxy") / F.nullif(F.sqrt(vx * vy), F.lit(0.0)))
    each = sums.select(*keys, "replicate", "w", r.alias("r"))
    own, drawn = F.col("replicate") == 0, F.when(F.col("replicate") > 0, F.col("r"))
    tail = (1 - level) / 2
    # A group has as many rows here as there are replicates.
    out = each.groupBy(*keys).agg(F.max(F.when(own, F.col("w"))).cast("long").alias("n_rows"), F.max(F.when(own, F.col("r"))).alias("correlation"), F.percentile(drawn, tail).alias("low"), F.percentile(drawn, 1 - tail).alias("high"))
    known = F.col("correlation").isNotNull()
    return out.select(*keys, "n_rows", "correlation", F.when(known, F.col("low")).alias("ci_low"), F.when(known, F.col("high")).alias("ci_high"))


def drawn_places(prefix: str, sizes: int) -> np.ndarray:
    """Of draws 1 to ``sizes`` a place from 0 to ``sizes`` - 1 each, by the first eight hex digits of the MD5 of prefix and draw."""
    begun = hashlib.md5(prefix.encode())

    def digits(i: int) -> bytes:
        draw = begun.copy()
        draw.update(b":%d" % i)
        return draw.digest()[:4]

    return (np.frombuffer(b"".join(map(digits, range(1, sizes + 1))), ">u4") % sizes).astype(np.int64)


def _p_value(n: int, m: int, steps: int) -> float:
    """Of the distance ``steps`` / (n m): exact for small samples, else by the limiting distribution."""
    distance = steps / (n * m)
    if max(n, m) <= EXACT:
        return ks_exact(n, m, distance)
    lam = math.sqrt(n * m / (n + m)) * distance
    return 1.0 if lam < 0.2 else min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 41))))


@functools.lru_cache(maxsize=10_000)
def critical_steps(n: int, m: int, alpha: float) -> int:
    """The smallest distance in units of 1 / (n m) whose p-value is below ``alpha``; n m + 1 if none is."""
    # A larger distance has no larger p-value, so that some 2 log2(n m) of them are asked for and not one for each test.
    low, high = 0, n * m + 1
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if _p_value(n, m, middle) < alpha else (middle, high)
    return high


def distance_steps(a: np.ndarray, b: np.ndarray) -> int:
    """The Kolmogorov-Smirnov distance of two samples in units of 1 / (n m)."""
    a, b = np.sort(a), np.sort(b)
    both = np.concatenate([a, b])
    return int(np.abs(np.searchsorted(a, both, side="right") * len(b) - np.searchsorted(b, both, side="right") * len(a)).max())


class _Pool:
    """Distances of samples that are drawn from one pool, by how often each place of its order is drawn.

    Where the pool and the moved pool meet depends on the shift alone; a pair of samples costs cumulated counts.
    """

    def __init__(self, z: np.ndarray, shifts: tuple[float, ...]):
        self.size = len(z)
        self.meets = []
        for shift in shifts:
            moved = z + shift
            # For each value of either pool: how many places of the pool and of the moved pool are not above it.
            self.meets.append([(np.searchsorted(z, at, side="right"), np.searchsorted(moved, at, side="right")) for at in (z, moved)])

    def steps(self, first: np.ndarray, second: np.ndarray) -> list[int]:
        """For each shift the distance in units of 1 / (n m) of the places ``first`` and the moved places ``second``."""
        below = [np.concatenate([[0], np.cumsum(np.bincount(x, minlength=self.size))]) * len(y) for x, y in ((first, second), (second, first))]
        return [max(int(np.abs(below[0][i] - below[1][j]).max()) for i, j in meets) for meets in self.meets]


def simulated_tests(rows: DataFrame, keys: list[str], value: str, second: str, shifts: tuple[float, ...], replicates: int) -> DataFrame:
    """``keys``, ``replicate``, ``shift``, ``n_first``, ``n_second``, ``ks``, ``steps`` (``ks`` in units of 1 / (n m)) of two samples under a shift.

    Both samples are drawn with replacement from the pooled, standardized values of their group, in the sizes that they
    have there, and the second is moved by ``shift`` pooled deviations: without a shift the null hypothesis holds.  A task
    gets a group's pooled values and ``CHUNK`` of its replicates and simulates one after the other: draws and samples are
    never rows, and it holds some 400 bytes for each pooled value, as much as for one pair of samples.  Groups without spread
    or without one of the samples have no tests.
    """
    known = rows.where(F.col(value).isNotNull())
    sizes = known.groupBy(*keys).agg(F.count_if(~F.col(second)).alias("n_first"), F.count_if(F.col(second)).alias("n_second"), F.avg(value).alias("center"), F.stddev_samp(value).alias("spread"))
    sizes = cut(sizes.where("n_first > 0 and n_second > 0 and spread > 0"))
    named = sizes.select(*[F.col(k).alias(f"of_{k}") for k in keys], "n_first", "center", "spread", F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).alias("named"))
    pooled = known.join(named, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys])
    z = (F.col(value).cast("double") - F.col("center")) / F.col("spread")
    held = pooled.select(*keys, "named", "n_first", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // CHUNK))).alias("chunk"), z.alias("z")).repartition(TASKS, *keys, "chunk")

    def test(key, part):
        *own, name, n_first, chunk = (k.as_py() for k in key)
        pool = _Pool(np.sort(part.column("z").to_numpy()), shifts)
        n_second = pool.size - n_first
        out = []
        for r in range(chunk * CHUNK + 1, min(replicates, (chunk + 1) * CHUNK) + 1):
            places = drawn_places(f"{name}:{r}" if keys else str(r), pool.size)
            out += [(r, shift, n_first, n_second, steps / (n_first * n_second), steps) for shift, steps in zip(shifts, pool.steps(places[:n_first], places[n_first:]), strict=True)]
        columns = list(zip(*out, strict=True))
        kinds = (pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
        return pa.table([*(pa.array([k] * len(out), kind.type) for k, kind in zip(own, key, strict=False)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[*keys, "replicate", "shift", "n_first", "n_second", "ks", "steps"])

    return held.groupBy(*keys, "named", "n_first", "chunk").applyInArrow(test, f"{_types(rows, keys) + ', ' if keys else ''}replicate int, shift double, n_first long, n_second long, ks double, steps long")


def power_curve(tests: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """``power`` (p-value below ``alpha``) and its Monte-Carlo error at each shift of each group, with the mean distance."""
    bound = F.udf(lambda n, m: critical_steps(n, m, alpha), "long")
    judged = tests.select(*keys, "shift", "ks", (F.col("steps") >= bound("n_first", "n_second")).cast("double").alias("rejected"))
    found = judged.groupBy(*keys, "shift").agg(F.count(F.lit(1)).alias("replicates"), F.avg("ks").alias("mean_ks"), F.avg("rejected").alias("power"))
    return found.withColumn("standard_error", F.sqrt(F.col("power") * (1 - F.col("power")) / F.col("replicates")))


def detectable_shifts(curve: DataFrame, keys: list[str], target: float) -> DataFrame:
    """The smallest shift whose mean power over a group's curves reaches ``target`` (null: none), and the null's rejections."""
    mean = curve.groupBy(*keys, "shift").agg(F.avg("power").alias("power"), F.count(F.lit(1)).alias("n_curves"))
    return mean.groupBy(*keys).agg(
        F.max("n_curves").alias("n_curves"), F.min(F.when(F.col("power") >= target, F.col("shift"))).alias("detectable_shift"),
        F.min_by("power", F.abs("shift")).alias("null_rejections"), F.max("shift").alias("largest_shift"),
    )
