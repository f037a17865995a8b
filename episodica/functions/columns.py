"""Column macros that several operators share; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Comparisons at a published boundary allow this much.
BOUNDARY = 1e-12
#: 0.75 quantile of the standard normal, the usual MAD consistency factor.
MAD_FACTOR = 0.67448975


def at_least(x: Column, bound: float) -> Column:
    return x >= bound - BOUNDARY


def at_most(x: Column, bound: float) -> Column:
    return x <= bound + BOUNDARY


def conformal_rank(n: Column, alpha: float) -> Column:
    """ceil((n + 1)(1 - alpha)), before any clipping to n."""
    return F.ceil((n + 1) * F.lit(1 - alpha)).cast("long")


def ratio(a: Column, b: Column, zero: Column | None = None) -> Column:
    """a / b; where b is 0 the column ``zero``, or null."""
    return F.when(b != 0, a / b).otherwise(F.lit(None).cast("double") if zero is None else zero)


def signed_ratio(a: Column, b: Column) -> Column:
    """a / b with +inf for a > 0 = b and NaN for 0 / 0."""
    return ratio(a, b, F.when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))


def median(x: Column | str) -> Column:
    return F.percentile(x, 0.5)


def robust_z(x: Column, center: Column, mad: Column, floor: float = 1e-12) -> Column:
    """0.67448975 (x - median) / MAD; 0 where the MAD vanishes."""
    return F.when(mad > floor, F.lit(MAD_FACTOR) * (x - center) / mad).otherwise(0.0)


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's correlation; null where a side does not vary, which the built-in divides by."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def average_rank(keys: list[str], by: str) -> Column:
    """Mean rank of tied values, as rank correlation and AUROC need it."""
    ordered = Window.partitionBy(*keys).orderBy(by)
    peers = Window.partitionBy(*keys, by)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(peers) - 1) / 2.0


def seeded_order(entity: Column, seed: Column) -> Column:
    """A hash that orders entities pseudo-randomly for a seed, equal on every engine that has MD5."""
    return F.md5(F.concat(entity.cast("string"), F.lit(":"), seed.cast("string")))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson score interval of k successes in n trials."""
    p, z2 = k / n, z * z
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))


def grouped(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)


def boolean_of(text: Column) -> Column:
    """true/1/yes and false/0/no in any case; anything else raises."""
    t = F.lower(F.trim(text.cast("string")))
    bad = F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(t, F.lit("null")))).cast("boolean")
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False).otherwise(bad)


def normalized_name(text: Column) -> Column:
    """Lower case with every run of other characters as one underscore."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")
