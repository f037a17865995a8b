"""Mergeable moments of rows of vectors, and what follows from them without the rows.

Of each group's vectors a task keeps their number and the sums of x_j, x_j x_k, x_j^2 x_k and x_j^2 x_k^2 about a centre of
its own: four matrices of p columns, however many rows there are.  Two such sums add up after one is moved to the other's
centre, so tasks' sums are merged in two shuffles of a bounded number of rows each.  Any subset of columns, in any scale
and about any centre, has its moments from the same sums.  Hence the standardizing frame, the Ledoit-Wolf covariance (whose
noise is the mean fourth power of a row's length), blends of two domains, folds that are left out, resampled rows and a
single row that is left out all come from one reading; no task ever holds a group's rows.

Moments of all groups of a study come to the driver and go to every executor only after a check of their size
(``MOST_BYTES``); groups are its runs and domains, which its grid bounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as L
from .membership import seeded_rank

#: Sums of a group that are merged side by side, before they meet.
MERGERS = 64
#: Bytes of all groups' sums that the driver takes.
MOST_BYTES = 256 << 20
#: Columns whose variance is not above this do not vary.
LEAST_VARIANCE = 1e-12
PRIOR, PRIORS, FOLDS, GAMMAS = 60.0, (0.0, 5.0, 10.0, 20.0, 60.0), 5, (0.05, 0.1, 0.2, 0.5)


@dataclass(frozen=True)
class Moments:
    """``n`` rows (a sum of weights) and their sums about ``center``."""

    n: float
    center: np.ndarray
    first: np.ndarray
    second: np.ndarray
    third: np.ndarray
    fourth: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, weights: np.ndarray | None = None, center: np.ndarray | None = None) -> Moments:
        center = x.mean(axis=0) if center is None else center
        y = x - center
        squares = y * y
        w = np.ones(len(y)) if weights is None else weights
        wy, ws = y * w[:, None], squares * w[:, None]
        return cls(float(w.sum()), center, wy.sum(axis=0), wy.T @ y, ws.T @ y, ws.T @ squares)

    def about(self, center: np.ndarray) -> Moments:
        """The same rows' sums about another centre."""
        d = center - self.center
        if not d.any():
            return self
        n, s, a, b, q = self.n, self.first, self.second, self.third, self.fourth
        j, k, diagonal = d[:, None], d[None, :], np.diag(a)
        second = a - s[:, None] * k - j * s[None, :] + n * j * k
        third = b - k * diagonal[:, None] - 2 * j * a + 2 * j * k * s[:, None] + j * j * s[None, :] - n * j * j * k
        fourth = q - 2 * k * b - 2 * j * b.T + k * k * diagonal[:, None] + j * j * diagonal[None, :] + 4 * j * k * a - 2 * j * k * k * s[:, None] - 2 * j * j * k * s[None, :] + n * j * j * k * k
        return Moments(n, center, s - n * d, second, third, fourth)

    def __add__(self, other: Moments) -> Moments:
        more = other.about(self.center)
        return Moments(self.n + more.n, self.center, self.first + more.first, self.second + more.second, self.third + more.third, self.fourth + more.fourth)

    def __sub__(self, other: Moments) -> Moments:
        less = other.about(self.center)
        return Moments(self.n - less.n, self.center, self.first - less.first, self.second - less.second, self.third - less.third, self.fourth - less.fourth)

    def without(self, row: np.ndarray) -> Moments:
        """The sums after one row is taken out: rank-one downdates."""
        y = row - self.center
        z = y * y
        return Moments(self.n - 1, self.center, self.first - y, self.second - np.outer(y, y), self.third - np.outer(z, y), self.fourth - np.outer(z, z))

    def scaled(self, center: np.ndarray, scale: np.ndarray, use: np.ndarray) -> Moments:
        """Of (x - center) / scale in the columns ``use``; center and scale are of these columns."""
        moved = self.about(np.where(use, _spread(center, use), self.center))
        c = 1 / scale
        at = np.ix_(use, use)
        return Moments(self.n, np.zeros(int(use.sum())), moved.first[use] * c, moved.second[at] * np.outer(c, c), moved.third[at] * np.outer(c * c, c), moved.fourth[at] * np.outer(c * c, c * c))

    @property
    def mean(self) -> np.ndarray:
        return self.center + self.first / self.n

    def covariance(self) -> np.ndarray:
        """By the number of rows."""
        return self.about(self.mean).second / self.n

    def shrunk(self) -> tuple[np.ndarray, np.ndarray, float]:
        """As :func:`linalg.shrunk_covariance` of the rows: mean, covariance, shrinkage."""
        own = self.about(self.mean)
        p, s = len(own.center), own.second / own.n
        mu = np.trace(s) / p
        spread = np.square(s - mu * np.eye(p)).sum()
        noise = (own.fourth.sum() / own.n - np.square(s).sum()) / own.n
        share = 0.0 if spread <= 0 else float(min(max(noise, 0.0), spread) / spread)
        return own.center, (1 - share) * s + share * mu * np.eye(p), share

    def packed(self) -> bytes:
        return np.concatenate([[self.n], self.center, self.first, self.second.ravel(), self.third.ravel(), self.fourth.ravel()]).tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Moments:
        flat = np.frombuffer(data)
        p = round((math.sqrt(1 + 3 * (len(flat) - 1)) - 1) / 3)
        n, center, first, *rest = np.split(flat, np.cumsum([1, p, p, p * p, p * p]))
        return cls(float(n[0]), center, first, *(r.reshape(p, p) for r in rest))


def _spread(values: np.ndarray, use: np.ndarray) -> np.ndarray:
    out = np.zeros(len(use))
    out[use] = values
    return out


def vectors_of(column: pa.Array) -> np.ndarray:
    """A list column as a matrix; all lists must be as long and without nulls."""
    sizes = set(column.value_lengths().to_pylist())
    if len(sizes) > 1 or None in sizes:
        raise ValueError("a vector is null or not as long as others")
    values = column.flatten()
    if values.null_count:
        raise ValueError("a vector holds a null")
    return values.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _by_key(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """Each key in ``batch`` (its first columns) and the numbers of its rows."""
    places: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(n_keys)), strict=True)):
        places.setdefault(key, []).append(i)
    for key, rows in places.items():
        yield key, np.array(rows)


def moments(rows: DataFrame, keys: list[str], vector: str = "v", replicates: int = 0, entity: str | None = None, seed: int = 42, counts: Callable | None = None) -> DataFrame:
    """``keys`` and ``moments`` (packed) of each group of ``rows``.

    With ``replicates``, each group also has as many resamples, numbered from 1 in ``replicate`` (0: the group itself),
    in which a row counts as often as :func:`resample_counts` of its ``entity`` says, or another function of that kind.
    """
    kinds = dict(rows.dtypes)
    more = ["replicate"] if replicates else []
    out_keys = [*keys, *more]
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{k} int" for k in more), "moments binary"])
    types = [*(rows.schema[k].dataType for k in keys)]

    def emit(held: dict[tuple, Moments]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [*map(to_arrow_type, types), *[pa.int32()] * len(more)]
        for key, m in held.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(key, kinds, strict=True)), pa.array([m.packed()], pa.binary())], names=[*out_keys, "moments"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Moments] = {}
        for batch in batches:
            x = vectors_of(batch.column("v"))
            for key, at in _by_key(batch, len(keys)):
                part = x[at]
                found = [(key + (0,) * len(more), Moments.of(part))]
                if replicates:
                    often = (counts or resample_counts)(batch.column("entity").to_numpy(zero_copy_only=False)[at], replicates, seed)
                    found += [((*key, r + 1), Moments.of(part, often[:, r], part.mean(axis=0))) for r in range(replicates)]
                for k, m in found:
                    held[k] = held[k] + m if k in held else m
        yield from emit(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Moments] = {}
        for batch in batches:
            for *key, _, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m, k = Moments.unpacked(data), tuple(key)
                held[k] = held[k] + m if k in held else m
        yield from emit(held)

    named = rows.select(*keys, F.col(vector).cast("array<double>").alias("v"), *([F.xxhash64(entity).alias("entity")] if replicates else []))
    parts = named.mapInArrow(gather, schema)
    salted = parts.select(*out_keys, F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("salt"), "moments")
    once = salted.repartition(*out_keys, "salt").mapInArrow(merge, schema)
    return once.select(*out_keys, F.lit(0).alias("salt"), "moments").repartition(*out_keys).mapInArrow(merge, schema)


#: Prime modulus of the counters' hash, its factors and additive constants.
PRIME, ROW_STEP, REPLICATE_STEP, MIX = 2_147_483_647, 48_271, 69_621, (12_345, 67_891)
#: A row counts once for each of these that its hash reaches: a Poisson number with mean 1.
POISSON = tuple(math.ceil(PRIME * c) for c in np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)]).tolist())


def _folded(x: np.ndarray) -> np.ndarray:
    """``x`` below 2 PRIME, by PRIME: without its subtraction the smaller of both wraps to the larger."""
    return np.minimum(x, x - np.uint32(PRIME))


def resample_hash(row: np.ndarray, replicate: np.ndarray) -> np.ndarray:
    """A number below PRIME for each row and replicate: a counter-based hash of products that fit a long, in any engine.

    PRIME is 2^31 - 1, so a remainder is a shift, a mask and a sum instead of a division.
    """
    by_row = np.mod(row, PRIME).astype(np.int64) * ROW_STEP % PRIME
    h = _folded(by_row.astype(np.uint32) + np.mod(replicate * REPLICATE_STEP, PRIME).astype(np.uint32))
    for step in MIX:
        product = np.multiply(h, _folded(h + np.uint32(step)), dtype=np.uint64)
        high = product >> np.uint64(31)
        product &= np.uint64(PRIME)
        product += high
        h = _folded(product.astype(np.uint32))
    return h


def resample_counts(entities: np.ndarray, replicates: int, seed: int = 0) -> np.ndarray:
    """How often each entity counts in each resample: Poisson with mean 1, the same wherever the row is read."""
    h = resample_hash(entities.astype(np.int64)[:, None], np.arange(1, replicates + 1)[None, :] + seed * 1009)
    counts = np.zeros(h.shape, np.uint8)
    for least in POISSON:
        counts += (h >= np.uint32(least)).view(np.uint8)
    return counts.astype(float)


def collected(found: DataFrame, keys: list[str]) -> dict[tuple, Moments]:
    """All groups' moments on the driver; an error if they are larger than MOST_BYTES together."""
    found = found.cache()
    try:
        size = found.agg(F.sum(F.octet_length("moments"))).first()[0] or 0
        if size > MOST_BYTES:
            raise ValueError(f"moments of all groups have {size} bytes, more than {MOST_BYTES}")
        return {tuple(r[k] for k in keys): Moments.unpacked(bytes(r["moments"])) for r in found.collect()}
    finally:
        found.unpersist()


# -- detectors and covariances from moments ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Frame:
    """Columns that vary in some rows, standardized by their population moments."""

    use: np.ndarray
    center: np.ndarray
    scale: np.ndarray

    @classmethod
    def of(cls, m: Moments) -> Frame:
        variance = np.diag(m.covariance())
        use = variance > LEAST_VARIANCE
        if not use.any():
            raise ValueError("no feature varies in the training rows")
        return cls(use, m.mean[use], np.sqrt(variance[use]))

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x[:, self.use] - self.center) / self.scale

    def moments(self, m: Moments) -> Moments:
        return m.scaled(self.center, self.scale, self.use)


#: frame, mean and covariance in it
Gaussian = tuple[Frame, np.ndarray, np.ndarray]
FITS: dict[str, Callable[[Moments, Moments], Gaussian]] = {}


def _alone(pick: Callable[[Moments, Moments], Moments]) -> Callable[[Moments, Moments], Gaussian]:
    def fit(s: Moments, t: Moments) -> Gaussian:
        m = pick(s, t)
        frame = Frame.of(m)
        mean, cov, _ = frame.moments(m).shrunk()
        return frame, mean, cov

    return fit


FITS["TargetOnly"], FITS["SourceOnly"], FITS["Pooled"] = _alone(lambda s, t: t), _alone(lambda s, t: s), _alone(lambda s, t: s + t)

#: Mean and covariance of each ablation: of the t(arget), the s(ource) or b(lended).
CHOICES = {"Blended": "bb", "MeanTransferOnly": "bt", "CovarianceTransferOnly": "tb", "TargetMeanSourceCovariance": "ts", "SourceMeanTargetCovariance": "st"}


def blended(s: Moments, t: Moments, prior: float = PRIOR) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Shrunk moments of both domains and their blend with target weight n / (n + prior)."""
    (ms, cs, _), (mt, ct, _) = s.shrunk(), t.shrunk()
    w = t.n / (t.n + prior)
    return {"s": (ms, cs), "t": (mt, ct), "b": ((1 - w) * ms + w * mt, (1 - w) * cs + w * ct)}


def _component(choice: str) -> Callable[[Moments, Moments], Gaussian]:
    def fit(s: Moments, t: Moments) -> Gaussian:
        frame = Frame.of(s + t)
        parts = blended(frame.moments(s), frame.moments(t))
        return frame, parts[choice[0]][0], L.floored(parts[choice[1]][1])

    return fit


FITS |= {name: _component(choice) for name, choice in CHOICES.items()}


def _swapped(values: str, vectors: str) -> Callable[[Moments, Moments], Gaussian]:
    """Target mean, one domain's eigenvalues on the other's eigenvectors."""

    def fit(s: Moments, t: Moments) -> Gaussian:
        frame = Frame.of(s + t)
        parts = blended(frame.moments(s), frame.moments(t))
        w, v = np.linalg.eigh(parts[values][1])[0], np.linalg.eigh(parts[vectors][1])[1]
        return frame, parts["t"][0], L.floored((v * w) @ v.T)

    return fit


FITS["EigenvectorsOnly"], FITS["EigenvaluesOnly"] = _swapped("t", "s"), _swapped("s", "t")


def scorer(fitted: Gaussian) -> Callable[[np.ndarray], np.ndarray]:
    frame, mean, cov = fitted
    inverse = np.linalg.pinv(cov, hermitian=True)
    return lambda q: L.mahalanobis(frame.rows(q), mean, inverse)


def gaussian_risk(m: Moments, cov: np.ndarray) -> float:
    """(tr(S P) - log |P|) / p of the rows' own covariance under the inverse P of ``cov``."""
    precision = np.linalg.pinv(L.floored(cov), hermitian=True)
    sign, log_det = np.linalg.slogdet(precision)
    return float((np.sum(m.covariance() * precision) - log_det) / len(precision)) if sign > 0 and np.isfinite(log_det) else math.inf


def ridge(m: Moments, gamma: float) -> np.ndarray:
    """The sample covariance (by n - 1) with the share ``gamma`` of the identity times its mean variance."""
    s = m.covariance() * m.n / (m.n - 1)
    return (1 - gamma) * s + gamma * max(np.trace(s) / len(s), LEAST_VARIANCE) * np.eye(len(s))


def covariance_family(source: Moments, folds: list[Moments], priors: tuple[float, ...] = PRIORS, gammas: tuple[float, ...] = GAMMAS) -> list[tuple[str, float, float, float, bool]]:
    """``family``, ``parameter``, mean risk of the folds left out, conservative gain over no source, and what is chosen.

    Families: the blend with a source prior (0: no source), and for the target alone Ledoit-Wolf and ridge.  A prior is
    eligible if its mean gain over prior 0 exceeds the gain's standard error over the folds; the largest of these lower
    bounds is chosen, the smaller prior of equals, and 0 if none is eligible.  Of the target's own, the least risk is.
    """
    whole = folds[0]
    for f in folds[1:]:
        whole = whole + f
    frame = Frame.of(whole)
    s, folds, whole = frame.moments(source), [frame.moments(f) for f in folds], frame.moments(whole)
    rest = [whole - f for f in folds]
    risks = np.array([[gaussian_risk(f, (blended(s, r, prior)["b"] if prior else r.shrunk())[1]) for f, r in zip(folds, rest, strict=True)] for prior in priors])
    gain = risks[priors.index(0.0)] - risks
    lower = gain.mean(axis=1) - gain.std(axis=1, ddof=1) / math.sqrt(len(folds))
    eligible = [(-low, prior) for low, prior in zip(lower.tolist(), priors, strict=True) if prior > 0 and low > 0]
    best = min(eligible)[1] if eligible else 0.0
    out = [("blend", prior, float(r.mean()), low, prior == best) for prior, r, low in zip(priors, risks, lower.tolist(), strict=True)]
    own = [("ledoit_wolf", 0.0, float(risks[priors.index(0.0)].mean()))]
    own += [("ridge", g, float(np.mean([gaussian_risk(f, ridge(r, g)) for f, r in zip(folds, rest, strict=True)]))) for g in gammas]
    least = min(own, key=lambda x: (x[2], x[0], x[1]))
    return [*out, *((*x, 0.0, x == least) for x in own)]


def fold_of(targets: DataFrame, keys: list[str], entity: str, folds: int = FOLDS, seed: int = 42) -> DataFrame:
    """``targets`` with ``fold``: entities in the seed's order dealt out in turn, the same folds in every run."""
    rank = seeded_rank(targets.select(entity).distinct(), entity, seed).select(F.col(entity).alias("of"), ((F.col("rank") - 1) % folds).cast("int").alias("fold"))
    return targets.join(rank, F.col(entity) == F.col("of")).drop("of")


def _types(rows: DataFrame, names: list[str]) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join(f"{n} {kinds[n]}" for n in names)


def _each(rows: DataFrame, runs: list[str], found: dict[tuple, object], output: str, of: Callable[[object, tuple, np.ndarray, pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``of(found[run], run, vectors, batch)`` for the rows of each run in each batch of run keys, ``episode``, ``v``."""
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors_of(batch.column("v"))
            for key, at in _by_key(batch, len(runs)):
                if key in shared.value:
                    yield from of(shared.value[key], key, x[at], batch.take(pa.array(at)))

    return rows.select(*runs, "episode", "v").mapInArrow(work, f"{_types(rows, [*runs, 'episode'])}, {output}")


def domains(rows: DataFrame, runs: list[str]) -> dict[tuple, tuple[Moments, Moments]]:
    """Moments of source and target of each run that has both; ``rows`` have ``role``, ``v`` and the run's keys."""
    found = collected(moments(rows.where("role <> 'query'"), [*runs, "role"]), [*runs, "role"])
    return {k[:-1]: (found[*k[:-1], "source"], m) for k, m in found.items() if k[-1] == "target" and (*k[:-1], "source") in found}


def score_queries(rows: DataFrame, runs: list[str], names: list[str]) -> DataFrame:
    """``detector``, ``score`` of every query of every run, by detectors that need nothing but moments."""
    fitted = {k: {n: FITS[n](*m) for n in names} for k, m in domains(rows, runs).items()}

    def score(models: dict, key: tuple, x: np.ndarray, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for name in names:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([name] * len(x)), pa.array(scorer(models[name])(x))], names=[*batch.schema.names[:-1], "detector", "score"])

    return _each(rows.where("role = 'query'"), runs, fitted, "detector string, score double", score)


def leave_one_out(rows: DataFrame, runs: list[str], names: list[str]) -> DataFrame:
    """``detector``, ``score`` of each target episode under the detector fitted without it.

    Each row is taken out of the moments, from which frame, shrinkage and covariance follow again: as good as a refit, at a
    cost that does not depend on the number of rows.  A run needs three targets.
    """
    found = {k: m for k, m in domains(rows, runs).items() if m[1].n >= 3}

    def score(m: tuple[Moments, Moments], key: tuple, x: np.ndarray, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        s, t = m[0], m[1].about(m[1].mean)
        for name in names:
            scores = [scorer(FITS[name](s, t.without(row)))(row[None, :])[0] for row in x]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([name] * len(x)), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "detector", "score"])

    return _each(rows.where("role = 'target'"), runs, found, "detector string, score double", score)


def _frame(spark, runs: list[str], rows: DataFrame, found: dict[tuple, list[tuple]], output: str) -> DataFrame:
    """A row for each entry of each run's list: facts about runs, as many as the study's grid has."""
    return spark.createDataFrame([(*k, *r) for k, facts in found.items() for r in facts], f"{_types(rows, runs)}, {output}")


def shrinkage(rows: DataFrame, keys: list[str], vector: str = "v") -> DataFrame:
    """``n_rows``, ``trace``, ``frobenius_squared`` and ``matrix_rank`` of each group's covariance and its ``shrinkage``."""
    kinds = [rows.schema[k].dataType for k in keys]

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            for *key, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m = Moments.unpacked(data)
                cov, share = m.covariance(), m.shrunk()[2]
                w = np.linalg.eigvalsh(cov)
                rank = int((w > max(w.max(), 0.0) * len(w) * 1e-13).sum())
                values = [int(m.n), float(np.trace(cov)), float(np.square(cov).sum()), rank, share]
                types = [pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([*(pa.array([k], to_arrow_type(t)) for k, t in zip(key, kinds, strict=True)), *(pa.array([v], t) for v, t in zip(values, types, strict=True))], names=[*keys, "n_rows", "trace", "frobenius_squared", "matrix_rank", "shrinkage"])

    return moments(rows, keys, vector).mapInArrow(facts, f"{_types(rows, keys)}, n_rows long, trace double, frobenius_squared double, matrix_rank long, shrinkage double")


def covariance_distances(rows: DataFrame, runs: list[str]) -> DataFrame:
    """``metric``, ``value`` of each run: distances of the shrunk covariances of source and target."""
    cov = lambda m: L.floored(m.shrunk()[1])
    found = {k: list(L.covariance_distances(cov(s), cov(t)).items()) for k, (s, t) in domains(rows, runs).items()}
    return _frame(rows.sparkSession, runs, rows, found, "metric string, value double")


def conditioning(rows: DataFrame, runs: list[str], width: int = 0) -> DataFrame:
    """``metric``, ``value`` of each run's target: ranks, condition, how strongly its features are correlated.

    ``width``: features of one signal, which stand together; with it, correlations within signals count by themselves.
    """
    found = {k: list(covariance_conditioning(m[1], width).items()) for k, m in domains(rows, runs).items()}
    return _frame(rows.sparkSession, runs, rows, found, "metric string, value double")


def covariance_conditioning(m: Moments, width: int = 0) -> dict[str, float]:
    cov = m.covariance() * m.n / (m.n - 1)
    p, w = len(cov), np.maximum(np.linalg.eigvalsh(cov), 0)
    w = np.where(w > w.max() * p * 1e-13, w, 0.0)
    share = w[w > 0] / w.sum() if w.any() else np.zeros(0)
    shrunk, lam = m.shrunk()[1:]
    low, high = np.linalg.eigvalsh(shrunk)[[0, -1]]
    sd = np.sqrt(np.diag(cov))
    varies = sd > LEAST_VARIANCE
    r = np.abs(cov / np.outer(np.where(varies, sd, 1), np.where(varies, sd, 1)))
    i, j = np.triu_indices(p, 1)
    both = varies[i] & varies[j]
    pairs = r[i, j][both]
    out = {
        "n_rows": m.n, "rank": float((w > 0).sum()), "effective_rank": float(np.exp(-(share * np.log(share)).sum())) if share.size else 0.0, "stable_rank": float(w.sum() / w.max()) if w.any() else 0.0,
        "constant_share": float(np.mean(~varies)), "condition": float(w.max() / w[w > 0].min()) if w.any() else math.inf, "shrinkage": lam, "shrunk_least_eigenvalue": float(low), "shrunk_condition": float(high / max(low, 1e-300)),
    }
    groups = {"": pairs} | ({"within_signal_": r[i, j][both & (i // width == j // width)]} if width else {})
    for name, values in groups.items():
        out[f"{name}median_correlation"] = float(np.median(values)) if values.size else math.nan
        out |= {f"{name}share_above_0_{t}": float(np.mean(values >= t / 100)) if values.size else 0.0 for t in (90, 95, 99)}
    return out


def risk_index(rows: DataFrame, runs: list[str], replicates: int = 50, seed: int = 42) -> DataFrame:
    """``metric``, ``value`` of each run: the source's distance against how uncertain the target's covariance is.

    The uncertainty is the mean squared distance of resamples' shrunk covariances from the target's: by Poisson counts,
    which add up over tasks as the moments do, and by leaving out each row, whose distances add up too.
    """
    both = domains(rows, runs)
    target = rows.where("role = 'target'")
    drawn = collected(moments(target, runs, replicates=replicates, entity="episode", seed=seed), [*runs, "replicate"])

    def left_out(m: Moments, key: tuple, x: np.ndarray, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, t = m.shrunk()[1], m.about(m.mean)
        away = [float(np.square(t.without(row).shrunk()[1] - own).sum()) for row in x]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(away, pa.float64())], names=[*batch.schema.names[:-1], "away"])

    jackknife = {tuple(r[k] for k in runs): r["away"] for r in _each(target, runs, {k: m[1] for k, m in both.items() if m[1].n > 2}, "away double", left_out).groupBy(*runs).agg(F.avg("away").alias("away")).collect()}
    found = {}
    for k, (s, t) in both.items():
        own, norm = t.shrunk()[1], None
        norm = float(np.square(own).sum())
        covs = [drawn[*k, r].shrunk()[1] for r in range(1, replicates + 1) if (*k, r) in drawn and drawn[*k, r].n > 1]
        uncertain, apart = float(np.mean([np.square(c - own).sum() for c in covs])), float(np.square(s.shrunk()[1] - own).sum())
        grid = np.linspace(0, 1, 101)
        gap = s.shrunk()[1] - own
        # The mean squared distance of own + w gap from the resamples is a parabola in w.
        cross = float(np.mean([np.sum(gap * (own - c)) for c in covs]))
        risk = uncertain + 2 * grid * cross + grid**2 * apart
        found[k] = [("uncertainty_bootstrap", uncertain), ("uncertainty_jackknife", jackknife.get(k, math.nan)), ("discrepancy", apart), ("uncertainty_normalized", uncertain / norm), ("discrepancy_normalized", apart / norm),
                    ("risk_index", apart / uncertain if uncertain > 0 else math.inf), ("best_weight", float(grid[risk.argmin()])), ("best_risk", float(risk.min()))]
    return _frame(rows.sparkSession, runs, rows, found, "metric string, value double")


def covariance_choices(rows: DataFrame, runs: list[str], folds: int = FOLDS, seed: int = 42) -> DataFrame:
    """:func:`covariance_family` of each run that has a source and a row in every fold."""
    source = collected(moments(rows.where("role = 'source'"), runs), runs)
    parts = collected(moments(fold_of(rows.where("role = 'target'"), runs, "episode", folds, seed), [*runs, "fold"]), [*runs, "fold"])
    found = {k: covariance_family(s, [parts[*k, f] for f in range(folds)]) for k, s in source.items() if all(parts.get((*k, f)) is not None and parts[*k, f].n > 1 for f in range(folds))}
    return _frame(rows.sparkSession, runs, rows, found, "family string, parameter double, risk double, lower_gain double, chosen boolean")


def strongest_contributions(rows: DataFrame, runs: list[str], most: int) -> DataFrame:
    """The ``most`` features with the largest parts of each query's squared distance from the target, and the distance."""
    targets = collected(moments(rows.where("role = 'target'"), runs), runs)
    fitted = {}
    for k, m in targets.items():
        frame = Frame.of(m)
        mean, cov, _ = frame.moments(m).shrunk()
        fitted[k] = frame, mean, np.linalg.pinv(cov, hermitian=True)

    def parts_of(model: tuple, key: tuple, x: np.ndarray, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        frame, mean, precision = model
        parts = L.contributions(frame.rows(x), mean, precision)
        top = np.argsort(-parts, axis=1, kind="stable")[:, :most]
        n, k = top.shape
        again = batch.take(pa.array(np.repeat(np.arange(n), k)))
        columns = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.flatnonzero(frame.use)[top].ravel().astype(np.int32)), pa.array(np.take_along_axis(parts, top, axis=1).ravel()), pa.array(np.repeat(parts.sum(axis=1), k))]
        yield pa.RecordBatch.from_arrays([*again.columns[:-1], *columns], names=[*batch.schema.names[:-1], "place", "feature", "contribution", "squared"])

    return _each(rows.where("role = 'query'"), runs, fitted, "place int, feature int, contribution double, squared double", parts_of)


# -- where a blend changes the scores ------------------------------------------------------------------------------------


def directional_parts(s: Moments, t: Moments, x: np.ndarray) -> np.ndarray:
    """By how much the blend changes each row's squared distance along each of the target's eigenvectors, largest first.

    A quadratic form y'Py is the sum over the vectors v of an orthonormal basis of (v'y)(v'Py), so the parts add up to the
    difference of the two squared distances exactly.
    """
    frame = Frame.of(s + t)
    parts = blended(frame.moments(s), frame.moments(t))
    vectors = np.linalg.eigh(parts["t"][1])[1][:, ::-1]
    z = frame.rows(x)
    out = 0.0
    for sign, which in ((1, "b"), (-1, "t")):
        mean, cov = parts[which]
        y = z - mean
        out = out + sign * (y @ vectors) * (y @ np.linalg.pinv(L.floored(cov), hermitian=True) @ vectors)
    return out


def directional_audit(rows: DataFrame, runs: list[str], kind: str) -> DataFrame:
    """For each run and eigenvector of the target: what both domains have there, and how the blend changes scores by it.

    ``rows`` have ``kind`` beside role, episode and v; the mean change is given for each kind of query row.
    """
    both = domains(rows, runs)
    facts = {}
    for k, (s, t) in both.items():
        frame = Frame.of(s + t)
        parts = blended(frame.moments(s), frame.moments(t))
        (w, v), u = np.linalg.eigh(parts["t"][1]), np.linalg.eigh(parts["s"][1])[1]
        order = np.argsort(-w, kind="stable")
        for place, j in enumerate(order):
            along = lambda cov, j=j, v=v: float(v[:, j] @ cov @ v[:, j])
            own, lent, cosine = max(float(w[j]), 1e-12), along(parts["s"][1]), float(np.square(u.T @ v[:, j]).max())
            agreement = math.exp(-abs(math.log((lent + 1e-12) / (own + 1e-12))))
            facts.setdefault(k, []).append((place, own, lent, along(parts["b"][1]), cosine, agreement, cosine * agreement, float((parts["b"][0] - parts["t"][0]) @ v[:, j])))

    shared = rows.sparkSession.sparkContext.broadcast(both)
    queries = rows.where("role = 'query'").select(*runs, F.col(kind).alias("kind"), "v")

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            x = vectors_of(batch.column("v"))
            for key, at in _by_key(batch, len(runs) + 1):
                if key[:-1] in shared.value:
                    parts = directional_parts(*shared.value[key[:-1]], x[at])
                    n, total, size = held.get(key, (0, 0.0, 0.0))
                    held[key] = (n + len(at), total + parts.sum(axis=0), size + np.abs(parts).sum(axis=0))
        for key, (n, total, size) in held.items():
            p = len(total)
            yield pa.RecordBatch.from_arrays([*(pa.array([k] * p, c) for k, c in zip(key, batch.schema.types, strict=False)), pa.array(range(p), pa.int32()), pa.array([n] * p, pa.int64()), pa.array(total), pa.array(size)], names=[*runs, "kind", "direction", "n_held", "total", "size"])

    sums = queries.mapInArrow(change, f"{_types(rows, runs)}, kind {dict(rows.dtypes)[kind]}, direction int, n_held long, total double, size double")
    means = sums.groupBy(*runs, "kind", "direction").agg(F.sum("n_held").alias("n_rows"), (F.sum("total") / F.sum("n_held")).alias("change"), (F.sum("size") / F.sum("n_held")).alias("absolute_change"))
    about = _frame(rows.sparkSession, runs, rows, facts, "direction int, target_variance double, source_variance double, blended_variance double, alignment double, variance_agreement double, compatibility double, mean_shift double")
    return means.join(F.broadcast(about), [*runs, "direction"])
