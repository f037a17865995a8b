"""Detectors that need a run's whole matrix: each run is one group of an Arrow-backed pandas function.

A run's rows have ``role`` source, target (commissioning) or query, an ``episode`` and a vector ``v``; a run's source and
target hold at most a few thousand episodes by design of the study, so a group is a few megabytes whatever the telemetry's
size.  Every detector is fitted on (source, target) matrices once for each run; what it returns scores any number of
queries, each by itself; larger is more anomalous.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import linalg as L
from ..functions.lineage import cut

Scorer = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
Fitted = Callable[[np.ndarray], np.ndarray]
Fit = Callable[[np.ndarray, np.ndarray], Fitted]
SCORERS: dict[str, Scorer] = {}
FITS: dict[str, Fit] = {}


def register_detector(name: str, scorer: Scorer | None = None):
    """Add a scorer of (source, target, query) to the registry; usable as a decorator.  It is fitted anew for each use."""
    if scorer is None:
        return lambda f: register_detector(name, f)
    SCORERS[name], FITS[name] = scorer, lambda s, t: lambda q: scorer(s, t, q)
    return scorer


def register_fit(name: str, fit: Fit | None = None):
    """Add a detector that is fitted once on (source, target) and returns the function of its queries' scores."""
    if fit is None:
        return lambda f: register_fit(name, f)
    SCORERS[name], FITS[name] = lambda s, t, q: fit(s, t)(q), fit
    return fit


def standardizer(training: np.ndarray, threshold: float = 1e-12) -> Fitted:
    """Takes the columns that vary in training and standardizes them by its population moments."""
    use = training.var(axis=0) > threshold
    if not use.any():
        raise ValueError("no feature varies in the training rows")
    mean, std = training[:, use].mean(axis=0), training[:, use].std(axis=0)
    return lambda x: (x[:, use] - mean) / std


def standardized(training: np.ndarray, *others: np.ndarray, threshold: float = 1e-12) -> list[np.ndarray]:
    """Columns that vary in training, standardized by its population moments."""
    z = standardizer(training, threshold)
    return [z(x) for x in (training, *others)]


def _distance(z: Fitted, mean: np.ndarray, cov: np.ndarray) -> Fitted:
    """Mahalanobis distance of standardized queries."""
    inverse = np.linalg.pinv(cov, hermitian=True)
    return lambda q: L.mahalanobis(z(q), mean, inverse)


def _gaussian(training: np.ndarray) -> Fitted:
    z = standardizer(training)
    mean, cov, _ = L.shrunk_covariance(z(training))
    return _distance(z, mean, cov)


register_fit("TargetOnly", lambda s, t: _gaussian(t))
register_fit("SourceOnly", lambda s, t: _gaussian(s))
register_fit("Pooled", lambda s, t: _gaussian(np.vstack([s, t])))

#: Which mean and covariance each ablation takes: t(arget), s(ource) or b(lend).
COMPONENTS = {"Blended": "bb", "MeanTransferOnly": "bt", "CovarianceTransferOnly": "tb", "TargetMeanSourceCovariance": "ts", "SourceMeanTargetCovariance": "st"}


def blended(source: np.ndarray, target: np.ndarray, prior: float = 60.0) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Shrunk moments of both domains and their blend with target weight n / (n + prior)."""
    (ms, cs, _), (mt, ct, _) = L.shrunk_covariance(source), L.shrunk_covariance(target)
    w = len(target) / (len(target) + prior)
    return {"s": (ms, cs), "t": (mt, ct), "b": ((1 - w) * ms + w * mt, (1 - w) * cs + w * ct)}


def _component(choice: str) -> Fit:
    def fit(s: np.ndarray, t: np.ndarray) -> Fitted:
        z = standardizer(np.vstack([s, t]))
        parts = blended(z(s), z(t))
        return _distance(z, parts[choice[0]][0], L.floored(parts[choice[1]][1]))

    return fit


for _name, _choice in COMPONENTS.items():
    register_fit(_name, _component(_choice))


def _swapped(values: str) -> Fit:
    """Target mean with one domain's eigenvalues and the other's eigenvectors."""

    def fit(s: np.ndarray, t: np.ndarray) -> Fitted:
        z = standardizer(np.vstack([s, t]))
        parts = blended(z(s), z(t))
        eigen = {k: np.linalg.eigh(parts[k][1]) for k in "st"}
        vectors = eigen["t" if values == "s" else "s"][1]
        return _distance(z, parts["t"][0], L.floored((vectors * eigen[values][0]) @ vectors.T))

    return fit


register_fit("EigenvectorsOnly", _swapped("t"))
register_fit("EigenvaluesOnly", _swapped("s"))


def safe_transfer_weight(source: np.ndarray, target: np.ndarray, priors: tuple[float, ...] = (0, 5, 10, 20, 60), folds: int = 5, seed: int = 42) -> float:
    """Source prior whose cross-validated improvement over none exceeds its standard error, else 0."""
    order = np.random.RandomState(seed).permutation(len(target))
    parts = np.array_split(order, min(folds, len(target)))
    risks = np.array([
        [L.gaussian_risk(target[part], np.linalg.pinv(L.floored(blended(source, np.delete(target, part, axis=0), prior)["b"][1]), hermitian=True)) for part in parts] for prior in priors
    ])
    gain = risks[0] - risks
    lower = gain.mean(axis=1) - gain.std(axis=1, ddof=1) / np.sqrt(len(parts))
    best = max(range(len(priors)), key=lambda i: (lower[i] if priors[i] > 0 and lower[i] > 0 else 0.0, -priors[i]))
    return float(priors[best])


@register_fit("SafeTransfer")
def _safe(s: np.ndarray, t: np.ndarray) -> Fitted:
    z = standardizer(t)
    t0, s0 = z(t), z(s)
    return _distance(z, t0.mean(axis=0), L.floored(blended(s0, t0, safe_transfer_weight(s0, t0))["b"][1]))


def _principal(share: float) -> Fit:
    """Mahalanobis distance within the components that explain ``share`` of the target's variance."""

    def fit(s: np.ndarray, t: np.ndarray) -> Fitted:
        z = standardizer(t)
        t = z(t)
        _, w, v = np.linalg.svd(t - t.mean(axis=0), full_matrices=False)
        basis = v[: int(np.searchsorted(np.cumsum(w**2) / (w**2).sum(), share) + 1)].T.copy()
        inner = _gaussian(t @ basis)
        return lambda q: inner(z(q) @ basis)

    return fit


register_fit("Principal95", _principal(0.95))
register_fit("Principal99", _principal(0.99))


def _bounded(clip: float, whiten: bool = True) -> Fit:
    """Norm of robust z, clipped, whitened by the target's shrunk covariance and clipped again."""

    def fit(s: np.ndarray, t: np.ndarray) -> Fitted:
        center, scale = np.median(t, axis=0), 1.4826 * np.median(np.abs(t - np.median(t, axis=0)), axis=0)
        use = scale > 1e-12
        z = lambda x: np.clip((x[:, use] - center[use]) / scale[use], -clip, clip)
        if not whiten:
            return lambda q: np.linalg.norm(z(q), axis=1)
        mean, cov, _ = L.shrunk_covariance(z(t))
        whitener = L.power(L.floored(cov), lambda w: w**-0.5)
        return lambda q: np.linalg.norm(np.clip((z(q) - mean) @ whitener, -clip, clip), axis=1)

    return fit


for _clip in (2.5, 3.0, 4.0):
    _suffix = "" if _clip == 3.0 else f"{_clip:g}".replace(".", "_")
    register_fit(f"BoundedWhitening{_suffix}", _bounded(_clip))
    register_fit(f"BoundedDiagonal{_suffix}", _bounded(_clip, whiten=False))

#: Distances that the nearest neighbours hold at once.
HELD_DISTANCES = 1 << 21


def _neighbours(k: int) -> Fit:
    def fit(s: np.ndarray, t: np.ndarray) -> Fitted:
        z = standardizer(t)
        t = z(t)
        squares, place, step = (t**2).sum(1)[None, :], min(k, len(t)) - 1, max(1, HELD_DISTANCES // len(t))

        def score(q: np.ndarray) -> np.ndarray:
            out = np.empty(len(q))
            for at in range(0, len(q), step):
                x = z(q[at : at + step])
                d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + squares - 2 * x @ t.T, 0.0))
                out[at : at + step] = np.partition(d, place, axis=1)[:, place]
            return out

        return score

    return fit


register_fit("NearestNeighbours", _neighbours(10))


@register_fit("IsolationForest")
def _isolation(s: np.ndarray, t: np.ndarray) -> Fitted:
    forest = L.isolation_forest(t, 500, 42)
    return lambda q: L.forest_scores(forest, q)


def _aligned(mode: str, modes: int = 16, strength: float = 0.25, beta: float = 0.5) -> Fit:
    """Energy along principal vectors that both domains share, weighted by cos2 / (cos2 + strength), beside the
    energy of the target's own modes and of what is orthogonal to them."""

    def fit(s: np.ndarray, t: np.ndarray) -> Fitted:
        center, scale = L.robust_frame(t)
        of = lambda x, c: np.clip((x - c) / scale, -8, 8)
        y, z = of(t, center), of(s, np.median(s, axis=0))
        k = max(1, min(modes, len(t) - 2, t.shape[1], len(s) - 1))
        basis = L.principal_basis(y, k)
        if mode == "aligned":
            _, cosine, right = np.linalg.svd(L.principal_basis(z, k).T @ basis, full_matrices=False)
            basis = basis @ right.T
            weight = np.clip(cosine, 0, 1) ** 2 / (np.clip(cosine, 0, 1) ** 2 + strength)
        else:
            basis = L.principal_basis(z, k) if mode == "source" else basis
            weight = np.ones(k) if mode != "target_only" else np.zeros(k)
        frame = lambda v: (np.median(v, axis=0), np.maximum((1.4826 * np.median(np.abs(v - np.median(v, axis=0)), axis=0)) ** 2, 1e-8))
        (mi, vi), (mo, vo) = frame(y @ basis), frame(y - y @ basis @ basis.T)

        def score(q: np.ndarray) -> np.ndarray:
            x = of(q, center)
            energy, rest = (x @ basis - mi) ** 2 / vi, ((x - x @ basis @ basis.T - mo) ** 2 / vo).mean(axis=1)
            shared = energy @ weight / (weight.sum() + 1e-8)
            own = energy @ (1 - weight) / ((1 - weight).sum() + 1e-8)
            if mode == "target_only":
                return 0.5 * energy.mean(axis=1) + 0.5 * rest
            return beta * shared + (1 - beta) * (0.5 * own + 0.5 * rest)

        return score

    return fit


for _mode, _name in (("aligned", "AlignedSubspace"), ("target_only", "AlignedTargetOnly"), ("target", "TargetSubspace"), ("source", "SourceSubspace")):
    register_fit(_name, _aligned(_mode))


def _matrices(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    rows = rows.sort_values("episode", kind="stable")
    return {r: np.array(part["v"].tolist(), float) for r, part in rows.groupby("role")}


def run_scores(rows: DataFrame, runs: list[str], names: list[str]) -> DataFrame:
    """Scores of every named detector for every run's queries: ``detector``, run keys, ``episode``, ``score``."""
    schema = ", ".join([f"{k} {t}" for k, t in rows.select(*runs).dtypes] + ["detector string", f"episode {dict(rows.dtypes)['episode']}", "score double"])

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        m = _matrices(part)
        ids = part[part["role"] == "query"].sort_values("episode", kind="stable")["episode"].to_numpy()
        out = [pd.DataFrame({**dict(zip(runs, key, strict=True)), "detector": n, "episode": ids, "score": SCORERS[n](m["source"], m["target"], m["query"])}) for n in names] if {"source", "target", "query"} <= m.keys() else []
        return pd.concat(out) if out else pd.DataFrame(columns=[*runs, "detector", "episode", "score"])

    return rows.groupBy(*runs).applyInPandas(fit, schema)


#: Parts into which a run's detectors are dealt for fitting, and the tasks that fit.
FIT_PARTS, FIT_TASKS = 8, 64


def score_queries(rows: DataFrame, runs: list[str], names: list[str], size: int) -> DataFrame:
    """As :func:`run_scores`, but each run is fitted once and some ``size`` query episodes are scored in one task.

    What was fitted comes to the driver, a few megabytes for each run, and goes to every executor once.
    """
    fits = {n: FITS[n] for n in names}
    queries = rows.where("role = 'query'")

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        m = _matrices(part)
        mine = names[key[-1] :: FIT_PARTS] if {"source", "target"} <= m.keys() else []
        models = [cloudpickle.dumps({n: fits[n](m["source"], m["target"]) for n in mine})] if mine else []
        return pd.DataFrame({**{k: [v] * len(models) for k, v in zip(runs, key, strict=False)}, "models": models})

    kinds = ", ".join(f"{k} {t}" for k, t in rows.select(*runs).dtypes)
    asked = rows.where("role <> 'query'").join(queries.select(*runs).distinct(), runs, "left_semi")
    # Detectors that leave out each row in turn take as long as all others: every part of a run is a task of its own.
    parts = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(min(FIT_PARTS, len(names)) - 1))).alias("fit_part")).repartition(FIT_TASKS, *runs, "fit_part")
    models: dict[tuple, list[bytes]] = {}
    for r in parts.groupBy(*runs, "fit_part").applyInPandas(fit, f"{kinds}, models binary").collect():
        models.setdefault(tuple(r[k] for k in runs), []).append(bytes(r["models"]))
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = {}
        for batch in batches:
            keys = np.empty(batch.num_rows, object)
            keys[:] = list(zip(*(batch.column(k).to_pylist() for k in range(len(runs))), strict=True))
            sizes = set(batch.column(len(runs) + 1).value_lengths().to_pylist())
            if len(sizes) > 1 or None in sizes:
                raise ValueError("a query's vector is null or not as long as others")
            vectors = batch.column(len(runs) + 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
            for key in dict.fromkeys(keys):
                if key not in shared.value:
                    continue
                if key not in fitted:
                    fitted[key] = {n: f for part in shared.value[key] for n, f in pickle.loads(part).items()}
                mine = np.flatnonzero([k == key for k in keys])
                of_run = batch.take(pa.array(mine))
                for name, scorer in fitted[key].items():
                    found = scorer(vectors[mine])
                    yield pa.RecordBatch.from_arrays([*of_run.columns[: len(runs)], pa.array([name] * len(mine)), of_run.column(len(runs)), pa.array(found, pa.float64())], names=[*runs, "detector", "episode", "score"])

    n = max(1, -(-queries.select("episode").distinct().count() // size))
    schema = f"{kinds}, detector string, episode {dict(rows.dtypes)['episode']}, score double"
    return queries.select(*runs, "episode", "v").repartition(n, "episode").mapInArrow(score, schema)


def healthy_contexts(rows: DataFrame, runs: list[str], k: int) -> DataFrame:
    """``context`` of each target episode: k-means over the run's standardized healthy rows, largest cluster first."""
    schema = ", ".join([f"{c} {t}" for c, t in rows.select(*runs).dtypes] + [f"episode {dict(rows.dtypes)['episode']}", "context int"])

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("episode", kind="stable")
        x = np.array(part["v"].tolist(), float)
        labels, _ = L.clusters(standardized(x)[0], k)
        return pd.DataFrame({**dict(zip(runs, key, strict=True)), "episode": part["episode"].to_numpy(), "context": labels})

    return rows.where("role = 'target'").groupBy(*runs).applyInPandas(fit, schema)


def precision_supports(rows: DataFrame, runs: list[str], penalty: float) -> DataFrame:
    """``metric``, ``value`` for each run: edges of the graphical lasso and of CLIME over its healthy rows, and their overlap."""
    schema = ", ".join([f"{c} {t}" for c, t in rows.select(*runs).dtypes] + ["metric string, value double"])

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = standardized(np.array(part.sort_values("episode", kind="stable")["v"].tolist(), float))[0]
        cov = L.shrunk_covariance(x)[1]
        lasso, clime = L.sparse_precision(cov, penalty), L.constrained_precision(cov, penalty)
        shared = L.support_metrics(clime, np.where(np.abs(lasso) > 1e-3, lasso, 0))
        found = {"lasso_edges": L.support_metrics(lasso, lasso)["edges"], "clime_edges": shared["edges"], "shared_f1": shared["edge_f1"], "lasso_risk": L.gaussian_risk(x, lasso)}
        return pd.DataFrame({**dict(zip(runs, key, strict=True)), "metric": list(found), "value": list(found.values())})

    return rows.where("role = 'target'").groupBy(*runs).applyInPandas(fit, schema)


def stable_graph(rows: DataFrame, runs: list[str], penalties: tuple[float, ...]) -> DataFrame:
    """``a`` < ``b``, ``stability`` and ``penalty`` of the edges that each run's healthy rows hold under resampling."""
    schema = ", ".join([f"{c} {t}" for c, t in rows.select(*runs).dtypes] + ["a int, b int, stability double, penalty double"])

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = standardized(np.array(part.sort_values("episode", kind="stable")["v"].tolist(), float))[0]
        penalty, often = L.stable_edges(x, penalties)
        a, b = np.nonzero(np.triu(often, 1))
        return pd.DataFrame({**dict(zip(runs, key, strict=True)), "a": a, "b": b, "stability": often[a, b], "penalty": penalty})

    return rows.where("role = 'target'").groupBy(*runs).applyInPandas(fit, schema)


def batched(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with ``batch``: about ``size`` query episodes in each, and the other roles' rows in every one."""
    queries = rows.where("role = 'query'").select("episode").distinct().count()
    n = max(1, -(-queries // size))
    fixed = rows.where("role <> 'query'").withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return fixed.unionByName(rows.where("role = 'query'").withColumn("batch", F.pmod(F.xxhash64("episode"), F.lit(n)).cast("int")))


#: Bytes of the runs' first episodes, and of their targets' profiles, that go to every executor.
MOST_SHARED = 128 << 20


def _shared_rows(df: DataFrame, runs: list[str], value: str) -> dict[tuple, list]:
    """``value`` (an array of doubles) of every row by run; an error if they are too large to be shared."""
    size = df.agg(F.sum(F.size(value))).first()[0] or 0
    if 8 * size > MOST_SHARED:
        raise ValueError(f"{8 * size} bytes to share with every executor, more than {MOST_SHARED}")
    out: dict[tuple, list] = {}
    for r in df.sort(*runs).collect():
        out.setdefault(tuple(r[k] for k in runs), []).append(np.array(r[value], float))
    return out


#: Series that one task warps onto the references of their runs.
SERIES = 4096


def _nearest(targets: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Distance of each query from its k-th nearest target."""
    place, step = min(k, len(targets)) - 1, max(1, HELD_DISTANCES // targets.size)
    parts = [np.sqrt(np.square(targets - queries[at : at + step, None]).sum(axis=2)) for at in range(0, len(queries), step)]
    return np.concatenate([np.partition(d, place, axis=1)[:, place] for d in parts])


def aligned_phase_scores(telemetry: DataFrame, roles: DataFrame, runs: list[str], bins: int = 128, radius: int = 2, k: int = 10) -> DataFrame:
    """k-NN on phase profiles: each query is warped onto the run's first commissioning episode and resampled.

    ``telemetry`` has ``episode``, ``at`` (order) and a vector ``v`` for each row; ``roles`` has each run's target and query
    episodes.  An episode's series is put together once, however many runs ask for it, and a task warps the series of equal
    length onto a run's reference together.  The run's frame comes from its episodes' sums; its targets' series and profiles, which its
    commissioning size bounds, are shared after a check of their size.
    """
    context = telemetry.sparkSession.sparkContext
    kinds = ", ".join(f"{c} {t}" for c, t in roles.select(*runs).dtypes)
    episode = f"episode {dict(roles.dtypes)['episode']}"
    rows = telemetry.join(roles.select("episode").distinct(), "episode", "left_semi").groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("rows"))
    series = cut(rows.select("episode", F.size("rows").alias("n"), F.flatten(F.transform("rows", lambda x: x["v"])).alias("rows")))
    targets = cut(series.join(F.broadcast(roles.where("role = 'target'").select(*runs, "episode")), "episode"))
    # Warping breaks ties by the last bits: each episode sums in its order, and the run's sum of these is exact in any order.
    channels = targets.select(*runs, "n", "rows", F.explode(F.expr("sequence(0, size(rows) div n - 1)")).alias("channel"))
    values = channels.select(*runs, "channel", F.expr("filter(rows, (x, i) -> i % (size(rows) div n) = channel and x is not null)").alias("x")).where("size(x) > 0")
    sums = values.select(*runs, "channel", F.size("x").alias("n"), F.expr("aggregate(x, 0D, (a, y) -> a + y)").alias("total"), "x")
    parts: dict[tuple, list] = {}
    for r in sums.select(*runs, "channel", "n", "total", F.expr("aggregate(x, 0D, (a, y) -> a + (y - total / n) * (y - total / n))").alias("squares")).collect():
        parts.setdefault((*(r[c] for c in runs), r["channel"]), []).append((r["n"], r["total"], r["squares"]))
    frames: dict[tuple, list] = {}
    for (*run, _), found in sorted(parts.items(), key=lambda part: part[0][-1]):
        n = sum(k for k, _, _ in found)
        mean = math.fsum(total for _, total, _ in found) / n
        std = math.sqrt(math.fsum(squares + k * (total / k - mean) ** 2 for k, total, squares in found) / n)
        frames.setdefault(tuple(run), []).append((mean, std if std > 1e-12 else 1.0))
    first = targets.groupBy(*runs).agg(F.min_by("rows", "episode").alias("rows"))
    references = {run: (found[0].reshape(-1, len(frames[run])) - np.array(frames[run])[:, 0]) / np.array(frames[run])[:, 1] for run, found in _shared_rows(first, runs, "rows").items()}
    shared = context.broadcast((frames, references))

    def profiles(run: tuple, lengths: np.ndarray, start: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Of the series at ``start`` in ``values``: channel after channel, the places of each."""
        mean, std = np.array(shared.value[0][run]).T
        out = np.empty((len(lengths), bins * len(mean)))
        for n in np.unique(lengths):
            mine = np.flatnonzero(lengths == n)
            v = values[start[mine][:, None] + np.arange(n * len(mean))].reshape(len(mine), n, -1)
            out[mine] = L.resampled(L.warped_all((v - mean) / std, shared.value[1][run], radius), bins).transpose(0, 2, 1).reshape(len(mine), -1)
        return out

    def each_run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Array, np.ndarray]]:
        """Runs' parts of the batches, in which an episode has a list of runs: run, episodes, profiles."""
        for batch in batches:
            lengths, asked, rows = batch.column(1).to_numpy(), batch.column(3), batch.column(2)
            values, end = rows.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(rows.value_lengths().to_numpy())
            start, of = np.append(0, end)[:-1], np.repeat(np.arange(batch.num_rows), asked.value_lengths().to_numpy())
            numbers = {run: i for i, run in enumerate(shared.value[1])}
            which = np.array([numbers.get(run, -1) for run in zip(*(c.to_pylist() for c in asked.flatten().flatten()), strict=True)], int)
            for run, i in numbers.items():
                mine = of[which == i]
                if len(mine):
                    yield run, batch.column(0).take(pa.array(mine)), profiles(run, lengths[mine], start[mine], values)

    def keyed(run: tuple, episodes: pa.Array) -> list[pa.Array]:
        return [*(pa.array([x] * len(episodes), t) for x, t in zip(run, key_types, strict=True)), episodes]

    def asked_by(role: str) -> DataFrame:
        wanted = roles.where(F.col("role") == role).groupBy("episode").agg(F.collect_list(F.struct(*runs)).alias("asked"))
        tasks = max(context.defaultParallelism, -(-wanted.count() // SERIES))
        # Series of about equal length meet in a task, and those of a frequent length are spread.
        return series.join(wanted, "episode").select("episode", "n", "rows", "asked").repartitionByRange(tasks, "n", "episode").sortWithinPartitions("n")

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, episodes, found in each_run(batches):
            columns = [*keyed(run, episodes), pa.array(list(found), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*runs, "episode", "profile"])

    key_types = [to_arrow_type(roles.schema[c].dataType) for c in runs]
    found = cut(asked_by("target").mapInArrow(profile, f"{kinds}, {episode}, profile array<double>"))
    healthy = context.broadcast({run: np.stack(found) for run, found in _shared_rows(found, runs, "profile").items()})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, episodes, found in each_run(batches):
            yield pa.RecordBatch.from_arrays([*keyed(run, episodes), pa.array(_nearest(healthy.value[run], found, k), pa.float64())], names=[*runs, "episode", "score"])

    return asked_by("query").mapInArrow(score, f"{kinds}, {episode}, score double")
