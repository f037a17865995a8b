"""How far two healthy domains are apart, for runs of any size: kernel discrepancy by tiles, the rest by moments.

A run's rows are dealt into some ``PARTS`` blocks (more where they would have more than ``MOST_ROWS`` rows); a task gets one
pair of blocks, goes through it in tiles of ``BLOCK`` rows a side and returns sums, so that no task holds a run and no matrix
of all pairs exists.  Each row is sent to as many tasks as there are blocks: what is shuffled grows like the rows.  The bandwidth is the exact median of all positive squared distances, found
by radix selection: a positive double's bits order as it does, each pass counts the tiles' distances by the next bits of
those that share the median's leading bits.  All runs are selected at once; the driver gets a row for each occupied range.

Every row meets every other one, as the statistic asks: the work is quadratic in a run, the memory is not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..functions.lineage import cut
from .moments import Moments, _frame, _types, collected, moments
from .order import quantiles

BLOCK = 1024
#: Blocks that a run is dealt into, and the most rows that a block shall have.
PARTS, MOST_ROWS = 8, 32_768
#: Bits by which each pass of the selection tells distances apart, all 64 of a double together.
PASSES = (20, 14, 14, 16)
CLIP, MODES, LEAST_SCALE = 8.0, 16, 1e-6
MAD_SCALE = 1.4826


def robust_units(rows: DataFrame, runs: list[str]) -> DataFrame:
    """``v`` of source and target rows about their own domain's medians, in the target's robust scale, clipped.

    A scale is 1.4826 median absolute deviations; one that vanishes takes the median of the run's others.
    """
    long = cut(rows.where("role <> 'query'").select(*runs, "role", "episode", F.posexplode("v").alias("place", "x")))
    at = [*runs, "role", "place"]
    centers = cut(quantiles(long, at, "x", {"center": 0.5}))
    named = centers.select(*[F.col(c).alias(f"c_{c}") for c in at], "center")
    about = long.join(F.broadcast(named), [F.col(c) == F.col(f"c_{c}") for c in at]).withColumn("d", F.abs(F.col("x") - F.col("center")))
    mads = cut(quantiles(about.where("role = 'target'"), [*runs, "place"], "d", {"mad": 0.5}))
    scales = mads.select(*runs, "place", (F.col("mad") * MAD_SCALE).alias("scale"))
    usual = scales.where(F.col("scale") > LEAST_SCALE).groupBy(*runs).agg(F.percentile("scale", 0.5).alias("usual"))
    scales = scales.join(usual, runs, "left").select(*runs, "place", F.when(F.col("scale") > LEAST_SCALE, F.col("scale")).otherwise(F.greatest(F.coalesce("usual", F.lit(1.0)), F.lit(LEAST_SCALE))).alias("scale"))
    # Medians and scales have a row for each run and feature, whatever the rows: they become an array for each run.
    lists = named.groupBy(*[f"c_{c}" for c in [*runs, "role"]]).agg(F.array_sort(F.collect_list(F.struct(F.col("c_place").alias("place"), F.col("center").alias("x")))).alias("centers"))
    sizes = scales.groupBy(*[F.col(c).alias(f"s_{c}") for c in runs]).agg(F.array_sort(F.collect_list(F.struct("place", F.col("scale").alias("x")))).alias("scales"))
    both = rows.where("role <> 'query'").join(F.broadcast(lists), [F.col(c) == F.col(f"c_{c}") for c in [*runs, "role"]]).join(F.broadcast(sizes), [F.col(c) == F.col(f"s_{c}") for c in runs])
    unit = lambda x, i: F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), (x - F.col("centers")[i]["x"]) / F.col("scales")[i]["x"]))
    return both.select(*runs, "role", "episode", F.transform("v", unit).alias("v"))


def tiles(rows: DataFrame, runs: list[str], block: int = BLOCK) -> tuple[DataFrame, dict[tuple, dict[str, int]]]:
    """``first``, ``second``, ``number``, ``role``, ``flat`` (a block's vectors) for each pair of blocks, and the runs' sizes."""
    counts: dict[tuple, dict[str, int]] = {}
    found = rows.groupBy(*runs, "role").agg(F.count(F.lit(1)).alias("n_rows"))
    for r in found.collect():
        counts.setdefault(tuple(r[k] for k in runs), {"source": 0, "target": 0})[r["role"]] = r["n_rows"]
    edge = {k: max(block, min(-(-sum(c.values()) // PARTS), MOST_ROWS)) for k, c in counts.items()}
    blocks = {k: {role: -(-n // edge[k]) for role, n in c.items()} for k, c in counts.items()}
    numbers = rows.sparkSession.createDataFrame([(*k, role, b[role], b["source"] * (role == "target"), sum(b.values())) for k, b in blocks.items() for role in b], f"{_types(rows, runs)}, role string, own long, before long, all_blocks long")
    placed = rows.join(F.broadcast(numbers), [*runs, "role"]).withColumn("number", (F.col("before") + F.pmod(F.xxhash64("episode"), F.col("own"))).cast("int"))
    held = cut(placed.groupBy(*runs, "role", "number", "all_blocks").agg(F.flatten(F.collect_list("v")).alias("flat")))
    other = held.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all_blocks") - 1)).alias("other"))
    return other.select(*runs, F.least("number", "other").cast("int").alias("first"), F.greatest("number", "other").cast("int").alias("second"), "number", "role", "flat"), counts


def _pair(part: pa.Table, width: int, block: int) -> tuple[str, str, bool, Iterator[tuple[bool, np.ndarray]]]:
    """Roles of a pair of blocks and its tiles of squared distances; of a block with itself only those up to the diagonal.

    Beside each tile stands whether it is on that diagonal, where a distance below it has a double above.
    """
    order = np.argsort(part.column("number").to_numpy())
    x = [np.array(part.column("flat")[int(i)].values.to_numpy(zero_copy_only=False)).reshape(-1, width) for i in order]
    roles = [part.column("role")[int(i)].as_py() for i in order]
    alone = len(x) == 1

    def tiled() -> Iterator[tuple[bool, np.ndarray]]:
        for i in range(0, len(x[0]), block):
            for j in range(0, i + 1 if alone else len(x[-1]), block):
                a, b = x[0][i : i + block], x[-1][j : j + block]
                yield alone and i == j, np.maximum(np.square(a).sum(axis=1)[:, None] + np.square(b).sum(axis=1)[None, :] - 2 * a @ b.T, 0.0)

    return roles[0], roles[-1], alone, tiled()


def _apart(part: pa.Table, width: int, block: int) -> Iterator[np.ndarray]:
    for diagonal, squared in _pair(part, width, block)[3]:
        apart = squared[np.tril_indices(len(squared), -1)] if diagonal else squared.ravel()
        yield apart[apart > 0]


def _counter(runs: list[str], width: int, known: dict[tuple, tuple[int, int]], shift: int, before: int, block: int):
    """Counts a pair's distances by the bits from ``shift`` on, of those whose bits from ``before`` on are the known ones."""

    def count(key, part):
        run = tuple(k.as_py() for k in key[: len(runs)])
        total = np.zeros(1 << (before - shift), np.int64)
        for apart in _apart(part, width, block) if not known or run in known else ():
            raw = apart.view(np.uint64)
            if known:
                raw = raw[raw >> np.uint64(before) == np.uint64(known[run][0])]
            places = ((raw >> np.uint64(shift)) & np.uint64(len(total) - 1)).astype(np.int64)
            if len(places):
                low = int(places.min())
                found = np.bincount(places - low)
                total[low : low + len(found)] += found
        ranges = np.flatnonzero(total)
        n, leading = total[ranges], ranges + ((known[run][0] << (before - shift)) if run in known else 0)
        return pa.table([*(pa.array([k] * len(n), s.type) for k, s in zip(run, key, strict=False)), pa.array(leading.astype(np.int64)), pa.array(n)], names=[*runs, "leading", "n_pairs"])

    return count


def median_squares(pairs: DataFrame, runs: list[str], width: int, block: int = BLOCK) -> dict[tuple, float]:
    """The median of the positive squared distances of each run's rows, exact."""
    known: dict[tuple, tuple[int, int]] = {}  # the leading bits and the rank among the distances that have them
    total: dict[tuple, int] = {}
    done = 0
    for bits in PASSES:
        shift, before = 64 - done - bits, 64 - done

        count = _counter(runs, width, dict(known), shift, before, block)
        counted = pairs.groupBy(*runs, "first", "second").applyInArrow(count, f"{_types(pairs, runs)}, leading long, n_pairs long")
        by: dict[tuple, list[tuple[int, int]]] = {}
        for r in counted.groupBy(*runs, "leading").agg(F.sum("n_pairs").alias("n_pairs")).collect():
            by.setdefault(tuple(r[k] for k in runs), []).append((r["leading"], r["n_pairs"]))
        for run, ranges in by.items():
            if not done:
                total[run] = sum(n for _, n in ranges)
            rank = known[run][1] if done else (total[run] - 1) // 2
            for leading, n in sorted(ranges):
                if rank < n:
                    break
                rank -= n
            known[run] = (leading, rank) if bits != PASSES[-1] else (leading, n - rank - 1)
        done += bits
    low = {run: float(np.array([leading], np.uint64).view(float)[0]) for run, (leading, _) in known.items()}
    # An even number has two middle values; unless the lower one occurs again, the upper one is the least above it.
    open_ = {run: low[run] for run, n in total.items() if n % 2 == 0 and known[run][1] == 0}
    if not open_:
        return low

    def above(key, part):
        run = tuple(k.as_py() for k in key[: len(runs)])
        least = [apart[apart > open_[run]].min(initial=math.inf) for apart in _apart(part, width, block)] if run in open_ else []
        found = [x for x in [min(least, default=math.inf)] if x < math.inf]
        return pa.table([*(pa.array([k] * len(found), s.type) for k, s in zip(run, key, strict=False)), pa.array(found, pa.float64())], names=[*runs, "least"])

    found = pairs.groupBy(*runs, "first", "second").applyInArrow(above, f"{_types(pairs, runs)}, least double").groupBy(*runs).agg(F.min("least").alias("least"))
    upper = {tuple(r[k] for k in runs): r["least"] for r in found.collect()}
    return {run: (v + upper[run]) / 2 if run in upper else v for run, v in low.items()}


def kernel_discrepancy(rows: DataFrame, runs: list[str], width: int, block: int = BLOCK) -> dict[tuple, float]:
    """Biased squared maximum mean discrepancy of source and target with a Gaussian kernel of the median bandwidth."""
    pairs, counts = tiles(rows, runs, block)
    bandwidth = {run: max(v, 1e-12) for run, v in median_squares(pairs, runs, width, block).items()}

    def weigh(key, part):
        run = tuple(k.as_py() for k in key[: len(runs)])
        a, b, _, of_pair = _pair(part, width, block)
        # Of a block with itself the tiles below the diagonal stand for those above, as a pair stands for both its orders.
        total = sum(float(np.exp(squared / (-2 * bandwidth.get(run, 1.0))).sum()) * (1 if diagonal else 2) for diagonal, squared in of_pair)
        return pa.table([*(pa.array([k], s.type) for k, s in zip(run, key, strict=False)), pa.array([a != b]), pa.array([a]), pa.array([total])], names=[*runs, "mixed", "domain", "kernel"])

    sums = pairs.groupBy(*runs, "first", "second").applyInArrow(weigh, f"{_types(pairs, runs)}, mixed boolean, domain string, kernel double")
    out = dict.fromkeys(counts, 0.0)
    for r in sums.groupBy(*runs, "mixed", "domain").agg(F.sum("kernel").alias("kernel")).collect():
        run = tuple(r[k] for k in runs)
        n = counts[run]
        out[run] += -r["kernel"] / (n["source"] * n["target"]) if r["mixed"] else r["kernel"] / n[r["domain"]] ** 2
    return {run: max(v, 0.0) for run, v in out.items() if all(counts[run].values())}


def transfer_metrics(rows: DataFrame, runs: list[str], block: int = BLOCK, most_modes: int = MODES) -> DataFrame:
    """``metric``, ``value`` of each run that has both domains: seven measures of how far they are apart.

    The first is in raw units, the others in the target's robust ones; medians are exact, covariances and principal modes
    follow from moments.
    """
    raw = collected(moments(rows.where("role <> 'query'"), [*runs, "role"]), [*runs, "role"])
    units = cut(robust_units(rows, runs))
    framed = collected(moments(units, [*runs, "role"]), [*runs, "role"])
    width = next((len(m.center) for m in raw.values()), 0)
    mmd = kernel_discrepancy(units, runs, width, block) if width else {}
    return _frame(rows.sparkSession, runs, rows, {run: list(_measures(*(m[*run, d] for m in (raw, framed) for d in ("source", "target")), most_modes, value).items()) for run, value in mmd.items()}, "metric string, value double")


def _measures(raw_s: Moments, raw_t: Moments, s: Moments, t: Moments, most_modes: int, mmd: float) -> dict[str, float]:
    gap = s.mean - t.mean
    cov_s, cov_t = s.covariance(), t.covariance()
    p = len(gap)
    modes = max(0, min(most_modes, int(s.n) - 1, int(t.n) - 1, p))
    similarity = 0.0
    if modes:
        top = lambda c: np.linalg.eigh(c)[1][:, ::-1][:, :modes]
        similarity = float(np.square(top(cov_s).T @ top(cov_t)).sum()) / modes
    sample = cov_s * (s.n / max(s.n - 1, 1)) - cov_t * (t.n / max(t.n - 1, 1))
    return {
        "mean_shift_distance": float(np.linalg.norm(raw_s.mean - raw_t.mean)), "standardized_mean_shift": float(np.sqrt(np.square(gap).mean())), "covariance_discrepancy": float(np.linalg.norm(sample)) / p,
        "projector_discrepancy": math.sqrt(max(1 - similarity, 0.0)) if modes else 0.0, "projector_similarity": similarity, "mmd_rbf": mmd,
        "wasserstein_diag": float(np.hypot(np.linalg.norm(gap), np.linalg.norm(np.sqrt(np.diag(cov_s)) - np.sqrt(np.diag(cov_t))))),
    }


#: The measures are those of :func:`linalg.transfer_metrics`, which takes two matrices.
MEASURES = tuple(L.transfer_metrics(np.eye(3), np.eye(3) * 2))
