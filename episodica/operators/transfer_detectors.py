"""Detectors that lend healthy structure from a source domain only as far as the target's own healthy rows bear it out.

They register themselves beside those of :mod:`matrix_detectors` and are fitted on the same (source, target).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from ..functions import linalg as L
from .matrix_detectors import Fit, Fitted, _gaussian, register_fit, standardizer

#: Fixed values of the published methods.
PRIOR, LOG_TAU, SHIFT_TAU, TRUST_FLOOR, GATE_SLACK, LEAST_EIGEN, KEPT_VARIANCE = 20.0, 1.0, 2.0, 0.05, 0.01, 1e-8, 0.95
BLEND_GRID = (0.0, 0.05, 0.1, 0.2, 0.4)
TAU_GRID = (0.5, 1.0, 2.0)
MOST_MODES, STRENGTH, RESAMPLES = 16, 0.25, 50
#: Target rows up to which each one left out is a model of its own; with more, moments lose the row.  Rows left out together.
FEW_ROWS, TOGETHER = 256, 128


def shuffled(n: int, seed: int) -> np.ndarray:
    """A permutation that is not the identity (for n above 1)."""
    order = np.random.default_rng(seed).permutation(n)
    return np.roll(order, 1) if n > 1 and (order == np.arange(n)).all() else order


def _left_out(x: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Some rows' place and, with each of them left out: mean, scatter matrix and :func:`linalg.shrunk_covariance` of the others.

    They follow from sums over all rows, so that a row costs the same however many there are.
    """
    center, (n, p) = x.mean(axis=0), x.shape
    c = x - center
    lengths = np.einsum("ij,ij->i", c, c)
    scatter, cubes, squares, fourths, m = c.T @ c, lengths @ c, lengths.sum(), (lengths**2).sum(), n - 1
    for at in range(0, n, TOGETHER):
        here = slice(at, min(at + TOGETHER, n))
        row, length = c[here], lengths[here]
        shift = row / -m
        moved = np.einsum("ij,ij->i", shift, shift)
        rest = scatter - row[:, :, None] * row[:, None, :]
        along = np.einsum("bi,bij,bj->b", shift, rest, shift, optimize=True)
        across = shift @ cubes - length * np.einsum("ij,ij->i", shift, row)
        # The sum of |c - shift|^4 over the others, whose rows c sum to m times the shift.
        fourth = fourths - length**2 + 4 * along + m * moved**2 - 4 * across + 2 * moved * (squares - length) - 4 * m * moved**2
        rest -= m * shift[:, :, None] * shift[:, None, :]
        s = rest / m
        mu, energy = np.einsum("bii->b", s) / p, np.einsum("bij,bij->b", s, s)
        spread, noise = energy - p * mu**2, (fourth / m - energy) / m
        share = np.where(spread > 0, np.clip(noise, 0, spread) / np.where(spread > 0, spread, 1), 0)
        yield here, center + shift, rest, (1 - share)[:, None, None] * s + (share * mu)[:, None, None] * np.eye(p)


# -- lending variance along the target's own directions ------------------------------------------------------------


@dataclass(frozen=True)
class Lending:
    """The target's directions with its own variance there, the source's, and how far the source is trusted."""

    mean: np.ndarray
    vectors: np.ndarray
    own: np.ndarray
    lent: np.ndarray
    trust: np.ndarray
    n: int

    def variance(self, trusting: bool) -> np.ndarray:
        """Own variance, or the average with the source's as ``PRIOR * trust`` further rows."""
        rows = PRIOR * self.trust * trusting
        return np.maximum((self.n * self.own + rows * self.lent) / (self.n + rows), LEAST_EIGEN)

    def squared(self, x: np.ndarray, trusting: bool) -> np.ndarray:
        return np.square((x - self.mean) @ self.vectors) @ (1 / self.variance(trusting))

    def log_density(self, x: np.ndarray, trusting: bool) -> np.ndarray:
        return -0.5 * (np.log(2 * np.pi * self.variance(trusting)).sum() + self.squared(x, trusting))


def _descending(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w, v = np.linalg.eigh((cov + cov.T) / 2)
    return np.maximum(w[::-1], LEAST_EIGEN), v[:, ::-1]


def _usable_rank(values: np.ndarray, n: int) -> int:
    """Modes that hold KEPT_VARIANCE of the variance, at most half of the rows less one."""
    return max(1, min((n - 1) // 2, int(np.searchsorted(np.cumsum(values) / values.sum(), KEPT_VARIANCE)) + 1, len(values)))


def lender(source: np.ndarray) -> tuple[np.ndarray, ...]:
    """What lending takes from the source alone: centered rows, covariance, its eigenvalues and eigenvectors."""
    mean, cov, _ = L.shrunk_covariance(source)
    return source - mean, cov, *_descending(cov)


def lending(source: np.ndarray, target: np.ndarray, permuted: bool = False, known: tuple[np.ndarray, ...] | None = None) -> Lending:
    """Trust is the product of shared subspace, agreeing variance and agreeing median, each between 0 and 1.

    ``known``: the :func:`lender` of ``source``, if it is at hand.
    """
    mean, cov_t, _ = L.shrunk_covariance(target)
    own, vectors = _descending(cov_t)
    centered, cov_s, values_s, vectors_s = known or lender(source)
    rank = min(_usable_rank(own, len(target)), _usable_rank(values_s, len(source)))
    lent = np.maximum(np.einsum("ij,ik,kj->j", vectors, cov_s, vectors), LEAST_EIGEN)
    structure = np.where(np.arange(len(own)) < rank, np.square(vectors.T @ vectors_s[:, :rank]).sum(axis=1), 0.0)
    gap = np.abs(np.median(centered @ vectors, axis=0) - np.median((target - mean) @ vectors, axis=0)) / np.sqrt(own)
    trust = np.clip(structure, 0, 1) * np.exp(-np.abs(np.log(lent / own)) / LOG_TAU - gap / SHIFT_TAU)
    trust = np.where(trust >= TRUST_FLOOR, trust, 0.0)
    return Lending(mean, vectors, own, lent, trust[shuffled(len(trust), 73)] if permuted else trust, len(target))


def _gain(source: np.ndarray, target: np.ndarray, i: int, permuted: bool, known: tuple[np.ndarray, ...]) -> float:
    model = lending(source, np.delete(target, i, axis=0), permuted, known)
    return model.log_density(target[i : i + 1], True)[0] - model.log_density(target[i : i + 1], False)[0]


def gate_margin(source: np.ndarray, target: np.ndarray, permuted: bool = False) -> float:
    """Mean gain in the log density of each target row left out, of lending over not lending."""
    known = lender(source)
    return float(np.mean([_gain(source, target, i, permuted, known) for i in range(len(target))]))


def gain_bounds(source: np.ndarray, target: np.ndarray, permuted: bool = False, known: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most that the gain of each target row left out can be, whatever the medians are.

    Medians are all that takes a pass over the rows.  They can only lower the trust, so that the variance lies between the
    target's own and that of agreeing medians; the density in between has its only peak where the variance is the square.
    """
    _, cov_s, values_s, vectors_s = known or lender(source)
    n, p = len(target) - 1, target.shape[1]
    most_s, least, most = _usable_rank(values_s, len(source)), np.empty(n + 1), np.empty(n + 1)
    order = shuffled(p, 73) if permuted else np.arange(p)
    for here, mean, _, cov in _left_out(target):
        w, v = np.linalg.eigh(cov)
        own, vectors = np.maximum(w[:, ::-1], LEAST_EIGEN), v[:, :, ::-1]
        rank = [min(_usable_rank(o, n), most_s) for o in own]
        lent = np.maximum(np.einsum("bij,bij->bj", vectors, cov_s @ vectors), LEAST_EIGEN)
        shared = np.cumsum(np.square(vectors.transpose(0, 2, 1) @ vectors_s), axis=2)[np.arange(len(rank)), :, np.array(rank) - 1]
        trust = np.where(np.arange(p) < np.array(rank)[:, None], shared.clip(0, 1), 0) * np.exp(-np.abs(np.log(lent / own)) / LOG_TAU)
        rows = PRIOR * np.where(trust >= TRUST_FLOOR, trust, 0.0)[:, order]
        far = np.maximum((n * own + rows * lent) / (n + rows), LEAST_EIGEN)
        square = np.square(np.einsum("bi,bij->bj", target[here] - mean, vectors))
        density = lambda variance: -0.5 * (np.log(variance) + square / variance)  # noqa: E731, B023
        without = density(own)
        least[here] = (np.minimum(density(far), without) - without).sum(axis=1)
        most[here] = (density(np.clip(square, np.minimum(own, far), np.maximum(own, far))) - without).sum(axis=1)
    return least, most


def gate_opens(source: np.ndarray, target: np.ndarray, permuted: bool = False) -> bool:
    """Whether :func:`gate_margin` is at least ``-GATE_SLACK``.

    With more than FEW_ROWS rows the gains' bounds stand for them, and the widest ones make way for gains until the answer is
    certain.  Bounds narrow like PRIOR over the rows, so that large targets need no or few gains.
    """
    if len(target) <= FEW_ROWS:
        return gate_margin(source, target, permuted) >= -GATE_SLACK
    known = lender(source)
    least, most = gain_bounds(source, target, permuted, known)
    low, high = least.sum(), most.sum()
    for i in np.argsort(least - most, kind="stable"):
        if low >= -GATE_SLACK * len(target) or high < -GATE_SLACK * len(target):
            break
        gain = _gain(source, target, i, permuted, known)
        low, high = low + gain - least[i], high + gain - most[i]
    return bool(low >= -GATE_SLACK * len(target))


def _selective(mode: str) -> Fit:
    def fit(s: np.ndarray, t: np.ndarray) -> Fitted:
        z = standardizer(t)
        t, s = z(t), z(s)
        if mode == "source_permuted":
            s = s[:, shuffled(s.shape[1], 59)]
        permuted = mode == "trust_permuted"
        model = lending(s, t, permuted)
        # The gate opens unless lending predicts the target's own healthy rows worse.
        trusting = mode != "target_only" and len(t) >= 4 and bool(model.trust.any()) and gate_opens(s, t, permuted)
        return lambda q: np.sqrt(model.squared(z(q), trusting))

    return fit


for _name, _mode in (("SelectiveTransfer", "selective"), ("SelectiveTargetOnly", "target_only"), ("SelectiveSourcePermuted", "source_permuted"), ("SelectiveTrustPermuted", "trust_permuted")):
    register_fit(_name, _selective(_mode))


# -- shared subspaces in the target's robust frame -------------------------------------------------------------------


def _framed(s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, Fitted]:
    """Source and target in the target's robust frame, the source by its own median, and the frame for queries."""
    center, scale = L.robust_frame(t)
    of = lambda x, c: np.clip((x - c) / scale, -8, 8)
    return of(s, np.median(s, axis=0)), of(t, center), lambda q: of(q, center)


def _modes(s: np.ndarray, t: np.ndarray) -> int:
    return max(1, min(MOST_MODES, len(t) - 2, len(s) - 1, t.shape[1]))


def _energy(healthy: np.ndarray) -> Fitted:
    """Squared distance from the healthy median in units of the healthy variance, entry by entry."""
    variance = healthy.var(axis=0, ddof=1)
    usable = variance[variance > LEAST_EIGEN]
    variance = np.where(variance > LEAST_EIGEN, variance, max(float(np.median(usable)) if usable.size else 1.0, LEAST_EIGEN))
    center = np.median(healthy, axis=0)
    return lambda values: np.square(values - center) / variance


def _blended_basis(own: np.ndarray, other: np.ndarray, share: float) -> np.ndarray:
    """Leading eigenvectors of the mean of two projectors."""
    _, v = np.linalg.eigh((1 - share) * own @ own.T + share * other @ other.T)
    return v[:, ::-1][:, : own.shape[1]]


def _blend_risks(other: np.ndarray, t: np.ndarray, k: int) -> np.ndarray:
    """For each share of the grid, what its subspace leaves of target rows that it has not seen.

    Two subspaces' principal vectors u and v pair up in planes that are orthogonal to each other.  With less than half of the
    weight on the other, the mean of the projectors has its leading vectors at one angle from u to v in each plane.
    """
    left = np.zeros(len(BLEND_GRID))
    for here, _, scatter, _ in _left_out(t):
        row, own = t[here], np.linalg.eigh(scatter)[1][:, :, : -k - 1 : -1]
        turn, cosine, back = np.linalg.svd(own.transpose(0, 2, 1) @ other)
        cosine = cosine.clip(0, 1)
        sine = np.sqrt(1 - cosine**2)
        on_u = np.einsum("bk,bkj->bj", np.einsum("bi,bik->bk", row, own), turn)
        on_v = np.einsum("bk,bjk->bj", row @ other, back)
        for i, share in enumerate(BLEND_GRID):
            angle = 0.5 * np.arctan2(2 * share * cosine * sine, 1 - 2 * share * sine**2)
            step = np.where(sine > 1e-6, np.sin(angle) / np.where(sine > 1e-6, sine, 1), share * cosine)
            seen = np.cos(angle) * on_u + step * (on_v - cosine * on_u)
            left[i] += (np.square(row).sum() - np.square(seen).sum()) / t.shape[1]
    return left / len(t)


def blend_share(s: np.ndarray, t: np.ndarray, k: int) -> float:
    """Smallest share of the grid whose subspace leaves the least of target rows that it has not seen."""
    other = L.principal_basis(s, k)
    if len(t) > FEW_ROWS:
        risks = dict(zip(BLEND_GRID, _blend_risks(other, t, k), strict=True))
    else:
        own = [L.principal_basis(np.delete(t, i, axis=0), k) for i in range(len(t))]

        def risk(share: float) -> float:
            bases = (_blended_basis(b, other, share) for b in own)
            return float(np.mean([np.square(row - b @ (b.T @ row)).mean() for row, b in zip(t, bases, strict=True)]))

        risks = {share: risk(share) for share in BLEND_GRID}
    return min(share for share, r in risks.items() if r <= min(risks.values()) + 1e-12)


@register_fit("SharedProjector")
def _shared_projector(s: np.ndarray, t: np.ndarray) -> Fitted:
    s, t, frame = _framed(s, t)
    k = _modes(s, t)
    basis = _blended_basis(L.principal_basis(t, k), L.principal_basis(s, k), blend_share(s, t, k))
    out = lambda x: x - x @ basis @ basis.T
    inner, outer = _energy(t @ basis), _energy(out(t))

    def score(q: np.ndarray) -> np.ndarray:
        x = frame(q)
        return 0.5 * inner(x @ basis).mean(axis=1) + 0.5 * outer(out(x)).mean(axis=1)

    return score


def variance_trust(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """exp(-|log ratio| / tau) with the tau of the grid under which the blended variance predicts the target's best."""
    log_s, log_t = np.log(source + LEAST_EIGEN), np.log(target + LEAST_EIGEN)
    agreement = {tau: np.exp(-np.abs(log_t - log_s) / tau) for tau in TAU_GRID}
    risk = {tau: np.square(np.log(a * source + (1 - a) * target + LEAST_EIGEN) - log_t).mean() for tau, a in agreement.items()}
    return agreement[min(TAU_GRID, key=lambda tau: (risk[tau], tau))]


def bootstrap_trust(t: np.ndarray, vectors: np.ndarray, seed: int = 42) -> np.ndarray:
    """How well resampled target modes repeat each vector: the median over samples of the best squared cosine."""
    rng, k = np.random.default_rng(seed), vectors.shape[1]
    samples = (t[rng.integers(0, len(t), len(t))] for _ in range(RESAMPLES))
    return np.median([np.square(L.principal_basis(x, k).T @ vectors).max(axis=0) for x in samples], axis=0).clip(0, 1)


def _paired(mode: str) -> Fit:
    """Energy along principal vectors of both domains by trust, beside the target's own and what is orthogonal."""

    def fit(s: np.ndarray, t: np.ndarray) -> Fitted:
        s, t, frame = _framed(s, t)
        if mode == "feature_permuted":
            s = s[:, shuffled(s.shape[1], 59)]
        k = _modes(s, t)
        own, other = L.principal_basis(t, k), L.principal_basis(s, k)
        if mode == "random":
            vectors, weight = np.linalg.qr(np.random.default_rng(42).normal(size=(t.shape[1], k)))[0], np.ones(k)
        else:
            left, cosine, right = np.linalg.svd(other.T @ own)
            vectors, theirs, squares = own @ right.T, other @ left, np.square(cosine.clip(0, 1))
            weight = squares / (squares + STRENGTH)
            if mode == "weight_permuted":
                weight = weight[shuffled(k, 42)]
            elif mode == "variance":
                weight = weight * variance_trust((s @ theirs).var(axis=0, ddof=1), (t @ vectors).var(axis=0, ddof=1))
            elif mode == "stability":
                weight = weight * bootstrap_trust(t, vectors)
        out = lambda x: x - x @ vectors @ vectors.T
        inner, outer = _energy(t @ vectors), _energy(out(t))

        def score(q: np.ndarray) -> np.ndarray:
            x = frame(q)
            energy, rest = inner(x @ vectors), outer(out(x)).mean(axis=1)
            mean = lambda w: energy @ w / (w.sum() + 1e-8)
            return 0.5 * mean(weight) + 0.25 * mean(1 - weight) + 0.25 * rest

        return score

    return fit


for _name, _mode in (
    ("AlignedFeaturePermuted", "feature_permuted"), ("AlignedRandomSubspace", "random"), ("AlignedWeightPermuted", "weight_permuted"), ("AlignedVarianceAware", "variance"), ("AlignedStabilityAware", "stability"),
):
    register_fit(_name, _paired(_mode))


# -- variants of regularization --------------------------------------------------------------------------------------


def _leading(k: int) -> Fit:
    """Mahalanobis distance within the k leading components of the target."""

    def fit(s: np.ndarray, t: np.ndarray) -> Fitted:
        z = standardizer(t)
        t = z(t)
        basis = L.principal_basis(t, min(k, len(t) - 1, t.shape[1]))
        mean, cov, _ = L.shrunk_covariance(t @ basis)
        inverse = np.linalg.pinv(cov, hermitian=True)
        return lambda q: L.mahalanobis(z(q) @ basis, mean, inverse)

    return fit


def _most_varying(k: int) -> Fit:
    """Mahalanobis distance over the k features of largest variance in the target."""

    def fit(s: np.ndarray, t: np.ndarray) -> Fitted:
        use = np.sort(np.argsort(-t.var(axis=0), kind="stable")[:k])
        inner = _gaussian(t[:, use])
        return lambda q: inner(q[:, use])

    return fit


@register_fit("Diagonal")
def _diagonal(s: np.ndarray, t: np.ndarray) -> Fitted:
    z = standardizer(t)
    return lambda q: np.linalg.norm(z(q), axis=1)


for _k in (10, 25, 50):
    register_fit(f"PrincipalModes{_k}", _leading(_k))
for _k in (50, 100, 250):
    register_fit(f"TopVariance{_k}", _most_varying(_k))
