"""Feature selection: spectral scores on a bag of rows, and clusters of features.

A bag is a documented bound of the method (``BAG`` rows, drawn with weights), since its spectrum is dense.  What does not
need the spectrum is an aggregate over the whole table: covariances, and ``graph.laplacian_scores``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.operators.draws import with_replacement
from quartzite.operators.factors import promax
from quartzite.operators.graph import optimal_k

#: Rows of a bag at most; their matrix of weights is held by the driver.
BAG = 3000


def bag_of(df: DataFrame, features: Sequence[str], size: int = BAG, weight: str | None = None, seed: int = 0) -> np.ndarray:
    """Standardised rows drawn with replacement, in proportion to a weight (as likely if all are zero)."""
    if size > BAG:
        raise ValueError(f"a bag has {BAG} rows at most")
    drawn = with_replacement(df.select(*features, *([weight] if weight else [])).dropna(subset=list(features)), size, weight, seed=seed)
    x = np.array(drawn.select(*(F.col(c).cast("double") for c in features)).collect(), float).reshape(-1, len(features))
    spread = x.std(0)
    return (x - x.mean(0)) / np.where(spread > 0, spread, 1.0) if len(x) else x


def gamma_of(x: np.ndarray) -> float:
    """1 / (2 * mean standard deviation)."""
    spread = float(x.std(0, ddof=1).mean()) if len(x) > 1 else 0.0
    return 1 / (2 * spread) if spread else 0.5


def affinity(x: np.ndarray, k: int | None = None, gamma: float | None = None) -> np.ndarray:
    """Symmetric weights exp(-gamma d^2) between rows one of which is among the other's k nearest."""
    n = len(x)
    k, gamma = min(k or optimal_k(n), n - 1), gamma_of(x) if gamma is None else gamma
    square = (x * x).sum(1)
    d = np.maximum(square[:, None] + square[None] - 2 * x @ x.T, 0)
    np.fill_diagonal(d, np.inf)
    near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(d, axis=1)[:, :k]
    w = np.zeros((n, n))
    w[np.arange(n)[:, None], near] = np.exp(-gamma * np.take_along_axis(d, near, 1))
    return np.maximum(w, w.T)


def _spectrum(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Degrees, eigenvalues and eigenvectors of the normalised Laplacian, in rising order."""
    d = w.sum(1)
    by = 1 / np.sqrt(np.where(d > 0, d, 1.0))
    values, vectors = np.linalg.eigh(np.eye(len(w)) - by[:, None] * w * by[None])
    return d, values, vectors


def spec_scores(x: np.ndarray, w: np.ndarray, clusters: int | None = None) -> np.ndarray:
    """Three scores of each feature: its normalised cut, that cut without the share of the trivial eigenvector, and the
    sum of squared cosines with the next eigenvectors, each times two less its eigenvalue."""
    d, values, vectors = _spectrum(w)
    f = np.sqrt(d)[:, None] * x
    f = f / np.where((size := np.linalg.norm(f, axis=0)) > 0, size, 1.0)
    share = (vectors.T @ f) ** 2
    cut = (values[:, None] * share).sum(0)
    rest = 1 - share[0]
    k = min(clusters or optimal_k(x.shape[1]) + 1, len(values))
    return np.stack([cut, np.where(rest > 1e-12, cut / np.where(rest > 1e-12, rest, 1.0), 0.0), ((2 - values[1:k, None]) * share[1:k]).sum(0)], axis=1)


def least_angle(x: np.ndarray, y: np.ndarray, steps: int) -> np.ndarray:
    """Coefficients after so many steps of least-angle regression."""
    beta, active, rest = np.zeros(x.shape[1]), [], y.astype(float).copy()
    for _ in range(min(steps, x.shape[1])):
        c = x.T @ rest
        if (top := float(np.abs(c).max())) < 1e-12:
            break
        active = sorted({*active, *(j for j in range(len(c)) if abs(c[j]) > top - 1e-9)})
        sign = np.sign(c[active])
        xa = x[:, active] * sign
        way = np.linalg.lstsq(xa.T @ xa, np.ones(len(active)), rcond=None)[0]
        if way.sum() <= 0:
            break
        scale = 1 / np.sqrt(way.sum())
        u = xa @ (scale * way)
        a = x.T @ u
        others = [j for j in range(len(c)) if j not in active]
        go = [g for j in others for g in ((top - c[j]) / (scale - a[j]) if scale != a[j] else np.inf, (top + c[j]) / (scale + a[j]) if scale != -a[j] else np.inf) if g > 1e-12]
        step = min([*go, top / scale])
        beta[active] += step * scale * way * sign
        rest = rest - step * u
    return beta


def multi_cluster_scores(x: np.ndarray, w: np.ndarray, clusters: int | None = None, steps: int | None = None) -> np.ndarray:
    """Greatest size of each feature's coefficient over regressions of the first eigenvectors beside the trivial one."""
    d, _, vectors = _spectrum(w)
    k = clusters or optimal_k(x.shape[1])
    flat = vectors[:, 1 : k + 1] / np.sqrt(np.where(d > 0, d, 1.0))[:, None]
    scores = np.zeros(x.shape[1])
    for y in flat.T:
        scores = np.maximum(scores, np.abs(least_angle(x, y - y.mean(), steps or x.shape[1])))
    return scores


def spectral_ranking(df: DataFrame, features: Sequence[str], method: str = "mcfs", bags: int = 1, size: int = BAG, weight: str | None = None, seed: int = 0) -> DataFrame:
    """``(feature, score)``, averaged over bags; ``mcfs``, ``spec_cut``, ``spec_normalised`` or ``spec_clusters``."""
    which = {"mcfs": None, "spec_cut": 0, "spec_normalised": 1, "spec_clusters": 2}
    if method not in which:
        raise ValueError(f"{method!r} is none of {sorted(which)}")
    total = np.zeros(len(features))
    for b in range(bags):
        x = bag_of(df, features, size, weight, seed + b)
        if len(x) > 2:
            w = affinity(x)
            total += multi_cluster_scores(x, w) if method == "mcfs" else spec_scores(x, w)[:, which[method]]
    return df.sparkSession.createDataFrame([(f, float(s)) for f, s in zip(features, total / max(bags, 1), strict=True)], "feature string, score double")


def covariance(df: DataFrame, features: Sequence[str]) -> np.ndarray:
    """Of the standardised features, over all rows: their correlations."""
    n = len(features)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    row = df.agg(*(F.covar_pop(F.col(features[i]).cast("double"), F.col(features[j]).cast("double")) for i, j in pairs)).first()
    out = np.zeros((n, n))
    for (i, j), v in zip(pairs, row, strict=True):
        out[i, j] = out[j, i] = v or 0.0
    spread = np.sqrt(np.where(np.diag(out) > 0, np.diag(out), 1.0))
    return out / spread[:, None] / spread[None]


def _ward(x: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters by Ward's rule."""
    own = [[i] for i in range(len(x))]
    while len(own) > k:
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * float(((x[a].mean(0) - x[b].mean(0)) ** 2).sum())
        _, i, j = min((cost(own[i], own[j]), i, j) for i in range(len(own)) for j in range(i + 1, len(own)))
        own[i] += own.pop(j)
    labels = np.zeros(len(x), int)
    for c, members in enumerate(own):
        labels[members] = c
    return labels


def _representatives(x: np.ndarray, k: int, rounds: int = 100) -> list[int]:
    """Rows nearest the centres of k-means that starts at Ward's clusters."""
    labels = _ward(x, k)
    for _ in range(rounds):
        centres = np.stack([x[labels == c].mean(0) if (labels == c).any() else x[c] for c in range(k)])
        new = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        if (new == labels).all():
            break
        labels = new
    far = ((x[:, None] - centres[None]) ** 2).sum(2)
    return sorted({int(min(np.flatnonzero(labels == c), key=lambda i: (far[i, c], i))) for c in range(k) if (labels == c).any()})


def principal_features(df: DataFrame, features: Sequence[str], k: int) -> list[str]:
    """``k`` features that stand for all: clusters of the features' rows in the eigenvectors of their correlations."""
    _, vectors = np.linalg.eigh(covariance(df, features))
    return [features[i] for i in _representatives(vectors[:, ::-1] * np.sign(vectors[:, ::-1][np.abs(vectors[:, ::-1]).argmax(0), np.arange(len(features))]), k)]


def independent_features(df: DataFrame, features: Sequence[str], k: int, seed: int = 0, rounds: int = 30) -> list[str]:
    """As ``principal_features``, in independent components turned obliquely.

    Each round of the components' search is one aggregate over all rows."""
    n = len(features)
    row = df.agg(*(f(F.col(c).cast("double")) for f in (F.avg, F.stddev_pop) for c in features)).first()
    mean, spread = np.array(row, float).reshape(2, -1)
    spread = np.where(spread > 0, spread, 1.0)
    values, vectors = np.linalg.eigh(covariance(df, features))
    white = vectors / np.sqrt(np.maximum(values, 1e-9))
    z = [(F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(features, mean, spread, strict=True)]
    scaled = df.dropna(subset=list(features)).select(*(e.alias(f"z{i}") for i, e in enumerate(z)))
    x = scaled.select(*(sum((F.col(f"z{i}") * float(white[i, j]) for i in range(n)), F.lit(0.0)).alias(f"x{j}") for j in range(n)))
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))
    for _ in range(rounds):
        sums = []
        for j in range(n):
            s = F.tanh(sum((F.col(f"x{i}") * float(turn[i, j]) for i in range(n)), F.lit(0.0)))
            sums += [*(F.avg(F.col(f"x{i}") * s) for i in range(n)), F.avg(1 - s * s)]
        got = np.array(x.agg(*(c.alias(f"a{i}") for i, c in enumerate(sums))).first(), float).reshape(n, n + 1)
        left, _, right = np.linalg.svd((got[:, :n] - got[:, n:] * turn.T).T, full_matrices=False)
        new = left @ right
        done = float(np.abs(np.abs((new * turn).sum(0)) - 1).max()) < 1e-6
        turn = new
        if done:
            break
    return [features[i] for i in _representatives(promax(white @ turn), k)]
