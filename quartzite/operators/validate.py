"""How well a map stands for its data: distributions, moments, topology, intervals.

Quantiles of Student's t and of F come from the incomplete beta function by its continued fraction.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.operators import impute, som
from quartzite.operators.draws import with_replacement


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + term * d, 1 + term / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def _solve(share, target: float, low: float, high: float) -> float:
    while share(high) < target:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if share(mid) < target else (low, mid)
    return (low + high) / 2


def f_quantile(p: float, d1: float, d2: float) -> float:
    return _solve(lambda f: beta_share(d1 / 2, d2 / 2, d1 * f / (d1 * f + d2)), p, 0.0, 1.0)


def t_quantile(p: float, d: float) -> float:
    if p < 0.5:
        return -t_quantile(1 - p, d)
    return _solve(lambda t: 1 - beta_share(d / 2, 0.5, d / (d + t * t)) / 2, p, 0.0, 1.0)


def confidence_interval(values: Sequence[float], confidence: float = 0.95) -> tuple[float, float]:
    """Of the mean, by Student's t; within [0, 1], as it is of shares."""
    v = np.asarray(values, float)
    if len(v) < 2:
        return (float(v.mean()),) * 2 if len(v) else (0.0, 1.0)
    half = t_quantile((1 + confidence) / 2, len(v) - 1) * float(v.std(ddof=1)) / math.sqrt(len(v))
    return max(0.0, float(v.mean()) - half), min(1.0, float(v.mean()) + half)


def _moments(df: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row = df.agg(*(f(c) for f in (F.count, F.avg, F.var_samp) for c in features)).first()
    return tuple(np.array(row, float).reshape(3, -1))


def _share(df: DataFrame, features: Sequence[str], good: Sequence[bool]) -> float:
    """Share of the variance that lies in the good features."""
    variance = np.nan_to_num(_moments(df, features)[2])
    return float(variance[np.array(good, bool)].sum() / variance.sum()) if variance.sum() else 0.0


def likelihood(df: DataFrame, features: Sequence[str], codebook: np.ndarray, confidence: float = 0.95) -> float:
    """Share of variance in the features whose neurons and data a Kolmogorov-Smirnov test does not tell apart."""
    good = []
    for k, c in enumerate(features):
        units = df.sparkSession.createDataFrame([(1, float(w)) for w in codebook[:, k]], "s int, v double")
        got = impute.ks(df.select(F.lit(0).alias("s"), F.col(c).cast("double").alias("v")).unionByName(units), "s", "v").first()
        good.append(got["statistic"] is not None and impute.ks_p_value(got["statistic"], got["n1"], got["n2"]) > 1 - confidence)
    return _share(df, features, good)


def embedding_index(df: DataFrame, features: Sequence[str], codebook: np.ndarray, confidence: float = 0.95) -> float:
    """Share of variance in the features whose ratio of variances may be 1 and whose difference of means may be 0."""
    n, mean, variance = _moments(df, features)
    m, own = len(codebook), codebook.var(0, ddof=1)
    good = []
    for k in range(len(features)):
        if not (n[k] > 1 and m > 1 and variance[k] > 0 and own[k] > 0):
            good.append(False)
            continue
        low, high = ratio_interval(variance[k], n[k], own[k], m, confidence)
        a, b = difference_interval(mean[k], variance[k], n[k], float(codebook[:, k].mean()), own[k], m, confidence)
        good.append(low <= 1 <= high and a <= 0 <= b)
    return _share(df, features, good)


def ratio_interval(v1: float, n1: float, v2: float, n2: float, confidence: float = 0.95) -> tuple[float, float]:
    """Of the ratio of two variances, by F."""
    p, ratio = (1 + confidence) / 2, v1 / v2
    return ratio / f_quantile(p, n1 - 1, n2 - 1), ratio * f_quantile(p, n2 - 1, n1 - 1)


def difference_interval(m1: float, v1: float, n1: float, m2: float, v2: float, n2: float, confidence: float = 0.95) -> tuple[float, float]:
    """Of the difference of two means with unequal variances."""
    a, b = v1 / n1, v2 / n2
    freedom = (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1))
    half = t_quantile((1 + confidence) / 2, freedom) * math.sqrt(a + b)
    return m1 - m2 - half, m1 - m2 + half


def topology_accuracy(df: DataFrame, features: Sequence[str], codebook: np.ndarray, lattice: som.Lattice, k: int = 30, confidence: float = 0.95, seed: int = 0) -> tuple[float, float, float]:
    """Share of ``k`` drawn rows whose two nearest neurons lie less than two apart on the lattice, and its interval."""
    x = np.array(with_replacement(df.select(*features).dropna(), k, seed=seed).select(*features).collect(), float).reshape(-1, len(features))  # k rows
    if not len(x):
        return 0.0, 0.0, 1.0
    two = np.argsort(((x[:, None] - codebook[None]) ** 2).sum(2), axis=1, kind="stable")[:, :2]
    places = lattice.places()
    good = np.sqrt(((places[two[:, 0]] - places[two[:, -1]]) ** 2).sum(1)) < 2
    return float(good.mean()), *confidence_interval(good, confidence)


def goodness_of_fit(df: DataFrame, features: Sequence[str], codebook: np.ndarray, lattice: som.Lattice, k: int = 30, confidence: float = 0.95, by_distribution: bool = True) -> dict[str, float]:
    """Likelihood (or embedding index), topology accuracy with its interval, and the mean of both."""
    fit = (likelihood if by_distribution else embedding_index)(df, features, codebook, confidence)
    accuracy, low, high = topology_accuracy(df, features, codebook, lattice, k, confidence)
    return {"likelihood": fit, "topology_accuracy": accuracy, "low": low, "high": high, "goodness": (fit + accuracy) / 2}
