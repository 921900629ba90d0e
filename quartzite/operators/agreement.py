"""How two labellings of the same rows agree: from their contingency table, which is all that is gathered."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a contingency table that may be gathered.
MAX_CELLS = 1_000_000


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """``(a, b, n)`` of rows that have both labels."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _entropy(sizes) -> float:
    total = sum(sizes)
    return -sum(n / total * math.log(n / total) for n in sizes if n)


def _expected_information(rows: list[int], columns: list[int]) -> float:
    """Mutual information that random labellings of these class sizes have on average; classes of one size count once."""
    total = sum(rows)
    ln = np.array([math.lgamma(k + 1) for k in range(total + 1)]) if total <= 1 << 22 else None
    fact = (lambda x: ln[x]) if ln is not None else np.vectorize(lambda x: math.lgamma(float(x) + 1))
    out = 0.0
    for a, times in Counter(rows).items():
        for b, more in Counter(columns).items():
            n = np.arange(max(1, a + b - total), min(a, b) + 1)
            log = fact(a) + fact(b) + fact(total - a) + fact(total - b) - fact(total) - fact(n) - fact(a - n) - fact(b - n) - fact(total - a - b + n)
            out += times * more * float((n / total * np.log(total * n / (a * b)) * np.exp(log)).sum())
    return out


def agreement(df: DataFrame, truth: str, found: str) -> dict[str, float]:
    """``nmi`` and ``ami`` (arithmetic means), ``homogeneity``, ``completeness``, ``v_measure`` and ``fowlkes_mallows``."""
    own = contingency(df, truth, found)
    cells = [tuple(r) for r in own.limit(MAX_CELLS + 1).collect()]
    if len(cells) > MAX_CELLS:
        raise ValueError(f"over {MAX_CELLS} pairs of labels")
    if not cells:
        return dict.fromkeys(("nmi", "ami", "homogeneity", "completeness", "v_measure", "fowlkes_mallows"), 1.0)
    rows, columns = Counter(), Counter()
    for a, b, n in cells:
        rows[a] += n
        columns[b] += n
    total = sum(rows.values())
    shared = sum(n / total * math.log(total * n / (rows[a] * columns[b])) for a, b, n in cells)
    one, two = _entropy(rows.values()), _entropy(columns.values())
    share = lambda x, h: x / h if h > 0 else 1.0
    homogeneity, completeness = share(shared, one), share(shared, two)
    expected, mean = _expected_information(list(rows.values()), list(columns.values())), (one + two) / 2
    pairs = lambda sizes: sum(n * (n - 1) for n in sizes)
    both = pairs(n for _, _, n in cells)
    return {
        "nmi": share(shared, mean),
        "ami": (shared - expected) / (mean - expected) if abs(mean - expected) > 1e-15 else 1.0,
        "homogeneity": homogeneity,
        "completeness": completeness,
        "v_measure": 2 * homogeneity * completeness / (homogeneity + completeness) if homogeneity + completeness > 0 else 0.0,
        "fowlkes_mallows": both / math.sqrt(pairs(rows.values()) * pairs(columns.values())) if both else 0.0,
    }


def knee(y) -> int:
    """Place of the knee of a rising curve: farthest below the line from its first to its last point."""
    v = np.asarray(y, float)
    if len(v) < 3 or v[-1] == v[0]:
        return 0
    return int(np.argmax(np.linspace(0, 1, len(v)) - (v - v[0]) / (v[-1] - v[0])))


def search_radius(edges: DataFrame, factor: float = 10.0, quantiles: int = 1000) -> float:
    """A radius for density clusters: the knee of the sorted mean distances to the nearest neighbours, times ``factor``.

    The curve is taken at ``quantiles`` places."""
    means = edges.groupBy("src").agg(F.avg("distance").alias("d"))
    row = means.agg(F.percentile_approx("d", [k / quantiles for k in range(quantiles + 1)], 10_000)).first()[0]
    return factor * row[knee(row)] if row else 0.0
