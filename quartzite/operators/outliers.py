"""Outliers by an isolation forest, or by the Mahalanobis distance."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.operators import prepare
from quartzite.storage import cut

#: Trees, and rows that a tree is made of: bounds of the method itself, whatever the table's size.
TREES, ROWS = 100, 256


def _average(n: np.ndarray | int):
    """Mean path length of an unsuccessful search in a tree of n."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _tree(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """A tree as arrays: feature (-1 at a leaf), split, left, right, path length at a leaf."""
    feature, split, left, right, length = [], [], [], [], []
    limit = math.ceil(math.log2(max(len(x), 2)))
    todo = [(x, 0, -1, False)]
    while todo:
        rows, depth, parent, is_right = todo.pop()
        k = len(feature)
        if parent >= 0:
            (right if is_right else left)[parent] = k
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
        open_ = np.flatnonzero(high > low)
        leaf = depth >= limit or len(rows) < 2 or not len(open_)
        f = -1 if leaf else int(rng.choice(open_))
        at = 0.0 if leaf else float(rng.uniform(low[f], high[f]))
        feature.append(f), split.append(at), left.append(0), right.append(0)
        length.append(depth + float(_average(len(rows))) if leaf else 0.0)
        if not leaf:
            under = rows[:, f] < at
            todo += [(rows[~under], depth + 1, k, True), (rows[under], depth + 1, k, False)]
    return tuple(map(np.array, (feature, split, left, right, length)))


def forest(df: DataFrame, features: Sequence[str], seed: int = 42, trees: int = TREES, rows: int = ROWS) -> tuple[list[tuple[np.ndarray, ...]], int]:
    """Trees of at most ``rows`` rows each, and how many a tree has; the driver holds ``trees * rows`` rows at most."""
    keyed = df.select(*(F.col(c).cast("double").alias(c) for c in features)).dropna().withColumn("_k", F.xxhash64(*features, F.lit(seed)))
    x = np.array([r[:-1] for r in keyed.orderBy("_k", *features).limit(trees * rows).collect()], float).reshape(-1, len(features))
    rng = np.random.default_rng(seed)
    size = min(rows, len(x))
    return [_tree(x[rng.choice(len(x), size, replace=False)], rng) for _ in range(trees)] if size else [], size


def scores(df: DataFrame, features: Sequence[str], model: tuple[list[tuple[np.ndarray, ...]], int], out: str = "score") -> DataFrame:
    """``df`` with the anomaly score, 0 to 1, of every row; NULL where a feature is missing."""
    made, size = model
    usual, at, names = float(_average(size)) or 1.0, len(df.columns), [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            bad, total = ~np.isfinite(x).all(1) | (not made), np.zeros(len(x))
            x = np.nan_to_num(x)
            for feature, split, left, right, length in made:
                node = np.zeros(len(x), int)
                while (go := np.flatnonzero(feature[node] >= 0)).size:
                    here = node[go]
                    node[go] = np.where(x[go, feature[here]] < split[here], left[here], right[here])
                total += length[node]
            score = 2.0 ** (-total / max(len(made), 1) / usual)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(score, mask=bad)], names=names)

    schema = df.withColumn(out, F.lit(None).cast("double")).schema
    return df.withColumn("_v", F.array(*(F.col(c).cast("double") for c in features))).mapInArrow(run, schema)


def drop_outliers(df: DataFrame, features: Sequence[str], fraction: float = 0.05, seed: int = 42, algorithm: str = "isolation_forest") -> DataFrame:
    """Rows whose score is not among the greatest ``fraction``; rows without a score stay.

    The limit is a quantile of the scores, to one part in 100,000 of the rows.  ``elliptic`` scores by Mahalanobis
    distance under the sample covariance."""
    if not 0 <= fraction < 0.5:
        raise ValueError("the fraction lies in [0, 0.5)")
    if algorithm == "isolation_forest":
        scored = cut(scores(df, features, forest(df, features, seed), "_score"))
    elif algorithm == "elliptic":
        scored = cut(prepare.mahalanobis(df, features, "_score"))
    else:
        raise ValueError(f"no such algorithm: {algorithm!r}")
    limit = scored.agg(F.percentile_approx("_score", 1 - fraction, 100_000)).first()[0]
    return (scored if limit is None else scored.where(F.col("_score").isNull() | (F.col("_score") <= F.lit(limit)))).drop("_score")
