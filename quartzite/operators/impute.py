"""Chained-equation imputation, predictive matching, and the two-sample Kolmogorov-Smirnov statistic."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzite.functions.columns import rescale
from quartzite.operators.prepare import exp_out, fill, finite_only, log_in
from quartzite.operators.relational import numbered
from quartzite.storage import cut


def _normal_equations(df: DataFrame, target: str, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X, X'y, y'y with an intercept first, and the number of rows: one aggregate whatever their number."""
    one = F.lit(1.0)
    x = [one, *(F.col(c).cast("double") for c in features)]
    y = F.col(target).cast("double")
    n = len(x)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    row = df.agg(*(F.sum(x[i] * x[j]) for i, j in pairs), *(F.sum(c * y) for c in x), F.sum(y * y), F.count(one)).first()
    xx = np.zeros((n, n))
    for (i, j), v in zip(pairs, row, strict=False):
        xx[i, j] = xx[j, i] = v or 0.0
    return xx, np.array([v or 0.0 for v in row[len(pairs) : len(pairs) + n]]), float(row[-2] or 0.0), int(row[-1])


def ridge(df: DataFrame, target: str, features: Sequence[str], rounds: int = 50) -> np.ndarray:
    """Bayesian ridge by evidence maximisation on the normal equations: weights, the intercept first (not shrunk)."""
    xx, xy, yy, n = _normal_equations(df, target, features)
    alpha, lam, shrink = 1.0, 1e-6, np.eye(len(xy))
    shrink[0, 0] = 0.0
    beta = np.zeros(len(xy))
    for _ in range(rounds):
        a = alpha * xx + lam * shrink
        beta = np.linalg.lstsq(a, alpha * xy, rcond=None)[0]
        eig = np.clip(np.linalg.eigvalsh(alpha * xx[1:, 1:]), 0, None) if len(xy) > 1 else np.zeros(0)
        gamma = float((eig / (eig + lam)).sum())
        rest = max(yy - 2 * beta @ xy + beta @ xx @ beta, 1e-12)
        new = (gamma / max(float(beta[1:] @ beta[1:]), 1e-12), max(n - gamma, 1e-6) / rest)
        done = abs(new[0] - lam) <= 1e-6 * lam and abs(new[1] - alpha) <= 1e-6 * alpha
        lam, alpha = new
        if done:
            break
    return beta


def least_squares(df: DataFrame, target: str, features: Sequence[str]) -> np.ndarray:
    """Without an intercept; the first weight is 0."""
    xx, xy, _, _ = _normal_equations(df, target, features)
    return np.concatenate(([0.0], np.linalg.lstsq(xx[1:, 1:], xy[1:], rcond=None)[0]))


#: Classes that a column of categories may have.
CLASSES = 100


def _linear(features: Sequence[str], beta: np.ndarray) -> Column:
    return sum((F.col(c) * float(b) for c, b in zip(features, beta[1:], strict=True)), F.lit(float(beta[0])))


def _polynomial(df: DataFrame, target: str, features: Sequence[str]) -> Column:
    """Least squares on the features and all products of two."""
    own = [F.col(c).cast("double") for c in features]
    terms = own + [a * b for a, b in combinations_with_replacement(own, 2)]
    names = [f"_t{i}" for i in range(len(terms))]
    beta = ridge(df.select(target, *(t.alias(n) for t, n in zip(terms, names, strict=True))), target, names)
    return sum((t * float(b) for t, b in zip(terms, beta[1:], strict=True)), F.lit(float(beta[0])))


def _likeliest(scores: Sequence[tuple[float, Column]]) -> Column:
    return F.array_max(F.array(*(F.struct(s.alias("s"), F.lit(float(v)).alias("v")) for v, s in scores)))["v"]


def _discriminant(df: DataFrame, target: str, features: Sequence[str], pooled: bool) -> Column:
    """The likeliest class by Gaussians of one covariance, or of each class's own: one aggregate by class."""
    n = len(features)
    x = [F.col(c).cast("double") for c in features]
    rows = df.groupBy(F.col(target).cast("double").alias("v")).agg(F.count(F.lit(1)), *(F.avg(c) for c in x), *(F.covar_pop(a, b) for a in x for b in x)).limit(CLASSES + 1).collect()
    if not rows or len(rows) > CLASSES:
        raise ValueError(f"{target}: not between 1 and {CLASSES} classes")
    total = sum(r[1] for r in rows)
    each = [(r[0], r[1] / total, np.array(r[2 : 2 + n], float), np.array(r[2 + n :], float).reshape(n, n)) for r in sorted(rows)]
    common, scores = sum(p * s for _, p, _, s in each), []
    for value, p, mean, own in each:
        spread = (common if pooled else own) + 1e-9 * np.eye(n) * max(float(np.trace(common)) / n, 1e-9)
        inverse = np.linalg.inv(spread)
        z = [a - float(m) for a, m in zip(x, mean, strict=True)]
        far = sum((z[i] * z[j] * float(inverse[i, j]) for i in range(n) for j in range(n)), F.lit(0.0))
        scores.append((value, F.lit(math.log(p) - float(np.linalg.slogdet(spread)[1]) / 2) - far / 2))
    return _likeliest(scores)


def _logistic(df: DataFrame, target: str, features: Sequence[str]) -> Column:
    """The likeliest class of a multinomial logistic regression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    values = sorted(r[0] for r in df.select(F.col(target).cast("double")).distinct().limit(CLASSES + 1).collect())
    if not values or len(values) > CLASSES:
        raise ValueError(f"{target}: not between 1 and {CLASSES} classes")
    if len(values) == 1:
        return F.lit(values[0])
    place = (F.array_position(F.array(*map(F.lit, values)), F.col(target).cast("double")) - 1).cast("double")
    own = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df.withColumn("_y", place))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial", maxIter=50).fit(own)
    weights, start = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    return _likeliest([(v, _linear(features, np.concatenate(([start[k]], weights[k])))) for k, v in enumerate(values)])


#: Each gives the expression that predicts a target.  Those of classes give values that the column has.
METHODS = {
    "norm": lambda df, y, x: _linear(x, ridge(df, y, x)),
    "norm.nob": lambda df, y, x: _linear(x, least_squares(df, y, x)),
    "polyreg": _polynomial,
    "lda": lambda df, y, x: _discriminant(df, y, x, True),
    "qda": lambda df, y, x: _discriminant(df, y, x, False),
    "logreg": _logistic,
}
OF_CLASSES = ("lda", "qda", "logreg")


def mice(df: DataFrame, columns: Sequence[str], method: str = "norm", sweeps: int = 10, start: str = "mean", within_range: bool = True, logs: bool = False) -> DataFrame:
    """Chained equations: missing cells start at a fill and are predicted from the other columns, column by column.

    Predictions are rescaled into the observed range where ``within_range`` and their width allow.  A model is one
    aggregate; each sweep is written as a table, so lineage stays short and executors may be lost.  With ``logs`` the columns
    are modelled as logarithms, which keeps the results above zero.  A column without any value stays without."""
    if method not in METHODS:
        raise ValueError(f"{method!r} is none of {sorted(METHODS)}")
    df = log_in(df, columns) if logs else df
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count(c).alias(c) for c in columns)).first()
    columns = [c for c in columns if counts[c]]
    gaps = [c for c in columns if counts[c] < counts["_n"]]
    now = fill(df.withColumns({f"_gap_{c}": F.col(c).isNull() for c in gaps}), columns, start)
    now = now.withColumns({c: F.col(c).cast("double") for c in columns})
    ranges = df.agg(*(f(c) for c in gaps for f in (F.min, F.max))).first() if gaps else ()
    for sweep in range(sweeps if gaps else 0):
        for k, target in enumerate(gaps):
            others = [c for c in columns if c != target]
            guess = METHODS[method](now.where(~F.col(f"_gap_{target}")), target, others)
            if within_range and method not in OF_CLASSES:
                low, high = now.where(F.col(f"_gap_{target}")).agg(F.min(guess), F.max(guess)).first()
                if low is not None and high > low:
                    guess = rescale(guess, F.lit(low), F.lit(high), float(ranges[2 * k]), float(ranges[2 * k + 1]))
            now = now.withColumn(target, F.when(F.col(f"_gap_{target}"), guess).otherwise(F.col(target)))
        now = cut(now, "sweep")
    done = now.select(*df.columns)
    return exp_out(done, columns) if logs else done


def impute(df: DataFrame, key: str, columns: Sequence[str], method: str = "mean", by: str | None = None, k: int = 3) -> DataFrame:
    """Infinite cells count as missing; ``mean`` fills by the column's mean, ``pmm`` by the nearest rows in ``by``."""
    own = finite_only(df, columns)
    if method == "mean":
        return fill(own, columns, "mean")
    if method != "pmm" or by is None:
        raise ValueError(f"no such way to fill: {method!r}, by {by!r}")
    for c in columns:
        found = nearest_mean(own, key, c, by, k).select(F.col(key).alias("_key"), "value")
        own = own.join(found, F.col(key) == F.col("_key"), "left").withColumn(c, F.coalesce(F.col(c).cast("double"), "value")).drop("_key", "value")
    return own


#: Known rows of a range.
RANGE = 50_000


def nearest_mean(df: DataFrame, key: str, target: str, by: str, k: int = 3) -> DataFrame:
    """``(key, value)`` for rows without ``target``: the mean of the k known rows nearest in ``by``, weighted by inverse
    distance (1e-12 at least); of equally near rows those of the smaller key.

    Known rows are dealt in order of ``by`` into ranges of RANGE rows, each with the k rows before and after it; of equal
    values only the k smallest keys can matter.  Values asked for meet their range's rows, salted where they are many."""
    spark = df.sparkSession
    own = df.select(F.col(key).alias("k"), F.col(target).cast("double").alias("y"), F.col(by).cast("double").alias("x")).where("x is not null")
    first = F.row_number().over(Window.partitionBy("x").orderBy("k"))
    known = cut(numbered(own.where("y is not null").withColumn("r", first).where(F.col("r") <= k).drop("r"), ["x", "k"], "place").withColumn("p", F.floor(F.col("place") / RANGE)))
    open_ = own.where("y is null").select("k", "x")
    asked = cut(open_.select("x").distinct())
    lows = sorted((r[0], r[1]) for r in known.groupBy("p").agg(F.min("x")).collect())  # a row a range
    starts = np.array([x for _, x in lows], float)
    salts = max(1, asked.count() // max(RANGE * len(lows), 1))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0)
            part = np.maximum(np.searchsorted(starts, x.to_numpy(), "right") - 1, 0)
            yield pa.RecordBatch.from_arrays([x, pa.array(part, pa.int64())], names=["x", "p"])

    near = known.select("k", "x", "y", "place", "p")
    at = F.col("place") % RANGE
    near = near.unionByName(near.where(at < k).withColumn("p", F.col("p") - 1)).unionByName(near.where(at >= RANGE - k).withColumn("p", F.col("p") + 1))
    near = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    of = asked.mapInArrow(dealt, "x double, p long").withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(salts)).cast("int"))

    def answer(points: pa.Table, xs: pa.Table) -> pa.Table:
        place = points.column("place").to_numpy()
        order = np.argsort(place)
        px, py, keys = (points.column(c).to_numpy()[order] for c in ("x", "y", "k"))
        ask = xs.column("x").to_numpy()
        if not len(px) or not len(ask):
            return pa.table({"x2": pa.array([], pa.float64()), "value": pa.array([], pa.float64())})
        n = min(k, len(px))
        # Of equal values the smaller keys come first: so k runs of equal values before, and k rows from each run's start on.
        runs, below, spots = np.searchsorted(px, px), np.searchsorted(px, ask)[:, None], []
        spots.append(below + np.arange(k))
        for _ in range(k):
            run = np.where(below > 0, runs[np.maximum(below - 1, 0)], -k)
            spots.append(np.where(run + np.arange(k) < below, run + np.arange(k), -1))
            below = np.maximum(run, 0)
        spots = np.concatenate(spots, axis=1)
        spots = np.sort(np.where((spots >= 0) & (spots < len(px)), spots, -1), axis=1)
        fresh = np.concatenate([np.ones((len(spots), 1), bool), spots[:, 1:] != spots[:, :-1]], axis=1) & (spots >= 0)
        d = np.where(fresh, np.abs(px[spots] - ask[:, None]), np.inf)
        by_ = np.lexsort((keys[spots], d), axis=1)[:, :n]
        d, spots = np.take_along_axis(d, by_, 1), np.take_along_axis(spots, by_, 1)
        w = np.where(np.isfinite(d), 1 / np.maximum(d, 1e-12), 0.0)
        return pa.table({"x2": pa.array(ask), "value": pa.array((w * py[spots]).sum(1) / w.sum(1))})

    got = near.groupBy("p", "salt").cogroup(of.groupBy("p", "salt")).applyInArrow(answer, "x2 double, value double")
    return open_.join(got, F.col("x") == F.col("x2")).select(F.col("k").alias(key), "value")


def ks(df: DataFrame, sample: str, value: str, ranges: int = 32) -> DataFrame:
    """``(statistic, n1, n2)``: the greatest distance of two empirical distributions; ``sample`` is 0 or 1.

    Running counts are kept within ranges of the value and joined with one row a range."""
    own = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(sample) == 0).alias("a"), F.count_if(F.col(sample) == 1).alias("b"))
    placed = own.repartitionByRange(ranges, "v").withColumn("p", F.spark_partition_id())
    turn = Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = placed.select("p", F.sum("a").over(turn).alias("a"), F.sum("b").over(turn).alias("b"))
    total = placed.groupBy("p").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    start = total.select("p", *(F.coalesce(F.sum(f"t{c}").over(before), F.lit(0)).alias(f"{c}0") for c in "ab"), *(F.sum(f"t{c}").over(all_).alias(f"n{c}") for c in "ab"))
    gap = F.abs((F.col("a") + F.col("a0")) / F.nullif(F.col("na"), F.lit(0)) - (F.col("b") + F.col("b0")) / F.nullif(F.col("nb"), F.lit(0)))
    return within.join(F.broadcast(start), "p").agg(F.max(gap).alias("statistic"), F.max("na").alias("n1"), F.max("nb").alias("n2"))


def ks_p_value(statistic: float, n1: int, n2: int) -> float:
    """Asymptotic two-sided p-value."""
    z = math.sqrt(n1 * n2 / (n1 + n2)) * statistic
    if z < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * z * z) for j in range(1, 101))))
