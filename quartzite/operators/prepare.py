"""Preparing tables: filters, derived columns, missing values, scaling, labels, sampling.

Every function takes a DataFrame and returns one; statistics of columns are one aggregate whose single row is joined
back by broadcast, so tables are scanned twice at most and never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartzite.functions.columns import FILLS, finite, rescale, zero_to_null

_FORMULA = re.compile(r"[\w\s.+\-*/%()<>=!,`&|]*")
_FUNCTIONS = frozenset("abs sqrt exp ln log10 power greatest least euclidean and or not in is null between".split())


def _checked(formula: str, columns: Sequence[str]) -> str:
    """A formula over column names, numbers, arithmetic and a few functions; anything else is refused."""
    if not _FORMULA.fullmatch(formula):
        raise ValueError(f"characters that a formula cannot have: {formula!r}")
    for name in re.findall(r"[A-Za-z_]\w*", formula):
        if name not in columns and name.lower() not in _FUNCTIONS:
            raise ValueError(f"{name!r} is neither a column nor a function of formulas")
    return re.sub(r"euclidean\s*\(([^(),]+),([^(),]+)\)", r"abs((\1) - (\2))", formula)


def keep(df: DataFrame, predicates: Sequence[str]) -> DataFrame:
    return reduce(lambda d, p: d.where(_checked(p, d.columns)), predicates, df)


def derive(df: DataFrame, formulas: dict[str, str]) -> DataFrame:
    return reduce(lambda d, kv: d.withColumn(kv[0], F.expr(_checked(kv[1], d.columns))), formulas.items(), df)


def numeric(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in without]


def with_stats(df: DataFrame, stats: dict[str, Column]) -> DataFrame:
    """``df`` with aggregates over all its rows on every row."""
    return df.crossJoin(F.broadcast(df.agg(*(c.alias(n) for n, c in stats.items()))))  # one row


def each(df: DataFrame, columns: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({c: fn(F.col(c)) for c in columns})


def zeros_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return each(df, columns, zero_to_null)


def finite_only(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return each(df, columns, finite)


def fill(df: DataFrame, columns: Sequence[str], method: str = "mean") -> DataFrame:
    """Missing cells become the column's zero, mean, median, min, max, geo(metric) or harmonic mean."""
    own = with_stats(df, {f"_{c}": FILLS[method](F.col(c)) for c in columns})
    return own.withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in columns}).select(*df.columns)


def standardise(df: DataFrame, columns: Sequence[str], sample: bool = False) -> DataFrame:
    """(x - mean) / std, of the population unless ``sample``; a constant column becomes 0."""
    std = F.stddev_samp if sample else F.stddev_pop
    own = with_stats(df, {f"_{c}{k}": f(c) for c in columns for k, f in (("m", F.avg), ("s", std))})
    return own.withColumns({c: (F.col(c) - F.col(f"_{c}m")) / F.when(F.col(f"_{c}s") > 0, F.col(f"_{c}s")).otherwise(1.0) for c in columns}).select(*df.columns)


def min_max(df: DataFrame, columns: Sequence[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    own = with_stats(df, {f"_{c}{k}": f(c) for c in columns for k, f in (("a", F.min), ("b", F.max))})
    return own.withColumns({c: rescale(F.col(c), F.col(f"_{c}a"), F.col(f"_{c}b"), low, high) for c in columns}).select(*df.columns)


_NORMS = {"l1": lambda c: F.sum(F.abs(c)), "l2": lambda c: F.sqrt(F.sum(c * c)), "max": lambda c: F.max(F.abs(c))}


def normalise(df: DataFrame, columns: Sequence[str], norm: str = "l1") -> DataFrame:
    """Columns over their norm."""
    own = with_stats(df, {f"_{c}": _NORMS[norm](F.col(c)) for c in columns})
    return own.withColumns({c: F.col(c) / F.nullif(F.col(f"_{c}"), F.lit(0.0)) for c in columns}).select(*df.columns)


def logarithm(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return each(df, columns, lambda c: F.when(c > 0, F.log10(c)))


def log_in(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Natural logarithms, before a model; NULL for what is not above zero."""
    return each(df, columns, lambda c: F.when(c > 0, F.ln(c)))


def exp_out(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Back from logarithms, after a model."""
    return each(df, columns, F.exp)


def reset_types(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns in the types of ``schema``; fractions become whole by rounding, halves to the even number."""
    kinds = {f.name: f.dataType for f in schema.fields if f.name in df.columns}
    whole = lambda c, t: F.bround(F.col(c)).cast(t) if isinstance(t, T.IntegralType) else F.col(c).cast(t)
    return df.withColumns({c: whole(c, t) for c, t in kinds.items() if df.schema[c].dataType != t})


def as_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers that are labels as text."""
    return each(df, columns, lambda c: c.cast("string")) if columns else df


def split_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Names of the columns of numbers, and of all others."""
    numbers = numeric(df)
    return numbers, [c for c in df.columns if c not in numbers]


def normalise_rows(df: DataFrame, columns: Sequence[str], norm: str = "l2") -> DataFrame:
    """Each row's columns over their norm (``l1``, ``l2`` or ``max``); NULL where that is zero, missing cells count as zero."""
    size = [F.abs(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in columns]
    if norm not in _NORMS:
        raise ValueError(f"{norm!r} is none of {sorted(_NORMS)}")
    total = F.greatest(*size) if norm == "max" and len(size) > 1 else size[0] if norm == "max" else reduce(lambda a, b: a + b, size if norm == "l1" else [x * x for x in size])
    by = F.nullif(F.sqrt(total) if norm == "l2" else total, F.lit(0.0))
    return df.withColumns({c: F.col(c) / by for c in columns})


def drop_empty_columns(df: DataFrame) -> DataFrame:
    counts = df.agg(*(F.count(c).alias(c) for c in df.columns)).first()
    return df.drop(*(c for c in df.columns if not counts[c]))


def drop_zero_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with every column zero go; a missing cell is not zero."""
    return df.where(reduce(lambda a, b: a | b, (F.coalesce(F.col(c) != 0, F.lit(True)) for c in columns)))


def missing_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, n_missing, ratio)``."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    long = one.select("_n", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_missing")) for c in columns))).alias("x"))
    return long.select("x.feature", "x.n_missing", (F.col("x.n_missing") / F.nullif(F.col("_n"), F.lit(0))).alias("ratio"))


def missing_patterns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each pattern of missing cells as a string of 0 and 1 in column order, and its number of rows."""
    return df.groupBy(F.concat(*(F.col(c).isNull().cast("int").cast("string") for c in columns)).alias("pattern")).agg(F.count(F.lit(1)).alias("n_rows"))


def pattern_rows(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``(key, pattern)``: which rows have which pattern of missing cells."""
    return df.select(key, F.concat(*(F.col(c).isNull().cast("int").cast("string") for c in columns)).alias("pattern"))


def null_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """1 for a missing cell, 0 for a value."""
    return each(df, columns, lambda c: c.isNull().cast("int"))


def missing_cells(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``(key, feature)`` of every missing cell."""
    return df.select(key, F.explode(F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns)))).alias("feature"))


def group_summary(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Size of each group and the mean of its columns' sample standard deviations."""
    spread = reduce(lambda a, b: a + b, (F.stddev_samp(c) for c in columns)) / float(len(columns))
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"), spread.alias("mean_std"))


def centroids(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(label).agg(*(F.avg(c).alias(c) for c in columns))


def feature_importance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, variance, share)``: sample variances and their shares of the total."""
    one = df.agg(*(F.var_samp(c).alias(c) for c in columns))
    total = reduce(lambda a, b: a + b, (F.col(c) for c in columns))
    long = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("variance"), (F.col(c) / F.nullif(total, F.lit(0.0))).alias("share")) for c in columns))).alias("x"))
    return long.select("x.*")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, r)`` of every pair of columns in order."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs))).alias("x")).select("x.*")


def correlated_columns(df: DataFrame, columns: Sequence[str], above: float = 0.95) -> list[str]:
    """Of each pair that correlates too highly, the later column."""
    return sorted({r["b"] for r in correlations(df, columns).where(F.abs("r") > above).collect()})  # one row a pair


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def frequencies(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    own = df.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), column)
    return own.limit(top) if top else own


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, n, mean, std, least, q1, median, q3, most)``."""
    of = lambda c: F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("least"), *(F.percentile(c, q).alias(n) for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))), F.max(c).cast("double").alias("most"))
    return df.agg(*(of(c).alias(f"x{i}") for i, c in enumerate(columns))).select(F.explode(F.array(*(f"x{i}" for i in range(len(columns))))).alias("x")).select("x.*")


def encode_labels(df: DataFrame, column: str, out: str) -> DataFrame:
    """Labels numbered from 0 in sorted order; only the distinct labels are ordered."""
    codes = df.select(column).distinct().where(F.col(column).isNotNull()).withColumn(out, F.row_number().over(Window.orderBy(column)) - 1)
    return df.join(F.broadcast(codes) if codes.count() <= 100_000 else codes, column, "left")


def rank_by_duration(df: DataFrame, label: str, duration: str, out: str = "rank") -> DataFrame:
    """``(label, total, rank)``: labels by descending total duration, 0 the longest, ties by label."""
    total = df.groupBy(label).agg(F.sum(duration).alias("total"))
    return total.withColumn(out, F.row_number().over(Window.orderBy(F.desc("total"), label)) - 1)


def relabel_by_duration(df: DataFrame, label: str, duration: str, keep: int | None = None, noise: Sequence = ()) -> DataFrame:
    """Labels become their rank by total duration, from 0; rows of a ``noise`` label go, and with ``keep`` those of a later rank."""
    own = df.where(~F.col(label).isin(*noise)) if noise else df
    ranks = rank_by_duration(own, label, duration, "_rank").select(F.col(label).alias("_label"), F.col("_rank"))
    out = own.join(ranks, F.col(label).eqNullSafe(F.col("_label"))).withColumn(label, F.col("_rank").cast("long"))
    return (out.where(F.col("_rank") < keep) if keep is not None else out).select(*df.columns)


def balanced_counts(df: DataFrame, label: str, to_largest: bool = True) -> DataFrame:
    """``(label, n_rows, target)``: how many rows each class has after resampling to the largest or smallest."""
    own = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    return with_stats(own, {"target": (F.max if to_largest else F.min)("n_rows")})


def per_group(df: DataFrame, label: str, k: int, key: str, seed: int = 10) -> DataFrame:
    """``k`` rows a group, by a hash of the key."""
    turn = Window.partitionBy(label).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return df.withColumn("_t", F.row_number().over(turn)).where(F.col("_t") <= k).drop("_t")


def mahalanobis(df: DataFrame, columns: Sequence[str], out: str = "distance") -> DataFrame:
    """Squared Mahalanobis distance from the mean, under the sample covariance; columns that depend on each other count
    once, by the pseudo-inverse."""
    import numpy as np

    n = len(columns)
    row = df.agg(*(F.avg(c) for c in columns), *(F.covar_samp(a, b) for a in columns for b in columns)).first()
    if any(v is None for v in row):
        return df.withColumn(out, F.lit(None).cast("double"))
    mean, inverse = row[:n], np.linalg.pinv(np.array(row[n:], float).reshape(n, n), hermitian=True)
    diff = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, mean, strict=True)]
    return df.withColumn(out, reduce(lambda a, b: a + b, (diff[i] * diff[j] * float(inverse[i, j]) for i in range(n) for j in range(n))))


def mean_mahalanobis(df: DataFrame, columns: Sequence[str]) -> float | None:
    return mahalanobis(df, columns, "_d").agg(F.avg("_d")).first()[0]
