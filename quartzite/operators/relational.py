"""Plain relational building blocks: distinct counts, arg-minima, rankings, set operations, differences, mappings.

Rankings over whole tables are numbered range by range: each range numbers its own rows and adds how many lie before it,
so no window gathers a table in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzite.storage import cut


def numbered(df: DataFrame, order: Sequence[Column | str], out: str) -> DataFrame:
    """``df`` with each row's place, from 0, in ``order``; order ties yourself, or equals come in any order."""
    placed = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    own = placed.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    start = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return own.join(F.broadcast(start), "_range").withColumn(out, F.col("_place") + F.col("_start") - 1).drop("_range", "_place", "_start")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, n_distinct)``, exact; NULL is no value."""
    one = df.agg(*(F.count_distinct(c).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_distinct")) for c in columns))).alias("x")).select("x.*")


def distinct_ids(df: DataFrame, parts: Sequence[str], out: str = "object_id") -> DataFrame:
    """Distinct ids made of parts, joined by dots."""
    return df.select(F.concat_ws(".", *(F.col(c).cast("string") for c in parts)).alias(out)).distinct()


def with_mean_row(df: DataFrame, label: str, columns: Sequence[str], name: str = "mean") -> DataFrame:
    """``df`` and a row of its columns' means, labelled ``name``."""
    total = df.agg(*(F.avg(c).alias(c) for c in columns)).select(F.lit(name).alias(label), *columns)
    return df.select(F.col(label).cast("string").alias(label), *(F.col(c).cast("double").alias(c) for c in columns)).unionByName(total)


def mean_scores(df: DataFrame, feature: str, score: str) -> DataFrame:
    """Mean score of each feature over repetitions."""
    return df.groupBy(feature).agg(F.avg(score).alias(score))


def arg_least(df: DataFrame, key: str, by: str, group: Sequence[str] = (), most: bool = False) -> DataFrame:
    """Of each group (or the table) the key with the least (or greatest) ``by``; of equals the smallest key."""
    place = F.struct((-F.col(by) if most else F.col(by)).alias("by"), F.col(key).alias("key"))
    got = df.where(F.col(by).isNotNull()).groupBy(*group).agg(F.min(place).alias("_least"))
    return got.select(*group, F.col("_least.key").alias(key), (-F.col("_least.by") if most else F.col("_least.by")).alias(by))


def ordering(values: Column) -> Column:
    """Places of an array's values, from 0, in ascending order of value; of equals the first place first."""
    placed = F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    return F.transform(F.array_sort(placed), lambda x: x["i"])


def pair_sort(x: Column, y: Column, descending: bool = False) -> Column:
    """``x`` in the order of ``y``; equals in the order they have."""
    pairs = F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p, i: F.struct((-p["y"] if descending else p["y"]).alias("y"), i.alias("i"), p["x"].alias("x")))
    return F.transform(F.array_sort(pairs), lambda p: p["x"])


def first_lines(lines: DataFrame, stop: int, order: str = "line_no") -> DataFrame:
    """The first ``stop`` lines, exactly."""
    return lines.orderBy(order).limit(stop)


def differences(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), out: str = "difference") -> DataFrame:
    """Each row's value less the one before it in its group; NULL for the first."""
    return df.withColumn(out, F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))


def path_differences(path: Column, how: str = "diff") -> Column:
    """Steps along an array: ``diff``, ``diff_abc`` (absolute), ``diff_pro`` (relative to where the step starts) or
    ``diff_pro_abs`` (relative and absolute)."""
    n = F.size(path)
    step = F.when(n > 1, F.zip_with(F.slice(path, 1, n - 1), F.slice(path, 2, n - 1), lambda a, b: (b - a) / F.nullif(a, F.lit(0.0)) if "pro" in how else b - a)).otherwise(F.slice(path, 1, 0))
    if how not in ("diff", "diff_abc", "diff_pro", "diff_pro_abs"):
        raise ValueError(f"{how!r} is no kind of difference")
    return F.transform(step, F.abs) if how in ("diff_abc", "diff_pro_abs") else step


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that just one of both tables has."""
    return a.subtract(b).unionByName(b.subtract(a))


def edge_keys(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keys that both tables have, those of the first alone, those of the second alone."""
    return a.intersect(b), a.subtract(b), b.subtract(a)


def mapped(df: DataFrame, column: str, mapping: dict, out: str | None = None, keep: bool = True) -> DataFrame:
    """Values through a mapping; those without an entry stay as they are, or become NULL.

    The mapping is written by hand, so it is small; above 1,000 entries use ``joined_through``."""
    if len(mapping) > 1000:
        raise ValueError("a mapping of so many entries is a table; use joined_through")
    if not mapping:
        return df.withColumn(out or column, F.col(column) if keep else F.lit(None).cast(dict(df.dtypes)[column]))
    pairs = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    got = F.try_element_at(pairs, F.col(column))
    return df.withColumn(out or column, F.coalesce(got, F.col(column)) if keep else got)


def joined_through(left: DataFrame, right: DataFrame, key: str, value: str, other: str, to: str) -> DataFrame:
    """``(key, to)``: the left table's keys through the right one, where left ``value`` equals right ``other``."""
    return left.select(key, F.col(value).alias("_value")).join(right.select(F.col(other).alias("_other"), to), F.col("_value") == F.col("_other")).select(key, to)


def isin(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose value is in a list, compared as the column's own type."""
    kind = dict(df.dtypes)[column]
    return df.where(F.col(column).isin(*(F.lit(v).cast(kind) for v in values))) if values else df.limit(0)


def ratios(df: DataFrame, columns: Sequence[str], divisor: str, invert: bool = False) -> DataFrame:
    """Columns over a divisor, or the divisor over them; NULL where that is zero."""
    of = lambda c: F.col(divisor) / F.nullif(F.col(c).cast("double"), F.lit(0.0)) if invert else F.col(c) / F.nullif(F.col(divisor).cast("double"), F.lit(0.0))
    return df.withColumns({c: of(c) for c in columns if c != divisor})


def trimmed_names(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.strip() for c in df.columns))


def without_returns(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.withColumn(column, F.regexp_replace(column, "\r", ""))


def first_word(text: Column) -> Column:
    return F.get(F.split(F.trim(F.lower(text)), r"\s+"), F.lit(0))


def factorised(df: DataFrame, column: str, order: str, out: str = "code") -> DataFrame:
    """Values numbered from 0 in order of first appearance; NULL is -1."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg(F.min(order).alias("_first"))
    codes = numbered(first, ["_first", "_value"], "_code")
    return df.join(codes, F.col(column) == F.col("_value"), "left").withColumn(out, F.coalesce("_code", F.lit(-1)).cast("long")).drop("_value", "_first", "_code")


def distinct_rows(df: DataFrame, columns: Sequence[str], out: str = "number") -> DataFrame:
    """Distinct rows in sorted order, numbered from 1."""
    return numbered(df.select(*columns).distinct(), list(columns), out).withColumn(out, F.col(out) + 1)


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    """Rows with any (or all) of the columns missing go; NaN counts as missing."""
    return df.dropna(how, subset=list(columns) if columns else None)


def finite_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with every column finite."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return df.where(reduce(lambda a, b: a & b, map(ok, columns), F.lit(True)))


def within_box(df: DataFrame, box: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows whose columns lie between their limits, which belong to the box."""
    return df.where(reduce(lambda a, b: a & b, (F.col(c).between(low, high) for c, (low, high) in box.items()), F.lit(True)))


def selected(df: DataFrame, features: Sequence[str | int], at_least: int = 1) -> DataFrame:
    """Columns by name or place."""
    names = [df.columns[f] if isinstance(f, int) else f for f in features]
    if len(names) > len(df.columns) or len(names) < at_least:
        raise ValueError(f"{len(names)} features asked of {len(df.columns)}")
    return df.select(*names)


def mask(features: Sequence[str], chosen: Sequence[str], binary: bool = False) -> list[int]:
    """Places of the chosen features, or a 0 or 1 for each feature."""
    return [int(f in chosen) for f in features] if binary else [k for k, f in enumerate(features) if f in chosen]


def rejoined(a: DataFrame, b: DataFrame, key: str = "row_id") -> DataFrame:
    """Columns side by side by a row key; rows that one of both lacks have NULL."""
    return a.join(b, key, "full")


def without(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows whose key the other table lacks."""
    return df.join(other.select(F.col(other_key).alias("_other")), F.col(key) == F.col("_other"), "left_anti")


def bins(df: DataFrame, column: str, n: int, out: str = "bin") -> DataFrame:
    """Rows with the number, from 0, of one of ``n`` bins of equal width; the greatest value belongs to the last."""
    span = df.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    place = F.floor((F.col(column) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * n)
    return df.crossJoin(F.broadcast(span)).withColumn(out, F.least(F.coalesce(place, F.when(F.col(column).isNotNull(), F.lit(0))), F.lit(n - 1)).cast("long")).drop("_low", "_high")  # one row
