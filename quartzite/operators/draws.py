"""Random draws of rows, exact in number, over tables of any size.

A table is written once with the number of each row's partition; each of these parts tells its weight, the driver draws
places, and the parts hand out the rows there.  Only a number a part reaches the driver.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.storage import cut


def with_replacement(df: DataFrame, size: int, weight: str | None = None, bags: int = 1, seed: int = 0, bag: str = "bag") -> DataFrame:
    """``bags`` independent draws of ``size`` rows each, a row's chance in proportion to its weight; ``bag`` numbers them.

    Without a weight, or if all are zero, all rows are as likely.  An empty table gives an empty result."""
    usual = F.greatest(F.coalesce(F.nanvl(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
    held = cut(df.withColumn("_weight", usual).withColumn("_part", F.spark_partition_id()))
    names = [*df.columns, bag]
    rows = sorted(map(tuple, held.groupBy("_part").agg(F.count(F.lit(1)), F.sum("_weight")).collect()))  # a row a part
    even = not any(w > 0 for _, _, w in rows)
    mass = np.array([n if even else w for _, n, w in rows], float)
    rng = np.random.default_rng(seed)
    picks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if mass.sum() > 0:
        ends = np.cumsum(mass)
        place = rng.random(size * bags) * ends[-1]
        part = np.minimum(np.searchsorted(ends, place, "right"), int(np.flatnonzero(mass)[-1]))
        for p in np.unique(part).tolist():
            own = np.flatnonzero(part == p)
            picks[rows[p][0]] = (place[own] - (ends[p] - mass[p]), own // size)

    def draw(table: pa.Table) -> pa.Table:
        place, to = picks.get(table.column("_part")[0].as_py(), (np.zeros(0), np.zeros(0, int)))
        w = np.ones(table.num_rows) if even else table.column("_weight").to_numpy()
        reach = np.cumsum(w)
        mine = np.minimum(np.searchsorted(reach, place, "right"), int(np.flatnonzero(w)[-1]) if w.any() else 0)
        return table.drop(["_weight", "_part"]).take(pa.array(mine)).append_column(bag, pa.array(to, pa.int32())).select(names)

    some = held.where(F.col("_part").isin(*picks)) if 0 < len(picks) <= 1000 else held
    return some.groupBy("_part").applyInArrow(draw, df.withColumn(bag, F.lit(0)).schema)


def without_replacement(df: DataFrame, size: int, weight: str | None = None, bags: int = 1, seed: int = 0, bag: str = "bag") -> DataFrame:
    """``bags`` draws of ``size`` distinct rows, heavier rows likelier: those with the least -ln(u) / weight."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    one = lambda b: df.withColumn(bag, F.lit(b)).withColumn("_k", -F.ln(1.0 - F.rand(seed + b)) / F.when(w > 0, w)).where("_k is not null").orderBy("_k").limit(size).drop("_k")
    return reduce(DataFrame.unionByName, (one(b) for b in range(bags)))


def balanced(df: DataFrame, label: str, to_largest: bool = True, seed: int = 4, majority: bool = True) -> DataFrame:
    """Every class at the size of the largest (or smallest), exactly: drawn with replacement, or, of a class that has too
    many rows, without.  ``majority`` False leaves classes of that size as they are."""
    held = cut(df)
    sizes = {r[0]: r[1] for r in held.groupBy(label).count().collect()}  # a row a class
    if not sizes:
        return df
    target = (max if to_largest else min)(sizes.values())
    out = []
    for k, (name, n) in enumerate(sorted(sizes.items(), key=lambda x: str(x[0]))):
        own = held.where(F.col(label).eqNullSafe(F.lit(name)))
        if n == target and not majority:
            out.append(own)
        elif n > target:
            out.append(without_replacement(own, target, seed=seed + k).select(*df.columns))
        else:
            out.append(with_replacement(own, target, seed=seed + k, bag="_bag").select(*df.columns))
    return reduce(DataFrame.unionByName, out)


def sample(df: DataFrame, fraction: float = 1.0, replace: bool = False, seed: int = 1) -> DataFrame:
    """A share of the rows, in expectation; all of them for a share of 1."""
    return df if fraction == 1.0 and not replace else df.sample(replace, fraction, seed)
