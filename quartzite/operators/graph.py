"""Nearest-neighbour graphs as edge tables, and what is computed on them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartzite.functions.columns import rbf

#: Vectors of one block: 4,096 vectors of 1,024 dimensions are 32 MB.
BLOCK = 4096


def optimal_k(n: int) -> int:
    """The root of n rounded, and the next number if that is even."""
    k = round(n**0.5)
    return k + 1 if k % 2 == 0 else k


def _nearest(of: np.ndarray, ids: np.ndarray, to: np.ndarray, others: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k nearest of each row, by exact distances of all that are as near as the k-th but for rounding."""
    size = (to**2).sum(1)
    for at in range(0, len(of), 256):
        part, mine = of[at : at + 256], ids[at : at + 256]
        own = (part**2).sum(1)
        d = own[:, None] + size - 2 * part @ to.T
        last = min(k, d.shape[1] - 1)  # one more, as a row itself is among the others
        row, col = np.nonzero(d <= (np.partition(d, last, axis=1)[:, last] + 1e-10 * (own + size.max()))[:, None])
        ok = others[col] != mine[row]
        row, col = row[ok], col[ok]
        exact = np.sqrt(((part[row] - to[col]) ** 2).sum(1))
        order = np.lexsort((others[col], exact, row))
        row, col, exact = row[order], col[order], exact[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        ok = place < k
        yield mine[row[ok]], others[col[ok]], exact[ok]


def knn(vectors: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """``(src, dst, distance)`` of the k nearest others of every vector, exact; ties by the smaller key.

    Vectors are dealt into b blocks; every pair of blocks is one group of two blocks' rows, whose k nearest are merged
    per source.  A task holds two blocks whatever the number of vectors; each row is copied b times.
    """
    n = vectors.count()
    blocks = max(1, -(-n // BLOCK))
    own = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sides = own.select("id", "v", F.col("block").alias("a"), every.alias("b"), F.lit(0).alias("side")).unionByName(own.select("id", "v", every.alias("a"), F.col("block").alias("b"), F.lit(1).alias("side")))

    def join(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids = table.column("id").to_numpy()
        v = np.array(table.column("v").to_pylist(), float).reshape(len(ids), -1)
        one, two = side == 0, side == 1
        got = list(_nearest(v[one], ids[one], v[two], ids[two], k)) if one.any() and two.any() else []
        src, dst, dist = (np.concatenate(c) for c in zip(*got, strict=True)) if got else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "distance": pa.array(dist, pa.float64())})

    near = sides.groupBy("a", "b").applyInArrow(join, "src long, dst long, distance double")
    if blocks == 1:
        return near
    return near.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))).where(F.col("_r") <= k).drop("_r")


def mutual(edges: DataFrame) -> DataFrame:
    """Edges that run both ways."""
    back = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return edges.join(back, ["src", "dst"], "left_semi")


def weighted(edges: DataFrame, gamma: float = 0.5) -> DataFrame:
    return edges.withColumn("weight", rbf(F.col("distance"), gamma))


def degrees(edges: DataFrame) -> DataFrame:
    """``(id, out_degree, in_degree)``."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def merge(a: DataFrame, b: DataFrame, weight: str = "distance", cap: int | None = None) -> DataFrame:
    """Both graphs' edges, the smaller weight where both have one; at most ``cap`` edges leave a vertex."""
    own = a.select("src", "dst", weight).unionByName(b.select("src", "dst", weight)).groupBy("src", "dst").agg(F.min(weight).alias(weight))
    if cap is None:
        return own
    return own.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy(weight, "dst"))).where(F.col("_r") <= cap).drop("_r")


def laplacian_scores(vectors: DataFrame, key: str, vector: str, edges: DataFrame, weight: str = "weight") -> DataFrame:
    """``(feature, score)``: the size of f'Lf for each dimension f, centred by out-degree; L = D - W of the directed
    graph."""
    w = edges.select("src", "dst", F.col(weight).alias("w"))
    d = w.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d"))
    v = vectors.select(F.col(key).cast("long").alias("id"), F.posexplode(F.col(vector).cast("array<double>")).alias("feature", "f"))
    deg = v.join(d, "id", "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    mean = deg.groupBy("feature").agg((F.sum(F.col("f") * F.col("d")) / F.sum("d")).alias("m"))
    hat = deg.join(F.broadcast(mean), "feature").select("id", "feature", "d", (F.col("f") - F.col("m")).alias("h"))  # one row a dimension
    first = hat.groupBy("feature").agg(F.sum(F.col("d") * F.col("h") * F.col("h")).alias("dd"))
    arrays = hat.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "h"))), lambda x: x["h"]).alias("hs"))
    both = w.join(arrays.select(F.col("id").alias("src"), F.col("hs").alias("a")), "src").join(arrays.select(F.col("id").alias("dst"), F.col("hs").alias("b")), "dst")
    cross = both.select("w", F.posexplode(F.zip_with("a", "b", lambda x, y: x * y)).alias("feature", "ab")).groupBy("feature").agg(F.sum(F.col("w") * F.col("ab")).alias("ww"))
    return first.join(cross, "feature").select("feature", F.abs(F.col("dd") - F.col("ww")).alias("score"))


def undirected(edges: DataFrame, weight: str = "distance") -> DataFrame:
    """``(a, b, weight)``, one edge for both ways; where they differ, that of the greater source."""
    both = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return both.agg(F.max_by(weight, "src").alias(weight))


def vertices(edges: DataFrame) -> DataFrame:
    """``(id)`` of all ends."""
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def update(edges: DataFrame, changes: DataFrame, weight: str = "distance", smallest: bool = True) -> DataFrame:
    """Edges with new weights, taken only if smaller (or always); changes to edges that are not there are left out."""
    got = edges.join(changes.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col(weight).alias("_w")), (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left")
    return got.select("src", "dst", (F.least(weight, "_w") if smallest else F.coalesce("_w", weight)).alias(weight))


def adjacency_matrix(edges: DataFrame, weight: str | None = None, most: int = 1000) -> DataFrame:
    """A row for each source, a column for each vertex: 0 and 1, or weights; refused over ``most`` vertices."""
    names = [r[0] for r in vertices(edges).orderBy("id").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"over {most} vertices")
    return edges.groupBy("src").pivot("dst", names).agg(F.max(weight) if weight else F.lit(1)).na.fill(0)
