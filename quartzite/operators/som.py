"""Self-organising maps: rectangular lattices, training, best-matching units, hits, unified distances, inertia.

A codebook is a small matrix (a lattice is refused above ``MAX_NEURONS`` neurons), held on the driver and sent with
tasks; data stay in their partitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzite.operators.draws import with_replacement

MAX_NEURONS = 4096


@dataclass(frozen=True)
class Lattice:
    """Neurons in row order: neuron i lies at (i // columns, i % columns)."""

    rows: int
    columns: int

    def __post_init__(self):
        if not 0 < self.rows * self.columns <= MAX_NEURONS:
            raise ValueError(f"a lattice has between 1 and {MAX_NEURONS} neurons")

    @property
    def size(self) -> int:
        return self.rows * self.columns

    def places(self) -> np.ndarray:
        return np.stack(np.divmod(np.arange(self.size), self.columns), axis=1)

    def edges(self) -> list[tuple[int, int]]:
        """Neighbours to all four sides, both ways."""
        out = []
        for i in range(self.size):
            x, y = divmod(i, self.columns)
            out += [(i, i + d) for d, ok in ((-self.columns, x > 0), (self.columns, x < self.rows - 1), (-1, y > 0), (1, y < self.columns - 1)) if ok]
        return out


def bounds(df: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least, greatest and mean of each feature."""
    row = df.agg(*(f(c) for f in (F.min, F.max, F.avg) for c in features)).first()
    return tuple(np.array(row, float).reshape(3, -1))


def regular_grid(lattice: Lattice, low: np.ndarray, high: np.ndarray, mean: np.ndarray, grid: Sequence[int] = (0, 1), margin: float = 0.2) -> np.ndarray:
    """Codebook spread evenly over two features, widened by a share of their range; other features at their mean."""
    low, high = np.asarray(low, float), np.asarray(high, float)
    out = np.tile(np.asarray(mean, float), (lattice.size, 1))
    pad = margin * (high - low)
    for axis, (feature, n) in enumerate(zip(grid, (lattice.rows, lattice.columns), strict=True)):
        out[:, feature] = np.linspace(low[feature] - pad[feature], high[feature] + pad[feature], n)[lattice.places()[:, axis]]
    return out


def drawn_rows(df: DataFrame, features: Sequence[str], n: int, seed: int = 0) -> np.ndarray:
    """n rows, each drawn from the whole table with replacement; the driver holds those alone."""
    rows = with_replacement(df.select(*(F.col(c).cast("double") for c in features)).dropna(), n, seed=seed).select(*features).collect()
    out = np.array(rows, float).reshape(-1, len(features))
    return out[np.random.default_rng(seed).permutation(len(out))]  # partitions hand them out in their own order


def initial(df: DataFrame, features: Sequence[str], lattice: Lattice, method: str = "rs", seed: int = 0, margin: float = -0.1) -> np.ndarray:
    """A codebook: ``rs`` drawn rows, ``rc`` uniform within the bounds, ``rpam`` Gaussian around the mean, ``rpaz`` around
    zero, ``rrg`` a regular grid over the first two features."""
    rng, shape = np.random.default_rng(seed), (lattice.size, len(features))
    if method == "rs":
        return drawn_rows(df, features, lattice.size, seed)
    if method == "rpaz":
        return rng.normal(size=shape)
    low, high, mean = bounds(df, features)
    if method == "rc":
        return rng.uniform(low, high, shape)
    if method == "rpam":
        return mean + rng.normal(size=shape)
    if method == "rrg":
        return regular_grid(lattice, low, high, mean, margin=margin)
    raise ValueError(f"{method!r} is no way to begin")


def best_units(df: DataFrame, features: Sequence[str], codebook: np.ndarray, out: str = "bmu", distance: str | None = None) -> DataFrame:
    """``df`` with the nearest neuron of every row, the lowest of equals; NULL where a feature is missing."""
    at, rows = len(df.columns), max(1, (1 << 20) // codebook.size)  # of a block of eight megabytes
    names = [*df.columns, out, *([distance] if distance else [])]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` int" + (f", `{distance}` double" if distance else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, codebook.shape[1])
            bad, unit, least = ~np.isfinite(x).all(1), np.zeros(len(x), np.int32), np.zeros(len(x))
            x = np.nan_to_num(x)
            for low in range(0, len(x), rows):
                d = ((x[low : low + rows, None, :] - codebook[None]) ** 2).sum(2)
                unit[low : low + rows] = d.argmin(1)
                least[low : low + rows] = d.min(1)
            cols = [pa.array(unit, mask=bad)]
            if distance:
                cols.append(pa.array(np.sqrt(least), mask=bad))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *cols], names=names)

    return df.withColumn("_v", F.array(*(F.col(c).cast("double") for c in features))).mapInArrow(run, schema)


def hits(df: DataFrame, unit: str, lattice: Lattice) -> DataFrame:
    """``(neuron, n_rows)`` of every neuron, zeros included."""
    own = df.where(F.col(unit).isNotNull()).groupBy(F.col(unit).cast("long").alias("neuron")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(lattice.size).withColumnRenamed("id", "neuron").join(F.broadcast(own), "neuron", "left").select("neuron", F.coalesce("n", F.lit(0)).alias("n_rows"))


def codebook_table(spark: SparkSession, codebook: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in w]) for i, w in enumerate(codebook)], "neuron long, weights array<double>")


def unified_distances(spark: SparkSession, codebook: np.ndarray, lattice: Lattice) -> DataFrame:
    """``(neuron, distance)``: mean distance to the lattice neighbours."""
    i, j = np.array(lattice.edges()).reshape(-1, 2).T
    d = np.sqrt(((codebook[i] - codebook[j]) ** 2).sum(1))
    mean = np.bincount(i, d, lattice.size) / np.maximum(np.bincount(i, minlength=lattice.size), 1)
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(mean)], "neuron long, distance double")


def _decay(start: float, epoch: int, epochs: int) -> float:
    return start * float(np.exp(-epoch / epochs))


def bubble(places: np.ndarray, winner: int, radius: float, rate: float) -> np.ndarray:
    """The rate for neurons within 1.5 radii of the winner on the lattice, 0 for others."""
    return np.where(np.sqrt(((places - places[winner]) ** 2).sum(1)) < 1.5 * radius, rate, 0.0)


def gravity(x: np.ndarray, codebook: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Mass over squared distance of every neuron; infinite at no distance."""
    d = ((codebook - x) ** 2).sum(1)
    return np.where(d > 0, mass / np.where(d > 0, d, 1.0), np.inf)


def train_online(
    df: DataFrame, features: Sequence[str], lattice: Lattice, codebook: np.ndarray, epochs: int, rate: float = 0.5, radius: float | None = None, seed: int = 0, fixed_edge: bool = False, active: Sequence[str] | None = None, by_mass: bool = False
) -> tuple[np.ndarray, list[float]]:
    """One row an epoch, drawn from the whole table, rate and radius falling exponentially; also each row's squared distance
    to its winner.  The driver holds the drawn rows alone.

    Winners are found by the ``active`` features (all unless given); all features move.  ``by_mass``: the winner is the
    neuron that pulls most, and gains mass by winning.  ``fixed_edge``: neurons of the boundary stay."""
    out, places, trail = codebook.astype(float).copy(), lattice.places(), []
    seen = [list(features).index(c) for c in active or features]
    mass, radius = np.ones(lattice.size), radius or max(lattice.rows, lattice.columns) / 2
    free = ((places > 0) & (places < [lattice.rows - 1, lattice.columns - 1])).all(1) if fixed_edge else np.ones(lattice.size, bool)
    for epoch, x in enumerate(drawn_rows(df, features, epochs, seed)):
        d = ((out[:, seen] - x[seen]) ** 2).sum(1)
        winner = int(gravity(x[seen], out[:, seen], mass).argmax()) if by_mass else int(d.argmin())
        mass[winner] += 1
        trail.append(float(d[winner]))
        pull = bubble(places, winner, _decay(radius, epoch, epochs), _decay(rate, epoch, epochs)) * free
        out += pull[:, None] * (x - out)
    return out, trail


def nearest_units(codebook: np.ndarray, x: np.ndarray, n: int | None = None, mass: np.ndarray | None = None) -> np.ndarray:
    """Neurons in order of distance (or of pull, strongest first) from one point, the first ``n`` of them."""
    by = ((codebook - x) ** 2).sum(1) if mass is None else -gravity(x, codebook, mass)
    return np.argsort(by, kind="stable")[:n]


def train_batch(df: DataFrame, features: Sequence[str], lattice: Lattice, codebook: np.ndarray, epochs: int = 10, radius: float | None = None) -> tuple[np.ndarray, list[float]]:
    """All rows an epoch: each neuron becomes the neighbourhood-weighted mean.  Tasks send sums per neuron, and nothing
    that grows with the rows.  Also the quantisation energy of each epoch."""
    places, energy = lattice.places(), []
    radius = radius or max(lattice.rows, lattice.columns) / 2
    apart = ((places[:, None] - places[None]) ** 2).sum(2)
    for epoch in range(epochs):
        units = best_units(df.select(*features), features, codebook, "_u", "_d").where("_u is not null")
        rows = units.groupBy("_u").agg(F.count(F.lit(1)), F.sum(F.col("_d") * F.col("_d")), *(F.sum(c) for c in features)).collect()  # a row a neuron
        n, total = np.zeros(lattice.size), np.zeros((lattice.size, len(features)))
        for row in rows:
            n[row[0]], total[row[0]] = row[1], row[3:]
        energy.append(float(sum(r[2] for r in rows)))
        r = max(_decay(radius, epoch, epochs), 0.3)
        pull = np.exp(-apart / (2 * r * r))
        weight = pull @ n
        codebook = np.where(weight[:, None] > 1e-12, pull @ total / np.maximum(weight, 1e-12)[:, None], codebook)
    return codebook, energy


def energy(df: DataFrame, features: Sequence[str], codebook: np.ndarray) -> float:
    """Sum of squared distances to the nearest neurons."""
    return float(best_units(df.select(*features), features, codebook, "_u", "_d").agg(F.sum(F.col("_d") * F.col("_d"))).first()[0] or 0.0)


def principal_units(codebook: np.ndarray) -> dict[str, int]:
    """Ends of the primary axis (the farthest pair) and of the secondary one.

    The secondary axis starts at the neuron with the greatest summed distance to both ends and ends at the neuron
    farthest from that."""
    d = np.sqrt(((codebook[:, None] - codebook[None]) ** 2).sum(2))
    a, b = (int(x) for x in np.unravel_index(d.argmax(), d.shape))
    away = d[a] + d[b]
    away[[a, b]] = -1
    c = int(away.argmax()) if len(codebook) > 2 else a
    rest = d[c].copy()
    rest[[a, b, c]] = -1
    return {"primary_low": a, "primary_high": b, "secondary_low": c, "secondary_high": int(rest.argmax()) if len(codebook) > 3 else b}


def inertia(spark: SparkSession, codebook: np.ndarray, features: Sequence[str]) -> DataFrame:
    """``(feature, primary, secondary)``: each feature's share of the way along either axis, scaled to length 1."""
    u = principal_units(codebook)
    axes = [codebook[u[f"{x}_high"]] - codebook[u[f"{x}_low"]] for x in ("primary", "secondary")]
    one, two = (a / (np.linalg.norm(a) or 1.0) for a in axes)
    return spark.createDataFrame(pd.DataFrame({"feature": list(features), "primary": one, "secondary": two}))


def topology_error(df: DataFrame, features: Sequence[str], codebook: np.ndarray, lattice: Lattice) -> float:
    """Share of rows whose two best units are not lattice neighbours."""
    near = set(lattice.edges())
    linked = np.zeros((lattice.size, lattice.size), bool)
    for i, j in near:
        linked[i, j] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(batch.num_rows, -1)
            if len(x):
                two = np.argsort(((x[:, None, :] - codebook[None]) ** 2).sum(2), axis=1, kind="stable")[:, :2]
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([int((~linked[two[:, 0], two[:, -1]]).sum())], pa.int64())], names=["n", "bad"])

    row = df.select(F.array(*(F.col(c).cast("double") for c in features))).mapInArrow(run, "n long, bad long").agg(F.sum("bad") / F.nullif(F.sum("n"), F.lit(0))).first()
    return float(row[0] or 0.0)


def geodesic_path(codebook: np.ndarray, lattice: Lattice, start: int, end: int) -> list[int]:
    """Neurons on the shortest way along lattice edges, by feature distance."""
    import heapq

    nb: dict[int, list[int]] = {}
    for i, j in lattice.edges():
        nb.setdefault(i, []).append(j)
    best, back, heap = {start: 0.0}, {}, [(0.0, start)]
    while heap:
        d, i = heapq.heappop(heap)
        if i == end:
            break
        if d > best[i]:
            continue
        for j in nb.get(i, ()):
            new = d + float(np.linalg.norm(codebook[i] - codebook[j]))
            if new < best.get(j, np.inf):
                best[j], back[j] = new, i
                heapq.heappush(heap, (new, j))
    path = [end]
    while path[-1] != start:
        path.append(back[path[-1]])
    return path[::-1]
