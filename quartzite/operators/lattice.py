"""What is computed on a trained lattice: boundaries, cells, neighbours, smoothed distances, clusters of neurons.

A codebook has ``som.MAX_NEURONS`` neurons at most, so all of this is NumPy on the driver; ``neuron_clusters`` joins the
outcome with rows.  Neuron i lies at ``divmod(i, columns)``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.operators.som import Lattice

_SIDES = ((-1, 0), (1, 0), (0, -1), (0, 1))
_CORNERS = ((-1, -1), (-1, 1), (1, -1), (1, 1))


def neighbours(lattice: Lattice, star: bool = False) -> dict[int, list[int]]:
    """Each neuron's neighbours to four sides, or, as a star, to eight."""
    out = {}
    for i, (x, y) in enumerate(lattice.places().tolist()):
        near = ((x + a, y + b) for a, b in (_SIDES + _CORNERS if star else _SIDES))
        out[i] = sorted(a * lattice.columns + b for a, b in near if 0 <= a < lattice.rows and 0 <= b < lattice.columns)
    return out


def diagonal_neighbours(lattice: Lattice, neuron: int) -> list[int]:
    return sorted(set(neighbours(lattice, True)[neuron]) - set(neighbours(lattice)[neuron]))


def oriented_edges(lattice: Lattice, vertical: bool = True) -> list[tuple[int, int]]:
    """Pairs of neurons one row (or one column) apart."""
    step = lattice.columns if vertical else 1
    return [(i, i + step) for i in range(lattice.size) if (i + step < lattice.size if vertical else i % lattice.columns < lattice.columns - 1)]


def sides(lattice: Lattice) -> dict[str, list[int]]:
    """Neurons of the four sides; corners belong to two."""
    x, y = lattice.places().T
    return {"top": np.flatnonzero(x == 0).tolist(), "bottom": np.flatnonzero(x == lattice.rows - 1).tolist(), "left": np.flatnonzero(y == 0).tolist(), "right": np.flatnonzero(y == lattice.columns - 1).tolist()}


def boundary(lattice: Lattice) -> list[int]:
    return sorted(set().union(*sides(lattice).values()))


def interior(lattice: Lattice) -> list[int]:
    return sorted(set(range(lattice.size)) - set(boundary(lattice)))


def diagonal(lattice: Lattice, rising: bool = False) -> list[int]:
    """Neurons from one corner of a square lattice to the opposite one."""
    if lattice.rows != lattice.columns:
        raise ValueError("only a square lattice has diagonals")
    return [i * lattice.columns + (lattice.columns - 1 - i if rising else i) for i in range(lattice.rows)]


def cells(lattice: Lattice) -> np.ndarray:
    """Corner neurons of every cell, in turn around it, cells in row order."""
    first = np.array([x * lattice.columns + y for x in range(lattice.rows - 1) for y in range(lattice.columns - 1)], int)
    return np.stack([first, first + lattice.columns, first + lattice.columns + 1, first + 1], axis=1).reshape(-1, 4)


def cell_areas(codebook: np.ndarray, lattice: Lattice, x: int = 0, y: int = 1) -> np.ndarray:
    """Area of each cell over two features, by its corners in turn."""
    px, py = codebook[cells(lattice)][:, :, x], codebook[cells(lattice)][:, :, y]
    return np.abs((px * np.roll(py, -1, 1) - np.roll(px, -1, 1) * py).sum(1)) / 2


def distances(codebook: np.ndarray, unit_columns: bool = False) -> np.ndarray:
    """Distance of every pair of neurons, of columns at length 1 if asked."""
    w = codebook / np.where((n := np.linalg.norm(codebook, axis=0)) > 0, n, 1.0) if unit_columns else codebook
    return np.sqrt(((w[:, None] - w[None]) ** 2).sum(2))


def heat(codebook: np.ndarray, lattice: Lattice, star: bool = False, bandwidth: float | None = None) -> np.ndarray:
    """Mean distance of each neuron to its neighbours, as a matrix; smoothed if a bandwidth is given."""
    d = distances(codebook)
    out = np.array([d[i, js].mean() if js else 0.0 for i, js in neighbours(lattice, star).items()]).reshape(lattice.rows, lattice.columns)
    return smoothed(out, bandwidth) if bandwidth else out


def smoothed(values: np.ndarray, bandwidth: float, power: float = 2.0) -> np.ndarray:
    """Weighted means with weights exp(-(d / bandwidth) ** power), by products of spectra on a doubled grid."""
    if bandwidth <= 0:
        raise ValueError("a bandwidth is above zero")
    n, m = values.shape
    a, b = (np.minimum(np.arange(2 * k), 2 * k - np.arange(2 * k)) for k in (n, m))
    weight = np.fft.rfft2(np.exp(-((np.hypot(a[:, None], b[None]) / bandwidth) ** power)))
    spread = lambda v: np.fft.irfft2(np.fft.rfft2(v, (2 * n, 2 * m)) * weight, (2 * n, 2 * m))[:n, :m]
    return spread(values) / spread(np.ones_like(values))


def descents(values: np.ndarray, one_step: bool = False) -> np.ndarray:
    """For each place the least place that steepest descent over eight neighbours reaches; of equals the first.

    ``one_step`` stops after one."""
    n, m = values.shape
    star = neighbours(Lattice(n, m), True)
    flat = values.ravel()
    to = np.array([min([i, *js], key=lambda j: (flat[j], j != i, j)) for i, js in star.items()])
    while not one_step and (to[to] != to).any():
        to = to[to]
    return to


def neuron_labels(values: np.ndarray, merge_range: float | None = None) -> np.ndarray:
    """Cluster number of each neuron: places with one descent; numbered by their least neurons.

    With ``merge_range`` clusters whose mean heat differs by less than the mean of their spreads times (1 + range) and
    which touch become one, whose least place is its coldest."""
    to, flat = descents(values), values.ravel()
    star = neighbours(Lattice(*values.shape), True)
    while merge_range is not None:
        found = {int(c): np.flatnonzero(to == c) for c in np.unique(to)}
        spread = {c: float(np.abs(flat[i] - flat[c]).mean()) for c, i in found.items()}
        touching = {tuple(sorted((int(to[i]), int(to[j])))) for i, js in star.items() for j in js if to[i] != to[j]}
        near = [(between(flat, found[a], found[b]), a, b) for a, b in sorted(touching)]
        near = [x for x in near if x[0] < (spread[x[1]] + spread[x[2]]) / 2 * (1 + merge_range)]
        if not near:
            break
        _, a, b = min(near)
        own = np.flatnonzero((to == a) | (to == b))
        to[own] = own[np.argmin(flat[own])]
    return np.unique(to, return_inverse=True)[1]


def between(flat: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """Difference of two clusters' mean heat."""
    return float(abs(flat[a].mean() - flat[b].mean()))


def sparsity(values: np.ndarray, labels: np.ndarray) -> dict[int, float]:
    """Mean absolute difference of each cluster's heat from its least."""
    flat = values.ravel()
    return {int(c): float(np.abs(flat[labels == c] - flat[labels == c].min()).mean()) for c in np.unique(labels)}


def cluster_distances(values: np.ndarray, labels: np.ndarray) -> dict[tuple[int, int], float]:
    flat, names = values.ravel(), np.unique(labels).tolist()
    return {(a, b): between(flat, np.flatnonzero(labels == a), np.flatnonzero(labels == b)) for a in names for b in names if a < b}


def neuron_clusters(df: DataFrame, unit: str, labels: np.ndarray, out: str = "cluster") -> DataFrame:
    """``df`` with its neuron's cluster and lattice place; NULL without a neuron."""
    got = df.sparkSession.createDataFrame([(i, int(c)) for i, c in enumerate(labels)], f"_neuron int, `{out}` int")
    return df.join(F.broadcast(got), F.col(unit) == F.col("_neuron"), "left").drop("_neuron")  # a row a neuron


def cosine(a: np.ndarray, b: np.ndarray, signed: bool = True, degrees: bool = False) -> float:
    """Cosine of two vectors within [-1, 1], or the angle; 0 for a vector of no length."""
    size = float(np.linalg.norm(a) * np.linalg.norm(b))
    value = min(1.0, max(-1.0, float(np.dot(a, b)) / size)) if size else 0.0
    value = value if signed else abs(value)
    return float(np.degrees(np.arccos(value))) if degrees else value


def alpha_shape(points: np.ndarray, alpha: float, outer: bool = True) -> set[tuple[int, int]]:
    """Edges of the triangles of a Delaunay triangulation whose circumradius is below ``alpha``; ``outer``: only those of one
    triangle."""
    p = np.asarray(points, float)
    if len(p) < 4:
        return {tuple(sorted((i, j))) for i in range(len(p)) for j in range(i)}
    centre, far = p.mean(0), 1e3 * (np.ptp(p, axis=0).max() or 1.0)
    every = np.vstack([p, centre + far * np.array([[-1, -1], [1, -1], [0, 1]])])
    n = len(p)

    def circle(t: tuple[int, int, int]) -> tuple[float, float, float]:
        (ax, ay), (bx, by), (cx, cy) = every[list(t)]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        if abs(d) < 1e-12:
            return 0.0, 0.0, np.inf
        ux = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
        uy = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
        return ux, uy, (ax - ux) ** 2 + (ay - uy) ** 2

    found = {(n, n + 1, n + 2): circle((n, n + 1, n + 2))}
    for i in range(n):
        gone = [t for t, (x, y, r) in found.items() if (every[i, 0] - x) ** 2 + (every[i, 1] - y) ** 2 < r]
        rim: dict[tuple[int, int], int] = {}
        for t in gone:
            del found[t]
            for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
                rim[tuple(sorted(e))] = rim.get(tuple(sorted(e)), 0) + 1
        for (a, b), times in rim.items():
            if times == 1:
                found[tuple(sorted((a, b, i)))] = circle(tuple(sorted((a, b, i))))
    count: dict[tuple[int, int], int] = {}
    for t, (_, _, r) in found.items():
        if max(t) < n and np.sqrt(r) < alpha:
            for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
                count[e] = count.get(e, 0) + 1
    return {e for e, k in count.items() if k == 1 or not outer}
