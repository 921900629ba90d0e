"""Bilinear maps of a regular grid's cells onto quadrilaterals, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coefficients(corners: DataFrame) -> DataFrame:
    """``(cell, a1..a8)`` from ``(cell, x0, y0, l, w, x00, y00, x10, y10, x01, y01, x11, y11)``.

    (x0, y0) is a cell's corner, l and w its sides; xij, yij are where the corner i along x and j along y goes.  The map is
    x' = a1 + a2 u + a3 v + a4 uv, y' = a5 + a6 u + a7 v + a8 uv with u = (x - x0) / l, v = (y - y0) / w."""
    of = lambda c: (F.col(f"{c}00"), F.col(f"{c}10") - F.col(f"{c}00"), F.col(f"{c}01") - F.col(f"{c}00"), F.col(f"{c}11") - F.col(f"{c}10") - F.col(f"{c}01") + F.col(f"{c}00"))
    return corners.select("cell", "x0", "y0", "l", "w", *(c.alias(f"a{i + 1}") for i, c in enumerate((*of("x"), *of("y")))))


def forward(points: DataFrame, x: str, y: str, origin: tuple[float, float], side: tuple[float, float], columns: int, cells: DataFrame) -> DataFrame:
    """``points`` with ``new_x`` and ``new_y``; NULL outside the grid.  Cells are numbered row by row along x."""
    i, j = F.floor((F.col(x) - origin[0]) / side[0]), F.floor((F.col(y) - origin[1]) / side[1])
    own = points.withColumn("_c", F.when((i >= 0) & (i < columns) & (j >= 0), j * columns + i))
    near = own.join(F.broadcast(cells), F.col("_c") == F.col("cell"), "left")  # as many rows as the grid has cells
    u, v = (F.col(x) - F.col("x0")) / F.col("l"), (F.col(y) - F.col("y0")) / F.col("w")
    at = lambda k: F.col(f"a{k}") + F.col(f"a{k + 1}") * u + F.col(f"a{k + 2}") * v + F.col(f"a{k + 3}") * u * v
    return near.withColumn("new_x", at(1)).withColumn("new_y", at(5)).select(*points.columns, "new_x", "new_y")


def backward(points: DataFrame, x: str, y: str, cells: DataFrame, cell: str = "cell") -> DataFrame:
    """``points`` (with their cell) with ``old_x`` and ``old_y``: the root of the quadratic in v that lies in the cell,
    the first of two; NULL if none does."""
    own = points.join(F.broadcast(cells.withColumnRenamed("cell", "_cell")), F.col(cell) == F.col("_cell"), "left")
    p, q = F.col(x) - F.col("a1"), F.col(y) - F.col("a5")
    # p = a2 u + a3 v + a4 uv and q = a6 u + a7 v + a8 uv; eliminating u leaves A v^2 + B v + C = 0.
    a = F.col("a4") * F.col("a7") - F.col("a3") * F.col("a8")
    b = F.col("a2") * F.col("a7") - F.col("a3") * F.col("a6") + p * F.col("a8") - q * F.col("a4")
    c = p * F.col("a6") - q * F.col("a2")
    root = F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0)))
    flat = F.abs(a) < 1e-12
    own = own.withColumn("_vs", F.when(flat, F.array(-c / F.nullif(b, F.lit(0.0)))).when(b * b - 4 * a * c >= 0, F.array((-b - root) / (2 * F.nullif(a, F.lit(0.0))), (-b + root) / (2 * F.nullif(a, F.lit(0.0))))))
    u_of = lambda v: F.coalesce((p - F.col("a3") * v) / F.nullif(F.col("a2") + F.col("a4") * v, F.lit(0.0)), (q - F.col("a7") * v) / F.nullif(F.col("a6") + F.col("a8") * v, F.lit(0.0)))
    tried = F.transform("_vs", lambda v: F.struct(u_of(v).alias("u"), v.alias("v")))
    inside = F.filter(tried, lambda r: (r["u"] >= -1e-9) & (r["u"] <= 1 + 1e-9) & (r["v"] >= -1e-9) & (r["v"] <= 1 + 1e-9))
    own = own.withColumn("_r", F.get(inside, F.lit(0)))
    return own.withColumn("old_x", F.col("x0") + F.col("_r.u") * F.col("l")).withColumn("old_y", F.col("y0") + F.col("_r.v") * F.col("w")).select(*points.columns, "old_x", "old_y")
