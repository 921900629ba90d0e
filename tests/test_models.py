"""Classifiers, reachability, embeddings and imputation of classes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzite.operators import impute, models
from quartzite.sources import tables


@pytest.fixture(scope="module")
def blobs(spark):
    return tables.make(spark, "blobs", 240, seed=3, centres=((0.0, 0.0), (8.0, 8.0), (-8.0, 8.0))).coalesce(1).cache()


@pytest.mark.parametrize("kernel", ["linear", "poly", "rbf"])
def test_support_vectors(spark, blobs, kernel):
    df = blobs.where("label < 2")
    got = models.support_vectors(df, ["x", "y"], "label", kernel, rounds=8)
    assert set(got) == set(models.MEASURES) and got["accuracy"] > 0.9
    with pytest.raises(ValueError):
        models.support_vectors(df, ["x"], "label", "else")


def test_mixture_and_reachability(spark, blobs):
    got = models.mixture(blobs, ["x", "y"], 3, seed=1)
    assert got.groupBy("label").agg(F.countDistinct("cluster").alias("n")).where("n > 1").count() == 0
    order = models.reachability(blobs, "id", ["x", "y"], min_points=5)
    found = models.cut_reachability(order, "id", 2.5).join(blobs, "id").where("cluster >= 0")
    assert order.count() == 240 and found.count() > 200
    assert found.groupBy("cluster").agg(F.countDistinct("label").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError):
        models.reachability(blobs, "id", ["x", "y"], most=10)


def test_embeddings(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(40, 2)) @ np.array([[1.0, 0.2, 0.5], [0.1, 1.0, -0.4]])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double")
    for method in ("mds", "isomap", "spectral", "lle"):
        got = np.array([tuple(v) for v in models.embedding(df, "id", ["a", "b", "c"], method).orderBy("id").collect()])[:, 1:]
        assert got.shape == (40, 2) and np.isfinite(got).all()
        if method == "mds":  # distances in a plane come back
            d = lambda p: np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
            assert d(got) == pytest.approx(d(x))


@pytest.mark.parametrize("method", ["lda", "qda", "logreg"])
def test_classes_are_filled(spark, blobs, method):
    df = blobs.withColumn("label", F.when(F.col("id") % 6 != 1, F.col("label"))).select("id", "x", "y", "label")
    got = impute.mice(df, ["x", "y", "label"], method, sweeps=1).join(blobs.select("id", F.col("label").alias("truth")), "id")
    assert got.where("label <> truth").count() <= 2 and got.count() == 240


def test_polynomials_are_filled(spark):
    rows = [(i, float(i % 13), None if i % 10 == 0 else float((i % 13) ** 2 - 3)) for i in range(200)]
    got = impute.mice(spark.createDataFrame(rows, "id long, a double, b double"), ["a", "b"], "polyreg", sweeps=1, within_range=False)
    assert got.where("id % 10 = 0 and abs(b - (a * a - 3)) > 0.05").count() == 0


def test_reachability_of_many_rows(spark):
    """Over 3,000 rows, copies and an infinite one among them, in the order of a plain walk."""
    r = np.random.default_rng(5)
    x = np.concatenate((np.tile(r.normal(size=(300, 2)), (9, 1)), r.normal(size=(400, 2)), [[np.inf, 0.0]]))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double")
    d = np.sqrt(((x[:-1, None] - x[None, :-1]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, 11]
    reach, left, order = np.full(len(d), np.inf), np.ones(len(d), bool), []
    while left.any():
        i = int(np.flatnonzero(left)[reach[left].argmin()])
        left[i] = False
        order.append(i)
        reach[left] = np.minimum(reach[left], np.maximum(core[i], d[i, left]))
    got = models.reachability(df, "id", ["a", "b"], 12).orderBy("place").collect()
    want = [(i, p, None if p == 0 else reach[i], core[i]) for p, i in enumerate(order)] + [(len(d), len(d), None, None)]
    assert [tuple(v) for v in got] == want


@pytest.mark.parametrize("n, copies", [(1050, 1), (70, 20)])
def test_isomap_of_many_rows(spark, n, copies):
    """Over 1,000 rows, in parts that do not meet, against all rows' distances at once."""
    r = np.random.default_rng(7)
    x = np.tile(np.concatenate((r.normal(size=(n - 40, 2)) * [3, 1], r.normal(size=(40, 2)) * 0.1 + [20, 5])), (copies, 1))[r.permutation(n * copies)]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    g = np.full_like(d, np.inf)
    for i, js in enumerate(np.argsort(d, axis=1, kind="stable")[:, 1:11]):
        g[i, js] = g[js, i] = d[i, js]
    part = np.arange(len(x))
    for i, j in np.argwhere(np.isfinite(g)):
        part[part == part[j]] = part[i]
    while (part != part[0]).any():
        inside, outside = np.flatnonzero(part == part[0]), np.flatnonzero(part != part[0])
        i, j = np.unravel_index(d[np.ix_(inside, outside)].argmin(), (len(inside), len(outside)))
        i, j = inside[i], outside[j]
        g[i, j] = g[j, i] = d[i, j]
        part[part == part[j]] = part[0]
    np.fill_diagonal(g, 0)
    for m in range(len(x)):
        np.minimum(g, g[:, m, None] + g[None, m], out=g)
    square = g**2
    values, vectors = np.linalg.eigh(-(square - square.mean(0) - square.mean(1)[:, None] + square.mean()) / 2)
    want = vectors[:, :-3:-1] * np.sqrt(values[:-3:-1])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double")
    got = models.embedding(df, "id", ["a", "b"], "isomap").orderBy("id").toArrow()
    got = np.array([got.column(c).to_numpy() for c in (1, 2)]).T
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-6)
    assert (np.abs((got * want).sum(0)) == pytest.approx((want**2).sum(0))) and (got[np.abs(got).argmax(0), [0, 1]] > 0).all()
