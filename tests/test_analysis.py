"""Draws, outliers, agreement, maps, selection, loaders: against values worked out by hand or with NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzite.operators import agreement, draws, graph, impute, lattice, outliers, pipeline, prepare, selection, som, trace, validate
from quartzite.sources import prv, tables


def test_draws_are_exact_and_weighted(spark):
    df = spark.createDataFrame([(i, float(i % 4), None if i == 7 else "x") for i in range(400)], "id long, w double, s string").repartition(5)
    got = draws.with_replacement(df, 4000, "w", bags=2, seed=3).groupBy("bag", "w").count().collect()
    n = {(r["bag"], r["w"]): r["count"] for r in got}
    assert sum(n.values()) == 8000 and all(w > 0 for _, w in n) and abs(n[0, 3.0] / n[0, 1.0] - 3) < 0.5
    assert draws.with_replacement(df.limit(0), 10).count() == 0 and draws.with_replacement(df.withColumn("w", F.lit(0.0)), 10, "w").count() == 10
    sizes = lambda d: sorted(r["count"] for r in d.groupBy("k").count().collect())
    df = spark.createDataFrame([(i, "a" if i < 50 else "b" if i < 60 else None) for i in range(63)], "id long, k string")
    assert sizes(draws.balanced(df, "k")) == [50, 50, 50] and sizes(draws.balanced(df, "k", to_largest=False)) == [3, 3, 3]
    assert draws.without_replacement(df, 20, bags=2).groupBy("bag").agg(F.countDistinct("id").alias("n")).where("n = 20").count() == 2


def test_outliers(spark):
    r = np.random.default_rng(0)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(r.normal(size=(300, 2)))] + [(900, 9.0, 9.0), (901, -8.0, 9.0), (902, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    for how in ("isolation_forest", "elliptic"):
        left = {x["id"] for x in outliers.drop_outliers(df, ["x", "y"], 0.02, algorithm=how).collect()}
        assert not left & {900, 901} and 902 in left and 290 <= len(left) <= 299
    assert outliers.drop_outliers(df.limit(0), ["x", "y"]).count() == 0


def test_agreement(spark):
    df = spark.createDataFrame([(0, "a"), (0, "a"), (1, "b"), (1, "a"), (2, None)], "t int, f string")
    got = agreement.agreement(df, "t", "f")
    h, c = math.log(2), -(0.75 * math.log(0.75) + 0.25 * math.log(0.25))
    mutual = 0.5 * math.log(0.5 / (0.5 * 0.75)) + 0.25 * math.log(0.25 / (0.5 * 0.25)) + 0.25 * math.log(0.25 / (0.5 * 0.75))
    assert got["homogeneity"] == pytest.approx(mutual / h) and got["completeness"] == pytest.approx(mutual / c)
    # By hand: all four rows' permutations give the same contingency up to names, so the expected information is the found one.
    assert got["ami"] == pytest.approx(0.0, abs=1e-12) and got["fowlkes_mallows"] == pytest.approx(2 / math.sqrt(4 * 6))
    same = agreement.agreement(df.withColumn("g", F.col("t") * 2), "t", "g")
    assert all(v == pytest.approx(1.0) for v in same.values())
    assert set(agreement.agreement(df.limit(0), "t", "f").values()) == {1.0}
    assert agreement.knee([0, 0.1, 0.2, 0.3, 5, 10]) == 3


def test_lattice():
    own = som.Lattice(3, 4)
    assert lattice.neighbours(own)[5] == [1, 4, 6, 9] and len(lattice.neighbours(own, True)[5]) == 8
    assert lattice.diagonal_neighbours(own, 0) == [5] and lattice.interior(own) == [5, 6] and len(lattice.boundary(own)) == 10
    assert (0, 4) in lattice.oriented_edges(own) and (0, 1) in lattice.oriented_edges(own, vertical=False) and len(lattice.oriented_edges(own)) == 8
    assert lattice.diagonal(som.Lattice(3, 3), rising=True) == [2, 4, 6] and lattice.cells(own).shape == (6, 4)
    v = np.random.default_rng(1).normal(size=(5, 7))
    i, j = np.indices(v.shape)
    want = np.empty_like(v)
    for a in range(5):
        for b in range(7):
            w = np.exp(-(np.hypot(i - a, j - b) / 2.0) ** 2)
            want[a, b] = (w * v).sum() / w.sum()
    assert lattice.smoothed(v, 2.0) == pytest.approx(want)
    valley = np.array([[1, 2, 9, 2, 0.5]] * 3) + np.array([[0.3], [0.0], [0.3]])
    labels = lattice.neuron_labels(valley).reshape(3, 5)
    assert labels[:, :2].max() == 0 and labels[:, 3:].min() == 1
    assert lattice.sparsity(np.array([[1.0, 3.0]]), np.array([0, 0])) == {0: 1.0} and lattice.cluster_distances(np.array([[1.0, 3.0]]), np.array([0, 1])) == {(0, 1): 2.0}
    assert lattice.cosine(np.array([1, 0]), np.array([0, 2]), degrees=True) == pytest.approx(90) and lattice.cosine(np.array([1, 0]), np.array([-1, 0]), signed=False) == 1
    square = np.array([[0, 0], [0, 1], [1, 0], [1, 1.01], [9, 9]])
    assert lattice.alpha_shape(square, 1.0) == {(0, 1), (0, 2), (1, 3), (2, 3)}


def test_online_training(spark):
    df = spark.createDataFrame([(float(x), float(y)) for x in (0, 10) for y in (0, 10) for _ in range(20)], "x double, y double")
    own = som.Lattice(4, 4)
    for method in ("rs", "rc", "rpam", "rpaz", "rrg"):
        assert som.initial(df, ["x", "y"], own, method).shape == (16, 2)
    start = som.initial(df, ["x", "y"], own, "rrg")
    book, trail = som.train_online(df, ["x", "y"], own, start, 200, fixed_edge=True)
    assert len(trail) == 200 and (book[lattice.boundary(own)] == start[lattice.boundary(own)]).all() and (book != start).any()
    places = own.places()
    assert som.bubble(places, 5, 1.0, 0.5).tolist() == [0.5 if np.hypot(*(p - places[5])) < 1.5 else 0 for p in places]
    assert som.nearest_units(start, np.array([0.0, 0.0]), 1)[0] == 0 and np.isinf(som.gravity(start[3], start, np.ones(16))[3])
    book, _ = som.train_online(df, ["x", "y"], own, start, 50, active=["x"], by_mass=True)
    assert np.isfinite(book).all()


def test_validation(spark):
    assert validate.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5) and validate.f_quantile(0.95, 3, 10) == pytest.approx(3.708265, abs=1e-5)
    low, high = validate.confidence_interval([0.4, 0.6, 0.5, 0.5])
    assert low < 0.5 < high and high - low == pytest.approx(2 * 3.182446 * np.std([0.4, 0.6, 0.5, 0.5], ddof=1) / 2, abs=1e-5)
    r = np.random.default_rng(5)
    df = spark.createDataFrame([tuple(map(float, x)) for x in r.normal(size=(400, 2))], "x double, y double")
    good, bad = r.normal(size=(64, 2)), r.normal(5, 0.1, size=(64, 2))
    assert validate.likelihood(df, ["x", "y"], good) > 0.4 and validate.likelihood(df, ["x", "y"], bad) == 0.0
    assert validate.embedding_index(df, ["x", "y"], bad) == 0.0
    own = som.Lattice(8, 8)
    grid = som.regular_grid(own, (-3, -3), (3, 3), (0, 0), margin=0)
    assert validate.goodness_of_fit(df, ["x", "y"], grid, own, by_distribution=False)["topology_accuracy"] == 1.0


def test_selection(spark):
    r = np.random.default_rng(7)
    a, b = np.repeat([-3.0, 3.0], 100) + r.normal(0, 0.3, 200), r.normal(size=200)
    rows = [(float(x), float(x + e), float(y), float(y + f)) for x, y, e, f in zip(a, b, r.normal(0, 0.05, 200), r.normal(0, 0.05, 200), strict=True)]
    cols = ["a1", "a2", "b1", "b2"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    for how in (selection.principal_features, selection.independent_features):
        assert sorted(f[0] for f in how(df, cols, 2)) == ["a", "b"]
    x = selection.bag_of(df, cols, 150)
    w = selection.affinity(x, 7)
    assert (w == w.T).all() and (np.diag(w) == 0).all()
    cut = selection.spec_scores(x, w)
    d = w.sum(1)
    f = x[:, 0] * np.sqrt(d)
    f /= np.linalg.norm(f)
    laplacian = np.eye(len(w)) - w / np.sqrt(d)[:, None] / np.sqrt(d)[None]
    assert cut[0, 0] == pytest.approx(f @ laplacian @ f) and cut[0, 0] < cut[2, 0]
    y = x[:, 2] * 2
    assert selection.least_angle(x, y, 4) @ x.T == pytest.approx(y, abs=1e-6)
    got = {q["feature"]: q["score"] for q in selection.spectral_ranking(df, cols, "mcfs", size=150).collect()}
    assert set(got) == set(cols) and all(v >= 0 for v in got.values())


def test_nearest_rows(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(i, None if i % 5 == 0 else float(r.integers(9)), float(r.integers(40)) if i else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, y double, x double")
    monkeypatch.setattr(impute, "RANGE", 20)
    got = {q["id"]: q["value"] for q in impute.nearest_mean(df, "id", "y", "x", 4).collect()}
    known = [q for q in rows if q[1] is not None and q[2] is not None]
    for i, y, x in rows:
        if y is None and x is not None:
            near = sorted(known, key=lambda q: (abs(q[2] - x), q[0]))[:4]
            w = [1 / max(abs(q[2] - x), 1e-12) for q in near]
            assert got.pop(i) == pytest.approx(sum(a * q[1] for a, q in zip(w, near, strict=True)) / sum(w))
    assert not got and impute.impute(df, "id", ["y"], "pmm", "x").where("y is null and x is not null").count() == 0


def test_knn_ties(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(60)] + [(99, [5.0, 5.0])], "id long, v array<double>")
    got = graph.knn(df, "id", "v", 3).collect()
    near = {i: sorted(q["dst"] for q in got if q["src"] == i) for i in range(60)}
    assert all(near[i] == [j for j in range(5) if j != i][:3] for i in range(60))
    assert sorted(q["dst"] for q in got if q["src"] == 99) == [0, 1, 2]


def test_graph_tables(spark):
    e = spark.createDataFrame([(1, 2, 5.0), (2, 1, 4.0), (2, 3, 1.0)], "src long, dst long, distance double")
    assert {tuple(q) for q in graph.undirected(e).collect()} == {(1, 2, 4.0), (2, 3, 1.0)}
    assert [tuple(q) for q in graph.adjacency_matrix(e, "distance").orderBy("src").collect()] == [(1, 0.0, 5.0, 0.0), (2, 4.0, 0.0, 1.0)]
    with pytest.raises(ValueError):
        graph.adjacency_matrix(e, most=2)
    assert sorted(q[0] for q in graph.merge(e, e, cap=1).select("distance").collect()) == [1.0, 5.0]


def test_labels_carry_forward(spark):
    lines = ["2:1:1:1:1:5:90000001:3", "2:1:1:1:1:9:42000050:1", "2:1:1:1:1:12:42000050:2", "2:1:1:1:1:15:42000050:2:90000001:8", "2:2:1:2:1:1:42000050:4"]
    got = prv.events(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string"), {"42000050": "ins"}).orderBy("object_id", "ts").collect()
    assert [(q["ts"], q["label"]) for q in got] == [(9, 3), (12, None), (15, 8), (1, None)]


def test_status_edges(spark):
    s = spark.createDataFrame([("1.1.1.1", 2, 6, 1), ("1.1.1.1", 6, 9, 2)], "object_id string, begin_time long, end_time long, state int")
    assert {tuple(q) for q in trace.status_edges(s).collect()} == {("1.1.1.1:2", "1.1.1.1:6", 4, 1), ("1.1.1.1:6", "1.1.1.1:9", 3, 2), ("start:0", "1.1.1.1:2", 2, 98), ("1.1.1.1:9", "finish", 0, 99)}


def test_tables(spark, tmp_path):
    df = tables.as_numbers(spark, [["", "a", "b"], ["r1", 1, None], ["r2", "2", float("nan")]])
    assert [tuple(q) for q in df.orderBy("row_id").collect()] == [("r1", 1.0, None), ("r2", 2.0, None)]
    with pytest.raises(ValueError):
        tables.as_numbers(spark, [])
    for kind in ("blobs", "aniso", "classes", "circles", "moons", "quantiles"):
        got = tables.make(spark, kind, 90, seed=1)
        assert got.count() == 90 and got.select("label").distinct().count() == {"blobs": 3, "aniso": 3, "classes": 4, "quantiles": 3}.get(kind, 2)
    tables.write_csv(df.coalesce(1), str(tmp_path / "student.csv").replace("student", "titanic"))
    assert tables.example(spark, str(tmp_path), "titanic").count() == 2
    with pytest.raises(ValueError):
        tables.example(spark, str(tmp_path), "else")
    base = {"a": {"b": 1}, "c": 2}
    assert tables.merged(base, {"a": {"d": 3}, "c": 4}) == {"a": {"b": 1, "d": 3}, "c": 4} and base == {"a": {"b": 1}, "c": 2}


def test_prepare_data(spark):
    df = spark.createDataFrame([(1, 2.0, 4.0, "k"), (1, None, 8.0, "l"), (2, 1.0, 1.0, "m")], "g int, a double, b double, s string").withColumn("void", F.lit(None).cast("double"))
    got = pipeline.prepare_data(df, ["a", "b", "void"], "g", [1], derived={"c": "a + b"}).orderBy("b").collect()
    assert [(q["a"], q["b"], q["c"], q["s"]) for q in got] == [(2.0, 4.0, 6.0, "k"), (2.0, 8.0, 6.0, "l")] and "void" not in got[0]
    assert pipeline.prepare_data(df.limit(0), ["a", "b"], derived={"c": "a + b"}).count() == 0
    assert prepare.mahalanobis(df.select("a", F.col("a").alias("a2")).dropna(), ["a", "a2"]).where("distance is null").count() == 0
