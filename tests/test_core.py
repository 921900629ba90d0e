"""Core operators against values worked out by hand or with NumPy."""

import importlib.util
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzite.operators import bilinear, cluster, components, factors, graph, impute, prepare, som, trace
from quartzite.sources import prv

TABLES = "/root/testdata/sf0.001"


@pytest.fixture
def small(spark):
    return spark.createDataFrame([(1, 2.0, 0.0), (2, 4.0, None), (3, 0.0, 8.0), (4, None, 2.0)], "id long, a double, b double")


def test_fills(small):
    own = prepare.zeros_missing(small, ["a", "b"])
    got = {m: {r["id"]: (r["a"], r["b"]) for r in prepare.fill(own, ["a", "b"], m).collect()} for m in ("mean", "geo", "harmonic", "median", "zero")}
    assert got["mean"][3][0] == 3.0 and got["mean"][1][1] == 5.0
    assert got["geo"][3][0] == pytest.approx(8**0.5) and got["harmonic"][3][0] == pytest.approx(8 / 3)
    assert got["zero"][4][0] == 0.0 and got["median"][2][1] == 5.0


def test_missing(small):
    own = prepare.zeros_missing(small, ["a", "b"])
    assert {tuple(r) for r in prepare.missing_patterns(own, ["a", "b"]).collect()} == {("01", 2), ("10", 2)}
    assert {tuple(r) for r in prepare.missing_cells(own, "id", ["a", "b"]).collect()} == {(1, "b"), (2, "b"), (3, "a"), (4, "a")}


def test_formulas_are_checked(small):
    assert prepare.derive(small, {"c": "euclidean(a, b)"}).where("id = 1").first()["c"] == 2.0
    for bad in ("__import__('os')", "a; drop", "reflect(a)"):
        with pytest.raises(ValueError):
            prepare.derive(small, {"c": bad})


def test_scaling_of_constants(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [r["x"] for r in prepare.standardise(df, ["x"]).collect()] == [0.0, 0.0]
    assert [r["x"] for r in prepare.min_max(df, ["x"]).collect()] == [None, None]


def test_overlap(spark):
    rows = list(enumerate(zip([1, 4, 2, 6, 4, 3], [2, 6, 4, 8, 6, 8], strict=True)))
    df = spark.createDataFrame([(k, float(b), float(e)) for k, (b, e) in rows], "k long, b double, e double")
    got = {r["k"]: r["factor"] for r in trace.overlap(df, "k", "b", "e", ranges=3).collect()}
    assert [round(got[k], 9) for k in range(6)] == [1.0, 3.0, 1.5, 2.0, 3.0, 2.4]


LINES = """#Paraver (01/01/2024 at 00:00):100:1(1):1:2(1:1,1:1)
1:1:1:1:1:0:40:1
2:1:1:1:1:40:42000050:100:42000059:50
2:2:1:2:1:45:42000050:0:42000059:0
2:1:1:1:1:70:42000050:30:42000059:60:70000001:7
2:1:1:1:1:70:50000001:9
3:1:1:1:1:40:42:2:1:2:1:50:55:1024:9""".split("\n")


@pytest.fixture
def lines(spark):
    return spark.createDataFrame(list(enumerate(LINES)), "line_no long, value string")


def test_trace_records(lines):
    got = prv.events(lines, {"42000050": "ins", "42000059": "cyc"}, {"70000001": "caller"}, "cyc", "ins").orderBy("ts").collect()
    assert [(r["object_id"], r["ts"], r["duration"], r["ipc"], r["caller"]) for r in got] == [("1.1.1.1", 40, 40, 2.0, 0), ("1.1.1.1", 70, 30, 0.5, 7)]
    assert tuple(prv.states(lines).first()) == ("1.1.1.1", 0, 40, 1)
    assert tuple(prv.communications(lines).first()) == ("1.1.1.1", 40, 42, "2.1.2.1", 50, 55, 1024, 9)


def test_trace_edits(spark, lines):
    edits = spark.createDataFrame([("1.1.1.1", 40, "42000050", "7", "u"), ("1.1.1.1", 40, "9", "1", "a"), ("1.1.1.1", 40, "8", "3", "n")], "object_id string, ts long, code string, new_value string, tag string")
    got = [r["value"] for r in prv.edit(lines, edits).orderBy("line_no", "sub_no").collect()]
    assert got[2:4] == ["2:1:1:1:1:40:42000050:7:42000059:50:9:1", "2:1:1:1:1:40:8:3"] and len(got) == 8


def test_knn_blocks(spark, monkeypatch):
    v = np.random.default_rng(0).normal(size=(60, 3))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    monkeypatch.setattr(graph, "BLOCK", 16)
    got = {(r["src"], r["dst"]) for r in graph.knn(df, "id", "v", 4).collect()}
    d = np.sqrt(((v[:, None] - v) ** 2).sum(2)) + np.diag([np.inf] * 60)
    assert got == {(i, int(j)) for i in range(60) for j in np.argsort(d[i])[:4]}


def test_components_and_dbscan(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5)], "a long, b long")
    assert {tuple(r) for r in components.connected(edges).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
    points = spark.createDataFrame([(i, x, 0.0) for i, x in enumerate([0.0, 0.1, 0.2, 5.0, 5.1, 5.2, 9.0])], "id long, x double, y double")
    got = {r["id"]: r["cluster"] for r in cluster.dbscan(points, "id", ["x", "y"], 0.15, 2).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: -1}


def test_som(spark):
    lattice = som.Lattice(2, 2)
    book = som.regular_grid(lattice, np.zeros(2), np.ones(2), np.full(2, 0.5), margin=0.0)
    assert book.tolist() == [[0, 0], [0, 1], [1, 0], [1, 1]]
    df = spark.createDataFrame([(0.1, 0.2), (0.9, 0.8), (None, 1.0)], "x double, y double")
    assert [r["bmu"] for r in som.best_units(df, ["x", "y"], book).collect()] == [0, 3, None]
    assert [r["n_rows"] for r in som.hits(som.best_units(df, ["x", "y"], book), "bmu", lattice).orderBy("neuron").collect()] == [1, 0, 0, 1]
    _, energy = som.train_batch(df.dropna(), ["x", "y"], lattice, book, 6)
    assert energy[-1] < energy[0]
    assert som.geodesic_path(book, lattice, 0, 3)[0] == 0


def test_bilinear_round_trip(spark):
    corners = spark.createDataFrame([(0, 0.0, 0.0, 2.0, 2.0, 0.0, 0.0, 3.0, 0.5, 0.2, 2.5, 2.8, 3.5)], "cell long, x0 double, y0 double, l double, w double, x00 double, y00 double, x10 double, y10 double, x01 double, y01 double, x11 double, y11 double")
    cells = bilinear.coefficients(corners)
    points = spark.createDataFrame([(1, 0.5, 1.5), (2, 2.5, 0.1), (3, 1.0, 1.0)], "id long, x double, y double")
    there = bilinear.forward(points, "x", "y", (0.0, 0.0), (2.0, 2.0), 1, cells)
    assert there.where("id = 2").first()["new_x"] is None
    back = bilinear.backward(there.where("new_x is not null").withColumn("cell", F.lit(0)), "new_x", "new_y", cells)
    assert all(r["old_x"] == pytest.approx(r["x"]) and r["old_y"] == pytest.approx(r["y"]) for r in back.collect())


def test_mice_recovers_a_line(spark):
    rows = [(i, float(i % 17), None if i % 9 == 0 else 2.0 * (i % 17) + 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = impute.mice(df, ["a", "b"], sweeps=2, within_range=False).where("id % 9 = 0").collect()
    assert all(r["b"] == pytest.approx(2 * r["a"] + 1, abs=1e-3) for r in got)
    with pytest.raises(ValueError):
        impute.mice(df, ["a", "b"], method="else")


def test_ks(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=300), rng.normal(0.3, size=200)
    df = spark.createDataFrame([(0, float(x)) for x in a] + [(1, float(x)) for x in b], "s int, v double")
    got = impute.ks(df, "s", "v").first()
    grid = np.sort(np.concatenate([a, b]))
    expected = np.abs(np.searchsorted(np.sort(a), grid, "right") / 300 - np.searchsorted(np.sort(b), grid, "right") / 200).max()
    assert got["statistic"] == pytest.approx(expected) and 0 <= impute.ks_p_value(expected, 300, 200) < 0.1


def test_rotations():
    a = np.random.default_rng(2).normal(size=(8, 3))
    for turned in (factors.varimax(a), factors.quartimax(a), factors.equimax(a)):
        assert turned @ turned.T == pytest.approx(a @ a.T)
    assert factors.promax(a).shape == a.shape


def test_streaming_durations(spark, tmp_path):
    from quartzite.streaming import events

    for k, rows in enumerate(([(1, 5), (1, 9)], [(1, 20), (2, 3)])):
        spark.createDataFrame(rows, "u long, t long").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("u long, t long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = events.durations(stream, "u", "t").writeStream.format("memory").queryName("durations").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["duration"] for r in spark.sql("select duration from durations").collect()) in ([3, 4, 5, 11],)


def test_entry_points_without_the_subpackage(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_llm", lambda: None)
    monkeypatch.setattr(entry, "_pipeline", lambda: None)
    assert set(entry.oracle_sql()) <= set(entry.queries()) and not any(n.startswith("op1_") for n in entry.queries())


@pytest.mark.skipif(not os.path.isdir(TABLES) or importlib.util.find_spec("duckdb") is None, reason="no tables")
@pytest.mark.parametrize("name", ["prep_filter_derive", "fill_geo", "standardize", "trace_duration", "prv_parse", "prv_edit", "knn_degree", "laplacian_score", "som_hits", "ks_statistic", "pmm_impute", "blt_forward", "arg_min_group", "path_diff", "factorize", "edit_and_apply", "relabel_by_duration", "normalise_rows"])
def test_against_sql(spark, name):
    import duckdb

    from quartzite.plans import catalogue as queries

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.sql(f"create view {t} as select * from '{TABLES}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, TABLES).toPandas(), con.sql(queries.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b) and all(((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all() for c in cols)
