"""Clustering: density clusters over grid cells, k-means, principal components, silhouettes."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.operators.components import connected


def _neighbours(df: DataFrame, key: str, features: Sequence[str], eps: float) -> DataFrame:
    """``(a, b)`` of all pairs within eps, itself included: cells of side eps, joined with the cells around."""
    own = df.select(F.col(key).cast("long").alias("id"), *(F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)))
    cell = lambda i: F.floor(F.col(f"f{i}") / eps)
    n = len(features)
    home = own.withColumns({f"c{i}": cell(i) for i in range(n)})
    around = own.withColumn("_o", F.explode(F.array(*(F.array(*map(F.lit, o)) for o in product((-1, 0, 1), repeat=n)))))
    around = around.select(F.col("id").alias("b"), *(F.col(f"f{i}").alias(f"g{i}") for i in range(n)), *((cell(i) + F.col("_o")[i]).alias(f"c{i}") for i in range(n)))
    distance = sum(((F.col(f"f{i}") - F.col(f"g{i}")) ** 2 for i in range(n)), F.lit(0.0))
    return home.join(around, [f"c{i}" for i in range(n)]).where(distance <= eps * eps).select(F.col("id").alias("a"), "b")


def dbscan(df: DataFrame, key: str, features: Sequence[str], eps: float, min_points: int) -> DataFrame:
    """``(key, cluster, core)``: clusters numbered by their smallest core key, noise is -1; a border point goes to the
    cluster with the smallest core key next to it.  Points with a missing feature are noise."""
    pairs = _neighbours(df, key, features, eps)
    core = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_points).select(F.col("a").alias("core"))
    links = pairs.join(core, pairs["a"] == core["core"], "left_semi").join(core, F.col("b") == F.col("core"), "left_semi")
    roots = connected(links.select("a", "b"))
    solo = core.join(roots, core["core"] == roots["node"], "left").select("core", F.coalesce("root", "core").alias("cluster"))
    reach = pairs.join(solo, F.col("b") == F.col("core")).groupBy("a").agg(F.min("cluster").alias("near"))
    own = df.select(F.col(key).cast("long").alias("id")).join(solo, F.col("id") == F.col("core"), "left").join(reach, F.col("id") == F.col("a"), "left")
    return own.select(F.col("id").alias(key), F.coalesce("cluster", "near", F.lit(-1)).alias("cluster"), F.col("core").isNotNull().alias("core"))


def assembled(df: DataFrame, features: Sequence[str], out: str = "_features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="skip").transform(df)


def kmeans(df: DataFrame, features: Sequence[str], k: int, seed: int = 0, out: str = "cluster") -> DataFrame:
    own = assembled(df, features)
    return KMeans(k=k, seed=seed, featuresCol="_features", predictionCol=out).fit(own).transform(own).drop("_features")


def silhouette(df: DataFrame, features: Sequence[str], label: str) -> float:
    return ClusteringEvaluator(featuresCol="_features", predictionCol=label).evaluate(assembled(df.withColumn(label, F.col(label).cast("int")), features))


def principal_components(df: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """``df`` with ``pc1..pck`` of the centred features; of each component the largest weight is positive."""
    import numpy as np

    own = assembled(df, features)
    model = PCA(k=k, inputCol="_features", outputCol="_pc").fit(own)
    w = model.pc.toArray()
    sign = np.sign(w[np.abs(w).argmax(0), np.arange(k)])
    mean = df.agg(*(F.avg(c) for c in features)).first()
    centre = np.array(mean, float) @ w
    values = vector_to_array("_pc")
    return model.transform(own).withColumns({f"pc{i + 1}": (values[i] - float(centre[i])) * float(sign[i]) for i in range(k)}).drop("_features", "_pc")
