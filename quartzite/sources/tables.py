"""Tables and settings: CSV in and out, JSON settings, made data, results and reports.

Everything is read and written by Spark, so any store that it knows will do.
"""

from __future__ import annotations

import json
import logging
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartzite.operators import prepare
from quartzite.operators.relational import isin, trimmed_names

log = logging.getLogger("quartzite")


def settings(spark: SparkSession, path: str) -> dict:
    """A JSON file of settings."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def merged(base: dict, *more: dict) -> dict:
    """Settings with further ones laid over them; nested ones are merged, and no argument is changed."""
    out = dict(base)
    for extra in more:
        for k, v in extra.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


@dataclass(frozen=True)
class TraceSettings:
    """What a trace's events hold: counters and call stacks by their codes, threads, and whether they are labelled."""

    counters: dict[str, str] = field(default_factory=dict)
    stacks: dict[str, str] = field(default_factory=dict)
    threads: int = 1
    clustered: bool = False

    @classmethod
    def of(cls, given: dict) -> TraceSettings:
        named = lambda key: {str(code): str(name) for code, name in given.get(key, {}).items()}
        return cls(named("hardware_counters"), named("call_stacks"), int(given.get("thread_numbers", 1)), bool(given.get("clustered", False)))

    @property
    def schema(self) -> T.StructType:
        """Of the event table."""
        whole = [T.StructField(c, T.LongType()) for c in ("ts", "duration", *self.counters.values(), *self.stacks.values())]
        return T.StructType([T.StructField("object_id", T.StringType()), *whole[:2], *whole[2:], T.StructField("ipc", T.DoubleType()), *([T.StructField("label", T.LongType())] if self.clustered else [])])


def load(spark: SparkSession, path: str, schema: T.StructType | str | None = None, drop: Sequence[str] = (), separator: str = ",") -> DataFrame:
    """A CSV file with a header; names are trimmed, columns in ``drop`` go, and such as are not there are logged."""
    reader = spark.read.option("header", True).option("sep", separator).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    own = trimmed_names(reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path))
    if absent := [c for c in drop if c not in own.columns]:
        log.warning("columns that are not there cannot be dropped: %s", ", ".join(absent))
    return own.drop(*drop)


def load_labelled(spark: SparkSession, path: str, features: Sequence[str], label: str, labels: Sequence | None = None, scale: bool = True) -> DataFrame:
    """Features and label of a CSV file, of the given labels alone, the features scaled to [0, 1]."""
    own = load(spark, path).select(*features, label)
    own = isin(own, label, labels) if labels is not None else own
    return prepare.min_max(own, features) if scale else own


#: Separators of the named example sets' files.
EXAMPLES = {"titanic": ",", "student": ";", "fifa": ",", "cancer": ",", "waterpump": ",", "retail": ",", "sprinkler": ","}


def example(spark: SparkSession, folder: str, name: str = "titanic") -> DataFrame:
    """A named example set out of a folder; nothing is fetched from elsewhere."""
    if name not in EXAMPLES:
        raise ValueError(f"{name!r} is none of {sorted(EXAMPLES)}")
    return load(spark, f"{folder}/{name}.csv", separator=EXAMPLES[name])


@dataclass(frozen=True)
class Parts:
    """A table's columns to work on, those that pass through by the row's key, and the order of all."""

    work: DataFrame
    through: DataFrame
    order: tuple[str, ...]
    key: str

    def joined(self, work: DataFrame | None = None) -> DataFrame:
        """All columns again, in their order, with ``work`` in place of what was worked on."""
        done = work if work is not None else self.work
        return done.join(self.through, self.key).select(*self.order)


def parts(df: DataFrame, wanted: Sequence[str], through: Sequence[str], key: str) -> Parts:
    """``wanted`` columns (unless they pass through) beside the others of a table."""
    absent = [c for c in (*wanted, *through, key) if c not in df.columns]
    if absent:
        raise ValueError(f"columns that are not there: {', '.join(absent)}")
    work = [c for c in wanted if c not in through and c != key]
    rest = [c for c in df.columns if c not in work and c != key]
    return Parts(df.select(key, *work), df.select(key, *rest), tuple(df.columns), key)


def imputation_parts(df: DataFrame, given: dict, key: str) -> tuple[Parts, list[str]]:
    """Parts of a table by its settings, and the features to fill: counters and complementary columns are worked on."""
    counters = list(given.get("hardware_counters", {}).values())
    wanted = [*counters, *(c for c in given.get("complimentary", []) if c not in counters)]
    return parts(df, wanted, given.get("pass_through", []), key), [c for c in counters if c in df.columns]


def selection_features(df: DataFrame, given: dict, key: str) -> DataFrame:
    """Key and counters for feature selection, missing values marked by NULL and scaled as the settings say."""
    counters = [c for c in given.get("hardware_counters", {}).values() if c in df.columns]
    own = df.select(key, *counters)
    if (mark := given.get("missing_values")) is not None:
        own = prepare.each(own, counters, lambda c: F.nullif(c, F.lit(mark)))
    return prepare.standardise(own, counters) if given.get("scale") else own


def as_numbers(spark: SparkSession, data, header: bool = True, index: bool = True) -> DataFrame:
    """A table of doubles from rows of any kind or from a DataFrame.  ``header``: the first row has the names; ``index``:
    the first column names the rows, and becomes ``row_id`` as text."""
    if isinstance(data, DataFrame):
        if not data.columns:
            raise ValueError("a table without columns")
        first, rest = (data.columns[0], data.columns[1:]) if index else (None, data.columns)
        return data.select(*([F.col(first).cast("string").alias("row_id")] if index else []), *(F.col(c).cast("double").alias(c) for c in rest))
    rows = np.asarray(data, dtype=object)
    if rows.ndim != 2 or not rows.size:
        raise ValueError("the data must have two dimensions and not be empty")
    names = [str(x) for x in rows[0]] if header else [f"x{i}" for i in range(rows.shape[1])]
    own = [[None if v is None or v != v or v == "" else v for v in r] for r in rows[header:].tolist()]
    number = lambda v: None if v is None else float(v)
    shaped = [([str(r[0])] if index else []) + [number(v) for v in r[index:]] for r in own]
    return spark.createDataFrame(shaped, T.StructType([*([T.StructField("row_id", T.StringType())] if index else []), *(T.StructField(n, T.DoubleType()) for n in names[index:])]))


def make(spark: SparkSession, kind: str, n: int, seed: int = 0, centres: Sequence[Sequence[float]] = ((0.0, 0.0), (4.0, 4.0), (-4.0, 4.0)), spread: float = 1.0, noise: float = 0.05) -> DataFrame:
    """``(id, x, y, label)`` of ``n`` points: ``blobs``, ``aniso`` (blobs, sheared), ``circles``, ``moons``, ``quantiles`` (rings
    of a Gaussian, by equal shares) or ``classes`` (blobs at the corners of a square)."""
    own = spark.range(n)
    normal = lambda k: F.randn(seed + k)
    turn = F.rand(seed + 2) * math.pi
    if kind in ("blobs", "aniso", "classes"):
        places = [(-2.0, -2.0), (-2.0, 2.0), (2.0, -2.0), (2.0, 2.0)] if kind == "classes" else [tuple(map(float, c)) for c in centres]
        label = F.pmod("id", F.lit(len(places)))
        centre = lambda axis: F.element_at(F.array(*(F.lit(c[axis]) for c in places)), (label + 1).cast("int"))
        got = own.select("id", (centre(0) + spread * normal(0)).alias("x"), (centre(1) + spread * normal(1)).alias("y"), label.cast("int").alias("label"))
        return got.withColumns({"x": 0.6 * F.col("x") - 0.4 * F.col("y"), "y": -0.6 * F.col("x") + 0.8 * F.col("y")}) if kind == "aniso" else got
    label = F.pmod("id", F.lit(2)).cast("int")
    if kind == "circles":
        r = F.when(label == 0, 1.0).otherwise(0.5)
        return own.select("id", (r * F.cos(2 * turn) + noise * normal(0)).alias("x"), (r * F.sin(2 * turn) + noise * normal(1)).alias("y"), label.alias("label"))
    if kind == "moons":
        x, y = F.when(label == 0, F.cos(turn)).otherwise(1 - F.cos(turn)), F.when(label == 0, F.sin(turn)).otherwise(0.5 - F.sin(turn))
        return own.select("id", (x + noise * normal(0)).alias("x"), (y + noise * normal(1)).alias("y"), label.alias("label"))
    if kind == "quantiles":
        k = len(centres)
        bounds = [math.sqrt(-2 * math.log(1 - i / k)) * spread for i in range(1, k)]
        got = own.select("id", (spread * normal(0)).alias("x"), (spread * normal(1)).alias("y"))
        far: Column = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)
        return got.withColumn("label", reduce(lambda a, b: a + b, ((far > b).cast("int") for b in bounds), F.lit(0)))
    raise ValueError(f"no such kind of data: {kind!r}")


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def write_events(events: DataFrame, path: str, counters: Sequence[str] = ()) -> None:
    """The event table, without rows whose given counters are all zero."""
    write_csv(prepare.drop_zero_rows(events, counters) if counters else events, path)


def write_imputed(parted: Parts, done: DataFrame, edits: DataFrame, path: str, edits_path: str) -> None:
    """Filled columns beside those that passed through, in the table's order; and the list of edits."""
    write_csv(parted.joined(done), path)
    write_csv(edits, edits_path)


def write_labels(df: DataFrame, columns: Sequence[str], label: str, path: str) -> None:
    """Points with their clusters."""
    write_csv(df.select(*columns, label), path)


def report(df: DataFrame, columns: Sequence[str], results: dict) -> dict:
    """Results beside a profile of the columns, as JSON holds them."""
    profile = {r["feature"]: {k: v for k, v in r.asDict().items() if k != "feature"} for r in prepare.describe(df, columns).collect()}  # a row a column
    return {**results, "profile": profile}


def write_report(spark: SparkSession, found: dict, path: str, html: str | None = None, title: str = "Organization component analysis") -> None:
    """``report`` as JSON, and as a page of tables where ``html`` names a folder."""
    from html import escape

    def page(value) -> Iterable[str]:
        if isinstance(value, dict):
            yield "<table>" + "".join(f"<tr><th>{escape(str(k))}</th><td>{''.join(page(v))}</td></tr>" for k, v in value.items()) + "</table>"
        else:
            yield escape(str(value))

    one = lambda text, to: spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(to)
    one(json.dumps(found, default=str), path)
    if html:
        one(f"<!doctype html><title>{escape(title)}</title><h1>{escape(title)}</h1>{''.join(page(found))}", html)
