"""Streams of events: durations per thread with state, windowed counts, and files as a source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed(events: DataFrame, time: str, by: str, value: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Number and sum per window and group, rows later than ``late`` left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(value).alias("total"))


def durations(events: DataFrame, thread: str, time: str) -> DataFrame:
    """``(thread, time, duration)`` in arrival batches: the time since the thread's last event, kept as state."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        times = sorted(t for part in parts for t in part["time"])
        out = []
        for t in times:
            out.append((key[0], t, t - last))
            last = t
        state.update((last,))
        yield pd.DataFrame(out, columns=["thread", "time", "duration"])

    own = events.select(F.col(thread).cast("long").alias("thread"), F.col(time).cast("long").alias("time"))
    return own.groupBy("thread").applyInPandasWithState(step, "thread long, time long, duration long", "last long", "append", GroupStateTimeout.NoTimeout)
