"""Performance traces: durations, successors, overlap of bursts, communication edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def durations(events: DataFrame, thread: str, time: Column, order: list[str]) -> DataFrame:
    """Time since the thread's previous event, the first counted from 0."""
    turn = Window.partitionBy(thread).orderBy(*order)
    own = events.withColumn("_t", time)
    return own.withColumn("duration", F.col("_t") - F.coalesce(F.lag("_t").over(turn), F.lit(0))).drop("_t")


def successors(events: DataFrame, thread: str, key: str, order: list[str]) -> DataFrame:
    """``(src, dst)``: each event and the thread's next; the last one's is ``finish``."""
    turn = Window.partitionBy(thread).orderBy(*order)
    return events.select(F.col(key).cast("string").alias("src"), F.coalesce(F.lead(F.col(key).cast("string")).over(turn), F.lit("finish")).alias("dst"))


def overlap(bursts: DataFrame, key: str, begin: str, end: str, ranges: int = 64) -> DataFrame:
    """``(key, factor)``: the time that all bursts, itself included, share with a burst, over its length.

    By prefix sums: with A(t) = sum over bursts of max(0, t - begin) - max(0, t - end), bursts share A(end) - A(begin)
    with a burst.  A at t is t times the number of bursts begun less those ended, less the sum of their begins plus the
    sum of their ends, so it needs two running sums over the sorted instants; ranges of time sum on their own and take
    what earlier ranges hold from one row a range.  Bursts of no length have no factor.
    """
    own = bursts.select(F.col(key).alias("k"), F.col(begin).cast("double").alias("b"), F.col(end).cast("double").alias("e"))
    marks = own.select(F.explode(F.array(F.struct(F.col("b").alias("t"), F.lit(1).alias("step")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("step")))).alias("x")).select("x.*")
    marks = marks.groupBy("t").agg(F.sum("step").alias("c"), F.sum(F.col("step") * F.col("t")).alias("s"))
    dealt = marks.repartitionByRange(ranges, "t").withColumn("part", F.spark_partition_id())
    turn = Window.partitionBy("part").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = dealt.withColumn("c", F.sum("c").over(turn)).withColumn("s", F.sum("s").over(turn))
    total = within.groupBy("part").agg(F.max_by("c", "t").alias("pc"), F.max_by("s", "t").alias("ps"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = total.select("part", F.coalesce(F.sum("pc").over(before), F.lit(0)).alias("c0"), F.coalesce(F.sum("ps").over(before), F.lit(0.0)).alias("s0"))
    area = within.join(F.broadcast(start), "part").select("t", (F.col("t") * (F.col("c") + F.col("c0")) - F.col("s") - F.col("s0")).alias("area"))
    at = lambda c, out: area.select(F.col("t").alias(c), F.col("area").alias(out))
    return own.join(at("b", "from"), "b").join(at("e", "to"), "e").select(F.col("k").alias(key), ((F.col("to") - F.col("from")) / F.nullif(F.col("e") - F.col("b"), F.lit(0.0))).alias("factor"))


def communications(sends: DataFrame, receives: DataFrame, on: str, sent: str, received: str) -> DataFrame:
    """``(src, dst, weight)`` from send to receive, weighted by the time between."""
    return sends.join(receives, on).select(F.col("src"), F.col("dst"), (F.col(received) - F.col(sent)).alias("weight"))


def status_edges(states: DataFrame, thread: str = "object_id", begin: str = "begin_time", end: str = "end_time", status: str = "state") -> DataFrame:
    """``(src, dst, weight, status)`` of every state, weighted by its length; and an edge from ``start`` to each thread's first
    instant (status 98), one from its last to ``finish`` (99)."""
    at = lambda c: F.concat_ws(":", F.col(thread), F.col(c).cast("string"))
    own = states.select(at(begin).alias("src"), at(end).alias("dst"), (F.col(end) - F.col(begin)).alias("weight"), F.col(status).cast("int").alias("status"))
    ends = states.groupBy(thread).agg(F.min(begin).alias("b"), F.max(end).alias("e"))
    first = ends.select(F.lit("start:0").alias("src"), at("b").alias("dst"), F.col("b").alias("weight"), F.lit(98).alias("status"))
    last = ends.select(at("e").alias("src"), F.lit("finish").alias("dst"), (F.col("e") * 0).alias("weight"), F.lit(99).alias("status"))
    return own.unionByName(first).unionByName(last)


def label_edges(events: DataFrame, thread: str, time: str, label: str, order: list[str]) -> DataFrame:
    """``(src, dst, weight, label)`` from each event to its thread's next, with the first one's label; also from ``start:0``
    to the first, and to ``finish`` from the last."""
    turn = Window.partitionBy(thread).orderBy(*order)
    name = lambda c: F.concat_ws(":", F.col(thread), c.cast("string"))
    own = events.select(thread, F.col(time).alias("_t"), F.col(label).alias("label"), F.lead(time).over(turn).alias("_n"), F.row_number().over(turn).alias("_r"))
    steps = own.select(name(F.col("_t")).alias("src"), F.coalesce(F.when(F.col("_n").isNotNull(), name(F.col("_n"))), F.lit("finish")).alias("dst"), F.coalesce(F.col("_n") - F.col("_t"), F.lit(0)).alias("weight"), "label")
    first = own.where("_r = 1").select(F.lit("start:0").alias("src"), name(F.col("_t")).alias("dst"), F.col("_t").alias("weight"), F.lit(None).cast(own.schema["label"].dataType).alias("label"))
    return steps.unionByName(first)


def joined_edges(**kinds: DataFrame) -> DataFrame:
    """``(kind, src, dst, weight)`` of several tables of edges."""
    tables = [df.select(F.lit(k).alias("kind"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("weight").cast("double").alias("weight")) for k, df in kinds.items()]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
