"""Traces in the colon-separated text format: reading, rendering, editing.

``1:cpu:appl:task:thread:begin:end:state``, ``2:cpu:appl:task:thread:time:type:value[:type:value...]`` and
``3:<sender>:lsend:psend:<receiver>:lrecv:precv:size:tag``; other lines are headers.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Types of events that carry no computation, and of cluster labels.
NOT_NEEDED = ("1000", "1001", "50000001")
LABEL = "90000001"


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, value)``; numbers follow the file's order within one file."""
    return spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())


def clean(lines: DataFrame) -> DataFrame:
    """Records with their fields, without headers and events of a single type that is not needed."""
    own = lines.withColumn("f", F.split("value", ":")).where(F.col("value").rlike("^[123]:"))
    return own.where(~((F.col("f")[0] == "2") & (F.size("f") == 8) & F.col("f")[6].isin(*NOT_NEEDED)))


def _object(first: int) -> Column:
    return F.concat_ws(".", *(F.col("f")[first + i] for i in range(4)))


def _long(i: int) -> Column:
    return F.col("f")[i].cast("long")


def states(lines: DataFrame) -> DataFrame:
    own = clean(lines).where(F.col("f")[0] == "1")
    return own.select(_object(1).alias("object_id"), _long(5).alias("begin_time"), _long(6).alias("end_time"), F.col("f")[7].cast("int").alias("state"))


def communications(lines: DataFrame) -> DataFrame:
    own = clean(lines).where(F.col("f")[0] == "3")
    return own.select(_object(1).alias("object_send"), _long(5).alias("lsend"), _long(6).alias("psend"), _object(7).alias("object_recv"), _long(11).alias("lrecv"), _long(12).alias("precv"), _long(13).alias("size"), _long(14).alias("tag"))


def _pairs() -> Column:
    """type -> value; of a type that repeats, the last value."""
    at = F.sequence(F.lit(6), F.size("f") - 2, F.lit(2))
    keys, values = F.transform(at, lambda i: F.get("f", i)), F.transform(at, lambda i: F.get("f", i + 1))
    last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v"), F.sequence(F.lit(0), F.size(at) - 1).alias("i")), lambda x: x["i"] == F.size(keys) - F.array_position(F.reverse(keys), x["k"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"].cast("long"))))


def events(lines: DataFrame, counters: dict[str, str], stacks: dict[str, str] | None = None, cycles: str | None = None, instructions: str | None = None) -> DataFrame:
    """Events with their durations and a column for each configured type; a label attaches to the thread's next counters.

    Rows whose cycles and instructions are both zero (or missing) go, after durations are known."""
    own = clean(lines).where(F.col("f")[0] == "2").select("line_no", _object(1).alias("object_id"), _long(5).alias("ts"), _pairs().alias("p"))
    own = own.withColumn("l", F.try_element_at("p", F.lit(LABEL))).withColumn("c", F.col("l").isNull() | (F.size("p") > 1))
    turn = Window.partitionBy("object_id").orderBy("ts", "line_no")
    # A line of labels alone stands for the thread's next line of counters; the last such line before it counts.
    upto = turn.rowsBetween(Window.unboundedPreceding, -1)
    told = own.withColumn("at", F.max(F.when(F.col("c"), F.struct("ts", "line_no"))).over(upto)).withColumn("told", F.max(F.when(F.col("l").isNotNull() & ~F.col("c"), F.struct("ts", "line_no", "l"))).over(upto))
    fresh = F.col("told").isNotNull() & (F.col("at").isNull() | (F.struct("told.ts", "told.line_no") > F.struct("at.ts", "at.line_no")))
    timed = told.where("c").withColumn("label", F.coalesce("l", F.when(fresh, F.col("told.l")))).withColumn("duration", F.col("ts") - F.coalesce(F.lag("ts").over(turn), F.lit(0)))
    wide = timed.select("line_no", "object_id", "ts", "duration", *(F.coalesce(F.try_element_at("p", F.lit(code)), F.lit(0)).alias(name) for code, name in (counters | (stacks or {})).items()), "label")
    if cycles and instructions:
        wide = wide.where(~((F.col(cycles) == 0) & (F.col(instructions) == 0))).withColumn("ipc", F.col(instructions) / F.nullif(F.col(cycles), F.lit(0)))
    return wide


def render_events(df: DataFrame, ids: Sequence[str], time: str, pairs: dict[str, str]) -> DataFrame:
    """``(value)``: event lines from columns."""
    return df.select(F.concat_ws(":", F.lit("2"), *(F.col(c).cast("string") for c in ids), F.col(time).cast("string"), *(x for code, c in pairs.items() for x in (F.lit(code), F.col(c).cast("string")))).alias("value"))


def edit(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """Lines with edits ``(object_id, ts, code, new_value, tag)`` applied to events of that thread and time.

    ``u`` replaces the value of the code, ``a`` appends the pair, ``n`` adds an event line after the last one there.
    Edits of one line apply in order of their code."""
    own = lines.withColumn("f", F.split("value", ":"))
    key = F.when(F.col("f")[0] == "2", F.concat(_object(1), F.lit("@"), F.col("f")[5]))
    per = edits.withColumn("_key", F.concat("object_id", F.lit("@"), F.col("ts").cast("string"))).groupBy("_key").agg(
        F.array_sort(F.collect_list(F.struct(F.col("code").cast("string").alias("code"), F.col("new_value").cast("string").alias("value"), "tag"))).alias("es")
    )
    joined = own.withColumn("_key", key).join(per, "_key", "left")
    at = F.sequence(F.lit(6), F.size("f") - 2, F.lit(2))
    new_value = lambda i: F.get(F.transform(F.filter("es", lambda e: (e["tag"] == "u") & (e["code"] == F.get("f", i))), lambda e: e["value"]), F.lit(0))
    pairs = F.transform(at, lambda i: F.concat(F.get("f", i), F.lit(":"), F.coalesce(new_value(i), F.get("f", i + 1))))
    added = F.transform(F.filter("es", lambda e: e["tag"] == "a"), lambda e: F.concat(e["code"], F.lit(":"), e["value"]))
    line = F.concat_ws(":", F.slice("f", 1, 6), pairs, added)
    last = F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("line_no"))) == 1
    marked = joined.where("es is not null").withColumn("_last", last)
    inserts = marked.where("_last").select("line_no", F.concat_ws(":", F.slice("f", 1, 6)).alias("head"), F.posexplode(F.filter("es", lambda e: e["tag"] == "n")).alias("sub", "e"))
    changed = marked.select("line_no", F.lit(0).alias("sub_no"), line.alias("value"))
    fresh = inserts.select("line_no", (F.col("sub") + 1).alias("sub_no"), F.concat_ws(":", "head", "e.code", "e.value").alias("value"))
    return joined.where("es is null").select("line_no", F.lit(0).alias("sub_no"), "value").unionByName(changed).unionByName(fresh)


def edit_list(before: DataFrame, after: DataFrame, columns: dict[str, str], codes: dict[str, str], key: Sequence[str] = ("object_id", "ts"), whole: Sequence[str] = ()) -> DataFrame:
    """Edits ``(object_id, ts, code, new_value, tag)`` of every cell that ``before`` lacks and ``after`` has.

    ``columns`` names the filled column of each column, ``codes`` its type in the trace.  Columns in ``whole`` are rounded
    to whole numbers, halves to the even one.  The tag is ``u``: the counter is there, with a value to replace."""
    gaps = before.select(*key, *(F.col(c).isNull().alias(f"_gap_{c}") for c in columns)).where(reduce(lambda a, b: a | b, (F.col(f"_gap_{c}") for c in columns)))
    value = lambda c: (F.bround(F.col(f"_new_{c}")).cast("long") if c in whole else F.col(f"_new_{c}")).cast("string")
    both = gaps.join(after.select(*key, *(F.col(f).alias(f"_new_{c}") for c, f in columns.items())), list(key))
    cells = F.array(*(F.struct(F.lit(codes[c]).alias("code"), value(c).alias("new_value"), F.col(f"_gap_{c}").alias("gap")) for c in columns))
    return both.select(*key, F.explode(cells).alias("x")).where("x.gap and x.new_value is not null").select(*key, "x.code", "x.new_value", F.lit("u").alias("tag"))
