"""Shared pieces of the training-data operators: shared storage, row keys, packing and connected components."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a text are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Where a null id is compared with others it counts as this, so null ids come first.
NULL_ID = -(2**63)

#: Spark's own switch: shuffle files are removed at the end of the execution that wrote them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows and bytes of a batch that goes to a Python worker; one row may have more bytes.
ROWS_PER_BATCH, BYTES_PER_BATCH = 2048, 16 << 20

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Where that is unset, a session within one
    machine gets a folder of its own, and any other is refused: its executors would not see each other's files."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="quartzite-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return "file://" + _LOCAL[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; what is left of it when the driver ends is deleted then."""
    top = f"{shared_dir(spark)}/quartzite/{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(hadoop)
    system.deleteOnExit(hadoop)
    return f"{top}/{name}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file systems, so that any store Spark can write works."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back, which ends its lineage.

    The shuffles behind it are of no more use then, and their files go at once."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def cut_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``cut``, in as many buckets of ``key`` as shuffles have partitions, so that a join on the key moves the other side
    alone.  The catalogue's entry goes once the table is read; its files stay in the shared folder."""
    spark, path, entry = df.sparkSession, fresh_path(df.sparkSession, name), f"quartzite_{uuid.uuid4().hex}"
    df.write.bucketBy(shuffle_partitions(spark), key).format("parquet").option("compression", "zstd").option("path", path).saveAsTable(entry)
    read = spark.table(entry)
    read.schema  # resolved before the entry goes
    spark.sql(f"drop table {entry}")
    return read


def in_bucket(bucket: int, n: int, first: int) -> Iterator[int]:
    """Whole numbers from ``first`` on that Spark puts into a bucket of ``n``."""

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint32(by)) | (x >> np.uint32(32 - by))

    def mixed(h: np.ndarray, k: np.ndarray) -> np.ndarray:
        k = turned(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        return turned(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)

    while True:
        x = np.arange(first, first + (1 << 12), dtype=np.uint64)
        h = mixed(mixed(np.full(len(x), 42, np.uint32), x.astype(np.uint32)), (x >> np.uint64(32)).astype(np.uint32)) ^ np.uint32(8)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h = (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % n
        yield from x[h == bucket].tolist()
        first += len(x)


def drop_cut(df: DataFrame) -> None:
    """Removes the table that ``cut`` gave, once nothing reads it any more."""
    for path in {os.path.dirname(x) for x in df.inputFiles()}:  # one folder
        remove_path(df.sparkSession, path)


def small_batches(spark: SparkSession) -> None:
    """Texts may be long, and a Python worker holds two Arrow batches at once: so few rows and bytes a batch, unless the
    session sets its own numbers."""
    for name, usual, own in (("maxRecordsPerBatch", "10000", ROWS_PER_BATCH), ("maxBytesPerBatch", "67108864b", BYTES_PER_BATCH)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) in (None, usual):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(own))


def free(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from all taken ones in any case."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def input_bytes(df: DataFrame, column: str) -> int:
    """Spark's estimate of a plan's size, which for a scan is that of its files; the bytes of ``column`` where it has none."""
    guess = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return guess if guess < 1 << 50 else df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_order(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(NULL_ID))


def arrow_map(df: DataFrame, schema: str, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> DataFrame:
    return df.mapInArrow(fn, schema)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(table_path(sf_dir, name))


def spread(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each unsigned 64-bit key, from its high bits after a multiplication."""
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n


def squeezed(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a string or binary column as zstandard frames, for texts that a shuffle moves; nulls stay."""
    at = df.columns.index(column)
    fields = [T.StructField(f.name, T.BinaryType() if f.name == column else f.dataType) for f in df.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            got = pa.array([None if (raw := x.as_buffer()) is None else squeeze(raw) for x in batch.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([got if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return df.mapInArrow(run, T.StructType(fields))


def unsqueezed(x: pa.Scalar, tool: zstandard.ZstdDecompressor) -> bytes | None:
    raw = x.as_buffer()
    return None if raw is None else tool.decompress(raw)


def local_components(u: np.ndarray, v: np.ndarray, n: int, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes; ``labels`` holds what earlier edges have joined."""
    labels = np.arange(n) if labels is None else labels
    while len(u):
        a, b = labels[u], labels[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        if not open_.any():
            break
        u, v, low, high = u[open_], v[open_], low[open_], high[open_]
        np.minimum.at(labels, high, low)
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` of every node in ``edges (a long, b long)``; root is the smallest node reachable.

    Alternating large-star and small-star rounds: each keeps at most one row per edge, each round's edges are
    a table in the shared folder, and only a count and a checksum reach the driver.  Null ends are dropped.
    """
    spark = edges.sparkSession
    now = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a > b")
        least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = down.join(least, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a > b").distinct()
        now = cut(small, "edges")
        got = tuple(now.agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if got == mark:
            break
        mark = got
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text; ``bytes.split`` cuts at exactly the six characters that WORD leaves out."""
    return text.encode().split() if text else []


def default_tokenizer(name: str) -> str:
    """Path of a public vocabulary file: ``QUARTZITE_TOKENIZERS`` or the folder that the image offers."""
    return os.path.join(os.environ.get("QUARTZITE_TOKENIZERS", "/opt/tokenizers"), name)
