"""Tables that end a plan's lineage, in the folder that driver and executors share."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from atexit import register

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where that is unset, a session within one machine gets a folder of its own, and any
    other is refused: its executors would not see each other's files."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="quartzite-")
        register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return "file://" + _LOCAL[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; what is left of it when the driver ends is deleted then."""
    top = f"{shared_dir(spark)}/quartzite/{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(hadoop)
    system.deleteOnExit(hadoop)
    return f"{top}/{name}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
