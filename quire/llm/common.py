"""What the operators share: sessions, the shared folder, column names."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


#: Arrow batches to Python workers: small enough that two workers of an executor and its buffers stay within a few hundred MB.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.execution.arrow.maxRecordsPerBatch": 2048}


def prepared(spark: SparkSession) -> SparkSession:
    """Bounds the session's Arrow batches, and lets Python workers import this package when they start in another folder (a cluster gets it by --py-files)."""
    for name, value in BATCH.items():
        spark.conf.set(name, str(value))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([*paths, ROOT])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir; only where that is unset and Spark runs in this one process, below a temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[[^,\]]*(,\s*\d+\s*)?\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/quire-{uuid.uuid4().hex}"


#: With it, Spark deletes the shuffle files of a plan when it has run, not when its objects are collected.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, where: str | None = None, free: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and survives lost executors. free: its shuffle files go at once."""
    spark = df.sparkSession
    where = where or shared_dir(spark)
    before = spark.conf.get(FREE, "false")
    if free:
        spark.conf.set(FREE, "true")
    try:
        df.write.mode("overwrite").parquet(where)
    finally:
        spark.conf.set(FREE, before)
    return spark.read.schema(df.schema).parquet(where)


def remove(spark: SparkSession, where: str) -> None:
    """Deletes a folder that written() made, through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def others(df: DataFrame, *taken: str) -> list[str]:
    """Columns of df whose names differ from those taken, without regard to case."""
    names = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in names]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def crc_rest(column: Column, divisor: int) -> Column:
    """crc32 of an id as text, modulo divisor; null ids count as remainder -1."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % divisor, F.lit(-1))


def docs_of(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


