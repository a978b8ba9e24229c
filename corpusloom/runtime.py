"""Session-level helpers shared by every operator."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to Python; bounds a worker's memory when rows hold long texts.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that operators rely on; values the user has set are kept."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where none is set, a folder below the warehouse in local mode; a
    cluster without the setting is an error, since its executors could not read each other's local disks."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm, where = spark._jvm, spark._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(where).delete(target, True)
    except Exception:  # noqa: BLE001  the JVM may have ended first
        pass


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` once as a table in the shared checkpoint folder and reads it back.

    Later passes neither recompute it nor depend on an executor that may be lost, and they prune its columns. The
    table is removed by ``release`` or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def cut_observed(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """``cut``, and measures of the rows that were written, taken while they were written."""
    seen = Observation()
    out = cut(df.observe(seen, *(m.alias(n) for n, m in measures.items())))
    return out, seen.get


def release(df: DataFrame) -> None:
    """Removes a table that ``cut`` wrote, once nothing reads it any more."""
    path = getattr(df, "_stage_path", None)
    if path:
        _drop(df.sparkSession, path)
        df._stage_path = None


def spread(df: DataFrame) -> DataFrame:
    """Raises the parallelism of a narrow scan whose file has fewer splits than the cluster has cores."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, key: str) -> DataFrame:
    """One row for each non-null key: repeated deliveries keep their id."""
    return df.where(F.col(key).isNotNull()).dropDuplicates([key])
