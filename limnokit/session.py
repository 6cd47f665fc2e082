"""Session defaults and tables settled in shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
# HotSpot does not compile longer methods; Spark then splits the code
COMPILED_BYTES = 8000


def build_session(app_name: str = "limnokit", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling on, in UTC."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        METHOD_LIMIT: str(COMPILED_BYTES),
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read, as the session names it.

    ``spark.checkpoint.dir`` if the cluster sets it, else the checkpoint folder
    set on the context, else ``spark.sql.warehouse.dir``. No folder of the
    driver's machine is ever made up here.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or spark.conf.get("spark.sql.warehouse.dir")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in a new folder of the shared one; the folder goes when the session's file system closes."""
    folder = f"{shared_dir(spark)}/hand-off/{label}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(target)
    system.deleteOnExit(target)
    return f"{folder}/data"


@contextmanager
def compiled_steps(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside have no generated method that HotSpot would leave interpreted.

    For steps that compute much per reading, in whatever session they run; the
    session's own limit is back afterwards. Results do not depend on it.
    """
    own = spark.conf.get(METHOD_LIMIT)
    spark.conf.set(METHOD_LIMIT, str(min(int(own), COMPILED_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(METHOD_LIMIT, own)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result survives the loss of any executor, is computed once however
    often it is used, has a short plan, and its size is known to Catalyst.
    The files go when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)
