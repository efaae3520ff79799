"""Session helpers: table access, lineage cuts, partition sizing."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session that names none (tests) gets a temporary folder; on a cluster
    a machine's own folder would be lost with it, so there a missing name is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = have.get() if have.isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="quirelight-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with a table that survives the loss of executors, so that
    several consumers read one result instead of computing it again.
    """
    spark = df.sparkSession
    path = f"{staging(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staging(spark: SparkSession) -> str:
    """The application's own folder for staged tables."""
    return f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete the application's staged tables; DataFrames that read them can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(staging(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def conf(spark: SparkSession, **settings: str):
    """Session settings (dots written as ``__``) for the time of a block."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
