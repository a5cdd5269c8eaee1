"""Tables written once to the shared folder and read back: they cut the lineage and outlive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PREFIX = "lumenframe-staged"


def folder(spark: SparkSession) -> str:
    """Where staged tables lie: in spark.checkpoint.dir; in a folder of our own where that is unset and Spark is local."""
    where, master = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.master", "local")
    if not where:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lumenframe-stage-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/{_PREFIX}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of its own."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Deletes all tables staged so far; results that still read them can't be computed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
