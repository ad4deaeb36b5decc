"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_paths: WeakKeyDictionary = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, or spark.checkpoint.dir. Only a local session may have neither: it gets a folder in /tmp."""
    if found := spark.sparkContext.getCheckpointDir():
        return found
    if found := spark.conf.get("spark.checkpoint.dir", ""):
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "/tmp/groundwork-checkpoints"


def ready(spark: SparkSession) -> None:
    """checkpoint() needs a folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage, and a lost executor loses nothing of it. Many small files want no codec, as
    each file's takes a buffer of a page."""
    spark = df.sparkSession
    df.write.option("compression", codec).parquet(path := place(spark, name))
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for table in tables:
        if path := _paths.pop(table, None):
            jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
