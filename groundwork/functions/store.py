"""Tables written to the folder that driver and executors share: they cut the lineage, and a lost executor loses nothing of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, or spark.checkpoint.dir; only a local session may have neither."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", "")
    if not found and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or "/tmp/groundwork-checkpoints"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a table that is computed once; checkpoint() computes its rows twice. Many small files want no codec, as each file's takes a buffer of a page."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Removes a written table that nothing reads any more."""
    spark = table.sparkSession
    for file in {x.rsplit("/", 1)[0] for x in table.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(file)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
