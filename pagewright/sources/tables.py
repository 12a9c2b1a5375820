"""Tables that a plan keeps between its stages, in a folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

#: Rows that a task gets of a table dealt by a key.
EACH = 150_000


def dealt(df: DataFrame, rows: int, key: str | Column, each: int = EACH) -> DataFrame:
    """df, of about `rows` rows, dealt by key to tasks of about `each`, one for each core at least. Windows, groups and folds by that key need no shuffle
    then, and a task's memory does not follow the size of df, as it does where the number of partitions is fixed."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)), key)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir. Where that is unset, a local session gets a temporary folder, and a cluster an error: its machines
    share no other."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """df evaluated once, as a Parquet table that survives the loss of any executor."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
