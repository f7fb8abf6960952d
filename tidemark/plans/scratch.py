"""Where intermediate tables go: the shared folder named in ``spark.checkpoint.dir``.

A table belongs to whoever asked for the path. Nothing is deleted here, because a frame that
reads the table may still be in use: the owner calls :func:`remove` when its last reader is done.
"""

import uuid

from pyspark.sql import SparkSession


def scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a table below the shared folder; False if there is none. Raises for any other path."""
    if not path.startswith(scratch_root(spark) + "/"):
        raise ValueError(f"{path} is not below the shared folder")
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)
