"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

A staged table cuts lineage as ``checkpoint()`` does, but as compressed Parquet: a lost executor costs only
the tasks that were running, and later steps read just the columns they need.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset (tests in local mode) a folder of our own."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="cairn-")
    return _OWN[app]


class Stage:
    """Writes tables below one folder and removes those no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/cairn/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made:04d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cairn_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes the files of a table that ``put`` returned; nothing may read it afterwards."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._cairn_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
