"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Intermediate tables in the folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a local session gets a folder of its own
    and any other master is refused, since a folder of one machine would lose rows there. Writing and rereading cuts
    the lineage, so a lost executor costs only the stage that it ran. What isn't dropped before goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.made = spark, {}, 0
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = os.path.join(tempfile.gettempdir(), "checkpoints", f"strandline-{os.getuid()}")
        self.root = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{label}-{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def store(self, name: str, content: bytes) -> str:
        """Path of a file with this content."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path)
        out.write(content)
        out.close()
        return path.toString()

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            _, path = self.paths.pop(id(df), (None, None))
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)
