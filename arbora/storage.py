"""Tables that cut a lineage, kept in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset, a temporary folder, but only under a local master."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        known = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="arbora-"))
    return known.rstrip("/")


class Workspace:
    """Writes tables under one folder of the shared directory and deletes what is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/arbora/{name}-{uuid.uuid4().hex}"
        self.tables: set[str] = set()

    def save(self, df: DataFrame, table: str) -> DataFrame:
        """Writes df as Parquet and returns it reread, so that a lost executor costs one read.

        The schema is given, so no job infers it and an empty table reads back."""
        path, schema = f"{self.root}/{table}", df.schema
        self.tables.add(table)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *tables: str) -> None:
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.tables.discard(table)

    def drop_all_but(self, *tables: str) -> None:
        """Deletes every table written so far, except those that a result still reads."""
        self.drop(*(self.tables - set(tables)))
