"""Cutting lineage between the rounds of an iterative plan: tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of the session's application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="edgetide-code-"), "edgetide.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where unset, a temporary folder for a local session and the warehouse for a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_rounds"
    return _local.setdefault(spark.sparkContext.applicationId, Path(tempfile.mkdtemp(prefix="edgetide-rounds-")).as_uri())


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/rounds-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """df written and read back; ``by`` names a column to make folders of, so that a filter on it reads only those.

    What this returned is not written again.
    """
    if by is None and getattr(df, "is_written", False):
        return df
    spark = df.sparkSession
    path = new_path(spark)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.is_written = by is None
    return back


class Levels:
    """A table that grows by a folder a level; it is read as one table, however many levels there are."""

    def __init__(self, spark: SparkSession, column: str = "level"):
        self.spark, self.path, self.column, self.schema, self.count = spark, new_path(spark), column, None, 0

    def add(self, df: DataFrame, level: int) -> DataFrame:
        path = f"{self.path}/{self.column}={level}"
        df.write.parquet(path)
        self.schema, self.count = df.schema, self.count + 1
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self) -> DataFrame:
        """All that was added, with the level as a column (int)."""
        return self.spark.read.schema(self.schema).parquet(self.path).withColumn(self.column, F.col(self.column).cast("int"))
