"""What every operator here needs from the cluster: shared staging, code on the executors, bounded broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows a Python worker gets at once. Texts can be long, so this stays far below Spark's default.
ARROW_ROWS = 2048
#: A lookup side of at most this many narrow rows (tens of bytes each) may be broadcast.
BROADCAST_ROWS = 200_000

_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers and bound their batches."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[1]
        archive = os.path.join(tempfile.mkdtemp(prefix="edgetide-code-"), "edgetide.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: the one in spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary folder; a cluster gets the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if spark.sparkContext.master.startswith("local"):
            _own_dirs[app] = Path(tempfile.mkdtemp(prefix="edgetide-")).as_uri()
        else:
            _own_dirs[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_edgetide"
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/edgetide-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def lookup(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (staged) as the small side of a join: broadcast if it is counted to be small enough."""
    return F.broadcast(df) if at_most(df, rows) else df


def fits(df: DataFrame, column: str, rows: int, size: int = 32 << 20) -> bool:
    """Has ``df`` (staged) at most so many rows, whose binary ``column`` is at most ``size`` bytes in all?"""
    return at_most(df, rows) and (df.agg(F.sum(F.octet_length(column))).first()[0] or 0) <= size


def text_keys() -> list[Column]:
    """128 bits that tell texts apart; null counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def remainder(key: str, modulus: int) -> Column:
    return F.crc32(F.col(key).cast("string")) % F.lit(modulus)


def bounded_sample(df: DataFrame, key: str, bound: int, salt: int) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of ``key``: the same rows in every run."""
    n = df.count()
    if n <= bound:
        return df
    cut = int(bound / n * (1 << 40))
    return df.where(F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1 << 40)) < F.lit(cut))


def bounded_rows(df: DataFrame, bound: int, salt: int) -> DataFrame:
    """About ``bound`` rows of (doc_id, text, ...) at most, chosen by a hash of id and text, so that neither an id nor a
    text that repeats comes in whole beyond its share; identical rows count once where the bound is passed."""
    n = df.count()
    if n <= bound:
        return df
    once = df.dropDuplicates(["doc_id", "text"])
    n = once.count()
    cut = int(min(1.0, bound / n) * (1 << 40))
    return once.where(F.pmod(F.xxhash64(F.lit(salt), "doc_id", "text"), F.lit(1 << 40)) < F.lit(cut))


def and_double(schema: T.StructType, name: str) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(name, T.DoubleType())])
