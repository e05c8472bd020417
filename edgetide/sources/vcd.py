"""VCD waveforms as a DataFrame of changes, by Spark's text reader (gzip by extension) and window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(signals, changes): id, name, type, width; and run_id (the file), seq, t, id, val (0 1 x z).

    A file's lines are numbered as they are read and its times are filled forward; a file is one trace and one run.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("run_id"), F.posexplode(F.split("value", r"\r?\n")).alias("seq", "line"))
    lines = whole.withColumn("line", F.trim("line"))
    var = lines.where(F.col("line").startswith("$var"))
    part = F.split("line", r"\s+")
    signals = var.select("run_id", F.get(part, 3).alias("id"), F.get(part, 4).alias("name"), F.get(part, 1).alias("type"), F.get(part, 2).cast("int").alias("width"))
    upto = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    timed = lines.withColumn("t", F.last(F.when(F.col("line").rlike("^#[0-9]+$"), F.substring("line", 2, 30).cast("long")), ignorenulls=True).over(upto))
    change = F.regexp_extract("line", r"^([01xXzZ])(\S+)$", 1)
    changes = timed.where(change != "").select("run_id", F.col("seq").cast("long").alias("seq"), F.coalesce("t", F.lit(0)).alias("t"), F.regexp_extract("line", r"^([01xXzZ])(\S+)$", 2).alias("id"), F.lower(change).alias("val"))
    return signals, changes


def scraped(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """First match of each pattern's group in lines (source, line_no, value): (source, key, found)."""
    keys = F.array(*[F.struct(F.lit(k).alias("key"), F.regexp_extract("value", p, 1).alias("found")) for k, p in patterns.items()])
    each = lines.select("source", "line_no", F.explode(keys).alias("m")).select("source", "line_no", "m.*").where("found <> ''")
    return each.groupBy("source", "key").agg(F.min_by("found", "line_no").alias("found"))
