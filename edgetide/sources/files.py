"""Plain files: CSV with named columns, name lists, log lines; and small texts written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgetide.staging import new_path


def csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """The named columns (name: type) of CSV files with a header; no other column is parsed. A value that is not of its
    type is null."""
    text = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    return text.select(*[F.expr(f"try_cast(`{c}` as {t})").alias(c) for c, t in columns.items()])


def base_name(column: str) -> str:
    """What stands before the colon of a column's name."""
    return column.split(":", 1)[0]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, line_no, value) of text files, each read whole and in order."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))
    return whole.select("source", "line_no", "value")


def names(spark: SparkSession, path: str) -> DataFrame:
    """(source, name, pos): the lines that are not blank, numbered from 0."""
    found = lines(spark, path).select("source", "line_no", F.trim("value").alias("name")).where("name <> ''")
    place = F.row_number().over(Window.partitionBy("source").orderBy("line_no")) - 1
    return found.select("source", "name", place.alias("pos"))


def highest_node(paths: DataFrame, pattern: str) -> DataFrame:
    """(path, number) of the file whose name has the largest number in ``pattern``'s group."""
    number = F.expr("try_cast(found as bigint)")
    each = paths.select("path", F.regexp_extract("path", pattern, 1).alias("found")).select("path", number.alias("number"))
    return each.agg(F.max_by("path", "number").alias("path"), F.max("number").alias("number"))


def scratch(spark: SparkSession, text: str, name: str) -> str:
    """A small text as a file of its own in the shared folder, written by Spark; returns its folder."""
    path = f"{new_path(spark)}/{name}"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path
