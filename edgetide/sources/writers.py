"""Sinks: histograms as CSV, a network as DOT, both written by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.functions.truth import rank

#: Shapes that the drawing gives node types.
SHAPES = {"INPAD_SOURCE": "cds", "FF_SOURCE": "box", "FF_SINK": "box", "OUTPAD_SINK": "rarrow", "PRIMITIVE_OPIN": "ellipse"}


def histograms(rows: DataFrame, path: str, gzip: bool = False) -> None:
    """rows (name, delay, probability): a folder a name, with one CSV file by ascending delay and a header."""
    placed = rows.select("name", "delay", "probability").repartition("name").sortWithinPartitions("name", "delay")
    placed.write.partitionBy("name").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line) of a directed graph; lines belong in the order of part, and within a part in any.

    nodes (node, type) and edges (src, dst, delay); a node's name is quoted, so it may hold any character.
    """
    spark = nodes.sparkSession
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    shapes = F.create_map(*[F.lit(x) for kv in SHAPES.items() for x in kv])
    shape = F.coalesce(F.concat(F.lit(" shape="), F.try_element_at(shapes, F.coalesce("type", F.lit("")))), F.lit(""))
    label = F.concat(F.lit('[label="'), F.coalesce("type", F.lit("")), F.lit('"'), shape, F.lit("]"))
    lines = spark.createDataFrame([(0, "digraph G {"), (3, "}")], "part int, line string")
    lines = lines.union(nodes.select(F.lit(1), F.concat(quoted("node"), label)))
    return lines.union(edges.select(F.lit(2), F.concat(quoted("src"), F.lit(" -> "), quoted("dst"), F.lit('[label="'), F.col("delay").cast("string"), F.lit('"]'))))


def write_dot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as text files that make the drawing when read in order of their names."""
    dot(nodes, edges).repartitionByRange("part", "line").sortWithinPartitions("part", "line").select("line").write.text(path)


def exhaustive(rows: DataFrame, circuit, output: str, numbered: bool = False) -> DataFrame:
    """A row a vector of ``extended.simulate``: a column ``<input>:<number>`` an input, the output's transition, its delay; in the
    order of the inputs by R, F, H, L, and with ``numbered`` the place in that order."""
    columns = {n: f"{n}:{i}" for i, n in enumerate(circuit.inputs)}
    found = rows.select(*[F.col(n).alias(c) for n, c in columns.items()], F.col(f"`out:{output}`")["trans"].alias(output), F.col(f"`out:{output}`")["arr"].alias("delay"))
    code = sum((rank(F.col(f"`{c}`")) * 4 ** (len(columns) - 1 - i) for i, c in enumerate(columns.values())), F.lit(0))
    return found.withColumn("row_no", code.cast("long")) if numbered else found.orderBy(code)


def write_exhaustive(rows: DataFrame, circuit, output: str, path: str, gzip: bool = False) -> None:
    """``exhaustive`` as CSV files with a header, which in order of their names are in order of the vectors."""
    found = exhaustive(rows, circuit, output, numbered=True)
    placed = found.repartitionByRange("row_no").sortWithinPartitions("row_no").drop("row_no")
    placed.write.option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def cycles_table(measured: DataFrame, signals: list[str]) -> DataFrame:
    """A row a cycle of ``waveform.measured`` (run_id, cycle, signal, trans, delay, rise): per signal its transition, ``delay:`` and
    ``sim_time:``, and MAX over all."""
    of = lambda s, c: F.max(F.when(F.col("signal") == s, c))
    at = F.col("rise") + F.col("delay")
    columns = [x for s in signals for x in (of(s, F.col("trans")).alias(s), of(s, F.col("delay")).alias(f"delay:{s}"), of(s, at).alias(f"sim_time:{s}"))]
    return measured.groupBy("run_id", "cycle").agg(*columns, F.lit("-").alias("MAX"), F.max("delay").alias("delay:MAX"), F.max(at).alias("sim_time:MAX"))


def write_table(rows: DataFrame, path: str, order: list[str], gzip: bool = False) -> None:
    """Any summary as CSV with a header, sorted over its files: cycles, levels by falling width, run summaries."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def level_times(widths: DataFrame, times: DataFrame) -> DataFrame:
    """(width, level, <action>...) from widths (level, nodes) and times (level, action, seconds)."""
    wide = times.groupBy("level").pivot("action").agg(F.avg("seconds"))
    return widths.select(F.col("nodes").alias("width"), "level").join(wide, "level", "left").orderBy(F.desc("width"), "level")


def dump(levels: DataFrame, edges: DataFrame) -> DataFrame:
    """(level, line): a line of text a node with its targets, for reading."""
    out = edges.groupBy("src").agg(F.array_sort(F.collect_list(F.concat_ws(":", F.col("dst").cast("string"), F.col("delay").cast("string")))).alias("to"))
    found = levels.join(out, F.col("node") == F.col("src"), "left")
    return found.select("level", F.concat(F.lit("Level "), F.col("level").cast("string"), F.lit(" "), F.col("node").cast("string"), F.lit(" -> "), F.coalesce(F.array_join("to", " "), F.lit(""))).alias("line"))
