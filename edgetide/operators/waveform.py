"""Delays measured in value-change waveforms: changes (run_id, signal, t, val), any number of runs at once.

A cycle begins at a clock change from 0 to 1 and ends at the next clock change; it counts only if the run has a later
tick. A signal's value at a time is that of its last change strictly before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clock_edges(changes: DataFrame, clock: str) -> DataFrame:
    """(run_id, t, edge): rise or fall; a change from an unknown value is neither."""
    w = Window.partitionBy("run_id").orderBy("t")
    c = changes.where(F.col("signal") == clock).withColumn("before", F.lag("val").over(w))
    edge = F.when((F.col("before") == 0) & (F.col("val") == 1), "rise").when((F.col("before") == 1) & (F.col("val") == 0), "fall")
    return c.select("run_id", "t", edge.alias("edge")).where("edge is not null")


def cycles(changes: DataFrame, clock: str) -> DataFrame:
    """(run_id, cycle, rise, fall)."""
    w = Window.partitionBy("run_id").orderBy("t")
    c = changes.where(F.col("signal") == clock).select("run_id", "t", "val", F.lag("val").over(w).alias("before"), F.lead("t").over(w).alias("fall"))
    last = changes.groupBy("run_id").agg(F.max("t").alias("last"))
    rises = c.where("before = 0 and val = 1 and fall is not null").join(last, "run_id").where("last > fall")
    return rises.select("run_id", (F.row_number().over(w) - 1).cast("long").alias("cycle"), F.col("t").alias("rise"), "fall")


def filled(changes: DataFrame, signals: list[str]) -> DataFrame:
    """(run_id, t, <signal>...): every signal's value at every tick, unknown (null) before its first change."""
    upto = Window.partitionBy("run_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    wide = changes.groupBy("run_id", "t").agg(*[F.max(F.when(F.col("signal") == s, F.col("val"))).alias(s) for s in signals])
    return wide.select("run_id", "t", *[F.last(s, ignorenulls=True).over(upto).alias(s) for s in signals])


def measured(changes: DataFrame, clock: str, signals: list[str]) -> DataFrame:
    """(run_id, cycle, signal, initial, final, delay): values before rise and before fall, and last change after rise.

    The as-of lookups are one forward fill over the run's changes and cycle marks, sorted together.
    """
    c = cycles(changes, clock)
    marks = c.select("run_id", F.col("rise").alias("t"), F.lit(0).alias("mark"), "cycle", "rise").union(c.select("run_id", F.col("fall").alias("t"), F.lit(1).alias("mark"), "cycle", "rise"))
    marks = marks.select("*", F.explode(F.array(*[F.lit(s) for s in signals])).alias("signal"))
    events = changes.where(F.col("signal").isin(signals)).select("run_id", "signal", "t", F.lit(None).cast("int").alias("mark"), F.lit(None).cast("long").alias("cycle"), F.lit(None).cast("long").alias("rise"), "val", F.col("t").alias("changed"))
    both = events.unionByName(marks.select("run_id", "signal", "t", "mark", "cycle", "rise", F.lit(None).cast("int").alias("val"), F.lit(None).cast("long").alias("changed")))
    # a mark comes before a change at its own tick: only what is strictly before counts
    w = Window.partitionBy("run_id", "signal").orderBy("t", F.col("mark").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("now", F.last("val", ignorenulls=True).over(w)).withColumn("at", F.last("changed", ignorenulls=True).over(w)).where("mark is not null")
    at = known.groupBy("run_id", "cycle", "signal", "rise").agg(F.max(F.when(F.col("mark") == 0, F.col("now"))).alias("initial"), F.max(F.when(F.col("mark") == 1, F.col("now"))).alias("final"), F.max(F.when(F.col("mark") == 1, F.col("at"))).alias("changed"))
    delay = F.when(F.col("changed") >= F.col("rise"), F.col("changed") - F.col("rise")).otherwise(0).cast("long")
    return at.select("run_id", "cycle", "signal", "initial", "final", delay.alias("delay"))
