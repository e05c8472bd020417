"""Static timing on a network: arrival, required time and slack, for setup and hold, by clock domain.

Times are doubles or longs; a time that is not known is null, never NaN.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.operators.graph import Plain, fold, plain_fold


def sources(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def starts(levels: DataFrame) -> DataFrame:
    """The sources again, from the levels: they are the first."""
    return levels.where("level = 0").select("node")


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def arrival(edges: DataFrame, levels: DataFrame, seeds: DataFrame | None = None, hold: bool = False) -> DataFrame:
    """(node, arrival): latest (hold: earliest) time at every node; sources start at 0 unless seeds (node, arrival) says else."""
    seeds = starts(levels).withColumn("arrival", F.lit(0).cast("long")) if seeds is None else seeds
    pick = "min" if hold else "max"
    return plain_fold(edges, levels, seeds, Plain("arrival", pick, 1))


def launched_arrival(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """(node, arrival, launch): the source that the latest time comes from; of equal times the least source."""
    seeds = starts(levels).select("node", F.lit(0).cast("long").alias("arrival"), F.col("node").alias("launch"))
    first = F.struct(-F.col("arrival"), F.col("launch"))
    merge = [F.max("arrival").alias("arrival"), F.min_by("launch", first).alias("launch")]
    return fold(edges, levels, seeds, [], {"arrival": F.col("arrival") + F.col("delay"), "launch": F.col("launch")}, merge)


def domain_arrival(edges: DataFrame, levels: DataFrame, seeds: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(node, domain, arrival) from seeds (node, domain, arrival); pairs (domain) leaves only domains under analysis."""
    if pairs is not None:
        seeds = seeds.join(F.broadcast(pairs.select("domain").distinct()) if pairs.count() <= 10_000 else pairs, "domain", "left_semi").select(*seeds.columns)
    return fold(edges, levels, seeds, ["domain"], {"arrival": F.col("arrival") + F.col("delay")}, [F.max("arrival").alias("arrival")])


def required(edges: DataFrame, levels: DataFrame, ends: DataFrame, hold: bool = False) -> DataFrame:
    """(node, required) from ends (node, required): min (hold: max) over out-edges of required minus delay."""
    return plain_fold(edges, levels, ends, Plain("required", "max" if hold else "min", -1), backward=True)


def end_constraints(edges: DataFrame, arrivals: DataFrame, constraint: float) -> DataFrame:
    """(node, required) of endpoints: the constraint, or a node's own arrival where the constraint is below zero."""
    own = endpoints(edges).join(arrivals, "node")
    return own.select("node", (F.col("arrival") if constraint < 0 else F.lit(constraint).cast("long")).alias("required"))


def critical_path_delay(arrivals: DataFrame) -> DataFrame:
    return arrivals.agg(F.max("arrival").alias("cpd"))


def check(computed: DataFrame, expected: DataFrame, relative: float = 1e-5, absolute: float = 1e-13) -> DataFrame:
    """Rows (node, computed, expected) that differ by more than both tolerances, or that one side lacks."""
    c, e = computed.toDF("node", "computed"), expected.toDF("node", "expected")
    joined = c.join(e, "node", "full")
    gap = F.abs(F.col("computed") - F.col("expected"))
    wrong = (gap > absolute) & (gap / F.greatest(F.abs("computed"), F.abs("expected")) > relative)
    return joined.where(F.col("computed").isNull() != F.col("expected").isNull()).union(joined.where(wrong))
