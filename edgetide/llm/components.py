"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a map-side combined aggregation and a join; edges stay distributed, and each step's table is
written to the shared folder. The number of steps grows with the logarithm of the longest path. A table that is
counted to hold few edges is finished by one executor task with arrays instead: the same result without the jobs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.llm.runtime import at_most, prepare, stage

#: Edges that one task may hold.
ONE_TASK = 200_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["id", "root"])


def _toward_least(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b): every neighbour b of a (above a if ``large``, else not above) is tied to the least of a's neighbourhood."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "cc-least")
    tied = both.join(least, "a")
    if large:
        new = tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = tied.select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return new.where(F.col("a") != F.col("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Is every component a star, each a tied once to its root?"""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("tied"), F.lit(0).alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("tied"), F.lit(1).alias("root")))
    seen = ends.groupBy("id").agg(F.sum("tied").alias("tied"), F.max("root").alias("root"))
    return seen.where((F.col("tied") > 1) | ((F.col("tied") == 1) & (F.col("root") == 1))).isEmpty()


def components(edges: DataFrame, limit: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(a, b) pairs of ids to (id, root): root is the least id reachable. Ids without an edge don't appear.

    Null ids and loops are ignored; an empty table gives an empty table.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = nodes = stage(ordered.where("a is not null and b is not null and a <> b").distinct(), "cc-edges")
    if one_task and at_most(now, one_task):
        prepare(now.sparkSession)
        return stage(now.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).coalesce(1).mapInArrow(_united, "id long, root long"), "cc-roots")
    for _ in range(limit):
        if _settled(now):
            break
        now = stage(_toward_least(stage(_toward_least(now, True), "cc-large"), False), "cc-small")
    else:
        raise RuntimeError("components did not settle")
    root = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return root.unionByName(nodes.select(F.col("b").alias("id")).distinct().join(root.select("id"), "id", "left_anti").withColumn("root", F.col("id")))
