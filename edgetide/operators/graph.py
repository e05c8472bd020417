"""Relational operators on directed acyclic networks: edges (src, dst, ...) of any id type.

Loops run a job a level; each level's rows are written once and never worked out again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgetide.staging import Levels, ship, written

#: Edges that one task may finish.
TAIL = 200_000


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def levelize(edges: DataFrame) -> DataFrame:
    """(node, level): level is the longest distance from a node without fan-in. Nodes on or behind a cycle have no row.

    A level sends a count along its out-edges; a node is in the next level when it has heard from all in-edges. Only
    nodes that have heard from some are kept between levels. Edges that are used up are left behind whenever half of
    them are, and the last TAIL edges are finished in one task, so a long thin end costs no job a level.
    """
    spark = ship(edges.sparkSession)
    links = written(edges)
    total = links.count()
    if total <= TAIL:
        kind = edges.schema["src"].dataType.simpleString()
        return written(links.select("src", "dst").coalesce(1).mapInPandas(_levels_of_rest(0, True), f"node {kind}, level int"))
    links = links.select("src", "dst")
    need = written(links.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("need")))
    front = links.select(F.col("src").alias("node")).distinct().join(need, "node", "left_anti")
    out, heard, level = Levels(spark), None, 0
    left = kept = total
    while True:
        front = out.add(front.select("node"), level)
        if not left or front.isEmpty():
            break
        if left <= TAIL:
            rest = links.join(out.table().where(F.col("level") < level).select(F.col("node").alias("src")), "src", "left_anti")
            tail = rest.coalesce(1).mapInPandas(_levels_of_rest(level), f"node {front.schema['node'].dataType.simpleString()}, level int")
            # a level's folder has a level's rows, but for those of the tail
            return written(out.table().select("node", "level").unionByName(tail))
        if left * 2 < kept and level:
            links, kept = written(links.join(out.table().where(F.col("level") < level).select(F.col("node").alias("src")), "src", "left_anti")), left
        got = links.join(front, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("got"))
        if heard is not None:
            got = got.unionByName(heard).groupBy("node").agg(F.sum("got").alias("got"))
        state = written(got.join(need, "node").select("node", "got", (F.col("got") == F.col("need")).alias("ready")))
        sums = state.groupBy("ready").agg(F.sum("got").alias("got")).collect()
        done = {r["ready"]: r["got"] for r in sums}
        # what waits has used got edges; what was ready in earlier levels has used all of its own
        total -= done.get(True, 0)
        left = total - done.get(False, 0)
        front, heard, level = state.where("ready"), state.where("not ready").select("node", "got"), level + 1
    return out.table().select("node", "level")


def _levels_of_rest(level: int, first: bool = False):
    """Levels of the ends of the edges that are left, where what has no in-edge among them is at ``level`` and left out,
    unless ``first`` says that it is not known yet."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        src, dst, names = _coded(pd.concat(parts))
        at, to = _out_edges(src, dst, len(names))
        need, place = np.bincount(dst, minlength=len(names)), np.full(len(names), -1)
        front, now = np.flatnonzero(need == 0), level
        while len(front):
            place[front] = now
            heard = to[runs(at[front], at[front + 1])]
            np.subtract.at(need, heard, 1)
            heard = np.unique(heard)
            front, now = heard[need[heard] == 0], now + 1
        on = place >= level if first else place > level
        yield pd.DataFrame({"node": names[on], "level": place[on].astype(np.int32)})

    return each


def _coded(edges: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, names = pd.factorize(pd.concat([edges["src"], edges["dst"]], ignore_index=True))
    return codes[: len(edges)], codes[len(edges) :], np.asarray(names)


def _out_edges(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each node's targets begin, and the targets."""
    return np.r_[0, np.cumsum(np.bincount(src, minlength=n))], dst[np.argsort(src, kind="stable")]


def runs(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The indexes low[i] .. high[i] - 1 of all i, one after the other."""
    n = high - low
    return np.repeat(high - np.cumsum(n), n) + np.arange(n.sum())


@dataclass(frozen=True)
class Plain:
    """A fold of one number that a task can finish with arrays: what meets is taken by max, min or sum; an edge adds
    ``sign`` times its delay."""

    value: str
    pick: str
    sign: int

    def across(self) -> dict[str, Column]:
        return {self.value: F.col(self.value) + self.sign * F.col("delay") if self.sign else F.col(self.value)}

    def merge(self) -> list[Column]:
        return [getattr(F, self.pick)(self.value).alias(self.value)]


def fold(edges: DataFrame, levels: DataFrame, seeds: DataFrame, key: list[str], across: dict[str, Column], merge: list[Column], backward: bool = False, plain: Plain | None = None) -> DataFrame:
    """A value for every node from those of its neighbours, level by level: the one loop behind all traversals.

    seeds has ``node``, the columns of ``key`` and the value columns. Along an edge ``across`` gives the new values
    (the edge's and the tag's columns may be named); what meets at a node under one key is merged by the aggregates of
    ``merge``. Forward by default, else from sinks to sources. Seeds of a node meet what arrives there.

    A finished level joins its out-edges once and what it sends is written by the level that it goes to; edges and
    messages are each read once, whatever the depth. With ``plain`` the last TAIL edges are finished in one task.
    """
    spark = ship(edges.sparkSession)
    edges = written(edges)
    at, to = ("dst", "src") if backward else ("src", "dst")
    if plain is not None and (not edges.limit(TAIL + 1).count() > TAIL):
        return written(_plain_tail(plain, [seeds], edges, at, to))
    here, there = levels.select(F.col("node").alias(at), F.col("level").alias("_from")), levels.select(F.col("node").alias(to), F.col("level").alias("_to"))
    placed = written(edges.join(here, at).join(there, to), "_from")
    values = [c for c in seeds.columns if c not in ("node", *key)]
    known = written(seeds.select("node", *key, *values).join(levels.select("node", F.col("level").alias("_level")), "node"), "_level")
    pairs = {(r["_from"], r["_to"]): r["count"] for r in placed.groupBy("_from", "_to").count().collect()}
    seeded = {r["_level"]: r["count"] for r in known.groupBy("_level").count().collect()}
    order = sorted(seeded.keys() | {t for _, t in pairs}, reverse=backward)
    # what is still to be read: seeds, and edges into what is left, whose messages may be written already
    left = sum(seeded.values()) + sum(pairs.values())
    out, sent = Levels(spark, "_level"), {}
    for level in order:
        beyond = (lambda c: F.col(c) <= level) if backward else (lambda c: F.col(c) >= level)
        if plain is not None and left <= TAIL:
            held = [known.where(beyond("_level")), *[m.where(beyond("_to")) for m in sent.values()]]
            out.add(_plain_tail(plain, held, placed.where(beyond("_from")), at, to), level)
            break
        own = [known.where(F.col("_level") == level).select("node", *key, *values)] if level in seeded else []
        own += [m.where(F.col("_to") == level).select("node", *key, *values) for f, m in sent.items() if (f, level) in pairs]
        now = out.add(reduce(DataFrame.unionByName, own).groupBy("node", *key).agg(*merge), level)
        targets = [t for f, t in pairs if f == level]
        if targets:
            moved = placed.where(F.col("_from") == level).join(now.withColumnRenamed("node", "_at"), F.col(at) == F.col("_at"))
            sent[level] = written(moved.select(F.col(to).alias("node"), "_to", *key, *[across[v].alias(v) for v in values]), "_to")
        left -= seeded.get(level, 0) + sum(n for (_, t), n in pairs.items() if t == level)
        sent = {f: m for f, m in sent.items() if any(g == f and (t < level if backward else t > level) for g, t in pairs)}
    return out.table().drop("_level") if out.count else seeds.select("node", *key, *values).limit(0)


def _plain_tail(plain: Plain, held: list[DataFrame], edges: DataFrame, at: str, to: str) -> DataFrame:
    """What a plain fold gives from the values that nodes hold and the edges that are left, in one task."""
    node = held[0].schema["node"].dataType
    rows = [h.select("node", F.col(plain.value).cast("double").alias("value"), F.lit(None).cast(node).alias("to")) for h in held]
    rows.append(edges.select(F.col(at).alias("node"), (F.col("delay") if plain.sign else F.lit(0)).cast("double").alias("value"), F.col(to).alias("to")))
    found = reduce(DataFrame.unionByName, rows).coalesce(1).mapInPandas(_plain_rest(plain), f"node {node.simpleString()}, value double")
    return found.select("node", F.col("value").cast(held[0].schema[plain.value].dataType).alias(plain.value))


def _plain_rest(plain: Plain):
    """Rows (node, value, to): values that nodes hold (to is null), and edges with their delay."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        is_edge = rows["to"].notna().to_numpy()
        codes, names = pd.factorize(pd.concat([rows["node"], rows["to"][is_edge]], ignore_index=True))
        node, to, amount = codes[: len(rows)], codes[len(rows) :], rows["value"].to_numpy()
        join, none = {"max": (np.maximum, -np.inf), "min": (np.minimum, np.inf), "sum": (np.add, 0.0)}[plain.pick]
        value, has = np.full(len(names), none), np.zeros(len(names), bool)
        join.at(value, node[~is_edge], amount[~is_edge])
        has[node[~is_edge]] = True
        src, delay = node[is_edge], plain.sign * amount[is_edge]
        by = np.argsort(src, kind="stable")
        first, to, delay, src = np.r_[0, np.cumsum(np.bincount(src, minlength=len(names)))], to[by], delay[by], src[by]
        need, settled = np.bincount(to, minlength=len(names)), np.zeros(len(names), bool)
        front = np.flatnonzero(need == 0)
        while len(front):
            settled[front] = True
            out = runs(first[front], first[front + 1])
            carried = out[has[src[out]]]
            join.at(value, to[carried], value[src[carried]] + delay[carried])
            has[to[carried]] = True
            np.subtract.at(need, to[out], 1)
            heard = np.unique(to[out])
            front = heard[need[heard] == 0]
        on = has & settled
        yield pd.DataFrame({"node": np.asarray(names)[on], "value": value[on]})

    return each


def plain_fold(edges: DataFrame, levels: DataFrame, seeds: DataFrame, plain: Plain, backward: bool = False) -> DataFrame:
    return fold(edges, levels, seeds, [], plain.across(), plain.merge(), backward, plain)


def reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(root, node): every node that a root of start (root, node) reaches, itself included; each pair once."""
    found = front = written(start.select("root", "node").distinct())
    while not front.isEmpty():
        new = front.join(edges.select("src", "dst").distinct(), F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        front = written(new.join(found, ["root", "node"], "left_anti"))
        found = found.union(front)
    return found


def relayout(levels: DataFrame) -> DataFrame:
    """(node, level, new_id): ids renumbered so that a level's nodes are contiguous."""
    sizes = levels.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("level").orderBy("node"))
    return levels.join(base, "level").select("node", "level", (F.col("first") + place - 1).cast("long").alias("new_id"))


def degree_histogram(edges: DataFrame, end: str) -> DataFrame:
    return edges.groupBy(end).agg(F.count(F.lit(1)).alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


def bucket_histogram(values: DataFrame, column: str, buckets: int) -> DataFrame:
    """Average of ascending values in equal runs of them; a short last run is divided by its own length."""
    n = values.count()
    width = max(1, -(-n // max(1, min(n, buckets))))
    place = F.row_number().over(Window.orderBy(column))
    return values.withColumn("bucket", F.floor((place - 1) / width).cast("int")).groupBy("bucket").agg(F.avg(column).alias("mean"), F.count(F.lit(1)).alias("n"))


def verify(edges: DataFrame, expected_sources: Column, expected_sinks: Column) -> DataFrame:
    """One row a rule with the number of nodes that break it; the conditions are on ``node``."""
    n = nodes_of(edges)
    ins, outs = edges.select(F.col("dst").alias("node")).distinct(), edges.select(F.col("src").alias("node")).distinct()
    rules = {"source with fan-in": n.where(expected_sources).join(ins, "node", "left_semi"), "sink with fan-out": n.where(expected_sinks).join(outs, "node", "left_semi"), "loop": edges.where("src = dst").select(F.col("src").alias("node"))}
    out = None
    for rule, broken in rules.items():
        row = broken.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("broken"))
        out = row if out is None else out.union(row)
    return out


def clock_edges(nodes: DataFrame) -> DataFrame:
    """(src, dst) from each block's clock pin to its register source and sink: nodes (node, type, block)."""
    clock = nodes.where("type = 'FF_CLOCK'").select("block", F.col("node").alias("src"))
    return nodes.where("type in ('FF_SOURCE', 'FF_SINK')").select("block", F.col("node").alias("dst")).join(clock, "block").select("src", "dst")


def remapped(constraints: DataFrame, layout: DataFrame) -> DataFrame:
    """Constraints (node, ...) with the new ids of ``relayout``; those on nodes without one go."""
    ids = layout.select(F.col("node").alias("_old"), "new_id")
    met = constraints.join(ids, F.col("node") == F.col("_old"))
    return met.select(F.col("new_id").alias("node"), *[c for c in constraints.columns if c != "node"])


def selected(edges: DataFrame, which: str) -> DataFrame:
    """(node) by a selection: ``all``, ``none``, ``pi`` (no fan-in), ``po`` (no fan-out), or names with commas between."""
    if which in ("pi", "po"):
        a, b = ("src", "dst") if which == "pi" else ("dst", "src")
        return edges.select(F.col(a).alias("node")).distinct().join(edges.select(F.col(b).alias("node")), "node", "left_anti")
    found = nodes_of(edges)
    if which == "all":
        return found
    return found.where(F.col("node").isin([] if which == "none" else [n.strip() for n in which.split(",")]))
