"""Extended timing: the distribution of arrival times over all input transitions of a circuit.

A row is an assignment of R, F, H or L to every primary input, cut from the bits of a number in a range of 4**n. Gates
become columns in topological order, so a circuit of any size is one projection without a shuffle, and only the
histogram aggregates. Tags (node, transition, arrival) with a weight are what the rows of a node add up to.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.functions import truth


@dataclass(frozen=True)
class Gate:
    out: str
    inputs: tuple[str, ...]
    cover: tuple[tuple[str, str], ...]
    pin_delay: tuple[int, ...]


@dataclass(frozen=True)
class Circuit:
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    gates: tuple[Gate, ...]
    net_delay: int = 5

    def ordered(self) -> list[Gate]:
        """Gates, each after those that drive it."""
        known, left, out = set(self.inputs), list(self.gates), []
        while left:
            ready = [g for g in left if set(g.inputs) <= known]
            if not ready:
                raise ValueError(f"no order for {[g.out for g in left]}")
            out += ready
            known |= {g.out for g in ready}
            left = [g for g in left if g.out not in known]
        return out

    def critical_path(self) -> int:
        at = dict.fromkeys(self.inputs, 0)
        for g in self.ordered():
            at[g.out] = max((at[i] + self.net_delay + d for i, d in zip(g.inputs, g.pin_delay)), default=0)
        return max(at[o] for o in self.outputs) + self.net_delay


def gate(out: str, inputs: str, *cover: str) -> Gate:
    """Cover rows as "bits value"; pin i (from 0) has delay 10 + 10 i."""
    pins = tuple(inputs.split())
    return Gate(out, pins, tuple(tuple(r.split()) for r in cover), tuple(10 + 10 * i for i in range(len(pins))))


def assignments(spark: SparkSession, inputs: tuple[str, ...], partitions: int | None = None) -> DataFrame:
    """``vec`` and a transition column for every input: all 4**n vectors."""
    n = len(inputs)
    letters = F.array(*[F.lit(x) for x in "RFHL"])
    base = spark.range(0, 4**n, 1, partitions) if partitions else spark.range(4**n)
    return base.select(F.col("id").alias("vec"), *[F.get(letters, F.shiftright("id", 2 * i).bitwiseAND(F.lit(3).cast("long")).cast("int")).alias(name) for i, name in enumerate(inputs)])


def moved(trans: Column, arrival: Column, delay: int) -> Column:
    """A net adds its delay only to a value that moves."""
    return arrival + F.when(trans.isin("R", "F"), delay).otherwise(0)


def evaluate(table: int, k: int, pins: list[tuple[Column, Column, int]]) -> Column:
    """struct(trans, arr) of a gate from its pins (transition, arrival, delay), as one fold.

    Inputs count by arrival, ties by pin. One whose final value does not change the function any more is filtered; the
    fold stops when the function is constant. The output moves if a used input moved, and then every used input
    adds its pin's delay.
    """
    every = (1 << (1 << k)) - 1
    every = every - (1 << 64) if every >> 63 else every
    rows = F.array_sort(F.array(*[F.struct(a.cast("long").alias("arr"), F.lit(i).alias("pin"), t.alias("trans"), F.lit(d).cast("long").alias("delay")) for i, (t, a, d) in enumerate(pins)]))
    return folded(rows, F.lit(table).cast("long"), F.lit(every).cast("long"))


def folded(rows: Column, table: Column, every: Column) -> Column:
    """The fold of ``evaluate`` over sorted pins (arr, pin, trans, delay), the table and its constant 1 being columns too."""
    zero = F.struct(table.alias("f"), F.lit(False).alias("dyn"), F.lit(0).cast("long").alias("still"), F.lit(0).cast("long").alias("late"))

    def step(s: Column, x: Column) -> Column:
        after = truth.cofactor_at(s["f"], x["pin"], F.when(x["trans"].isin("R", "H"), 1).otherwise(0)).bitwiseAND(every)
        skip = (s["f"] == 0) | (s["f"] == every) | (after == s["f"])
        used = F.struct(after.alias("f"), (s["dyn"] | x["trans"].isin("R", "F")).alias("dyn"), F.greatest(s["still"], x["arr"]).alias("still"), F.greatest(s["late"], x["arr"] + x["delay"]).alias("late"))
        return F.when(skip, s).otherwise(used)

    def finish(s: Column) -> Column:
        up = s["f"] != 0
        trans = F.when(s["dyn"], F.when(up, "R").otherwise("F")).otherwise(F.when(up, "H").otherwise("L"))
        return F.struct(trans.alias("trans"), F.when(s["dyn"], s["late"]).otherwise(s["still"]).alias("arr"))

    return F.aggregate(rows, zero, step, finish)


def simulate(spark: SparkSession, circuit: Circuit) -> DataFrame:
    """vec, the inputs, and struct(trans, arr) columns ``out:<name>`` at the primary outputs, for every vector."""
    rows = assignments(spark, circuit.inputs)
    for name in circuit.inputs:
        rows = rows.withColumn(f"net:{name}", F.struct(F.col(name).alias("trans"), F.lit(0).cast("long").alias("arr")))
    for g in circuit.ordered():
        pins = [(F.col(f"net:{i}")["trans"], moved(F.col(f"net:{i}")["trans"], F.col(f"net:{i}")["arr"], circuit.net_delay), d) for i, d in zip(g.inputs, g.pin_delay)]
        if pins:
            value = evaluate(truth.cover_table(list(g.cover)), len(g.inputs), pins)
        else:
            value = F.struct(F.lit("H" if g.cover else "L").alias("trans"), F.lit(0).cast("long").alias("arr"))
        rows = rows.withColumn(f"net:{g.out}", value)
    ends = [F.struct(F.col(f"net:{o}")["trans"].alias("trans"), moved(F.col(f"net:{o}")["trans"], F.col(f"net:{o}")["arr"], circuit.net_delay).alias("arr")).alias(f"out:{o}") for o in circuit.outputs]
    return rows.select("vec", *circuit.inputs, *ends)


def histogram(rows: DataFrame, output: str | None = None, weight: Column | None = None) -> DataFrame:
    """(delay, n): vectors by arrival at an output, or by the largest of all outputs if none is named."""
    outs = [c for c in rows.columns if c.startswith("out:")]
    arr = [F.col(f"`{c}`")["arr"] for c in outs if output is None or c == f"out:{output}"]
    delay = F.greatest(*arr) if len(arr) > 1 else arr[0]
    return rows.groupBy(delay.alias("delay")).agg(F.count(F.lit(1)).alias("n") if weight is None else F.sum(weight).alias("probability"))


def bins(arrival: Column, coarse: int, fine: int, threshold: Column | None = None) -> Column:
    """Bin of an arrival: coarse up to the threshold, fine above it; width 0 leaves times as they are."""
    one = lambda width: arrival if not width else F.floor(arrival / width)
    if threshold is None:
        return one(coarse).cast("long")
    return F.when(arrival > threshold, one(fine)).otherwise(one(coarse)).cast("long")


def merge_tags(tags: DataFrame, key: list[str], coarse: int = 0, fine: int = 0, threshold: Column | None = None) -> DataFrame:
    """Tags (key, trans, arr) merged by bin: the latest arrival stands for all, and ``n`` tags are counted.

    The side of the threshold is part of the bin, so the result does not depend on the order of tags.
    """
    high = F.lit(False) if threshold is None else F.col("arr") > threshold
    return tags.groupBy(*key, "trans", high.alias("fine_side"), bins(F.col("arr"), coarse, fine, threshold).alias("bin")).agg(F.max("arr").alias("arr"), F.count(F.lit(1)).alias("n")).drop("fine_side", "bin")


def cap_widths(tags: list[dict], limit: int, coarse: float, growth: float = 1.2) -> list[float]:
    """Bin widths of the inputs (0: none) so that the product of their tags is at most ``limit``: ever the input with most
    tags is binned more coarsely, until one bin holds its largest delay.

    tags: for each input a dict with a key (transition, arrival), or an arrival alone, a tag; limit 0 means none.
    """
    if limit and coarse <= 0:
        raise ValueError("a limit on permutations needs a positive bin")
    split = lambda key: key if isinstance(key, tuple) else ("", key)
    sizes, width, used = [len(t) for t in tags], [coarse] * len(tags), [0.0] * len(tags)
    while limit and math.prod(sizes) > limit:
        worst = max(range(len(sizes)), key=lambda i: sizes[i])
        if width[worst] > max(split(t)[1] for t in tags[worst]):
            break
        sizes[worst] = len({(split(t)[0], int(split(t)[1] // width[worst])) for t in tags[worst]})
        used[worst] = width[worst]
        width[worst] *= growth
    return used


def cap_bin(counts: list[dict], limit: int, coarse: float, growth: float = 1.2) -> list[int]:
    """Tag counts of the inputs after binning by ``cap_widths``."""
    split = lambda key: key if isinstance(key, tuple) else ("", key)
    return [len({(split(t)[0], int(split(t)[1] // w)) for t in c}) if w else len(c) for c, w in zip(counts, cap_widths(counts, limit, coarse, growth))]
