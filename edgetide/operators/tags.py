"""Tags of a circuit: what each net can do (a transition at a time), met at gates, merged, binned and capped.

A gate's tags come from all combinations of its pins' tags, level by level, as joins on the gate; combinations that no
input vector produces give tags too. Their probability comes from the vectors (``extended.simulate``), so a tag that no
vector reaches stays, with probability 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.functions import truth
from edgetide.operators import extended
from edgetide.operators.extended import Circuit, cap_widths, merge_tags, moved
from edgetide.staging import Levels

TAG = "net string, trans string, arr long"
PIN = "struct<arr: bigint, pin: int, trans: string, delay: bigint>"


def sources(spark: SparkSession, circuit: Circuit, clocks: tuple[str, ...] = ()) -> DataFrame:
    """(net, trans, arr) of the primary inputs: R, F, H and L at 0; a clock has one tag, C."""
    rows = [(i, t, 0) for i in circuit.inputs for t in ("C" if i in clocks else "RFHL")]
    rows += [(g.out, "H" if g.cover else "L", 0) for g in circuit.gates if not g.inputs]
    return spark.createDataFrame(rows, TAG)


def launched(clock_tags: DataFrame, registers: DataFrame) -> DataFrame:
    """(net, trans, arr): a register (clock, net, delay) turns each tag of its clock into the four data tags."""
    at = registers.select(F.col("clock").alias("c"), F.col("net").alias("to"), "delay")
    met = clock_tags.where("trans = 'C'").join(at, F.col("net") == F.col("c"))
    return met.select(F.col("to").alias("net"), (F.col("arr") + F.col("delay")).alias("arr"), F.explode(F.array(*[F.lit(t) for t in "RFHL"])).alias("trans")).select("net", "trans", "arr").distinct()


def combinations(tags: DataFrame, pins: DataFrame, gates: DataFrame, net_delay: int) -> DataFrame:
    """gates (out, k, table) with ``pins``, an array of one tag a pin, for every combination of the pins' tags.

    tags (net, trans, arr), pins (out, pin, net, delay). One equi-join on the gate a pin, so a gate's product is made where
    its rows are.
    """
    rows = gates.withColumn("pins", F.expr(f"cast(array() as array<{PIN}>)"))
    depth = gates.agg(F.max("k")).first()[0] or 0
    at = pins.join(tags, "net").select(F.col("out").alias("to"), "pin", F.struct(moved(F.col("trans"), F.col("arr"), net_delay).cast("long").alias("arr"), "pin", "trans", F.col("delay").cast("long").alias("delay")).alias("tag"))
    for p in range(depth):
        more = rows.where(F.col("k") > p).join(at.where(F.col("pin") == p), F.col("out") == F.col("to"))
        more = more.select("out", "k", "table", F.concat("pins", F.array("tag")).alias("pins"))
        rows = rows.where(F.col("k") <= p).unionByName(more)
    return rows


def evaluated(rows: DataFrame) -> DataFrame:
    """(net, trans, arr) of each combination of pins."""
    every = F.when(F.col("k") >= 6, F.lit(-1).cast("long")).otherwise(F.expr("shiftleft(1L, shiftleft(1, k)) - 1"))
    return rows.select(F.col("out").alias("net"), extended.folded(F.array_sort("pins"), F.col("table"), every).alias("r")).select("net", "r.trans", "r.arr")


def propagate(spark: SparkSession, circuit: Circuit, coarse: int = 0, fine: int = 0, threshold: Column | None = None, limit: int = 0, given: DataFrame | None = None) -> DataFrame:
    """(net, trans, arr): the tags of all nets. Tags in a bin are merged into its latest; ``limit`` caps a gate's combinations
    by binning the pins with most tags ever more coarsely (it needs a positive coarse bin)."""
    if limit and coarse <= 0:
        raise ValueError("a limit on permutations needs a positive bin")
    out = Levels(spark)
    out.add(given if given is not None else sources(spark, circuit), 0)
    at = {i: 0 for i in circuit.inputs} | {g.out: 0 for g in circuit.gates if not g.inputs}
    for g in circuit.ordered():
        at[g.out] = 1 + max((at[i] for i in g.inputs), default=-1)
    for level in range(1, max(at.values(), default=0) + 1):
        now = [g for g in circuit.gates if at[g.out] == level]
        gates = spark.createDataFrame([(g.out, len(g.inputs), truth.cover_table(list(g.cover))) for g in now], "out string, k int, table long")
        pins = spark.createDataFrame([(g.out, p, i, g.pin_delay[p]) for g in now for p, i in enumerate(g.inputs)], "out string, pin int, net string, delay int")
        known = out.table().drop("level")
        if limit:
            known = _capped(known, pins, coarse, limit)
        met = evaluated(combinations(known, pins, gates, circuit.net_delay) if not limit else combinations_of(known, pins, gates, circuit.net_delay))
        out.add(merge_tags(met, ["net"], coarse, fine, threshold).select("net", "trans", "arr"), level)
    return out.table().drop("level")


def combinations_of(tags: DataFrame, pins: DataFrame, gates: DataFrame, net_delay: int) -> DataFrame:
    """``combinations`` where a pin has tags of its own: tags (out, pin, net, trans, arr)."""
    own = tags.select(F.concat_ws("\t", "out", F.col("pin").cast("string")).alias("net"), "trans", "arr")
    return combinations(own, pins.withColumn("net", F.concat_ws("\t", "out", F.col("pin").cast("string"))), gates, net_delay)


def _capped(tags: DataFrame, pins: DataFrame, coarse: int, limit: int) -> DataFrame:
    """Each gate's own tags (out, pin, net, trans, arr), binned where its combinations pass the limit."""
    own = pins.join(tags, "net").select("out", "pin", "net", "trans", "arr")
    sizes = own.groupBy("out", "pin").agg(F.count(F.lit(1)).alias("n")).groupBy("out").agg(F.sum(F.log2("n")).alias("bits"))
    crowded = sizes.where(F.col("bits") > F.log2(F.lit(float(limit))) - 1e-9).select("out")
    counts = own.join(crowded, "out", "left_semi").groupBy("out", "pin", "trans", "arr").count().collect()
    widths = []
    for gate in sorted({r["out"] for r in counts}):
        held = [r for r in counts if r["out"] == gate]
        by_pin = sorted({r["pin"] for r in held})
        found = cap_widths([{(r["trans"], r["arr"]): r["count"] for r in held if r["pin"] == p} for p in by_pin], limit, coarse)
        widths += [(gate, p, float(w)) for p, w in zip(by_pin, found)]
    if not widths:
        return own
    w = tags.sparkSession.createDataFrame(widths, "out string, pin int, width double")
    bin = F.when(F.coalesce("width", F.lit(0.0)) > 0, F.floor(F.col("arr") / F.col("width"))).otherwise(F.col("arr"))
    return own.join(F.broadcast(w), ["out", "pin"], "left").groupBy("out", "pin", "net", "trans", bin.alias("bin")).agg(F.max("arr").alias("arr")).drop("bin")


def weighted(spark: SparkSession, circuit: Circuit, output: str, tags: DataFrame | None = None) -> DataFrame:
    """(trans, arr, n, probability) of a primary output's tags: n of the 4**inputs vectors give the tag, 0 if none does."""
    found = (propagate(spark, circuit) if tags is None else tags).where(F.col("net") == output)
    found = found.select("trans", moved(F.col("trans"), F.col("arr"), circuit.net_delay).cast("long").alias("arr")).distinct()
    seen = extended.simulate(spark, circuit).select(F.col(f"`out:{output}`").alias("o")).groupBy("o.trans", "o.arr").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return found.join(seen, ["trans", "arr"], "left").select("trans", "arr", n.alias("n"), (n / F.lit(4.0 ** len(circuit.inputs))).alias("probability"))


def total_probability(tags: DataFrame, key: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(key, total, whole): does the probability of each group's tags add up to one?"""
    return tags.groupBy(*key).agg(F.sum("probability").alias("total")).withColumn("whole", F.abs(F.col("total") - 1) < tolerance)


def tag_count_histogram(tags: DataFrame, key: list[str]) -> DataFrame:
    """(tags, n, fraction): how many nodes have so many tags."""
    counts = tags.groupBy(*key).agg(F.count(F.lit(1)).alias("tags")).groupBy("tags").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("tags", "n", (F.col("n") / F.col("all")).alias("fraction"))


def captured(data: DataFrame, clocks: DataFrame, constraints: DataFrame) -> DataFrame:
    """(node, src, sink, required): at a register, data tags (node, domain) meet clock tags (node, domain, arr) where a
    constraint (src, sink, value) is on the pair; one that is below zero is none."""
    d, c = data.select("node", F.col("domain").alias("src")).distinct(), clocks.select("node", F.col("domain").alias("sink"), "arr")
    met = d.join(c, "node").join(constraints.where("value >= 0"), ["src", "sink"])
    return met.groupBy("node", "src", "sink").agg(F.min(F.col("arr") + F.col("value")).alias("required"))


def active_arcs(spark: SparkSession, table: int, k: int) -> DataFrame:
    """(pin, trans_in, trans_out): transitions that a gate's output can have while a pin has one, over all input vectors."""
    rows = extended.assignments(spark, tuple(f"p{i}" for i in range(k)))
    bit = lambda when: reduce(lambda x, i: x + F.when(F.col(f"p{i}").isin(*when), 1 << i).otherwise(0), range(k), F.lit(0))
    tt = F.lit(table).cast("long")
    out = truth.transition(truth.value_at(tt, bit("FH")), truth.value_at(tt, bit("RH")))
    pins = F.array(*[F.struct(F.lit(i).alias("pin"), F.col(f"p{i}").alias("trans_in")) for i in range(k)])
    return rows.select(F.explode(pins).alias("p"), out.alias("trans_out")).select("p.pin", "p.trans_in", "trans_out").distinct()


def filtered_inputs(table: int, k: int) -> Column:
    """Of a gate's pins (array of struct(arr, pin, trans, delay) in column ``pins``) those that its output does not depend on,
    given what came before."""
    every = (1 << (1 << k)) - 1
    every = every - (1 << 64) if every >> 63 else every

    def step(s: Column, x: Column) -> Column:
        after = truth.cofactor_at(s["f"], x["pin"], F.when(x["trans"].isin("R", "H"), 1).otherwise(0)).bitwiseAND(F.lit(every).cast("long"))
        return F.struct(after.alias("f"), F.when(after == s["f"], F.concat(s["skipped"], F.array(x["pin"]))).otherwise(s["skipped"]).alias("skipped"))

    zero = F.struct(F.lit(table).cast("long").alias("f"), F.expr("cast(array() as array<int>)").alias("skipped"))
    return F.aggregate(F.array_sort("pins"), zero, step, lambda s: s["skipped"])

