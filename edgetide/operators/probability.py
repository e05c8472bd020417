"""Weights of input transitions, and how minterms are dealt to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgetide.functions.truth import gray


def uniform_weights(inputs: DataFrame) -> DataFrame:
    """(pi, trans, weight): a quarter for R, F, H and L of every primary input."""
    return inputs.select("pi", F.explode(F.array(*[F.lit(t) for t in "RFHL"])).alias("trans")).withColumn("weight", F.lit(0.25))


def random_counts(inputs: DataFrame, variables: int, seed: int) -> DataFrame:
    """(pi, trans, minterms): 2**variables minterms of each input split by a hash of seed and input; L takes the rest."""
    total = 1 << variables
    draw = lambda t, free: F.greatest(F.lit(1), F.pmod(F.xxhash64(F.lit(seed), "pi", F.lit(t)), F.greatest(free - 3, F.lit(1))) + 1).cast("long")
    r = inputs.withColumn("R", draw("R", F.lit(total))).withColumn("F", draw("F", F.lit(total) - F.col("R"))).withColumn("H", draw("H", F.lit(total) - F.col("R") - F.col("F")))
    r = r.withColumn("L", F.lit(total) - F.col("R") - F.col("F") - F.col("H"))
    return r.select("pi", F.expr("stack(4, 'R', R, 'F', F, 'H', H, 'L', L) as (trans, minterms)"))


def rank_of(trans: str = "trans") -> Column:
    return F.when(F.col(trans) == "R", 0).when(F.col(trans) == "F", 1).when(F.col(trans) == "H", 2).otherwise(3)


def round_robin(counts: DataFrame) -> DataFrame:
    """(pi, minterm, trans): minterm i goes to the next transition that has some left, in the order R, F, H, L."""
    each = counts.where("minterms > 0").select("pi", "trans", F.explode(F.expr("sequence(1L, cast(minterms as bigint))")).alias("round"))
    place = F.row_number().over(Window.partitionBy("pi").orderBy("round", rank_of()))
    return each.select("pi", (place - 1).cast("long").alias("minterm"), "trans")


def grouped(counts: DataFrame, gray_code: bool = False) -> DataFrame:
    """(pi, minterm, trans): blocks of powers of two, the largest transition first, ties by R, F, H, L."""
    bits = counts.select("pi", "trans", "minterms", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("bit")).where(F.expr("(shiftright(cast(minterms as bigint), bit) & 1) = 1"))
    block = F.row_number().over(Window.partitionBy("pi", "trans").orderBy(F.desc("bit")))
    sized = bits.select("pi", "trans", "minterms", block.alias("turn"), F.expr("shiftleft(1L, bit)").alias("size"))
    upto = Window.partitionBy("pi").orderBy("turn", F.desc("minterms"), rank_of()).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("first", F.coalesce(F.sum("size").over(upto), F.lit(0)))
    m = placed.select("pi", "trans", F.explode(F.expr("sequence(first, first + size - 1)")).alias("i"))
    return m.select("pi", (gray(F.col("i")) if gray_code else F.col("i")).alias("minterm"), "trans")


def pair_table(joint: DataFrame) -> DataFrame:
    """(a, b, trans_a, trans_b, n) of every pair of inputs from (minterm, pi, trans)."""
    x, y = joint.toDF("minterm", "a", "trans_a"), joint.toDF("minterm", "b", "trans_b")
    return x.join(y, "minterm").where("a < b").groupBy("a", "b", "trans_a", "trans_b").agg(F.count(F.lit(1)).alias("n"))


def max_by_exclusion(rows: DataFrame) -> DataFrame:
    """(delay, n) from (vec, delay) of all outputs: a delay's vectors are those that have it, less those that are covered by
    a larger one."""
    seen = rows.distinct()
    larger = seen.select(F.col("vec").alias("v"), F.col("delay").alias("d"))
    free = seen.join(larger, (F.col("vec") == F.col("v")) & (F.col("d") > F.col("delay")), "left_anti")
    return free.groupBy("delay").agg(F.count(F.lit(1)).alias("n"))



def cube_of(minterm: Column, variables: int) -> Column:
    """The values of a minterm's variables as text, the first variable first."""
    return F.concat(*[F.shiftright(minterm, i).bitwiseAND(F.lit(1)).cast("string") for i in range(variables)])


def cubes_to_rows(spark: SparkSession, cubes: list[str]) -> DataFrame:
    """(assignment) that any of the cubes (0, 1, - by variable) holds, each once."""
    n = len(cubes[0])
    held = lambda c: [(sum(1 << i for i, b in enumerate(c) if b != "-"), sum(1 << i for i, b in enumerate(c) if b == "1"))]
    match = [F.col("id").bitwiseAND(F.lit(mask)) == value for c in cubes for mask, value in held(c)]
    any_of = match[0]
    for m in match[1:]:
        any_of = any_of | m
    return spark.range(1 << n).where(any_of).select(F.col("id").alias("assignment"))


def complement(spark: SparkSession, rows: DataFrame, variables: int) -> DataFrame:
    return spark.range(1 << variables).select(F.col("id").alias("assignment")).join(rows, "assignment", "left_anti")


def fraction(rows: DataFrame, variables: int, key: list[str] | None = None) -> DataFrame:
    """(key, n, fraction) of satisfying assignments (key, assignment), each counted once."""
    n = rows.select(*(key or []), "assignment").distinct().groupBy(*(key or [])).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("fraction", F.col("n") / F.lit(2.0**variables))


def disjoint_or(parts: DataFrame, key: list[str]) -> DataFrame:
    """(key, fraction) of the OR of functions without a common variable: what none of them leaves out."""
    return parts.groupBy(*key).agg((1 - F.product(1 - F.col("fraction"))).alias("fraction"))


def disjoint_and(parts: DataFrame, key: list[str]) -> DataFrame:
    """(key, fraction) of the AND of functions without a common variable."""
    return parts.groupBy(*key).agg(F.product("fraction").alias("fraction"))


def overlapping(supports: DataFrame) -> DataFrame:
    """(f, variable): variables that more than one part of a function f has, so that its parts are not disjoint."""
    return supports.select("f", "part", "variable").distinct().groupBy("f", "variable").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("f", "variable")
