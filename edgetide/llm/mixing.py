"""Mixing sources to target weights: Pareto order sampling of documents.

Each source has a target amount of words. A document's expected number of copies is its source's target over its
source's size; with weights it is a rate of the source times the document's weight, ``cap`` at most, and the rate is such
that the expected words of the source are its target. Whole copies are certain and are allocated first. What is left of the
expectation is an inclusion probability p; documents are ranked by Pareto's q = (u / (1 - u)) / (p / (1 - p)), u a
uniform number from a hash of the document, and are taken in that order until the source's amount is met.

The cut in that order is found without sorting a source in one place: ranks are counted in fine bins, the bin where
the cut falls is taken from cumulative sums over bins, and only the rows of that one bin are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgetide.llm.runtime import lookup, prepare, stage

BINS = 1 << 14


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(seed: int) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of seed and doc_id, or of the text where that is null."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target): weights 1, 2, 3 in turn by source, null last.

    All words are shared by weight; no source gets more than ``cap`` times its size, and what it can't take is
    shared by weight among the others. That level L, with target = min(cap * size, L * weight), comes from
    cumulative sums over the sources in order of cap * size / weight. One row a source, so one partition holds it.
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = sizes.withColumn("weight", (F.pmod(F.row_number().over(ordered) - 1, F.lit(3)) + 1).cast("double"))
    w = w.withColumn("room", F.lit(cap) * F.col("source_size")).withColumn("fills", F.col("room") / F.col("weight"))
    all_rows = Window.partitionBy()
    up = Window.orderBy("fills", F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("total", F.sum("source_size").over(all_rows)).withColumn("weights", F.sum("weight").over(all_rows))
    w = w.withColumn("before", F.coalesce(F.sum("room").over(up), F.lit(0.0))).withColumn("left", F.col("weights") - F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
    level = (F.col("total") - F.col("before")) / F.col("left")
    # the level holds from the first source on that does not fill up
    w = w.withColumn("open", F.when(F.col("fills") >= level, level))
    w = w.withColumn("level", F.max("open").over(all_rows))
    target = F.when(F.col("level").isNull(), F.col("room")).otherwise(F.least("room", F.col("level") * F.col("weight")))
    return w.select("source", "source_size", target.alias("target"))


def rates(sized: DataFrame, plan: DataFrame, cap: float, rounds: int = 100) -> DataFrame:
    """plan (p_source, source_size, target) with ``rate``: expected copies are least(cap, rate * w) and add up to the target.

    Documents that the rate fills up to ``cap`` leave the rest of the target to the others, so the rate grows until no
    more fill up; each round is one aggregation by source. A source that can't reach its target is filled up whole.
    """
    same = F.col("source").eqNullSafe(F.col("p_source"))
    plan = plan.withColumn("rate", F.lit(0.0)).withColumn("full", F.lit(-1).cast("long"))
    for _ in range(rounds):
        d = sized.join(lookup(plan), same)
        full = (F.col("rate") * F.col("w") >= cap) & (F.col("w") > 0)
        sums = d.where("size > 0").groupBy("p_source").agg(F.sum(F.when(full, F.col("size")).otherwise(0)).alias("filled"), F.sum(F.when(~full, F.col("size") * F.col("w")).otherwise(0.0)).alias("open"), F.count_if(full).alias("n_full"))
        sums = sums.select(F.col("p_source").alias("q_source"), "filled", "open", "n_full")
        rate = F.when(F.col("open") > 0, F.greatest(F.lit(0.0), F.col("target") - cap * F.col("filled")) / F.col("open")).otherwise(F.col("rate"))
        new = plan.join(sums, F.col("p_source").eqNullSafe(F.col("q_source")), "left")
        new = new.select("p_source", "source_size", "target", F.greatest("rate", F.coalesce(rate, F.lit(0.0))).alias("rate"), F.coalesce("n_full", F.lit(0)).alias("now"), "full")
        plan = stage(new.select("p_source", "source_size", "target", "rate", F.col("now").alias("full"), (F.col("now") == F.col("full")).alias("settled")), "mix-rates")
        if plan.where("not settled").isEmpty():
            break
    return plan.select("p_source", "source_size", "target", "rate")


def pareto_mix(docs: DataFrame, targets: DataFrame | None = None, weight: str | None = None, cap: int = 3, seed: int = 1) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken.

    docs (doc_id, text, source; more columns are ignored). size is the number of words (null text: 0). ``targets``
    (source, target) gives words wanted of each source; without it, source_targets does. ``weight`` names a column of
    docs in proportion to which documents of a source are expected (null, not finite or below zero: 0). No document is
    taken more than ``cap`` times. The amount
    taken of a source misses its target by half a document at the cut at most, unless its documents at ``cap``
    copies hold less. Documents without words are never taken. Null sources are one source. Rows with the same doc_id
    have the same u, and rows without one have that of their text; ties in rank are ordered by doc_id and size, so equal
    rows may differ in copies but the set of rows is the same in every run. Empty tables give empty tables.
    """
    prepare(docs.sparkSession)
    given = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    w = F.when((given > 0) & (given < float("inf")), given).otherwise(0.0)
    sized = stage(docs.select("doc_id", "source", word_count("text").alias("size"), w.alias("w"), uniform(seed).alias("u")), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    if targets is None:
        plan = source_targets(sizes, cap)
    else:
        t = targets.select(F.col("source").alias("s"), F.col("target").cast("double").alias("target"))
        plan = sizes.join(t, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"))
    plan = stage(plan.select(F.col("source").alias("p_source"), "source_size", "target"), "mix-targets")
    if weight:
        rated = rates(sized, plan, float(cap))
    else:
        rated = plan.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    same = F.col("source").eqNullSafe(F.col("p_source"))
    d = sized.join(lookup(rated), same).drop("p_source")
    expected = F.least(F.lit(float(cap)), F.col("rate") * F.col("w"))
    d = d.withColumn("sure", F.floor(expected)).withColumn("p", expected - F.floor(expected))
    odds = F.col("u") / (1 - F.col("u"))
    d = d.withColumn("q", F.when(F.col("p") > 0, odds / (F.col("p") / (1 - F.col("p")))).otherwise(odds * 1e18))
    open_ = (F.col("sure") < cap) & (F.col("size") > 0)
    # q / (1 + q) grows with q and lies in (0, 1): bins of equal width
    d = d.withColumn("bin", F.when(open_, F.least(F.floor(F.col("q") / (1 + F.col("q")) * BINS), F.lit(BINS - 1)).cast("int")))
    bins = d.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("sure")).alias("certain"))
    of = Window.partitionBy("source")
    upto = of.orderBy(F.col("bin").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.join(lookup(plan), same).withColumn("wanted", F.col("target") - F.sum("certain").over(of))
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).where(F.col("bin").isNotNull())
    cut = bins.where((F.col("before") < F.col("wanted")) & (F.col("before") + F.col("words") >= F.col("wanted")))
    cut = stage(cut.select(F.col("source").alias("c_source"), F.col("bin").alias("cut_bin"), "before", "wanted"), "mix-cuts")
    short = stage(bins.groupBy("source", "wanted").agg(F.max(F.col("before") + F.col("words")).alias("have")).where("have < wanted").select(F.col("source").alias("s_source")), "mix-short")
    d = d.join(lookup(cut), F.col("source").eqNullSafe(F.col("c_source")), "left")
    d = d.join(lookup(short.withColumn("all_in", F.lit(True))), F.col("source").eqNullSafe(F.col("s_source")), "left").drop("c_source", "s_source")
    at_cut = F.col("bin").isNotNull() & F.col("cut_bin").isNotNull() & (F.col("bin") == F.col("cut_bin"))
    rank = Window.partitionBy("source").orderBy("q", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    columns = ["doc_id", "source", "size", "source_size", "target"]
    edge = d.where(at_cut).withColumn("through", F.col("before") + F.sum("size").over(rank))
    # the row that crosses the line comes in if that brings the source nearer to its target
    takes = (F.col("through") <= F.col("wanted")) | ((F.col("through") - F.col("size") < F.col("wanted")) & (F.col("through") - F.col("wanted") < F.col("wanted") - (F.col("through") - F.col("size"))))
    edge = edge.select(*columns, (F.col("sure") + takes.cast("long")).alias("copies"))
    early = F.col("bin").isNotNull() & (F.coalesce(F.col("bin") < F.col("cut_bin"), F.lit(False)) | F.coalesce("all_in", F.lit(False)))
    rest = d.where(~at_cut).select(*columns, (F.col("sure") + early.cast("long")).alias("copies"))
    return rest.unionByName(edge).withColumn("taken", F.col("copies") * F.col("size"))
