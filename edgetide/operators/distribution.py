"""Delay distributions: histograms, cumulative forms, distances, intervals and comparisons. Long tables: a row a delay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgetide.functions.stats import clopper_pearson, t_quantile


def histogram(rows: DataFrame, key: list[str], delay: str) -> DataFrame:
    """(key, delay, n, probability) of each group; probability is n over the group's rows."""
    n = rows.groupBy(*key, F.col(delay).alias("delay")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy(*key)))


def with_zero(hist: DataFrame, key: list[str]) -> DataFrame:
    """The histogram with a row of probability 0 at delay 0 where a group has none."""
    lacks = hist.groupBy(*key).agg(F.max((F.col("delay") == 0).cast("int")).alias("has")).where("has = 0").drop("has")
    return hist.select(*key, "delay", "probability").unionByName(lacks.select(*key, F.lit(0).cast(hist.schema["delay"].dataType).alias("delay"), F.lit(0.0).alias("probability")))


def cdf(hist: DataFrame, key: list[str], weight: str = "probability") -> DataFrame:
    upto = Window.partitionBy(*key).orderBy("delay").rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("cumulative", F.sum(weight).over(upto))


def pivoted(hist: DataFrame, key: str, names: list[str], value: str = "probability") -> DataFrame:
    """A row a delay and a column ``prob:<name>`` a group, 0 where a group lacks the delay."""
    wide = hist.groupBy("delay").pivot(key, names).agg(F.sum(value)).na.fill(0)
    return wide.select("delay", *[F.col(f"`{n}`").alias(f"prob:{n}") for n in names])


def earth_mover(a: DataFrame, b: DataFrame, key: list[str] | None = None, weight: str = "probability") -> DataFrame:
    """(key, emd) of two histograms of equal mass: the area between their cumulative forms."""
    key = key or []
    both = a.select(*key, "delay", F.col(weight).alias("d")).unionByName(b.select(*key, "delay", (-F.col(weight)).alias("d"))).groupBy(*key, "delay").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*key).orderBy("delay")
    area = both.withColumn("gap", F.abs(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))) * (F.lead("delay").over(w) - F.col("delay")))
    return area.groupBy(*key).agg(F.coalesce(F.sum("gap"), F.lit(0.0)).alias("emd"))


def normalised(distance: Column, base: Column) -> Column:
    """distance over base; 0 over 0 is 0."""
    return F.when((distance == 0) & (base == 0), F.lit(0.0)).otherwise(distance / base)


def false_path(hist: DataFrame, key: list[str]) -> DataFrame:
    """(key, structural, true_max): the largest delay, and the largest that has a probability above 0."""
    return hist.groupBy(*key).agg(F.max("delay").alias("structural"), F.max(F.when(F.col("probability") > 0, F.col("delay"))).alias("true_max"))


def mean_delay(hist: DataFrame, key: list[str]) -> DataFrame:
    return hist.groupBy(*key).agg(F.sum(F.col("delay") * F.col("probability")).alias("mean"))


def plot_bins(hist: DataFrame, low: float, high: float, n: int) -> DataFrame:
    """(bin, probability) over n equal bins; the last bin holds its upper edge too."""
    at = F.least(F.floor((F.col("delay") - low) / ((high - low) / n)), F.lit(n - 1)).cast("int")
    return hist.where(F.col("delay").between(low, high)).groupBy(at.alias("bin")).agg(F.sum("probability").alias("probability"))


def mean_interval(rows: DataFrame, key: list[str], column: str, confidence: float = 0.99) -> DataFrame:
    """(key, n, mean, low, high) with Student's t. The few distinct sample sizes get their quantile on the driver."""
    s = rows.groupBy(*key).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"))
    sizes = [r[0] for r in s.select("n").distinct().limit(10_001).collect()]
    if len(sizes) > 10_000:
        raise ValueError("over 10000 different group sizes: aggregate first")
    q = F.create_map(*[F.lit(x) for n in sizes for x in (n, t_quantile(1 - (1 - confidence) / 2, n - 1) if n > 1 else 0.0)])
    half = F.element_at(q, F.col("n")) * F.col("sd") / F.sqrt("n")
    return s.select(*key, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def largest_interval(rows: DataFrame, column: str, confidence: float = 0.99) -> DataFrame:
    """(delay, successes, n, low, high): share of rows at the largest value, by Clopper and Pearson."""
    top = rows.agg(F.max(column).alias("delay"), F.count(column).alias("n")).first()
    k = rows.where(F.col(column) == top["delay"]).count()
    low, high = clopper_pearson(k, top["n"], confidence)
    return rows.sparkSession.createDataFrame([(top["delay"], k, top["n"], low, high)], "delay double, successes long, n long, low double, high double")


def prefix_means(rows: DataFrame, order: list[Column], column: str, sizes: list[int]) -> DataFrame:
    """(n, mean) of the first n rows in ``order`` for every n of ``sizes``, in one pass over those rows: a sampling
    report. Only the largest size is sorted."""
    top = rows.orderBy(*order).limit(max(sizes)).withColumn("_o", F.monotonically_increasing_id())
    place = F.row_number().over(Window.orderBy(*order))
    first = top.withColumn("place", place)
    out = first.select(F.explode(F.array(*[F.lit(s) for s in sizes])).alias("n"), "place", column).where("place <= n")
    return out.groupBy("n").agg(F.avg(column).alias("mean"))


def compare(ref: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """One row of counts for two tables (key, class, delay): rows on both sides, on one, other final class, and how many
    of ``other`` are optimistic (below ref by 1 or more), pessimistic, equal."""
    a, b = ref.toDF(*key, "class_a", "delay_a"), other.toDF(*key, "class_b", "delay_b")
    j = a.join(b, key, "full")
    both = F.col("delay_a").isNotNull() & F.col("delay_b").isNotNull()
    d = F.col("delay_b") - F.col("delay_a")
    return j.agg(
        F.count_if(both).alias("matched"), F.count_if(~both).alias("unmatched"), F.count_if(both & (F.col("class_a") != F.col("class_b"))).alias("other_class"),
        F.count_if(both & (d <= -1)).alias("optimistic"), F.count_if(both & (d > 0)).alias("pessimistic"), F.count_if(both & (d == 0)).alias("equal"),
    )


def step_histogram(cpd: DataFrame, key: list[str]) -> DataFrame:
    """(key, delay, probability) of a static result (key, cpd): all at cpd, and a row of 0 at delay 0 where that is another."""
    rows = F.when(F.col("cpd") == 0, F.array(F.struct(F.lit(0).cast("long").alias("delay"), F.lit(1.0).alias("probability"))))
    rows = rows.otherwise(F.array(F.struct(F.lit(0).cast("long").alias("delay"), F.lit(0.0).alias("probability")), F.struct(F.col("cpd").cast("long").alias("delay"), F.lit(1.0).alias("probability"))))
    return cpd.select(*key, F.explode(rows).alias("h")).select(*key, "h.*")


def row_max(tables: list[DataFrame], key: list[str]) -> DataFrame:
    """(key, delay): the largest delay of several tables (key, delay) for each key, whichever has it."""
    return reduce(DataFrame.unionByName, tables).groupBy(*key).agg(F.max("delay").alias("delay"))


def mean_normalised(distances: DataFrame) -> DataFrame:
    """The average over keys of distances (key, distance, base), each over its base."""
    return distances.agg(F.avg(normalised(F.col("distance"), F.col("base"))).alias("mean"))
