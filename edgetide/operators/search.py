"""Monte-Carlo convergence and run bookkeeping: how large a sample is enough, how much of all cases it is, what to run."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def smallest_sample(rows: DataFrame, order: list[Column], column: str, length: float, confidence: float = 0.99, least: int = 30, start: int = 1024) -> DataFrame:
    """(n, mean): the fewest rows in ``order`` whose mean has a confidence interval of at most ``length``; none if all rows
    are too few. A report on a sample: prefixes are doubled until one is long enough, and only that one is sorted.
    """
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    total, size = rows.count(), start
    while True:
        top = rows.orderBy(*order).limit(size).select(column, F.row_number().over(Window.orderBy(*order)).alias("n"))
        upto = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
        seen = top.select("n", F.avg(column).over(upto).alias("mean"), (F.stddev_samp(column).over(upto) / F.sqrt("n")).alias("error"))
        good = seen.where((F.col("n") >= least) & (2 * z * F.col("error") <= length)).orderBy("n").limit(1).select(F.col("n").cast("long").alias("n"), "mean")
        if size >= total or not good.isEmpty():
            return good
        size *= 2


def repeated_means(rows: DataFrame, column: str, n: int, times: int, seed: int, key: Column) -> DataFrame:
    """(draw, n, mean) of ``times`` samples of about n rows without replacement, each by its own hash of the row's key."""
    total = rows.count()
    share = min(1.0, n / max(1, total))
    draws = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    each = rows.select(F.col(column).alias("x"), key.alias("k"), draws.alias("draw"))
    taken = each.where(F.pmod(F.xxhash64(F.lit(seed), "draw", "k"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    return taken.groupBy("draw").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"))


def exhaustive_cases(inputs: Column) -> Column:
    """4 ** inputs as a decimal, for up to 62 inputs."""
    return F.aggregate(F.sequence(F.lit(1), inputs), F.lit(1).cast("decimal(38,0)"), lambda x, _: (x * F.lit(4)).cast("decimal(38,0)"))


def sample_fraction(cases: Column, inputs: Column) -> Column:
    """The share of all cases of so many inputs that a file of ``cases`` rows holds."""
    return cases / F.pow(F.lit(4.0), inputs)


def commands(runs: DataFrame) -> DataFrame:
    """runs (benchmark, note, ext, mc): a row for the mean and the max search of each, with the delay to search about and the
    command; a note * says that the analysis did not finish, and the sampled delay stands in."""
    delay = F.when(F.col("note") == "*", F.col("mc")).otherwise(F.col("ext"))
    kinds = F.explode(F.array(F.lit("mean"), F.lit("max"))).alias("kind")
    each = runs.select("benchmark", kinds, delay.alias("delay"))
    return each.withColumn("command", F.format_string("search --benchmark %s --kind %s --true-max %s", "benchmark", "kind", F.col("delay").cast("string")))


def speedup(times: DataFrame, base: str, other: str) -> DataFrame:
    """One row (base_seconds, other_seconds, speedup) from times (action, seconds) by their averages."""
    avg = lambda a: F.avg(F.when(F.col("action") == a, F.col("seconds")))
    return times.agg(avg(base).alias("base_seconds"), avg(other).alias("other_seconds"), (avg(base) / avg(other)).alias("speedup"))


def summary(facts: DataFrame, keys: list[str], emd: DataFrame | None = None) -> DataFrame:
    """A row a run from scraped facts (source, key, found), a column a key (a number, or null where it is none); with the
    distances (source, emd) of the runs, if given."""
    wide = facts.groupBy("source").pivot("key", keys).agg(F.first("found"))
    wide = wide.select("source", *[F.expr(f"try_cast(`{k}` as double)").alias(k) for k in keys])
    return wide if emd is None else wide.join(emd, "source", "left")
