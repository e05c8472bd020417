"""Networks, waveforms, distributions and circuits that the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.operators.extended import Circuit, gate

#: A timing network from the foreign keys of the order tables; runs unchanged in Spark SQL and DuckDB.
EDGES = """
SELECT concat('R',n_regionkey) src, concat('N',n_nationkey) dst, CAST(n_nationkey % 7 + 1 AS BIGINT) delay FROM nation
UNION ALL SELECT concat('N',c_nationkey), concat('C',c_custkey), CAST(floor(abs(c_acctbal)) AS BIGINT) % 97 FROM customer
UNION ALL SELECT concat('N',s_nationkey), concat('S',s_suppkey), CAST(floor(abs(s_acctbal)) AS BIGINT) % 89 FROM supplier
UNION ALL SELECT concat('C',o_custkey), concat('O',o_orderkey), CAST(floor(o_totalprice) AS BIGINT) % 101 FROM orders
UNION ALL SELECT concat('O',l_orderkey), concat('L',l_orderkey,'_',l_linenumber), CAST(l_quantity AS BIGINT) FROM lineitem
UNION ALL SELECT concat('S',l_suppkey), concat('L',l_orderkey,'_',l_linenumber), CAST(round(l_discount*100) AS BIGINT) FROM lineitem
UNION ALL SELECT concat('P',l_partkey), concat('L',l_orderkey,'_',l_linenumber), CAST(l_linenumber*3 AS BIGINT) FROM lineitem
"""
SIGNALS = ("purchase", "error")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = EDGES
    frames = {t: table(spark, sf_dir, t) for t in ("nation", "customer", "supplier", "orders", "lineitem")}
    for t in frames:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **frames)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run a user, a signal an event type; every event toggles its signal, which is unknown before its first."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return e.selectExpr("user_id as run_id", "event_type as signal", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01', ts) as t", "event_id", "cast(row_number() over (partition by user_id, event_type order by ts, event_id) % 2 as int) as val")


def histogram_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, delay, n): l_quantity by l_returnflag."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("key"), F.col("l_quantity").cast("long").alias("delay")).agg(F.count(F.lit(1)).alias("n"))


AND2 = Circuit(("a", "b"), ("c",), (gate("c", "a b", "11 1"),))
AND3 = Circuit(("a", "b", "c"), ("d",), (gate("x", "a b", "11 1"), gate("d", "x c", "11 1")))
MAJORITY = Circuit(("a", "b", "c", "d", "e"), ("o",), (gate("o", "a b c d e", "---1- 1", "111-- 1", "11--1 1", "1-1-1 1", "-11-1 1"),))
MUX = Circuit(("a", "b", "c", "sel"), ("out",), (gate("bi", "b", "0 1"), gate("d", "c bi sel", "011 1", "100 1", "110 1", "111 1"), gate("out", "d a sel", "011 1", "100 1", "110 1", "111 1")))
