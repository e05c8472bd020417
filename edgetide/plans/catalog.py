"""Queries by name, and the SQL that each must agree with. Every computed column has the same name in both."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.functions import truth
from edgetide.operators import distribution, extended, graph, netlist, probability, search, tags as tag_ops, timing, waveform
from edgetide.plans import inputs
from edgetide.plans.inputs import EDGES, SIGNALS, table
from edgetide.sources import blif, echo, files, sdf, vcd, writers
from edgetide.staging import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# --- timing -------------------------------------------------------------------------------------------------

PATHS = f"""WITH RECURSIVE e AS ({EDGES}),
p(node, root, level, t) AS (SELECT DISTINCT src, src, 0, 0::BIGINT FROM e WHERE src NOT IN (SELECT dst FROM e)
  UNION ALL SELECT e.dst, p.root, p.level + 1, p.t + e.delay FROM p JOIN e ON e.src = p.node)"""
BACK = f"""{PATHS}, a AS (SELECT node, max(t) AS late, min(t) AS early FROM p GROUP BY node),
ends AS (SELECT DISTINCT dst AS node FROM e WHERE dst NOT IN (SELECT src FROM e)),
b(node, r) AS (SELECT node, {{end}} FROM ends UNION ALL SELECT e.src, b.r - e.delay FROM b JOIN e ON e.dst = b.node)"""


def network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # every level reads the edges again, so they are written once
    e = written(inputs.edges(spark, sf_dir))
    return e, graph.levelize(e)


@query(f"{PATHS} SELECT node, max(t) AS arrival FROM p GROUP BY node")
def sta_arrival(spark, sf_dir):
    return timing.arrival(*network(spark, sf_dir))


@query(f"{PATHS} SELECT node, min(t) AS arrival FROM p GROUP BY node")
def hold_arrival(spark, sf_dir):
    return timing.arrival(*network(spark, sf_dir), hold=True)


def _required(spark, sf_dir, constraint=250, hold=False):
    e, levels = network(spark, sf_dir)
    a = timing.arrival(e, levels)
    return timing.required(e, levels, timing.end_constraints(e, a, constraint), hold), a


@query(BACK.format(end="250::BIGINT") + " SELECT node, min(r) AS required FROM b GROUP BY node")
def sta_required(spark, sf_dir):
    return _required(spark, sf_dir)[0]


@query(BACK.format(end="(SELECT late FROM a WHERE a.node = ends.node)") + " SELECT node, min(r) AS required FROM b GROUP BY node")
def sta_required_relaxed(spark, sf_dir):
    return _required(spark, sf_dir, -1)[0]


@query(BACK.format(end="0::BIGINT") + " SELECT node, max(r) AS required FROM b GROUP BY node")
def hold_required(spark, sf_dir):
    return _required(spark, sf_dir, 0, True)[0]


@query(BACK.format(end="250::BIGINT") + " SELECT a.node, a.late AS arrival, r.required, r.required - a.late AS slack FROM a JOIN (SELECT node, min(r) AS required FROM b GROUP BY node) r ON r.node = a.node")
def sta_slack(spark, sf_dir):
    r, a = _required(spark, sf_dir)
    return a.join(r, "node").select("node", "arrival", "required", (F.col("required") - F.col("arrival")).alias("slack"))


@query(f"{PATHS} SELECT max(t) AS cpd FROM p")
def sta_cpd(spark, sf_dir):
    return timing.critical_path_delay(timing.arrival(*network(spark, sf_dir)))


@query(f"{PATHS}, m AS (SELECT node, max(t) AS arrival FROM p GROUP BY node) SELECT m.node, m.arrival, min(p.root) AS launch FROM m JOIN p ON p.node = m.node AND p.t = m.arrival GROUP BY m.node, m.arrival")
def sta_launch_node(spark, sf_dir):
    return timing.launched_arrival(*network(spark, sf_dir))


@query(f"{PATHS} SELECT node, root AS domain, max(t) AS arrival FROM p WHERE root LIKE 'R%' GROUP BY node, root")
def multi_domain_arrival(spark, sf_dir):
    e, levels = network(spark, sf_dir)
    seeds = timing.starts(levels).select("node", F.col("node").alias("domain"), F.lit(0).cast("long").alias("arrival"))
    pairs = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("domain"))
    return timing.domain_arrival(e, levels, seeds, pairs)


@query(f"{PATHS} SELECT node, max(t) AS computed, max(t) + 1 AS expected FROM p WHERE node LIKE 'N%' GROUP BY node")
def sta_verify(spark, sf_dir):
    a = timing.arrival(*network(spark, sf_dir))
    return timing.check(a, a.withColumn("arrival", F.col("arrival") + F.col("node").startswith("N").cast("long")))


# --- graph --------------------------------------------------------------------------------------------------


@query(f"{PATHS} SELECT node, max(level) AS level FROM p GROUP BY node")
def levelize(spark, sf_dir):
    return network(spark, sf_dir)[1]


@query(f"{PATHS} SELECT level, count(*) AS nodes FROM (SELECT node, max(level) AS level FROM p GROUP BY node) GROUP BY level")
def level_width_hist(spark, sf_dir):
    return network(spark, sf_dir)[1].groupBy("level").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"WITH e AS ({EDGES}) SELECT degree, count(*) AS nodes FROM (SELECT count(*) AS degree FROM e GROUP BY dst) GROUP BY degree")
def fanin_hist(spark, sf_dir):
    return graph.degree_histogram(inputs.edges(spark, sf_dir), "dst")


@query(f"WITH e AS ({EDGES}) SELECT degree, count(*) AS nodes FROM (SELECT count(*) AS degree FROM e GROUP BY src) GROUP BY degree")
def fanout_hist(spark, sf_dir):
    return graph.degree_histogram(inputs.edges(spark, sf_dir), "src")


@query("""WITH s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier)
SELECT (i // ((n + 9) // 10))::INTEGER AS bucket, avg(s_suppkey) AS mean, count(*) AS n FROM s GROUP BY 1""")
def bucket_hist(spark, sf_dir):
    return graph.bucket_histogram(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", 10)


@query(f"""WITH e AS ({EDGES}) SELECT left(src, 1) || left(dst, 1) AS edge_type, count(*) AS edges, sum(delay)::BIGINT AS delay FROM e GROUP BY 1""")
def edge_types(spark, sf_dir):
    kind = F.concat(F.substring("src", 1, 1), F.substring("dst", 1, 1)).alias("edge_type")
    return inputs.edges(spark, sf_dir).groupBy(kind).agg(F.count(F.lit(1)).alias("edges"), F.sum("delay").alias("delay"))


@query(f"{PATHS}, l AS (SELECT node, max(level) AS level FROM p GROUP BY node) SELECT node, level, row_number() OVER (ORDER BY level, node) - 1 AS new_id FROM l")
def node_relayout(spark, sf_dir):
    return graph.relayout(network(spark, sf_dir)[1])


@query(f"WITH e AS ({EDGES}) SELECT 'source with fan-in' AS rule, 0::BIGINT AS broken UNION ALL SELECT 'sink with fan-out', 0 UNION ALL SELECT 'loop', count(*) FROM e WHERE src = dst")
def graph_verify(spark, sf_dir):
    return graph.verify(inputs.edges(spark, sf_dir), F.col("node").rlike("^[RP]"), F.col("node").startswith("L"))


@query(f"{PATHS} SELECT DISTINCT root, node FROM p WHERE root LIKE 'R%'")
def clock_fanout(spark, sf_dir):
    region = F.concat(F.lit("R"), "r_regionkey")
    start = table(spark, sf_dir, "region").select(region.alias("root"), region.alias("node"))
    return graph.reach(inputs.edges(spark, sf_dir), start)


@query(f"""WITH RECURSIVE e AS ({EDGES}), f(root, node) AS (SELECT dst, dst FROM e WHERE dst LIKE 'O%' UNION SELECT f.root, e.src FROM f JOIN e ON e.dst = f.node),
c AS (SELECT root, count(*) AS n_nodes, count(*) FILTER (WHERE node NOT IN (SELECT dst FROM e)) AS n_sources FROM f GROUP BY root)
SELECT n_nodes, n_sources, count(*) AS roots FROM c GROUP BY ALL""")
def transitive_fanin(spark, sf_dir):
    e = inputs.edges(spark, sf_dir)
    start = e.where("dst like 'O%'").select(F.col("dst").alias("root"), F.col("dst").alias("node"))
    back = graph.reach(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start)
    marked = back.join(timing.sources(e).withColumn("source", F.lit(1)), "node", "left")
    return marked.groupBy("root").agg(F.count(F.lit(1)).alias("n_nodes"), F.count("source").alias("n_sources")).groupBy("n_nodes", "n_sources").agg(F.count(F.lit(1)).alias("roots"))


@query(f"{PATHS} SELECT node, string_agg(DISTINCT root, ',' ORDER BY root) AS support FROM p GROUP BY node")
def support_sets(spark, sf_dir):
    e, levels = network(spark, sf_dir)
    seeds = timing.starts(levels).select("node", F.array("node").alias("support"))
    merge = [F.array_distinct(F.flatten(F.collect_list("support"))).alias("support")]
    s = graph.fold(e, levels, seeds, [], {"support": F.col("support")}, merge)
    return s.select("node", F.array_join(F.array_sort("support"), ",").alias("support"))


@query(f"{PATHS} SELECT node, count(*) AS paths FROM p GROUP BY node")
def path_counts(spark, sf_dir):
    e, levels = network(spark, sf_dir)
    return graph.plain_fold(e, levels, timing.starts(levels).withColumn("paths", F.lit(1).cast("long")), graph.Plain("paths", "sum", 0))


@query(f"""{PATHS}, l AS (SELECT node, max(level) AS level, count(DISTINCT root) AS tags FROM p GROUP BY node) SELECT level, sum(tags)::BIGINT AS total, min(tags) AS least, max(tags) AS most FROM l GROUP BY level""")
def level_tag_stats(spark, sf_dir):
    e, levels = network(spark, sf_dir)
    seeds = timing.starts(levels).select("node", F.col("node").alias("domain"), F.lit(0).cast("long").alias("arrival"))
    tags = timing.domain_arrival(e, levels, seeds).groupBy("node").agg(F.count(F.lit(1)).alias("tags"))
    return tags.join(levels, "node").groupBy("level").agg(F.sum("tags").alias("total"), F.min("tags").alias("least"), F.max("tags").alias("most"))


# --- logic and extended timing --------------------------------------------------------------------------------


def golden(rows: list[tuple[int, int]], b: str = "n") -> str:
    return "SELECT delay::BIGINT AS delay, " + b + "::BIGINT AS " + b + " FROM (VALUES " + ", ".join(f"({a}, {n})" for a, n in rows) + f") v(delay, {b})"


ADDER1 = ".model m\n.inputs a b c\n.outputs s co\n.names a b c s\n100 1\n010 1\n001 1\n111 1\n.names a b c co\n11- 1\n1-1 1\n-11 1\n110 1\n.end\n"


@query("SELECT i::INTEGER AS assignment, CASE WHEN i IN (1, 2, 4, 7) THEN 1 ELSE 0 END AS value FROM range(8) t(i)")
def truth_table_onset(spark, sf_dir):
    tt = truth.cover_table([("100", "1"), ("010", "1"), ("001", "1"), ("111", "1")])
    return spark.range(8).select(F.col("id").cast("int").alias("assignment"), truth.value_at(F.lit(tt).cast("long"), F.col("id")).alias("value"))


@query("SELECT i::INTEGER AS assignment, CASE WHEN i % 2 = 0 AND i < 4 THEN 0 ELSE 1 END AS value FROM range(8) t(i)")
def truth_table_offset(spark, sf_dir):
    tt = truth.cover_table([("0-0", "0")])
    return spark.range(8).select(F.col("id").cast("int").alias("assignment"), truth.value_at(F.lit(tt).cast("long"), F.col("id")).alias("value"))


@query("SELECT p::INTEGER AS pin, v::INTEGER AS value, CASE WHEN v = 0 THEN 0 ELSE CASE p WHEN 0 THEN 12 ELSE 10 END END::BIGINT AS cofactor FROM range(2) a(p), range(2) b(v)")
def cofactor(spark, sf_dir):
    r = spark.range(4).select(F.shiftright("id", 1).cast("int").alias("pin"), F.col("id").bitwiseAND(F.lit(1)).cast("int").alias("value"))
    return r.select("pin", "value", truth.cofactor_at(F.lit(8).cast("long"), F.col("pin"), F.col("value")).bitwiseAND(F.lit(15)).cast("long").alias("cofactor"))


@query("""WITH t(x, b, a) AS (VALUES ('R', 0, 1), ('F', 1, 0), ('H', 1, 1), ('L', 0, 0))
SELECT p.x AS a, q.x AS b, (SELECT x FROM t WHERE t.b = (p.b & q.b) AND t.a = (p.a & q.a)) AS out FROM t p, t q""")
def two_vector_eval(spark, sf_dir):
    a = extended.assignments(spark, ("a", "b"))
    now, before = (lambda c: c.isin("R", "H").cast("int")), (lambda c: c.isin("F", "H").cast("int"))
    both = lambda f: f(F.col("a")).bitwiseAND(f(F.col("b")))
    return a.select("a", "b", truth.transition(both(before), both(now)).alias("out"))


@query(golden([(0, 8), (20, 2), (25, 2), (30, 4)]))
def ext_and2(spark, sf_dir):
    return extended.histogram(extended.simulate(spark, inputs.AND2), "c")


@query(golden([(0, 38), (30, 10), (35, 4), (40, 4), (45, 8)]))
def ext_and3(spark, sf_dir):
    return extended.histogram(extended.simulate(spark, inputs.AND3), "d")


@query(golden([(0, 8), (35, 24), (40, 32)]))
def ext_adder1(spark, sf_dir):
    return extended.histogram(extended.simulate(spark, blif.circuit(ADDER1)), "s")


@query(golden([(0, 8), (35, 24), (40, 32)]))
def max_delay_hist(spark, sf_dir):
    return extended.histogram(extended.simulate(spark, blif.circuit(ADDER1)))


@query(golden([(0, 8), (35, 24), (40, 32)]))
def max_delay_covered(spark, sf_dir):
    rows = extended.simulate(spark, blif.circuit(ADDER1))
    long = rows.select("vec", F.explode(F.array(F.col("`out:s`")["arr"], F.col("`out:co`")["arr"])).alias("delay"))
    return probability.max_by_exclusion(long)


def tags(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_linestatus", F.when(F.col("l_returnflag") == "A", "R").when(F.col("l_returnflag") == "N", "F").otherwise("H").alias("trans"), F.floor("l_extendedprice").cast("long").alias("arr"))


TAGS = "WITH t AS (SELECT l_linestatus, CASE l_returnflag WHEN 'A' THEN 'R' WHEN 'N' THEN 'F' ELSE 'H' END AS trans, floor(l_extendedprice)::BIGINT AS arr FROM lineitem)"


@query(f"{TAGS} SELECT l_linestatus, trans, arr, count(*) AS n FROM t GROUP BY ALL")
def tag_merge(spark, sf_dir):
    return extended.merge_tags(tags(spark, sf_dir), ["l_linestatus"])


@query(f"{TAGS} SELECT l_linestatus, trans, max(arr) AS arr, count(*) AS n FROM t GROUP BY l_linestatus, trans, arr // 1000")
def ext_binned(spark, sf_dir):
    return extended.merge_tags(tags(spark, sf_dir), ["l_linestatus"], coarse=1000, fine=1000)


@query(f"{TAGS} SELECT l_linestatus, trans, max(arr) AS arr, count(*) AS n FROM t GROUP BY l_linestatus, trans, arr > 40000, CASE WHEN arr > 40000 THEN arr // 100 ELSE arr // 5000 END")
def ext_slack_binned(spark, sf_dir):
    return extended.merge_tags(tags(spark, sf_dir), ["l_linestatus"], coarse=5000, fine=100, threshold=F.lit(40000))


@query(golden([(0, 362), (35, 12), (40, 16), (45, 58), (50, 216), (55, 264), (60, 96)]))
def ext_majority(spark, sf_dir):
    return extended.histogram(extended.simulate(spark, inputs.MAJORITY), "o")


@query(golden([(0, 68), (30, 4), (35, 32), (40, 72), (50, 32), (55, 48), (60, 0)]))
def ext_false_path_mux(spark, sf_dir):
    return tag_ops.weighted(spark, inputs.MUX, "out").groupBy(F.col("arr").alias("delay")).agg(F.sum("n").alias("n"))


@query("SELECT 60::BIGINT AS structural, 55::BIGINT AS true_max, 1.0::DOUBLE AS total, true AS whole")
def tag_total_probability(spark, sf_dir):
    t = tag_ops.weighted(spark, inputs.MUX, "out")
    ends = distribution.false_path(t.select(F.lit(0).alias("k"), F.col("arr").alias("delay"), "probability"), ["k"])
    return ends.join(tag_ops.total_probability(t.withColumn("k", F.lit(0)), ["k"]), "k").drop("k")


@query("SELECT true AS within_limit, true AS no_less_than_exact")
def perm_capped(spark, sf_dir):
    capped = tag_ops.propagate(spark, inputs.MAJORITY, coarse=10, limit=200).where("net = 'o'").agg(F.max("arr").alias("capped"))
    exact = tag_ops.propagate(spark, inputs.MAJORITY).where("net = 'o'").agg(F.max("arr").alias("exact"))
    sizes = extended.cap_bin([{(t, 5 * (t in "RF")): 1 for t in "RFHL"}] * 5, 200, 10)
    return capped.crossJoin(exact).select((F.lit(math.prod(sizes)) <= 4**5).alias("within_limit"), (F.col("capped") >= F.col("exact")).alias("no_less_than_exact"))


@query("SELECT tags, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS fraction FROM (SELECT l_suppkey, count(*) AS tags FROM lineitem GROUP BY 1) GROUP BY tags")
def tag_counts(spark, sf_dir):
    t = tag_ops.tag_count_histogram(table(spark, sf_dir, "lineitem").select("l_suppkey"), ["l_suppkey"])
    return t.select("tags", "n", F.round("fraction", 9).alias("fraction"))


@query("""WITH t(x, b, a) AS (VALUES ('R', 0, 1), ('F', 1, 0), ('H', 1, 1), ('L', 0, 0)), v AS (SELECT p.x AS x, q.x AS y, (SELECT x FROM t WHERE t.b = (p.b & q.b) AND t.a = (p.a & q.a)) AS o FROM t p, t q)
SELECT DISTINCT 0 AS pin, x AS trans_in, o AS trans_out FROM v UNION SELECT DISTINCT 1, y, o FROM v""")
def active_arcs(spark, sf_dir):
    return tag_ops.active_arcs(spark, 8, 2)


@query("""WITH t(x, a) AS (VALUES ('R', 1), ('F', 0), ('H', 1), ('L', 0)) SELECT p.x AS a, q.x AS b, CASE WHEN p.a = 0 THEN '1' ELSE '' END AS filtered FROM t p, t q""")
def input_filter(spark, sf_dir):
    a = extended.assignments(spark, ("a", "b"))
    pins = F.array(*[F.struct(F.lit(i).cast("long").alias("arr"), F.lit(i).alias("pin"), F.col(c).alias("trans"), F.lit(0).cast("long").alias("delay")) for i, c in enumerate(("a", "b"))])
    return a.withColumn("pins", pins).select("a", "b", F.concat_ws(",", F.transform(tag_ops.filtered_inputs(8, 2), lambda x: x.cast("string"))).alias("filtered"))


@query("""WITH t(x, k) AS (VALUES ('R', 0), ('F', 1), ('H', 2), ('L', 3)) SELECT (row_number() OVER (ORDER BY p.k, q.k) - 1)::BIGINT AS row_no, p.x AS "a:0", q.x AS "b:1", CASE WHEN p.x = 'L' OR q.x = 'L' THEN 'L' WHEN p.x = 'H' THEN q.x WHEN q.x = 'H' THEN p.x WHEN p.x = q.x THEN p.x ELSE 'L' END AS out_class FROM t p, t q""")
def exhaustive_csv_order(spark, sf_dir):
    rows = extended.simulate(spark, inputs.AND2)
    wide = writers.exhaustive(rows, inputs.AND2, "c", numbered=True)
    exact = truth.transition(F.expr("cast(`a:0` in ('F','H') and `b:1` in ('F','H') as int)"), F.expr("cast(`a:0` in ('R','H') and `b:1` in ('R','H') as int)"))
    return wide.select("row_no", "a:0", "b:1", exact.alias("out_class"))


@query("WITH d AS (SELECT DISTINCT l_linestatus AS src, l_orderkey AS node FROM lineitem), c(sink, arr) AS (VALUES ('F', 3), ('O', 5)), k(src, sink, value) AS (VALUES ('F', 'F', 100), ('F', 'O', -1), ('O', 'F', 7), ('O', 'O', 0)) SELECT node, d.src, c.sink, (arr + value)::INTEGER AS required FROM d, c JOIN k ON k.sink = c.sink WHERE k.src = d.src AND value >= 0")
def clock_capture(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    data = li.select(F.col("l_orderkey").alias("node"), F.col("l_linestatus").alias("domain"))
    clocks = data.select("node").distinct().crossJoin(F.broadcast(spark.createDataFrame([("F", 3), ("O", 5)], "domain string, arr int")))
    return tag_ops.captured(data, clocks, spark.createDataFrame([("F", "F", 100), ("F", "O", -1), ("O", "F", 7), ("O", "O", 0)], "src string, sink string, value int"))


@query("SELECT * FROM (VALUES ('q', 'R', 9), ('q', 'F', 9), ('q', 'H', 9), ('q', 'L', 9)) v(net, trans, arr)")
def clock_tag_launch(spark, sf_dir):
    clocks = tag_ops.sources(spark, extended.Circuit(("clk", "a"), (), ()), clocks=("clk",))
    found = tag_ops.launched(clocks, spark.createDataFrame([("clk", "q", 9)], "clock string, net string, delay int"))
    return found.select("net", "trans", F.col("arr").cast("int").alias("arr"))


# --- probability ------------------------------------------------------------------------------------------------


def counts(spark):
    rows = [(0, "R", 3), (0, "F", 2), (0, "H", 1), (0, "L", 2), (1, "R", 1), (1, "F", 1), (1, "H", 5), (1, "L", 1)]
    return spark.createDataFrame(rows, "pi int, trans string, minterms long")


@query("SELECT n_nationkey AS pi, trans, 0.25::DOUBLE AS weight FROM nation, (VALUES ('R'), ('F'), ('H'), ('L')) v(trans)")
def uniform_weights(spark, sf_dir):
    return probability.uniform_weights(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pi")))


@query("SELECT n_nationkey AS pi, 64::BIGINT AS total, 4::BIGINT AS kinds FROM nation")
def nonuniform_weights(spark, sf_dir):
    c = probability.random_counts(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pi")), 6, 7)
    return c.where("minterms > 0").groupBy("pi").agg(F.sum("minterms").alias("total"), F.count(F.lit(1)).alias("kinds"))


@query("SELECT pi::INTEGER AS pi, m::BIGINT AS minterm, trans FROM (VALUES (0,0,'R'),(0,1,'F'),(0,2,'H'),(0,3,'L'),(0,4,'R'),(0,5,'F'),(0,6,'L'),(0,7,'R'),(1,0,'R'),(1,1,'F'),(1,2,'H'),(1,3,'L'),(1,4,'H'),(1,5,'H'),(1,6,'H'),(1,7,'H')) v(pi,m,trans)")
def roundrobin_minterms(spark, sf_dir):
    return probability.round_robin(counts(spark))


@query("SELECT pi::INTEGER AS pi, m::BIGINT AS minterm, trans FROM (VALUES (0,0,'R'),(0,1,'R'),(0,3,'F'),(0,2,'F'),(0,6,'L'),(0,7,'L'),(0,5,'H'),(0,4,'R'),(1,0,'H'),(1,1,'H'),(1,3,'H'),(1,2,'H'),(1,6,'R'),(1,7,'F'),(1,5,'L'),(1,4,'H')) v(pi,m,trans)")
def gray_minterms(spark, sf_dir):
    return probability.grouped(counts(spark), gray_code=True)


@query("SELECT a::INTEGER AS a, b::INTEGER AS b, trans_a, trans_b, n::BIGINT AS n FROM (VALUES (0,1,'R','R',1),(0,1,'F','F',1),(0,1,'H','H',1),(0,1,'L','L',1),(0,1,'R','H',2),(0,1,'F','H',1),(0,1,'L','H',1)) v(a,b,trans_a,trans_b,n)")
def joint_distribution_check(spark, sf_dir):
    return probability.pair_table(probability.round_robin(counts(spark)).select("minterm", "pi", "trans"))


@query("SELECT i AS vec, substr('RFHL', (i % 4 + 1)::INTEGER, 1) AS a, substr('RFHL', (i // 4 % 4 + 1)::INTEGER, 1) AS b FROM range(16) t(i)")
def minterm_expand(spark, sf_dir):
    return extended.assignments(spark, ("a", "b"))


# --- waveforms ----------------------------------------------------------------------------------------------------

WAVE = """WITH c AS (SELECT user_id AS run_id, event_type AS signal, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) AS t,
  CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) % 2 AS INTEGER) AS val FROM events),
k AS (SELECT run_id, t, val, lag(val) OVER w AS before, lead(t) OVER w AS fall FROM c WHERE signal = 'view' WINDOW w AS (PARTITION BY run_id ORDER BY t)),
y AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY t) - 1 AS cycle, t AS rise, fall FROM k
  WHERE before = 0 AND val = 1 AND fall IS NOT NULL AND fall < (SELECT max(t) FROM c WHERE c.run_id = k.run_id)),
m AS (SELECT y.run_id, y.cycle, s.signal,
  (SELECT max_by(val, t) FROM c WHERE c.run_id = y.run_id AND c.signal = s.signal AND c.t < y.rise) AS initial,
  (SELECT max_by(val, t) FROM c WHERE c.run_id = y.run_id AND c.signal = s.signal AND c.t < y.fall) AS final,
  coalesce((SELECT CASE WHEN max(t) >= y.rise THEN max(t) - y.rise END FROM c WHERE c.run_id = y.run_id AND c.signal = s.signal AND c.t < y.fall), 0) AS delay
  FROM y, (VALUES ('purchase'), ('error')) s(signal))"""


@query(f"{WAVE} SELECT run_id, t, CASE WHEN before = 0 AND val = 1 THEN 'rise' ELSE 'fall' END AS edge FROM k WHERE before IS NOT NULL")
def vcd_clock_edges(spark, sf_dir):
    return waveform.clock_edges(inputs.changes(spark, sf_dir), "view")


@query(f"{WAVE} SELECT * FROM y")
def vcd_cycles(spark, sf_dir):
    return waveform.cycles(inputs.changes(spark, sf_dir), "view")


@query(f"{WAVE}, w AS (SELECT run_id, t, max(val) FILTER (WHERE signal = 'purchase') AS p, max(val) FILTER (WHERE signal = 'error') AS e FROM c GROUP BY run_id, t) SELECT run_id, t, last_value(p IGNORE NULLS) OVER o AS purchase, last_value(e IGNORE NULLS) OVER o AS error FROM w WINDOW o AS (PARTITION BY run_id ORDER BY t ROWS UNBOUNDED PRECEDING)")
def vcd_ffill(spark, sf_dir):
    return waveform.filled(inputs.changes(spark, sf_dir), list(SIGNALS))


@query(f"{WAVE} SELECT * FROM m")
def vcd_delays(spark, sf_dir):
    return waveform.measured(inputs.changes(spark, sf_dir), "view", list(SIGNALS))


@query(f"{WAVE} SELECT run_id, cycle, signal, CASE WHEN initial IS NULL OR final IS NULL THEN 'X' WHEN initial = 0 AND final = 1 THEN 'R' WHEN initial = 1 AND final = 0 THEN 'F' WHEN final = 1 THEN 'H' ELSE 'L' END AS trans FROM m")
def vcd_transitions(spark, sf_dir):
    m = waveform.measured(inputs.changes(spark, sf_dir), "view", list(SIGNALS))
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("x"))
    return m.select("run_id", "cycle", "signal", truth.transition(known("initial"), known("final")).alias("trans"))


@query(f"{WAVE} SELECT run_id, cycle, max(delay) AS delay FROM m GROUP BY run_id, cycle")
def vcd_max_delay(spark, sf_dir):
    return waveform.measured(inputs.changes(spark, sf_dir), "view", list(SIGNALS)).groupBy("run_id", "cycle").agg(F.max("delay").alias("delay"))


# --- distributions ------------------------------------------------------------------------------------------------

HIST = "WITH h AS (SELECT l_returnflag AS key, l_quantity::BIGINT AS delay, count(*) AS n FROM lineitem GROUP BY ALL)"


@query(f"{HIST} SELECT key, delay, n, round(n / sum(n) OVER (PARTITION BY key), 9) AS probability FROM h")
def delay_hist(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_quantity").cast("long").alias("q"))
    return distribution.histogram(li, ["key"], "q").withColumn("probability", F.round("probability", 9))


@query(f"{HIST} SELECT key, delay, n, (sum(n) OVER (PARTITION BY key ORDER BY delay))::BIGINT AS cumulative FROM h")
def delay_cdf(spark, sf_dir):
    return distribution.cdf(inputs.histogram_of(spark, sf_dir), ["key"], "n")


@query(f"{HIST} SELECT delay, coalesce(sum(n) FILTER (WHERE key = 'A'), 0)::BIGINT AS \"prob:A\", coalesce(sum(n) FILTER (WHERE key = 'N'), 0)::BIGINT AS \"prob:N\" FROM h WHERE key IN ('A', 'N') GROUP BY delay")
def multi_hist_pivot(spark, sf_dir):
    return distribution.pivoted(inputs.histogram_of(spark, sf_dir).where("key in ('A', 'N')"), "key", ["A", "N"], "n")


@query(f"{HIST} SELECT least(floor((delay - 0) / 5.0), 9)::INTEGER AS bin, sum(n)::BIGINT AS n FROM h WHERE delay BETWEEN 0 AND 50 GROUP BY 1")
def plot_bins(spark, sf_dir):
    h = inputs.histogram_of(spark, sf_dir).withColumnRenamed("n", "probability")
    return distribution.plot_bins(h, 0, 50, 10).withColumnRenamed("probability", "n")


@query(f"{HIST}, p AS (SELECT key, delay, round(n / sum(n) OVER (PARTITION BY key), 9) AS probability FROM h) SELECT * FROM p UNION ALL SELECT key, 0, 0.0 FROM p GROUP BY key HAVING count(*) FILTER (WHERE delay = 0) = 0")
def zero_row(spark, sf_dir):
    return distribution.with_zero(delay_hist(spark, sf_dir).drop("n"), ["key"])


EMD = """, u AS (SELECT delay, sum(CASE key WHEN 'A' THEN n / (SELECT sum(n) FROM h WHERE key = 'A') ELSE -n / (SELECT sum(n) FROM h WHERE key = 'N') END) AS d FROM h WHERE key IN ('A', 'N') GROUP BY delay),
g AS (SELECT abs(sum(d) OVER (ORDER BY delay)) * (lead(delay) OVER (ORDER BY delay) - delay) AS gap FROM u)"""


def _probabilities(spark, sf_dir, key):
    return distribution.histogram(table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == key).select(F.col("l_quantity").cast("long").alias("q")), [], "q")


@query(f"{HIST} {EMD} SELECT round(sum(gap), 9) AS emd FROM g")
def emd(spark, sf_dir):
    d = distribution.earth_mover(_probabilities(spark, sf_dir, "A"), _probabilities(spark, sf_dir, "N"))
    return d.select(F.round("emd", 9).alias("emd"))


@query(f"{HIST} {EMD} SELECT round((SELECT sum(gap) FROM g) / ((SELECT max(delay) FROM h WHERE key = 'A') - (SELECT sum(delay * n) / sum(n) FROM h WHERE key = 'A')), 9) AS normalised")
def emd_normalised(spark, sf_dir):
    a = _probabilities(spark, sf_dir, "A")
    step = a.agg(F.max("delay").alias("delay")).withColumn("probability", F.lit(1.0))
    x = distribution.earth_mover(a, _probabilities(spark, sf_dir, "N")).withColumnRenamed("emd", "x")
    return x.join(distribution.earth_mover(a, step), how="inner").select(F.round(distribution.normalised(F.col("x"), F.col("emd")), 9).alias("normalised"))


@query(f"{HIST} SELECT key, round(sum(delay * n) / sum(n), 6) AS mean FROM h GROUP BY key")
def mean_delay(spark, sf_dir):
    h = distribution.histogram(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_quantity").cast("long").alias("q")), ["key"], "q")
    return distribution.mean_delay(h, ["key"]).select("key", F.round("mean", 6).alias("mean"))


@query(f"{HIST} SELECT key, max(delay) AS structural, max(CASE WHEN delay <= 40 THEN delay END) AS true_max FROM h GROUP BY key")
def false_path(spark, sf_dir):
    h = inputs.histogram_of(spark, sf_dir).withColumn("probability", F.when(F.col("delay") <= 40, F.col("n")).otherwise(0))
    return distribution.false_path(h, ["key"])


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS c, floor(o_totalprice)::BIGINT AS d FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN '?' ELSE o_orderstatus END AS c, floor(o_totalprice)::BIGINT + o_orderkey % 3 - 1 AS d FROM orders)
SELECT count(a.d) FILTER (WHERE b.d IS NOT NULL) AS matched, count(*) FILTER (WHERE a.d IS NULL OR b.d IS NULL) AS unmatched, count(*) FILTER (WHERE a.c <> b.c) AS other_class, count(*) FILTER (WHERE b.d - a.d <= -1) AS optimistic, count(*) FILTER (WHERE b.d > a.d) AS pessimistic, count(*) FILTER (WHERE b.d = a.d) AS equal FROM a FULL JOIN b ON a.k = b.k""")
def compare_exhaustive(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = F.floor("o_totalprice").cast("long")
    a = o.where("o_orderkey % 7 <> 0").select("o_orderkey", "o_orderstatus", d.alias("d"))
    b = o.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "?").otherwise(F.col("o_orderstatus")).alias("c"), (d + F.col("o_orderkey") % 3 - 1).alias("d"))
    return distribution.compare(a, b, ["k"])


@query()
def mean_ci(spark, sf_dir):
    return distribution.mean_interval(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")


@query()
def max_prob_ci(spark, sf_dir):
    return distribution.largest_interval(table(spark, sf_dir, "lineitem").select("l_quantity"), "l_quantity")


@query("WITH r AS (SELECT l_quantity AS q, row_number() OVER (ORDER BY md5(l_orderkey || ':' || l_linenumber || ':' || l_partkey), l_quantity) AS i FROM lineitem) SELECT n, round(avg(q), 6) AS mean FROM r, (VALUES (10), (100), (1000)) v(n) WHERE i <= n GROUP BY n")
def mc_convergence(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    order = [F.md5(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))), F.col("l_quantity")]
    return distribution.prefix_means(li, order, "l_quantity", [10, 100, 1000]).select("n", F.round("mean", 6).alias("mean"))


@query("WITH p AS (SELECT l_returnflag AS key, max(l_quantity)::BIGINT AS cpd FROM lineitem GROUP BY 1) SELECT key, 0::BIGINT AS delay, CASE WHEN cpd = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS probability FROM p UNION ALL SELECT key, cpd, 1.0 FROM p WHERE cpd <> 0")
def sta_step_hist(spark, sf_dir):
    cpd = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("key")).agg(F.max("l_quantity").cast("long").alias("cpd"))
    return distribution.step_histogram(cpd, ["key"])


@query("WITH v AS (SELECT l_orderkey AS vec, max(l_quantity)::BIGINT AS a, max(l_linenumber)::BIGINT AS b FROM lineitem GROUP BY 1) SELECT vec, greatest(a, b) AS delay FROM v")
def row_max(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("vec")).agg(F.max("l_quantity").cast("long").alias("a"), F.max("l_linenumber").cast("long").alias("b"))
    return distribution.row_max([li.select("vec", F.col("a").alias("delay")), li.select("vec", F.col("b").alias("delay"))], ["vec"])


@query("WITH r AS (SELECT l_quantity AS q, row_number() OVER (ORDER BY md5(l_orderkey || ':' || l_linenumber || ':' || l_partkey), l_quantity) AS n FROM lineitem), s AS (SELECT n, avg(q) OVER w AS mean, stddev_samp(q) OVER w / sqrt(n) AS error FROM r WINDOW w AS (ORDER BY n ROWS UNBOUNDED PRECEDING)) SELECT min(n) AS n, round(min_by(mean, n), 6) AS mean FROM s WHERE n >= 30 AND 2 * 2.5758293035489004 * error <= 5")
def mc_search(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    order = [F.md5(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))), F.col("l_quantity")]
    return search.smallest_sample(li, order, "l_quantity", 5.0).select("n", F.round("mean", 6).alias("mean"))


@query("SELECT i AS minterm, CASE WHEN i % 2 = 1 THEN '1' ELSE '0' END || CASE WHEN i // 2 % 2 = 1 THEN '1' ELSE '0' END || CASE WHEN i // 4 = 1 THEN '1' ELSE '0' END AS cube FROM range(8) t(i)")
def minterm_cubes(spark, sf_dir):
    return spark.range(8).select(F.col("id").alias("minterm"), probability.cube_of(F.col("id"), 3).alias("cube"))


@query("SELECT * FROM (VALUES ('and', 0.375), ('or', 0.875), ('not', 0.5), ('minus', 0.375)) v(op, fraction)")
def sat_fraction(spark, sf_dir):
    a, b = probability.cubes_to_rows(spark, ["1--", "-1-", "--1"]).where("assignment <> 0"), spark.range(8).select(F.col("id").alias("assignment")).where("assignment % 2 = 1")
    a = a.where("assignment % 8 <> 0")
    each = {"and": a.intersect(b).where("assignment <> 1"), "or": a.union(b).distinct(), "not": probability.complement(spark, b, 3), "minus": a.subtract(b)}
    out = None
    for op, rows in each.items():
        one = rows.agg(F.lit(op).alias("op"), (F.count(F.lit(1)) / 8).cast("decimal(4,3)").alias("fraction"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT 'f' AS f, 0.4375::DOUBLE AS fraction")
def sat_disjoint(spark, sf_dir):
    parts = spark.createDataFrame([("f", 0.25), ("f", 0.25)], "f string, fraction double")
    return probability.disjoint_or(parts, ["f"]).select("f", "fraction")


@query("SELECT n::INTEGER AS n, (1::HUGEINT << (2 * n)::INTEGER)::VARCHAR AS cases, round(1e6 / 4.0 ** n, 12) AS fraction FROM range(1, 20) t(n)")
def exhaustive_cases(spark, sf_dir):
    n = spark.range(1, 20).select(F.col("id").cast("int").alias("n"))
    return n.select("n", search.exhaustive_cases(F.col("n")).cast("decimal(38,0)").cast("string").alias("cases"), F.round(F.lit(1e6) / F.pow(F.lit(4.0), "n"), 12).alias("fraction"))


@query("SELECT b AS benchmark, kind, CASE WHEN note = '*' THEN mc ELSE ext END AS delay FROM (VALUES ('x', '', 5, 9), ('y', '*', 6, 7)) v(b, note, ext, mc), (VALUES ('mean'), ('max')) k(kind)")
def run_commands(spark, sf_dir):
    runs = spark.createDataFrame([("x", "", 5, 9), ("y", "*", 6, 7)], "benchmark string, note string, ext int, mc int")
    return search.commands(runs).select("benchmark", "kind", "delay")


@query("SELECT round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') / avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 9) AS speedup FROM orders")
def profile_speedup(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("action"), F.col("o_totalprice").alias("seconds"))
    return search.speedup(t, "O", "F").select(F.round("speedup", 9).alias("speedup"))


@query("SELECT * FROM (VALUES (0, 5, 12.0, 3.0), (1, 5, 9.0, 8.0)) v(domain, node, arr, req)")
def expected_times(spark, sf_dir):
    rows = [(0, 0, 5, 10.0, 3.0), (0, 1, 5, 12.0, None), (1, 0, 5, None, 8.0), (1, 1, 5, 9.0, 9.0)]
    t = spark.createDataFrame(rows, "src_domain int, sink_domain int, node_id int, t_arr double, t_req double")
    return echo.expected(t)


# --- sources --------------------------------------------------------------------------------------------------------

SDF = r'(DELAYFILE (SDFVERSION "2.1") (CELL (CELLTYPE "fpga_interconnect") (INSTANCE routing_segment_a_output_0_0_to_b_input_0_0) (DELAY (ABSOLUTE (IOPATH datain dataout (5:5:5.4) (5:5:5.4))))) (CELL (CELLTYPE "LUT_K") (INSTANCE lut_b) (DELAY (ABSOLUTE (IOPATH in\[0\] out (10:10:10) (10:10:10)) (IOPATH in\[1\] out (20:20:20) (20:20:20)))))) '


@query("SELECT 'co' AS output, 3 AS inputs, 4 AS rows UNION ALL SELECT 's', 3, 4")
def blif_parse(spark, sf_dir):
    rows = [(n["output"], len(n["inputs"]), len(n["cover"])) for n in blif.parse(ADDER1)["names"]]
    return spark.createDataFrame(rows, "output string, inputs int, rows int")


@query("SELECT 'fpga_interconnect' AS celltype, 'a' AS driver, 'b' AS sink, 0 AS pin, 5::BIGINT AS delay UNION ALL SELECT 'LUT_K', '', '', 0, 10 UNION ALL SELECT 'LUT_K', '', '', 1, 20")
def sdf_annotate(spark, sf_dir):
    rows = [(c["celltype"], c["instance"], p["pos"], p["rise"]["max"]) for c in sdf.parse(SDF)["cells"] for p in c["iopaths"]]
    d = spark.createDataFrame(rows, "celltype string, instance string, pin int, rise double")
    part = lambda i: F.regexp_extract("instance", r"^routing_segment_(.*)_output_\d+_\d+_to_(.*)_(?:input|clock)_\d+_\d+$", i)
    return d.select("celltype", part(1).alias("driver"), part(2).alias("sink"), "pin", F.round("rise").cast("long").alias("delay"))


FLIPFLOP = ".model top\n.inputs a clk\n.outputs q\n.names a q d\n11 1\n.latch d q re clk 2\n.end\n"
ECHO = "num_tnodes: 2\nNode #\tType\t\tipin\tiblk\tDomain\tis_clk_src\tSkew\tI/O Delay\t# edges\tto_node     Tdel\n0\tTN_INPAD_SOURCE\t\t3\t0\t1\t\t\t1\t1\t1e-9\n1\tTN_OUTPAD_SINK\t\t\t\t\t\t\t0\n"


def _network(spark, text):
    p = blif.parse(text)
    schemas = {"ports": blif.PORTS, "names": blif.NAMES, "latches": blif.LATCHES, "subckts": blif.SUBCKTS}
    t = {k: spark.createDataFrame(p[k], s) for k, s in schemas.items()}
    found = netlist.nodes(**t)
    return found, netlist.edges(**t, found=found)


@query("SELECT * FROM (VALUES ('CLOCK_SOURCE', 1), ('CLOCK_OPIN', 1), ('INPAD_SOURCE', 1), ('INPAD_OPIN', 1), ('OUTPAD_IPIN', 1), ('OUTPAD_SINK', 1), ('FF_IPIN', 1), ('FF_SINK', 1), ('FF_SOURCE', 1), ('FF_OPIN', 1), ('FF_CLOCK', 1), ('PRIMITIVE_IPIN', 2), ('PRIMITIVE_OPIN', 1)) t(type, n)")
def netlist_nodes(spark, sf_dir):
    return _network(spark, FLIPFLOP)[0].groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('net', 5, 5), ('cell', 9, 28)) t(kind, n, delay)")
def netlist_annotated(spark, sf_dir):
    delays = [("fpga_interconnect", "routing_segment_a_output_0_0_to_lut_d_input_0_0", 0, 5.4), ("LUT_K", "lut_d", 1, 20.0), ("DFF", "latch_q", 0, 7.5)]
    links = netlist.annotate(_network(spark, FLIPFLOP)[1], spark.createDataFrame(delays, "celltype string, instance string, pin int, value double"))
    return links.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("delay").alias("delay"))


@query("SELECT 0 AS src, 1 AS sink, 1e-9::DOUBLE AS delay")
def echo_edges(spark, sf_dir):
    return spark.createDataFrame([r for k, r in echo.parse(ECHO) if k == "tedges"], echo.SCHEMAS["tedges"])


@query(f"""WITH e AS ({EDGES}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
SELECT 0 AS part, 'digraph G {{' AS line UNION ALL SELECT 3, '}}'
UNION ALL SELECT 1, '"' || node || '"[label="' || substr(node, 1, 1) || '"]' FROM n
UNION ALL SELECT 2, '"' || src || '" -> "' || dst || '"[label="' || delay || '"]' FROM e""")
def dot_lines(spark, sf_dir):
    e = inputs.edges(spark, sf_dir)
    return writers.dot(graph.nodes_of(e).select("node", F.substring("node", 1, 1).alias("type")), e)


@query("SELECT * FROM (VALUES ('fpga_interconnect', 'routing_segment_a_output_0_0_to_b_input_0_0', 0, 5.4::DOUBLE), ('LUT_K', 'lut_b', 0, 10.0), ('LUT_K', 'lut_b', 1, 20.0)) v(celltype, instance, pin, value)")
def sdf_parse(spark, sf_dir):
    path = files.scratch(spark, SDF, "delays.sdf")
    return sdf.iopaths(sdf.read(spark, path)).select("celltype", "instance", "pin", "value")


@query("SELECT * FROM (VALUES (0, 'clk', '0'), (5, 'clk', '1'), (9, 'clk', 'x'), (9, 'd', 'z')) v(t, name, val)")
def vcd_parse(spark, sf_dir):
    text = "$timescale 1ps $end\n$scope module top $end\n$var wire 1 ! clk $end\n$var reg 1 # d $end\n$upscope $end\n$enddefinitions $end\n#0\n0!\n#5\n1!\n#9\nx!\nz#\n"
    signals, changes = vcd.read(spark, files.scratch(spark, text, "wave.vcd"))
    return changes.join(signals.select("run_id", "id", "name"), ["run_id", "id"]).select(F.col("t").cast("int").alias("t"), "name", "val")


@query("SELECT * FROM (VALUES ('STA', '1.5'), ('peak', '2048')) v(key, found)")
def log_scrape(spark, sf_dir):
    log = "### Start STA\n### End STA after 1.5 sec\nMaximum resident set size (kbytes): 2048\n### End STA after 9 sec\n"
    return vcd.scraped(files.lines(spark, files.scratch(spark, log, "run.log")), {"STA": r"End STA after ([0-9.]+)", "peak": r"set size .*: ([0-9]+)"}).select("key", "found")


@query("SELECT * FROM (VALUES (1, 0.25::DOUBLE), (2, 0.75::DOUBLE)) v(delay, probability)")
def csv_columns(spark, sf_dir):
    return files.csv(spark, files.scratch(spark, "delay,other,probability\n1,x,0.25\n2,y,0.75\n", "h.csv"), {"delay": "int", "probability": "double"})


@query("SELECT * FROM (VALUES ('a', 0), ('b[1]', 1)) v(name, pos)")
def names_file(spark, sf_dir):
    return files.names(spark, files.scratch(spark, "a\n\nb[1]\n", "names.txt")).select("name", "pos")


@query("SELECT true AS same")
def sdf_round_trip(spark, sf_dir):
    return spark.createDataFrame([(sdf.parse(sdf.printed(sdf.parse(SDF))) == sdf.parse(SDF),)], "same boolean")


@query("SELECT true AS same")
def blif_round_trip(spark, sf_dir):
    return spark.createDataFrame([(blif.parse(blif.printed(blif.parse(FLIPFLOP))) == blif.parse(FLIPFLOP),)], "same boolean")


@query("SELECT * FROM (VALUES ('FF_CLOCK', 'FF_SOURCE'), ('FF_CLOCK', 'FF_SINK')) v(src_type, dst_type)")
def clock_edges_added(spark, sf_dir):
    found = spark.createDataFrame([(1, "FF_CLOCK", 7), (2, "FF_SOURCE", 7), (3, "FF_SINK", 7), (4, "FF_SINK", 8)], "node int, type string, block int")
    e = graph.clock_edges(found)
    kind = found.select("node", "type")
    return e.join(kind, F.col("src") == F.col("node")).select(F.col("type").alias("src_type"), "dst").join(kind, F.col("dst") == F.col("node")).select("src_type", F.col("type").alias("dst_type"))


@query(f"{PATHS}, l AS (SELECT node, max(level) AS level FROM p GROUP BY node), m AS (SELECT node, row_number() OVER (ORDER BY level, node) - 1 AS new_id FROM l) SELECT new_id AS node, 'input' AS dir, n_nationkey::DOUBLE AS value FROM nation JOIN m ON m.node = concat('N', n_nationkey)")
def constraint_remap(spark, sf_dir):
    given = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("node"), F.lit("input").alias("dir"), F.col("n_nationkey").cast("double").alias("value"))
    return graph.remapped(given, graph.relayout(network(spark, sf_dir)[1]))


@query("SELECT * FROM (VALUES ('a', 'in'), ('clk', 'in'), ('q', 'out')) v(port, dir)")
def swept_ports(spark, sf_dir):
    p = blif.parse(FLIPFLOP.replace(".inputs a clk", ".inputs a clk unused"))
    t = {k: spark.createDataFrame(p[k], s) for k, s in {"ports": blif.PORTS, "names": blif.NAMES, "latches": blif.LATCHES}.items()}
    return blif.swept(**t).select("port", "dir")


@query(f"WITH e AS ({EDGES}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node FROM n WHERE node NOT IN (SELECT dst FROM e)")
def node_selection(spark, sf_dir):
    return graph.selected(inputs.edges(spark, sf_dir), "pi")


@query("WITH t(src, dst) AS (VALUES ('a', 'b'), ('b', 'c')) SELECT 'a' AS node, 'in_a' AS name UNION ALL SELECT 'b', '<unknown>' UNION ALL SELECT 'c', '<unknown>'")
def node_names(spark, sf_dir):
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    return netlist.named(n, spark.createDataFrame([("a", "in_a")], "node string, name string"))
