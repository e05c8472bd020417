"""Netlist to network, delay annotation, echo reader and sinks, against values worked out by hand."""

import glob

from edgetide.operators import netlist
from edgetide.sources import blif, echo, endpoints, writers

TEXT = """.model top
.inputs a clk
.outputs q z
.names a x d
11 1
.names x
1
.names unread
.latch d q re clk 2
.subckt inv in=a out=z
.end
.model inv
.inputs in
.outputs out
.names in out
0 1
.end
"""


def tables(spark, text):
    p = blif.parse(text)
    schemas = {"ports": blif.PORTS, "names": blif.NAMES, "latches": blif.LATCHES, "subckts": blif.SUBCKTS}
    return {k: spark.createDataFrame(p[k], s) for k, s in schemas.items()}


def test_network(spark):
    t = tables(spark, TEXT)
    found = netlist.nodes(**t)
    types = {r.node: r.type for r in found.where("model = 'top'").collect()}
    assert types["in:clk:source"] == "CLOCK_SOURCE" and types["in:a:source"] == "INPAD_SOURCE"
    assert types["names:x:opin"] == "CONSTANT_GEN_SOURCE" and "names:unread:opin" not in types
    assert {k.split(":")[2] for k in types if k.startswith("latch:q")} == {"ipin", "sink", "source", "opin", "clock"}
    links = netlist.edges(**t, found=found)
    e = {(r.src, r.dst) for r in links.where("model = 'top'").collect()}
    assert {("in:a:opin", "names:d:0"), ("names:d:opin", "latch:q:ipin"), ("latch:q:opin", "out:q:ipin"), ("in:clk:opin", "latch:q:clock"), ("sub:0:in", "sub:0:out"), ("sub:0:out", "out:z:ipin")} <= e
    assert len(e) == 4 + 4 + 2 + 1 + 7
    assert netlist.problems(t["ports"], t["latches"], t["subckts"], found).count() == 0
    delays = [("fpga_interconnect", "routing_segment_a_output_0_0_to_lut_d_input_0_0", 0, 5.4), ("LUT_K", "lut_d", 1, 20.0), ("DFF", "latch_q", 0, 7.5)]
    got = {(r.src, r.dst): r.delay for r in netlist.annotate(links.where("model = 'top'"), spark.createDataFrame(delays, "celltype string, instance string, pin int, value double")).collect()}
    assert {k: v for k, v in got.items() if v} == {("in:a:opin", "names:d:0"): 5, ("names:d:1", "names:d:opin"): 20, ("latch:q:ipin", "latch:q:sink"): 8}


def test_problems(spark):
    t = tables(spark, ".model m\n.inputs a\n.outputs y\n.latch a q fe c 0\n.subckt gone p=a\n.end\n")
    got = {(r.rule, r.what) for r in netlist.problems(t["ports"], t["latches"], t["subckts"], netlist.nodes(**t)).collect()}
    assert got == {("one driver", "y"), ("one driver", "c"), ("one driver", "q"), ("known model", "gone"), ("rising edge", "q")} - {("one driver", "q")}


def test_echo(spark, tmp_path):
    node = "0\tTN_INPAD_SOURCE\t\t3\t0\t1\t\t0.5\t2\t1\t1e-9\n" + "\t" * 11 + "2\t2e-9\n1\tTN_OUTPAD_SINK\t\t\t\t\t\t\t1\t-1\t0\n"
    text = "num_tnodes: 2\nNode #\tType\t\tipin\tiblk\tDomain\tis_clk_src\tSkew\tI/O Delay\t# edges\tto_node     Tdel\n\n" + node
    text += "num_tnode_levels: 1\nLevel: 0 Num_nodes: 2\nNodes:\t0\t1\nSRC_Domain: 0\tSINK_Domain: 1\nNode #\t\tT_arr\t\tT_req\n0\t1e-9\t\t-\n"
    text += "Clock Constraints\nSrc_Clk\tSink_Clk\tConstraint\n0\t1\t5e-9\n1\t1\t-1.0\nInput Constraints\ntnode_id\tinput_delay\n0\t0.5\nOutput Constraints\ntnode_id\toutput_delay\n1\t-1\n"
    got = list(echo.parse(text))
    assert [r for k, r in got if k == "tnodes"] == [(0, "INPAD_SOURCE", None, 3, 0, True, None, 0.5), (1, "OUTPAD_SINK", None, None, None, False, None, None)]
    assert [r for k, r in got if k == "tedges"] == [(0, 1, 1e-9), (0, 2, 2e-9)]
    assert [r for k, r in got if k in ("levels", "arr_req")] == [(0, 0), (0, 1), (0, 1, 0, 1e-9, None)]
    assert [r for k, r in got if "constraints" in k] == [(0, 1, 5e-9), (0, "input", 0.5)]
    (tmp_path / "g.echo").write_text(text)
    tables = echo.read(spark, str(tmp_path))
    for name, df in tables.items():
        assert [tuple(r)[1:] for r in df.collect()] == [r for k, r in got if k == name]


def test_sinks(spark, tmp_path):
    writers.histograms(spark.createDataFrame([("a", 2.0, 0.25), ("a", 1.0, 0.75)], "name string, delay double, probability double"), f"{tmp_path}/h")
    (f,) = glob.glob(f"{tmp_path}/h/name=a/*.csv")
    assert open(f).read().split() == ["delay,probability", "1.0,0.75", "2.0,0.25"]
    n = spark.createDataFrame([('a"b', "INPAD_SOURCE"), ("c", None)], "node string, type string")
    writers.write_dot(n, spark.createDataFrame([('a"b', "c", 3)], "src string, dst string, delay long"), f"{tmp_path}/d")
    text = "".join(open(x).read() for x in sorted(glob.glob(f"{tmp_path}/d/*.txt")))
    assert text.splitlines()[0] == "digraph G {" and text.splitlines()[-1] == "}" and '"a\\"b" -> "c"[label="3"]' in text


def test_endpoints(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"endpoint_timing": [\n{"node_identifier": "q", "T_arr": 2e-9},\n{"node_identifier": "z"}]}')
    (tmp_path / "b.json").write_text("{}")
    got = {r.node: r.arrival_ps for r in endpoints.read(spark, str(tmp_path)).collect()}
    assert set(got) == {"q", "z"} and abs(got["q"] - 2000) < 1e-6 and got["z"] is None
