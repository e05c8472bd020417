"""From a netlist's tables to a timing network: pads, latches, covers and subcircuits become nodes; nets become edges.

Nodes are (model, node, type, net, role, block, pin): ``net`` is what the node drives or reads, ``block`` the name that delay
files use. Edges are (model, src, dst, kind, block, pin), kind being net or cell; net edges have no pin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "model string, node string, type string, net string, role string, block string, pin int"


def _node(id: Column, type: str, net: Column | None = None, role: str | None = None, block: Column | None = None, pin: Column | None = None) -> Column:
    fields = {"node": id, "type": F.lit(type), "net": net, "role": F.lit(role), "block": block, "pin": pin}
    types = {"pin": "int"}
    return F.struct(*[(F.lit(None) if v is None else v).cast(types.get(k, "string")).alias(k) for k, v in fields.items()])


def _rows(df: DataFrame, *nodes: Column) -> DataFrame:
    return df.select("model", F.explode(F.array(*nodes)).alias("n")).select("model", "n.*")


def _named(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _block(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(prefix), F.replace(name, F.lit("."), F.lit("_")))


def clock_nets(latches: DataFrame) -> DataFrame:
    """(model, net, domain): nets that control a latch; domains are numbered by net name, so they do not depend on order."""
    found = latches.where("control is not null and control <> 'NIL'").groupBy("model").agg(F.array_sort(F.collect_set("control")).alias("c"))
    return found.select("model", F.posexplode("c").alias("domain", "net")).select("model", "net", "domain")


def nodes(ports: DataFrame, names: DataFrame, latches: DataFrame, subckts: DataFrame) -> DataFrame:
    """All nodes of all models. A cover without inputs whose net is read by nobody has none; nor has a black box an inside."""
    p, out = F.col("port"), F.col("output")
    clocks = clock_nets(latches).select("model", F.col("net").alias("port"), F.lit(True).alias("clock"))
    ins = ports.where("dir in ('in', 'clock')").join(clocks, ["model", "port"], "left")
    pad = lambda df, source, pin: _rows(df, _node(_named("in:", p, ":source"), source), _node(_named("in:", p, ":opin"), pin, p, "driver", _block("", p)))
    all_nodes = pad(ins.where("clock is null"), "INPAD_SOURCE", "INPAD_OPIN").union(pad(ins.where("clock"), "CLOCK_SOURCE", "CLOCK_OPIN"))
    all_nodes = all_nodes.union(_rows(ports.where("dir = 'out'"), _node(_named("out:", p, ":ipin"), "OUTPAD_IPIN", p, "sink", _block("", p)), _node(_named("out:", p, ":sink"), "OUTPAD_SINK")))
    q, at = F.col("q"), lambda what: _named("latch:", F.col("q"), f":{what}")
    of_latch = [_node(at("ipin"), "FF_IPIN", F.col("d"), "sink", _block("latch_", q)), _node(at("sink"), "FF_SINK"), _node(at("source"), "FF_SOURCE")]
    of_latch += [_node(at("opin"), "FF_OPIN", q, "driver", _block("latch_", q)), _node(at("clock"), "FF_CLOCK", F.col("control"), "sink", _block("latch_", q))]
    all_nodes = all_nodes.union(_rows(latches, *of_latch))
    lut = _block("lut_", out)
    pins = names.select("model", "output", F.posexplode("inputs").alias("pin", "input"))
    all_nodes = all_nodes.union(_rows(pins, _node(_named("names:", out, ":", F.col("pin").cast("string")), "PRIMITIVE_IPIN", F.col("input"), "sink", lut, F.col("pin"))))
    all_nodes = all_nodes.union(_rows(names.where("size(inputs) > 0"), _node(_named("names:", out, ":opin"), "PRIMITIVE_OPIN", out, "driver", lut)))
    conn = connections(ports, subckts)
    id = _named("sub:", F.col("subckt_id").cast("string"), ":", p)
    all_nodes = all_nodes.union(_rows(conn.where("dir = 'in'"), _node(id, "PRIMITIVE_IPIN", F.col("net"), "sink", F.lit(None), F.col("pos"))))
    all_nodes = all_nodes.union(_rows(conn.where("dir = 'out'"), _node(id, "PRIMITIVE_OPIN", F.col("net"), "driver")))
    read = all_nodes.where("role = 'sink'").select("model", F.col("net").alias("output")).distinct()
    constants = names.where("size(inputs) = 0").join(read, ["model", "output"], "left_semi")
    return all_nodes.union(_rows(constants, _node(_named("names:", out, ":opin"), "CONSTANT_GEN_SOURCE", out, "driver", lut)))


def connections(ports: DataFrame, subckts: DataFrame) -> DataFrame:
    """(model, subckt_id, port, net, dir, pos) of subcircuit ports; dir and pos come from the model that is referred to."""
    each = subckts.select("model", "subckt_id", "type", F.explode("conn").alias("port", "net"))
    of = ports.select(F.col("model").alias("type"), "port", F.when(F.col("dir") == "clock", "in").otherwise(F.col("dir")).alias("dir"), "pos")
    return each.join(of, ["type", "port"]).drop("type")


def problems(ports: DataFrame, latches: DataFrame, subckts: DataFrame, found: DataFrame) -> DataFrame:
    """(model, rule, what): nets without exactly one driver, subcircuits of unknown models, latches that don't rise."""
    drivers = found.where("role is not null").groupBy("model", "net").agg(F.count_if(F.col("role") == "driver").alias("n")).where("n <> 1")
    out = drivers.select("model", F.lit("one driver").alias("rule"), F.col("net").alias("what"))
    unknown = subckts.join(ports.select(F.col("model").alias("type")).distinct(), "type", "left_anti")
    out = out.union(unknown.select("model", F.lit("known model"), "type"))
    return out.union(latches.where("not type <=> 're'").select("model", F.lit("rising edge"), "q"))


def edges(ports: DataFrame, names: DataFrame, latches: DataFrame, subckts: DataFrame, found: DataFrame) -> DataFrame:
    """Edges inside pads, latches, covers and subcircuits (each input to each output), and driver to sinks along each net."""
    p, out, none = F.col("port"), F.col("output"), F.lit(None)

    def rows(df: DataFrame, *pairs: tuple) -> DataFrame:
        each = F.array(*[F.struct(a.alias("src"), b.alias("dst"), F.lit("cell").alias("kind"), block.cast("string").alias("block"), pin.cast("int").alias("pin")) for a, b, block, pin in pairs])
        return df.select("model", F.explode(each).alias("e")).select("model", "e.*")

    at, latch = lambda what: _named("latch:", F.col("q"), f":{what}"), _block("latch_", F.col("q"))
    inside = rows(ports.where("dir in ('in', 'clock')"), (_named("in:", p, ":source"), _named("in:", p, ":opin"), none, none))
    inside = inside.union(rows(ports.where("dir = 'out'"), (_named("out:", p, ":ipin"), _named("out:", p, ":sink"), none, none)))
    # pin 0 of a latch is its setup check, pin 1 its path from clock to output; the clock's own edges have no delay
    inside = inside.union(rows(latches, (at("ipin"), at("sink"), latch, F.lit(0)), (at("source"), at("opin"), latch, F.lit(1)), (at("clock"), at("sink"), none, none), (at("clock"), at("source"), none, none)))
    pins = names.select("model", "output", F.posexplode("inputs").alias("pin", "input"))
    inside = inside.union(rows(pins, (_named("names:", out, ":", F.col("pin").cast("string")), _named("names:", out, ":opin"), _block("lut_", out), F.col("pin"))))
    conn, id = connections(ports, subckts), lambda c: _named("sub:", F.col("subckt_id").cast("string"), ":", F.col(c))
    both = conn.where("dir = 'in'").select("model", "subckt_id", F.col("port").alias("a")).join(conn.where("dir = 'out'").select("model", "subckt_id", F.col("port").alias("b")), ["model", "subckt_id"])
    inside = inside.union(rows(both, (id("a"), id("b"), none, none)))
    drive = found.where("role = 'driver'").select("model", "net", F.col("node").alias("src"), F.col("block").alias("from"))
    sinks = found.where("role = 'sink'").select("model", "net", F.col("node").alias("dst"), F.col("block").alias("to"))
    along = drive.join(sinks, ["model", "net"]).select("model", "src", "dst", F.lit("net").alias("kind"), F.concat_ws(">", "from", "to").alias("block"), F.lit(None).cast("int").alias("pin"))
    return inside.union(along)


ROUTE = r"^routing_segment_(.*)_output_\d+_\d+_to_(.*)_(?:input|clock)_\d+_\d+$"


def annotate(links: DataFrame, delays: DataFrame) -> DataFrame:
    """links with ``delay`` (long): the rounded longest delay from delays (celltype, instance, pin, value), 0 where none is.

    Interconnect cells are met by the driver and sink in their instance name, other cells by instance and pin.
    """
    routed = F.col("celltype") == "fpga_interconnect"
    block = F.when(routed, F.concat_ws(">", F.regexp_extract("instance", ROUTE, 1), F.regexp_extract("instance", ROUTE, 2))).otherwise(F.col("instance"))
    pin = F.when(~routed, F.col("pin"))
    known = delays.select(block.alias("b"), pin.alias("p"), F.round("value").cast("long").alias("delay")).groupBy("b", "p").agg(F.max("delay").alias("delay"))
    met = links.join(known, (F.col("block") == F.col("b")) & F.col("pin").eqNullSafe(F.col("p")), "left")
    return met.select(*links.columns, F.coalesce("delay", F.lit(0).cast("long")).alias("delay"))


def named(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """nodes with ``name`` from names (node, name); a node that has none is ``<unknown>``."""
    return nodes.join(names, "node", "left").withColumn("name", F.coalesce("name", F.lit("<unknown>")))
