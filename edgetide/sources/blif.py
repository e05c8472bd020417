"""BLIF netlists: statements of a text, and DataFrames over many files (one task a file; rows carry the path)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.operators.extended import Circuit, Gate
from edgetide.staging import ship

PORTS, NAMES, LATCHES, SUBCKTS = (
    "model string, port string, dir string, pos int",
    "model string, names_id int, output string, inputs array<string>, cover array<struct<bits: string, out: string>>",
    "model string, d string, q string, type string, control string, init string",
    "model string, subckt_id int, type string, conn map<string,string>",
)


def statements(text: str) -> Iterator[list[str]]:
    """Words of each statement; # begins a comment, a backslash at the end continues the line."""
    held = ""
    for line in text.splitlines():
        line = held + line.split("#", 1)[0].rstrip()
        if line.endswith("\\"):
            held = line[:-1] + " "
            continue
        held = ""
        if words := line.split():
            yield words
    if held.split():
        yield held.split()


def parse(text: str) -> dict[str, list[dict]]:
    """ports, names, latches, subckts of all models; a statement that is not known stops the parse."""
    out: dict[str, list[dict]] = {"ports": [], "names": [], "latches": [], "subckts": []}
    model, current, seen = "", None, {}
    for words in statements(text):
        head, rest = words[0], words[1:]
        if head == ".model":
            model, seen = rest[0], {}
        elif head in (".inputs", ".outputs", ".clock"):
            kind = {".inputs": "in", ".outputs": "out", ".clock": "clock"}[head]
            for p in rest:
                out["ports"].append({"model": model, "port": p, "dir": kind, "pos": seen.get(kind, 0)})
                seen[kind] = seen.get(kind, 0) + 1
        elif head == ".names":
            current = {"model": model, "names_id": len(out["names"]), "output": rest[-1], "inputs": rest[:-1], "cover": []}
            out["names"].append(current)
            continue
        elif head == ".latch":
            kind, control = (rest[2], rest[3]) if len(rest) >= 4 else (None, None)
            out["latches"].append({"model": model, "d": rest[0], "q": rest[1], "type": kind, "control": control, "init": rest[-1] if len(rest) in (3, 5) else None})
        elif head == ".subckt":
            out["subckts"].append({"model": model, "subckt_id": len(out["subckts"]), "type": rest[0], "conn": dict(x.split("=", 1) for x in rest[1:])})
        elif head in (".end", ".blackbox"):
            pass
        elif current is not None and set("".join(words)) <= set("01-"):
            current["cover"].append({"bits": words[0] if len(words) == 2 else "", "out": words[-1]})
            continue
        else:
            raise ValueError(f"unknown statement {' '.join(words)[:60]!r}")
        current = None
    return out


def _flat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(p, kind, json.dumps(r)) for p, text in zip(b["path"], b["value"]) for kind, found in parse(text).items() for r in found]
        yield pd.DataFrame(rows, columns=["path", "kind", "row"])


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """ports, names, latches, subckts as DataFrames; gzip by extension."""
    rows = ship(spark).read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value").mapInPandas(_flat, "path string, kind string, row string")
    schemas = {"ports": PORTS, "names": NAMES, "latches": LATCHES, "subckts": SUBCKTS}
    return {k: rows.where(F.col("kind") == k).select("path", F.from_json("row", s).alias("r")).select("path", "r.*") for k, s in schemas.items()}


def nets(ports: DataFrame, names: DataFrame, latches: DataFrame) -> DataFrame:
    """(model, net, drivers, sinks) with arrays of what drives and reads each net."""
    row = lambda df, net, role, by: df.select("model", F.col(net).alias("net"), F.lit(role).alias("role"), by.alias("by"))
    ends = row(ports.where("dir = 'in'"), "port", "driver", F.lit("input")).union(row(ports.where("dir = 'out'"), "port", "sink", F.lit("output")))
    ends = ends.union(row(names, "output", "driver", F.concat(F.lit("names:"), F.col("output"))))
    ends = ends.union(row(names.select("model", "output", F.explode("inputs").alias("i")), "i", "sink", F.concat(F.lit("names:"), F.col("output"))))
    ends = ends.union(row(latches, "q", "driver", F.concat(F.lit("latch:"), F.col("q")))).union(row(latches, "d", "sink", F.concat(F.lit("latch:"), F.col("q"))))
    of = lambda role: F.sort_array(F.collect_list(F.when(F.col("role") == role, F.col("by"))))
    return ends.groupBy("model", "net").agg(of("driver").alias("drivers"), of("sink").alias("sinks"))


def clean(found: DataFrame) -> DataFrame:
    """Nets that have a driver and a sink."""
    return found.where((F.size("drivers") > 0) & (F.size("sinks") > 0))


def circuit(text: str) -> Circuit:
    """The combinational circuit of the first model, with the delay model of ``extended.gate``."""
    p = parse(text)
    top = p["ports"][0]["model"]
    io = {d: tuple(x["port"] for x in p["ports"] if x["model"] == top and x["dir"] == d) for d in ("in", "out")}
    gates = [Gate(n["output"], tuple(n["inputs"]), tuple((c["bits"], c["out"]) for c in n["cover"]), tuple(10 + 10 * i for i in range(len(n["inputs"])))) for n in p["names"] if n["model"] == top]
    return Circuit(io["in"], io["out"], tuple(gates))


def printed(parsed: dict[str, list[dict]]) -> str:
    """A netlist's text, which ``parse`` reads back."""
    out, models = [], list(dict.fromkeys(r["model"] for k in ("ports", "names", "latches", "subckts") for r in parsed[k]))
    for m in models:
        own = {k: [r for r in parsed[k] if r["model"] == m] for k in parsed}
        out.append(f".model {m}")
        for kind, word in (("in", ".inputs"), ("out", ".outputs"), ("clock", ".clock")):
            if found := [p["port"] for p in own["ports"] if p["dir"] == kind]:
                out.append(" ".join([word, *found]))
        for n in own["names"]:
            out.append(" ".join([".names", *n["inputs"], n["output"]]))
            out += [f"{c['bits']} {c['out']}".strip() for c in n["cover"]]
        for x in own["latches"]:
            out.append(" ".join([".latch", x["d"], x["q"], *([x["type"], x["control"]] if x["type"] else []), *([x["init"]] if x["init"] is not None else [])]))
        out += [" ".join([".subckt", s["type"], *[f"{a}={b}" for a, b in s["conn"].items()]]) for s in own["subckts"]]
        out.append(".end")
    return "\n".join([*out, ""])


def swept(ports: DataFrame, names: DataFrame, latches: DataFrame) -> DataFrame:
    """ports without the inputs that nothing reads and the outputs that nothing drives."""
    read = names.select("model", F.explode("inputs").alias("port")).union(latches.select("model", "d")).union(latches.select("model", "control")).union(ports.where("dir = 'out'").select("model", "port"))
    driven = names.select("model", F.col("output").alias("port")).union(latches.select("model", "q")).union(ports.where("dir <> 'out'").select("model", "port"))
    return ports.where("dir <> 'out'").join(read, ["model", "port"], "left_semi").union(ports.where("dir = 'out'").join(driven, ["model", "port"], "left_semi"))
