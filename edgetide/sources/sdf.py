"""SDF delay files: nested lists read into cells with their paths and checks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.staging import ship

_TOKEN = re.compile(r'"[^"]*"|[()]|(?:\\.|[^\s()"\\])+')


def expressions(text: str) -> list:
    """The file as nested lists of words. Comments // and /* */ are dropped."""
    text = re.sub(r"//[^\n]*|/\*.*?\*/", "", text, flags=re.S)
    stack: list[list] = [[]]
    for t in _TOKEN.findall(text):
        if t == "(":
            stack.append([])
        elif t == ")":
            if len(stack) < 2:
                raise ValueError("a bracket closes that was not opened")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(t.strip('"'))
    if len(stack) != 1:
        raise ValueError("a bracket is not closed")
    return stack[0]


def triple(x: list) -> dict[str, float | None]:
    """(min:typ:max); a single number is all three; () is three nulls."""
    parts = "".join(x).split(":") if x else []
    values = [float(v) if v else None for v in parts] or [None]
    return dict(zip(("min", "typ", "max"), values * 3 if len(values) == 1 else values))


def port(x) -> dict[str, str | None]:
    return {"port": x[1], "cond": x[0]} if isinstance(x, list) else {"port": unescape(x), "cond": None}


def unescape(name: str) -> str:
    return name.replace("\\", "")


def escape(name: str, keep_last_index: bool = False) -> str:
    """Special characters behind a backslash; a final [n] stays as it is if asked."""
    m = re.search(r"\[\d+\]$", name) if keep_last_index else None
    head, tail = (name[: m.start()], m.group()) if m else (name, "")
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", head) + tail


def parse(text: str) -> dict:
    """{"header": {...}, "cells": [{celltype, instance, iopaths, setup, hold}]}."""
    (top,) = [e for e in expressions(text) if e and e[0] == "DELAYFILE"]
    header, cells = {}, []
    for item in top[1:]:
        if item[0] != "CELL":
            header[item[0].lower()] = " ".join(map(str, item[1:]))
            continue
        cell = {"celltype": None, "instance": None, "iopaths": [], "setup": [], "hold": []}
        for part in item[1:]:
            if part[0] in ("CELLTYPE", "INSTANCE"):
                cell[part[0].lower()] = unescape(part[1]) if len(part) > 1 else None
            elif part[0] == "DELAY":
                paths = [p for a in part[1:] for p in a[1:] if p[0] == "IOPATH"]
                for p in paths:
                    rise = triple(p[3])
                    cell["iopaths"].append({"pos": len(cell["iopaths"]), "in": port(p[1]), "out": port(p[2]), "rise": rise, "fall": triple(p[4]) if len(p) > 4 else rise})
            elif part[0] == "TIMINGCHECK":
                for c in part[1:]:
                    cell[c[0].lower()].append({"port": port(c[1]), "clock": port(c[2]), "value": triple(c[3])})
        cells.append(cell)
    return {"header": header, "cells": cells}


TRIPLE = "struct<min: double, typ: double, max: double>"
PORT = "struct<port: string, cond: string>"
CHECK = f"array<struct<port: {PORT}, clock: {PORT}, value: {TRIPLE}>>"
CELLS = f"celltype string, instance string, iopaths array<struct<pos: int, `in`: {PORT}, out: {PORT}, rise: {TRIPLE}, fall: {TRIPLE}>>, setup {CHECK}, hold {CHECK}"


def _flat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(p, json.dumps(c)) for p, text in zip(b["path"], b["value"]) for c in parse(text)["cells"]]
        yield pd.DataFrame(rows, columns=["path", "row"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The cells of all files of a path, each with its file; one task reads a whole file."""
    rows = ship(spark).read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value").mapInPandas(_flat, "path string, row string")
    return rows.select("path", F.from_json("row", CELLS).alias("r")).select("path", "r.*")


def iopaths(cells: DataFrame) -> DataFrame:
    """(path, celltype, instance, pin, value, same): the longest delay of each path, and whether rise and fall agree."""
    each = cells.select("path", "celltype", "instance", F.explode("iopaths").alias("p"))
    return each.select("path", "celltype", "instance", F.col("p.pos").alias("pin"), F.col("p.rise.max").alias("value"), F.col("p.rise.max").eqNullSafe(F.col("p.fall.max")).alias("same"))


def printed(file: dict) -> str:
    """A delay file's text, which ``parse`` reads back."""
    number = lambda v: "" if v is None else repr(v)
    value = lambda t: "(" + ("" if all(v is None for v in t.values()) else ":".join(number(t[k]) for k in ("min", "typ", "max"))) + ")"
    name = lambda p: f"({p['cond']} {p['port']})" if p["cond"] else escape(p["port"])
    out = ["(DELAYFILE"] + [f'  ({k.upper()} "{v}")' for k, v in file["header"].items()]
    for c in file["cells"]:
        out.append(f'  (CELL (CELLTYPE "{c["celltype"]}") (INSTANCE {escape(c["instance"] or "")})')
        if c["iopaths"]:
            out += ["    (DELAY (ABSOLUTE", *[f"      (IOPATH {name(p['in'])} {name(p['out'])} {value(p['rise'])} {value(p['fall'])})" for p in c["iopaths"]], "    ))"]
        checks = [f"      ({kind.upper()} {name(x['port'])} {name(x['clock'])} {value(x['value'])})" for kind in ("setup", "hold") for x in c[kind]]
        out += ["    (TIMINGCHECK", *checks, "    )"] if checks else []
        out.append("  )")
    return "\n".join([*out, ")", ""])
