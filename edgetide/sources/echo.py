"""Timing-graph echo files: tab-separated sections of nodes with their edges, arrival and required times, constraints."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.staging import ship

SCHEMAS = {
    "tnodes": "node_id long, type string, ipin int, iblk int, domain int, is_clk_src boolean, skew double, io_delay double",
    "tedges": "src long, sink long, delay double",
    "levels": "level int, node_id long",
    "arr_req": "src_domain int, sink_domain int, node_id long, t_arr double, t_req double",
    "clock_constraints": "src int, sink int, value double",
    "io_constraints": "node_id long, dir string, value double",
}

#: Heads of sections, as they begin a line.
HEADS = {"Node #\tType": "nodes", "Net #": "nets", "Node #\t\tT_arr": "times", "Clock Constraints": "clock", "Input Constraints": "input", "Output Constraints": "output"}
COLUMN_HEADS = ("Src_Clk", "tnode_id")


def number(word: str) -> float | None:
    return None if word in ("", "-") else float(word)


def whole(word: str) -> int | None:
    return int(word) if word else None


def parse(text: str) -> Iterator[tuple[str, tuple]]:
    """(table, row) in order of the lines, for the tables

    tnodes (node_id, type, ipin, iblk, domain, is_clk_src, skew, io_delay), tedges (src, sink, delay), levels (level, node_id),
    arr_req (src_domain, sink_domain, node_id, t_arr, t_req), clock_constraints (src, sink, value),
    io_constraints (node_id, dir, value). Empty fields are None. Edges to -1 and constraints of -1 mean none and are left out.
    """
    section, node, level, domains = "nodes", None, None, (None, None)
    for line in text.splitlines():
        head = next((s for h, s in HEADS.items() if line.startswith(h)), None)
        words = [w.strip() for w in line.split("\t")]
        filled = [w for w in words if w]
        if head:
            section = head
        elif not filled or line.startswith(("num_tnode", *COLUMN_HEADS)):
            continue
        elif line.startswith("Level:"):
            section, level = "levels", int(line.split()[1])
        elif line.startswith("SRC_Domain:"):
            section, domains = "times", tuple(int(w.split(":")[1]) for w in filled)
        elif section == "nodes" and words[0]:
            node, rest = int(words[0]), [*words[2:], *[""] * 9]
            yield "tnodes", (node, words[1].removeprefix("TN_"), *map(whole, rest[:3]), rest[3] == "1", number(rest[4]), number(rest[5]))
            if rest[7] and int(rest[7]) >= 0:
                yield "tedges", (node, int(rest[7]), float(rest[8]))
        elif section == "nodes":
            if int(filled[0]) >= 0:
                yield "tedges", (node, int(filled[0]), float(filled[1]))
        elif section == "levels":
            for w in filled:
                if w.lstrip("-").isdigit():
                    yield "levels", (level, int(w))
        elif section == "times":
            yield "arr_req", (*domains, int(filled[0]), number(filled[1]), number(filled[2]))
        elif section == "clock" and float(filled[2]) != -1:
            yield "clock_constraints", (int(filled[0]), int(filled[1]), float(filled[2]))
        elif section in ("input", "output") and float(filled[1]) != -1:
            yield "io_constraints", (int(filled[0]), section, float(filled[1]))


def _flat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = {k: [c.split()[0] for c in s.split(", ")] for k, s in SCHEMAS.items()}
    for b in batches:
        rows = [(p, kind, json.dumps(dict(zip(names[kind], r)))) for p, text in zip(b["path"], b["value"]) for kind, r in parse(text)]
        yield pd.DataFrame(rows, columns=["path", "kind", "row"])


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of ``parse`` over all files of a path, each row with its file; one task reads a whole file."""
    rows = ship(spark).read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value").mapInPandas(_flat, "path string, kind string, row string")
    return {k: rows.where(F.col("kind") == k).select("path", F.from_json("row", s).alias("r")).select("path", "r.*") for k, s in SCHEMAS.items()}


def expected(times: DataFrame) -> DataFrame:
    """(domain, node, arr, req) over all source domains of arr_req rows: the latest arrival and the earliest required time; an
    unknown time never replaces a known one."""
    return times.groupBy(F.col("src_domain").alias("domain"), F.col("node_id").alias("node")).agg(F.max("t_arr").alias("arr"), F.min("t_req").alias("req"))
