"""Level loops: the levels that run as jobs, the tail that one task finishes, and deep and cyclic networks."""

import random

import pytest

from edgetide.operators import graph, timing


def network(seed, n=300, depth=12):
    r = random.Random(seed)
    out = []
    for i in range(n):
        for _ in range(r.randint(0, 3)):
            j = r.randint(i + 1, min(n, i + 1 + n // depth))
            out.append((f"n{i:04}", f"n{j:04}", r.randint(0, 9)))
    return out


def longest(edges, value, pick, sign, back=False):
    ins, nodes = {}, sorted({x for e in edges for x in e[:2]}, reverse=back)
    for a, b, d in edges:
        ins.setdefault(a if back else b, []).append((b if back else a, d))
    at = {}
    for v in nodes:
        at[v] = pick([at[a] + sign * d for a, d in ins.get(v, [])] or [value])
    return at


@pytest.mark.parametrize("tail", [0, 60, 10**6])
def test_folds_do_not_depend_on_the_tail(spark, monkeypatch, tail):
    monkeypatch.setattr(graph, "TAIL", tail)
    rows = network(3, 40, 8) if tail != 10**6 else network(3)
    e = spark.createDataFrame(rows, "src string, dst string, delay long")
    levels = graph.levelize(e)
    want = longest([(a, b, 1) for a, b, _ in rows], 0, max, 1)
    assert {r.node: r.level for r in levels.collect()} == want
    assert {r.node: r.arrival for r in timing.arrival(e, levels).collect()} == longest(rows, 0, max, 1)
    assert {r.node: r.arrival for r in timing.arrival(e, levels, hold=True).collect()} == longest(rows, 0, min, 1)
    ends = timing.endpoints(e).selectExpr("node", "100L as required")
    assert {r.node: r.required for r in timing.required(e, levels, ends).collect()} == longest(rows, 100, min, -1, True)


def test_deep_chain(spark):
    e = spark.createDataFrame([(i, i + 1, 2) for i in range(500)], "src long, dst long, delay long")
    levels = graph.levelize(e)
    assert {r.node: r.level for r in levels.collect()} == {i: i for i in range(501)}
    assert {r.node: r.arrival for r in timing.arrival(e, levels).collect()} == {i: 2 * i for i in range(501)}


def test_cycles_have_no_level(spark):
    e = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 2, 1), (3, 4, 1), (5, 6, 1)], "src long, dst long, delay long")
    assert {r.node: r.level for r in graph.levelize(e).collect()} == {1: 0, 5: 0, 6: 1}
    none = e.limit(0)
    assert graph.levelize(none).count() == 0 and timing.arrival(none, graph.levelize(none)).count() == 0
