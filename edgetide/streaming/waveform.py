"""Cycles and delays from a stream of changes: a state machine per run, emitting a cycle when time passes its fall.

The stream must be in time order within a run, as a recorder writes it. State per run: last value and change of every
signal, the open cycle, and the fall that waits for a later tick.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "run_id long, cycle long, signal string, initial int, final int, delay long"


def _machine(clock: str, signals: list[str]):
    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else {"now": {}, "at": {}, "cycle": 0, "rise": None, "first": {}, "fall": None, "done": None}
        rows = []
        for b in batches:
            for t, signal, val in b.sort_values("t")[["t", "signal", "val"]].itertuples(index=False):
                t, val = int(t), int(val)
                if s["fall"] is not None and t > s["fall"]:
                    for name, (initial, final, at) in s["done"].items():
                        rows.append((key[0], s["cycle"], name, initial, final, at - s["rise"] if at is not None and at >= s["rise"] else 0))
                    s |= {"cycle": s["cycle"] + 1, "rise": s["open"], "fall": None, "done": None}
                    s["first"] = s.pop("next_first")
                if signal == clock:
                    before = s["now"].get(clock)
                    if s["rise"] is not None and s["fall"] is None:
                        s["done"] = {n: (s["first"].get(n), s["now"].get(n), s["at"].get(n)) for n in signals}
                        s |= {"fall": t, "open": None, "next_first": {}}
                    elif before == 0 and val == 1:
                        s["rise"], s["first"] = t, {n: s["now"].get(n) for n in signals}
                s["now"][signal], s["at"][signal] = val, t
        state.update((json.dumps(s),))
        yield pd.DataFrame(rows, columns=["run_id", "cycle", "signal", "initial", "final", "delay"]).astype({"initial": "Int32", "final": "Int32"})

    return each


def cycles(changes: DataFrame, clock: str, signals: list[str]) -> DataFrame:
    """Streaming changes (run_id, signal, t, val) to the rows that the batch operator ``measured`` gives, in append mode."""
    return changes.groupBy("run_id").applyInPandasWithState(_machine(clock, signals), OUTPUT, "state string", "append", GroupStateTimeout.NoTimeout)
