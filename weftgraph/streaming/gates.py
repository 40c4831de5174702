"""Logic gates over a stream of timed net events, with a clock for each input.

A gate's state is the last time and value of each of its inputs and the events that wait. Its clock is
the least of its inputs' last times: waiting events up to the clock are safe, are taken in the order of
(time, sender, input), and each evaluation sends the output's value at time + delay. A null value
closes an input: its last time is then unbounded. An event older than its input's last time is an
error. This is the streaming form of ``operators.logic.simulate`` for one layer of gates; layers are
chained by writing one's output where the next one reads.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftgraph.operators.logic import value_of

OUT = "gate long, net string, time long, value string"
STATE = "held string"
NEVER = 1 << 62


def routed(events: DataFrame, gates: DataFrame) -> DataFrame:
    """Each event of (net, time, value, sender) at each gate that reads its net, with the gate's
    definition; ``gates`` is a table of a checked size, joined to the stream as it is."""
    ends = gates.select("gate", "fn", "out", "delay", F.posexplode(F.filter(F.array("in1", "in2"), lambda c: c.isNotNull())).alias("place", "net"))
    return events.join(ends, "net").select("gate", "fn", "out", "delay", "place", "time", "value", "sender")


def _step(gate: dict, rows: list[tuple]) -> list[tuple]:
    """Takes (time, sender, place, value) rows into the gate's state; returns (time, value) sent."""
    for time, sender, place, value in rows:
        last = gate["last"][place]
        if time < last:
            raise ValueError(f"an event of time {time} came after one of {last}")
        gate["last"][place] = NEVER if value is None else time
        if value is not None:
            gate["wait"].append([time, sender, place, value])
    clock, sent = min(gate["last"]), []
    gate["wait"].sort()
    ready = [e for e in gate["wait"] if e[0] <= clock]
    gate["wait"] = gate["wait"][len(ready) :]
    for k, (time, _, place, value) in enumerate(ready):
        gate["value"][place] = value
        if k + 1 == len(ready) or ready[k + 1][0] != time:  # all of one time before the gate fires
            new = value_of(gate["fn"], gate["value"][0], gate["value"][-1] if len(gate["value"]) > 1 else None)
            sent.append((time + gate["delay"], new))
    return sent


def run_gates(routed_events: DataFrame, inputs: int = 2) -> DataFrame:
    """(gate, net, time, value) sent by gates of so many inputs, from ``routed`` events, as a stream."""

    def fire(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gate = json.loads(state.get[0]) if state.exists else None
        rows: list[tuple] = []
        for pdf in batches:
            for fn, out, delay, place, time, value, sender in pdf[["fn", "out", "delay", "place", "time", "value", "sender"]].itertuples(index=False):
                if gate is None:
                    gate = {"fn": fn, "out": out, "delay": max(1, int(delay)), "last": [-1] * inputs, "value": ["X"] * inputs, "wait": []}
                rows.append((int(time), int(sender), int(place), value if isinstance(value, str) else None))
        if gate is None:
            return
        sent = _step(gate, sorted(rows, key=lambda r: r[:3]))
        state.update((json.dumps(gate),))
        if sent:
            yield pd.DataFrame([(key[0], gate["out"], t, v) for t, v in sent], columns=["gate", "net", "time", "value"])

    return routed_events.groupBy("gate").applyInPandasWithState(fire, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def activity(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, event_type, n) over a stream of (ts, event_type): windows of event time, closed by a
    watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
