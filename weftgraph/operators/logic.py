"""Event-driven simulation of logic circuits over 0, 1 and X.

A circuit is gates(gate, fn, out, in1, in2, delay) and stimuli(net, time, value); all nets are X
before time 0 but for stimuli. Events at the least open time are safe together, since every gate
delays by 1 at least: a round takes them all, sets their nets and sends the new outputs of the gates
that read a changed net. An event at the same net and time as another counts in the order of the
sending gate, as the last one to arrive wins."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.engine import in_one_task
from weftgraph.plans.scratch import materialize

FUNCTIONS = ("buf", "inv", "and2", "nand2", "or2", "nor2", "xor2", "xnor2")
COMPACT_GATES = 200_000


def apply_function(fn: Column, a: Column, b: Column) -> Column:
    """Value of a gate over '0', '1' and 'X'."""
    invert = lambda v: F.when(v == "0", "1").when(v == "1", "0").otherwise("X")
    both = F.when((a == "0") | (b == "0"), "0").when((a == "1") & (b == "1"), "1").otherwise("X")
    any_ = F.when((a == "1") | (b == "1"), "1").when((a == "0") & (b == "0"), "0").otherwise("X")
    odd = F.when((a == "X") | (b == "X"), "X").when(a != b, "1").otherwise("0")
    out = F.when(fn == "buf", F.when(a.isin("0", "1"), a).otherwise("X")).when(fn == "inv", invert(a))
    for name, v in (("and2", both), ("or2", any_), ("xor2", odd)):
        negated = {"and2": "nand2", "or2": "nor2", "xor2": "xnor2"}[name]
        out = out.when(fn == name, v).when(fn == negated, invert(v))
    return out


def value_of(fn: str, a: str, b: str | None) -> str:
    if fn in ("buf", "inv"):
        return a if fn == "buf" or a == "X" else "10"[int(a)]
    if fn in ("and2", "nand2"):
        v = "0" if "0" in (a, b) else "1" if a == b == "1" else "X"
    elif fn in ("or2", "nor2"):
        v = "1" if "1" in (a, b) else "0" if a == b == "0" else "X"
    else:
        v = "X" if "X" in (a, b) else str(int(a != b))
    return v if fn in ("and2", "or2", "xor2") or v == "X" else "10"[int(v)]


def simulate(gates: DataFrame, stimuli: DataFrame, until: int | None = None) -> DataFrame:
    """(net, value, time): the last value of every net and when it came (null: it has stayed X)."""
    gates = materialize(gates.select("gate", "fn", "out", "in1", "in2", F.greatest("delay", F.lit(1)).alias("delay")), "gates")
    if gates.count() <= COMPACT_GATES:
        return _simulate_compact(gates, stimuli, until)
    nets = gates.select(F.explode(F.array("out", "in1", "in2")).alias("net")).unionByName(stimuli.select("net")).filter("net IS NOT NULL").distinct()
    state = materialize(nets.select("net", F.lit("X").alias("value"), F.lit(None).cast("long").alias("time")), "nets")
    events = materialize(stimuli.select("net", F.col("time").cast("long").alias("time"), "value", F.lit(-1).cast("long").alias("sender")), "events")
    while True:
        now = events.agg(F.min("time")).first()[0]
        if now is None or until is not None and now > until:
            return state
        due = events.filter(F.col("time") == now).groupBy("net").agg(F.max_by("value", "sender").alias("new"))
        changed = materialize(due.join(state, "net").filter("new <> value").select("net", "new"), "changed")
        state = materialize(state.join(changed, "net", "left").select("net", F.coalesce("new", "value").alias("value"), F.when(F.col("new").isNotNull(), now).otherwise(F.col("time")).alias("time")), "nets")
        touched = gates.join(changed.toDF("in1", "_"), "in1", "left_semi").union(gates.join(changed.toDF("in2", "_"), "in2", "left_semi")).distinct()
        a, b = state.select(F.col("net").alias("in1"), F.col("value").alias("a")), state.select(F.col("net").alias("in2"), F.col("value").alias("b"))
        fired = touched.join(a, "in1").join(b, "in2", "left")
        sent = fired.select(F.col("out").alias("net"), (F.lit(now) + F.col("delay")).cast("long").alias("time"), apply_function(F.col("fn"), F.col("a"), F.col("b")).alias("value"), F.col("gate").alias("sender"))
        events = materialize(events.filter(F.col("time") > now).unionByName(sent), "events")


def _simulate_compact(gates: DataFrame, stimuli: DataFrame, until: int | None) -> DataFrame:
    rows = gates.select("gate", "fn", "out", "in1", "in2", "delay").unionByName(
        stimuli.select(F.lit(None).cast("long").alias("gate"), F.col("value").alias("fn"), F.col("net").alias("out"), F.lit(None).cast("string").alias("in1"), F.lit(None).cast("string").alias("in2"), F.col("time").cast("long").alias("delay"))
    )

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        value, time, readers, heap = {}, {}, {}, []
        for gate, fn, out, in1, in2, delay in pdf.itertuples(index=False):
            if pd.isna(gate):
                heapq.heappush(heap, (int(delay), out, -1, fn))
                value.setdefault(out, "X")
                continue
            g = (int(gate), fn, out, in1, in2 if isinstance(in2, str) else None, int(delay))
            for net in {in1, g[4]} - {None}:
                readers.setdefault(net, []).append(g)
            for net in {out, in1, g[4]} - {None}:
                value.setdefault(net, "X")
        while heap and (until is None or heap[0][0] <= until):
            now, due = heap[0][0], {}
            while heap and heap[0][0] == now:
                _, net, _, new = heapq.heappop(heap)  # ascending senders: the last wins
                due[net] = new
            changed = [net for net, new in due.items() if value[net] != new]
            for net in changed:
                value[net], time[net] = due[net], now
            for g in {g for net in changed for g in readers.get(net, ())}:
                heapq.heappush(heap, (now + g[5], g[2], g[0], value_of(g[1], value[g[3]], None if g[4] is None else value[g[4]])))
        return pd.DataFrame({"net": list(value), "value": list(value.values()), "time": pd.array([time.get(n) for n in value], "Int64")})

    return in_one_task(rows, kernel, "net string, value string, time long")


def adder(spark: SparkSession, bits: int) -> DataFrame:
    """Ripple-carry adder of a<k>, b<k> and carry c0 to s<k> and c<bits>, with two half adders a bit."""
    one = F.col("id").cast("string")
    k = lambda p: F.concat(F.lit(p), one)
    after = F.concat(F.lit("c"), (F.col("id") + 1).cast("string"))
    rows = [("xor2", k("p"), k("a"), k("b"), 2), ("and2", k("g"), k("a"), k("b"), 1), ("xor2", k("s"), k("p"), k("c"), 2), ("and2", k("t"), k("p"), k("c"), 1), ("or2", after, k("g"), k("t"), 1)]
    made = F.array(*(F.struct((F.col("id") * 5 + i).alias("gate"), F.lit(fn).alias("fn"), out.alias("out"), a.alias("in1"), b.alias("in2"), F.lit(d).cast("long").alias("delay")) for i, (fn, out, a, b, d) in enumerate(rows)))
    return spark.range(bits).select(F.explode(made).alias("g")).select("g.*")


def _q_function(spark, sf_dir):
    signs = spark.createDataFrame([("0",), ("1",), ("X",)], "a string")
    fns = spark.createDataFrame([(f,) for f in FUNCTIONS], "fn string")
    return fns.crossJoin(signs).crossJoin(signs.toDF("b")).select("fn", "a", "b", apply_function(F.col("fn"), F.col("a"), F.col("b")).alias("value"))


def _pairs(spark, sf_dir, bits: int) -> DataFrame:
    """Addends: the 25 nations' keys and their customers' number, one circuit for each nation."""
    own = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_nationkey").cast("long").alias("key")).agg(F.count("*").alias("n"))
    return own.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))


def _q_adders(spark, sf_dir, run=simulate):
    bits = 24
    keyed = _pairs(spark, sf_dir, bits)
    name = lambda p: F.concat(F.col("key").cast("string"), F.lit("/"), F.lit(p), F.col("k").cast("string"))
    bit = lambda v: F.substring(F.reverse(F.lpad(F.bin(v), bits, "0")), F.col("k") + 1, F.lit(1))
    pulses = keyed.select(F.explode(F.array(F.struct(name("a").alias("net"), bit(F.col("key")).alias("value")), F.struct(name("b").alias("net"), bit(F.col("n")).alias("value")))).alias("p")).select("p.net", F.lit(0).cast("long").alias("time"), "p.value")
    keys = keyed.select("key").distinct()
    pulses = pulses.unionByName(keys.select(F.concat(F.col("key").cast("string"), F.lit("/c0")).alias("net"), F.lit(0).cast("long").alias("time"), F.lit("0").alias("value")))
    each = adder(spark, bits).crossJoin(F.broadcast(keys))  # 25 nations
    net = lambda c: F.concat(F.col("key").cast("string"), F.lit("/"), F.col(c)).alias(c)
    gates = each.select((F.col("gate") * 1000 + F.col("key")).alias("gate"), "fn", net("out"), net("in1"), net("in2"), "delay")
    done = run(gates, pulses)
    part = F.split("net", "/")
    sums = done.filter(part[1].startswith("s")).select(part[0].cast("long").alias("key"), F.substring(part[1], F.lit(2), F.lit(9)).cast("int").alias("k"), "value")
    return sums.groupBy("key").agg(F.sum(F.call_function("pow", F.lit(2.0), F.col("k")) * F.col("value").cast("int")).cast("long").alias("total"))


def _q_io(spark, sf_dir):
    """Inputs drive stimuli, outputs keep the last value: an inverter of each nation's parity."""
    keys = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"))
    name = lambda p: F.concat(F.lit(p), F.col("k").cast("string"))
    gates = keys.select(F.col("k").alias("gate"), F.lit("inv").alias("fn"), name("o").alias("out"), name("i").alias("in1"), F.lit(None).cast("string").alias("in2"), (F.col("k") + 1).alias("delay"))
    pulses = keys.select(name("i").alias("net"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("time"), F.lit("X").alias("value")), F.struct(F.lit(5).cast("long").alias("time"), (F.col("k") % 2).cast("string").alias("value")))).alias("p")).select("net", "p.time", "p.value")
    return simulate(gates, pulses).filter(F.col("net").startswith("o")).select("net", "value", "time")


_ADD = "SELECT CAST(c_nationkey AS BIGINT) AS key, CAST(c_nationkey + count(*) AS BIGINT) AS total FROM customer GROUP BY 1, c_nationkey"
_X = "(VALUES ('0'), ('1'), ('X'))"
QUERIES = {"logic_fn": _q_function, "des_ordered": _q_adders, "des_unordered": _q_adders, "des_ordered_par": _q_adders, "des_io": _q_io}
ORACLES = {
    "logic_fn": f"""SELECT fn, a, b, CASE fn WHEN 'buf' THEN a WHEN 'inv' THEN translate(a, '01', '10')
  WHEN 'and2' THEN x WHEN 'nand2' THEN translate(x, '01', '10') WHEN 'or2' THEN y WHEN 'nor2' THEN translate(y, '01', '10')
  WHEN 'xor2' THEN z ELSE translate(z, '01', '10') END AS value
FROM (SELECT fn, a, b, least(a, b) AS l, CASE WHEN a = '0' OR b = '0' THEN '0' WHEN a = '1' AND b = '1' THEN '1' ELSE 'X' END AS x,
  CASE WHEN a = '1' OR b = '1' THEN '1' WHEN a = '0' AND b = '0' THEN '0' ELSE 'X' END AS y,
  CASE WHEN a = 'X' OR b = 'X' THEN 'X' WHEN a = b THEN '0' ELSE '1' END AS z
  FROM (VALUES {", ".join(f"('{f}')" for f in FUNCTIONS)}) f(fn), {_X} p(a), {_X} q(b))""",
    "des_ordered": _ADD,
    "des_unordered": _ADD,
    "des_ordered_par": _ADD,
    "des_io": "SELECT 'o' || n_nationkey AS net, CAST(1 - n_nationkey % 2 AS VARCHAR) AS value, CAST(6 + n_nationkey AS BIGINT) AS time FROM nation",
}
