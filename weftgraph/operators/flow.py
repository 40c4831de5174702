"""Maximum flow by synchronous push-relabel, with a minimum cut as certificate."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.plans.engine import in_one_task, least_paths, numbered
from weftgraph.plans.fixtures import cte, edges
from weftgraph.plans.graph import Graph
from weftgraph.plans.scratch import materialize

#: The kernel in one task is a Python loop over edges, hence a lower bound than the engine's.
COMPACT_FLOW = 500_000
#: Supersteps between exact relabellings from the sink.
RELABEL = 8


def residual_network(graph: Graph) -> DataFrame:
    """(src, dst, cap): capacities added up for each pair, with the reverse at 0 where missing."""
    both = graph.edges.filter("src <> dst").select("src", "dst", F.col("w").alias("cap"))
    back = both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0).cast("long").alias("cap"))
    return both.unionByName(back).groupBy("src", "dst").agg(F.sum("cap").alias("cap"))


def max_flow(graph: Graph, source: int, sink: int) -> DataFrame:
    """(src, dst, cap, rest): capacities and what is left of them under a maximum (pre)flow; the
    flow's value is what the sink has got, ``flow_value``."""
    own = materialize(residual_network(graph), "flow")
    if own.count() <= COMPACT_FLOW:
        return materialize(_max_flow_compact(own, source, sink), "flow-done")
    state = own.withColumn("rest", F.when(F.col("src") == source, 0).otherwise(F.col("cap")))
    filled = own.filter(F.col("src") == source).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("cap").alias("got"))
    state = materialize(state.join(filled, ["src", "dst"], "left").select("src", "dst", "cap", (F.col("rest") + F.coalesce("got", F.lit(0))).alias("rest")), "flow")
    ids = materialize(own.select(F.col("src").alias("id")).distinct(), "flow-ids")
    step = 0
    while True:
        if step % RELABEL == 0:
            heights = _heights(state, ids, source, sink)
        got = F.sum(F.col("rest") - F.col("cap")).alias("got")
        excess = state.groupBy(F.col("src").alias("id")).agg(got)
        active = materialize(excess.join(heights, "id").filter((F.col("got") > 0) & (F.col("h") < F.lit(1 << 40)) & ~F.col("id").isin(source, sink)), "flow-active")
        if active.isEmpty():
            if step % RELABEL == 0:
                return state
            step = 0
            continue
        # push: an active vertex fills its downhill edges in order until its excess is spent
        down = state.filter("rest > 0").join(active.toDF("src", "got", "h"), "src").join(heights.toDF("dst", "hd"), "dst").filter("h = hd + 1")
        before = Window.partitionBy("src").orderBy("dst").rowsBetween(Window.unboundedPreceding, -1)
        sent = down.withColumn("used", F.coalesce(F.sum("rest").over(before), F.lit(0)))
        sent = sent.select("src", "dst", F.least("rest", F.greatest(F.col("got") - F.col("used"), F.lit(0))).alias("sent")).filter("sent > 0")
        sent = materialize(sent, "flow-sent")
        moved = sent.select("src", "dst", (-F.col("sent")).alias("d")).unionByName(sent.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("sent").alias("d")))
        state = materialize(state.join(moved, ["src", "dst"], "left").select("src", "dst", "cap", (F.col("rest") + F.coalesce("d", F.lit(0))).alias("rest")), "flow")
        # relabel: active vertices without a downhill edge left rise above their lowest neighbour
        low = state.filter("rest > 0").join(active.select(F.col("id").alias("src")), "src", "left_semi").join(heights.toDF("dst", "hd"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("hd").alias("low"))
        heights = materialize(heights.join(low, "id", "left").select("id", F.when(F.col("low") >= F.col("h"), F.col("low") + 1).otherwise(F.col("h")).alias("h")), "flow-heights")
        step += 1


def _heights(state: DataFrame, ids: DataFrame, source: int, sink: int) -> DataFrame:
    """Exact distance to the sink in the residual network; out of reach is beyond any height."""
    back = state.filter("rest > 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).cast("long").alias("w"))
    seeds = ids.filter(F.col("id") == sink).select(F.lit(0).cast("long").alias("source"), "id", F.lit(0).cast("long").alias("dist"))
    far = F.lit(1 << 40).cast("long")
    found = ids.join(least_paths(back, seeds).select("id", "dist"), "id", "left")
    return materialize(found.select("id", F.when(F.col("id") == source, far).otherwise(F.coalesce("dist", far)).alias("h")), "flow-heights")


def flow_value(state: DataFrame, sink: int) -> DataFrame:
    return state.filter(F.col("src") == sink).agg(F.coalesce(F.sum(F.col("rest") - F.col("cap")), F.lit(0)).cast("long").alias("flow"))


def minimum_cut(state: DataFrame, sink: int) -> DataFrame:
    """Certificate: the capacity of the edges into the part that can still reach the sink."""
    back = state.filter("rest > 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0).cast("long").alias("w"))
    seeds = state.sparkSession.createDataFrame([(0, sink, 0)], "source long, id long, dist long")
    side = materialize(least_paths(back, seeds).select("id"), "cut-side")
    into = state.join(side.toDF("dst"), "dst", "left_semi").join(side.toDF("src"), "src", "left_anti")
    return into.agg(F.coalesce(F.sum("cap"), F.lit(0)).cast("long").alias("cut"))


def _max_flow_compact(own: DataFrame, source: int, sink: int) -> DataFrame:
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst"], ignore_index=True)
        ids, a, b = numbered(pdf, np.array([source, sink]))
        n, s, t = len(ids), int(np.searchsorted(ids, source)), int(np.searchsorted(ids, sink))
        start = np.searchsorted(a, np.arange(n + 1)).tolist()
        key = a.astype(np.int64) * n + b
        other = np.searchsorted(key, b.astype(np.int64) * n + a).tolist()
        b, rest = b.tolist(), pdf["cap"].tolist()
        while s != t:
            level, queue = [-1] * n, deque([s])
            level[s] = 0
            while queue:
                u = queue.popleft()
                for e in range(start[u], start[u + 1]):
                    if rest[e] > 0 and level[b[e]] < 0:
                        level[b[e]] = level[u] + 1
                        queue.append(b[e])
            if level[t] < 0:
                break
            place, path = start[:-1].copy(), []
            u = s
            while True:
                if u == t:
                    low = min(rest[e] for e in path)
                    for e in path:
                        rest[e] -= low
                        rest[other[e]] += low
                    k = next(i for i, e in enumerate(path) if not rest[e])
                    u, path = b[other[path[k]]], path[:k]
                    continue
                while place[u] < start[u + 1] and not (rest[place[u]] > 0 and level[b[place[u]]] == level[u] + 1):
                    place[u] += 1
                if place[u] < start[u + 1]:
                    path.append(place[u])
                    u = b[place[u]]
                elif u == s:
                    break
                else:
                    e = path.pop()
                    u = b[other[e]]
                    place[u] += 1
        return pdf.assign(rest=rest)[["src", "dst", "cap", "rest"]]

    return in_one_task(own, kernel, "src long, dst long, cap long, rest long")


def _solved(spark, sf_dir):
    graph = Graph.from_edges(materialize(edges(spark, sf_dir, "user"), "fixture"))
    ends = graph.vertices.agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    return max_flow(graph, ends["a"], ends["b"]), ends["b"]


def _q_flow(spark, sf_dir):
    state, sink = _solved(spark, sf_dir)
    return flow_value(state, sink)


def _q_verify(spark, sf_dir):
    state, sink = _solved(spark, sf_dir)
    return flow_value(state, sink).crossJoin(minimum_cut(state, sink)).select((F.col("cut") - F.col("flow")).alias("gap"))


QUERIES = {"maxflow": _q_flow, "maxflow_verify": _q_verify}
ORACLES = {
    # no flow is larger than what leaves the source or enters the sink; in a graph as dense as the fixture that is reached
    "maxflow": f"""WITH {cte("user", False)}, s AS (SELECT min(id) AS s, max(id) AS t FROM v)
SELECT CAST(least((SELECT sum(w) FROM g, s WHERE src = s), (SELECT sum(w) FROM g, s WHERE dst = t)) AS BIGINT) AS flow""",
    "maxflow_verify": "SELECT CAST(0 AS BIGINT) AS gap",
}
