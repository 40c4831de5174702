"""The parallel loops as functions of DataFrames: work lists are frontiers, ordered loops take the
lowest bucket each round, independent iterations are projections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.traversal import hub
from weftgraph.plans.fixtures import HUB, cte, edges
from weftgraph.plans.graph import Graph
from weftgraph.plans.scratch import discard, materialize


def for_each(items: DataFrame, body: Callable[[DataFrame], DataFrame], stop: Callable[[DataFrame], bool] | None = None) -> DataFrame:
    """All items ever worked on: each round's items go through ``body``, whose rows are new work;
    rows worked on before are not taken again. ``stop`` may end the loop after a round."""
    done = front = materialize(items.distinct(), "work")
    while not front.isEmpty() and not (stop and stop(front)):
        pushed = body(front).select(*items.columns).distinct()
        front = materialize(pushed.join(done, items.columns, "left_anti"), "work")
        done = materialize(done.unionByName(front), "work-done")
    return done


def do_all(df: DataFrame, **columns: Column) -> DataFrame:
    """Independent iterations that set columns."""
    return df.withColumns(columns)


def on_each(df: DataFrame, body: Callable[[int, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """body(partition, its rows) once a partition."""

    def run(stream):
        from pyspark import TaskContext

        yield from body(TaskContext.get().partitionId(), stream)

    return df.mapInPandas(run, schema)


def for_each_ordered(items: DataFrame, priority: str, body: Callable[[DataFrame], DataFrame], ready: Column | None = None) -> DataFrame:
    """Items in ascending order of a number: each round takes all of the lowest that is open - and,
    for an unstable source, only those that are ``ready`` - and adds what ``body`` pushes. Returns
    the items with ``round``; an item pushed with a number below the round's is an error."""
    open_ = materialize(items.distinct(), "ordered")
    done, turn = None, 0
    while True:
        now = open_.filter(ready) if ready is not None else open_
        low = now.agg(F.min(priority)).first()[0]
        if low is None:
            return done if done is not None else items.withColumn("round", F.lit(0)).limit(0)
        due = materialize(now.filter(F.col(priority) == low), "ordered-due")
        pushed = materialize(body(due).select(*items.columns), "ordered-pushed")
        if not pushed.filter(F.col(priority) < low).isEmpty():
            raise ValueError("work was pushed into the past")
        worked = due.withColumn("round", F.lit(turn))
        done = materialize(worked if done is None else done.unionByName(worked), "ordered-done")
        rest = open_.join(due, items.columns, "left_anti").unionByName(pushed).distinct()
        open_ = materialize(rest.join(done.select(*items.columns), items.columns, "left_anti"), "ordered")
        turn += 1


def for_each_safe(items: DataFrame, priority: str, touches: Callable[[DataFrame], DataFrame], body: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Items (id, priority, ..) in the order (priority, id) as far as it matters: ``touches`` gives the
    nodes (id, node) of items, and a round takes every open item that is the first at all of its nodes,
    whatever its priority. ``body`` may push new items, which must come after all that they touch.
    Returns the items with ``round``."""
    open_, done, turn = materialize(items, "safe"), [], 0
    while not open_.isEmpty():
        near = touches(open_).join(open_.select("id", F.struct(priority, "id").alias("turn")), "id")
        first = near.groupBy("node").agg(F.min("turn").alias("first"))
        late = near.join(first, "node").filter("first < turn").select("id")
        now = materialize(open_.join(late, "id", "left_anti"), "safe-now")
        done.append(now.withColumn("round", F.lit(turn)))
        rest = open_.join(now.select("id"), "id", "left_anti")
        old, open_ = open_, materialize(rest if body is None else rest.unionByName(body(now)), "safe")
        discard(old)
        turn += 1
    out = done[0] if done else items.withColumn("round", F.lit(0)).limit(0)
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def independent_rounds(items: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(id, round): a deterministic schedule in which no two items of a round conflict: in each, the
    open items smaller than all their open conflicting ones are taken."""
    both = materialize(conflicts.union(conflicts.select("dst", "src")).filter("src <> dst").distinct(), "conflicts")
    open_, done, turn = materialize(items.select("id").distinct(), "det"), [], 0
    while not open_.isEmpty():
        live = both.join(open_.toDF("src"), "src", "left_semi").join(open_.toDF("dst"), "dst", "left_semi")
        now = materialize(open_.join(live.filter("dst < src").select(F.col("src").alias("id")), "id", "left_anti"), "det-now")
        done.append(now.withColumn("round", F.lit(turn)))
        open_, turn = materialize(open_.join(now, "id", "left_anti"), "det"), turn + 1
    out = done[0] if done else items.select("id", F.lit(0).alias("round")).limit(0)
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _graph(spark, sf_dir) -> Graph:
    return Graph.from_edges(materialize(edges(spark, sf_dir, "sparse"), "fixture")).symmetrize()


def _hub(graph: Graph) -> DataFrame:
    return graph.vertices.filter(F.col("id") == hub(graph.edges)).select("id")


def _expand(graph: Graph):
    return lambda front: graph.edges.join(front.toDF("src"), "src", "left_semi").select(F.col("dst").alias("id"))


def _q_foreach(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    return for_each(_hub(graph), _expand(graph))


def _q_break(spark, sf_dir):
    graph, rounds = _graph(spark, sf_dir), []
    return for_each(_hub(graph), _expand(graph), lambda front: rounds.append(1) or len(rounds) > 2)


def _q_ordered(spark, sf_dir):
    """Levels of a walk: an item (id, at) pushes its neighbours at the next number, up to 3."""
    graph = _graph(spark, sf_dir)
    first = _hub(graph).withColumn("at", F.lit(0))
    push = lambda due: graph.edges.join(due, graph.edges.src == due.id).filter("at < 3").select(F.col("dst").alias("id"), (F.col("at") + 1).alias("at"))
    return for_each_ordered(first, "at", push).select("id", "at")


def _q_safe(spark, sf_dir):
    """Orders by date; one touches its customer, so its round is its place among the customer's orders."""
    own = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), "o_orderdate", "o_custkey")
    found = for_each_safe(own, "o_orderdate", lambda rows: rows.select("id", F.col("o_custkey").alias("node")))
    return found.select("id", F.col("round").cast("long").alias("turn"))


def _q_oneach(spark, sf_dir):
    def body(part, stream):
        for pdf in stream:
            yield pd.DataFrame({"n": [len(pdf)], "quantity": [int(pdf["l_quantity"].sum())]})

    rows = on_each(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity"), body, "n long, quantity long")
    return rows.agg(F.sum("n").alias("n"), F.sum("quantity").alias("quantity"))


def _q_det(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    rounds = materialize(independent_rounds(graph.vertices, graph.edges.select("src", "dst")), "rounds")
    a, b = rounds.toDF("src", "ra"), rounds.toDF("dst", "rb")
    clash = graph.edges.join(a, "src").join(b, "dst").filter("ra = rb AND src <> dst")
    return rounds.agg(F.count("*").alias("items"), F.count_if(F.col("round") == 0).alias("first")).crossJoin(clash.agg(F.count("*").alias("clashes")))


def _q_doall(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return do_all(own.select("l_orderkey", "l_quantity"), double=(F.col("l_quantity") * 2).cast("long")).select("l_orderkey", "double")


QUERIES = {"l_foreach": _q_foreach, "l_foreach_local": _q_foreach, "l_break": _q_break, "l_push": _q_ordered, "l_ordered": _q_ordered, "l_ordered_u": _q_ordered, "l_ordered_2p": _q_ordered, "l_ordered_lc": _q_safe, "l_doall": _q_doall, "l_oneach": _q_oneach, "l_det": _q_det}
_REACH = f"""WITH RECURSIVE {cte("sparse")}, {HUB}, t(id, d) AS (SELECT id, 0 FROM s UNION SELECT e.dst, t.d + 1 FROM t JOIN e ON e.src = t.id WHERE t.d < {{depth}})"""
_ALL = f"""WITH RECURSIVE {cte("sparse")}, {HUB}, t(id) AS (SELECT id FROM s UNION SELECT e.dst FROM t JOIN e ON e.src = t.id) SELECT DISTINCT id FROM t"""
_WALK = _REACH.format(depth=3) + ' SELECT DISTINCT id, d AS "at" FROM t'
ORACLES = {
    "l_foreach": _ALL,
    "l_foreach_local": _ALL,
    "l_break": _REACH.format(depth=2) + " SELECT DISTINCT id FROM t",
    "l_push": _WALK,
    "l_ordered": _WALK,
    "l_ordered_u": _WALK,
    "l_ordered_2p": _WALK,
    "l_ordered_lc": "SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS turn FROM orders",
    "l_doall": "SELECT l_orderkey, CAST(l_quantity * 2 AS BIGINT) AS double FROM lineitem",
    "l_oneach": "SELECT count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem",
    "l_det": f"""WITH {cte("sparse")} SELECT (SELECT count(*) FROM v) AS items,
  (SELECT count(*) FROM v WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = v.id AND e.dst < v.id)) AS "first", CAST(0 AS BIGINT) AS clashes""",
}
