"""Connected components by contraction.

Each round draws an order of the vertices anew, by a hash of the id and the round. Every vertex of
the remaining graph points at the first of its closed neighbourhood, edges are rewritten to those
pointers, and loops and doubles go. At most three quarters of the vertices are expected to be left
(a half on a path), however they are numbered, so the rounds are as many as the logarithm of the
vertices; the pointers of all rounds, followed backwards, give each vertex its component, named by
its smallest vertex at last. Every table a join reads is a written one, so both sides of the
join are plain exchanges and adaptive execution may split a hub's rows over several tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.plans.engine import in_one_task, is_compact, least_paths, numbered
from weftgraph.plans.fixtures import GRAPHS, cte, edges
from weftgraph.plans.graph import Graph
from weftgraph.plans.scratch import discard, materialize


def component_labels(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex with an edge to another one; ``edges`` has src and dst, in
    either direction, nulls and loops being ignored; component is the smallest id reachable.
    Vertices without such edges are absent: left-join and coalesce."""
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    rest = materialize(pairs.filter("a < b").distinct(), "cc-edges")
    rounds: list[DataFrame] = []
    while not rest.isEmpty():
        drawn = lambda c, r=len(rounds): F.xxhash64(F.lit(r), c)
        ends = rest.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("n")), F.struct(F.col("b").alias("id"), F.col("a").alias("n")))).alias("e"))
        least = ends.groupBy("e.id").agg(F.min(F.struct(drawn(F.col("e.n")).alias("h"), F.col("e.n").alias("n"))).alias("m"))
        pointer = materialize(least.select("id", F.least(F.struct(drawn(F.col("id")).alias("h"), F.col("id").alias("n")), F.col("m"))["n"].alias("p")), "cc-pointers")
        rounds.append(pointer)
        left = rest.join(pointer.select(F.col("id").alias("a"), F.col("p").alias("pa")), "a").select("pa", "b")
        half = materialize(left.distinct(), "cc-half")
        both = half.join(pointer.select(F.col("id").alias("b"), F.col("p").alias("pb")), "b")
        old, rest = rest, materialize(both.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).filter("a < b").distinct(), "cc-edges")
        discard(old, half)
    if not rounds:
        return rest.select(F.col("a").alias("id"), F.col("b").alias("component"))
    labels = materialize(rounds[-1].select("id", F.col("p").alias("component")), "cc-labels")
    for pointer in reversed(rounds[:-1]):
        upper = labels.select(F.col("id").alias("p"), "component")
        old, labels = labels, materialize(pointer.join(upper, "p", "left").select("id", F.coalesce("component", "p").alias("component")), "cc-labels")
        discard(old)
    discard(*rounds)
    # whichever vertex was drawn last stands for the component until here
    smallest = materialize(labels.groupBy("component").agg(F.min("id").alias("least")), "cc-least")
    return labels.join(smallest, "component").select("id", F.col("least").alias("component"))


def _labels_compact(edges: DataFrame) -> DataFrame:
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna()
        pdf = pdf[pdf["src"] != pdf["dst"]]
        ids, a, b = numbered(pdf)
        label = np.arange(len(ids))
        while True:
            x, y = label[a], label[b]
            low = np.minimum(x, y)
            before = label.copy()
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            while not np.array_equal(up := label[label], label):
                label = up
            if np.array_equal(before, label):
                return pd.DataFrame({"id": ids, "component": ids[label] if len(ids) else ids})

    return in_one_task(edges.select("src", "dst"), kernel, "id long, component long")


def connected_components(graph: Graph) -> DataFrame:
    """(id, component) of every vertex, edges taken both ways; a lone vertex is its own component."""
    own = materialize(graph.edges.select("src", "dst"), "edges")
    labels = _labels_compact(own) if is_compact(own) else component_labels(own)
    return graph.vertices.select("id").join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def largest_component(labels: DataFrame) -> DataFrame:
    """Numbers of components, of those of two vertices at least, the largest's size and share of the
    vertices in such components, and its label (ties to the smallest)."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    wide = F.when(F.col("n") > 1, F.col("n"))
    best = F.max(F.struct("n", (-F.col("component")).alias("c")))
    out = sizes.agg(F.count("*").alias("num_components"), F.count(wide).alias("num_nontrivial"), best.alias("b"), F.sum(wide).alias("within"))
    return out.select("num_components", "num_nontrivial", F.col("b.n").alias("largest"), (-F.col("b.c")).alias("label"), F.when(F.col("b.n") > 1, F.col("b.n") / F.col("within")).alias("share"))


def label_propagation(graph: Graph) -> DataFrame:
    """(id, component): the smallest id that reaches the vertex along the edges' direction."""
    seeds = graph.vertices.select(F.lit(0).cast("long").alias("source"), "id", F.col("id").alias("dist"))
    own = graph.edges.select("src", "dst", F.lit(0).cast("long").alias("w"))
    return least_paths(own, seeds).select("id", F.col("dist").alias("component"))


def keep_component(graph: Graph, labels: DataFrame, label: int) -> Graph:
    """The component as a graph of its own, ids renumbered from 0 in their order."""
    own = labels.filter(F.col("component") == label).select("id")
    to = materialize(dense_ids(own, "id"), "renumbered")
    a, b = to.toDF("src", "a"), to.toDF("dst", "b")
    inner = graph.edges.join(a, "src").join(b, "dst")
    rest = [c for c in graph.edges.columns if c not in ("src", "dst")]
    return Graph(to.select(F.col("place").alias("id")), inner.select(F.col("a").alias("src"), F.col("b").alias("dst"), *rest), graph.directed)


def dense_ids(rows: DataFrame, key: str) -> DataFrame:
    """(key, place) with places 0, 1, .. in the key's order; no task holds more than its range."""
    spread = materialize(rows.select(key).repartitionByRange(key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = spread.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row a partition
    within = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return spread.withColumn("_nth", within).join(base, "_part").select(key, (F.col("base") + F.col("_nth")).alias("place"))


def _fixture(spark, sf_dir, name="sparse") -> Graph:
    return Graph.from_edges(materialize(edges(spark, sf_dir, name), "fixture"))


def _q_cc(spark, sf_dir):
    return connected_components(_fixture(spark, sf_dir))


def _q_contraction(spark, sf_dir):
    return component_labels(edges(spark, sf_dir, "sparse"))


def _q_largest(spark, sf_dir):
    return largest_component(_q_cc(spark, sf_dir)).select("num_components", "num_nontrivial", "largest", "label", F.round("share", 9).alias("share"))


def _q_labelprop(spark, sf_dir):
    return label_propagation(_fixture(spark, sf_dir))


def _q_component(spark, sf_dir):
    graph = _fixture(spark, sf_dir)
    labels = materialize(connected_components(graph), "labels")
    best = largest_component(labels).first()["label"]
    return keep_component(graph, labels, best).edges


_LABELS = """WITH RECURSIVE {0},
t(id, c) USING KEY (id) AS (SELECT id, id FROM v UNION
  SELECT x.dst, x.m FROM (SELECT e.dst, min(t.c) AS m FROM t JOIN e ON t.id = e.src GROUP BY 1) x
  JOIN recurring.t r ON r.id = x.dst WHERE x.m < r.c)"""
_CC = _LABELS.format(cte("sparse")) + " SELECT id, c AS component FROM t"
QUERIES = {"cc": _q_cc, "cc_contraction": _q_contraction, "cc_largest": _q_largest, "cc_labelprop": _q_labelprop, "snk_component": _q_component}
ORACLES = {
    "cc": _CC,
    "cc_contraction": _CC,
    "cc_largest": f"""WITH l AS ({_CC}), z AS (SELECT component, count(*) AS n FROM l GROUP BY 1)
SELECT count(*) AS num_components, count(*) FILTER (n > 1) AS num_nontrivial, max(n) AS largest,
  (SELECT component FROM z ORDER BY n DESC, component LIMIT 1) AS label,
  round(max(n) / sum(n) FILTER (n > 1), 9) AS share FROM z""",
    "cc_labelprop": _LABELS.format(cte("sparse", False)) + " SELECT id, c AS component FROM t",
    "snk_component": f"""WITH l AS ({_CC}), g AS ({GRAPHS["sparse"]}),
b AS (SELECT component FROM l GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM l WHERE component = (SELECT component FROM b))
SELECT a.place AS src, c.place AS dst, g.w FROM g JOIN n a ON a.id = g.src JOIN n c ON c.id = g.dst""",
}
