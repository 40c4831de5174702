"""Breadth-first levels and shortest paths; unreachable vertices have a null distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.engine import Spread, fixpoint, least_paths
from weftgraph.plans.fixtures import GRAPHS, HUB, cte, edges
from weftgraph.plans.graph import Graph, reversed_edges
from weftgraph.plans.scratch import discard, materialize

#: A frontier of a share below this is pushed along its edges, a larger one pulled by the rest.
PULL_SHARE = 1 / 21


def hub(edge_rows: DataFrame) -> int:
    """The vertex with most out-edges, ties to the smallest id."""
    return edge_rows.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").first()["src"]


def sssp(graph: Graph, source: int, weight: str = "w") -> DataFrame:
    """(id, dist) from one source over non-negative weights."""
    spark = graph.edges.sparkSession
    seeds = spark.createDataFrame([(0, source, 0)], "source long, id long, dist long")
    own = graph.edges.select("src", "dst", F.col(weight).alias("w"))
    found = least_paths(own, seeds.join(graph.vertices.select("id"), "id", "left_semi"))
    return graph.vertices.select("id").join(found.drop("source"), "id", "left")


def bfs(graph: Graph, source: int) -> DataFrame:
    """(id, dist) in edges."""
    return sssp(Graph(graph.vertices, graph.edges.select("src", "dst", F.lit(1).cast("long").alias("w"))), source)


def sssp_all(graph: Graph, sources: DataFrame | None = None, weight: str = "w") -> DataFrame:
    """(source, id, dist) of every pair with a path, all sources in one loop."""
    own = graph.edges.select("src", "dst", F.col(weight).alias("w"))
    seeds = (graph.vertices if sources is None else sources).select(F.col("id").alias("source"), "id", F.lit(0).cast("long").alias("dist"))
    return least_paths(own, seeds)


def bfs_direction(graph: Graph, source: int) -> DataFrame:
    """Levels by a frontier that is pushed while its edges are few, and pulled by the unvisited
    vertices once they exceed PULL_SHARE of all; the graph must be symmetric."""
    own = materialize(graph.edges.select("src", "dst"), "edges")
    total, level = own.count(), 0
    state = materialize(graph.vertices.select("id", F.when(F.col("id") == source, F.lit(0).cast("long")).alias("dist")), "levels")
    while True:
        front = state.filter(F.col("dist") == level).select(F.col("id").alias("src"))
        work = own.join(front, "src", "left_semi").count()
        if not work:
            return state
        if work < PULL_SHARE * total:
            new = own.join(front, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        else:
            rest = state.filter("dist IS NULL").select(F.col("id").alias("src"))
            new = own.join(rest, "src", "left_semi").join(front.toDF("dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        level += 1
        old, state = state, materialize(state.join(new.withColumn("new", F.lit(level).cast("long")), "id", "left").select("id", F.coalesce("dist", "new").alias("dist")), "levels")
        discard(old)


def sssp_bellman(graph: Graph, source: int, max_rounds: int | None = None) -> DataFrame:
    """Edge-parallel relaxation of all edges in each round until no distance changes."""
    own = graph.edges.select("src", "dst", "w")
    if (own.agg(F.min("w")).first()[0] or 0) < 0:
        raise ValueError("weights must not be negative")
    routes = Spread(own)

    def step(state: DataFrame) -> DataFrame:
        sent = routes.join(state.filter("dist IS NOT NULL").select(F.col("id").alias("src"), "dist")).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        met = state.drop("active").join(sent, "id", "left")
        better = F.col("new").isNotNull() & (F.col("dist").isNull() | (F.col("new") < F.col("dist")))
        return met.select("id", F.least("dist", "new").alias("dist"), better.alias("active"))

    first = graph.vertices.select("id", F.when(F.col("id") == source, F.lit(0).cast("long")).alias("dist")).withColumn("active", F.col("id") == source)
    return fixpoint(first, step, max_rounds=max_rounds, what="bellman").select("id", "dist")


def sssp_buckets(graph: Graph, source: int, delta: int = 10) -> DataFrame:
    """Distances settled bucket by bucket: only vertices within the lowest open bucket of width
    2 ** delta send; the source given is the one used."""
    routes = Spread(graph.edges.select("src", "dst", "w"))
    state = materialize(graph.vertices.select("id", F.when(F.col("id") == source, F.lit(0).cast("long")).alias("dist")).withColumn("open", F.col("id") == source), "buckets")
    while True:
        low = state.filter("open").agg(F.min("dist")).first()[0]
        if low is None:
            return state.select("id", "dist")
        top = (low >> delta) + 1 << delta
        now = F.col("open") & (F.col("dist") < top)
        sent = routes.join(state.filter(now).select(F.col("id").alias("src"), "dist")).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        met = state.join(sent, "id", "left")
        better = F.coalesce(F.col("new").isNotNull() & (F.col("dist").isNull() | (F.col("new") < F.col("dist"))), F.lit(False))
        old, state = state, materialize(met.select("id", F.least("dist", "new").alias("dist"), (better | (F.col("open") & (F.col("dist") >= top))).alias("open")), "buckets")
        discard(old)


def parents(graph: Graph, dist: DataFrame, weight: str | None = None) -> DataFrame:
    """(id, parent): for each reached vertex the smallest predecessor on a least path."""
    w = F.lit(1) if weight is None else F.col(weight)
    a, b = dist.toDF("src", "da"), dist.toDF("dst", "db")
    tight = graph.edges.join(a, "src").join(b, "dst").filter(F.col("da") + w == F.col("db"))
    return tight.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))


def unsettled(graph: Graph, dist: DataFrame, weight: str | None = None) -> DataFrame:
    """Certificate: the edges that could shorten a distance; none for a right result."""
    w = F.lit(1) if weight is None else F.col(weight)
    a, b = dist.toDF("src", "da"), dist.toDF("dst", "db")
    return graph.edges.join(a, "src").join(b, "dst").filter(F.col("da").isNotNull() & (F.col("db").isNull() | (F.col("db") > F.col("da") + w)))


def hops(graph: Graph, ids: DataFrame, n: int) -> DataFrame:
    """(id) within n out-edges of the ids."""
    found = ids.select("id").distinct()
    for _ in range(n):
        found = found.union(graph.edges.join(found.toDF("src"), "src", "left_semi").select("dst")).distinct()
    return found


def _sparse(spark, sf_dir) -> Graph:
    own = materialize(edges(spark, sf_dir, "sparse"), "fixture")
    return Graph.from_edges(own.unionByName(reversed_edges(own)))


def _from_hub(run):
    def query(spark, sf_dir):
        graph = _sparse(spark, sf_dir)
        return run(graph, hub(graph.edges)).select("id", F.col("dist").cast("long").alias("dist"))

    return query


def _q_all(spark, sf_dir):
    return sssp_all(Graph.from_edges(materialize(edges(spark, sf_dir, "user"), "fixture"))).select("source", "id", "dist")


def _q_directed(spark, sf_dir):
    graph = Graph.from_edges(materialize(edges(spark, sf_dir, "part"), "fixture"))
    return sssp(graph, 0)


def _q_parents(spark, sf_dir):
    graph = _sparse(spark, sf_dir)
    return parents(graph, materialize(bfs(graph, hub(graph.edges)), "levels"))


def _q_unsettled(spark, sf_dir):
    graph = _sparse(spark, sf_dir)
    bad = unsettled(graph, materialize(sssp(graph, hub(graph.edges)), "paths"), "w")
    return bad.agg(F.count("*").alias("violations"))


def _oracle(weight: str, graph: str = "sparse", symmetric: bool = True, start: str = HUB) -> str:
    return f"""WITH RECURSIVE {cte(graph, symmetric)}, {start},
t(id, d) USING KEY (id) AS (SELECT id, CAST(0 AS BIGINT) FROM s UNION
  SELECT x.dst, x.m FROM (SELECT e.dst, min(t.d + {weight}) AS m FROM t JOIN e ON t.id = e.src GROUP BY 1) x
  LEFT JOIN recurring.t r ON r.id = x.dst WHERE r.d IS NULL OR x.m < r.d)
SELECT v.id, CAST(t.d AS BIGINT) AS dist FROM v LEFT JOIN t ON t.id = v.id"""


_BFS, _SSSP = _oracle("1"), _oracle("e.w")

QUERIES = {
    "bfs": _from_hub(bfs),
    "bfs_dir": _from_hub(bfs_direction),
    "sssp": _from_hub(sssp),
    "sssp_dijkstra": _from_hub(sssp),
    "sssp_bellman": _from_hub(sssp_bellman),
    "sssp_chaotic": _from_hub(lambda g, s: sssp_buckets(g, s, 3)),
    "sssp_delta": _from_hub(lambda g, s: sssp_buckets(g, s, 5)),
    "sssp_directed": _q_directed,
    "sssp_all": _q_all,
    "bfs_parents": _q_parents,
    "sssp_verify": _q_unsettled,
}
ORACLES = {
    "bfs": _BFS,
    "bfs_dir": _BFS,
    "sssp": _SSSP,
    "sssp_dijkstra": _SSSP,
    "sssp_bellman": _SSSP,
    "sssp_chaotic": _SSSP,
    "sssp_delta": _SSSP,
    "sssp_directed": _oracle("e.w", "part", False, "s AS (SELECT CAST(0 AS BIGINT) AS id)"),
    "sssp_all": f"""WITH RECURSIVE {cte("user", False)},
t(source, id, d) USING KEY (source, id) AS (SELECT id, id, CAST(0 AS BIGINT) FROM v UNION
  SELECT x.source, x.dst, x.m FROM (SELECT t.source, e.dst, min(t.d + e.w) AS m FROM t JOIN e ON t.id = e.src GROUP BY 1, 2) x
  LEFT JOIN recurring.t r ON r.source = x.source AND r.id = x.dst WHERE r.d IS NULL OR x.m < r.d)
SELECT source, id, CAST(d AS BIGINT) AS dist FROM t""",
    "bfs_parents": f"""WITH d AS ({_BFS}), g AS ({GRAPHS["sparse"]}), e AS (SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g)
SELECT e.dst AS id, min(e.src) AS parent FROM e JOIN d a ON a.id = e.src JOIN d b ON b.id = e.dst WHERE a.dist + 1 = b.dist GROUP BY 1""",
    "sssp_verify": "SELECT CAST(0 AS BIGINT) AS violations",
}
