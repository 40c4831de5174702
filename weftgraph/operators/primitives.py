"""Queries for the graph's access, mutation and rewriting primitives."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.plans.fixtures import BIP, PART, SPARSE, edges
from weftgraph.plans.graph import Graph
from weftgraph.plans.scratch import materialize


def _graph(spark, sf_dir, name) -> Graph:
    return Graph.from_edges(materialize(edges(spark, sf_dir, name), "fixture"))


def _isolated(spark, sf_dir) -> Graph:
    """The sparse graph over all customers and parts, most of them without edges."""
    own = spark.read.parquet(f"{sf_dir}/customer.parquet").select((2 * F.col("c_custkey")).alias("id"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select((2 * F.col("p_partkey") + 1).alias("id"))
    return Graph(own.unionByName(part), materialize(edges(spark, sf_dir, "sparse"), "fixture"))


def _q_data(spark, sf_dir):
    graph = _isolated(spark, sf_dir)
    return graph.with_data("best", graph.edges.groupBy(F.col("src").alias("id")).agg(F.max("w").alias("best"))).vertices


def _q_triplet(spark, sf_dir):
    graph = _graph(spark, sf_dir, "sparse")
    return graph.with_data("tag", F.col("id") % 7).triplets().select("src", "dst", "w", "src_tag", "dst_tag")


def _q_has(spark, sf_dir):
    graph = _graph(spark, sf_dir, "part")
    return graph.has_neighbor(graph.edges.select((F.col("src") + 1).alias("src"), "dst")).distinct()


def _q_contains(spark, sf_dir):
    return _graph(spark, sf_dir, "sparse").contains_node(spark.range(1000))


def _q_add(spark, sf_dir):
    return _graph(spark, sf_dir, "sparse").add_nodes(spark.range(100)).vertices


def _upserts(spark, graph):
    return graph.edges.filter("src % 3 = 0").select("src", (F.col("dst") + F.col("w") % 2 * 2).alias("dst"), F.lit(99).cast("long").alias("w")).distinct()


def _q_addedge(spark, sf_dir):
    graph = _graph(spark, sf_dir, "sparse")
    return graph.add_edges(_upserts(spark, graph)).edges


def _q_addmulti(spark, sf_dir):
    graph = _graph(spark, sf_dir, "sparse")
    return graph.add_edges(_upserts(spark, graph), multi=True).edges


def _q_rmnode(spark, sf_dir):
    graph = _graph(spark, sf_dir, "sparse")
    return graph.remove_nodes(graph.vertices.filter("id % 5 = 1")).edges


def _q_rmedge(spark, sf_dir):
    graph = _graph(spark, sf_dir, "sparse")
    return graph.remove_edges(graph.edges.filter("w > 4")).edges


def _q_dedupe(spark, sf_dir):
    graph = _graph(spark, sf_dir, "part")
    ordered = Graph(graph.vertices, graph.edges.withColumn("ord", F.struct("src", "dst")))
    return ordered.dedupe("ord").edges


def _mapping(graph):
    return graph.vertices.select("id", F.floor(F.col("id") / 10).alias("to"))


def _q_contract(spark, sf_dir):
    graph = _graph(spark, sf_dir, "part")
    return graph.contract(_mapping(graph)).edges


def _q_subgraph(spark, sf_dir):
    graph = _graph(spark, sf_dir, "part")
    return graph.subgraph(graph.vertices.select("id", (F.col("id") % 4).alias("part"))).edges.select("src", "dst", "w", "part")


def _q_torus_inc(spark, sf_dir):
    from weftgraph.sources.generators import torus

    graph = torus(spark, 20)
    return graph.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("value"))


QUERIES = {
    "g_nodes": lambda s, d: _graph(s, d, "sparse").vertices,
    "g_size": lambda s, d: _graph(s, d, "bip").summary(),
    "g_data": _q_data,
    "g_out": lambda s, d: _isolated(s, d).out_edges().select("id", "dst"),
    "g_dst": lambda s, d: _graph(s, d, "bip").edges.select("dst", "w"),
    "g_triplet": _q_triplet,
    "g_has": _q_has,
    "g_contains": _q_contains,
    "g_add": _q_add,
    "g_addedge": _q_addedge,
    "g_addmulti": _q_addmulti,
    "g_rmnode": _q_rmnode,
    "g_rmedge": _q_rmedge,
    "g_sortadj": lambda s, d: _graph(s, d, "bip").sorted_adjacency("w").select("src", "dst", "w", F.col("place").cast("long").alias("place")),
    "g_symm": lambda s, d: _graph(s, d, "part").symmetrize().edges,
    "g_dedupe": _q_dedupe,
    "g_dedupe_min": lambda s, d: _graph(s, d, "part").dedupe().edges,
    "g_residual": lambda s, d: _graph(s, d, "part").residual().edges,
    "g_hasout": lambda s, d: _isolated(s, d).has_out(),
    "g_degree": lambda s, d: _isolated(s, d).degrees(),
    "g_contract": _q_contract,
    "g_subgraph": _q_subgraph,
    "stat_summary": lambda s, d: _graph(s, d, "part").summary(),
    "stat_degrees": lambda s, d: _isolated(s, d).degrees(),
    "torus_inc": _q_torus_inc,
    "hello": lambda s, d: s.range(100).select(F.col("id").alias("i"), F.concat(F.lit("Hello "), F.col("id")).alias("line")),
}

_S, _P, _B = f"g AS ({SPARSE})", f"g AS ({PART})", f"g AS ({BIP})"
_V = "v AS (SELECT src AS id FROM g UNION SELECT dst FROM g)"
_I = "v AS (SELECT 2*c_custkey AS id FROM customer UNION ALL SELECT 2*p_partkey+1 FROM part)"
_U = "u AS (SELECT DISTINCT src, dst + w % 2 * 2 AS dst, CAST(99 AS BIGINT) AS w FROM g WHERE src % 3 = 0)"
_DEGREES = f"WITH {_S}, {_I} SELECT v.id, count(g.src) AS degree FROM v LEFT JOIN g ON g.src = v.id GROUP BY 1"
ORACLES = {
    "g_nodes": f"WITH {_S}, {_V} SELECT id FROM v",
    "g_size": f"WITH {_B}, {_V} SELECT (SELECT count(*) FROM v) AS num_nodes, (SELECT count(*) FROM g) AS num_edges",
    "g_data": f"WITH {_S}, {_I} SELECT v.id, max(g.w) AS best FROM v LEFT JOIN g ON g.src = v.id GROUP BY 1",
    "g_out": f"WITH {_S}, {_I} SELECT v.id, g.dst FROM v JOIN g ON g.src = v.id",
    "g_dst": f"WITH {_B} SELECT dst, w FROM g",
    "g_triplet": f"WITH {_S} SELECT src, dst, w, src % 7 AS src_tag, dst % 7 AS dst_tag FROM g",
    "g_has": f"WITH {_P}, p AS (SELECT DISTINCT src + 1 AS src, dst FROM g) SELECT src, dst FROM p WHERE EXISTS (SELECT 1 FROM g WHERE g.src = p.src AND g.dst = p.dst)",
    "g_contains": f"WITH {_S}, {_V} SELECT id FROM v WHERE id < 1000",
    "g_add": f"WITH {_S}, {_V} SELECT id FROM v UNION SELECT range FROM range(100)",
    "g_addedge": f"WITH {_S}, {_U} SELECT * FROM u UNION ALL SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.src = g.src AND u.dst = g.dst)",
    "g_addmulti": f"WITH {_S}, {_U} SELECT * FROM u UNION ALL SELECT * FROM g",
    "g_rmnode": f"WITH {_S} SELECT * FROM g WHERE src % 5 <> 1 AND dst % 5 <> 1",
    "g_rmedge": f"WITH {_S} SELECT * FROM g WHERE w <= 4",
    "g_sortadj": f"WITH {_B} SELECT *, row_number() OVER (PARTITION BY src ORDER BY w, dst) - 1 AS place FROM g",
    "g_symm": f"WITH {_P} SELECT src, dst, w FROM g UNION ALL SELECT dst, src, w FROM g",
    "g_dedupe": f"WITH {_P} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, arg_min(w, src) AS w FROM g WHERE src <> dst GROUP BY 1, 2",
    "g_dedupe_min": f"WITH {_P} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, min(w) AS w FROM g WHERE src <> dst GROUP BY 1, 2",
    "g_residual": f"WITH {_P} SELECT * FROM g UNION ALL SELECT dst, src, 0 FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.src = g.dst AND h.dst = g.src)",
    "g_hasout": f"WITH {_S}, {_I} SELECT id FROM v WHERE id IN (SELECT src FROM g)",
    "g_degree": _DEGREES,
    "g_contract": f"WITH {_P} SELECT src // 10 AS src, dst // 10 AS dst, CAST(sum(w) AS BIGINT) AS w FROM g WHERE src // 10 <> dst // 10 GROUP BY 1, 2",
    "g_subgraph": f"WITH {_P} SELECT src, dst, w, src % 4 AS part FROM g WHERE src % 4 = dst % 4",
    "stat_summary": f"WITH {_P}, {_V} SELECT (SELECT count(*) FROM v) AS num_nodes, (SELECT count(*) FROM g) AS num_edges",
    "stat_degrees": _DEGREES,
    "torus_inc": "SELECT range AS id, CAST(4 AS BIGINT) AS value FROM range(400)",
    "hello": "SELECT range AS i, 'Hello ' || range AS line FROM range(100)",
}
