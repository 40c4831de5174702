"""Queries that write a fixture in a format and read it back, or check what a generator makes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.ranks import ORACLES as RANKS
from weftgraph.operators.ranks import betweenness
from weftgraph.operators.traversal import bfs
from weftgraph.plans.fixtures import HUB, SPARSE, USER, cte, edges, sql
from weftgraph.plans.graph import Graph
from weftgraph.plans.scratch import materialize, scratch_path
from weftgraph.sources import generators as gen
from weftgraph.sources import gr, text


def _edges(spark, sf_dir, name="sparse") -> DataFrame:
    return materialize(edges(spark, sf_dir, name), "fixture")


def _dense(spark, sf_dir, name="sparse") -> Graph:
    return Graph.dense(_edges(spark, sf_dir, name))


def _round_trip(write, read, *columns: str):
    def query(spark, sf_dir):
        path = scratch_path(spark, "format")
        write(_dense(spark, sf_dir), path)
        return read(spark, path).edges.select(*columns)

    return query


def _q_gr_mem(spark, sf_dir):
    path = scratch_path(spark, "gr")
    gr.write_gr(_dense(spark, sf_dir), path)
    return gr.read_gr_column(spark.read.format("binaryFile").load(path)).select("src", "dst", "w")


def _q_gr_arrays(spark, sf_dir):
    rows = sql(spark, sf_dir, "SELECT n_nationkey, n_regionkey FROM nation").orderBy("n_nationkey").collect()  # 25 nations
    return gr.from_arrays(spark, list(range(1, len(rows) + 1)), [r[1] for r in rows], [r[0] * 10 for r in rows]).edges


def _q_nodedata(spark, sf_dir):
    graph = _dense(spark, sf_dir).with_data("zero", F.lit(0.0))
    return graph.with_data("best", graph.edges.groupBy(F.col("dst").alias("id")).agg(F.min("w").alias("best"))).vertices


def _q_metis(spark, sf_dir):
    path = scratch_path(spark, "metis")
    text.write_adjacency_lines(_dense(spark, sf_dir).symmetrize(), path, 1)
    return text.read_metis(spark, path).edges


def _q_symm(spark, sf_dir):
    path = scratch_path(spark, "gr")
    gr.write_gr(_dense(spark, sf_dir, "part"), path)
    return text.symmetric_without_loops(gr.read_gr(spark, path)).edges


def _q_wpbbs(spark, sf_dir):
    path = scratch_path(spark, "wpbbs")
    text.write_weighted_pbbs(_edges(spark, sf_dir), path, 1000)
    return text.read_weighted_pbbs(spark, path).edges


def _q_wrmat(spark, sf_dir):
    path = scratch_path(spark, "wrmat")
    text.write_counted_edges(_dense(spark, sf_dir, "part"), path)
    return text.read_weighted_rmat(spark, path).edges


def _q_pta(spark, sf_dir):
    from weftgraph.operators.pointsto import _FIXTURE

    path = scratch_path(spark, "pta")
    text.write_constraints(sql(spark, sf_dir, _FIXTURE), path, 1000)
    return text.read_constraints(spark, path)


def _points(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), *(F.round(F.col("embedding")[k].cast("double"), 6).alias(c) for k, c in enumerate("xy")))


def _mesh(spark, sf_dir) -> dict:
    """A strip of triangles over the vectors in id order."""
    node = _points(spark, sf_dir)
    ids = spark.range(1, node.count() - 1)
    ele = ids.select("id", (F.col("id") - 1).alias("p1"), F.col("id").alias("p2"), (F.col("id") + 1).alias("p3"))
    return {"node": node, "ele": ele, "poly": ids.select("id", (F.col("id") - 1).alias("p1"), F.col("id").alias("p2"))}


def _q_triangle(spark, sf_dir):
    stem = scratch_path(spark, "mesh") + "/mesh"
    text.write_mesh(_mesh(spark, sf_dir), stem)
    back = text.read_mesh(spark, stem)
    ele = back["ele"].select("id", F.array_join(F.sort_array(F.array("p1", "p2", "p3")), ",").alias("corners"))
    return ele.join(back["node"], "id").join(back["poly"].withColumnRenamed("p1", "q1"), "id").select("id", "corners", "x", "y", "q1")


def _q_mesh_order(spark, sf_dir):
    stem = scratch_path(spark, "mesh") + "/mesh"
    text.write_mesh(_mesh(spark, sf_dir), stem)
    back = text.read_mesh(spark, stem)
    at = lambda k: back["node"].select(F.col("id").alias(f"p{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    turned = back["ele"].join(at(1), "p1").join(at(2), "p2").join(at(3), "p3").filter("(x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1) < 0")
    return turned.agg(F.count("*").alias("clockwise"))


def _q_femap(spark, sf_dir):
    from weftgraph.sources.femap import read_femap, write_femap

    path, mesh = scratch_path(spark, "femap"), _mesh(spark, sf_dir)
    node = mesh["node"].withColumns({"id": F.col("id") + 1, "z": F.lit(0.0)})  # 0 is no node there
    write_femap(node, mesh["ele"].select("id", *(F.col(c) + 1 for c in ("p1", "p2", "p3"))).toDF("id", "p1", "p2", "p3"), path)
    back = read_femap(spark, path)
    ele = back["elements"].select("id", F.array_join("nodes", ",").alias("corners"))
    return ele.join(back["nodes"], "id").select("id", "corners", "x", "y")


def _q_points(spark, sf_dir):
    path = scratch_path(spark, "points")
    own = _points(spark, sf_dir)
    text.write_lines(own.select("id", F.concat_ws(" ", "id", "x", "y").alias("value")), path, "id", header=[f"{own.count()} 2 0 0"])
    return text.read_points(spark, path).filter("id >= 0")


def _samples(spark, sf_dir) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("row"), F.col("label").cast("double").alias("target"), F.posexplode("embedding").alias("feature", "v"))
    return own.select("row", "target", (F.col("feature") + 1).alias("feature"), F.round(F.col("v").cast("double"), 6).alias("value"))


def _q_libsvm(spark, sf_dir):
    path = scratch_path(spark, "libsvm")
    text.write_libsvm(_samples(spark, sf_dir), path)
    stats = text.feature_stats(text.read_libsvm(spark, path))
    return stats.select("feature", F.round("mean", 6).alias("mean"), "low", "high")


def _q_dense(spark, sf_dir):
    path = scratch_path(spark, "dense")
    own = _samples(spark, sf_dir).groupBy("row", "target").agg(F.sort_array(F.collect_list(F.struct("feature", "value"))).alias("f")).select("row", F.col("f.value").alias("features"), "target")
    text.write_dense(own, path)
    return text.read_dense(spark, path).select("row", F.element_at("features", 1).alias("first"), F.element_at("features", -1).alias("last"), "target")


def _lines(write):
    def query(spark, sf_dir):
        path = scratch_path(spark, "lines")
        write(_dense(spark, sf_dir), path)
        return text.numbered_lines(spark, path)

    return query


def _stored(spark, sf_dir) -> Graph:
    path = scratch_path(spark, "stored")
    gr.write_gr(_dense(spark, sf_dir), path)
    return gr.read_gr(spark, path)


def _q_matrix(spark, sf_dir):
    path = scratch_path(spark, "matrix")
    gr.write_matrix(_dense(spark, sf_dir), path)
    return gr.read_matrix(spark, path)


def _q_circuit(spark, sf_dir):
    """The parts of a netlist file, as they are read."""
    from weftgraph.sources.netlist import parse_netlist, write_netlist

    path = scratch_path(spark, "netlist")
    write_netlist(spark, path, 16, 12345, 54321)
    found = parse_netlist(spark, path)
    gates = found["gates"].select(F.lit("gate").alias("part"), "out", "fn", F.concat_ws(",", "in1", "in2").alias("ins"), "delay")
    pulses = found["stimuli"].select(F.lit("pulse").alias("part"), F.col("net").alias("out"), "value", F.lit(None).cast("string"), "time")
    wanted = found["expected"].select(F.lit("want").alias("part"), F.col("net").alias("out"), "value", F.lit(None).cast("string"), F.lit(None).cast("long"))
    return gates.union(pulses).union(wanted)


def _q_sorted(spark, sf_dir):
    path = scratch_path(spark, "sorted")
    graph = _dense(spark, sf_dir, "user").with_data("rank", -F.col("id"))
    gr.write_sorted_graph(graph, "rank", path)
    return gr.read_gr(spark, path).edges


def _q_dist(spark, sf_dir):
    own = _edges(spark, sf_dir)
    graph = Graph.from_edges(own).symmetrize()
    from weftgraph.operators.traversal import hub

    path = scratch_path(spark, "dist")
    found = bfs(graph, hub(graph.edges))
    text.write_lines(found.select("id", F.coalesce(F.col("dist").cast("string"), F.lit("inf")).alias("value")), path, "id")
    return text.numbered_lines(spark, path)


def _q_bc(spark, sf_dir):
    path = scratch_path(spark, "bc")
    found = betweenness(Graph.from_edges(_edges(spark, sf_dir, "user")))
    text.write_lines(found.select("id", F.format_string("%d: %.4f", "id", "bc").alias("value")), path, "id")
    return spark.read.text(path).select(F.split("value", ": ")[0].cast("long").alias("id"), F.round(F.split("value", ": ")[1].cast("double"), 2).alias("bc"))


def _q_stats(spark, sf_dir):
    """Counters of a run as rows: STAT, LOOP, CATEGORY, n, sum and one value for each partition key."""
    own = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type", (F.col("user_id") % 4).alias("t")).agg(F.count("*").alias("n"))
    wide = own.groupBy("event_type").pivot("t", [0, 1, 2, 3]).agg(F.sum("n"))
    path = scratch_path(spark, "stats")
    total = F.col("0") + F.col("1") + F.col("2") + F.col("3")
    lines = wide.fillna(0).select("event_type", F.concat_ws(",", F.lit("STAT"), F.lit("events"), "event_type", F.lit(4), total, "0", "1", "2", "3").alias("value"))
    text.write_lines(lines, path, "event_type", header=["STATTYPE,LOOP,CATEGORY,n,sum,T0,T1,T2,T3"])
    return spark.read.csv(path, schema="STATTYPE string, LOOP string, CATEGORY string, n long, sum long, T0 long, T1 long, T2 long, T3 long").filter("STATTYPE <> 'STATTYPE'")


def _q_pfp(spark, sf_dir):
    return materialize(Graph.from_edges(_edges(spark, sf_dir, "user")).residual().edges, "residual")


def _checked(graph: Graph, n: int) -> DataFrame:
    """Counts that must be zero in a simple connected graph over 0 .. n - 1."""
    own = materialize(graph.edges, "generated")
    bad = own.agg(F.count_if(F.col("src") == F.col("dst")).alias("loops"), (F.count("*") - F.count_distinct("src", "dst")).alias("doubles"), F.count_if((F.col("src") < 0) | (F.col("dst") < 0) | (F.col("src") >= n) | (F.col("dst") >= n)).alias("outside"))
    ring = graph.vertices.select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst")).join(own, ["src", "dst"], "left_anti")
    return bad.crossJoin(ring.agg(F.count("*").alias("ring_missing")))


def _q_plummer(spark, sf_dir):
    own = materialize(gen.plummer(spark, 2000), "plummer")
    energy = own.agg(F.sum(F.col("mass")).alias("m"), F.avg(F.sqrt(F.expr("x*x+y*y+z*z"))).alias("r"), F.max(F.expr("vx*vx+vy*vy+vz*vz")).alias("v"), F.count("*").alias("n"))
    return energy.select("n", F.round("m", 6).alias("mass"), ((F.col("r") > 0.2) & (F.col("r") < 3) & (F.col("v") < 4)).alias("plausible"))


def _q_ksat(spark, sf_dir):
    own = gen.ksat(spark, 1000, 300, 3)
    each = own.groupBy("clause").agg(F.count("*").alias("n"), F.count_distinct("var").alias("d"), F.min("var").alias("low"), F.max("var").alias("high"))
    return each.agg(F.count("*").alias("clauses"), F.count_if((F.col("n") != 3) | (F.col("d") != 3) | (F.col("low") < 0) | (F.col("high") >= 300)).alias("bad"))


def _q_bipart(spark, sf_dir):
    own = gen.bipartite(spark, 400, 300, 3, 4)
    return own.edges.agg(F.count_if((F.col("src") % 2 != 0) | (F.col("dst") % 2 != 1) | (F.col("dst") >= 600)).alias("bad"), F.count_distinct("src").alias("left"))


def _q_box(make):
    def query(spark, sf_dir):
        own = make(spark)
        inside = F.lit(True)
        for c in own.columns:
            if c in "xyz":
                inside = inside & (F.col(c) >= 0) & (F.col(c) < 1)
        return own.agg(F.count("*").alias("n"), F.count_if(~inside).alias("outside"), F.round(F.avg("x"), 1).alias("middle"))

    return query


def _q_netlist(spark, sf_dir):
    from weftgraph.sources.netlist import parse_netlist, write_netlist

    path = scratch_path(spark, "netlist")
    write_netlist(spark, path, 16, 12345, 54321)
    circuit = parse_netlist(spark, path)
    from weftgraph.operators.logic import simulate

    done = simulate(circuit["gates"], circuit["stimuli"])
    return done.join(circuit["expected"].withColumnRenamed("value", "want"), "net").agg(F.count("*").alias("outputs"), F.count_if(F.col("value") != F.col("want")).alias("wrong"))


QUERIES = {
    "src_gr": _round_trip(gr.write_gr, gr.read_gr, "src", "dst", "w"),
    "snk_gr": _round_trip(lambda g, p: gr.write_gr(g, p, 8), gr.read_gr, "src", "dst", "w"),
    "src_gr_mem": _q_gr_mem,
    "src_gr_arrays": _q_gr_arrays,
    "src_parser": lambda s, d: text.begin_offsets(_dense(s, d)),
    "src_lc": lambda s, d: _stored(s, d).edges.repartition("src").groupBy("src").agg(F.count("*").alias("n"), F.sum("dst").alias("total")),
    "src_nodedata": _q_nodedata,
    "src_edgelist": _round_trip(lambda g, p: text.write_edge_list(g.edges, p), text.read_edge_list, "src", "dst", "w"),
    "src_dimacs": _round_trip(text.write_dimacs, text.read_dimacs, "src", "dst", "w"),
    "src_rmat": _round_trip(text.write_rmat, text.read_rmat, "src", "dst", "w"),
    "src_stext": _round_trip(text.write_adjacency_lines, text.read_stext, "src", "dst"),
    "src_pbbs": _round_trip(text.write_pbbs, text.read_pbbs, "src", "dst"),
    "src_wpbbs": _q_wpbbs,
    "src_wrmat": _q_wrmat,
    "src_metis": _q_metis,
    "src_symm_gr": _q_symm,
    "src_pr_el": _round_trip(lambda g, p: text.write_sorted_edges(g.edges, p), text.read_ranked_edges, "src", "dst"),
    "src_sssp_txt": _round_trip(text.write_counted_edges, text.read_counted_edges, "src", "dst", "w"),
    "src_pta": _q_pta,
    "src_netlist": _q_circuit,
    "src_triangle": _q_triangle,
    "src_femap": _q_femap,
    "src_points": _q_points,
    "src_libsvm": _q_libsvm,
    "src_dense": _q_dense,
    "gen_torus": lambda s, d: gen.torus(s, 16).edges,
    "gen_rand": lambda s, d: _checked(gen.random_graph(s, 1000), 1000),
    "gen_grid": lambda s, d: gen.grid(s, 16).edges,
    "gen_grid_curve": lambda s, d: gen.grid(s, 16, curve=True).edges.agg(F.count("*").alias("edges"), F.count_if(F.abs(F.col("src") - F.col("dst")) == 1).alias("steps"), F.count_distinct("src").alias("nodes")),
    "gen_points": _q_box(lambda s: gen.points(s, 5000)),
    "gen_lights": _q_box(lambda s: gen.lights(s, 5000)),
    "gen_bipart": _q_bipart,
    "gen_ksat": _q_ksat,
    "gen_plummer": _q_plummer,
    "gen_netlist": _q_netlist,
    "snk_graph": _q_sorted,
    "snk_textedge": _lines(lambda g, p: text.write_lines(g.edges.select("src", "dst", F.col("w").cast("string").alias("value")), p, "src", "dst")),
    "snk_dimacs": _lines(text.write_dimacs),
    "snk_pbbs": _lines(text.write_pbbs),
    "snk_wpbbs": _lines(lambda g, p: text.write_weighted_pbbs(g.edges, p)),
    "snk_wpbbs_k": _lines(lambda g, p: text.write_weighted_pbbs(g.edges, p, 4)),
    "snk_bsml": _q_matrix,
    "snk_mesh": _q_mesh_order,
    "snk_meshbin": lambda s, d: materialize(_mesh(s, d)["ele"], "mesh"),
    "snk_pfp": _q_pfp,
    "snk_bc": _q_bc,
    "snk_dist": _q_dist,
    "snk_stats": _q_stats,
}

_S = f"g AS ({SPARSE})"
_EDGES = f"WITH {_S} SELECT src, dst, w FROM g"
_N = "n AS (SELECT max(greatest(src, dst)) + 1 AS n FROM g)"
_BODY = "body AS (SELECT src, dst, w, row_number() OVER (ORDER BY src, dst) AS k FROM g)"
_ALL = "v AS (SELECT unnest(range(n)) AS id FROM n)"
_P = "p AS (SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS y FROM embeddings)"
_BFS = f"""WITH RECURSIVE {cte("sparse")}, {HUB},
t(id, d) USING KEY (id) AS (SELECT id, CAST(0 AS BIGINT) FROM s UNION
  SELECT x.dst, x.m FROM (SELECT e.dst, min(t.d + 1) AS m FROM t JOIN e ON t.id = e.src GROUP BY 1) x
  LEFT JOIN recurring.t r ON r.id = x.dst WHERE r.d IS NULL OR x.m < r.d)"""
_TORUS = "(VALUES (1, 0), ({n} - 1, 0), (0, 1), (0, {n} - 1)) d(a, b)"
ORACLES = {
    **dict.fromkeys(("src_gr", "snk_gr", "src_gr_mem", "src_edgelist", "src_dimacs", "src_rmat", "src_sssp_txt"), _EDGES),
    "src_gr_arrays": "SELECT CAST(n_nationkey AS BIGINT) AS src, CAST(n_regionkey AS BIGINT) AS dst, CAST(n_nationkey * 10 AS BIGINT) AS w FROM nation",
    "src_parser": f"""WITH {_S}, {_N}, {_ALL}, c AS (SELECT id, count(src) AS d FROM v LEFT JOIN g ON src = id GROUP BY 1)
SELECT id, CAST(sum(d) OVER (ORDER BY id) - d AS BIGINT) AS "from" FROM c""",
    "src_lc": f"WITH {_S} SELECT src, count(*) AS n, CAST(sum(dst) AS BIGINT) AS total FROM g GROUP BY 1",
    "src_nodedata": f"WITH {_S}, {_N}, {_ALL} SELECT id, CAST(0 AS DOUBLE) AS zero, min(w) AS best FROM v LEFT JOIN g ON dst = id GROUP BY 1",
    **dict.fromkeys(("src_stext", "src_pbbs", "src_pr_el"), f"WITH {_S} SELECT src, dst FROM g"),
    "src_wpbbs": f"WITH {_S} SELECT src, dst, w * 1000 AS w FROM g",
    "src_wrmat": f"WITH {cte('part')} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, min(w) AS w FROM g GROUP BY 1, 2",
    "src_metis": f"WITH {cte('sparse')} SELECT src, dst, CAST(1 AS BIGINT) AS w FROM e",
    "src_symm_gr": f"WITH {cte('part')} SELECT src, dst, max(w) AS w FROM e WHERE src <> dst GROUP BY 1, 2",
    "src_pta": "SELECT CAST(s_nationkey AS BIGINT) AS src, 100 + s_suppkey AS dst, CAST(0 AS BIGINT) AS type FROM supplier UNION SELECT 50 + n_regionkey, n_nationkey, 1 FROM nation UNION SELECT 60 + r_regionkey, 50 + r_regionkey, 2 FROM region UNION SELECT n_nationkey, 50 + (n_regionkey + 1) % 5, 3 FROM nation",
    "src_netlist": """WITH b AS (SELECT unnest(range(16)) AS k), p AS (SELECT * FROM (VALUES ('a', 12345), ('b', 54321)) p(p, x))
SELECT 'gate' AS part, o || CASE o WHEN 'c' THEN k + 1 ELSE k END AS out, fn, i || k || ',' || j || k AS ins, CAST(d AS BIGINT) AS delay
FROM b, (VALUES ('p', 'xor2', 'a', 'b', 2), ('g', 'and2', 'a', 'b', 1), ('s', 'xor2', 'p', 'c', 2), ('t', 'and2', 'p', 'c', 1), ('c', 'or2', 'g', 't', 1)) g(o, fn, i, j, d)
UNION ALL SELECT 'pulse', p || k, CAST(CASE t WHEN 0 THEN 0 ELSE (x >> k) & 1 END AS VARCHAR), NULL, t FROM b, p, (VALUES (0), (1)) t(t) UNION ALL SELECT 'pulse', 'c0', '0', NULL, 0
UNION ALL SELECT 'want', CASE k WHEN 16 THEN 'c' ELSE 's' END || k, CAST(((12345 + 54321) >> k) & 1 AS VARCHAR), NULL, NULL FROM (SELECT unnest(range(17)) AS k)""",
    "gen_netlist": "SELECT CAST(17 AS BIGINT) AS outputs, CAST(0 AS BIGINT) AS wrong",
    "src_triangle": f"WITH {_P} SELECT id, (id - 1) || ',' || id || ',' || (id + 1) AS corners, x, y, id - 1 AS q1 FROM p WHERE id BETWEEN 1 AND (SELECT count(*) - 2 FROM p)",
    "src_femap": f"WITH {_P} SELECT id + 1 AS id, (id + 1) || ',' || (id + 2) || ',' || (id + 3) AS corners, x, y FROM p WHERE id < (SELECT count(*) - 2 FROM p)",
    "src_points": f"WITH {_P} SELECT id, x, y FROM p",
    "src_libsvm": "SELECT CAST(i AS INTEGER) AS feature, round(avg(v), 6) AS mean, min(v) AS low, max(v) AS high FROM (SELECT i, round(CAST(embedding[i] AS DOUBLE), 6) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)) GROUP BY 1",
    "src_dense": "SELECT vec_id AS row, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[64] AS DOUBLE), 6) AS last, CAST(label AS DOUBLE) AS target FROM embeddings",
    "gen_torus": f"SELECT y * 16 + x AS src, (y + b) % 16 * 16 + (x + a) % 16 AS dst FROM (SELECT range AS x FROM range(16)), (SELECT range AS y FROM range(16)), {_TORUS.format(n=16)}",
    "gen_rand": "SELECT CAST(0 AS BIGINT) AS loops, CAST(0 AS BIGINT) AS doubles, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS ring_missing",
    "gen_grid": "SELECT y * 16 + x AS src, (y + b) * 16 + x + a AS dst FROM (SELECT range AS x FROM range(16)), (SELECT range AS y FROM range(16)), (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(a, b) WHERE x + a BETWEEN 0 AND 15 AND y + b BETWEEN 0 AND 15",
    "gen_grid_curve": "SELECT CAST(960 AS BIGINT) AS edges, CAST(510 AS BIGINT) AS steps, CAST(256 AS BIGINT) AS nodes",
    **dict.fromkeys(("gen_points", "gen_lights"), "SELECT CAST(5000 AS BIGINT) AS n, CAST(0 AS BIGINT) AS outside, CAST(0.5 AS DOUBLE) AS middle"),
    "gen_bipart": "SELECT CAST(0 AS BIGINT) AS bad, CAST(400 AS BIGINT) AS \"left\"",
    "gen_ksat": "SELECT CAST(1000 AS BIGINT) AS clauses, CAST(0 AS BIGINT) AS bad",
    "gen_plummer": "SELECT CAST(2000 AS BIGINT) AS n, CAST(1.0 AS DOUBLE) AS mass, true AS plausible",
    "snk_graph": f"WITH g AS ({USER}), m AS (SELECT max(greatest(src, dst)) AS m FROM g) SELECT m - src AS src, m - dst AS dst, w FROM g, m",
    "snk_textedge": f"WITH {_S}, {_BODY} SELECT k - 1 AS line, CAST(w AS VARCHAR) AS value FROM body",
    "snk_dimacs": f"""WITH {_S}, {_N}, {_BODY} SELECT CAST(0 AS BIGINT) AS line, 'c graph' AS value UNION ALL SELECT 1, 'p sp ' || n || ' ' || (SELECT count(*) FROM g) FROM n
UNION ALL SELECT k + 1, 'a ' || (src + 1) || ' ' || (dst + 1) || ' ' || w FROM body""",
    "snk_pbbs": f"""WITH {_S}, {_N}, {_BODY}, {_ALL}, c AS (SELECT id, count(src) AS d FROM v LEFT JOIN g ON src = id GROUP BY 1)
SELECT CAST(0 AS BIGINT) AS line, 'AdjacencyGraph' AS value UNION ALL SELECT 1, CAST(n AS VARCHAR) FROM n UNION ALL SELECT 2, CAST((SELECT count(*) FROM g) AS VARCHAR)
UNION ALL SELECT 3 + id, CAST(CAST(sum(d) OVER (ORDER BY id) - d AS BIGINT) AS VARCHAR) FROM c UNION ALL SELECT 2 + n + k, CAST(dst AS VARCHAR) FROM body, n""",
    "snk_wpbbs": f"WITH {_S}, {_BODY} SELECT CAST(0 AS BIGINT) AS line, 'WeightedEdgeArray' AS value UNION ALL SELECT k, src || ' ' || dst || ' ' || w FROM body",
    "snk_wpbbs_k": f"WITH {_S}, {_BODY} SELECT CAST(0 AS BIGINT) AS line, 'WeightedEdgeArray' AS value UNION ALL SELECT k, src || ' ' || dst || ' ' || printf('%.6f', w / 4) FROM body",
    "snk_bsml": f"WITH {_S} SELECT src, dst, CAST(w AS DOUBLE) AS w FROM g",
    "snk_bc": RANKS["bc"].replace("round(coalesce(b.bc, 0), 6)", "round(round(coalesce(b.bc, 0), 4), 2)"),
    "snk_mesh": "SELECT CAST(0 AS BIGINT) AS clockwise",
    "snk_meshbin": "SELECT vec_id AS id, vec_id - 1 AS p1, vec_id AS p2, vec_id + 1 AS p3 FROM embeddings WHERE vec_id BETWEEN 1 AND (SELECT count(*) - 2 FROM embeddings)",
    "snk_pfp": f"WITH g AS ({USER}) SELECT src, dst, w FROM g UNION ALL SELECT dst, src, 0 FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.src = g.dst AND h.dst = g.src)",
    "snk_dist": _BFS + " SELECT row_number() OVER (ORDER BY v.id) - 1 AS line, coalesce(CAST(t.d AS VARCHAR), 'inf') AS value FROM v LEFT JOIN t ON t.id = v.id",
    "snk_stats": "SELECT 'STAT' AS STATTYPE, 'events' AS LOOP, event_type AS CATEGORY, CAST(4 AS BIGINT) AS n, count(*) AS sum, " + ", ".join(f"count(*) FILTER (user_id % 4 = {k}) AS T{k}" for k in range(4)) + " FROM events GROUP BY event_type",
}
