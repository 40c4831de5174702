"""PageRank over out-neighbours, ranks within a list, the distance of two rankings, betweenness."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.reduce import sorted_places
from weftgraph.operators.traversal import sssp_all
from weftgraph.plans.engine import Packed, Spread, dealt, distinct_places, in_one_task, is_compact, is_sent, numbered, sent_adjacency, sorted_ids, table_of
from weftgraph.plans.fixtures import cte, edges
from weftgraph.plans.graph import Graph, reversed_edges
from weftgraph.plans.scratch import discard, materialize

DAMPING, TOLERANCE, TOP = 0.85, 1e-4, 100


def pagerank(graph: Graph, rounds: int | None = None, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(id, rank): r'(i) = (1 - d) / V + d * sum of r(j) / outdegree(j) over the out-neighbours j,
    from 1 / V, for so many rounds or until the ranks change by ``tolerance`` in sum. A neighbour
    without out-edges hands on nothing. On a symmetric graph this is PageRank."""
    degrees = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    own = graph.edges.join(degrees, graph.edges.dst == degrees.id).select("src", "dst", (damping / F.col("degree")).alias("share"))
    own = materialize(own, "shares")
    vertices = materialize(graph.vertices.select("id"), "vertices")
    n = vertices.count()
    if not n:
        return vertices.withColumn("rank", F.lit(0.0))
    base, start = (1 - damping) / n, 1 / n
    if is_compact(own):
        rows = own.unionByName(vertices.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("share")))

        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            is_edge = pdf["dst"].notna().to_numpy()
            ids, a, b = numbered(pdf[is_edge], pdf.loc[~is_edge, "src"].to_numpy(np.int64))
            share, rank, done = pdf.loc[is_edge, "share"].to_numpy(), np.full(len(ids), start), 0
            order = np.argsort(b, kind="stable")  # neighbours in order: the sums read memory forwards
            a, b, share = a[order], b[order], share[order]
            while rounds is None or done < rounds:
                new = base + np.bincount(a, share * rank[b], len(ids))
                change, rank, done = np.abs(new - rank).sum(), new, done + 1
                if rounds is None and change <= tolerance:
                    break
            return pd.DataFrame({"id": ids, "rank": rank})

        return in_one_task(rows, kernel, "id long, rank double")
    ids = sorted_ids(vertices, graph.edges)
    if ids is not None:
        routes, rank, done = Packed(graph.edges, ids), np.full(len(ids), start), 0
        share = _shares(routes, damping)
        while rounds is None or done < rounds:
            new = base + routes.sums(share * rank)
            change, rank, done = np.abs(new - rank).sum(), new, done + 1
            if rounds is None and change <= tolerance:
                break
        discard(own)
        routes.discard()
        return table_of(own.sparkSession, "id long, rank double", ids, rank)
    routes, rank, done = Spread(own, "dst"), materialize(vertices.withColumn("rank", F.lit(start)), "ranks"), 0
    while rounds is None or done < rounds:
        sent = routes.join(rank.withColumnRenamed("id", "dst")).select(F.col("src").alias("id"), (F.col("share") * F.col("rank")).alias("got"), F.lit(None).cast("double").alias("old"))
        kept = rank.select("id", F.lit(base).alias("got"), F.col("rank").alias("old"))
        new = sent.unionByName(kept).groupBy("id").agg(F.sum("got").alias("rank"), F.max("old").alias("old"))
        new = materialize(new.select("id", "rank", F.abs(F.col("rank") - F.col("old")).alias("change")), "ranks")
        discard(rank)
        rank, done = new, done + 1
        if rounds is None and new.agg(F.sum("change")).first()[0] <= tolerance:
            break
    routes.discard()
    return rank.select("id", "rank")


def _shares(routes: Packed, damping: float) -> np.ndarray:
    """What a vertex hands on of its rank along each edge; nothing without out-edges."""
    degrees = routes.degrees()
    return np.divide(damping, degrees, out=np.zeros(len(degrees)), where=degrees > 0)


def pagerank_async(graph: Graph, tolerance: float = 1e-13, damping: float = DAMPING) -> DataFrame:
    """The same fixpoint by residuals: a vertex adds what has reached it to its rank and sends on the
    damped share; only residuals of note are sent, so late rounds touch few edges."""
    degrees = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    own = materialize(graph.edges.join(degrees, graph.edges.dst == degrees.id).select("src", "dst", (damping / F.col("degree")).alias("share")), "shares")
    vertices = materialize(graph.vertices.select("id"), "vertices")
    n = max(vertices.count(), 1)
    least, base = tolerance / n, (1 - damping) / n
    if is_compact(own):
        rows = own.unionByName(vertices.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("share")))

        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            is_edge = pdf["dst"].notna().to_numpy()
            ids, a, b = numbered(pdf[is_edge], pdf.loc[~is_edge, "src"].to_numpy(np.int64))
            share = pdf.loc[is_edge, "share"].to_numpy()
            rank, left = np.zeros(len(ids)), np.full(len(ids), base)
            while len(ids) and (open_ := left > least).any():
                sent = np.where(open_, left, 0)
                rank, left = rank + sent, np.where(open_, 0, left) + np.bincount(a, share * sent[b], len(ids))
            return pd.DataFrame({"id": ids, "rank": rank + left})

        return in_one_task(rows, kernel, "id long, rank double")
    ids = sorted_ids(vertices, graph.edges)
    if ids is not None:
        routes, rank, left = Packed(graph.edges, ids), np.zeros(len(ids)), np.full(len(ids), base)
        share = _shares(routes, damping)
        while (open_ := left > least).any():
            sent = np.where(open_, left, 0)
            rank, left = rank + sent, np.where(open_, 0, left) + routes.sums(share * sent)
        discard(own)
        routes.discard()
        return table_of(own.sparkSession, "id long, rank double", ids, rank + left)
    routes, state = Spread(own, "dst"), materialize(vertices.select("id", F.lit(0.0).alias("rank"), F.lit(base).alias("left")), "residuals")
    open_ = F.col("left") > least
    while not state.filter(open_).isEmpty():
        moved = routes.join(state.filter(open_).select(F.col("id").alias("dst"), "left")).select(F.col("src").alias("id"), F.lit(0.0).alias("rank"), (F.col("share") * F.col("left")).alias("left"))
        kept = state.select("id", (F.col("rank") + F.when(open_, F.col("left")).otherwise(0.0)).alias("rank"), F.when(open_, 0.0).otherwise(F.col("left")).alias("left"))
        old, state = state, materialize(kept.unionByName(moved).groupBy("id").agg(F.sum("rank").alias("rank"), F.sum("left").alias("left")), "residuals")
        discard(old)
    routes.discard()
    return state.select("id", (F.col("rank") + F.col("left")).alias("rank"))


def top(scores: DataFrame, k: int = TOP) -> DataFrame:
    """The k rows of highest rank, ties to the smallest id."""
    return scores.orderBy(F.desc("rank"), "id").limit(k)


def ranking(scores: DataFrame) -> DataFrame:
    """(id, place) of all vertices from 1, by rank and then id."""
    return sorted_places(scores.select("id", "rank"), "_at", F.desc("rank"), "id").select("id", (F.col("_at") + 1).alias("place"))


def places(scores: DataFrame, few: DataFrame, name: str) -> DataFrame:
    """(id, name) for a few ids: how many of all come before, by rank and then id; no global sort."""
    own = scores.join(F.broadcast(few.select("id")), "id").select("id", F.col("rank").alias("own"))
    before = (F.col("r") > F.col("own")) | (F.col("r") == F.col("own")) & (F.col("i") < F.col("id"))
    met = scores.select(F.col("id").alias("i"), F.col("rank").alias("r")).join(F.broadcast(own))
    return met.groupBy("id").agg(F.count_if(before).alias(name))


def rank_distance(first: DataFrame, second: DataFrame, k: int = TOP) -> DataFrame:
    """Of the pairs from the union of both top k, the share in which one vertex stands before its
    place in the other list and the other vertex does not."""
    first, second = materialize(first, "first"), materialize(second, "second")
    few = materialize(top(first, k).select("id").union(top(second, k).select("id")).distinct(), "tops")  # 2 k rows at most
    moved = places(first, few, "p").join(places(second, few, "q"), "id").select((F.col("p") < F.col("q")).alias("up"))
    counted = moved.agg(F.count_if("up").alias("u"), F.count("*").alias("n"))
    return counted.select((F.col("u") * (F.col("n") - F.col("u")) / (F.col("n") * (F.col("n") - 1) / 2)).alias("distance"))


def betweenness(graph: Graph, sources: DataFrame | None = None) -> DataFrame:
    """(id, bc): sum over the sources and all targets of the share of shortest paths through the
    vertex, unweighted, not normalised; parallel edges are paths of their own."""
    own = materialize(graph.edges.select("src", "dst"), "edges")
    sources = graph.has_out().select("id") if sources is None else sources
    if is_sent(own):
        summed = _betweenness_compact(own, sources)
        return graph.vertices.select("id").join(summed, "id", "left").select("id", F.coalesce("bc", F.lit(0.0)).alias("bc"))
    ids = sorted_ids(graph.vertices, own)
    if ids is not None:
        return graph.vertices.select("id").join(_betweenness_packed(own, sources, ids), "id")
    levels = materialize(sssp_all(Graph(graph.vertices, own.distinct().withColumn("w", F.lit(1).cast("long"))), sources).withColumnRenamed("dist", "level"), "levels")
    deepest = levels.agg(F.max("level")).first()[0] or 0
    sigma = [materialize(levels.filter("level = 0").select("source", "id", F.lit(1.0).alias("sigma")), "sigma")]
    for level in range(1, deepest + 1):
        here = levels.filter(F.col("level") == level).select("source", "id")
        come = sigma[-1].join(own, sigma[-1].id == own.src).groupBy("source", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        sigma.append(materialize(come.join(here, ["source", "id"]), "sigma"))
    delta = materialize(sigma[-1].withColumn("delta", F.lit(0.0)), "delta")
    parts = [delta]
    for level in range(deepest - 1, -1, -1):
        back = delta.select("source", F.col("id").alias("dst"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
        got = back.join(own, "dst").groupBy("source", F.col("src").alias("id")).agg(F.sum("share").alias("share"))
        delta = materialize(sigma[level].join(got, ["source", "id"], "left").withColumn("delta", F.col("sigma") * F.coalesce("share", F.lit(0.0))).drop("share"), "delta")
        parts.append(delta)
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    summed = total.filter("source <> id").groupBy("id").agg(F.sum("delta").alias("bc"))
    return graph.vertices.select("id").join(summed, "id", "left").select("id", F.coalesce("bc", F.lit(0.0)).alias("bc"))


#: Pairs of a source and a vertex at a time: the driver has some 50 bytes each.
PAIRS = 4_000_000


def _betweenness_packed(own: DataFrame, sources: DataFrame, ids: np.ndarray) -> DataFrame:
    """(id, bc) with the edges dealt in blocks and so many sources at a time; a round is a job."""
    into, out_of, total = Packed(own, ids, "dst"), Packed(own, ids, "src"), np.zeros(len(ids))
    wanted = sources.select("id").distinct().toArrow()["id"].to_numpy()
    at = np.sort(np.searchsorted(ids, wanted[np.isin(wanted, ids)]))
    size = max(1, PAIRS // max(1, len(ids)))
    for low in range(0, len(at), size):
        some = at[low : low + size]
        level, sigma, deepest = np.full((len(ids), len(some)), -1, np.int32), np.zeros((len(ids), len(some))), 0
        own_place = some, np.arange(len(some))
        level[own_place], sigma[own_place] = 0, 1.0
        while True:
            come = into.sums(np.where(level == deepest, sigma, 0.0))
            new = (level < 0) & (come > 0)
            if not new.any():
                break
            deepest += 1
            level[new], sigma[new] = deepest, come[new]
        delta = np.zeros(sigma.shape)
        for depth in range(deepest - 1, -1, -1):
            share = np.divide(1 + delta, sigma, out=np.zeros(sigma.shape), where=level == depth + 1)
            here = level == depth
            delta[here] = sigma[here] * out_of.sums(share)[here]
        delta[own_place] = 0
        total += delta.sum(1)
    into.discard(), out_of.discard()
    return table_of(own.sparkSession, "id long, bc double", ids, total)


def _betweenness_compact(own: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, bc) with the sources dealt over tasks, each of which has the whole small graph."""
    held = sent_adjacency(own)

    def run(stream):
        g = held.value
        total = np.zeros(len(g.ids))
        level, sigma, delta = np.empty(len(g.ids), np.int32), np.empty(len(g.ids)), np.empty(len(g.ids))
        for pdf in stream:
            for s in g.places(pdf["id"].to_numpy(np.int64)):
                level.fill(-1), sigma.fill(0), delta.fill(0)
                level[s], sigma[s], front, steps = 0, 1.0, np.array([s]), []
                unmet = g.in_degree.sum() - g.in_degree[s]  # edges into vertices without a level
                while len(front):
                    if unmet < g.out_degree[front].sum():  # fewer edges lead to the rest than leave here
                        rest = np.flatnonzero(level < 0)
                        e, n = g.edges_into(rest)
                        a, b = g.src[e], np.repeat(rest, n)
                        tight = level[a] == len(steps)
                    else:
                        e, n = g.edges_of(front)
                        a, b = np.repeat(front, n), g.dst[e]
                        tight = level[b] < 0
                    a, b = a[tight], b[tight]
                    level[b] = len(steps) + 1
                    np.add.at(sigma, b, sigma[a])
                    steps.append((a, b))
                    front = distinct_places(b, len(level))
                    unmet -= g.in_degree[front].sum()
                for a, b in reversed(steps):
                    np.add.at(delta, a, sigma[a] * (1 + delta[b]) / sigma[b])
                delta[s] = 0
                total += delta
        met = np.flatnonzero(total)
        yield pd.DataFrame({"id": g.ids[met], "bc": total[met]})

    spread = dealt(sources.select("id").distinct(), "id")
    return spread.mapInPandas(run, "id long, bc double").groupBy("id").agg(F.sum("bc").alias("bc"))


def _bip(spark, sf_dir) -> Graph:
    own = materialize(edges(spark, sf_dir, "bip"), "fixture")
    return Graph.from_edges(own.unionByName(reversed_edges(own)))


def _q_sync(spark, sf_dir):
    return pagerank(_bip(spark, sf_dir), 10).select("id", F.round("rank", 12).alias("rank"))


def _q_async(spark, sf_dir):
    return pagerank_async(_bip(spark, sf_dir)).select("id", F.round("rank", 9).alias("rank"))


def _q_distance(spark, sf_dir):
    """Jacobi rounds to the tolerance against the in-place fixpoint."""
    graph = _bip(spark, sf_dir)
    rounded = lambda r: r.select("id", F.round("rank", 9).alias("rank"))
    return rank_distance(rounded(pagerank(graph)), rounded(pagerank_async(graph))).select(F.round("distance", 9).alias("distance"))


def _q_top(spark, sf_dir):
    return top(_q_sync(spark, sf_dir))


def _q_rank(spark, sf_dir):
    return ranking(_q_sync(spark, sf_dir))


def _q_tolerance(spark, sf_dir):
    return pagerank(_bip(spark, sf_dir)).select("id", F.round("rank", 9).alias("rank"))


def _q_bc(spark, sf_dir):
    graph = Graph.from_edges(materialize(edges(spark, sf_dir, "user"), "fixture"))
    return betweenness(graph).select("id", F.round("bc", 6).alias("bc"))


def _jacobi(k: int, digits: int) -> str:
    return f"""WITH RECURSIVE {cte("bip")}, nv AS (SELECT count(*) AS n FROM v), deg AS (SELECT src AS id, count(*) AS n FROM e GROUP BY 1),
t(it, id, r) AS (SELECT 0, id, CAST(1.0 AS DOUBLE) / (SELECT n FROM nv) FROM v UNION ALL
  SELECT it + 1, e.src, CAST(0.15 AS DOUBLE) / (SELECT n FROM nv) + CAST(0.85 AS DOUBLE) * sum(t.r / deg.n)
  FROM t JOIN e ON e.dst = t.id JOIN deg ON deg.id = t.id WHERE it < {k} GROUP BY it, e.src)
SELECT id, round(r, {digits}) AS rank FROM t WHERE it = {k}"""


#: The first of 100 rounds after which the ranks have changed by the tolerance in sum or less.
_TOLERANCE = _jacobi(100, 9).replace("SELECT id, round(r, 9)", """, ch AS (SELECT b.it, sum(abs(b.r - a.r)) AS ch FROM t a JOIN t b ON b.id = a.id AND b.it = a.it + 1 GROUP BY 1)
SELECT id, round(r, 9)""").replace("WHERE it = 100", f"WHERE it = (SELECT min(it) FROM ch WHERE ch <= {TOLERANCE})")


QUERIES = {"pagerank_sync": _q_sync, "pagerank_async": _q_async, "pagerank_tolerance": _q_tolerance, "rank_distance": _q_distance, "s_topk": _q_top, "s_rank": _q_rank, "bc": _q_bc}
ORACLES = {
    "pagerank_sync": _jacobi(10, 12),
    "pagerank_async": _jacobi(170, 9),
    "pagerank_tolerance": _TOLERANCE,
    "rank_distance": f"""WITH a AS ({_TOLERANCE}), b AS ({_jacobi(170, 9)}),
p AS (SELECT id, row_number() OVER (ORDER BY rank DESC, id) AS p FROM a), q AS (SELECT id, row_number() OVER (ORDER BY rank DESC, id) AS q FROM b),
m AS (SELECT id, p, q FROM p JOIN q USING (id) WHERE p <= 100 OR q <= 100)
SELECT round(avg(CAST((x.p < x.q) <> (y.p < y.q) AS DOUBLE)), 9) AS distance FROM m x JOIN m y ON x.id < y.id""",
    "s_topk": f"SELECT * FROM ({_jacobi(10, 12)}) ORDER BY rank DESC, id LIMIT 100",
    "s_rank": f"SELECT id, row_number() OVER (ORDER BY rank DESC, id) AS place FROM ({_jacobi(10, 12)})",
    "bc": f"""WITH RECURSIVE {cte("user", False)},
d(source, id, dist) USING KEY (source, id) AS (SELECT DISTINCT src, src, 0 FROM e UNION
  SELECT x.source, x.dst, x.m FROM (SELECT d.source, e.dst, min(d.dist + 1) AS m FROM d JOIN e ON d.id = e.src GROUP BY 1, 2) x
  LEFT JOIN recurring.d r ON r.source = x.source AND r.id = x.dst WHERE r.dist IS NULL OR x.m < r.dist),
mx AS (SELECT max(dist) AS m FROM d),
s(lvl, source, id, sigma) AS (SELECT 0, source, id, CAST(1 AS DOUBLE) FROM d WHERE dist = 0 UNION ALL
  SELECT s.lvl + 1, s.source, e.dst, sum(s.sigma) FROM s JOIN e ON e.src = s.id JOIN d ON d.source = s.source AND d.id = e.dst AND d.dist = s.lvl + 1 GROUP BY s.lvl, s.source, e.dst),
u(lvl, source, id, sigma, delta) AS (SELECT lvl, source, id, sigma, CAST(0 AS DOUBLE) FROM s WHERE lvl = (SELECT m FROM mx) UNION ALL
  SELECT x.lvl, x.source, x.id, max(x.sigma), max(x.sigma) * coalesce(sum((1 + y.delta) / y.sigma), 0)
  FROM (SELECT s.*, e.dst FROM s JOIN e ON e.src = s.id) x LEFT JOIN u y ON y.source = x.source AND y.id = x.dst AND y.lvl = x.lvl + 1
  WHERE x.lvl = (SELECT max(lvl) FROM u) - 1 GROUP BY x.lvl, x.source, x.id)
SELECT v.id, round(coalesce(b.bc, 0), 6) AS bc FROM v LEFT JOIN (SELECT id, sum(delta) AS bc FROM u WHERE source <> id GROUP BY 1) b ON b.id = v.id""",
}
