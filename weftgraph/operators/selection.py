"""Rounds that select: independent sets, spanning forests, matchings.

All ties have a total order, so results do not depend on scheduling: an independent set is the one
a greedy scan by id finds, a minimum spanning forest that of the order (w, src, dst)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.components import component_labels, connected_components
from weftgraph.operators.traversal import parents
from weftgraph.plans.engine import in_one_task, is_compact, least_paths, numbered
from weftgraph.plans.fixtures import cte, edges, sql
from weftgraph.plans.graph import Graph, reversed_edges
from weftgraph.plans.scratch import materialize

UNDECIDED, IN, OUT = 0, 1, 2


def independent_set(graph: Graph) -> DataFrame:
    """(id, in_set): in each round every undecided vertex with no smaller undecided neighbour joins
    and its neighbours drop out: the set a scan by ascending id builds. Edges count both ways."""
    both = graph.edges.select("src", "dst").filter("src <> dst")
    both = materialize(both.union(both.select("dst", "src")).distinct(), "edges")
    vertices = materialize(graph.vertices.select("id"), "vertices")
    if is_compact(both):
        rows = both.union(vertices.select("id", F.lit(None).cast("long")))

        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            is_edge = pdf["dst"].notna().to_numpy()
            ids, a, b = numbered(pdf[is_edge], pdf.loc[~is_edge, "src"].to_numpy(np.int64))
            state = np.zeros(len(ids), np.int8)
            while len(open_ := np.flatnonzero(state == UNDECIDED)):
                live = (state[a] == UNDECIDED) & (state[b] == UNDECIDED)
                a, b = a[live], b[live]
                blocked = np.zeros(len(ids), bool)
                blocked[a[b < a]] = True
                new = open_[~blocked[open_]]
                state[new] = IN
                state[b[state[a] == IN]] = OUT
            return pd.DataFrame({"id": ids, "in_set": state == IN})

        return in_one_task(rows, kernel, "id long, in_set boolean")
    state = materialize(vertices.withColumn("s", F.lit(UNDECIDED)), "mis")
    while not (open_ := state.filter(F.col("s") == UNDECIDED).select("id")).isEmpty():
        live = both.join(open_.toDF("src"), "src", "left_semi").join(open_.toDF("dst"), "dst", "left_semi").select("src", "dst")
        blocked = live.filter("dst < src").select(F.col("src").alias("id")).distinct()
        new = materialize(open_.join(blocked, "id", "left_anti"), "mis-new")
        gone = live.join(new.toDF("src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        turned = new.withColumn("t", F.lit(IN)).unionByName(gone.withColumn("t", F.lit(OUT)))
        state = materialize(state.join(turned, "id", "left").select("id", F.coalesce("t", "s").alias("s")), "mis")
    return state.select("id", (F.col("s") == IN).alias("in_set"))


def independent_set_violations(graph: Graph, found: DataFrame) -> DataFrame:
    """Certificate: (adjacent, addable), both 0 for a maximal independent set."""
    both = graph.drop_loops().symmetrize().edges
    inside = found.filter("in_set").select("id")
    adjacent = both.join(inside.toDF("src"), "src", "left_semi").join(inside.toDF("dst"), "dst", "left_semi")
    near = both.join(inside.toDF("dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    addable = found.filter("NOT in_set").join(near, "id", "left_anti")
    return adjacent.agg(F.count("*").alias("adjacent")).crossJoin(addable.agg(F.count("*").alias("addable")))


def minimum_forest(graph: Graph, contract: bool = True) -> DataFrame:
    """Minimum spanning forest (src, dst, w) of the edges taken both ways, in the order (w, src,
    dst): each round every component takes its least edge to another and merges along it.

    With ``contract`` doubles between merged components are dropped each round, so the edge table
    shrinks with the number of components; without, edges are only relabelled."""
    own = materialize(graph.dedupe().edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.struct("w", "src", "dst").alias("e")), "forest-edges")
    if is_compact(own):
        return _forest_compact(own.select("e.*"))
    picked = []
    while not own.isEmpty():
        ends = own.select(F.explode(F.array("a", "b")).alias("c"), "e")
        best = materialize(ends.groupBy("c").agg(F.min("e").alias("e")).select("e").distinct(), "forest-picked")
        picked.append(best)
        ab = own.join(best, "e", "left_semi").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        labels = materialize(component_labels(ab), "forest-labels")
        x, y = labels.toDF("a", "x"), labels.toDF("b", "y")
        rest = own.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"), "e").filter("a <> b")
        if contract:
            rest = rest.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("e").alias("e"))
        own = materialize(rest, "forest-edges")
    out = graph.edges.select("src", "dst", "w").limit(0)
    for p in picked:
        out = out.union(p.select("e.src", "e.dst", "e.w"))
    return out.distinct()


def _forest_compact(own: DataFrame) -> DataFrame:
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["w", "src", "dst"], ignore_index=True)
        ids, a, b = numbered(pdf)
        label, left, picked = np.arange(len(ids)), np.arange(len(pdf)), [np.empty(0, np.int64)]
        while len(left):
            x, y = label[a[left]], label[b[left]]
            left = left[x != y]
            x, y = label[a[left]], label[b[left]]
            best = np.full(len(ids), len(pdf))
            np.minimum.at(best, x, left)  # edges are in order, so the place is the rank
            np.minimum.at(best, y, left)
            new = np.unique(best[best < len(pdf)])
            picked.append(new)
            p, q = label[a[new]], label[b[new]]
            up = np.arange(len(ids))
            while len(p):
                r, s = up[p], up[q]
                apart = r != s
                p, q, r, s = p[apart], q[apart], r[apart], s[apart]
                np.minimum.at(up, np.maximum(r, s), np.minimum(r, s))
                while not np.array_equal(up[up], up):
                    up = up[up]
            label = up[label]
        return pdf.loc[np.concatenate(picked), ["src", "dst", "w"]]

    return in_one_task(own, kernel, "src long, dst long, w long")


def forest_by_weight(graph: Graph) -> DataFrame:
    """The same forest in ascending order of weights: each weight's edges in turn, between the
    components that all lighter ones have formed. For few distinct weights."""
    own = materialize(graph.dedupe().edges, "forest-edges")
    if is_compact(own):
        return _forest_compact(own)
    labels = None
    out = own.limit(0).select("src", "dst", "w")
    for (w,) in sorted(own.select("w").distinct().collect()):
        here = own.filter(F.col("w") == w)
        if labels is not None:
            x, y = labels.toDF("src", "x"), labels.toDF("dst", "y")
            here = here.join(x, "src", "left").join(y, "dst", "left").select(F.coalesce("x", "src").alias("a"), F.coalesce("y", "dst").alias("b"), F.struct("src", "dst", "w").alias("e")).filter("a <> b")
        else:
            here = here.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.struct("src", "dst", "w").alias("e"))
        # the order (src, dst) among equal weights stands in for a weight
        light = materialize(here.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.min("e").alias("e")), "forest-light")
        ranked = light.select("src", "dst", F.struct("e.src", "e.dst").alias("w"))
        picked = materialize(_forest_of(ranked), "forest-picked")
        out = out.union(picked.select("w.src", "w.dst", F.lit(w).cast("long")))
        merged = materialize(component_labels(picked), "forest-labels")
        if labels is None:
            labels = merged
        else:
            up = merged.toDF("component", "c")
            old = labels.join(up, "component", "left").select("id", F.coalesce("c", "component").alias("component"))
            labels = materialize(old.unionByName(merged.join(labels.select("id"), "id", "left_anti")), "forest-all")
    return out


def _forest_of(own: DataFrame) -> DataFrame:
    """Forest of (src, dst, w) for any ordered, distinct w."""
    rest, picked = materialize(own.select(F.col("src").alias("a"), F.col("dst").alias("b"), "src", "dst", "w"), "forest-rest"), None
    while not rest.isEmpty():
        best = rest.select(F.explode(F.array("a", "b")).alias("c"), F.struct("w", "src", "dst").alias("e")).groupBy("c").agg(F.min("e").alias("e"))
        new = materialize(best.select("e.src", "e.dst", "e.w").distinct(), "forest-new")
        picked = new if picked is None else picked.unionByName(new)
        ab = rest.join(new, ["src", "dst"], "left_semi").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        labels = materialize(component_labels(ab), "forest-names")
        x, y = labels.toDF("a", "x"), labels.toDF("b", "y")
        rest = rest.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"), "src", "dst", "w").filter("a <> b")
        rest = materialize(rest, "forest-rest")
    return own.limit(0) if picked is None else picked.distinct()


def forest_from(graph: Graph, root: int) -> DataFrame:
    """The minimum forest's tree that holds the root: the part one can reach from it."""
    labels = connected_components(graph)
    mine = labels.filter(F.col("id") == root).select("component")
    inside = labels.join(mine, "component", "left_semi").select(F.col("id").alias("src"))
    return minimum_forest(graph).join(inside, "src", "left_semi").select("src", "dst", "w")


def spanning_forest(graph: Graph) -> DataFrame:
    """(id, parent) by levels from the smallest vertex of each component; roots are their own."""
    both = materialize(graph.symmetrize().edges.select("src", "dst"), "edges")
    labels = materialize(connected_components(graph), "labels")
    seeds = labels.filter("id = component").select(F.lit(0).cast("long").alias("source"), "id", F.lit(0).cast("long").alias("dist"))
    levels = materialize(least_paths(both.withColumn("w", F.lit(1).cast("long")), seeds).select("id", "dist"), "levels")
    up = parents(Graph(graph.vertices, both), levels)
    return graph.vertices.select("id").join(up, "id", "left").select("id", F.coalesce("parent", "id").alias("parent"))


def matching(graph: Graph, max_rounds: int | None = None) -> DataFrame:
    """Maximum-cardinality matching (src, dst) of a bipartite graph with edges from left to right.

    A greedy start by mutual choice, then phases of augmenting: alternating levels from the free
    left vertices, and back from the free right ones of the first level reached along vertex-disjoint
    paths, each step a choice by the smallest id. It ends when no free right vertex is reached."""
    own = materialize(graph.edges.select("src", "dst").distinct(), "match-edges")
    if is_compact(own):
        return _matching_compact(own)
    mate = _greedy(own)
    phases = 0
    while max_rounds is None or phases < max_rounds:
        grown = _augment(own, mate)
        if grown is None:
            break
        mate, phases = grown, phases + 1
    return mate


def _greedy(own: DataFrame) -> DataFrame:
    """A maximal matching: rounds in which mutual first choices marry."""
    mate, rest = own.limit(0), own
    while not rest.isEmpty():
        best = rest.groupBy("src").agg(F.min("dst").alias("dst"))
        new = materialize(best.groupBy("dst").agg(F.min("src").alias("src")).select("src", "dst"), "match-new")
        mate = materialize(mate.unionByName(new), "match")
        rest = materialize(rest.join(new.select("src"), "src", "left_anti").join(new.select("dst"), "dst", "left_anti").select("src", "dst"), "match-rest")
    return mate


def _augment(own: DataFrame, mate: DataFrame) -> DataFrame | None:
    """The matching after one phase, or None if no augmenting path is left."""
    front = own.select("src").distinct().join(mate.select("src"), "src", "left_anti")
    trees, seen = [], None  # trees[k]: (src, dst) by which right vertices are first reached
    while True:
        come = own.join(front, "src", "left_semi").select("src", "dst")
        if seen is not None:
            come = come.join(seen, "dst", "left_anti")
        layer = materialize(come.groupBy("dst").agg(F.collect_set("src").alias("from")), "match-layer")
        if layer.isEmpty():
            return None
        trees.append(layer)
        free = layer.join(mate.select("dst"), "dst", "left_anti")
        if not free.isEmpty():
            break
        new = layer.select("dst")
        seen = materialize(new if seen is None else seen.union(new), "match-seen")
        front = materialize(mate.join(new, "dst", "left_semi").select("src"), "match-front")
    # walk back: each path claims one left vertex a layer, disputes go to the smallest path
    paths = materialize(free.select(F.col("dst").alias("path"), F.col("dst").alias("at"), F.array().cast("array<struct<src:bigint,dst:bigint>>").alias("pairs")), "match-paths")
    for k in range(len(trees) - 1, -1, -1):
        options = paths.join(trees[k].select(F.col("dst").alias("at"), F.explode("from").alias("src")), "at")
        claimed = _claims(materialize(options.select("path", "at", "src", "pairs"), "match-options"))
        steps = claimed.select("path", "src", F.concat("pairs", F.array(F.struct("src", F.col("at").alias("dst")))).alias("pairs"))
        if k:
            back = steps.join(mate, "src").select("path", F.col("dst").alias("at"), "pairs")
            paths = materialize(back, "match-paths")
        else:
            paths = materialize(steps, "match-paths")
    new = paths.select(F.explode("pairs").alias("p")).select("p.src", "p.dst")
    kept = mate.join(new.select("src"), "src", "left_anti")
    return materialize(kept.unionByName(new), "match")


def _claims(options: DataFrame) -> DataFrame:
    """Of (path, at, src, pairs) rows a choice of one src a path and one path a src, maximal."""
    held, rest = None, options
    while not rest.isEmpty():
        best = rest.groupBy("path").agg(F.min("src").alias("src"))
        won = materialize(best.groupBy("src").agg(F.min("path").alias("path")), "match-won")
        new = rest.join(won, ["path", "src"], "left_semi")
        held = new if held is None else held.unionByName(new)
        rest = materialize(rest.join(won.select("path"), "path", "left_anti").join(won.select("src"), "src", "left_anti").select(*options.columns), "match-open")
    return held


def _matching_compact(own: DataFrame) -> DataFrame:
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        left, a = np.unique(pdf["src"].to_numpy(np.int64), return_inverse=True)
        right, b = np.unique(pdf["dst"].to_numpy(np.int64), return_inverse=True)
        order = np.lexsort((b, a))
        a, b = a[order], b[order].tolist()
        start = np.searchsorted(a, np.arange(len(left) + 1)).tolist()
        of_left, of_right = [-1] * len(left), [-1] * len(right)
        while True:
            level, front = [-1] * len(left), [u for u in range(len(left)) if of_left[u] < 0]
            for u in front:
                level[u] = 0
            found = False
            while front and not found:
                after = []
                for u in front:
                    for v in b[start[u] : start[u + 1]]:
                        w = of_right[v]
                        if w < 0:
                            found = True
                        elif level[w] < 0:
                            level[w] = level[u] + 1
                            after.append(w)
                front = after
            if not found:
                break
            place = start[:-1].copy()
            for root in range(len(left)):
                if of_left[root] >= 0:
                    continue
                stack = [root]
                while stack:
                    u = stack[-1]
                    if place[u] >= start[u + 1]:
                        level[u] = -1
                        stack.pop()
                        continue
                    w = of_right[b[place[u]]]
                    if w < 0:
                        for x in reversed(stack):
                            of_left[x], of_right[b[place[x]]] = b[place[x]], x
                        break
                    if level[w] == level[u] + 1:
                        stack.append(w)
                    else:
                        place[u] += 1
                        continue
                    if level[stack[-1]] < 0:
                        stack.pop()
                        place[u] += 1
                else:
                    continue
        got = [(int(left[u]), int(right[v])) for u, v in enumerate(of_left) if v >= 0]
        return pd.DataFrame(got, columns=["src", "dst"])

    return in_one_task(own, kernel, "src long, dst long")


def node_cover(graph: Graph, mate: DataFrame) -> DataFrame:
    """Certificate: a node cover as large as the matching, by alternating reachability from the free
    left vertices: (cover, uncovered, matched)."""
    own = materialize(graph.edges.select("src", "dst").distinct(), "cover-edges")
    mate = materialize(mate, "cover-mate")
    free = own.select("src").distinct().join(mate.select("src"), "src", "left_anti").select(F.col("src").alias("id"))
    steps = own.join(mate, ["src", "dst"], "left_anti").select("src", "dst").unionByName(mate.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seeds = free.select(F.lit(0).cast("long").alias("source"), "id", F.lit(0).cast("long").alias("dist"))
    met = materialize(least_paths(steps.withColumn("w", F.lit(0).cast("long")), seeds).select("id"), "cover-met")
    cover = own.select("src").distinct().join(met.toDF("src"), "src", "left_anti").union(own.select("dst").distinct().join(met.toDF("dst"), "dst", "left_semi"))
    cover = materialize(cover.toDF("id"), "cover")
    bare = own.join(cover.toDF("src"), "src", "left_anti").join(cover.toDF("dst"), "dst", "left_anti")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(cover, "cover").crossJoin(one(bare, "uncovered")).crossJoin(one(mate, "matched"))


def _sparse(spark, sf_dir) -> Graph:
    return Graph.from_edges(materialize(edges(spark, sf_dir, "sparse"), "fixture"))


def _weight(run):
    def query(spark, sf_dir):
        return run(_sparse(spark, sf_dir)).agg(F.count("*").alias("tree_edges"), F.sum("w").alias("weight"))

    return query


def _q_spantree(spark, sf_dir):
    up = spanning_forest(_sparse(spark, sf_dir))
    return up.agg(F.count_if(F.col("id") == F.col("parent")).alias("num_trees"), F.count_if(F.col("id") != F.col("parent")).alias("tree_edges"))


def _q_prim(spark, sf_dir):
    graph = _sparse(spark, sf_dir)
    root = graph.edges.agg(F.min("src")).first()[0]
    return forest_from(graph, root).agg(F.count("*").alias("tree_edges"), F.sum("w").alias("weight"))


def _q_mis_check(spark, sf_dir):
    graph = _sparse(spark, sf_dir)
    return independent_set_violations(graph, materialize(independent_set(graph), "mis"))


def _q_cover(spark, sf_dir):
    graph = _sparse(spark, sf_dir)
    return node_cover(graph, matching(graph)).select("uncovered", (F.col("cover") - F.col("matched")).alias("gap"))


def _q_matching(spark, sf_dir):
    """Of a graph so small that its oracle can try all sets of left vertices."""
    return matching(Graph.from_edges(sql(spark, sf_dir, _FEW).selectExpr("CAST(src AS BIGINT) src", "CAST(dst AS BIGINT) dst"))).agg(F.count("*").alias("matched"))


#: Twelve nations and their suppliers' ranges of account balance, thinned.
_FEW = "SELECT DISTINCT s_nationkey AS src, 100 + CAST(floor(s_acctbal / 1500) AS BIGINT) AS dst FROM supplier WHERE s_nationkey < 12 AND s_suppkey % 3 < 2"
_CC = """t{k}(id, c) USING KEY (id) AS (SELECT id, id FROM v UNION
  SELECT x.dst, x.m FROM (SELECT e.dst, min(t{k}.c) AS m FROM t{k} JOIN e ON t{k}.id = e.src WHERE e.w <= {k} GROUP BY 1) x
  JOIN recurring.t{k} r ON r.id = x.dst WHERE x.m < r.c)"""
_WEIGHTS = range(1, 8)  # line numbers
_FOREST = f"""WITH RECURSIVE {cte("sparse")}, {", ".join(_CC.format(k=k) for k in _WEIGHTS)},
n AS (SELECT {", ".join(f"(SELECT count(DISTINCT c) FROM t{k}) AS n{k}" for k in _WEIGHTS)}, (SELECT count(*) FROM v) AS n0)
SELECT n0 - n7 AS tree_edges, {" + ".join(f"(n{k} - n7)" for k in range(7))} AS weight FROM n"""
_ALL_CC = f"WITH RECURSIVE {cte('sparse')}, {_CC.format(k=7)}"
QUERIES = {
    "mis": lambda s, d: independent_set(_sparse(s, d)),
    "mis_verify": _q_mis_check,
    "mst_boruvka": _weight(lambda g: minimum_forest(g, contract=False)),
    "mst_morph": _weight(lambda g: minimum_forest(g, contract=True)),
    "mst_kruskal": _weight(forest_by_weight),
    "mst_prim": _q_prim,
    "mst_edges": lambda s, d: minimum_forest(_sparse(s, d)),
    "spantree": _q_spantree,
    "matching": _q_matching,
    "matching_verify": _q_cover,
}
ORACLES = {
    "mis": f"""WITH RECURSIVE {cte("sparse")},
t(id, s) USING KEY (id) AS (SELECT id, 0 FROM v UNION (WITH st AS (SELECT id, s FROM recurring.t), und AS (SELECT id FROM st WHERE s = 0),
  ins AS (SELECT id FROM und WHERE NOT EXISTS (SELECT 1 FROM e JOIN und u2 ON u2.id = e.dst WHERE e.src = und.id AND e.dst < und.id)),
  outs AS (SELECT DISTINCT e.dst AS id FROM ins JOIN e ON e.src = ins.id)
  SELECT id, 1 FROM ins UNION ALL SELECT id, 2 FROM outs))
SELECT id, s = 1 AS in_set FROM t""",
    "mis_verify": "SELECT CAST(0 AS BIGINT) AS adjacent, CAST(0 AS BIGINT) AS addable",
    "mst_boruvka": _FOREST,
    "mst_morph": _FOREST,
    "mst_kruskal": _FOREST,
    "mst_prim": f"""WITH RECURSIVE {cte("sparse")}, {", ".join(_CC.format(k=k) for k in _WEIGHTS)}, mine AS (SELECT id FROM t7 WHERE c = (SELECT c FROM t7 WHERE id = (SELECT min(src) FROM g))),
n AS (SELECT {", ".join(f"(SELECT count(DISTINCT c) FROM t{k} JOIN mine USING (id)) AS n{k}" for k in _WEIGHTS)}, (SELECT count(*) FROM mine) AS n0)
SELECT n0 - 1 AS tree_edges, {" + ".join(f"(n{k} - 1)" for k in range(7))} AS weight FROM n""",
    "spantree": f"{_ALL_CC} SELECT count(DISTINCT c) AS num_trees, count(*) - count(DISTINCT c) AS tree_edges FROM t7",
    "matching": f"""WITH g AS ({_FEW}), l AS (SELECT src, row_number() OVER (ORDER BY src) - 1 AS k FROM (SELECT DISTINCT src FROM g)), n AS (SELECT count(*) AS n FROM l),
s AS (SELECT unnest(range(CAST(1 << n AS BIGINT))) AS s FROM n), h AS (SELECT s, count(DISTINCT dst) AS near FROM s JOIN l ON (s >> k) & 1 = 1 JOIN g USING (src) GROUP BY 1)
SELECT n - coalesce(greatest(max(bit_count(s) - near), 0), 0) AS matched FROM n LEFT JOIN h ON true GROUP BY n""",
    "matching_verify": "SELECT CAST(0 AS BIGINT) AS uncovered, CAST(0 AS BIGINT) AS gap",
}
