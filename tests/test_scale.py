"""Forms that larger graphs take: what they write, how they are dealt, and that they are right."""

import random
from collections import Counter

import numpy as np
import pytest

from weftgraph.operators import partitioning, ranks, traversal
from weftgraph.plans import engine
from weftgraph.plans.graph import Graph


def graph_of(spark, n, m, seed=1):
    rnd = random.Random(seed)
    rows = sorted({(rnd.randrange(n), rnd.randrange(n), rnd.randint(1, 3)) for _ in range(m)})
    return Graph(spark.range(n), spark.createDataFrame(rows, "src long, dst long, w long"))


@pytest.fixture
def written(monkeypatch):
    names = []
    for module in (engine, ranks, traversal):
        plain = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, what, plain=plain: names.append(what) or plain(df, what))
    return names


def values(df):
    return {tuple(r)[:-1]: round(tuple(r)[-1], 9) for r in df.collect()}


def test_betweenness_of_a_graph_beyond_one_task_keeps_no_pairs(spark, monkeypatch, written):
    graph = graph_of(spark, 40, 300)
    want = values(ranks.betweenness(graph))
    monkeypatch.setattr(engine, "COMPACT_EDGES", 3)
    written.clear()
    assert values(ranks.betweenness(graph)) == want and written == ["edges"]
    monkeypatch.setattr(engine, "COMPACT_EDGES", -1)
    monkeypatch.setattr(engine, "PACKED_IDS", -1)
    assert values(ranks.betweenness(graph)) == want  # tables of pairs


def test_all_paths_of_a_graph_beyond_one_task_keep_no_pairs(spark, monkeypatch, written):
    graph = graph_of(spark, 60, 1200)  # dense: rounds also go along the edges into the rest
    want = values(traversal.sssp_all(graph))
    monkeypatch.setattr(engine, "COMPACT_EDGES", 3)
    written.clear()
    got = traversal.sssp_all(graph)
    assert values(got) == want and written == ["edges"]
    assert got.rdd.getNumPartitions() >= 8  # not one task for all sources
    monkeypatch.setattr(engine, "COMPACT_EDGES", -1)
    assert values(traversal.sssp_all(graph)) == want


def test_betweenness_in_rounds_takes_sources_in_turn(spark, monkeypatch, written):
    graph = graph_of(spark, 40, 300, 2)
    want = values(ranks.betweenness(graph))
    monkeypatch.setattr(engine, "COMPACT_EDGES", -1)
    monkeypatch.setattr(ranks, "PAIRS", 600)  # 15 sources at a time
    written.clear()
    assert values(ranks.betweenness(graph)) == want
    assert sorted(written) == ["edges", "ids", "packed", "packed"]


@pytest.mark.parametrize("run", [ranks.pagerank, ranks.pagerank_async])
def test_ranks_write_their_edges_once(spark, monkeypatch, written, run):
    graph = graph_of(spark, 50, 200, 3)
    want = values(run(graph))
    monkeypatch.setattr(engine, "COMPACT_EDGES", -1)
    written.clear()
    assert values(run(graph)) == want
    assert sorted(written) == ["ids", "packed", "shares", "vertices"]
    monkeypatch.setattr(engine, "PACKED_IDS", -1)
    if run is ranks.pagerank:
        assert values(run(graph)) == want  # tables a round


def test_sums_of_long_rows_are_cut(spark):
    import numpy as np

    other, start = np.arange(10) % 4, np.array([0, 1, 8])
    wide = np.random.default_rng(1).random((4, (1 << 20) // 3))  # three edges a piece
    got = engine.summed_ends(np.arange(3), start, other, None, wide)
    assert np.allclose(got, np.add.reduceat(wide[other], start))


def test_clusters_beyond_one_task_write_no_pairs(spark, monkeypatch):
    from weftgraph.operators import bodies

    rnd, rows = random.Random(4), []
    for k in range(150):
        d = [rnd.uniform(-1, 1) for _ in range(3)]
        norm = sum(x * x for x in d) ** 0.5
        rows.append((k, float(rnd.randint(1, 3)), *(rnd.randint(0, 5) / 4 for _ in range(3)), *(x / norm for x in d)))
    lights = spark.createDataFrame(rows, "id long, intensity double, x double, y double, z double, dx double, dy double, dz double")
    tree = lambda: sorted(tuple(r) for r in bodies.cluster(lights).select("id", "left", "right", "size").collect())
    want, names, plain = tree(), [], bodies.materialize
    assert len(want) == 149
    monkeypatch.setattr(bodies, "materialize", lambda df, what: names.append(what) or plain(df, what))
    monkeypatch.setattr(bodies, "COMPACT_LIGHTS", 10)
    assert tree() == want and names == ["clusters", "merges"]


def cliques(n, size, seed=3):
    """Edges of cliques in mixed ids, a ring of single edges through them."""
    ids = list(range(n * size))
    random.Random(seed).shuffle(ids)
    own = [ids[i * size : (i + 1) * size] for i in range(n)]
    return [(a, b, 2) for c in own for i, a in enumerate(c) for b in c[:i]] + [(own[i][0], own[i - 1][1], 1) for i in range(n)]


def parts_of(spark, rows, vertices, k, small):
    graph = Graph(vertices, spark.createDataFrame(rows, "src long, dst long, w long").repartition(3))
    found = [tuple(r) for r in partitioning.partition(graph, k, small).collect()]
    assert len(found) == len(dict(found)) == vertices.count() and set(dict(found).values()) <= set(range(k))
    return dict(found)


def test_partition_writes_no_tables_a_round_and_has_one_result(spark, monkeypatch):
    names, plain, rows = [], partitioning.materialize, cliques(24, 10)
    monkeypatch.setattr(partitioning, "materialize", lambda df, what: names.append(what) or plain(df, what))
    want = parts_of(spark, rows, spark.range(240), 4, 24)
    assert names == ["part-nodes", "packed"]
    size = Counter(want.values())
    assert len(size) == 4 and max(size.values()) <= 61
    assert sum(w for a, b, w in rows if want[a] != want[b]) <= 8  # whole cliques, in few stretches of the ring
    monkeypatch.setattr(engine, "COMPACT_EDGES", 200)
    names.clear()
    assert parts_of(spark, rows, spark.range(240), 4, 24) == want and set(names) == {"part-nodes", "packed"}
    monkeypatch.setattr(engine, "COMPACT_EDGES", 3)  # the smallest graph, too, has too many edges for the driver
    got = parts_of(spark, rows, spark.range(240), 4, 24)
    assert max(Counter(got.values()).values()) <= 61 and sum(w for a, b, w in rows if got[a] != got[b]) <= 300  # of 2,184, 1,638 by chance
    monkeypatch.setattr(engine, "PACKED_IDS", 100)  # the finest level as tables
    got = parts_of(spark, rows, spark.range(240), 4, 24)
    assert max(Counter(got.values()).values()) <= 70 and sum(w for a, b, w in rows if got[a] != got[b]) <= 100


def test_partition_of_hubs_lone_vertices_and_strangers(spark, monkeypatch):
    rows = [(0, i, 1) for i in range(1, 400)] + [(5, 5, 9), (7, 10**12, 1), (3, 2, 4), (2, 3, 4), (2, 3, 1)]
    vertices = spark.range(600)  # 400 and on have no edges; 10**12 is none of them
    want = parts_of(spark, rows, vertices, 3, 30)
    assert max(Counter(want.values()).values()) <= 206 and want[2] == want[3]
    monkeypatch.setattr(engine, "COMPACT_EDGES", 100)
    assert parts_of(spark, rows, vertices, 3, 30) == want
    assert parts_of(spark, [(1, 1, 1)], spark.range(4), 2, 2) == {0: 0, 1: 0, 2: 1, 3: 1}
    assert parts_of(spark, [(1, 1, 1)], spark.range(0), 2, 2) == {}


def test_coarsening_a_hub_does_not_stop():
    keys, start = np.arange(20_001, dtype=np.int32), np.r_[0, np.arange(20_000, 40_000)]
    other = np.r_[np.arange(1, 20_001), np.zeros(20_000, int)].astype(np.int32)
    level = partitioning.Held(20_001, [(keys, start, other, np.ones(40_000, np.int64))], "i8")
    group, weight = partitioning.grouped(level, np.ones(20_001, np.int64), 100, 500)
    assert len(weight) < 4_000 and weight.sum() == 20_001 and weight.max() <= 8
    assert (np.bincount(group) == weight).all()


def test_weights_of_parts_with_fractions_and_borders(spark):
    rows = [(0, 1, 0.5), (1, 2, 0.25), (2, 0, 0.75), (2, 3, 1.5), (3, 2, 0.125), (4, 4, 3.0)]
    graph = Graph(spark.range(6), spark.createDataFrame(rows, "src long, dst long, w double"))
    parts = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 2)], "id long, part int")
    assert sorted(tuple(r) for r in partitioning.cut_stats(graph, parts).collect()) == [(0, 3, 1.5, 1.5, 1), (1, 2, 3.0, 0.125, 1), (2, 1, 0.0, 0.0, 0)]
    halves = {r.id: r.part for r in partitioning.partition(graph, 2).collect()}
    assert Counter(halves.values()) == {0: 3, 1: 3}
