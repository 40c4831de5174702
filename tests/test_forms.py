"""The distributed rounds against the compact kernels, plain algorithms and each other."""

import os
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import components, flow, logic, ranks, selection, survey, traversal
from weftgraph.plans import engine, scratch
from weftgraph.plans.graph import Graph
from weftgraph.sources import generators, netlist


@pytest.fixture(params=["compact", "rounds"])
def form(request, monkeypatch):
    if request.param == "rounds":
        monkeypatch.setattr(engine, "COMPACT_EDGES", -1)
        monkeypatch.setattr(flow, "COMPACT_FLOW", -1)
        monkeypatch.setattr(logic, "COMPACT_GATES", -1)
    return request.param


def rows_of(seed, n=30, m=45, symmetric=True):
    rnd = random.Random(seed)
    pairs = {(rnd.randrange(n), rnd.randrange(n)): rnd.randint(1, 9) for _ in range(m)}
    rows = [(a, b, w) for (a, b), w in pairs.items() if a != b and (not symmetric or (b, a) not in pairs or a < b)]
    return rows + ([(b, a, w) for a, b, w in rows] if symmetric else [])


def graph_of(spark, rows, n=32):
    return Graph(spark.range(n), spark.createDataFrame(rows, "src long, dst long, w long"))


def plain_paths(rows, source, weight=lambda w: w):
    dist, queue = {source: 0}, deque([source])
    while queue:
        u = queue.popleft()
        for a, b, w in rows:
            if a == u and dist[u] + weight(w) < dist.get(b, 10**9):
                dist[b] = dist[u] + weight(w)
                queue.append(b)
    return dist


def test_paths(spark, form):
    rows = rows_of(1)
    graph = graph_of(spark, rows)
    got = {r.id: r.dist for r in traversal.sssp(graph, 0).collect()}
    want = plain_paths(rows, 0)
    assert got == {i: want.get(i) for i in range(32)}
    levels = plain_paths(rows, 0, lambda w: 1)
    for run in (traversal.bfs, traversal.bfs_direction):
        assert {r.id: r.dist for r in run(graph, 0).collect()} == {i: levels.get(i) for i in range(32)}
    assert traversal.unsettled(graph, traversal.sssp(graph, 0), "w").count() == 0
    with pytest.raises(ValueError):
        traversal.sssp(graph_of(spark, [(0, 1, -1)]), 0)
    got = {(r.source, r.id): r.dist for r in traversal.sssp_all(graph).collect()}
    assert got == {(s, i): d for s in range(32) for i, d in plain_paths(rows, s).items()}


def test_the_test_input_of_five_rows(spark, form):
    rows = [(0, 1, 3), (0, 2, 1), (1, 3, 2), (2, 1, 5), (2, 3, 2)]
    assert {r.id: r.dist for r in traversal.sssp(graph_of(spark, rows, 4), 0).collect()} == {0: 0, 1: 3, 2: 1, 3: 3}


def test_components(spark, form):
    rows = rows_of(2, m=25)
    got = {r.id: r.component for r in components.connected_components(graph_of(spark, rows)).collect()}
    assert got == {i: min(plain_paths(rows, i)) for i in range(32)}
    directed = rows_of(3, m=40, symmetric=False)
    got = {r.id: r.component for r in components.label_propagation(graph_of(spark, directed)).collect()}
    reach = [plain_paths(directed, s) for s in range(32)]
    assert got == {i: min(s for s in range(32) if i in reach[s]) for i in range(32)}


def test_long_path_and_star_contract(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, i) for i in range(1001, 1200)]
    random.Random(1).shuffle(path)
    got = {r.id: r.component for r in components.component_labels(spark.createDataFrame(path + star, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1200)}


def test_rounds_of_contraction_do_not_follow_the_diameter(spark, monkeypatch):
    """An ascending path, a grid numbered row by row and a star whose centre is the last."""
    n, side, written = 10_000, 48, []
    rows = [(i, i + 1) for i in range(n)]
    grid = [(20_000 + i * side + j, 20_000 + (i + di) * side + j + dj) for i in range(side) for j in range(side) for di, dj in ((0, 1), (1, 0)) if i + di < side and j + dj < side]
    star = [(40_000 + k, 50_000) for k in range(3000)]
    plain = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, what: written.append(what) or plain(df, what))
    got = components.component_labels(spark.createDataFrame(rows + grid + star, "src long, dst long"))
    sizes = {r.component: r["count"] for r in got.groupBy("component").count().collect()}
    assert sizes == {0: n + 1, 20_000: side * side, 40_000: 3001}
    assert written.count("cc-pointers") < 30


def test_scratch_does_not_grow_with_the_rounds(spark, monkeypatch):
    monkeypatch.setattr(engine, "COMPACT_EDGES", -1)
    monkeypatch.setattr(engine, "FOLD", 4)
    folder = scratch.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    most, plain = [0], engine.materialize
    monkeypatch.setattr(engine, "materialize", lambda df, what: (plain(df, what), most.append(len(set(os.listdir(folder)) - before)))[0])
    path = spark.createDataFrame([(i, i + 1, 1) for i in range(24)], "src long, dst long, w long")
    got = {r.id: r.dist for r in traversal.sssp(Graph(spark.range(25), path), 0).collect()}
    assert got == {i: i for i in range(25)} and max(most) <= 12


def test_a_hub_is_dealt_over_slots(spark):
    edges = spark.createDataFrame([(0, k, k) for k in range(1000)] + [(1, 2, 5)], "src long, dst long, w long")
    routes = engine.Spread(edges, limit=100)
    assert {r.src: r.slots for r in routes.heavy.collect()} == {0: 10}
    assert routes.edges.filter("src = 0").select("slot").distinct().count() == 10
    met = routes.join(spark.createDataFrame([(0, 7), (1, 8), (5, 9)], "src long, x long"))
    assert sorted((r.src, r.dst, r.w, r.x) for r in met.collect()) == sorted([(0, k, k, 7) for k in range(1000)] + [(1, 2, 5, 8)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:  # what is joined with many rows: only these move, the edges lie where they are
        plan = routes.join(spark.range(100).toDF("src"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    routes.discard()


def test_pagerank(spark, form):
    rows = rows_of(4, m=60)
    graph = graph_of(spark, rows)
    degree = defaultdict(int)
    for a, _, _ in rows:
        degree[a] += 1
    rank = {i: 1 / 32 for i in range(32)}
    for _ in range(7):
        rank = {i: 0.15 / 32 + 0.85 * sum(rank[b] / degree[b] for a, b, _ in rows if a == i and degree[b]) for i in rank}
    got = {r.id: r.rank for r in ranks.pagerank(graph, 7).collect()}
    assert all(abs(got[i] - rank[i]) < 1e-12 for i in rank)
    a = {r.id: r.rank for r in ranks.pagerank(graph, tolerance=1e-12).collect()}
    b = {r.id: r.rank for r in ranks.pagerank_async(graph).collect()}
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_betweenness(spark, form):
    rows = rows_of(5, n=14, m=24, symmetric=False)
    want = defaultdict(float)
    for s in range(14):
        level = plain_paths(rows, s, lambda w: 1)
        count = {s: 1}
        for v in sorted(level, key=level.get):
            if v != s:
                count[v] = sum(count[a] for a, b, _ in rows if b == v and a in level and level[a] + 1 == level[v])
        delta = dict.fromkeys(level, 0.0)
        for v in sorted(level, key=level.get, reverse=True):
            for a, b, _ in rows:
                if b == v and a in level and level[a] + 1 == level[v]:
                    delta[a] += count[a] / count[v] * (1 + delta[v])
        for v in level:
            want[v] += delta[v] * (v != s)
    got = {r.id: r.bc for r in ranks.betweenness(graph_of(spark, rows, 14)).collect()}
    assert all(abs(got[v] - want[v]) < 1e-9 for v in range(14))


def test_independent_set(spark, form):
    rows = rows_of(6, m=60)
    inside = set()
    for i in range(32):
        if not any(a == i and b in inside for a, b, _ in rows):
            inside.add(i)
    graph = graph_of(spark, rows)
    found = selection.independent_set(graph)
    assert {r.id for r in found.filter("in_set").collect()} == inside
    assert selection.independent_set_violations(graph, found).first() == (0, 0)


def test_forest(spark, form):
    rows = rows_of(7, m=60)
    up = list(range(32))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    want = set()
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in rows):
        if find(a) != find(b):
            up[find(a)] = find(b)
            want.add((a, b, w))
    graph = graph_of(spark, rows)
    for run in (selection.minimum_forest, lambda g: selection.minimum_forest(g, contract=False), selection.forest_by_weight):
        assert {tuple(r) for r in run(graph).collect()} == want
    tree = {r.id: r.parent for r in selection.spanning_forest(graph).collect()}
    assert sum(i == p for i, p in tree.items()) == 32 - len(want)
    assert all(i == p or any(a == p and b == i for a, b, _ in rows) for i, p in tree.items())


def kuhn(pairs):
    near, mate = defaultdict(list), {}
    for a, b in pairs:
        near[a].append(b)

    def go(a, seen):
        for b in near[a]:
            if b not in seen:
                seen.add(b)
                if b not in mate or go(mate[b], seen):
                    mate[b] = a
                    return True
        return False

    return sum(go(a, set()) for a in list(near))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matching(spark, form, seed):
    rnd = random.Random(seed)
    pairs = sorted({(2 * rnd.randrange(16), 2 * rnd.randrange(14) + 1) for _ in range(34)})
    graph = Graph.from_edges(spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, w long"))
    found = selection.matching(graph)
    got = [tuple(r) for r in found.select("src", "dst").collect()]
    assert set(got) <= set(pairs) and len(got) == len({a for a, _ in got}) == len({b for _, b in got}) == kuhn(pairs)
    cover = selection.node_cover(graph, found).first()
    assert cover.uncovered == 0 and cover.cover == cover.matched == len(got)


def edmonds_karp(rows, s, t):
    rest = defaultdict(int)
    for a, b, w in rows:
        rest[a, b] += w
    total = 0
    while True:
        back, queue = {s: None}, deque([s])
        while queue:
            u = queue.popleft()
            for (a, b), c in list(rest.items()):
                if a == u and c > 0 and b not in back:
                    back[b] = a
                    queue.append(b)
        if t not in back:
            return total
        path, v = [], t
        while back[v] is not None:
            path.append((back[v], v))
            v = back[v]
        low = min(rest[e] for e in path)
        for a, b in path:
            rest[a, b] -= low
            rest[b, a] += low
        total += low


def test_flow(spark, form):
    rows = rows_of(8, n=10, m=26, symmetric=False) + [(0, 1, 5), (8, 9, 7)]
    state = flow.max_flow(Graph.from_edges(spark.createDataFrame(rows, "src long, dst long, w long")), 0, 9)
    want = edmonds_karp(rows, 0, 9)
    assert flow.flow_value(state, 9).first()[0] == want == flow.minimum_cut(state, 9).first()[0]


def test_circuit(spark, form):
    found = netlist.parse(netlist.adder_text(5, 19, 27))
    gates = spark.createDataFrame(found["gates"], netlist.GATES)
    stimuli = spark.createDataFrame(found["stimuli"], "net string, time long, value string")
    got = {r.net: r.value for r in logic.simulate(gates, stimuli).collect()}
    assert {n: got[n] for n, _ in found["expected"]} == dict(found["expected"])
    unknown = logic.simulate(gates, stimuli.filter("net <> 'b0'"))
    assert {r.net: r.value for r in unknown.collect()}["s0"] == "X"


def test_formula(spark):
    formula = spark.createDataFrame([(0, 1, True), (0, 2, False), (1, 2, True), (1, 3, True), (2, 1, False), (2, 3, True), (3, 3, True)], "clause long, var long, positive boolean")
    values, bad = survey.solve(formula, 0.5)
    assert bad.count() == 0 and {r.var: r.value for r in values.collect()}[3]


def test_empty_graph(spark, form):
    graph = Graph.from_edges(spark.createDataFrame([], "src long, dst long, w long"))
    assert components.connected_components(graph).count() == 0
    assert ranks.pagerank(graph, 3).count() == 0 and ranks.betweenness(graph).count() == 0
    assert selection.independent_set(graph).count() == selection.minimum_forest(graph).count() == selection.matching(graph).count() == 0
    assert traversal.sssp_all(graph).count() == 0 and traversal.sssp(graph, 0).count() == 0


def test_generators_do_not_depend_on_partitions(spark):
    a = generators.random_graph(spark, 200).edges
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    b = generators.random_graph(spark, 200).edges.repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert generators.torus(spark, 5).edges.groupBy("dst").count().filter(F.col("count") != 4).count() == 0
