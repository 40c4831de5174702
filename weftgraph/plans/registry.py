"""Registered queries and their DuckDB oracles, keyed by operator."""

from __future__ import annotations

from weftgraph.plans import engine
from weftgraph.operators import bodies, components, flow, formats, geometry, logic, loops, partitioning, pointsto, primitives, ranks, reduce, regression, report, selection, survey, traversal

MODULES = (traversal, components, ranks, primitives, reduce, selection, flow, pointsto, logic, formats, report, loops, geometry, bodies, regression, partitioning, survey)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLES = {k: q for m in MODULES for k, q in m.ORACLES.items()}
#: Queries whose algorithm has a compact form for small graphs: here with rounds at any size. Those that
#: take a hundred rounds or more on the fixtures are left to the tests.
IN_ROUNDS = ("bfs", "sssp", "cc", "cc_labelprop", "pagerank_sync", "bc", "mis", "mst_boruvka")


def in_rounds(query):
    """The query with the bounds of all compact forms at nothing."""

    def run(spark, sf_dir):
        held = engine.COMPACT_EDGES, flow.COMPACT_FLOW
        engine.COMPACT_EDGES = flow.COMPACT_FLOW = -1
        try:
            return query(spark, sf_dir)
        finally:
            engine.COMPACT_EDGES, flow.COMPACT_FLOW = held

    return run


QUERIES |= {f"{k}_rounds": in_rounds(QUERIES[k]) for k in IN_ROUNDS}
ORACLES |= {f"{k}_rounds": ORACLES[k] for k in IN_ROUNDS if k in ORACLES}
