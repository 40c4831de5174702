"""Bulk-synchronous rounds over DataFrames, and their compact form for small graphs.

A round is a join of the active rows with the edges, an aggregation of the messages and a join with
the state. What a round changes is a written table in the shared folder: plans stay one round deep,
and a lost executor costs one round at most. Tables that no later round reads are deleted. Where a graph has ``COMPACT_EDGES`` edges or fewer -
counted, not guessed - the same recurrence runs over numpy arrays in one task instead, which saves
the scheduling of a job or more per round; results are equal, and tests hold them against another.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bucketed, discard, materialize

#: 24 bytes an edge: about 100 MB in the one task.
COMPACT_EDGES = 4_000_000
#: Edges of a graph that the driver sends to every worker, where many sources are dealt over tasks: the
#: driver has 24 bytes an edge while it collects them, a worker 8, or 16 with weights.
SENT_EDGES = 8_000_000


def is_compact(edges: DataFrame) -> bool:
    """Whether a written edge table is small enough for one task."""
    return edges.count() <= COMPACT_EDGES


def is_sent(edges: DataFrame) -> bool:
    """Whether a written edge table is small enough for every worker to have."""
    return edges.count() <= (SENT_EDGES if COMPACT_EDGES >= 0 else COMPACT_EDGES)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Few rows that are much work each, dealt by the key over all cores: adaptive execution, which looks
    at bytes only, would give them to one task."""
    spark = rows.sparkSession
    parts = max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, key)


def in_one_task(df: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """kernel over all rows of a bounded table."""
    empty = pd.DataFrame({c: pd.Series(dtype="object") for c in df.columns})

    def run(stream):
        got = list(stream)
        yield kernel(pd.concat(got, ignore_index=True) if got else empty)

    return df.coalesce(1).mapInPandas(run, schema)


def numbered(edges: pd.DataFrame, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids and the endpoints as their places."""
    src, dst = edges["src"].to_numpy(np.int64), edges["dst"].to_numpy(np.int64)
    ids, at = np.unique(np.concatenate([src, dst, *more]), return_inverse=True)
    return ids, at[: len(src)], at[len(src) : 2 * len(src)]


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], active: str = "active", max_rounds: int | None = None, what: str = "state") -> DataFrame:
    """state, step(state), .. until no row is active. Each round is written; one action a round
    besides tells whether any row is active. Two rounds' tables are held at most."""
    state, rounds = materialize(state, what), 0
    while (max_rounds is None or rounds < max_rounds) and not state.filter(active).isEmpty():
        old, state, rounds = state, materialize(step(state), what), rounds + 1
        discard(old)
    return state


class Spread:
    """Edges written once, dealt by ``key``, so that no round shuffles them. A vertex with more of them
    than ``limit`` has them dealt over several slots; there are a few such vertices at most - fewer
    than edges / limit - and what is sent along their edges goes to every slot."""

    def __init__(self, edges: DataFrame, key: str = "src", limit: int | None = None):
        parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        total = edges.count()
        limit = limit or max(10_000, total // (2 * parts))
        heavy = edges.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > limit)
        self.key, self.heavy = key, materialize(heavy.select(F.col(key), F.ceil(F.col("n") / limit).cast("int").alias("slots")), "heavy")
        other = next(c for c in edges.columns if c != key)
        slot = F.coalesce(F.pmod(F.xxhash64(other), F.col("slots")), F.lit(0)).cast("int")
        self.edges = bucketed(edges.join(F.broadcast(self.heavy), key, "left").withColumn("slot", slot).drop("slots"), "spread-edges", key, "slot")

    def join(self, rows: DataFrame) -> DataFrame:
        """rows, which have the key, with each of its edges."""
        slots = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("slots"), F.lit(1)) - 1))
        sent = rows.join(F.broadcast(self.heavy), self.key, "left").withColumn("slot", slots).drop("slots")
        return sent.join(self.edges, [self.key, "slot"]).drop("slot")

    def discard(self) -> None:
        discard(self.edges, self.heavy)


#: Rounds of changes that are kept apart before they are merged into the table of all distances.
FOLD = 16


def least_paths(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(source, id, dist): the least weight of a path from each seed row (source, id, dist), for the
    vertices one reaches; edges (src, dst, w), w >= 0. All sources run in one loop.

    A round sends what changed in the last one along its edges and writes only what that improves;
    the table of all distances is rewritten every ``FOLD`` rounds, and between them only read where
    the messages meet it."""
    edges = materialize(edges.select("src", "dst", "w"), "edges")
    low = edges.agg(F.min("w")).first()[0]
    if low is not None and low < 0:
        raise ValueError("weights must not be negative")
    kind = dict(edges.dtypes)["w"]
    if is_sent(edges):
        return _least_paths_compact(edges, seeds, kind)
    routes, place = Spread(edges), ["source", "id"]
    discard(edges)

    def least(tables: list[DataFrame]) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, tables).groupBy(*place).agg(F.min("dist").alias("dist"))

    front = materialize(seeds.groupBy(*place).agg(F.min("dist").cast(kind).alias("dist")), "front")
    base, later = bucketed(front, "paths", *place), []
    while not front.isEmpty():
        sent = routes.join(front.withColumnRenamed("id", "src")).groupBy("source", F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("w")).alias("dist"))
        sent = materialize(sent, "messages")
        met = sent.select(*place)
        known = least([x.join(met, place) for x in (base, *later)]).withColumnRenamed("dist", "old")
        better = sent.join(known, place, "left").filter(F.col("old").isNull() | (F.col("dist") < F.col("old"))).select(*place, "dist")
        if not later:
            discard(front)
        front = materialize(better, "front")
        discard(sent)
        later.append(front)
        if len(later) == FOLD:
            old, base = base, bucketed(least([base, *later]), "paths", *place)
            discard(old, *later[:-1])
            later = []
    found = materialize(least([base, *later]), "paths")
    discard(base, front, *later)
    routes.discard()
    return found


#: Vertices whose values the driver and every worker hold as arrays, 8 bytes each.
PACKED_IDS = 4_000_000


def sorted_ids(vertices: DataFrame, edges: DataFrame) -> np.ndarray | None:
    """The ids of the vertices and of all ends of edges in order at the driver, or None where there are
    more than ``PACKED_IDS``."""
    ends = edges.select(F.explode(F.array(F.col("src").cast("long"), F.col("dst").cast("long"))).alias("id"))
    found = materialize(vertices.select(F.col("id").cast("long").alias("id")).union(ends).distinct(), "ids")
    ids = np.sort(found.toArrow()["id"].to_numpy()) if found.count() <= PACKED_IDS else None
    discard(found)
    return ids


def table_of(spark, schema: str, *columns: np.ndarray) -> DataFrame:
    """A frame of arrays that the driver has: sent to the workers once, cut into rows there."""
    held, names, size = spark.sparkContext.broadcast(columns), [x.split()[0] for x in schema.split(", ")], 1 << 16

    def run(stream):
        for batch in stream:
            for at in batch.column(0).to_numpy():
                yield pa.RecordBatch.from_arrays([pa.array(c[at * size : (at + 1) * size]) for c in held.value], names=names)

    blocks = -(-len(columns[0]) // size)
    return spark.range(0, blocks, 1, min(max(blocks, 1), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, schema)


class Packed:
    """Edges of any number, written once as blocks of arrays, over vertices that are places in a sorted
    array of ids. All edges with one ``key`` lie in one block, in its order. A round is one job: the driver sends an
    array of values, a row a vertex, and gets back a row for every vertex that is the key of an edge."""

    def __init__(self, edges: DataFrame, ids: np.ndarray, key: str = "src", weight: str | None = None):
        spark, other = edges.sparkSession, "dst" if key == "src" else "src"
        held = spark.sparkContext.broadcast(ids)

        def pack(stream):
            got = pa.Table.from_batches(list(stream), schema=fields)
            if not len(got):
                return
            a, b = (np.searchsorted(held.value, got[c].to_numpy()).astype(np.int32) for c in (key, other))
            order = np.lexsort((b, a))
            keys, start = np.unique(a[order], return_index=True)
            w = got[weight].to_numpy().astype(np.int64)[order] if weight else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (keys, start.astype(np.int64), b[order], w)], names=["keys", "start", "other", "w"])

        names = [key, other, *([weight] if weight else [])]
        fields = pa.schema([(c, pa.int64()) for c in names])
        rows = edges.select(*(F.col(c).cast("long").alias(c) for c in names))
        parts = max(2 * spark.sparkContext.defaultParallelism, -(-edges.count() // 1_000_000))
        self.n, self.spark, self.parts = len(ids), spark, parts
        self.blocks = materialize(rows.repartition(parts, key).mapInArrow(pack, "keys binary, start binary, other binary, w binary"), "packed")
        held.destroy()

    def each(self, kernel: Callable, values=None, kind=np.float64) -> tuple[np.ndarray, np.ndarray]:
        """(places, kernel(keys, start, other, w, values) of them in rows), one job."""
        held = self.spark.sparkContext.broadcast(values)

        def run(stream):
            for batch in stream:
                for row in zip(*(batch.column(k) for k in range(4)), strict=True):
                    keys, start, other, w = (np.frombuffer(x.as_buffer(), k) for x, k in zip(row, (np.int32, np.int64, np.int32, np.int64), strict=True))
                    found = np.ascontiguousarray(kernel(keys, start, other, w, held.value), kind)
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (keys, found)], names=["keys", "found"])

        got = self.blocks.mapInArrow(run, "keys binary, found binary").toArrow()
        held.destroy()
        keys = [np.frombuffer(x.as_buffer(), np.int32) for x in got["keys"]]
        found = [np.frombuffer(x.as_buffer(), kind).reshape(len(k), -1) for x, k in zip(got["found"], keys, strict=True)]
        return (np.concatenate(keys), np.concatenate(found)) if keys else (np.zeros(0, np.int32), np.zeros((0, 1), kind))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each vertex the sum of the values at the other ends of its edges."""
        at, found = self.each(summed_ends, values)
        out = np.zeros((self.n, *values.shape[1:]))
        out[at] = found if values.ndim > 1 else found[:, 0]
        return out

    def degrees(self) -> np.ndarray:
        at, found = self.each(lambda keys, start, other, w, values: np.diff(np.r_[start, len(other)]), kind=np.int64)
        out = np.zeros(self.n, np.int64)
        out[at] = found[:, 0]
        return out

    def discard(self) -> None:
        discard(self.blocks)


def summed_ends(keys, start, other, w, values):
    """Sums of the values at the other ends, by pieces of a bounded size where a value is a row."""
    if values.ndim == 1:
        return np.add.reduceat(values[other], start)
    out, step, end = np.empty((len(keys), values.shape[1])), max(1, (1 << 20) // values.shape[1]), np.r_[start, len(other)]
    low = 0
    while low < len(keys):
        high = max(low + 1, int(np.searchsorted(end, end[low] + step, "right")) - 1)
        if high == low + 1:  # a vertex of many edges
            out[low] = sum(values[other[at : min(at + step, end[high])]].sum(0) for at in range(end[low], end[high], step))
        else:
            out[low:high] = np.add.reduceat(values[other[end[low] : end[high]]], start[low:high] - end[low])
        low = high
    return out


class Adjacency:
    """Edges of a small graph in arrays by source and by destination, to be sent to every worker."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray | None = None):
        self.ids = np.union1d(src, dst)
        a, b = (np.searchsorted(self.ids, x).astype(np.int32) for x in (src, dst))
        self.start, self.dst, self.w = self._lists(a, b, w)
        self.end, self.src, self.back_w = self._lists(b, a, w)
        self.out_degree, self.in_degree = np.diff(self.start), np.diff(self.end)

    def _lists(self, by: np.ndarray, to: np.ndarray, w: np.ndarray | None):
        order = np.argsort(by, kind="stable")
        start = np.r_[0, np.cumsum(np.bincount(by, minlength=len(self.ids)))] if len(self.ids) else np.zeros(1, np.int64)
        return start, to[order], None if w is None else w[order]

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Places of those ids that are vertices here."""
        at = np.searchsorted(self.ids, ids)
        return at[(at < len(self.ids)) & (self.ids[np.minimum(at, len(self.ids) - 1)] == ids)] if len(self.ids) else at[:0]

    @staticmethod
    def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())

    def edges_of(self, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edge, how many of them each vertex of the frontier has)."""
        n = self.out_degree[front]
        return self._spans(self.start[front], n), n

    def edges_into(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of the edges that lead to the vertices, places in ``src`` and ``back_w``."""
        n = self.in_degree[rest]
        return self._spans(self.end[rest], n), n


def distinct_places(at: np.ndarray, n: int) -> np.ndarray:
    """np.unique of places below n, by a table where there are many."""
    if 16 * len(at) < n:
        return np.unique(at)
    met = np.zeros(n, bool)
    met[at] = True
    return np.flatnonzero(met)


def sent_adjacency(edges: DataFrame, number=np.int64):
    """A broadcast Adjacency of a table that is_sent."""
    got = edges.toArrow()
    w = got["w"].to_numpy().astype(number) if "w" in got.column_names else None
    if w is not None and w.dtype.kind == "i" and len(w) and np.abs(w).max() < 2**31:
        w = w.astype(np.int32)
    own = Adjacency(got["src"].to_numpy().astype(np.int64), got["dst"].to_numpy().astype(np.int64), w)
    return edges.sparkSession.sparkContext.broadcast(own)


def _least_paths_compact(edges: DataFrame, seeds: DataFrame, kind: str) -> DataFrame:
    """Sources are dealt over tasks; each task has the whole small graph. A round goes along the edges
    of the vertices that came nearer, or, where those are more, along the edges into all vertices that
    still can."""
    number = np.float64 if kind in ("double", "float") else np.int64
    held = sent_adjacency(edges, number)
    fields = pa.schema([("source", pa.int64()), ("id", pa.int64()), ("dist", pa.float64() if number is np.float64 else pa.int64())])

    def run(stream):
        own, far = held.value, np.iinfo(np.int64).max if number is np.int64 else np.inf
        least = own.w.min() if len(own.w) else 0
        got = [b.to_pandas() for b in stream]
        for source, some in pd.concat(got).groupby("source", sort=True) if got else ():
            known = some["id"].isin(own.ids)
            lone = some[~known].groupby("id", as_index=False)["dist"].min()  # seeds without edges
            dist = np.full(len(own.ids), far, number)
            at = own.places(some["id"].to_numpy(np.int64)[known.to_numpy()])
            np.minimum.at(dist, at, some["dist"].to_numpy(number)[known.to_numpy()])
            front = np.unique(at)
            while len(front):
                sent, rest = own.out_degree[front].sum(), None
                if sent > len(own.ids):
                    rest = np.flatnonzero(dist > dist[front].min() + least)
                if rest is not None and own.in_degree[rest].sum() < sent:
                    e, n = own.edges_into(rest)
                    to, new, old = np.repeat(rest, n), own.back_w[e], dist[own.src[e]]
                    met = old < far
                    to, new = to[met], old[met] + new[met]
                else:
                    e, n = own.edges_of(front)
                    to, new = own.dst[e], np.repeat(dist[front], n) + own.w[e]
                better = new < dist[to]
                to, new = to[better], new[better]
                np.minimum.at(dist, to, new)
                front = distinct_places(to, len(dist))
            met = np.flatnonzero(dist < far)
            ids, found = np.r_[own.ids[met], lone["id"].to_numpy(np.int64)], np.r_[dist[met], lone["dist"].to_numpy(number)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), source, np.int64)), pa.array(ids), pa.array(found)], schema=fields)

    rows = seeds.select("source", "id", F.col("dist").cast("double" if number is np.float64 else "long").alias("dist"))
    found = dealt(rows, "source").mapInArrow(run, f"source long, id long, dist {'double' if number is np.float64 else 'long'}")
    return found.withColumn("dist", F.col("dist").cast(kind))
