"""Binary CSR graphs (``gr``, version 1) as a Spark data source, and the other binary sinks.

Layout, little-endian: u64 version, u64 bytes an edge value, u64 nodes, u64 edges; u64 end offset of
each node; u32 target of each edge, padded to 8 bytes; the edge values. Each read partition is a
range of nodes and seeks to its part of the three arrays; pyarrow opens any file system it knows.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftgraph.plans.graph import Graph
from weftgraph.plans.scratch import materialize, qualified

HEAD, HEAD_SIZE = "<4Q", 32
SCHEMA = "src long, dst long, w long"


def _open(path: str):
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class GrReader(DataSourceReader):
    def __init__(self, path: str, parts: int):
        self.path, self.parts = path, parts

    def _head(self, f) -> tuple[int, int, int]:
        version, width, nodes, edges = struct.unpack(HEAD, f.read(HEAD_SIZE))
        if version != 1 or width not in (0, 4, 8):
            raise ValueError(f"not a version 1 graph with integer values: {version}, {width}")
        return width, nodes, edges

    def partitions(self):
        filesystem, path = _open(self.path)
        with filesystem.open_input_file(path) as f:
            _, nodes, _ = self._head(f)
        step = max(1, -(-nodes // self.parts))
        return [_Range(k, min(nodes, k + step)) for k in range(0, nodes, step)] or [_Range(0, 0)]

    def read(self, part: _Range):
        filesystem, path = _open(self.path)
        with filesystem.open_input_file(path) as f:
            width, nodes, edges = self._head(f)

            def array(at: int, kind: str, n: int) -> np.ndarray:
                f.seek(at)
                return np.frombuffer(f.read(n * np.dtype(kind).itemsize), kind)

            if part.first == part.last:
                return
            begin = 0 if not part.first else int(array(HEAD_SIZE + 8 * (part.first - 1), "<u8", 1)[0])
            ends = array(HEAD_SIZE + 8 * part.first, "<u8", part.last - part.first).astype(np.int64)
            degrees = np.diff(np.r_[begin, ends])
            outs = HEAD_SIZE + 8 * nodes
            values = outs + 4 * (edges + edges % 2)
            src = np.repeat(np.arange(part.first, part.last), degrees)
            for at in range(0, len(src), 1 << 20):
                n = min(1 << 20, len(src) - at)
                dst = array(outs + 4 * (begin + at), "<u4", n).astype(np.int64)
                w = array(values + width * (begin + at), f"<i{width}", n).astype(np.int64) if width else np.zeros(n, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(src[at : at + n]), pa.array(dst), pa.array(w, mask=None if width else np.ones(n, bool))], names=["src", "dst", "w"])


class GrSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gr"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GrReader(self.options["path"], int(self.options.get("parts", 32)))


def read_gr(spark: SparkSession, path: str, parts: int = 32) -> Graph:
    """Edges with their values (null in a graph without), vertices 0 .. n - 1."""
    spark.dataSource.register(GrSource)
    filesystem, local = _open(path)
    with filesystem.open_input_file(local) as f:
        nodes = struct.unpack(HEAD, f.read(HEAD_SIZE))[2]
    return Graph(spark.range(nodes), spark.read.format("gr").option("parts", parts).load(path))


def parse_gr(content: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray | None]:
    """(nodes, src, dst, values) of a graph in memory."""
    version, width, nodes, edges = struct.unpack_from(HEAD, content)
    if version != 1:
        raise ValueError("not a version 1 graph")
    ends = np.frombuffer(content, "<u8", nodes, HEAD_SIZE).astype(np.int64)
    outs = HEAD_SIZE + 8 * nodes
    dst = np.frombuffer(content, "<u4", edges, outs).astype(np.int64)
    w = np.frombuffer(content, f"<i{width}", edges, outs + 4 * (edges + edges % 2)).astype(np.int64) if width else None
    return nodes, np.repeat(np.arange(nodes), np.diff(np.r_[0, ends])), dst, w


def read_gr_column(graphs: DataFrame, content: str = "content") -> DataFrame:
    """(path, src, dst, w) of the graphs in a binary column, as ``binaryFile`` reads them."""

    def run(stream):
        for batch in stream:
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                _, src, dst, w = parse_gr(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(src), pa.string()), pa.array(src), pa.array(dst), pa.array(w if w is not None else [None] * len(src), pa.int64())], names=["path", "src", "dst", "w"])

    return graphs.select("path", content).mapInArrow(run, "path string, src long, dst long, w long")


def from_arrays(spark: SparkSession, ends: list[int], outs: list[int], values: list[int] | None = None) -> Graph:
    """A graph from CSR arrays on the driver: end offsets, targets, values."""
    src = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, np.asarray(ends, np.int64)])) if len(ends) else np.empty(0, np.int64)
    table = pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(outs, pa.int64()), "w": pa.array(values if values is not None else [None] * len(outs), pa.int64())})
    return Graph(spark.range(len(ends)), spark.createDataFrame(table))


def write_gr(graph: Graph, path: str, width: int = 4) -> None:
    """One file. The format has one offset array before all edges, so one task writes it, in order
    and in pieces: the degrees first, then targets, then values; none of them is held whole."""
    nodes, path = graph.size(), qualified(graph.edges.sparkSession, path)
    by_source = graph.edges.select("src", "dst", "w").repartition(1).sortWithinPartitions("src", "dst")

    def run(stream):
        filesystem, local = _open(path)
        degrees, spools = np.zeros(nodes, np.int64), (path + ".dst", path + ".val")
        opened = [filesystem.open_output_stream(_open(p)[1]) for p in spools]
        for batch in stream:
            src = batch.column(0).to_numpy(zero_copy_only=False)
            if len(src):  # in order: a batch is a range of sources
                counted = np.bincount(src - src[0])
                degrees[src[0] : src[0] + len(counted)] += counted
            opened[0].write(batch.column(1).to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            if width:
                opened[1].write(batch.column(2).to_numpy(zero_copy_only=False).astype(f"<i{width}").tobytes())
        for o in opened:
            o.close()
        edges = int(degrees.sum())
        with filesystem.open_output_stream(local) as f:
            f.write(struct.pack(HEAD, 1, width, nodes, edges))
            f.write(np.cumsum(degrees).astype("<u8").tobytes())
            for k, spool in enumerate(spools):
                with filesystem.open_input_stream(_open(spool)[1]) as s:
                    while piece := s.read(1 << 20):
                        f.write(piece)
                if not k and edges % 2:
                    f.write(b"\0" * 4)
                filesystem.delete_file(_open(spool)[1])
        yield pa.RecordBatch.from_arrays([pa.array([edges])], names=["edges"])

    by_source.mapInArrow(run, "edges long").collect()


def write_matrix(graph: Graph, path: str) -> None:
    """Binary sparse matrix: u32 n, n, nonzeros; rows; columns (from 1); f64 values, 1.0 if null. The
    format is one file, so one task writes it: thrice through the sorted edges, batch by batch."""
    n, m, path = graph.size(), graph.size_edges(), qualified(graph.edges.sparkSession, path)
    ordered = materialize(graph.edges.select("src", "dst", F.coalesce(F.col("w").cast("double"), F.lit(1.0)).alias("w")), "matrix-edges")
    if max(n, m) >= 1 << 32:
        raise ValueError("the format counts nodes and entries in 32 bits")
    parts = [ordered.select(F.lit(k).alias("part"), "src", "dst", value.alias("v")) for k, value in enumerate((F.col("src") + 1.0, F.col("dst") + 1.0, F.col("w")))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).repartition(1).sortWithinPartitions("part", "src", "dst")

    def run(stream):
        filesystem, local = _open(path)
        with filesystem.open_output_stream(local) as f:
            f.write(struct.pack("<3I", n, n, m))
            for batch in stream:
                part, v = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 3))
                f.write(v[part < 2].astype("<u4").tobytes() + v[part == 2].astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([m])], names=["edges"])

    rows.mapInArrow(run, "edges long").collect()


def read_matrix(spark: SparkSession, path: str, step: int = 1 << 20) -> DataFrame:
    """(src, dst, w) of a binary sparse matrix; tasks read ranges of its entries."""
    path = qualified(spark, path)
    filesystem, local = _open(path)
    with filesystem.open_input_file(local) as f:
        _, _, m = struct.unpack("<3I", f.read(12))

    def run(stream):
        filesystem, local = _open(path)
        for batch in stream:
            for first in batch.column(0).to_pylist():
                k = min(step, m - first * step)
                with filesystem.open_input_file(local) as f:
                    got = [np.frombuffer(f.read_at(k * size, 12 + skip * m + first * step * size), kind) for kind, size, skip in (("<u4", 4, 0), ("<u4", 4, 4), ("<f8", 8, 8))]
                yield pa.RecordBatch.from_arrays([pa.array(got[0].astype(np.int64) - 1), pa.array(got[1].astype(np.int64) - 1), pa.array(got[2])], names=["src", "dst", "w"])

    ranges = -(-m // step)
    return spark.range(0, ranges, 1, max(1, min(ranges, 4096))).mapInArrow(run, "src long, dst long, w double")


def write_sorted_graph(graph: Graph, data: str, path: str) -> None:
    """Nodes in the order of their value ``data`` (then id), renumbered from 0, as ``gr``."""
    from weftgraph.operators.components import dense_ids
    from weftgraph.plans.scratch import materialize

    to = materialize(dense_ids(graph.vertices.select(F.struct(data, "id").alias("k")), "k"), "order").select(F.col("k.id").alias("id"), F.col("place").alias("to"))
    a, b = to.toDF("src", "a"), to.toDF("dst", "b")
    own = graph.edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")
    write_gr(Graph(to.select(F.col("to").alias("id")), own), path)
