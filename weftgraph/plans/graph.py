"""The graph model: vertices(id, ..) and edges(src, dst, ..) as plain DataFrames, a multigraph.

Every primitive is a join, an aggregation or a union that Catalyst plans; ids are BIGINT.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    directed: bool = True

    @staticmethod
    def from_edges(edges: DataFrame, vertices: DataFrame | None = None, directed: bool = True) -> Graph:
        """Vertices are the distinct endpoints unless given."""
        if vertices is None:
            vertices = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        return Graph(vertices, edges, directed)

    @staticmethod
    def dense(edges: DataFrame, n: int | None = None) -> Graph:
        """Vertices 0 .. n - 1, or up to the largest endpoint."""
        spark = edges.sparkSession
        if n is None:
            top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
            n = 0 if top is None else top + 1
        return Graph(spark.range(n), edges)

    # nodes and their values
    def size(self) -> int:
        return self.vertices.count()

    def size_edges(self) -> int:
        return self.edges.count()

    def summary(self) -> DataFrame:
        return self.vertices.agg(F.count("*").alias("num_nodes")).crossJoin(self.edges.agg(F.count("*").alias("num_edges")))

    def with_data(self, name: str, value: Column | DataFrame) -> Graph:
        """A node value: an expression, or a frame of (id, value) with null where it has none."""
        if isinstance(value, Column):
            return replace(self, vertices=self.vertices.withColumn(name, value))
        return replace(self, vertices=self.vertices.join(value.toDF("id", name), "id", "left"))

    # neighbourhoods
    def degrees(self) -> DataFrame:
        """(id, degree) of out-edges, zeros included."""
        counted = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        return self.vertices.select("id").join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def out_edges(self) -> DataFrame:
        """Each vertex with each of its out-edges."""
        return self.vertices.join(self.edges, self.vertices.id == self.edges.src)

    def triplets(self) -> DataFrame:
        """Edges with both endpoints' values, as src_<name> and dst_<name>."""
        names = [c for c in self.vertices.columns if c != "id"]
        left = self.vertices.select(F.col("id").alias("src"), *(F.col(c).alias(f"src_{c}") for c in names))
        right = self.vertices.select(F.col("id").alias("dst"), *(F.col(c).alias(f"dst_{c}") for c in names))
        return self.edges.join(left, "src").join(right, "dst")

    def has_neighbor(self, pairs: DataFrame) -> DataFrame:
        """The pairs (src, dst) that are edges."""
        return pairs.join(self.edges.select("src", "dst"), ["src", "dst"], "left_semi")

    def contains_node(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.vertices.select("id"), "id", "left_semi")

    def has_out(self) -> DataFrame:
        """Vertices with an out-edge at least."""
        return self.vertices.join(self.edges.select(F.col("src").alias("id")), "id", "left_semi")

    def sorted_adjacency(self, *order: str) -> DataFrame:
        """Edges with their place among the out-edges of src, by the given columns and dst."""
        return self.edges.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy(*order, "dst")) - 1)

    def adjacency(self) -> DataFrame:
        """(src, neighbours) with the neighbours in ascending order. A list is one vertex's."""
        return self.edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))

    # mutation: a new graph each time
    def add_nodes(self, ids: DataFrame) -> Graph:
        new = ids.join(self.vertices.select("id"), "id", "left_anti")
        return replace(self, vertices=self.vertices.unionByName(new, allowMissingColumns=True))

    def add_edges(self, new: DataFrame, multi: bool = False) -> Graph:
        """Upsert, the new value replacing the old; or append where parallel edges are wanted."""
        if multi:
            return replace(self, edges=self.edges.unionByName(new))
        kept = self.edges.join(new.select("src", "dst"), ["src", "dst"], "left_anti")
        return replace(self, edges=kept.unionByName(new))

    def remove_nodes(self, ids: DataFrame) -> Graph:
        gone = ids.select("id").distinct()
        rest = self.edges.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti")
        return replace(self, vertices=self.vertices.join(gone, "id", "left_anti"), edges=rest.select(*self.edges.columns))

    def remove_edges(self, pairs: DataFrame) -> Graph:
        return replace(self, edges=self.edges.join(pairs.select("src", "dst"), ["src", "dst"], "left_anti"))

    # whole-graph rewrites
    def reverse(self) -> Graph:
        return replace(self, edges=reversed_edges(self.edges))

    def symmetrize(self) -> Graph:
        """Every edge and its reverse; nothing is deduped, a loop becomes two."""
        return replace(self, edges=self.edges.unionByName(reversed_edges(self.edges)), directed=False)

    def drop_loops(self) -> Graph:
        return replace(self, edges=self.edges.filter("src <> dst"))

    def dedupe(self, order: str | None = None) -> Graph:
        """Undirected: one edge (least, greatest) for each pair, loops dropped, with the smallest
        weight or that of the first edge by ``order``."""
        pair = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
        kept = F.min("w") if order is None else F.min_by("w", order)
        return replace(self, edges=self.edges.filter("src <> dst").groupBy(*pair).agg(kept.alias("w")), directed=False)

    def residual(self) -> Graph:
        """With an edge of capacity 0 wherever the reverse of an edge is missing."""
        back = reversed_edges(self.edges).select("src", "dst").distinct()
        missing = back.join(self.edges.select("src", "dst"), ["src", "dst"], "left_anti")
        return replace(self, edges=self.edges.unionByName(missing.withColumn("w", F.lit(0).cast("long"))))

    def contract(self, mapping: DataFrame, weight: str = "sum") -> Graph:
        """Endpoints through mapping(id, to); inner edges go, parallel ones merge by sum or min."""
        a, b = mapping.toDF("src", "a"), mapping.toDF("dst", "b")
        merged = self.edges.join(a, "src").join(b, "dst").filter("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst"))
        found = merged.agg((F.sum("w") if weight == "sum" else F.min("w")).alias("w"))
        return Graph(mapping.select(F.col("to").alias("id")).distinct(), found, self.directed)

    def subgraph(self, parts: DataFrame) -> Graph:
        """Edges within a part of parts(id, part), with that part."""
        a, b = parts.toDF("src", "part"), parts.toDF("dst", "part_")
        inner = self.edges.join(a, "src").join(b, "dst").filter("part = part_").drop("part_")
        return replace(self, vertices=self.vertices.join(parts, "id"), edges=inner)


def reversed_edges(edges: DataFrame) -> DataFrame:
    swapped = {"src": "dst", "dst": "src"}
    return edges.select(*(F.col(swapped.get(c, c)).alias(c) for c in edges.columns))
