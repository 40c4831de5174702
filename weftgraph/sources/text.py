"""Graph, sample and mesh text formats: readers to DataFrames and writers from them.

Formats in which a line's place matters are read with line numbers that hold over any number of
files and splits: places are counted per file split, and only those counts are summed up in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators.components import dense_ids
from weftgraph.plans.graph import Graph, reversed_edges
from weftgraph.plans.scratch import materialize


def numbered_lines(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """(line, value) of a file, or of part files in the order of their names, from 0; with ``keep``
    only the lines that satisfy it are counted."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
    rows = materialize((raw if keep is None else raw.filter(keep)).withColumn("_m", F.monotonically_increasing_id()), "lines")
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("_f", "_b").agg(F.count("*").alias("n")).select("_f", "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row a split
    within = F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_m")) - 1
    return rows.withColumn("_w", within).join(F.broadcast(base), ["_f", "_b"]).select((F.col("base") + F.col("_w")).alias("line"), "value")


def write_lines(rows: DataFrame, path: str, *order: str, header: list[str] | None = None) -> None:
    """The column ``value``, in order over the part files, after the header lines."""
    spark = rows.sparkSession
    body = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    if not header:
        body.select("value").write.text(path)
        return
    first = spark.createDataFrame([(h,) for h in header], "value string").coalesce(1)
    first.union(body.select("value")).write.text(path)  # a union keeps its sides' partitions in order


def _fields(value: str = "value") -> Column:
    return F.split(F.trim(F.col(value)), r"\s+")


def read_edge_list(spark: SparkSession, path: str, weight: str | None = "long") -> Graph:
    """``src dst [weight]`` a line; vertices 0 .. largest id."""
    f = _fields()
    rows = spark.read.text(path).filter(F.trim("value") != "")
    columns = [f[0].cast("long").alias("src"), f[1].cast("long").alias("dst")]
    return Graph.dense(materialize(rows.select(*columns, *([f[2].cast(weight).alias("w")] if weight else [])), "edge-list"))


def write_edge_list(edges: DataFrame, path: str) -> None:
    write_lines(edges.withColumn("value", F.concat_ws(" ", *edges.columns)), path)


def read_ranked_edges(spark: SparkSession, path: str) -> Graph:
    """``src dst`` sorted by src, without header."""
    return read_edge_list(spark, path, None)


def write_sorted_edges(edges: DataFrame, path: str) -> None:
    write_lines(edges.select("src", "dst", F.concat_ws(" ", "src", "dst").alias("value")), path, "src", "dst")


def read_counted_edges(spark: SparkSession, path: str) -> Graph:
    """Header ``V E``, then ``src dst weight``."""
    rows = numbered_lines(spark, path)
    n = int(rows.filter("line = 0").first()["value"].split()[0])
    f = _fields()
    own = rows.filter("line > 0 AND trim(value) <> ''").select(f[0].cast("long").alias("src"), f[1].cast("long").alias("dst"), f[2].cast("long").alias("w"))
    return Graph(spark.range(n), own)


def write_counted_edges(graph: Graph, path: str) -> None:
    head = [f"{graph.size()} {graph.size_edges()}"]
    write_lines(graph.edges.select("src", "dst", F.concat_ws(" ", "src", "dst", "w").alias("value")), path, "src", "dst", header=head)


def read_dimacs(spark: SparkSession, path: str) -> Graph:
    """``c`` comments, ``p sp n m``, ``a src dst w``, ids from 1 in the file and from 0 here; of
    edges between the same two vertices the last in the file stays. Other lines are an error."""
    rows = numbered_lines(spark, path)
    f = _fields()
    kind = f[0]
    known = F.when((F.trim("value") == "") | kind.isin("c", "p", "a"), kind).otherwise(F.raise_error(F.concat(F.lit("not a DIMACS line: "), F.col("value"))))
    rows = rows.withColumn("kind", known)
    n = int(rows.filter("kind = 'p'").select(f[2].alias("n")).first()["n"])
    own = rows.filter("kind = 'a'").select("line", (f[1].cast("long") - 1).alias("src"), (f[2].cast("long") - 1).alias("dst"), f[3].cast("long").alias("w"))
    return Graph(spark.range(n), own.groupBy("src", "dst").agg(F.max_by("w", "line").alias("w")))


def write_dimacs(graph: Graph, path: str) -> None:
    head = ["c graph", f"p sp {graph.size()} {graph.size_edges()}"]
    write_lines(graph.edges.select("src", "dst", F.concat_ws(" ", F.lit("a"), F.col("src") + 1, F.col("dst") + 1, F.col("w")).alias("value")), path, "src", "dst", header=head)


def read_rmat(spark: SparkSession, path: str) -> Graph:
    """``%`` comments, ``n m``, then ``id degree (neighbour weight)*``; the last of doubles stays."""
    rows = numbered_lines(spark, path, ~F.col("value").startswith("%") & (F.trim("value") != ""))
    n = int(rows.filter("line = 0").first()["value"].split()[0])
    f = F.transform(_fields(), lambda x: x.cast("long"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.floor(F.size("f") / 2) - 2), lambda k: F.struct((F.col("line") * 1_000_000 + k).alias("ord"), F.get("f", (2 * k + 2).cast("int")).alias("dst"), F.get("f", (2 * k + 3).cast("int")).alias("w")))
    own = rows.filter("line > 0").select("line", f.alias("f")).filter("size(f) > 3").select(F.col("f")[0].alias("src"), F.explode(pairs).alias("e"))
    return Graph(spark.range(n), own.groupBy("src", "e.dst").agg(F.max_by("e.w", "e.ord").alias("w")))


def _listed(graph: Graph, text: Column) -> DataFrame:
    """(id, n, list): each vertex's neighbours as text, in ascending order."""
    lists = graph.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("dst", text.alias("t")))).alias("l"))
    return graph.vertices.select("id").join(lists, "id", "left").select("id", F.coalesce(F.size("l"), F.lit(0)).alias("n"), F.coalesce(F.array_join(F.col("l.t"), " "), F.lit("")).alias("list"))


def write_rmat(graph: Graph, path: str) -> None:
    rows = _listed(graph, F.concat_ws(" ", "dst", "w"))
    write_lines(rows.select("id", F.rtrim(F.concat_ws(" ", "id", F.greatest("n", F.lit(0)), "list")).alias("value")), path, "id", header=["% graph", f"{graph.size()} {graph.size_edges()}"])


def read_adjacency_lines(spark: SparkSession, path: str, first: int = 0, comment: str | None = None, unit: bool = False) -> Graph:
    """``n m``, then a line of neighbours for each vertex in turn, ids from ``first``."""
    rows = numbered_lines(spark, path, None if comment is None else ~F.col("value").startswith(comment))
    n = int(rows.filter("line = 0").first()["value"].split()[0])
    own = rows.filter((F.col("line") > 0) & (F.trim("value") != "")).select((F.col("line") - 1).alias("src"), F.explode(_fields()).alias("d"))
    own = own.select("src", (F.col("d").cast("long") - first).alias("dst"))
    return Graph(spark.range(n), own.filter("src <> dst").withColumn("w", F.lit(1).cast("long")) if unit else own)


def read_stext(spark: SparkSession, path: str) -> Graph:
    return read_adjacency_lines(spark, path)


def read_metis(spark: SparkSession, path: str) -> Graph:
    """Ids from 1, ``%`` comments, unit weights, loops dropped."""
    return read_adjacency_lines(spark, path, 1, "%", True)


def write_adjacency_lines(graph: Graph, path: str, first: int = 0, edges: int | None = None) -> None:
    rows = _listed(graph, (F.col("dst") + first).cast("string"))
    write_lines(rows.select("id", F.col("list").alias("value")), path, "id", header=[f"{graph.size()} {graph.size_edges() if edges is None else edges}"])


def read_pbbs(spark: SparkSession, path: str) -> Graph:
    """``AdjacencyGraph``, n, m, n offsets, m targets, one a line."""
    rows = materialize(numbered_lines(spark, path), "pbbs")
    head = {r["line"]: r["value"].strip() for r in rows.filter("line < 3").collect()}
    if head[0] != "AdjacencyGraph":
        raise ValueError("not an AdjacencyGraph")
    n, m = int(head[1]), int(head[2])
    offsets = rows.filter((F.col("line") >= 3) & (F.col("line") < 3 + n)).select((F.col("line") - 3).alias("src"), F.trim("value").cast("long").alias("from"))
    outs = rows.filter((F.col("line") >= 3 + n) & (F.col("line") < 3 + n + m)).select((F.col("line") - 3 - n).alias("at"), F.trim("value").cast("long").alias("dst"))
    return Graph(spark.range(n), csr_to_edges(offsets, outs, m))


def csr_to_edges(offsets: DataFrame, outs: DataFrame, m: int) -> DataFrame:
    """(src, dst) from begin offsets (src, from) and targets (at, dst): each vertex's range of places
    is listed, and places are joined with equal places; no range join."""
    block = 1 << 16  # ends come from the next vertex, looked up within blocks and at their borders
    cut = offsets.withColumn("block", F.floor(F.col("src") / block))
    inner = cut.withColumn("to", F.lead("from").over(Window.partitionBy("block").orderBy("src")))
    firsts = cut.groupBy("block").agg(F.min("from").alias("next")).select((F.col("block") - 1).alias("block"), "next")
    ends = inner.join(firsts, "block", "left").select("src", "from", F.coalesce("to", "next", F.lit(m)).alias("to"))
    places = ends.filter("from < to").select("src", F.explode(F.sequence(F.col("from"), F.col("to") - 1)).alias("at"))
    return places.join(outs, "at").select("src", "dst")


def begin_offsets(graph: Graph) -> DataFrame:
    """(id, from): the exclusive prefix sum of degrees in id order, block by block."""
    degrees = materialize(graph.degrees().withColumn("block", F.floor(F.col("id") / (1 << 16))), "degrees")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = degrees.groupBy("block").agg(F.sum("degree").alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row per 65,536 ids
    own = Window.partitionBy("block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return degrees.join(base, "block").select("id", (F.col("base") + F.coalesce(F.sum("degree").over(own), F.lit(0))).alias("from"))


def write_pbbs(graph: Graph, path: str) -> None:
    offsets = begin_offsets(graph).select(F.lit(0).alias("k"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.col("from").cast("string").alias("value"))
    outs = graph.edges.select(F.lit(1), "src", "dst", F.col("dst").cast("string"))
    write_lines(offsets.union(outs), path, "k", "a", "b", header=["AdjacencyGraph", str(graph.size()), str(graph.size_edges())])


def read_weighted_pbbs(spark: SparkSession, path: str) -> Graph:
    """``WeightedEdgeArray``, then ``src dst w`` with a fraction as weight: millionths, truncated."""
    f = _fields()
    rows = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("WeightedEdgeArray"))
    own = rows.select(f[0].cast("long").alias("src"), f[1].cast("long").alias("dst"), (f[2].cast("decimal(30,9)") * 1_000_000).cast("long").alias("w"))
    return Graph.dense(materialize(own, "wpbbs"))


def write_weighted_pbbs(edges: DataFrame, path: str, scale: int | None = None) -> None:
    """Weights as they are, or divided by ``scale`` as fractions."""
    w = F.col("w") if scale is None else F.format_string("%.6f", F.col("w") / scale)
    write_lines(edges.select("src", "dst", F.concat_ws(" ", "src", "dst", w).alias("value")), path, "src", "dst", header=["WeightedEdgeArray"])


def read_weighted_rmat(spark: SparkSession, path: str) -> Graph:
    """A header line, then ``src dst w``: undirected, the least weight of a pair stays."""
    f = _fields()
    rows = numbered_lines(spark, path).filter("line > 0 AND trim(value) <> ''")
    own = rows.select(f[0].cast("long").alias("src"), f[1].cast("long").alias("dst"), f[2].cast("long").alias("w"))
    return Graph.from_edges(materialize(own, "wrmat")).dedupe()


def read_constraints(spark: SparkSession, path: str) -> DataFrame:
    """Two header lines, then ``no,src,dst,type,offset``."""
    f = F.split("value", ",")
    rows = numbered_lines(spark, path).filter("line > 1 AND trim(value) <> ''")
    return rows.select(*(F.trim(f[k]).cast("long").alias(c) for k, c in ((1, "src"), (2, "dst"), (3, "type"))))


def write_constraints(rows: DataFrame, path: str, variables: int) -> None:
    own = materialize(rows.select("src", "dst", "type").distinct(), "constraints")
    ids = dense_ids(own.select(F.struct("type", "src", "dst").alias("k")), "k")
    lines = ids.select("place", F.concat_ws(",", "place", "k.src", "k.dst", "k.type", F.lit(0)).alias("value"))
    write_lines(lines, path, "place", header=[str(variables), str(own.count())])


def read_libsvm(spark: SparkSession, path: str) -> DataFrame:
    """(row, target, feature, value) of ``y feature:value ..`` samples, features as they are numbered."""
    rows = numbered_lines(spark, path).filter(F.trim("value") != "")
    f = _fields()
    own = rows.select(F.col("line").alias("row"), f[0].cast("double").alias("target"), F.explode_outer(F.slice(f, 2, F.greatest(F.size(f) - 1, F.lit(0)))).alias("p"))
    pair = F.split("p", ":")
    return own.select("row", "target", pair[0].cast("int").alias("feature"), pair[1].cast("double").alias("value"))


def write_libsvm(rows: DataFrame, path: str) -> None:
    """From (row, target, feature, value)."""
    pairs = rows.filter("feature IS NOT NULL").groupBy("row", "target").agg(F.sort_array(F.collect_list(F.struct("feature", F.concat_ws(":", "feature", "value").alias("t")))).alias("l"))
    write_lines(pairs.select("row", F.concat_ws(" ", "target", F.array_join("l.t", " ")).alias("value")), path, "row")


def feature_stats(samples: DataFrame) -> DataFrame:
    """(feature, mean, min, max) over the samples that have the feature."""
    return samples.filter("feature IS NOT NULL").groupBy("feature").agg(F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """(row, features, target): white space between columns, the last is the target."""
    rows = numbered_lines(spark, path).filter(F.trim("value") != "")
    f = F.transform(_fields(), lambda x: x.cast("double"))
    return rows.select(F.col("line").alias("row"), f.alias("f")).select("row", F.slice("f", 1, F.size("f") - 1).alias("features"), F.element_at("f", -1).alias("target"))


def write_dense(rows: DataFrame, path: str) -> None:
    write_lines(rows.select("row", F.concat_ws(" ", F.concat(F.transform("features", lambda x: x.cast("string")), F.array(F.col("target").cast("string")))).alias("value")), path, "row")


def read_mesh(spark: SparkSession, stem: str) -> dict[str, DataFrame]:
    """node(id, x, y), ele(id, p1, p2, p3) and poly(id, p1, p2) of a Triangle mesh."""
    f = _fields()
    body = ~F.col("value").startswith("#") & (F.trim("value") != "")

    def rows(kind: str, *columns: tuple[str, str], skip: int = 1) -> DataFrame:
        own = numbered_lines(spark, f"{stem}.{kind}", body).filter(F.col("line") >= skip)
        return own.select(*(F.get(f, F.lit(k)).cast(t).alias(c) for k, (c, t) in enumerate(columns)))

    node = rows("node", ("id", "long"), ("x", "double"), ("y", "double"))
    ele = rows("ele", ("id", "long"), ("p1", "long"), ("p2", "long"), ("p3", "long"))
    lines = materialize(numbered_lines(spark, f"{stem}.poly", body), "poly")
    n = int(lines.filter("line = 1").first()["value"].split()[0])  # after the empty list of points
    poly = lines.filter((F.col("line") > 1) & (F.col("line") <= 1 + n)).select(*(F.get(f, F.lit(k)).cast("long").alias(c) for k, c in enumerate(("id", "p1", "p2"))))
    return {"node": node, "ele": ele, "poly": poly}


def write_mesh(mesh: dict[str, DataFrame], stem: str) -> None:
    """The three files; triangles are written counter-clockwise."""
    node, ele, poly = mesh["node"], mesh["ele"], mesh["poly"]
    write_lines(node.select("id", F.concat_ws(" ", "id", "x", "y", F.lit(0)).alias("value")), f"{stem}.node", "id", header=[f"{node.count()} 2 0 1"])
    at = lambda k: node.select(F.col("id").alias(f"p{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    full = ele.join(at(1), "p1").join(at(2), "p2").join(at(3), "p3")
    left = F.expr("(x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)") >= 0
    lines = full.select("id", F.concat_ws(" ", "id", "p1", F.when(left, F.col("p2")).otherwise(F.col("p3")), F.when(left, F.col("p3")).otherwise(F.col("p2"))).alias("value"))
    write_lines(lines, f"{stem}.ele", "id", header=[f"{ele.count()} 3 0"])
    write_lines(poly.select("id", F.concat_ws(" ", "id", "p1", "p2", F.lit(1)).alias("value")), f"{stem}.poly", "id", header=["0 2 0 1", f"{poly.count()} 1"])


def read_points(spark: SparkSession, path: str, bound: bool = True) -> DataFrame:
    """(id, x, y) of a ``.node`` file or a bare list of ``x y``; with ``bound`` three points (ids -1,
    -2, -3) of a triangle around all others are added."""
    rows = materialize(numbered_lines(spark, path, ~F.col("value").startswith("#") & (F.trim("value") != "")), "points")
    f = _fields()
    head = rows.filter("line = 0").select(F.size(f).alias("n")).first()
    if head["n"] == 2:
        own = rows.select(F.col("line").alias("id"), f[0].cast("double").alias("x"), f[1].cast("double").alias("y"))
    else:
        own = rows.filter("line > 0").select(f[0].cast("long").alias("id"), f[1].cast("double").alias("x"), f[2].cast("double").alias("y"))
    if not bound:
        return own
    box = own.agg(((F.min("x") + F.max("x")) / 2).alias("cx"), ((F.min("y") + F.max("y")) / 2).alias("cy"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)).alias("r"))
    corners = [(-1, 0.0, 20.0), (-2, -20.0, -20.0), (-3, 20.0, -20.0)]
    around = box.select(F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("id"), (F.col("cx") + dx * F.col("r")).alias("x"), (F.col("cy") + dy * F.col("r")).alias("y")) for i, dx, dy in corners))).alias("p")).select("p.*")
    return own.unionByName(around)


def symmetric_without_loops(graph: Graph) -> Graph:
    """Both directions of every edge but loops, one edge a pair and direction, the larger weight."""
    own = graph.edges.filter("src <> dst")
    return Graph(graph.vertices, own.unionByName(reversed_edges(own)).groupBy("src", "dst").agg(F.max("w").alias("w")), False)
