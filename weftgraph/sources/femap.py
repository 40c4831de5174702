"""FEMAP neutral files: blocks between lines of -1, each headed by its number.

Read are nodes (block 403), elements (404), whose records are seven lines, and nodal constraints
(406). ``.gz`` files are opened by Spark's text reader as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.scratch import materialize
from weftgraph.sources.text import numbered_lines, write_lines

NODES, ELEMENTS, CONSTRAINTS = 403, 404, 406
ELEMENT_LINES = 7


def blocks(lines: DataFrame) -> dict[int, tuple[int, int]]:
    """First line and end of the body of each block, by its number; only the border lines, two a
    block, come to the driver."""
    marks = [r["line"] for r in lines.filter(F.trim("value") == "-1").orderBy("line").collect()]
    found: dict[int, tuple[int, int]] = {}
    heads = {r["line"]: r["value"].strip() for r in lines.join(F.broadcast(lines.sparkSession.createDataFrame([(m + 1,) for m in marks], "line long")), "line").collect()} if marks else {}
    k = 0
    while k + 1 < len(marks):
        head = heads.get(marks[k] + 1, "")
        if head.isdigit():
            found[int(head)] = (marks[k] + 2, marks[k + 1])
            k += 2
        else:
            k += 1
    return found


def read_femap(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes(id, x, y, z, fixed), elements(id, property, type, topology, nodes) and
    constraints(node, dof)."""
    lines = materialize(numbered_lines(spark, path), "femap")
    where = blocks(lines)
    f = F.transform(F.split("value", ","), lambda x: F.trim(x))

    def body(number: int) -> DataFrame:
        first, end = where.get(number, (0, 0))
        return lines.filter((F.col("line") >= first) & (F.col("line") < end)).withColumn("nth", F.col("line") - first)

    number = lambda k, kind="long": F.get(f, F.lit(k)).try_cast(kind)
    nodes = body(NODES).select(number(0).alias("id"), number(11, "double").alias("x"), number(12, "double").alias("y"), number(13, "double").alias("z"), F.transform(F.slice(f, 6, 6), lambda v: v.try_cast("int") != 0).alias("fixed"))
    rows = body(ELEMENTS).withColumn("record", F.floor(F.col("nth") / ELEMENT_LINES)).withColumn("part", F.col("nth") % ELEMENT_LINES)
    head = rows.filter("part = 0").select("record", number(0).alias("id"), number(2).alias("property"), number(3).alias("type"), number(4).alias("topology"))
    listed = rows.filter("part IN (1, 2)").select("record", F.posexplode(f).alias("place", "node"), "part").withColumn("node", F.col("node").try_cast("long")).filter("node <> 0")
    own = listed.groupBy("record").agg(F.sort_array(F.collect_list(F.struct("part", "place", "node"))).alias("l"))
    elements = head.join(own, "record", "left").select("id", "property", "type", "topology", F.coalesce(F.col("l.node"), F.array().cast("array<bigint>")).alias("nodes"))
    dof = F.transform(F.slice(f, 4, 6), lambda v: v.try_cast("int") != 0)
    constraints = body(CONSTRAINTS).filter((F.size(f) >= 10) & (number(0) > 0)).select(number(0).alias("node"), dof.alias("dof"))
    return {"nodes": nodes, "elements": elements, "constraints": constraints}


def write_femap(nodes: DataFrame, elements: DataFrame, path: str) -> None:
    """A file of nodes (id, x, y, z) and of triangles (id, p1, p2, p3)."""
    zeros = lambda n: ",".join(["0"] * n)
    first = nodes.select(F.lit(0).alias("k"), "id", F.lit(0).alias("part"), F.concat_ws(",", "id", F.lit("0,0,1,46"), F.lit(zeros(6)), "x", "y", "z", F.lit("0,")).alias("value"))
    record = F.array(
        F.concat_ws(",", "id", F.lit("124,1,17,2,1"), F.lit(zeros(7)), F.lit("")),
        F.concat_ws(",", "p1", "p2", "p3", F.lit(zeros(7)), F.lit("")),
        F.lit(zeros(10) + ","),
        *[F.lit("0.,0.,0.,")] * 3,
        F.lit(zeros(16) + ","),
    )
    second = elements.select(F.lit(1).alias("k"), "id", F.posexplode(record).alias("part", "value"))
    spark = nodes.sparkSession
    border = spark.createDataFrame([(0, -1, 0, "   -1"), (0, -1, 1, f"   {NODES}"), (0, 1 << 60, 0, "   -1"), (1, -1, 0, "   -1"), (1, -1, 1, f"   {ELEMENTS}"), (1, 1 << 60, 0, "   -1")], "k int, id long, part int, value string")
    write_lines(first.unionByName(second).unionByName(border), path, "k", "id", "part")
