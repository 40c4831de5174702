"""Graphs and point sets over the driver's tables: one SQL text for Spark and for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.plans.scratch import materialize

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

#: Customer - part, undirected, many components, long diameter.
SPARSE = """SELECT 2*o_custkey AS src, 2*l_partkey+1 AS dst, CAST(min(l_linenumber) AS BIGINT) AS w
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity >= 49 GROUP BY 1, 2"""
#: Customer -> supplier, dense, weighted.
BIP = """SELECT 2*o_custkey AS src, 2*l_suppkey+1 AS dst, CAST(sum(l_quantity) AS BIGINT) AS w
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2"""
#: Part -> next part of the same order, directed.
PART = """SELECT a AS src, b AS dst, count(*) AS w FROM (SELECT l_partkey AS a, lead(l_partkey) OVER
  (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem) t
WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2"""
#: User -> user of the next event, small and dense.
USER = """SELECT a AS src, b AS dst, count(*) AS w FROM (SELECT user_id AS a, lead(user_id) OVER
  (ORDER BY ts, event_id) AS b FROM events) t WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2"""
GRAPHS = {"sparse": SPARSE, "bip": BIP, "part": PART, "user": USER}


def sql(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    """A Spark SQL text over the tables it names and the given frames."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", text)}
    for t in [*used, *frames]:
        text = re.sub(rf"\b{t}\b(?!\s*\()", f"{{{t}}}", text)
    return spark.sql(text, **used, **frames)


def next_in_order(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """The rows with ``next``, the value of the row after in the order: ranges of the order are sorted
    apart, and only each range's first value goes over to the range before it."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    spread = materialize(spread, "ranges")
    inner = spread.withColumn("_next", F.lead(value).over(Window.partitionBy("_part").orderBy(*order)))
    firsts = spread.groupBy("_part").agg(F.min_by(value, F.struct(*order)).alias("_first"))  # a row a range
    over = firsts.select("_part", F.lead("_first").over(Window.orderBy("_part")).alias("_over"))
    return inner.join(over, "_part").withColumn("next", F.coalesce("_next", "_over")).drop("_part", "_next", "_over")


def edges(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "user":  # as its text says, without one task for all events
        events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "user_id")
        steps = next_in_order(events, "user_id", "ts", "event_id").filter("next IS NOT NULL AND user_id <> next")
        return steps.groupBy(F.col("user_id").alias("src"), F.col("next").alias("dst")).agg(F.count("*").alias("w"))
    return sql(spark, sf_dir, GRAPHS[name]).selectExpr("CAST(src AS BIGINT) src", "CAST(dst AS BIGINT) dst", "CAST(w AS BIGINT) w")


def cte(name: str, symmetric: bool = True) -> str:
    """Oracle text: g, e (symmetrised if asked for), v."""
    both = "SELECT src, dst, w FROM g UNION ALL SELECT dst, src, w FROM g" if symmetric else "SELECT src, dst, w FROM g"
    return f"g AS ({GRAPHS[name]}), e AS ({both}), v AS (SELECT DISTINCT src AS id FROM (SELECT src FROM g UNION ALL SELECT dst FROM g))"


#: The vertex of highest degree of e, ties to the smallest id.
HUB = "s AS (SELECT src AS id FROM e GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
