"""Inclusion-based points-to analysis: the least fixpoint of four kinds of constraints.

Constraints (src, dst, type): 0 dst's address goes into src; 1 src = dst; 2 src = *dst; 3 *src = dst.
Variables that must hold the same objects are one class, so facts are kept once for all of them; within a
set of flows rounds are semi-naive: only facts new in the last round meet the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.fixtures import sql
from weftgraph.plans.scratch import discard, materialize

ADDRESS, COPY, LOAD, STORE = range(4)


def _digests(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, digest): two 64-bit sums over the hashes of its distinct values."""
    h = [F.xxhash64(F.lit(seed), value).cast("decimal(38, 0)") for seed in (11, 12)]
    return rows.select(key, value).distinct().groupBy(key).agg(F.concat_ws("/", F.count("*"), *(F.sum(x) for x in h)).alias("digest"))


def _alike(facts: DataFrame, flows: DataFrame) -> DataFrame:
    """(var, cls): the coarsest classes whose members are given the same objects and take from the same
    classes, named by their smallest variable. All members end with the same objects."""
    names = facts.select("var").union(flows.select("to")).union(flows.select("from")).distinct()
    given = materialize(names.join(_digests(facts, "var", "object"), "var", "left").select("var", F.coalesce("digest", F.lit("")).alias("given")), "given")

    def named(rows: DataFrame) -> DataFrame:
        keys = [c for c in rows.columns if c != "var"]
        least = rows.groupBy(*keys).agg(F.min("var").alias("least"))
        return materialize(rows.join(least, keys).select("var", F.col("least").alias("cls")), "classes")

    classes = named(given)
    n = classes.filter("var = cls").count()
    while True:
        taken = _digests(flows.join(classes.toDF("from", "cls"), "from"), "to", "cls").toDF("var", "taken")
        # with its class so far, classes are only ever split
        finer = named(classes.join(taken, "var", "left").select("var", "cls", F.coalesce("taken", F.lit("")).alias("taken")))
        more = finer.filter("var = cls").count()
        discard(classes)
        classes = finer
        if more == n:
            discard(given)
            return classes
        n = more


def points_to_classes(constraints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(var, cls) and (cls, object): variables that take from the same sources hold the same objects, and
    these are held once. Variables that are in no constraint but as objects have no class."""
    own = materialize(constraints.select("src", "dst", "type").distinct(), "constraints")
    of = lambda kind, a, b: own.filter(F.col("type") == kind).select(F.col("src").alias(a), F.col("dst").alias(b))
    loads, stores, facts = of(LOAD, "to", "var"), of(STORE, "var", "from"), of(ADDRESS, "var", "object")
    flows = materialize(of(COPY, "to", "from"), "flows")
    while True:
        classes = _alike(facts, flows)
        lead = classes.filter("var = cls").select("var")
        given = facts.join(lead, "var", "left_semi").select(F.col("var").alias("cls"), "object")
        links = flows.join(classes.toDF("to", "a"), "to").join(classes.toDF("from", "b"), "from").filter("a <> b").select("a", "b").distinct()
        links, points = materialize(links, "links"), materialize(given, "points")
        new = points
        while not new.isEmpty():  # only what is new goes on
            sent = links.join(new.withColumnRenamed("cls", "b"), "b").select(F.col("a").alias("cls"), "object").distinct()
            found = materialize(sent.join(points, ["cls", "object"], "left_anti"), "points-new")
            grown = materialize(points.unionByName(found), "points")
            discard(points, new)
            points, new = grown, found
        discard(links, new)
        # an object that a pointer holds opens flows for the loads and stores through it
        through = lambda rows: rows.join(classes, "var").join(points, "cls")
        opened = through(loads).select("to", F.col("object").alias("from")).union(through(stores).select(F.col("object").alias("to"), "from"))
        fresh = materialize(opened.distinct().join(flows, ["to", "from"], "left_anti"), "flows-new")
        if fresh.isEmpty():
            discard(fresh, flows)
            return classes, points
        grown = materialize(flows.unionByName(fresh), "flows")
        discard(classes, points, fresh, flows)
        flows = grown


def points_to(constraints: DataFrame) -> DataFrame:
    """(var, object) pairs; offsets are not modelled."""
    classes, points = points_to_classes(constraints)
    return classes.join(points, "cls").select("var", "object")


def unsatisfied(constraints: DataFrame, points: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Certificate: how many facts the constraints demand that are missing. points are pairs (var,
    object), or (cls, object) with classes (var, cls), whose members are then counted, not listed."""
    if classes is None:
        points = points.toDF("cls", "object")
        ids = points.select("cls").union(constraints.select("src")).union(constraints.filter(F.col("type") != ADDRESS).select("dst"))
        classes = ids.distinct().select(F.col("cls").alias("var"), "cls")
    p = materialize(points.select("cls", "object"), "points")
    # what no class has is a class of its own
    known = constraints.select("src").union(constraints.select("dst")).union(p.select("object")).distinct().toDF("var")
    c = materialize(known.join(classes, "var", "left").select("var", F.when(F.col("cls").isNull(), F.struct(F.lit(1).alias("own"), F.col("var").alias("id"))).otherwise(F.struct(F.lit(0).alias("own"), F.col("cls").alias("id"))).alias("k")), "classes")
    p = materialize(p.select(F.struct(F.lit(0).alias("own"), F.col("cls").alias("id")).alias("k"), "object"), "points")
    of = lambda kind: constraints.filter(F.col("type") == kind).select("src", "dst")
    at = lambda rows, name: rows.join(c.toDF(name, f"k_{name}"), name)
    held = lambda rows, k, name: rows.join(p.toDF(k, name), k)
    need = at(of(ADDRESS), "src").select(F.col("k_src").alias("k"), F.col("dst").alias("object"), F.lit(1).cast("long").alias("n"))
    # (receiving class, giving class, for how many facts of a kind), before objects are met
    pairs = at(at(of(COPY), "src"), "dst").select(F.col("k_src").alias("to"), F.col("k_dst").alias("k"))
    pairs = pairs.union(at(held(at(at(of(LOAD), "src"), "dst"), "k_dst", "mid"), "mid").select(F.col("k_src").alias("to"), F.col("k_mid").alias("k")))
    pairs = pairs.union(at(held(at(at(of(STORE), "src"), "dst"), "k_src", "mid"), "mid").select(F.col("k_mid").alias("to"), F.col("k_dst").alias("k")))
    pairs = pairs.groupBy("to", "k").agg(F.count("*").alias("n"))
    given = held(pairs, "k", "object").select(F.col("to").alias("k"), "object", "n")
    missing = need.unionByName(given).join(p, ["k", "object"], "left_anti")
    return missing.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("missing"))


#: Nations point at their suppliers, regions copy nations, suppliers are stored through and loaded.
_FIXTURE = """SELECT CAST(s_nationkey AS BIGINT) AS src, 100 + s_suppkey AS dst, 0 AS type FROM supplier
UNION ALL SELECT CAST(50 + n_regionkey AS BIGINT), CAST(n_nationkey AS BIGINT), 1 FROM nation
UNION ALL SELECT CAST(60 + r_regionkey AS BIGINT), CAST(50 + r_regionkey AS BIGINT), 2 FROM region
UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST(50 + (n_regionkey + 1) % 5 AS BIGINT), 3 FROM nation"""


def _constraints(spark, sf_dir) -> DataFrame:
    return materialize(sql(spark, sf_dir, _FIXTURE), "fixture")


def _q_pta(spark, sf_dir):
    classes, points = points_to_classes(_constraints(spark, sf_dir))
    counted = points.groupBy("cls").agg(F.count("*").alias("objects"), F.sum("object").alias("total"))
    return classes.join(counted, "cls").select("var", "objects", "total")


def _q_verify(spark, sf_dir):
    own = _constraints(spark, sf_dir)
    classes, points = points_to_classes(own)
    return unsatisfied(own, points, classes)


QUERIES = {"pta": _q_pta, "pta_verify": _q_verify}
ORACLES = {
    "pta": f"""WITH RECURSIVE c AS ({_FIXTURE}),
t(kind, a, b) USING KEY (kind, a, b) AS (SELECT type, src, dst FROM c WHERE type < 2 UNION (
  WITH r AS (SELECT kind, a, b FROM recurring.t),
  n AS (SELECT 1 AS kind, c.src AS a, p.b FROM c JOIN r p ON p.kind = 0 AND p.a = c.dst WHERE c.type = 2
    UNION SELECT 1, p.b, c.dst FROM c JOIN r p ON p.kind = 0 AND p.a = c.src WHERE c.type = 3
    UNION SELECT 0, f.a, p.b FROM r f JOIN r p ON p.kind = 0 AND p.a = f.b WHERE f.kind = 1)
  SELECT kind, a, b FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.kind = n.kind AND r.a = n.a AND r.b = n.b)))
SELECT a AS var, count(*) AS objects, CAST(sum(b) AS BIGINT) AS total FROM t WHERE kind = 0 GROUP BY 1""",
    "pta_verify": "SELECT CAST(0 AS BIGINT) AS missing",
}
