"""Reductions, sorts and selections: partial per task, then combined, as Spark aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.plans.fixtures import sql
from weftgraph.plans.scratch import materialize


def count_if(df: DataFrame, condition: Column | str, name: str = "n") -> DataFrame:
    return df.agg(F.count_if(F.expr(condition) if isinstance(condition, str) else condition).alias(name))


def find_if(df: DataFrame, condition: Column | str) -> DataFrame:
    """Any row that satisfies the condition, none if there is none."""
    return df.filter(condition).limit(1)


def map_reduce(df: DataFrame, mapped: Column, reduce: Callable[[Column], Column], name: str) -> DataFrame:
    return df.select(mapped.alias("_v")).agg(reduce(F.col("_v")).alias(name))


def vector_sum(df: DataFrame, vector: str, *by: str) -> DataFrame:
    """(by.., place, total): element-wise sum of vectors of any lengths."""
    return df.select(*by, F.posexplode(vector).alias("place", "_v")).groupBy(*by, "place").agg(F.sum("_v").alias("total"))


def online_stat(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Count, mean, sample and population variance."""
    return df.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.var_samp(column).alias("var_samp"), F.var_pop(column).alias("var_pop"))


def partition(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy the condition, and the others (a null condition included)."""
    held = F.coalesce(condition, F.lit(False))
    return df.filter(held), df.filter(~held)


def nth_element(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The k first rows of the order; k is the feature, and only k rows a task reach the last."""
    return df.orderBy(*order).limit(k)


def sorted_places(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df in the order, and the place of each row from 0: ranges are sorted apart, and what goes between
    them is the number of rows of each. No task holds more than its range."""
    spread = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = spread.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))  # a row a range
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return spread.withColumn("_nth", within).join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_nth")).drop("_part", "_base", "_nth")


def morton(x: Column, y: Column, bits: int = 16) -> Column:
    """Bits of two non-negative integers, interleaved, x lowest."""

    def spread(v: Column) -> Column:
        v = v.cast("long").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def z_order(df: DataFrame, x: Column, y: Column, partitions: int | None = None) -> DataFrame:
    """Rows laid out by the Morton code of two columns: ranges of the curve, sorted within each."""
    coded = df.withColumn("z", morton(x, y))
    dealt = coded.repartitionByRange(partitions, "z") if partitions else coded.repartitionByRange("z")
    return dealt.sortWithinPartitions("z")


def feature_scale(df: DataFrame, *columns: str) -> DataFrame:
    """(x - mean) / (max - min) of each column; a constant column is 0."""
    stats = df.agg(*(f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("a", F.avg), ("l", F.min), ("h", F.max))))
    scaled = {c: F.coalesce((F.col(c) - F.col(f"_a_{c}")) / F.nullif(F.col(f"_h_{c}") - F.col(f"_l_{c}"), F.lit(0.0)), F.when(F.col(c).isNotNull(), F.lit(0.0))) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(scaled).select(*df.columns)  # one row


def bounding_box(df: DataFrame, *axes: str) -> DataFrame:
    """Least and greatest of each axis, the centre, and the longest side."""
    out = df.agg(*(f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))))
    out = out.withColumns({f"mid_{a}": (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 for a in axes})
    sides = [F.col(f"max_{a}") - F.col(f"min_{a}") for a in axes]
    return out.withColumn("diameter", F.greatest(*sides) if len(sides) > 1 else sides[0])


def _lines(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _vectors(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")))


def _q_partition(spark, sf_dir):
    yes, no = partition(_lines(spark, sf_dir), F.col("l_quantity") >= 25)
    total = lambda df, side: df.agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity")).withColumn("side", F.lit(side))
    return total(yes, "yes").unionByName(total(no, "no"))


def _q_zorder(spark, sf_dir):
    own = z_order(_lines(spark, sf_dir), F.col("l_partkey"), F.col("l_suppkey"))
    return own.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "z")


def _q_scale(spark, sf_dir):
    own = feature_scale(_lines(spark, sf_dir).select("l_orderkey", "l_quantity", "l_discount", "l_tax"), "l_quantity", "l_discount", "l_tax")
    return own.select("l_orderkey", *(F.round(c, 9).alias(c) for c in ("l_quantity", "l_discount", "l_tax")))


_SORT = "SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) - 1 AS place FROM lineitem"
QUERIES = {
    "a_countif": lambda s, d: count_if(_lines(s, d), "l_quantity > 30"),
    "a_findif": lambda s, d: find_if(s.read.parquet(f"{d}/events.parquet"), "event_id = 42").select("event_id", "user_id", "event_type"),
    "a_accum": lambda s, d: _lines(s, d).agg(F.sum(F.col("l_quantity").cast("long")).alias("total"), F.max("l_partkey").alias("top")),
    "a_mapred": lambda s, d: map_reduce(_lines(s, d), F.col("l_partkey") * F.col("l_linenumber"), F.max, "top"),
    "a_sum": lambda s, d: _lines(s, d).agg(F.sum("l_partkey").alias("total")),
    "a_max": lambda s, d: _lines(s, d).agg(F.max("l_extendedprice").alias("top")),
    "a_min": lambda s, d: _lines(s, d).agg(F.min(-F.col("l_extendedprice")).alias("least")),
    "a_reduce": lambda s, d: s.read.parquet(f"{d}/orders.parquet").groupBy("o_orderstatus").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("dearest")),
    "a_set": lambda s, d: _lines(s, d).groupBy("l_returnflag").agg(F.array_join(F.sort_array(F.collect_set("l_linestatus")), ",").alias("seen")),
    "a_vec": lambda s, d: s.read.parquet(f"{d}/nation.parquet").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names")),
    "a_vecelem": lambda s, d: vector_sum(s.read.parquet(f"{d}/embeddings.parquet").select("label", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000)).alias("v")), "v", "label"),
    "a_mapelem": lambda s, d: _lines(s, d).groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("total")),
    "a_welford": lambda s, d: online_stat(_lines(s, d), "l_quantity", "l_returnflag").select("l_returnflag", "n", *(F.round(c, 6).alias(c) for c in ("mean", "var_samp", "var_pop"))),
    "a_atomic": lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.count("*").alias("increments"), F.max_by("event_id", "ts").alias("last_write")),
    "s_sort": lambda s, d: sorted_places(_lines(s, d).select("l_orderkey", "l_linenumber", "l_extendedprice"), "place", F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"),
    "s_part": _q_partition,
    "s_nth": lambda s, d: nth_element(s.read.parquet(f"{d}/orders.parquet"), 50, "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice"),
    "s_pq": lambda s, d: sql(s, d, "SELECT user_id, min(struct(ts, event_id)).event_id AS first_event FROM events GROUP BY 1"),
    "s_zorder": _q_zorder,
    "feat_scale": _q_scale,
    "bbox": lambda s, d: bounding_box(_vectors(s, d), "x", "y", "z"),
}


def _spread_sql(c: str) -> str:
    return " + ".join(f"((({c} >> {k}) & 1) << {2 * k})" for k in range(16))


_SCALED = ", ".join(f"round(({c} - avg({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 9) AS {c}" for c in ("l_quantity", "l_discount", "l_tax"))
ORACLES = {
    "a_countif": "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 30",
    "a_findif": "SELECT event_id, user_id, event_type FROM events WHERE event_id = 42",
    "a_accum": "SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, max(l_partkey) AS top FROM lineitem",
    "a_mapred": "SELECT max(l_partkey * l_linenumber) AS top FROM lineitem",
    "a_sum": "SELECT CAST(sum(l_partkey) AS BIGINT) AS total FROM lineitem",
    "a_max": "SELECT max(l_extendedprice) AS top FROM lineitem",
    "a_min": "SELECT min(-l_extendedprice) AS least FROM lineitem",
    "a_reduce": "SELECT o_orderstatus, o_orderkey AS dearest FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey DESC) = 1",
    "a_set": "SELECT l_returnflag, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS seen FROM lineitem GROUP BY 1",
    "a_vec": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1",
    "a_vecelem": "SELECT label, CAST(i - 1 AS INTEGER) AS place, CAST(sum(CAST(floor(CAST(embedding[i] AS DOUBLE) * 1000) AS BIGINT)) AS BIGINT) AS total FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2",
    "a_mapelem": "SELECT l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY 1",
    "a_welford": "SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS var_samp, round(var_pop(l_quantity), 6) AS var_pop FROM lineitem GROUP BY 1",
    "a_atomic": "SELECT user_id, count(*) AS increments, arg_max(event_id, ts) AS last_write FROM events GROUP BY 1",
    "s_sort": _SORT,
    "s_part": "SELECT CASE WHEN l_quantity >= 25 THEN 'yes' ELSE 'no' END AS side, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1",
    "s_nth": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50",
    "s_pq": "SELECT user_id, arg_min(event_id, ts) AS first_event FROM events GROUP BY 1",
    "s_zorder": f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_spread_sql('l_partkey')} + 2 * ({_spread_sql('l_suppkey')}) AS z FROM lineitem",
    "feat_scale": f"SELECT l_orderkey, {_SCALED} FROM lineitem",
    "bbox": """WITH p AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
b AS (SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM p)
SELECT *, (min_x + max_x) / 2 AS mid_x, (min_y + max_y) / 2 AS mid_y, (min_z + max_z) / 2 AS mid_z, greatest(max_x - min_x, max_y - min_y, max_z - min_z) AS diameter FROM b""",
}
