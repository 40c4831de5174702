"""Scratch tables: cutting lineage by written tables in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only on one machine, as in tests, one of our own stands in
    where that is unset; executors elsewhere would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftgraph-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark would take it to."""
    files, where = _hadoop(spark, path)
    return files.makeQualified(where).toString()


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; the file system deletes it when the driver's JVM ends."""
    path = qualified(spark, f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}")
    files, where = _hadoop(spark, path)
    files.deleteOnExit(where)
    return path


def fewer_parts(df: DataFrame) -> DataFrame:
    """df in an eighth of the session's shuffle partitions (8 at least): for tables of a few bytes a
    row, whose files would else be many and tiny."""
    return df.coalesce(max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: the lineage is cut, the
    files outlive any executor, and later joins exchange them directly."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = (path, None)
    return out


def bucketed(df: DataFrame, what: str, *keys: str) -> DataFrame:
    """Like materialize, dealt by the keys once and for all: joins and aggregations by them read the
    table as it lies."""
    spark = df.sparkSession
    path, name, n = scratch_path(spark, what), f"scratch_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._scratch = (path, name)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete scratch tables that nothing will read again; other frames are left alone."""
    for df in tables:
        path, name = getattr(df, "_scratch", (None, None))
        if name:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if path:
            files, where = _hadoop(df.sparkSession, path)
            files.delete(where, True)
