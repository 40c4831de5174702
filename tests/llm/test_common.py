import zlib

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import common

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize(("before", "after"), [("64m", 8 << 20), ("67108864b", 8 << 20), ("1g", 8 << 20), ("4m", "4m"), ("1000", "1000")])
def test_batches_are_narrowed_but_never_widened(spark, before, after):
    old = spark.conf.get(NAME)
    spark.conf.set(NAME, before)
    common.narrow(spark.range(1))
    assert spark.conf.get(NAME).rstrip("b") == str(after)
    spark.conf.set(NAME, old)


def test_fold_of_a_key(spark):
    rows = spark.range(50).select("id", common.crc_mod("id", 7).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 7 for r in rows)
    assert spark.range(1).select(common.crc_mod(F.lit(None).cast("long"), 7)).first()[0] == 0


def test_written_tables_survive_their_source(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/a")
    kept = common.materialize(spark.read.parquet(f"{tmp_path}/a"), "t")
    import shutil

    shutil.rmtree(f"{tmp_path}/a")
    assert kept.count() == 5 and common.materialize(kept.limit(0), "t").count() == 0
