"""Shared helpers: table reading, keys and text bytes. Scratch tables come from the engine."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.scratch import fewer_parts, materialize, scratch_path  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: Column | str) -> Column:
    """UTF-8 bytes of a text; a null text is empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col, F.lit("")).cast("binary")


def crc_mod(key: Column | str, modulus: int) -> Column:
    """crc32 of the key written as text, modulo; a null key counts as the empty text."""
    col = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def numbered(docs: DataFrame) -> DataFrame:
    """docs, written, with a key of each row in ``_row``: ids may be null or repeated."""
    return materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")


#: Rows that may be broadcast to be dropped; more of them are joined by a shuffle.
FEW_ROWS = 1_000_000


def without(own: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of a numbered table whose ``_row`` is not among the written ones."""
    few = F.broadcast(rows) if rows.count() <= FEW_ROWS else rows
    return own.join(few, "_row", "left_anti").drop("_row")


#: Bytes of an Arrow batch that goes to a Python worker; Spark's own default is 64 MB.
BATCH_BYTES = 8 << 20


def narrow(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches held to ``BATCH_BYTES``: beside rows of text of any
    length a worker's memory then stays small. A smaller setting stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", conf.get(name).strip().lower()).groups()
    if int(number) << 10 * " kmgt".index(unit or " ") > BATCH_BYTES:
        conf.set(name, BATCH_BYTES)
    return df


def batches(column, rows: int = 2048):
    """Slices of an Arrow batch small enough to work on at once."""
    for at in range(0, column.num_rows, rows):
        yield column.slice(at, rows)
