"""Tables fed by micro-batches: each batch owns partitions of its own.

A batch is written by dynamic partition overwrite: Spark writes it aside and moves
whole partitions into place at the commit, and a replay replaces them. So readers see
no half of a batch's partition, and a replayed batch is there once.

A table that is read again and again is kept in tiers: whenever ``FANOUT`` groups of
batches of one size are complete, they are merged into a group of the next size. Which
groups make up the batches so far follows from their number alone, so a replay merges
and reads the same ones, and a reader visits O(log batches) folders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgauge.storage import read_if_there

BATCH = "batch_id"
TIER = "tier"
FANOUT = 8


def write_batch(rows: DataFrame, path: str, batch_id: int, by: Sequence[str] = ()) -> None:
    """Write the rows of one micro-batch, or replace what a former attempt wrote.
    Partitions are ``by`` first, then the batch."""
    (rows.withColumn(BATCH, F.lit(batch_id).cast("bigint")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*by, BATCH).parquet(path))


def read_table(spark: SparkSession, path: str, schema: T.StructType, below: str | None = None) -> DataFrame:
    """What batches have written so far, with ``batch_id``. ``below`` is a pattern of
    partition folders, to list these only. ``schema`` includes the ``by`` columns."""
    full = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    return read_if_there(spark, path, full, below)


def read_batch(spark: SparkSession, path: str, schema: T.StructType, batch_id: int, by: Sequence[str] = ()) -> DataFrame:
    """The rows of one batch; only its folders are listed."""
    return read_table(spark, path, schema, "/".join([*[f"{c}=*" for c in by], f"{BATCH}={batch_id}"])).drop(BATCH)


def read_parts(spark: SparkSession, path: str, schema: T.StructType, column: str, values: Iterable) -> DataFrame:
    """The rows of some partitions of the first ``by`` column, of all batches."""
    return read_table(spark, path, schema, f"{column}={{{','.join(map(str, values))}}}")


# -- tables in tiers ---------------------------------------------------------------

def groups_of(batches: int) -> list[tuple[int, int]]:
    """``tier, last batch`` of the groups that make up the first ``batches`` batches,
    oldest first. A group of tier ``t`` has ``FANOUT**t`` batches."""
    found, at, tier = [], 0, 0
    while FANOUT ** (tier + 1) <= batches:
        tier += 1
    while tier >= 0:
        size = FANOUT ** tier
        while at + size <= batches:
            at += size
            found.append((tier, at - 1))
        tier -= 1
    return found


def _group(spark: SparkSession, path: str, schema: T.StructType, tier: int, last: int, by: str, values: Iterable | None) -> DataFrame:
    below = "*" if values is None else f"{{{','.join(map(str, values))}}}"
    rows = read_if_there(
        spark, path, T.StructType([*schema.fields, T.StructField(TIER, T.IntegerType()), T.StructField(BATCH, T.LongType())]),
        f"{TIER}={tier}/{BATCH}={last}/{by}={below}")
    return rows.select(*schema.fieldNames())


def _write_group(rows: DataFrame, path: str, tier: int, last: int, by: str) -> None:
    (rows.withColumn(TIER, F.lit(tier)).withColumn(BATCH, F.lit(last).cast("bigint")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(TIER, BATCH, by).parquet(path))


def write_tiered(rows: DataFrame, path: str, batch_id: int, by: str, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Write the rows of one batch, partitioned by ``by`` below the batch, and merge the
    groups that it completes. A row is rewritten once per tier."""
    schema, spark = rows.schema, rows.sparkSession
    _write_group(rows, path, 0, batch_id, by)
    tier, size = 1, FANOUT
    while (batch_id + 1) % size == 0:
        step = size // FANOUT
        parts = [_group(spark, path, schema, tier - 1, batch_id - n * step, by, None) for n in range(FANOUT)]
        _write_group(merge(reduce(DataFrame.unionByName, parts)), path, tier, batch_id, by)
        tier, size = tier + 1, size * FANOUT


def read_tiered(
    spark: SparkSession, path: str, schema: T.StructType, batch_id: int, by: str, values: Iterable | None = None,
) -> DataFrame:
    """The rows of the batches up to ``batch_id``, all or those in the partitions
    ``values`` of ``by``. Groups were merged by themselves, so partial rows of a key may
    be left."""
    values = None if values is None else list(values)
    parts = [_group(spark, path, schema, tier, last, by, values) for tier, last in groups_of(batch_id + 1)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def read_own(spark: SparkSession, path: str, schema: T.StructType, batch_id: int, by: str) -> DataFrame:
    """The rows that a batch has written to a table in tiers."""
    return _group(spark, path, schema, 0, batch_id, by, None)
