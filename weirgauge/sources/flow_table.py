"""The persistent flow table: date-partitioned Parquet, time-sorted inside files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgauge.functions.clock import date_of_ms
from weirgauge.schema import FLOW_COLUMNS, FLOW_SCHEMA

PARTITION = "flow_date"


def flow_layout(flows: DataFrame) -> DataFrame:
    return flows.select(*FLOW_COLUMNS).withColumn(PARTITION, date_of_ms(F.col("received_at_ms")))


def write_flows(flows: DataFrame, path: str, *, mode: str = "append") -> None:
    """Append flows. Sorting inside each task keeps row-group min/max narrow, so
    time-range reads skip most of a day, without a shuffle of the flows."""
    (flow_layout(flows)
     .sortWithinPartitions(PARTITION, "received_at_ms")
     .write.mode(mode).partitionBy(PARTITION).parquet(path))


def read_flows(spark: SparkSession, path: str, *, streaming: bool = False) -> DataFrame:
    schema = T.StructType([*FLOW_SCHEMA.fields, T.StructField(PARTITION, T.DateType())])
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).parquet(path)
