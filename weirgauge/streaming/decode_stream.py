"""Datagrams of a micro-batch → flows.

Templates are the only memory. They are kept as a table of versions, not as keyed
operator state: payloads of a busy exporter then need not meet in one task, and every
micro-batch uses the same lookup as the batch decoder. A batch writes the versions that
it has received and nothing else; the table's tiers keep the folders few, and its shards
leave out other exporters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgauge.operators.decode import decode_with_layouts
from weirgauge.operators.sets import data_sets, split_sets
from weirgauge.operators.templates import (
    FIELD_LIST, SETS_PER_PACKET, TEMPLATE_KEY, parse_templates, template_history, template_layouts,
)
from weirgauge.sources.datagrams import classify_datagrams, version_gate
from weirgauge.streaming.tables import read_tiered, write_tiered

TEMPLATE_SCHEMA = T.StructType([
    T.StructField("exporter_ip", T.StringType()),
    T.StructField("domain", T.LongType()),
    T.StructField("template_id", T.IntegerType()),
    T.StructField("seq", T.LongType()),
    T.StructField("set_idx", T.IntegerType()),
    T.StructField("tmpl_idx", T.IntegerType()),
    T.StructField("fields", FIELD_LIST),
    T.StructField("total_length", T.IntegerType()),
])
VERSION_TABLE = T.StructType([*TEMPLATE_SCHEMA.fields, T.StructField("shard", T.LongType())])


SHARD = "shard"  # of exporters
SHARDS = 64


def _shard() -> Column:
    return F.pmod(F.xxhash64("exporter_ip"), F.lit(SHARDS)).cast("bigint")


def received_versions(templates: DataFrame) -> DataFrame:
    """Templates without their repeats, as rows of the table of versions."""
    history = template_history(templates)
    return history.select(
        *TEMPLATE_KEY, F.call_function("div", F.col("from_pos"), F.lit(SETS_PER_PACKET)).alias("seq"),
        (F.col("from_pos") % SETS_PER_PACKET).cast("int").alias("set_idx"),
        F.lit(0).alias("tmpl_idx"), "fields", "total_length", _shard().alias(SHARD))


def decode_batch(datagrams: DataFrame, batch_id: int, templates_path: str, accepted: Sequence[int] = ()) -> DataFrame:
    """Flows of the batch, with the template versions of this and all earlier batches."""
    spark = datagrams.sparkSession
    sets = split_sets(classify_datagrams(version_gate(datagrams, accepted)), fixed_layout=True)
    write_tiered(received_versions(parse_templates(sets)), templates_path, batch_id, SHARD, received_versions)
    shards = [r[0] for r in datagrams.select(_shard()).distinct().collect()]  # SHARDS at most
    known = read_tiered(spark, templates_path, VERSION_TABLE, batch_id, SHARD, shards or [0])
    return decode_with_layouts(data_sets(sets), template_layouts(template_history(known)))
