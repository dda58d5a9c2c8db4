"""Captured export datagrams: reading, version gate and classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgauge.functions.net import uint_be
from weirgauge.schema import DATAGRAM_SCHEMA

# Header and record sizes of the export formats, in bytes.
V5_HEADER = 24
V5_RECORD = 48
V9_HEADER = 20
IPFIX_HEADER = 16


def read_datagrams(
    spark: SparkSession, primary: str, ipfix: str | None = None, *, streaming: bool = False, fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Datagrams of one capture folder, or of two merged; both are treated alike.
    ``files_per_batch`` bounds the micro-batches of a stream."""
    def load(path: str) -> DataFrame:
        reader = spark.readStream if streaming else spark.read
        if streaming and files_per_batch is not None:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        return reader.format(fmt).schema(DATAGRAM_SCHEMA).load(path)

    merged = load(primary)
    return merged if ipfix is None else merged.unionByName(load(ipfix))


def version_of(payload: Column) -> Column:
    """Format version in the first two bytes; NULL for shorter payloads."""
    return F.when(F.length(payload) >= 2, uint_be(payload, 0, 2)).cast("int")


def version_gate(datagrams: DataFrame, accepted: Sequence[int] = ()) -> DataFrame:
    """Keep only the listed versions; an empty list lets everything through."""
    if not accepted:
        return datagrams
    return datagrams.where(version_of(F.col("payload")).isin(*accepted))


def classify_datagrams(datagrams: DataFrame) -> DataFrame:
    """Add ``kind`` (v5, v9, ipfix or NULL) and ``error`` (NULL for good rows)."""
    payload = F.col("payload")
    size, version = F.length(payload), version_of(payload)
    count = uint_be(payload, 2, 2)
    fits = F.call_function("div", size - V5_HEADER, F.lit(V5_RECORD))

    def too_short(need: int) -> Column:
        return F.concat(F.lit(f"too_short({need}, "), size.cast("string"), F.lit(")"))

    error = (
        F.when(size < 2, too_short(2))
        .when((version == 5) & (size < V5_HEADER), too_short(V5_HEADER))
        .when((version == 9) & (size < V9_HEADER), too_short(V9_HEADER))
        .when((version == 10) & (size < IPFIX_HEADER), too_short(IPFIX_HEADER))
        .when(~version.isin(5, 9, 10),
              F.concat(F.lit("unsupported_version("), version.cast("string"), F.lit(")")))
        .when((version == 5) & (size != count * V5_RECORD + V5_HEADER),
              F.concat(F.lit("length_mismatch("), count.cast("string"), F.lit(", "), fits.cast("string"), F.lit(")")))
    )
    kind = F.when(version == 5, "v5").when(version == 9, "v9").when(version == 10, "ipfix")
    return datagrams.withColumn("kind", kind).withColumn("error", error)


def decode_errors(classified: DataFrame) -> DataFrame:
    """The rejected datagrams, one row each; never affects the others."""
    return classified.where(F.col("error").isNotNull()).select(
        "seq", "received_at", "exporter_ip", "kind", "error", F.length("payload").alias("size"))
