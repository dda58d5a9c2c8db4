"""Cutting packets into their sets.

The position of a set depends on the lengths of all sets before it, which no
built-in expression follows. Packets with one set need no such walk and stay on
the JVM side. For the others the walk runs on whole Arrow batches: each step
reads the next set header of all packets still being walked. Only positions
come back from Python; the bytes are cut out on the JVM side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgauge.functions.net import uint_be
from weirgauge.sources.datagrams import IPFIX_HEADER, V5_HEADER, V9_HEADER

# Set ids and the size of a set header.
V9_TEMPLATE_SET = 0
IPFIX_TEMPLATE_SET = 2
FIRST_DATA_SET = 256
SET_HEADER = 4
# Stands for the records of a version 5 packet; no real set has this id.
V5_SET = -5

SET_LIST = T.ArrayType(T.StructType([
    T.StructField(n, T.IntegerType()) for n in ("set_idx", "set_id", "start", "size")]))
SET_ARROW = pa.struct([(n, pa.int32()) for n in ("set_idx", "set_id", "start", "size")])


def packet_bytes(packets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and the n+1 offsets of its values."""
    wide = pa.types.is_large_binary(packets.type)
    _, offsets, data = packets.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[packets.offset:packets.offset + len(packets) + 1]
    content = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return content, bounds.astype(np.int64)


def walk_sets(packets: pa.Array, header: np.ndarray) -> pa.Array:
    """Sets of each packet, in order, up to the first malformed set header."""
    content, bounds = packet_bytes(packets)
    rows = np.arange(len(packets))
    at, end = bounds[:-1] + header, bounds[1:]
    found = []
    step = 0
    while rows.size:
        live = at + SET_HEADER <= end
        rows, at, end = rows[live], at[live], end[live]
        set_id = content[at].astype(np.int64) << 8 | content[at + 1]
        length = content[at + 2].astype(np.int64) << 8 | content[at + 3]
        whole = (length >= SET_HEADER) & (at + length <= end)
        rows, at, end, set_id, length = rows[whole], at[whole], end[whole], set_id[whole], length[whole]
        found.append((rows, np.full(rows.size, step), set_id, at + SET_HEADER - bounds[rows], length - SET_HEADER))
        at = at + length
        step += 1
    row, *columns = (np.concatenate(parts) for parts in zip(*found)) if found else [np.zeros(0, np.int64)] * 5
    order = np.argsort(row, kind="stable")
    counts = np.bincount(row, minlength=len(packets))
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    values = pa.StructArray.from_arrays(
        [pa.array(c[order].astype(np.int32)) for c in columns], fields=list(SET_ARROW))
    return pa.ListArray.from_arrays(pa.array(offsets), values)


@F.arrow_udf(SET_LIST)
def _sets_of(payload: pa.Array, header: pa.Array) -> pa.Array:
    return walk_sets(payload, header.to_numpy(zero_copy_only=False).astype(np.int64))


def _one_set(set_id: Column, start: Column, size: Column) -> Column:
    return F.array(F.struct(
        F.lit(0).alias("set_idx"), set_id.cast("int").alias("set_id"),
        start.cast("int").alias("start"), size.cast("int").alias("size")))


def split_sets(classified: DataFrame, fixed_layout: bool = False) -> DataFrame:
    """Template and data sets of the well-formed packets, with ``domain`` and order.

    ``fixed_layout`` adds the records of version 5 packets as one set each, so
    that all formats are decoded in a single pass over the datagrams.
    """
    payload, size = F.col("payload"), F.length("payload")
    is_v5, is_v9 = F.col("kind") == "v5", F.col("kind") == "v9"
    kinds = ["v9", "ipfix", "v5"] if fixed_layout else ["v9", "ipfix"]
    packets = classified.where(F.col("kind").isin(*kinds) & F.col("error").isNull())
    header = F.when(is_v9, V9_HEADER).otherwise(IPFIX_HEADER)
    first_id, first_size = uint_be(payload, header, 2), uint_be(payload, header + 2, 2)
    # Whole first set, and no room for the header of a second one.
    alone = F.coalesce(
        (first_size >= SET_HEADER) & (header + first_size <= size) & (header + first_size + SET_HEADER > size),
        F.lit(False))
    walked = _sets_of(F.when(~is_v5 & ~alone, payload), header)
    sets = F.when(alone, _one_set(first_id, header + SET_HEADER, first_size - SET_HEADER)).otherwise(walked)
    if fixed_layout:
        sets = F.when(is_v5, _one_set(F.lit(V5_SET), F.lit(V5_HEADER), size - V5_HEADER)).otherwise(sets)
    listed = packets.select(
        "exporter_ip", "seq", "received_at", "kind", "payload",
        F.when(is_v9, uint_be(payload, 16, 4)).when(~is_v5, uint_be(payload, 12, 4)).alias("domain"),
        F.explode(sets).alias("set"),
    )
    template_set = F.when(is_v9, V9_TEMPLATE_SET).otherwise(IPFIX_TEMPLATE_SET)
    wanted = (F.col("set.set_id") >= FIRST_DATA_SET) | (F.col("set.set_id") == template_set) | is_v5
    return listed.where(wanted).select(
        "exporter_ip", "domain", "seq", "set.set_idx", "set.set_id", "kind", "received_at",
        F.substring(payload, F.col("set.start") + 1, F.col("set.size")).alias("body"),
    )


def data_sets(sets: DataFrame) -> DataFrame:
    wanted = (F.col("set_id") >= FIRST_DATA_SET) | (F.col("set_id") == V5_SET)
    return sets.where(wanted).select(
        "exporter_ip", "domain", F.col("set_id").alias("template_id"), "seq", "set_idx", "received_at", "body")


def template_sets(sets: DataFrame) -> DataFrame:
    return sets.where(F.col("set_id").isin(V9_TEMPLATE_SET, IPFIX_TEMPLATE_SET))
