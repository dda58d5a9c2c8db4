"""Records of whole Arrow batches → flow columns.

A record's columns lie at offsets of its template, and records of one size follow on
each other, so the bytes of a column over all records of a batch are one gather. No
text is made on the way, and only finished flows leave the task's Python side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgauge.operators.sets import packet_bytes
from weirgauge.operators.templates import ELEMENTS, OFFSET_COLUMNS
from weirgauge.schema import FLOW_COLUMNS, FLOW_SCHEMA

STEP = 1 << 16  # records that are cut at a time; a set adds less than that again
ARROW_TYPES = {"int": pa.int32(), "bigint": pa.int64()}


def record_starts(bodies: pa.Array, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the sets, and for each record the set it is in and where it begins.
    A tail shorter than a record is padding."""
    content, bounds = packet_bytes(bodies)
    counts = np.diff(bounds) // size
    owner = np.repeat(np.arange(len(bodies)), counts)
    place = np.arange(owner.size) - np.repeat(np.cumsum(counts) - counts, counts)
    return content, owner, bounds[:-1][owner] + place * size[owner]


def big_endian(content: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Unsigned numbers of ``width`` bytes at the places ``at``."""
    value = np.zeros(at.size, np.int64)
    for k in range(width):
        value = value << 8 | content[at + k]
    return value


def cut_records(sets: pa.RecordBatch) -> pa.RecordBatch:
    """Flows of data sets with their layouts; columns that a template lacks are 0."""
    size = sets.column("total_length").to_numpy(zero_copy_only=False).astype(np.int64)
    content, owner, start = record_starts(sets.column("body"), size)
    made = {}
    for name, _, width, kind, _ in ELEMENTS:
        offsets = sets.column(f"at_{name}")
        there = offsets.is_valid().to_numpy(zero_copy_only=False)[owner]
        at = offsets.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[owner]
        value = np.zeros(owner.size, np.int64)
        value[there] = big_endian(content, (start + at)[there], width)
        made[name] = pa.array(value).cast(ARROW_TYPES[kind])
    rows = pa.array(owner)
    for name in ("exporter_ip", "received_at", "received_at_ms"):
        made[name] = sets.column(name).take(rows)
    return pa.RecordBatch.from_arrays([made[c] for c in FLOW_COLUMNS], names=FLOW_COLUMNS)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = batch.column("total_length").to_numpy(zero_copy_only=False).astype(np.int64)
        _, bounds = packet_bytes(batch.column("body"))
        steps = np.cumsum(np.diff(bounds) // size) // STEP
        edges = [0, *(np.flatnonzero(np.diff(steps)) + 1).tolist(), batch.num_rows]
        for first, end in zip(edges, edges[1:]):
            if end > first:
                yield cut_records(batch.slice(first, end - first))


def gather_records(resolved: DataFrame) -> DataFrame:
    """Resolved data sets → flows."""
    whole = resolved.where((F.col("total_length") > 0) & (F.length("body") >= F.col("total_length")))
    return whole.select(
        "exporter_ip", "received_at", F.unix_millis("received_at").alias("received_at_ms"), "body", "total_length",
        *OFFSET_COLUMNS).mapInArrow(_cut, FLOW_SCHEMA)
