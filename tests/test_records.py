import random

import numpy as np
import pyarrow as pa
import pytest
from moments import T0, moment
from pyspark.sql import types as T

from weirgauge.operators import records
from weirgauge.operators.decode import map_fields, slice_records
from weirgauge.operators.records import big_endian, cut_records, gather_records, record_starts
from weirgauge.operators.templates import ELEMENTS, OFFSET_COLUMNS
from weirgauge.schema import FLOW_COLUMNS, FLOW_SCHEMA

WIDTH = {name: width for name, _, width, _, _ in ELEMENTS}
RESOLVED = T.StructType([
    T.StructField("exporter_ip", T.StringType()), T.StructField("received_at", T.TimestampType()),
    T.StructField("body", T.BinaryType()), T.StructField("total_length", T.IntegerType()),
    *[T.StructField(c, T.IntegerType()) for c in OFFSET_COLUMNS]])


def odd_sets(seed, count):
    """Sets of any layout: columns that are missing or overlap, tails, no whole record."""
    rng = random.Random(seed)
    for n in range(count):
        size = rng.choice([4, 5, 17, 48, 300])
        at = [None if rng.random() < 0.3 else rng.randrange(size - WIDTH[c[3:]] + 1) for c in OFFSET_COLUMNS]
        body = rng.randbytes(rng.choice([0, 1, size - 1, size, size + 1, 3 * size, 7 * size + 3]))
        yield (f"10.0.0.{n % 3}", moment(T0 + n), body, size, *at)


@pytest.mark.parametrize("seed", range(3))
def test_gathered_records_are_those_cut_as_text(spark, seed):
    sets = spark.createDataFrame(list(odd_sets(seed, 200)), RESOLVED)
    left, right = gather_records(sets), map_fields(slice_records(sets))
    assert left.schema == right.schema == FLOW_SCHEMA
    assert left.count() > 200 and left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def test_sizes_and_bodies_that_are_none(spark):
    rows = [("e", moment(T0), body, size, *[0] * len(OFFSET_COLUMNS))
            for body, size in [(None, 48), (b"", 48), (b"\1" * 47, 48), (b"\1" * 48, 0), (b"\1" * 48, None)]]
    assert gather_records(spark.createDataFrame(rows, RESOLVED)).count() == 0
    assert gather_records(spark.createDataFrame([], RESOLVED)).columns == FLOW_COLUMNS


def test_largest_numbers():
    content = np.frombuffer(b"\xff" * 8 + b"\x01\x02\x03\x04", np.uint8)
    assert big_endian(content, np.array([0, 8]), 4).tolist() == [2**32 - 1, 0x01020304]
    assert big_endian(content, np.array([0]), 1).tolist() == [255]


def test_starts_of_a_slice():
    """A slice of a column keeps the bytes of the whole one."""
    bodies = pa.array([b"abc", b"", b"defgh", b"ij"], pa.binary()).slice(1)
    content, owner, start = record_starts(bodies, np.array([2, 2, 2]))
    assert owner.tolist() == [1, 1, 2]
    assert [bytes(content[s:s + 2]) for s in start] == [b"de", b"fg", b"ij"]


def test_batches_are_cut_in_steps(monkeypatch):
    def batch(bodies):
        n = len(bodies)
        given = {"exporter_ip": pa.array(["e"] * n), "received_at": pa.array([0] * n, pa.timestamp("us", "UTC")),
                 "received_at_ms": pa.array([0] * n, pa.int64()), "body": pa.array(bodies, pa.binary()),
                 "total_length": pa.array([17] * n, pa.int32()),
                 **{c: pa.array([0] * n, pa.int32()) for c in OFFSET_COLUMNS}}
        return pa.RecordBatch.from_pydict(given)

    sets = batch([bytes([n]) * (17 * (n % 5 + 1)) for n in range(40)])
    whole = cut_records(sets)
    monkeypatch.setattr(records, "STEP", 7)
    parts = list(records._cut(iter([sets, batch([])])))
    assert len(parts) > 5 and max(p.num_rows for p in parts) <= 7 + 5
    assert pa.Table.from_batches(parts).to_pylist() == whole.to_pylist()
