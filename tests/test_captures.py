"""Captures made from ``events``: packed once, however often the decoders pass over them,
and in files that many tasks read."""

import os

import pytest
from pyspark.sql import functions as F

from weirgauge.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.mark.parametrize("name", [
    "decode_templated_flows_without_broadcast", "decode_templated_flows", "decode_flows", "decode_flows_long_validity",
    "decode_flows_several_sets",
])
def test_decoders_read_a_written_capture(spark, name):
    read = registry.QUERIES[name](spark, FOLDER).inputFiles()
    assert any("/capture-" in file for file in read)
    assert not [file for file in read if file.endswith("events.parquet")]


def test_a_micro_batch_of_the_stream_is_read_by_many_tasks(spark, monkeypatch):
    """A file per micro-batch would be one task's work, as it was: no batch is a single file."""
    batches, known = [], set()

    def look(spark, capture, root, **options):
        # Files as the stream would take them in: all new ones, or so many at a time.
        new = sorted(file for file in spark.read.parquet(capture).inputFiles() if file not in known)
        known.update(new)
        step = options.get("files_per_batch") or len(new)
        batches.extend(spark.read.parquet(*new[at:at + step]) for at in range(0, len(new), step))

    monkeypatch.setattr(registry, "run_available", look)
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        registry.QUERIES["stream_alerts_from_datagrams"](spark, FOLDER)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)

    first, second = batches
    assert min(len(first.inputFiles()), len(second.inputFiles())) > 1
    assert first.agg(F.max("seq")).first()[0] < second.agg(F.min("seq")).first()[0]
    packed = registry._captured(spark, FOLDER)
    assert first.unionByName(second).count() == packed.count()
