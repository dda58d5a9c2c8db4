"""The streaming engine: one query that takes every micro-batch through all stages.

No stage reads what another query is writing, so nothing is handed over twice: a
replayed batch starts from the tables as earlier batches left them and replaces what
it had written itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from weirgauge.config import EngineConfig
from weirgauge.schema import FLOW_SCHEMA
from weirgauge.sources.flow_table import PARTITION, flow_layout
from weirgauge.streaming.alert_stream import deliver_batch
from weirgauge.streaming.cooldown_tree import update_cooldown
from weirgauge.streaming.decode_stream import decode_batch
from weirgauge.streaming.metrics_stream import absorb_flows, add_totals
from weirgauge.streaming.tables import read_batch, write_batch

FLOW_TABLE = T.StructType([*FLOW_SCHEMA.fields, T.StructField(PARTITION, T.DateType())])


def process_flows(flows: DataFrame, batch_id: int, root: str, config: EngineConfig = EngineConfig()) -> None:
    """Flows of one batch → flow table, totals, metrics, candidates and outbox."""
    tick, detection = config.snapshot_interval_secs, config.detection
    placed = flow_layout(flows).sortWithinPartitions(PARTITION, "received_at_ms")
    write_batch(placed, f"{root}/flows", batch_id, [PARTITION])
    own = read_batch(flows.sparkSession, f"{root}/flows", FLOW_TABLE, batch_id, [PARTITION]).drop(PARTITION)
    add_totals(own, batch_id, root, tick)
    spans = absorb_flows(own, batch_id, root, detection, tick_secs=tick)
    if spans:
        update_cooldown(flows.sparkSession, root, batch_id, spans, detection.cooldown_secs, tick)
        deliver_batch(flows.sparkSession, root, batch_id, spans, detection.cooldown_secs, tick)


def process_datagrams(datagrams: DataFrame, batch_id: int, root: str, config: EngineConfig = EngineConfig()) -> None:
    flows = decode_batch(datagrams, batch_id, f"{root}/templates", config.accepted_versions)
    process_flows(flows, batch_id, root, config)


def start_engine(datagrams: DataFrame, root: str, config: EngineConfig = EngineConfig(), **trigger) -> StreamingQuery:
    """Run a datagram stream into the tables under ``root``."""
    return _start(datagrams, process_datagrams, root, config, trigger)


def start_flow_engine(flows: DataFrame, root: str, config: EngineConfig = EngineConfig(), **trigger) -> StreamingQuery:
    """The same for a stream of flows."""
    return _start(flows, process_flows, root, config, trigger)


def _start(rows: DataFrame, process, root: str, config: EngineConfig, trigger: dict) -> StreamingQuery:
    return (
        rows.writeStream.foreachBatch(lambda batch, batch_id: process(batch, batch_id, root, config))
        .option("checkpointLocation", f"{root}/checkpoint").trigger(**(trigger or {"processingTime": "10 seconds"})).start()
    )
