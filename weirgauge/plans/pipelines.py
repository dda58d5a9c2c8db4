"""End-to-end plans put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgauge.config import EngineConfig, validate_config
from weirgauge.functions.clock import timestamp_of_us
from weirgauge.operators.cooldown import apply_cooldown
from weirgauge.operators.decode import decode_flows
from weirgauge.operators.rules import candidate_alerts
from weirgauge.operators.ticks import unrolled_ticks
from weirgauge.operators.views import samples_of
from weirgauge.schema import METRIC_COLUMNS
from weirgauge.sources.datagrams import read_datagrams
from weirgauge.storage import settle
from weirgauge.streaming.alert_stream import deliver_rest, stored_alerts
from weirgauge.streaming.engine import start_engine
from weirgauge.streaming.metrics_stream import current_metrics, stored_arrivals, stored_presence


def fired_alerts(
    flows: DataFrame, config: EngineConfig = EngineConfig(), metrics: DataFrame | None = None
) -> DataFrame:
    """Flows → alerts after the cooldown.

    The candidates are few and are read several times by the cooldown, so they
    are written once: the flows are never evaluated again for them.
    """
    validate_config(config)
    candidates = candidate_alerts(flows, config.detection, config.snapshot_interval_secs, metrics)
    return apply_cooldown(settle(candidates, "candidates"), config.detection.cooldown_secs)


def alerts_from_datagrams(datagrams: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Datagrams → alerts. The flows are written once, so payloads are decoded once."""
    return fired_alerts(settle(decode_flows(datagrams, config.accepted_versions), "flows"), config)


def run_available(spark: SparkSession, capture: str, root: str, config: EngineConfig = EngineConfig(),
                  ipfix: str | None = None, files_per_batch: int | None = None) -> None:
    """Work through all captured datagrams that are there now.

    Calling this again continues with newly captured ones, whatever time they are
    from. ``files_per_batch`` bounds a micro-batch. At the end the alerts of the tick
    still open are sent too.
    """
    validate_config(config)
    root = root.rstrip("/")
    datagrams = read_datagrams(spark, capture, ipfix, streaming=True, files_per_batch=files_per_batch)
    query = start_engine(datagrams, root, config, availableNow=True)
    query.awaitTermination()
    if query.lastProgress is not None:
        deliver_rest(spark, root, query.lastProgress["batchId"], config.detection.cooldown_secs, config.snapshot_interval_secs)


def stream_samples(spark: SparkSession, root: str, config: EngineConfig = EngineConfig(), prefix: str = "") -> DataFrame:
    """Metric samples of all that a stream has taken in, as of every tick up to the newest.
    The counters come from what every batch has added per tick; flows are not read."""
    tick = config.snapshot_interval_secs
    arrived = settle(stored_arrivals(spark, root), "arrivals")
    spine = unrolled_ticks(arrived.agg(F.min("tick_us").alias("low"), F.max("tick_us").alias("high")), (tick,), tick)
    wanted = spine.select(timestamp_of_us(F.col("tick_us")).alias("tick")).distinct()
    metrics = current_metrics(spark, root).join(wanted, "tick", "left_semi").select(*METRIC_COLUMNS)
    fired = stored_alerts(spark, root, config.detection.cooldown_secs, tick)
    return samples_of(arrived, stored_presence(spark, root), metrics, fired, spine, tick, prefix)
