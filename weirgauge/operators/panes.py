"""All pane sums of flows in one pass.

A pane row is about an endpoint side, a protocol or the contacts of a source with a word
of 64 ports, a bitmap. One scan and one aggregation make all of them; metrics, talkers and scanners follow from
them, in batch and in streams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgauge.config import TICK_SECS, TOP_TALKERS, WINDOW_SECS
from weirgauge.functions.net import has_bits
from weirgauge.functions.numbers import saturating_minus
from weirgauge.operators.metrics import (
    ACK, DST, SRC, SYN, TCP, TRAFFIC_SUMS, contact_spans, metrics_from_panes, port_bit, port_word,
)
from weirgauge.operators.ticks import event_us, first_tick, pane_moment, pane_secs, unrolled_ticks

# Topics besides the endpoint sides SRC and DST.
PROTOCOL = 2
CONTACT = 3
PANE_KEY = ["topic", "key", "sub"]
PANE_SCHEMA = T.StructType([
    T.StructField("moment_us", T.LongType()),
    T.StructField("topic", T.IntegerType()),
    T.StructField("key", T.LongType()),
    T.StructField("sub", T.IntegerType()),
    *[T.StructField(name, T.LongType()) for name in TRAFFIC_SUMS],
    T.StructField("ports", T.LongType()),
])


def merge_panes(rows: DataFrame) -> DataFrame:
    """Partial pane rows → one row per pane and key."""
    return rows.groupBy("moment_us", *PANE_KEY).agg(
        *[F.sum(c).alias(c) for c in TRAFFIC_SUMS], F.bit_or("ports").alias("ports"))


def pane_rows(flows: DataFrame, windows: Sequence[int] = WINDOW_SECS, tick_secs: int = TICK_SECS,
              contacts: bool = True) -> DataFrame:
    """Sums and port bitmaps per pane moment, topic and key; without ``contacts`` no
    contact rows."""
    is_tcp = F.col("protocol") == TCP
    syn_only = is_tcp & has_bits(F.col("tcp_flags"), SYN) & ~has_bits(F.col("tcp_flags"), ACK)
    zero = F.lit(0).cast("bigint")

    def topic(number: int, key, sub=None):
        full = number == PROTOCOL
        return F.struct(
            F.lit(number).alias("topic"), key.cast("bigint").alias("key"),
            (F.lit(0) if sub is None else sub).cast("int").alias("sub"),
            (F.lit(1).cast("bigint") if full else zero).alias("flows"),
            (F.col("packets") if full else zero).alias("packets"),
            (F.col("bytes") if number != CONTACT else zero).alias("bytes"),
            (F.when(syn_only, 1).otherwise(0).cast("bigint") if full else zero).alias("syn_only_flows"),
            (F.when(is_tcp, saturating_minus(F.col("end_time"), F.col("start_time"))).otherwise(zero)
             if full else zero).alias("duration_ms"),
            (port_bit(F.col("dst_port")) if number == CONTACT else zero).alias("ports"),
        )

    topics = [topic(SRC, F.col("src_ip")), topic(DST, F.col("dst_ip")), topic(PROTOCOL, F.col("protocol"))]
    if contacts:
        topics.append(topic(CONTACT, F.col("src_ip"), port_word(F.col("dst_port"))))
    moment = pane_moment(event_us(flows), pane_secs(windows, tick_secs))
    rows = flows.select(moment.alias("moment_us"), F.explode(F.array(*topics)).alias("t")).select("moment_us", "t.*")
    return merge_panes(rows)


def pane_metrics(panes: DataFrame, windows: Sequence[int] = WINDOW_SECS, tick_secs: int = TICK_SECS,
                 top_n: int = TOP_TALKERS, keep_empty: bool = True) -> DataFrame:
    """Pane rows → one metrics row per (window size, tick). Partial rows of one pane,
    from several batches, add up. ``keep_empty`` as in ``window_metrics``."""
    protocols = panes.where(F.col("topic") == PROTOCOL).select(
        "moment_us", F.col("key").cast("int").alias("protocol"), *TRAFFIC_SUMS)
    endpoints = panes.where(F.col("topic").isin(SRC, DST)).select(
        "moment_us", F.col("topic").alias("side"), F.col("key").alias("ip"), "bytes")
    spine = pane_spine(panes, windows, tick_secs) if keep_empty else None
    return metrics_from_panes(protocols, endpoints, windows, tick_secs, top_n, spine)


def pane_contacts(panes: DataFrame, windows: Sequence[int], tick_secs: int = TICK_SECS) -> DataFrame:
    """Spans with the distinct destination ports of each source."""
    contacts = panes.where(F.col("topic") == CONTACT).select(
        "moment_us", F.col("key").alias("src_ip"), F.col("sub").alias("word"), "ports")
    return contact_spans(contacts, windows, tick_secs)


def pane_spine(panes: DataFrame, windows: Sequence[int] = WINDOW_SECS, tick_secs: int = TICK_SECS) -> DataFrame:
    """``tick_spine`` from pane rows: a pane's moment has the first tick of its flows."""
    return unrolled_ticks(panes.agg(
        first_tick(F.min("moment_us"), tick_secs).alias("low"), first_tick(F.max("moment_us"), tick_secs).alias("high")),
        windows, tick_secs)
