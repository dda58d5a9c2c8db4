"""Totals, exporter liveness, events and time-range reads of flows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirgauge.config import EXPORTER_ACTIVE_SECS
from weirgauge.functions.clock import date_of_ms, rfc3339_argument_ms, rfc3339_text, whole_second_text
from weirgauge.functions.net import ip_text
from weirgauge.schema import FLOW_COLUMNS
from weirgauge.sources.flow_table import PARTITION

DEFAULT_LIMIT = 100
MAX_LIMIT = 1000
HISTORY_MS = 3_600_000


def flow_totals(flows: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return flows.agg(
        F.count(F.lit(1)).alias("flows"),
        F.coalesce(F.sum("packets"), zero).alias("packets"),
        F.coalesce(F.sum("bytes"), zero).alias("bytes"))


def exporter_last_seen(flows: DataFrame) -> DataFrame:
    return flows.groupBy("exporter_ip").agg(F.max("received_at").alias("last_seen"))


def active_exporters(flows: DataFrame, as_of: Column, active_secs: int = EXPORTER_ACTIVE_SECS) -> DataFrame:
    """Exporters heard from less than ``active_secs`` before ``as_of``."""
    age_us = F.unix_micros(as_of) - F.unix_micros("last_seen")
    return (
        exporter_last_seen(flows.where(F.col("received_at") <= as_of))
        .where(age_us < active_secs * 1_000_000)
        .agg(F.count(F.lit(1)).alias("active_exporters"))
    )


def flow_events(flows: DataFrame) -> DataFrame:
    """One JSON event per flow with its twelve fields."""
    fields = [
        ip_text(F.col(c)).alias(c) if c in ("src_ip", "dst_ip")
        else rfc3339_text(F.unix_micros("received_at"), "Z").alias(c) if c == "received_at"
        else F.col(c)
        for c in FLOW_COLUMNS if c != "received_at_ms"
    ]
    return flows.select("received_at_ms", F.to_json(F.struct(*fields)).alias("event"))


def oldest_date_needed(table: DataFrame, start_ms: int, end_ms: int, limit: int) -> dt.date:
    """The date from which on a date-partitioned table surely holds the ``limit`` newest
    flows of the closed range; the first date of the range if it has fewer.

    Looks at the last date first and then at twice as many, so that a request for the
    newest flows of a long range reads the partitions that have them, and at most as
    many again.
    """
    def date_of(ms: int) -> dt.date:
        return dt.date(1970, 1, 1) + dt.timedelta(milliseconds=ms)

    wanted = table.where((F.col("received_at_ms") >= start_ms) & (F.col("received_at_ms") <= end_ms))
    first, upto = date_of(start_ms), date_of(end_ms)
    days, held = 1, 0
    while upto > first:
        since = max(first, upto - dt.timedelta(days=days - 1))
        held += wanted.where(F.col(PARTITION).between(F.lit(since), F.lit(upto))).limit(limit - held).count()
        if held >= limit:
            return since
        upto, days = since - dt.timedelta(days=1), 2 * days
    return first


def flows_in_range(flows: DataFrame, start_ms: int, end_ms: int, limit: int) -> DataFrame:
    """Newest flows of the closed range, at most ``limit``.

    Ties in time are broken by all columns, so the answer is the same on every run. Of
    a date-partitioned table only the newest partitions that hold ``limit`` flows are read.
    """
    wanted = flows.where((F.col("received_at_ms") >= start_ms) & (F.col("received_at_ms") <= end_ms))
    if PARTITION in flows.columns and 0 < limit and start_ms <= end_ms:
        since = oldest_date_needed(flows, start_ms, end_ms, limit)
        wanted = wanted.where(F.col(PARTITION).between(F.lit(since), date_of_ms(F.lit(end_ms))))
    ties = [F.asc(c) for c in FLOW_COLUMNS if c not in ("received_at", "received_at_ms")]
    return wanted.select(*FLOW_COLUMNS).orderBy(F.desc("received_at_ms"), *ties).limit(limit)


def flow_history(
    flows: DataFrame, start: str | None = None, end: str | None = None, limit: int | None = None,
    now: dt.datetime | None = None,
) -> DataFrame:
    """Recent flows for display; the last hour unless told otherwise.

    Arguments that are no RFC 3339 text count as absent. ``total`` is the number
    of rows returned.
    """
    now_ms = int((now or dt.datetime.now(dt.timezone.utc)).timestamp() * 1000)
    end_ms = rfc3339_argument_ms(end)
    end_ms = now_ms if end_ms is None else end_ms
    start_ms = rfc3339_argument_ms(start)
    start_ms = end_ms - HISTORY_MS if start_ms is None else start_ms
    count = min(DEFAULT_LIMIT if limit is None else limit, MAX_LIMIT)
    found = flows_in_range(flows, start_ms, end_ms, count)
    # At most MAX_LIMIT rows reach this window.
    total = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return found.select(
        ip_text(F.col("src_ip")).alias("src_ip"), ip_text(F.col("dst_ip")).alias("dst_ip"),
        "src_port", "dst_port", "protocol", "packets", "bytes",
        whole_second_text(F.col("received_at_ms")).alias("received_at"),
        total.alias("total"),
    )
