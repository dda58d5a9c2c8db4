"""Alert numbering, persistence, lookup and text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgauge.functions.clock import parse_rfc3339, rfc3339_text
from weirgauge.functions.net import ip_literal, ip_number, ip_text
from weirgauge.operators.prefix import running_totals
from weirgauge.schema import ALERT_COLUMNS, ALERT_SCHEMA
from weirgauge.storage import read_if_there, settle

# The whole text is a JSON array of strings.
_BLANK = r"[ \t\r\n]*+"
_STRING = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
STRING_LIST = rf"^{_BLANK}\[{_BLANK}(?:{_STRING}{_BLANK}(?:,{_BLANK}{_STRING}{_BLANK})*+)?\]{_BLANK}\z"

DEFAULT_LIMIT = 20
MAX_LIMIT = 100
RECENT_ALERTS = 100


def number_alerts(fired: DataFrame, last_id: int = 0) -> DataFrame:
    """Give fired alerts consecutive ids after ``last_id``, in (time, rule, target)
    order. Hours are numbered side by side."""
    hour = F.call_function("div", F.unix_micros("triggered_at"), F.lit(3_600_000_000))
    order = [F.asc("triggered_at"), F.asc("rule"), F.asc_nulls_first("target_ip")]
    numbered = running_totals(fired, hour, order, {"id": F.lit(1).cast("bigint")})
    return numbered.withColumn("id", F.col("id") + last_id).select(*ALERT_COLUMNS)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return read_if_there(spark, path, ALERT_SCHEMA)


def append_alerts(fired: DataFrame, path: str) -> None:
    """Append fired alerts to the alert table with auto-incremented ids. Alerts that
    the table has, by rule, target and time, are left out, so that a repeated call
    changes nothing; only the table's rows of their time are compared. One writer at a
    time."""
    fired = settle(fired, "fired")
    stored = read_alerts(fired.sparkSession, path)
    last = stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    at = F.unix_micros("triggered_at")
    oldest, newest = fired.agg(F.min(at), F.max(at)).first()
    if oldest is not None:
        stored = stored.where(F.col("triggered_at").between(F.timestamp_micros(F.lit(oldest)), F.timestamp_micros(F.lit(newest))))
    same = F.lit(True)
    for column in ("rule", "target_ip", "triggered_at"):
        same = same & F.col(f"f.{column}").eqNullSafe(F.col(f"s.{column}"))
    new = fired.alias("f").join(stored.alias("s"), same, "left_anti")
    number_alerts(new, last).write.mode("append").parquet(path)


def newest_first(alerts: DataFrame, limit: int) -> DataFrame:
    return alerts.orderBy(F.desc("triggered_at"), F.desc("id")).limit(limit)


def alerts_recent(alerts: DataFrame, limit: int) -> DataFrame:
    return newest_first(alerts, limit)


def recent_alerts(alerts: DataFrame) -> DataFrame:
    """The bounded list of latest alerts."""
    return newest_first(alerts, RECENT_ALERTS)


def alert_by_id(alerts: DataFrame, alert_id: int) -> DataFrame:
    return alerts.where(F.col("id") == alert_id)


def alerts_by_ip(alerts: DataFrame, ip: str, limit: int) -> DataFrame:
    return newest_first(alerts.where(F.col("target_ip") == ip_literal(ip)), limit)


def alerts_by_rule(alerts: DataFrame, rule: str, limit: int) -> DataFrame:
    return newest_first(alerts.where(F.col("rule") == rule), limit)


def query_alerts(
    alerts: DataFrame, limit: int | None = None, rule: str | None = None, ip: str | None = None
) -> DataFrame:
    """Latest alerts, by rule or by target. A rule wins over an address; a bad
    address raises ``ValueError``."""
    count = min(DEFAULT_LIMIT if limit is None else limit, MAX_LIMIT)
    if rule is not None:
        return alerts_by_rule(alerts, rule, count)
    if ip is not None:
        return alerts_by_ip(alerts, ip, count)
    return alerts_recent(alerts, count)


def count_by_rule(fired: DataFrame) -> DataFrame:
    return fired.groupBy("rule").agg(F.count(F.lit(1)).alias("alerts"))


def _json(alert_id: Column, time_text: Column) -> Column:
    return F.to_json(F.struct(
        alert_id.alias("id"), F.col("rule"), F.col("severity"), ip_text(F.col("target_ip")).alias("target_ip"),
        F.col("window_secs"), F.col("indicators"), time_text.alias("triggered_at"),
    ), {"ignoreNullFields": "false"})


def alert_json(alerts: DataFrame) -> DataFrame:
    """Stored alerts as JSON objects with seven keys."""
    stamp = rfc3339_text(F.unix_micros("triggered_at"))
    return alerts.select("id", _json(F.col("id"), stamp).alias("json"))


def alert_outbox(fired: DataFrame, *more: str) -> DataFrame:
    """One JSON payload per fired alert for a downstream deliverer; the id is
    not assigned yet at that point and is sent as null. ``more`` columns are kept."""
    stamp = rfc3339_text(F.unix_micros("triggered_at"), "Z")
    return fired.select(
        "rule", "triggered_at", *more, _json(F.lit(None).cast("bigint"), stamp).alias("payload"))


def alert_text_rows(alerts: DataFrame) -> DataFrame:
    """Alerts in the all-text layout of an external alert store."""
    return alerts.select(
        "id", "rule", "severity", ip_text(F.col("target_ip")).alias("target_ip"), "window_secs",
        F.to_json("indicators").alias("indicators"),
        rfc3339_text(F.unix_micros("triggered_at")).alias("triggered_at"))


def normalize_alert_rows(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Tolerant read of text rows: odd severities become High, unreadable
    addresses NULL, unreadable indicator lists empty, unreadable times ``now``."""
    fallback = F.current_timestamp() if now is None else now
    parsed = F.when(F.col("indicators").rlike(STRING_LIST), F.from_json("indicators", "array<string>"))
    return rows.select(
        "id", "rule",
        F.when(F.col("severity").isin("Low", "Medium"), F.col("severity")).otherwise("High").alias("severity"),
        ip_number(F.col("target_ip")).alias("target_ip"),
        "window_secs",
        F.coalesce(parsed, F.array().cast("array<string>")).alias("indicators"),
        F.coalesce(parse_rfc3339(F.col("triggered_at")), fallback).alias("triggered_at"),
    )
