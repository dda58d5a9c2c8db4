"""Flow records derived from a generic ``events`` table.

Integer arithmetic only, so that any engine computes the same rows. Thirty days
of events are compressed a thousandfold; four-minute phases cycle through
normal traffic, UDP flood, SYN flood, port scan and destination hotspot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgauge.schema import FLOW_COLUMNS

# Time origin, phase length and the addresses of the five phases.
ORIGIN_MS = 1_704_067_200_000
PHASE_MS = 240_000
PHASES = 5
BOT_BASE = 167_772_161
SCANNER = 167_772_259
CLIENT_BASE = 167_772_165
UDP_VICTIM = 167_837_953
SYN_VICTIM = 3_221_225_985
RESOLVER = 134_744_072
HOTSPOT = 16_843_009
INTRANET = 3_232_235_777
MICROS_SINCE_ORIGIN = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def flows_from_events(events: DataFrame) -> DataFrame:
    """``events`` → flows, with ``flow_id`` kept in front for numbering datagrams."""
    timed = events.select(
        "event_id", "user_id",
        (F.lit(ORIGIN_MS) + F.expr(f"({MICROS_SINCE_ORIGIN}) div 1000000")).alias("received_at_ms"))
    phased = timed.selectExpr("*", f"(received_at_ms - {ORIGIN_MS}) div {PHASE_MS} % {PHASES} as phase")
    return phased.selectExpr(
        "event_id as flow_id",
        f"""case phase when 1 then {BOT_BASE} + event_id % 251 when 2 then {BOT_BASE} + event_id % 9973
            when 3 then {SCANNER} else {CLIENT_BASE} + user_id % 150 end as src_ip""",
        f"""cast(case phase when 1 then {UDP_VICTIM} when 2 then {SYN_VICTIM} when 3 then {RESOLVER}
            when 4 then if(event_id % 20 < 19, {HOTSPOT}, {RESOLVER})
            else case event_id % 4 when 0 then {INTRANET} when 1 then {RESOLVER} when 2 then {HOTSPOT}
                 else {UDP_VICTIM} end end as bigint) as dst_ip""",
        "cast(1024 + event_id % 64511 as int) as src_port",
        """cast(case phase when 1 then 53 when 2 then 80 when 3 then 1 + event_id % 200
            else case event_id % 3 when 0 then 443 when 1 then 80 else 22 end end as int) as dst_port""",
        """case when phase = 1 and event_id % 10 < 9 then 17 when phase = 0 and event_id % 7 = 0 then 17
            when phase = 0 and event_id % 31 = 0 then 1 else 6 end as protocol""",
        """cast(case phase when 1 then 400 + event_id % 200 when 2 then 180 + event_id % 40 when 3 then 1
            else 12 end as bigint) as packets""",
        """cast(case phase when 1 then (400 + event_id % 200) * 512 when 2 then (180 + event_id % 40) * 40
            when 3 then 44 when 4 then if(event_id % 20 < 19, 50000, 5000) else 5840 end as bigint) as bytes""",
        "0L as start_time",
        "case phase when 2 then 50L when 3 then 10L else 10000L end as end_time",
        """case phase when 2 then if(event_id % 10 < 9, 2, 18) when 3 then 2 else 24 end as tcp_flags""",
        "concat('127.0.0.', 1 + user_id % 3) as exporter_ip",
        "timestamp_millis(received_at_ms) as received_at",
        "received_at_ms",
    )


def event_flows(spark: SparkSession, folder: str) -> DataFrame:
    return flows_from_events(read_events(spark, folder)).select(*FLOW_COLUMNS)
