"""Table layouts shared by the batch and streaming operators."""

from __future__ import annotations

from pyspark.sql import types as T

# One captured export datagram. ``seq`` orders the datagrams of an exporter.
DATAGRAM_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("received_at", T.TimestampType()),
    T.StructField("exporter_ip", T.StringType()),
    T.StructField("payload", T.BinaryType()),
])

# IPv4 addresses are unsigned 32-bit numbers held in a long; counters are u32
# on the wire and would overflow a Spark int.
FLOW_SCHEMA = T.StructType([
    T.StructField("src_ip", T.LongType()),
    T.StructField("dst_ip", T.LongType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.IntegerType()),
    T.StructField("packets", T.LongType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("start_time", T.LongType()),
    T.StructField("end_time", T.LongType()),
    T.StructField("tcp_flags", T.IntegerType()),
    T.StructField("exporter_ip", T.StringType()),
    T.StructField("received_at", T.TimestampType()),
    T.StructField("received_at_ms", T.LongType()),
])
FLOW_COLUMNS = FLOW_SCHEMA.fieldNames()

TALKER_LIST = T.ArrayType(T.StructType([
    T.StructField("ip", T.LongType()),
    T.StructField("bytes", T.LongType()),
]))

WINDOW_METRICS_SCHEMA = T.StructType([
    T.StructField("tick", T.TimestampType()),
    T.StructField("window_secs", T.LongType()),
    T.StructField("flows", T.LongType()),
    T.StructField("packets", T.LongType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("flows_per_sec", T.DoubleType()),
    T.StructField("packets_per_sec", T.DoubleType()),
    T.StructField("bytes_per_sec", T.DoubleType()),
    T.StructField("unique_src_ips", T.LongType()),
    T.StructField("unique_dst_ips", T.LongType()),
    T.StructField("top_src_ips", TALKER_LIST),
    T.StructField("top_dst_ips", TALKER_LIST),
    T.StructField("protocol_dist", T.MapType(T.IntegerType(), T.LongType())),
    T.StructField("tcp_flows", T.LongType()),
    T.StructField("syn_only_flows", T.LongType()),
    T.StructField("avg_flow_duration_ms", T.LongType()),
])
METRIC_COLUMNS = WINDOW_METRICS_SCHEMA.fieldNames()

# Stored alerts carry an id; freshly fired ones do not have the column yet.
ALERT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("rule", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("target_ip", T.LongType()),
    T.StructField("window_secs", T.LongType()),
    T.StructField("indicators", T.ArrayType(T.StringType())),
    T.StructField("triggered_at", T.TimestampType()),
])
ALERT_COLUMNS = ALERT_SCHEMA.fieldNames()
FIRED_COLUMNS = ALERT_COLUMNS[1:]
