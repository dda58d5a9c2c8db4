"""Test captures: packs the flows of an ``events`` table into export datagrams.

Used only to check the decoders end to end. Thirty consecutive flow ids form a
chunk; each exporter sends its flows of a chunk as one datagram stamped with the
newest of them. 127.0.0.1 speaks version 5, 127.0.0.2 version 9 and 127.0.0.3
IPFIX. Templates come every 16 chunks but not at the start, and change their
layout every 64 chunks. Some chunks add a malformed version 5 datagram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgauge.functions.clock import timestamp_of_ms
from weirgauge.schema import DATAGRAM_SCHEMA
from weirgauge.sources.event_flows import flows_from_events

CHUNK = 30
TEMPLATE_EVERY = 16
LAYOUT_EVERY = 64
V5_EXPORTER = "127.0.0.1"
V9_EXPORTER = "127.0.0.2"
IPFIX_EXPORTER = "127.0.0.3"
TEMPLATE_ID = 300
DOMAIN = 7
VENDOR = 9876

STANDARD = [("src_ip", 8, 4), ("dst_ip", 12, 4), ("src_port", 7, 2), ("dst_port", 11, 2), ("protocol", 4, 1),
            ("packets", 2, 4), ("bytes", 1, 4), ("start_time", 22, 4), ("end_time", 21, 4), ("tcp_flags", 6, 1)]
# The second layout of version 9: other order, no times, an unknown element.
COMPACT = [("bytes", 1, 4), ("packets", 2, 4), (None, 61, 1), ("protocol", 4, 1), ("tcp_flags", 6, 1),
           ("dst_port", 11, 2), ("src_port", 7, 2), ("dst_ip", 12, 4), ("src_ip", 8, 4)]
# IPFIX: a vendor field in front; the second layout counts bytes in eight bytes.
VENDOR_FIRST = [("vendor", 8, 4), *STANDARD]
WIDE_BYTES = [(n, e, 8 if n == "bytes" else w) for n, e, w in STANDARD]
LAYOUTS = {V9_EXPORTER: (STANDARD, COMPACT), IPFIX_EXPORTER: (VENDOR_FIRST, WIDE_BYTES)}


def _hex(value: Column | int, width: int) -> Column:
    number = value if isinstance(value, Column) else F.lit(value)
    return F.lpad(F.hex(number.cast("bigint")), width * 2, "0")


def _record(layout: list) -> Column:
    return F.concat(*[_hex(F.col(n) if n and n != "vendor" else F.lit(0), w) for n, _, w in layout])


def _v5_record() -> Column:
    return F.concat(
        _hex(F.col("src_ip"), 4), _hex(F.col("dst_ip"), 4), F.lit("00" * 8), _hex(F.col("packets"), 4),
        _hex(F.col("bytes"), 4), _hex(F.col("start_time"), 4), _hex(F.col("end_time"), 4),
        _hex(F.col("src_port"), 2), _hex(F.col("dst_port"), 2), F.lit("00"), _hex(F.col("tcp_flags"), 1),
        _hex(F.col("protocol"), 1), F.lit("00" * 9))


def template_hex(layout: list, template_id: int = TEMPLATE_ID) -> str:
    out = f"{template_id:04x}{len(layout):04x}"
    for name, element, width in layout:
        out += f"{element | 0x8000:04x}{width:04x}{VENDOR:08x}" if name == "vendor" else f"{element:04x}{width:04x}"
    return out


def _second() -> Column:
    return F.call_function("div", F.col("chunk"), F.lit(LAYOUT_EVERY)) % 2 == 1


def _by_layout(exporter: str, make) -> Column:
    first, second = (make(layout) for layout in LAYOUTS[exporter])
    return F.when(_second(), second).otherwise(first)


def _v9_header() -> Column:
    return F.concat(F.lit("00090001" + "00" * 12), _hex(DOMAIN, 4))


def _ipfix_header() -> Column:
    return F.concat(F.lit("000a0000" + "00" * 8), _hex(DOMAIN, 4))


def _set(set_id: int, body: Column) -> Column:
    return F.concat(_hex(set_id, 2), _hex(F.length(body) / 2 + 4, 2), body)


def chunked_flows(events: DataFrame) -> DataFrame:
    return flows_from_events(events).withColumn("chunk", F.call_function("div", F.col("flow_id"), F.lit(CHUNK)))


def datagrams_from_events(events: DataFrame) -> DataFrame:
    flows = chunked_flows(events)
    record = (
        F.when(F.col("exporter_ip") == V5_EXPORTER, _v5_record())
        .when(F.col("exporter_ip") == V9_EXPORTER, _by_layout(V9_EXPORTER, _record))
        .otherwise(_by_layout(IPFIX_EXPORTER, _record)))
    packed = flows.groupBy("exporter_ip", "chunk").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("flow_id", record.alias("record")))), lambda r: r["record"]),
            "").alias("records"),
        F.count(F.lit(1)).alias("n"), F.max("received_at_ms").alias("at_ms"))
    records = F.col("records")
    payload = (
        F.when(F.col("exporter_ip") == V5_EXPORTER,
               F.concat(F.lit("0005"), _hex(F.col("n"), 2), F.lit("00" * 20), records))
        .when(F.col("exporter_ip") == V9_EXPORTER,
              F.concat(_v9_header(), _set(TEMPLATE_ID, F.concat(records, F.lit("00" * 3)))))
        .otherwise(F.concat(_ipfix_header(), _set(TEMPLATE_ID, records))))
    data = packed.select((F.col("chunk") * 2 + 1).alias("seq"), "at_ms", "exporter_ip", payload.alias("hex"))

    chunks = flows.groupBy("chunk").agg(F.min("received_at_ms").alias("at_ms"))

    def template_packets(exporter: str, header: Column, set_id: int) -> DataFrame:
        body = _by_layout(exporter, lambda layout: F.lit(template_hex(layout)))
        return chunks.where((F.col("chunk") > 0) & (F.col("chunk") % TEMPLATE_EVERY == 0)).select(
            (F.col("chunk") * 2).alias("seq"), "at_ms", F.lit(exporter).alias("exporter_ip"),
            F.concat(header, _set(set_id, body)).alias("hex"))

    broken = (
        F.when(F.col("chunk") % 10 == 3, F.lit("00050002" + "00" * 20 + "11" * 48))
        .when(F.col("chunk") % 10 == 4, F.lit("0007" + "00" * 30))
        .when(F.col("chunk") % 10 == 5, F.lit("00"))
        .when(F.col("chunk") % 10 == 6, F.lit("0009" + "00" * 8))
        .when(F.col("chunk") % 10 == 7, F.lit("00050000" + "00" * 20)))
    noise = chunks.select(
        (F.col("chunk") * 2).alias("seq"), "at_ms", F.lit(V5_EXPORTER).alias("exporter_ip"), broken.alias("hex")
    ).where(F.col("hex").isNotNull())

    merged = (
        data.unionByName(template_packets(V9_EXPORTER, _v9_header(), 0))
        .unionByName(template_packets(IPFIX_EXPORTER, _ipfix_header(), 2))
        .unionByName(noise))
    return merged.select(
        "seq", timestamp_of_ms(F.col("at_ms")).alias("received_at"), "exporter_ip",
        F.unhex("hex").alias("payload")).select(*DATAGRAM_SCHEMA.fieldNames())


def multi_set_datagrams(events: DataFrame) -> DataFrame:
    """Version 9 and IPFIX packets of several sets, as routers send them: one set with
    two templates, records of the first (even flow ids), an options set, records of the
    second (odd ones), and a set that is cut off."""
    flows = chunked_flows(events).where(F.col("exporter_ip") != V5_EXPORTER)

    def records(rest: int, layout: list) -> Column:
        mine = F.collect_list(F.when(F.col("flow_id") % 2 == rest, F.struct("flow_id", _record(layout).alias("record"))))
        return F.array_join(F.transform(F.array_sort(mine), lambda r: r["record"]), "")

    packed = flows.groupBy("exporter_ip", "chunk").agg(
        records(0, STANDARD).alias("even"), records(1, COMPACT).alias("odd"), F.max("received_at_ms").alias("at_ms"))
    templates = F.lit(template_hex(STANDARD) + template_hex(COMPACT, TEMPLATE_ID + 1))

    def packet(header: Column, template_set: int, options_set: int) -> Column:
        return F.concat(
            header, _set(template_set, templates), _set(TEMPLATE_ID, F.col("even")), _set(options_set, F.lit("abcdef")),
            _set(TEMPLATE_ID + 1, F.col("odd")), F.lit("01900064ffff"))

    payload = F.when(F.col("exporter_ip") == V9_EXPORTER, packet(_v9_header(), 0, 1)).otherwise(packet(_ipfix_header(), 2, 3))
    return packed.select(
        F.col("chunk").alias("seq"), timestamp_of_ms(F.col("at_ms")).alias("received_at"), "exporter_ip",
        F.unhex(payload).alias("payload")).select(*DATAGRAM_SCHEMA.fieldNames())
