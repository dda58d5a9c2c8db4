"""Sliding-window traffic metrics.

Flows are first summed into panes (see ``ticks.pane_moment``); every later step
works on pane sums. All partial results are sums or sets, so distinct counts
stay exact and a hot address or protocol collapses before the first shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirgauge.config import TICK_SECS, TOP_TALKERS, WINDOW_SECS
from weirgauge.functions.clock import MICROS, timestamp_of_us
from weirgauge.functions.net import has_bits, ip_text
from weirgauge.functions.numbers import saturating_minus, whole_quotient
from weirgauge.operators.coverage import amount_spans, at_ticks, count_spans, place_partials, presence_spans
from weirgauge.operators.ticks import event_us, expand_windows, pane_moment, pane_secs, tick_spine
from weirgauge.schema import METRIC_COLUMNS
from weirgauge.storage import settle

# Protocol numbers, TCP flag bits and the two endpoint sides.
TCP = 6
UDP = 17
SYN = 0x02
ACK = 0x10
SRC = 0
DST = 1

WINDOW_KEY = ["window_secs", "tick_us"]
ENDPOINT = ["ip", "side"]
TRAFFIC_SUMS = ["flows", "packets", "bytes", "syn_only_flows", "duration_ms"]


def closed_reaches(windows: Sequence[int]) -> dict[int, int]:
    return {w: w * MICROS for w in windows}


def with_tick(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tick", timestamp_of_us(F.col("tick_us"))).drop("tick_us")


# -- pane sums ---------------------------------------------------------------

def protocol_measures(flows: DataFrame) -> DataFrame:
    """Per-flow amounts that the protocol panes add up."""
    is_tcp = F.col("protocol") == TCP
    syn_only = is_tcp & has_bits(F.col("tcp_flags"), SYN) & ~has_bits(F.col("tcp_flags"), ACK)
    return flows.select(
        "received_at", "protocol", "packets", "bytes",
        F.lit(1).cast("bigint").alias("flows"),
        F.when(syn_only, 1).otherwise(0).cast("bigint").alias("syn_only_flows"),
        F.when(is_tcp, saturating_minus(F.col("end_time"), F.col("start_time")))
        .otherwise(0).cast("bigint").alias("duration_ms"),
    )


def endpoint_measures(flows: DataFrame) -> DataFrame:
    """Two rows per flow: its bytes at the source and at the destination."""
    ends = F.array(
        F.struct(F.lit(SRC).alias("side"), F.col("src_ip").alias("ip")),
        F.struct(F.lit(DST).alias("side"), F.col("dst_ip").alias("ip")),
    )
    return flows.select("received_at", "bytes", F.explode(ends).alias("end")).select(
        "received_at", "end.side", "end.ip", "bytes")


def protocol_panes(flows: DataFrame, width_secs: int) -> DataFrame:
    amounts = protocol_measures(flows)
    return (
        amounts.withColumn("moment_us", pane_moment(event_us(amounts), width_secs))
        .groupBy("moment_us", "protocol")
        .agg(*[F.sum(c).alias(c) for c in TRAFFIC_SUMS])
    )


def endpoint_panes(flows: DataFrame, width_secs: int) -> DataFrame:
    amounts = endpoint_measures(flows)
    return (
        amounts.withColumn("moment_us", pane_moment(event_us(amounts), width_secs))
        .groupBy("moment_us", "side", "ip").agg(F.sum("bytes").alias("bytes"))
    )


def port_word(port: Column) -> Column:
    """Number of the word of 64 ports that a port is in."""
    return F.shiftright(port, 6).cast("int")


def port_bit(port: Column) -> Column:
    """The port's bit in its word."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), port.bitwiseAND(63).cast("int"))


def ports_of(word: Column, bits: Column) -> Column:
    """The ports of a word, as an array."""
    return F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(F.getbit(bits, b) == 1, word * 64 + b)),
        lambda port: port.isNotNull())


def port_panes(flows: DataFrame, width_secs: int) -> DataFrame:
    """Ports contacted per source, as bitmaps of 64 ports. They merge by OR, before the
    shuffle too: a scanner of all ports has 1024 rows in a pane, a source with one port one."""
    moment = pane_moment(event_us(flows), width_secs)
    return flows.groupBy(moment.alias("moment_us"), "src_ip", port_word(F.col("dst_port")).alias("word")).agg(
        F.bit_or(port_bit(F.col("dst_port"))).alias("ports"))


# -- per-protocol windows and the scalar counters -----------------------------

def per_protocol_sums(panes: DataFrame, windows: Sequence[int], tick_secs: int) -> DataFrame:
    return (
        expand_windows(panes, "moment_us", windows, tick_secs)
        .groupBy(*WINDOW_KEY, "protocol").agg(*[F.sum(c).alias(c) for c in TRAFFIC_SUMS])
    )


def protocol_windows(
    flows: DataFrame, windows: Sequence[int] = WINDOW_SECS, tick_secs: int = TICK_SECS
) -> DataFrame:
    return per_protocol_sums(protocol_panes(flows, pane_secs(windows, tick_secs)), windows, tick_secs)


def window_counters(per_protocol: DataFrame) -> DataFrame:
    """Counts, protocol mix and TCP counters per (window, tick)."""
    def tcp_sum(name: str):
        return F.coalesce(F.sum(F.when(F.col("protocol") == TCP, F.col(name))), F.lit(0).cast("bigint"))

    totals = per_protocol.groupBy(*WINDOW_KEY).agg(
        *[F.sum(c).alias(c) for c in ("flows", "packets", "bytes")],
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("protocol", "flows")))).alias("protocol_dist"),
        tcp_sum("flows").alias("tcp_flows"),
        F.sum("syn_only_flows").alias("syn_only_flows"),
        F.sum("duration_ms").alias("duration_ms"),
    )
    return totals.withColumn(
        "avg_flow_duration_ms", whole_quotient(F.col("duration_ms"), F.col("tcp_flows"))).drop("duration_ms")


def window_counts(flows: DataFrame, windows=WINDOW_SECS, tick_secs: int = TICK_SECS) -> DataFrame:
    counters = window_counters(protocol_windows(flows, windows, tick_secs))
    return with_tick(counters.select(*WINDOW_KEY, "flows", "packets", "bytes"))


def with_rates(counters: DataFrame) -> DataFrame:
    """Per-second rates over the nominal window length."""
    secs = F.col("window_secs").cast("double")
    for name in ("flows", "packets", "bytes"):
        counters = counters.withColumn(f"{name}_per_sec", F.col(name).cast("double") / secs)
    return counters


def all_rates(flows: DataFrame, windows=WINDOW_SECS, tick_secs: int = TICK_SECS) -> DataFrame:
    """Counts and rates of every tick between the first and the last flow; quiet ones
    are zero. Neither addresses nor talkers are looked at."""
    spine = with_tick(tick_spine(flows, windows, tick_secs))
    counted = spine.join(window_counts(flows, windows, tick_secs), ["window_secs", "tick"], "left")
    return with_rates(counted.na.fill(0, ["flows", "packets", "bytes"]))


def protocol_distribution(flows: DataFrame, windows=WINDOW_SECS, tick_secs: int = TICK_SECS) -> DataFrame:
    per_protocol = protocol_windows(flows, windows, tick_secs)
    return with_tick(per_protocol.select(*WINDOW_KEY, "protocol", "flows"))


def tcp_counters(flows: DataFrame, windows=WINDOW_SECS, tick_secs: int = TICK_SECS) -> DataFrame:
    counters = window_counters(protocol_windows(flows, windows, tick_secs))
    return with_tick(counters.select(*WINDOW_KEY, "tcp_flows", "syn_only_flows", "avg_flow_duration_ms"))


# -- endpoints ----------------------------------------------------------------

def placed_endpoints(flows: DataFrame, windows=WINDOW_SECS, tick_secs: int = TICK_SECS) -> DataFrame:
    panes = endpoint_panes(flows, pane_secs(windows, tick_secs)).withColumnRenamed("bytes", "amount")
    return place_partials(panes, ENDPOINT, closed_reaches(windows), tick_secs)


def byte_spans(placed: DataFrame, windows=WINDOW_SECS, tick_secs: int = TICK_SECS) -> DataFrame:
    """Window byte sums of each endpoint, as spans."""
    return amount_spans(placed, ENDPOINT, closed_reaches(windows), tick_secs).withColumnRenamed("amount", "bytes")


def bytes_by_endpoint(flows: DataFrame, windows=WINDOW_SECS, tick_secs: int = TICK_SECS) -> DataFrame:
    placed = placed_endpoints(flows, windows, tick_secs)
    return with_tick(at_ticks(byte_spans(placed, windows, tick_secs), tick_secs))


def distinct_per_side(placed: DataFrame, windows=WINDOW_SECS, tick_secs: int = TICK_SECS) -> DataFrame:
    """Number of different addresses per (window, tick, side)."""
    spans = presence_spans(placed, ENDPOINT, closed_reaches(windows), tick_secs)
    return at_ticks(count_spans(spans, ["side"], "addresses"), tick_secs)


def unique_endpoints(flows: DataFrame, windows=WINDOW_SECS, tick_secs: int = TICK_SECS) -> DataFrame:
    counted = distinct_per_side(placed_endpoints(flows, windows, tick_secs), windows, tick_secs)
    sides = counted.groupBy(*WINDOW_KEY).agg(
        F.max(F.when(F.col("side") == SRC, F.col("addresses"))).alias("unique_src_ips"),
        F.max(F.when(F.col("side") == DST, F.col("addresses"))).alias("unique_dst_ips"),
    )
    return with_tick(sides)


def rank_talkers(per_tick: DataFrame, top_n: int = TOP_TALKERS) -> DataFrame:
    """Largest byte sums per (window, tick, side); ties go to the lower address.

    The rank limit runs before the shuffle too, so each task sends at most
    ``top_n`` rows per group.
    """
    order = Window.partitionBy("tick_us", "side", "window_secs").orderBy(F.desc("bytes"), F.asc("ip"))
    return per_tick.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def talker_ticks(spans: DataFrame, tick_secs: int = TICK_SECS, top_n: int = TOP_TALKERS) -> DataFrame:
    """Spans → ranked talkers per tick.

    Among spans with the same extent only the ``top_n`` largest can ever be in a
    tick's list: the others are beaten at each of their ticks. Addresses seen
    once all share a few extents, so nearly all of them go before the spans are
    expanded, and no result changes.
    """
    order = Window.partitionBy("from_us", "to_us", "side", "window_secs").orderBy(F.desc("bytes"), F.asc("ip"))
    contenders = spans.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_n).drop("place")
    return rank_talkers(at_ticks(contenders, tick_secs), top_n)


def top_talkers(
    flows: DataFrame, windows=WINDOW_SECS, tick_secs: int = TICK_SECS, top_n: int = TOP_TALKERS
) -> DataFrame:
    spans = byte_spans(placed_endpoints(flows, windows, tick_secs), windows, tick_secs)
    return with_tick(talker_ticks(spans, tick_secs, top_n))


# -- destination ports per source ----------------------------------------------

def contact_spans(panes: DataFrame, windows: Sequence[int], tick_secs: int = TICK_SECS) -> DataFrame:
    """Distinct destination ports of each source, as spans, from port bitmaps at pane
    moments; repeats of a contact add nothing. The bitmaps are shuffled, and opened
    where they have arrived: a port's spans need no exchange of their own."""
    owner, reaches = ["src_ip", "word"], closed_reaches(windows)
    placed = place_partials(panes.select("moment_us", *owner, "ports"), owner, reaches, tick_secs)
    contacts = placed.select("moment_us", *owner, "segment", F.explode(ports_of(F.col("word"), F.col("ports"))).alias("dst_port"))
    spans = presence_spans(contacts, ["dst_port", *owner], reaches, tick_secs)
    return count_spans(spans, ["src_ip"], "n_ports")


def fanout_spans(flows: DataFrame, windows=(60,), tick_secs: int = TICK_SECS) -> DataFrame:
    return contact_spans(port_panes(flows, pane_secs(windows, tick_secs)), windows, tick_secs)


def source_port_fanout(flows: DataFrame, windows=WINDOW_SECS, tick_secs: int = TICK_SECS) -> DataFrame:
    return with_tick(at_ticks(fanout_spans(flows, windows, tick_secs), tick_secs))


# -- the assembled row -----------------------------------------------------------

def assemble_metrics(counters: DataFrame, addresses: DataFrame, talkers: DataFrame,
                     spine: DataFrame | None = None) -> DataFrame:
    """Merge the partial results on (window, tick) in one small shuffle.

    With a spine, exactly the spine's ticks come out and quiet ones are zero.
    """
    parts = counters.unionByName(addresses, True).unionByName(talkers, True)
    if spine is not None:
        parts = parts.unionByName(spine.withColumn("wanted", F.lit(True)), True)
    zero = F.lit(0).cast("bigint")

    def amount(name: str):
        return F.coalesce(F.max(name), zero).alias(name)

    def addresses_of(side: int):
        return F.coalesce(F.max(F.when(F.col("side") == side, F.col("addresses"))), zero)

    def talkers_of(side: int):
        ranked = F.collect_list(F.when(
            (F.col("side") == side) & F.col("rank").isNotNull(), F.struct("rank", "ip", "bytes")))
        return F.transform(F.array_sort(ranked), lambda r: F.struct(r["ip"].alias("ip"), r["bytes"].alias("bytes")))

    keep = F.max("wanted").alias("wanted") if spine is not None else F.lit(True).alias("wanted")
    merged = parts.groupBy(*WINDOW_KEY).agg(
        keep, amount("flows"), amount("packets"),
        F.coalesce(F.max(F.when(F.col("rank").isNull(), F.col("bytes"))), zero).alias("bytes"),
        addresses_of(SRC).alias("unique_src_ips"), addresses_of(DST).alias("unique_dst_ips"),
        talkers_of(SRC).alias("top_src_ips"), talkers_of(DST).alias("top_dst_ips"),
        F.coalesce(F.first("protocol_dist", ignorenulls=True),
                   F.create_map().cast("map<int,bigint>")).alias("protocol_dist"),
        amount("tcp_flows"), amount("syn_only_flows"), amount("avg_flow_duration_ms"),
    )
    return with_tick(with_rates(merged.where("wanted"))).select(*METRIC_COLUMNS)


def metrics_from_panes(
    protocols: DataFrame, endpoints: DataFrame, windows: Sequence[int], tick_secs: int, top_n: int,
    spine: DataFrame | None = None,
) -> DataFrame:
    """Metrics rows from protocol sums and endpoint bytes at pane moments."""
    placed = place_partials(
        endpoints.withColumnRenamed("bytes", "amount"), ENDPOINT, closed_reaches(windows), tick_secs)
    return assemble_metrics(
        window_counters(per_protocol_sums(protocols, windows, tick_secs)),
        distinct_per_side(placed, windows, tick_secs),
        talker_ticks(byte_spans(placed, windows, tick_secs), tick_secs, top_n),
        spine,
    )


def window_metrics(
    flows: DataFrame,
    windows: Sequence[int] = WINDOW_SECS,
    tick_secs: int = TICK_SECS,
    top_n: int = TOP_TALKERS,
    keep_empty: bool = True,
) -> DataFrame:
    """One metrics row per (window size, tick).

    ``keep_empty`` reports every tick between the first and the last flow;
    without it only ticks whose window holds flows appear, also past the last flow.
    The flows are read once: their pane sums are written, and all else follows from these.
    """
    from weirgauge.operators.panes import pane_metrics, pane_rows  # which is built on this module

    panes = settle(pane_rows(flows, windows, tick_secs, contacts=False), "panes")
    return pane_metrics(panes, windows, tick_secs, top_n, keep_empty)


def latest_snapshot(metrics: DataFrame) -> DataFrame:
    """Newest row per window size."""
    newest = metrics.groupBy("window_secs").agg(
        F.max_by(F.struct(*[c for c in metrics.columns if c != "window_secs"]), "tick").alias("row"))
    return newest.select("window_secs", "row.*").select(*metrics.columns)


# -- text form -----------------------------------------------------------------

def talkers_text(talkers: Column) -> Column:
    return F.array_join(F.transform(
        talkers, lambda t: F.concat(ip_text(t["ip"]), F.lit("="), t["bytes"].cast("string"))), ",")


def protocols_text(dist: Column) -> Column:
    entries = F.array_sort(F.map_entries(dist))
    return F.array_join(F.transform(
        entries, lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",")


def snapshot_event(metrics: DataFrame) -> DataFrame:
    """The metrics row with its nested columns as ``k=v,k=v`` text."""
    return metrics.select(
        "tick", "window_secs", "flows", "packets", "bytes",
        "flows_per_sec", "packets_per_sec", "bytes_per_sec", "unique_src_ips", "unique_dst_ips",
        talkers_text(F.col("top_src_ips")).alias("top_src_ips"),
        talkers_text(F.col("top_dst_ips")).alias("top_dst_ips"),
        protocols_text(F.col("protocol_dist")).alias("protocol_dist"),
    )
