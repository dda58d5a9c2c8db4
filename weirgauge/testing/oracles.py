"""The registered queries once more, as plain SQL for an independent engine.

Windows are computed here by listing every (flow, tick) pair, decoding by
knowing what the fixture packed, and the cooldown by recursion: none of the
methods used by the operators.
"""

from __future__ import annotations

FLOWS = """
timed as (
  select event_id, user_id,
         1704067200000 + (epoch_us(ts) - 1704067200000000) // 1000000 as received_at_ms
  from events),
phased as (select *, ((received_at_ms - 1704067200000) // 240000) % 5 as phase from timed),
all_flows as (
  select event_id as flow_id,
    cast(case phase when 1 then 167772161 + event_id % 251 when 2 then 167772161 + event_id % 9973
         when 3 then 167772259 else 167772165 + user_id % 150 end as bigint) as src_ip,
    cast(case phase when 1 then 167837953 when 2 then 3221225985 when 3 then 134744072
         when 4 then case when event_id % 20 < 19 then 16843009 else 134744072 end
         else case event_id % 4 when 0 then 3232235777 when 1 then 134744072
                                when 2 then 16843009 else 167837953 end end as bigint) as dst_ip,
    cast(1024 + event_id % 64511 as integer) as src_port,
    cast(case phase when 3 then 1 + event_id % 200 when 1 then 53 when 2 then 80
         else case event_id % 3 when 0 then 443 when 1 then 80 else 22 end end as integer) as dst_port,
    cast(case when phase = 1 and event_id % 10 < 9 then 17 when phase = 0 and event_id % 7 = 0 then 17
         when phase = 0 and event_id % 31 = 0 then 1 else 6 end as integer) as protocol,
    cast(case phase when 1 then 400 + event_id % 200 when 2 then 180 + event_id % 40
         when 3 then 1 else 12 end as bigint) as packets,
    cast(case phase when 1 then (400 + event_id % 200) * 512 when 2 then (180 + event_id % 40) * 40
         when 3 then 44 when 4 then case when event_id % 20 < 19 then 50000 else 5000 end
         else 5840 end as bigint) as bytes,
    cast(0 as bigint) as start_time,
    cast(case phase when 2 then 50 when 3 then 10 else 10000 end as bigint) as end_time,
    cast(case when phase = 2 then case when event_id % 10 < 9 then 2 else 18 end
         when phase = 3 then 2 else 24 end as integer) as tcp_flags,
    '127.0.0.' || cast(1 + user_id % 3 as varchar) as exporter_ip,
    received_at_ms
  from phased)"""

# What the decoders must recover from the fixture's datagrams.
PACKED = """
packed as (
  select *, flow_id // 30 as chunk, (flow_id // 30) // 64 % 2 as layout,
         max(received_at_ms) over (partition by exporter_ip, flow_id // 30) as at_ms
  from all_flows),
chunks as (select chunk, min(received_at_ms) as at_ms from packed group by chunk),
first_template as (select min(chunk) as chunk from chunks where chunk > 0 and chunk % 16 = 0),
decoded_v5 as (select * from packed where exporter_ip = '127.0.0.1'),
decoded_templated as (
  select flow_id, src_ip, dst_ip, src_port, dst_port, protocol, packets, bytes,
         cast(0 as bigint) as start_time,
         case when layout = 1 then cast(0 as bigint) else end_time end as end_time,
         tcp_flags, exporter_ip, at_ms
  from packed, first_template
  where packed.chunk >= first_template.chunk
    and (exporter_ip = '127.0.0.2' or (exporter_ip = '127.0.0.3' and layout = 0)))"""

FLOW_FIELDS = ("src_ip, dst_ip, src_port, dst_port, protocol, packets, bytes, start_time, end_time, "
               "tcp_flags, exporter_ip")

DECODED = f"""
all_decoded as (
  select {FLOW_FIELDS}, at_ms as received_at_ms from decoded_v5
  union all select {FLOW_FIELDS}, at_ms from decoded_templated)"""


def ip(value: str) -> str:
    return f"(({value}) // 16777216 || '.' || ({value}) // 65536 % 256 || '.' || ({value}) // 256 % 256 || '.' || ({value}) % 256)"


def windows(flows: str = "all_flows", sizes: str = "(10), (60), (300)", step: int = 10_000) -> str:
    """Every (window, tick, flow) membership."""
    return f"""
sizes(w) as (values {sizes}),
spans as (
  select cast(w as bigint) as window_secs, f.*,
         (received_at_ms + {step - 1}) // {step} * {step} as first_ms,
         (received_at_ms + w * 1000) // {step} * {step} as last_ms
  from {flows} f, sizes),
hits as (
  select * exclude (first_ms, last_ms), unnest(generate_series(first_ms, last_ms, {step})) as tick_ms
  from spans where first_ms <= last_ms),
spine as (
  select cast(w as bigint) as window_secs, unnest(generate_series(low, high, {step})) as tick_ms
  from sizes, (select (min(received_at_ms) + {step - 1}) // {step} * {step} as low,
                      (max(received_at_ms) + {step - 1}) // {step} * {step} as high from {flows})),
counters as (
  select window_secs, tick_ms, count(*) as flows, cast(sum(packets) as bigint) as packets,
         cast(sum(bytes) as bigint) as bytes,
         count(*) filter (protocol = 6) as tcp_flows,
         count(*) filter (protocol = 6 and tcp_flags & 2 <> 0 and tcp_flags & 16 = 0) as syn_only_flows,
         cast(coalesce(sum(greatest(end_time - start_time, 0)) filter (protocol = 6)
              // nullif(count(*) filter (protocol = 6), 0), 0) as bigint) as avg_flow_duration_ms,
         count(*) filter (protocol = 17) as udp_flows,
         count(distinct src_ip) as unique_src_ips, count(distinct dst_ip) as unique_dst_ips
  from hits group by all),
protocols as (
  select window_secs, tick_ms, string_agg(protocol || '=' || n, ',' order by protocol) as protocol_dist
  from (select window_secs, tick_ms, protocol, count(*) as n from hits group by all) group by all),
ends as (
  select window_secs, tick_ms, 0 as side, src_ip as ip, bytes from hits
  union all select window_secs, tick_ms, 1, dst_ip, bytes from hits),
endpoint_bytes as (
  select window_secs, tick_ms, side, ip, cast(sum(bytes) as bigint) as bytes from ends group by all),
ranked as (
  select *, cast(row_number() over (partition by window_secs, tick_ms, side order by bytes desc, ip) as integer) as rank
  from endpoint_bytes qualify rank <= 5),
talkers as (
  select window_secs, tick_ms,
         string_agg({ip('ip')} || '=' || bytes, ',' order by rank) filter (side = 0) as top_src_ips,
         string_agg({ip('ip')} || '=' || bytes, ',' order by rank) filter (side = 1) as top_dst_ips,
         string_agg({ip('ip')} || '(' || bytes || 'B)', ', ' order by rank) filter (side = 1) as top_dst_shown,
         max(ip) filter (side = 1 and rank = 1) as top_dst, max(bytes) filter (side = 1 and rank = 1) as top_dst_bytes
  from ranked group by all),
fanout as (
  select window_secs, tick_ms, src_ip, count(distinct dst_port) as n_ports from hits group by all),
busy as (
  select window_secs, tick_ms, c.flows, c.packets, c.bytes,
         c.flows / cast(window_secs as double) as flows_per_sec,
         c.packets / cast(window_secs as double) as packets_per_sec,
         c.bytes / cast(window_secs as double) as bytes_per_sec,
         c.unique_src_ips, c.unique_dst_ips, t.top_src_ips, t.top_dst_ips, p.protocol_dist,
         c.tcp_flows, c.syn_only_flows, c.avg_flow_duration_ms, c.udp_flows, t.top_dst_shown, t.top_dst, t.top_dst_bytes
  from counters c join protocols p using (window_secs, tick_ms) join talkers t using (window_secs, tick_ms)),
metrics as (
  select window_secs, tick_ms, coalesce(flows, 0) as flows, coalesce(packets, 0) as packets,
         coalesce(bytes, 0) as bytes, coalesce(flows_per_sec, 0) as flows_per_sec,
         coalesce(packets_per_sec, 0) as packets_per_sec, coalesce(bytes_per_sec, 0) as bytes_per_sec,
         coalesce(unique_src_ips, 0) as unique_src_ips, coalesce(unique_dst_ips, 0) as unique_dst_ips,
         coalesce(top_src_ips, '') as top_src_ips, coalesce(top_dst_ips, '') as top_dst_ips,
         coalesce(protocol_dist, '') as protocol_dist, coalesce(tcp_flows, 0) as tcp_flows,
         coalesce(syn_only_flows, 0) as syn_only_flows,
         coalesce(avg_flow_duration_ms, 0) as avg_flow_duration_ms,
         coalesce(udp_flows, 0) as udp_flows, top_dst_shown, top_dst, top_dst_bytes
  from spine left join busy using (window_secs, tick_ms))"""


METRIC_FIELDS = ("tick_ms, window_secs, flows, packets, bytes, flows_per_sec, packets_per_sec, bytes_per_sec, "
                 "unique_src_ips, unique_dst_ips, top_src_ips, top_dst_ips, protocol_dist")
ALL_METRIC_FIELDS = METRIC_FIELDS + ", tcp_flows, syn_only_flows, avg_flow_duration_ms"


def _rounded(value: str) -> str:
    return f"cast(cast(round_even({value}, 0) as bigint) as varchar)"


CANDIDATES = f"""
widest as (
  select window_secs, tick_ms, src_ip, n_ports from fanout where window_secs = 60 and n_ports >= 50
  qualify row_number() over (partition by tick_ms order by n_ports desc, src_ip) = 1),
candidates as (
  select 'udp_flood' as rule, 'High' as severity, cast(null as bigint) as target_ip, window_secs,
         'packets/sec: ' || {_rounded('packets_per_sec')} || ' (threshold: 1000) | UDP ratio: '
         || {_rounded('cast(udp_flows as double) / flows * 100.0')} || '% of flows (threshold: 80%) | unique source IPs: '
         || unique_src_ips || ' (threshold: 10) | unique destination IPs: ' || unique_dst_ips
         || ' | top destination IPs: ' || top_dst_shown as indicators, tick_ms as triggered_ms
  from metrics where window_secs = 10 and flows > 0 and packets_per_sec >= 1000
    and cast(udp_flows as double) / flows >= 0.8 and unique_src_ips >= 10
  union all
  select 'syn_flood', 'High', null, window_secs,
         'packets/sec: ' || {_rounded('packets_per_sec')} || ' (threshold: 500) | SYN-only ratio: '
         || {_rounded('cast(syn_only_flows as double) / tcp_flows * 100.0')}
         || '% of TCP flows (threshold: 70%) | average flow duration: ' || avg_flow_duration_ms
         || 'ms (threshold: 500ms) | unique destination IPs: ' || unique_dst_ips
         || ' | top destination IPs: ' || top_dst_shown, tick_ms
  from metrics where window_secs = 10 and tcp_flows > 0 and packets_per_sec >= 500
    and cast(syn_only_flows as double) / tcp_flows >= 0.7 and avg_flow_duration_ms <= 500
  union all
  select 'destination_hotspot', 'Medium', top_dst, window_secs,
         'destination ' || {ip('top_dst')} || ' received '
         || {_rounded('cast(top_dst_bytes as double) / bytes * 100.0')} || '% of total traffic in ' || window_secs
         || 's window (threshold: 80%) | traffic rate: ' || printf('%.1f', bytes_per_sec / 1000000.0) || ' MB/sec', tick_ms
  from metrics where window_secs = 10 and bytes > 0 and bytes_per_sec >= 100
    and cast(top_dst_bytes as double) / bytes >= 0.8
  union all
  select 'port_scan', 'Medium', src_ip, window_secs,
         'source ' || {ip('src_ip')} || ' contacted ' || n_ports || ' unique destination ports in ' || window_secs
         || 's (threshold: 50) | average bytes per flow: ' || {_rounded('cast(bytes as double) / flows')}
         || ' bytes (threshold: 100)', tick_ms
  from metrics join widest using (window_secs, tick_ms) where flows > 0 and cast(bytes as double) / flows <= 100)"""


def cooldown(quiet_ms: int = 60_000) -> str:
    return f"""
nexts as (
  select a.rule, a.target_ip, a.triggered_ms, min(b.triggered_ms) as next_ms
  from candidates a left join candidates b
    on a.rule = b.rule and a.target_ip is not distinct from b.target_ip
   and b.triggered_ms >= a.triggered_ms + {quiet_ms}
  group by all),
chain as (
  select rule, target_ip, min(triggered_ms) as triggered_ms from candidates group by all
  union all
  select n.rule, n.target_ip, n.next_ms from chain c join nexts n
    on n.rule = c.rule and n.target_ip is not distinct from c.target_ip and n.triggered_ms = c.triggered_ms
  where n.next_ms is not null),
fired as (
  select c.* from candidates c join chain k
    on c.rule = k.rule and c.target_ip is not distinct from k.target_ip and c.triggered_ms = k.triggered_ms)"""


STORED = """
stored as (
  select row_number() over (order by triggered_ms, rule, target_ip nulls first) as id, * from fired)"""


def sql(*ctes: str, body: str) -> str:
    return "with recursive " + ",".join(ctes) + "\n" + body


def windowed(body: str, **how) -> str:
    return sql(FLOWS, windows(**how), body=body)


def detected(*more: str, body: str, flows: str = "all_flows", quiet_ms: int = 60_000) -> str:
    extra = () if flows == "all_flows" else (PACKED, DECODED)
    return sql(FLOWS, *extra, windows(flows, sizes="(10), (60)" if flows == "all_flows" else "(10), (60), (300)"),
               CANDIDATES, cooldown(quiet_ms), *more, body=body)


def _second(ms: str) -> str:
    return f"strftime(make_timestamp({ms} // 1000 * 1000000), '%Y-%m-%dT%H:%M:%S')"


def _rfc(ms: str, zone: str) -> str:
    return (f"{_second(ms)} || case when {ms} % 1000 = 0 then '' else '.' || lpad(cast({ms} % 1000 as varchar), 3, '0') end"
            f" || '{zone}'")


ALERT_FIELDS = "rule, severity, target_ip, window_secs, indicators, triggered_ms"
STORED_FIELDS = "id, " + ALERT_FIELDS
NEWEST = "order by triggered_ms desc, id desc limit"


def _json(identifier: str, zone: str) -> str:
    return (f"""'{{"id":' || {identifier} || ',"rule":"' || rule || '","severity":"' || severity || '","target_ip":' """
            f"""|| coalesce('"' || {ip('target_ip')} || '"', 'null') || ',"window_secs":' || window_secs """
            f"""|| ',"indicators":["' || replace(indicators, ' | ', '","') || '"],"triggered_at":"' """
            f"""|| {_second('triggered_ms')} || '{zone}"}}'""")


EXPORTER_TICKS = """
exporter_spans as (
  select distinct exporter_ip, (received_at_ms + 9999) // 10000 * 10000 as first_ms,
         (received_at_ms + 299999) // 10000 * 10000 as last_ms from all_flows),
exporter_ticks as (
  select tick_ms, count(distinct exporter_ip) as active_exporters
  from (select exporter_ip, unnest(generate_series(first_ms, last_ms, 10000)) as tick_ms from exporter_spans)
  group by all)"""

_RULE_LABEL = "'rule=' || rule"
SAMPLES = f"""
moments as (select distinct tick_ms from spine where window_secs = 10),
arrivals as (
  select (received_at_ms + 9999) // 10000 * 10000 as tick_ms, count(*) as flows, sum(packets) as packets,
         sum(bytes) as bytes from all_flows group by all),
totals as (
  select tick_ms, sum(coalesce(flows, 0)) over (order by tick_ms) as flows,
         sum(coalesce(packets, 0)) over (order by tick_ms) as packets,
         sum(coalesce(bytes, 0)) over (order by tick_ms) as bytes
  from moments left join arrivals using (tick_ms)),
samples as (
  select tick_ms, 'flows_total' as metric, '' as labels, cast(flows as double) as value from totals
  union all select tick_ms, 'packets_total', '', packets from totals
  union all select tick_ms, 'bytes_total', '', bytes from totals
  union all select m.tick_ms, 'alerts_total', {_RULE_LABEL}, cast(count(*) as double)
    from moments m join fired f on f.triggered_ms <= m.tick_ms group by m.tick_ms, rule
  union all select tick_ms, 'active_exporters', '', cast(coalesce(active_exporters, 0) as double)
    from moments left join exporter_ticks using (tick_ms)
  union all select tick_ms, 'flows_per_sec', 'window=' || window_secs || 's', flows_per_sec from metrics
  union all select tick_ms, 'packets_per_sec', 'window=' || window_secs || 's', packets_per_sec from metrics
  union all select tick_ms, 'bytes_per_sec', 'window=' || window_secs || 's', bytes_per_sec from metrics
  union all select tick_ms, 'unique_src_ips', 'window=' || window_secs || 's', cast(unique_src_ips as double) from metrics
  union all select tick_ms, 'unique_dst_ips', 'window=' || window_secs || 's', cast(unique_dst_ips as double) from metrics)"""

NOISE = """
noise as (
  select chunk * 2 as seq, case chunk % 10 when 3 then 'v5' when 6 then 'v9' when 7 then 'v5' end as kind,
         case chunk % 10 when 3 then 'length_mismatch(2, 1)' when 4 then 'unsupported_version(7)'
              when 5 then 'too_short(2, 1)' when 6 then 'too_short(20, 10)' end as error,
         case chunk % 10 when 3 then 72 when 4 then 32 when 5 then 1 when 6 then 10 when 7 then 24 end as size,
         case chunk % 10 when 3 then 5 when 4 then 7 when 6 then 9 when 7 then 5 end as version
  from chunks where chunk % 10 between 3 and 7)"""

DATAGRAMS = """
data_grams as (
  select exporter_ip, chunk, chunk * 2 + 1 as seq, layout, count(*) as n from packed group by all),
template_grams as (
  select e as exporter_ip, chunk, chunk * 2 as seq, chunk // 64 % 2 as layout
  from chunks, (values ('127.0.0.2'), ('127.0.0.3')) x(e) where chunk > 0 and chunk % 16 = 0),
body_sizes as (
  select exporter_ip, seq, 300 as set_id, case exporter_ip when '127.0.0.2'
           then n * (case layout when 0 then 30 else 23 end) + 3 else n * 34 end as body_bytes
  from data_grams where exporter_ip <> '127.0.0.1'
  union all
  select exporter_ip, seq, case exporter_ip when '127.0.0.2' then 0 else 2 end,
         case when exporter_ip = '127.0.0.2' then case layout when 0 then 44 else 40 end
              else case layout when 0 then 52 else 44 end end
  from template_grams),
captured as (
  select exporter_ip, seq, 'v5' as kind, cast(null as varchar) as error, 24 + 48 * n as size, 5 as version
  from data_grams where exporter_ip = '127.0.0.1'
  union all
  select exporter_ip, seq, case exporter_ip when '127.0.0.2' then 'v9' else 'ipfix' end, null,
         body_bytes + 4 + case exporter_ip when '127.0.0.2' then 20 else 16 end,
         case exporter_ip when '127.0.0.2' then 9 else 10 end
  from body_sizes
  union all select '127.0.0.1', seq, kind, error, size, version from noise)"""

# Field lists and column offsets of the fixture's four layouts.
TEMPLATE_TEXT = """
texts(exporter_ip, layout, total_length, fields, offsets, usable) as (values
  ('127.0.0.2', 0, 30, '8:4,12:4,7:2,11:2,4:1,2:4,1:4,22:4,21:4,6:1', '0,4,8,10,12,13,17,21,25,29', true),
  ('127.0.0.2', 1, 23, '1:4,2:4,61:1,4:1,6:1,11:2,7:2,12:4,8:4', '19,15,13,11,9,4,0,-,-,10', true),
  ('127.0.0.3', 0, 34, '8:4:9876,8:4,12:4,7:2,11:2,4:1,2:4,1:4,22:4,21:4,6:1', '4,8,12,14,16,17,21,25,29,33', true),
  ('127.0.0.3', 1, 34, '8:4,12:4,7:2,11:2,4:1,2:4,1:8,22:4,21:4,6:1', '0,4,8,10,12,13,-,25,29,33', false))"""

LOGS = """
logs as (
  select 1704067200000 + (epoch_us(ts) - 1704067200000000) // 1000000 as ts_ms, event_type as level,
         case when event_type = 'error' and user_id % 2 = 0 then 'ALERT' when event_type = 'error' then 'Alert'
              else event_type end as message, event_id
  from events)"""


def _captured(body: str) -> str:
    return sql(FLOWS, PACKED, NOISE, DATAGRAMS, TEMPLATE_TEXT, body=body)


def _decoded(table: str) -> str:
    return sql(FLOWS, PACKED, DECODED, body=f"select {FLOW_FIELDS}, "
               + ("received_at_ms" if table == "all_decoded" else "at_ms as received_at_ms") + f" from {table}")


def _rule(name: str) -> str:
    return detected(body=f"select {ALERT_FIELDS} from candidates where rule = '{name}'")


def _store(body: str) -> str:
    return detected(STORED, body=body)


_TIES = FLOW_FIELDS
_HISTORY = (f"select {ip('src_ip')} as src_ip, {ip('dst_ip')} as dst_ip, src_port, dst_port, protocol, packets, bytes, "
            f"{_second('received_at_ms')} || 'Z' as received_at, count(*) over () as total from "
            "(select * from all_flows where received_at_ms between {low} and {high} "
            f"order by received_at_ms desc, {_TIES} limit {{limit}})")

YEAR = """
year_flows as (
  select * exclude (received_at_ms), received_at_ms + (bytes * 7 + src_port) % 365 * 86400000 as received_at_ms from all_flows)"""

ORACLES: dict[str, str] = {
    "read_datagrams": _captured(
        "select exporter_ip, count(*) as datagrams, cast(sum(size) as bigint) as payload_bytes from captured group by all"),
    "version_gate": _captured(
        "select exporter_ip, version, count(*) as datagrams from captured where version in (5, 9) group by all"),
    "read_datagrams_rows": _captured("select exporter_ip, seq, cast(size as integer) as payload_bytes from captured"),
    "version_gate_rows": _captured(
        "select exporter_ip, seq, version, cast(size as integer) as payload_bytes from captured where version in (5, 9)"),
    "classify_datagrams": _captured("select exporter_ip, seq, kind, error from captured"),
    "decode_errors": _captured(
        "select error, count(*) as datagrams, cast(sum(size) as bigint) as payload_bytes from captured "
        "where error is not null group by all"),
    "decode_v5_flows": _decoded("decoded_v5"),
    "split_sets": _captured(
        "select exporter_ip, cast(7 as bigint) as domain, seq, 0 as set_idx, set_id, cast(body_bytes as integer) as body_bytes "
        "from body_sizes"),
    "parse_templates": _captured(
        "select exporter_ip, cast(7 as bigint) as domain, 300 as template_id, seq, 0 as tmpl_idx, total_length, fields "
        "from template_grams join texts using (exporter_ip, layout)"),
    "template_history": _captured(
        "select exporter_ip, cast(7 as bigint) as domain, 300 as template_id, seq * 16384 as from_pos, "
        "lead(seq * 16384) over (partition by exporter_ip order by seq) as to_pos, total_length, usable, offsets from "
        "(select *, lag(layout) over (partition by exporter_ip order by seq) as previous from template_grams) "
        "join texts using (exporter_ip, layout) where previous is null or previous <> layout"),
    "layout_cover": _captured(
        "select exporter_ip, from_pos, to_pos, from_pos // 16384 as first_packet, to_pos // 16384 - 1 as last_packet, "
        "(to_pos - from_pos) // 16384 as packets, true as few from (select exporter_ip, seq * 999983 * 16384 as from_pos, "
        "lead(seq * 999983 * 16384) over (partition by exporter_ip order by seq) as to_pos from "
        "(select *, lag(layout) over (partition by exporter_ip order by seq) as previous from template_grams) "
        "where previous is null or previous <> layout) where to_pos is not null"),
    "decode_templated_flows": _decoded("decoded_templated"),
    "decode_templated_flows_without_broadcast": _decoded("decoded_templated"),
    "decode_flows": _decoded("all_decoded"),
    "decode_flows_long_validity": _decoded("all_decoded"),
    "split_sets_several": sql(FLOWS, body=(
        "select exporter_ip, seq, s.set_idx, s.set_id, cast(s.body_bytes as integer) as body_bytes from (select exporter_ip, "
        "flow_id // 30 as seq, unnest([{'set_idx': 0, 'set_id': case exporter_ip when '127.0.0.2' then 0 else 2 end, "
        "'body_bytes': 84}, {'set_idx': 1, 'set_id': 300, 'body_bytes': 30 * count(*) filter (flow_id % 2 = 0)}, "
        "{'set_idx': 3, 'set_id': 301, 'body_bytes': 23 * count(*) filter (flow_id % 2 = 1)}]) as s "
        "from all_flows where exporter_ip <> '127.0.0.1' group by exporter_ip, flow_id // 30)")),
    "decode_flows_several_sets": sql(FLOWS, body=(
        f"select {FLOW_FIELDS}, received_at_ms from (select * replace (case when flow_id % 2 = 0 then start_time else 0 end "
        "as start_time, case when flow_id % 2 = 0 then end_time else 0 end as end_time, "
        "max(received_at_ms) over (partition by exporter_ip, flow_id // 30) as received_at_ms) from all_flows "
        "where exporter_ip <> '127.0.0.1')")),
    "flow_totals": sql(FLOWS, body="select count(*) as flows, cast(sum(packets) as bigint) as packets, "
                                   "cast(sum(bytes) as bigint) as bytes from all_flows"),
    "exporter_last_seen": sql(
        FLOWS, body="select exporter_ip, max(received_at_ms) as last_seen_ms from all_flows group by all"),
    "active_exporters": sql(
        FLOWS, body="select count(distinct exporter_ip) as active_exporters from all_flows "
                    "where received_at_ms <= 1704068400000 and received_at_ms > 1704068400000 - 300000"),
    "active_exporters_per_tick": sql(FLOWS, EXPORTER_TICKS, body="select * from exporter_ticks"),
    "flow_events": sql(FLOWS, body=(
        """select received_at_ms, '{"src_ip":"' || """ + ip("src_ip") + """ || '","dst_ip":"' || """ + ip("dst_ip")
        + """ || '","src_port":' || src_port || ',"dst_port":' || dst_port || ',"protocol":' || protocol"""
        + """ || ',"packets":' || packets || ',"bytes":' || bytes || ',"start_time":' || start_time"""
        + """ || ',"end_time":' || end_time || ',"tcp_flags":' || tcp_flags || ',"exporter_ip":"' || exporter_ip"""
        + """ || '","received_at":"' || """ + _rfc("received_at_ms", "Z") + """ || '"}' as event from all_flows""")),
    "write_flows": sql(FLOWS, body=(
        "select strftime(make_timestamp(received_at_ms * 1000), '%Y-%m-%d') as flow_date, count(*) as flows, "
        "cast(sum(bytes) as bigint) as bytes, max(received_at_ms) as newest_ms from all_flows group by all")),
    "write_flows_rows": sql(FLOWS, body=(
        f"select {FLOW_FIELDS}, received_at_ms, strftime(make_timestamp(received_at_ms * 1000), '%Y-%m-%d') as flow_date from all_flows")),
    "flow_history_of_a_year": sql(FLOWS, YEAR, body=_HISTORY.format(
        low=1704067200000, high=1748736000000, limit=700).replace("from all_flows", "from year_flows")),
    "flows_in_range": sql(FLOWS, body=(
        f"select {FLOW_FIELDS}, received_at_ms from all_flows where received_at_ms between 1704067800000 and 1704068100000 "
        f"order by received_at_ms desc, {_TIES} limit 500")),
    "flow_history": sql(FLOWS, body=_HISTORY.format(low=1704065400000, high=1704069000000, limit=250)),
    "flow_history_defaults": sql(FLOWS, body=_HISTORY.format(low=1704066180000, high=1704069780000, limit=100)),
    "scalar_functions": sql(FLOWS, body=(
        f"select flow_id, {ip('dst_ip')} as dst_text, dst_ip as dst_again, {_second('received_at_ms')} || 'Z' as second_text, "
        f"{_rfc('received_at_ms', '+00:00')} as rfc_text, received_at_ms as rfc_again, bytes // packets as mean_size, "
        "cast(cast(round_even(flow_id / 8.0::double, 0) as bigint) as varchar) as rounded, "
        "printf('%.1f', flow_id / 80.0::double) as rounded_1, greatest(packets - flow_id % 700, 0) as rest, "
        "tcp_flags & 16 <> 0 as acked from all_flows")),
    "tick_spine": windowed("select window_secs, tick_ms from spine"),
    "assign_windows": windowed(
        "select window_secs, tick_ms, count(*) as flows, min(received_at_ms) as oldest_ms, "
        "max(received_at_ms) as newest_ms from hits group by all"),
    "assign_windows_odd_ticks": windowed(
        "select window_secs, tick_ms, count(*) as flows from hits group by all", sizes="(10), (60)", step=7000),
    "window_counts": windowed("select window_secs, tick_ms, flows, packets, bytes from counters"),
    "window_counts_sparse_ticks": windowed(
        "select window_secs, tick_ms, flows, packets, bytes from counters", sizes="(10)", step=25000),
    "window_rates": windowed(
        "select window_secs, tick_ms, flows, packets, bytes, flows_per_sec, packets_per_sec, bytes_per_sec from busy"),
    "unique_endpoints": windowed("select window_secs, tick_ms, unique_src_ips, unique_dst_ips from counters"),
    "bytes_by_endpoint": windowed("select window_secs, tick_ms, side, ip, bytes from endpoint_bytes"),
    "top_talkers": windowed("select window_secs, tick_ms, side, ip, bytes, rank from ranked"),
    "protocol_distribution": windowed(
        "select window_secs, tick_ms, protocol, count(*) as flows from hits group by all"),
    "tcp_counters": windowed(
        "select window_secs, tick_ms, tcp_flows, syn_only_flows, avg_flow_duration_ms from counters"),
    "source_port_fanout": windowed("select window_secs, tick_ms, src_ip, n_ports from fanout"),
    "window_metrics_10s": windowed(f"select {ALL_METRIC_FIELDS} from metrics", sizes="(10)"),
    "window_metrics": windowed(f"select {ALL_METRIC_FIELDS} from metrics"),
    "window_metrics_busy_ticks": windowed(f"select {ALL_METRIC_FIELDS} from busy"),
    "latest_snapshot": windowed(
        f"select {ALL_METRIC_FIELDS} from metrics where tick_ms = (select max(tick_ms) from spine)"),
    "snapshot_event": windowed(f"select {METRIC_FIELDS} from metrics"),
    **{f"rule_{name}": _rule(name) for name in ("udp_flood", "syn_flood", "destination_hotspot", "port_scan")},
    "port_scan_all_sources": windowed(
        "select 'port_scan' as rule, 'Medium' as severity, src_ip as target_ip, window_secs, tick_ms as triggered_ms "
        "from fanout join spine using (window_secs, tick_ms) where window_secs = 60 and n_ports >= 4"),
    "route_rules": detected(body=f"select {ALERT_FIELDS} from candidates"),
    "apply_cooldown": detected(body=f"select {ALERT_FIELDS} from fired"),
    "apply_cooldown_short_blocks": detected(
        body="select rule, severity, target_ip, window_secs, triggered_ms from fired", quiet_ms=45_000),
    "alerts_by_rule_counts": detected(body="select rule, count(*) as alerts from fired group by all"),
    "recent_alerts": _store(f"select {STORED_FIELDS} from stored {NEWEST} 100"),
    "append_alerts": detected(body=(
        f"select row_number() over (order by severity, triggered_ms, rule, target_ip nulls first) as id, {ALERT_FIELDS} "
        "from fired")),
    "alerts_recent": _store(f"select {STORED_FIELDS} from stored {NEWEST} 10"),
    "alert_by_id": _store(f"select {STORED_FIELDS} from stored where id = 7"),
    "alerts_by_ip": _store(f"select {STORED_FIELDS} from stored where target_ip = 16843009 {NEWEST} 5"),
    "alerts_by_rule": _store(f"select {STORED_FIELDS} from stored where rule = 'udp_flood' {NEWEST} 5"),
    "query_alerts": _store(f"select {STORED_FIELDS} from stored where rule = 'syn_flood' {NEWEST} 20"),
    "query_alerts_defaults": _store(f"select {STORED_FIELDS} from stored {NEWEST} 20"),
    "alert_json": _store(f"select id, {_json('id', '+00:00')} as json from stored"),
    "normalize_alert_rows": (
        "select event_id as id, event_type as rule, case event_id % 4 when 0 then 'Low' when 1 then 'Medium' else 'High' end "
        "as severity, case when event_id % 6 = 0 then 167772160 + event_id % 100 end as target_ip, "
        "cast(60 as bigint) as window_secs, case event_id % 9 when 0 then 'a ' || event_id % 100 || ' | b' when 7 then 'q' "
        "else '' end as indicators, case event_id % 7 when 0 then 1704067200000 + event_id % 60 * 1000 "
        "when 2 then 1704067205250 when 4 then 1704067205000 when 5 then 1704067260000 else 1706832000000 end "
        "as triggered_ms from events"),
    "summary": sql(FLOWS, windows(sizes="(10)"), EXPORTER_TICKS, body=(
        "select window_secs, flows_per_sec, packets_per_sec, bytes_per_sec, unique_src_ips, unique_dst_ips, "
        "coalesce(active_exporters, 0) as active_exporters from metrics left join exporter_ticks using (tick_ms) "
        "where tick_ms = (select max(tick_ms) from spine)")),
    "top_talkers_view": windowed(
        f"select window_secs, case side when 0 then 'source' else 'destination' end as side, rank, {ip('ip')} as ip, bytes, "
        "bytes / cast(window_secs as double) as bytes_per_sec from ranked "
        "where tick_ms = (select max(tick_ms) from spine)", sizes="(60)"),
    "metric_samples": sql(
        FLOWS, windows(), CANDIDATES, cooldown(), EXPORTER_TICKS, SAMPLES, body="select * from samples"),
    "alert_outbox": detected(body=f"select rule, triggered_ms, {_json(chr(39) + 'null' + chr(39), 'Z')} as payload from fired"),
    "dashboard_stats": sql(
        FLOWS, windows(), CANDIDATES, cooldown(), EXPORTER_TICKS, SAMPLES,
        body="select metric, value from samples where tick_ms = (select max(tick_ms) from spine) and labels in ('', 'window=10s') "
             "and metric in ('flows_per_sec', 'bytes_per_sec', 'unique_src_ips', 'unique_dst_ips', 'active_exporters')"),
    "dashboard_total_alerts": detected(body="select count(*) as alerts from fired"),
    "dashboard_total_alerts_when_none": sql(FLOWS, body="select count(*) as alerts from all_flows where false"),
    **{f"dashboard_series_{m}": windowed(f"select tick_ms, window_secs, {m} as value from metrics")
       for m in ("flows_per_sec", "bytes_per_sec", "packets_per_sec")},
    "dashboard_detections_by_rule": detected(body="select rule, count(*) as alerts from fired group by all"),
    "log_lines_all": sql(LOGS, body=(
        """select ts_ms, level, message, '{"level":"' || level || '","message":"' || message || '","event_id":' """
        """|| event_id || '}' as line from logs""")),
    "log_filter_level": sql(LOGS, body="select ts_ms, level, message from logs where level in ('error', 'warn')"),
    "log_filter_alerts": sql(LOGS, body="select ts_ms, level, message from logs where lower(message) = 'alert'"),
    "log_rate": sql(LOGS, body=(
        "select tick_ms, level, count(*) / 60.0::double as rate from (select level, unnest(generate_series("
        "(ts_ms + 14999) // 15000 * 15000, (ts_ms + 59999) // 15000 * 15000, 15000)) as tick_ms from logs) group by all")),
    "stream_window_metrics": windowed(f"select {ALL_METRIC_FIELDS} from busy"),
    "stream_window_metrics_out_of_order": windowed(f"select {ALL_METRIC_FIELDS} from busy"),
    "stream_alerts_between": detected(STORED, body=(
        f"select {STORED_FIELDS} from stored, (select min(received_at_ms) as low, "
        "(max(received_at_ms) - min(received_at_ms)) // 3 as third from all_flows) "
        "where triggered_ms between low + third and low + 2 * third")),
    "stream_alerts_from_datagrams": detected(STORED, flows="all_decoded", body=f"select {STORED_FIELDS} from stored"),
    "stream_totals": sql(FLOWS, body="select count(*) as flows, cast(sum(packets) as bigint) as packets, "
                                     "cast(sum(bytes) as bigint) as bytes from all_flows"),
}
