import random

import pytest
from moments import T0, moment
from packets import STANDARD, cut, ipfix, record, template, v5, v5_record, v9
from pyspark.sql import functions as F

from weirgauge.operators.decode import decode_flows, decode_templated, decode_v5
from weirgauge.operators.sets import split_sets
from weirgauge.operators import templates
from weirgauge.operators.templates import (
    dyadic_blocks, layout_cover, parse_templates, read_templates, template_history, template_layouts,
)
from weirgauge.schema import DATAGRAM_SCHEMA
from weirgauge.sources.datagrams import classify_datagrams, decode_errors, read_datagrams, version_gate


@pytest.fixture(scope="module")
def capture(spark):
    def make(*payloads, exporter="127.0.0.1"):
        rows = [(n, moment(T0 + n), exporter, bytearray(p)) if not isinstance(p, tuple)
                else (n, moment(T0 + n), p[0], bytearray(p[1])) for n, p in enumerate(payloads)]
        return spark.createDataFrame(rows, DATAGRAM_SCHEMA)
    return make


def flows_of(datagrams, **how):
    return decode_flows(datagrams, **how).orderBy("received_at_ms", "bytes").collect()


def test_v5_single_record(capture):
    (row,) = flows_of(capture(v5(v5_record())))
    assert (row.src_ip, row.dst_ip, row.src_port, row.dst_port) == (0x0A000001, 0x0A000002, 1024, 80)
    assert (row.protocol, row.packets, row.bytes, row.tcp_flags) == (6, 100, 5000, 2)
    assert (row.exporter_ip, row.received_at_ms) == ("127.0.0.1", T0)


def test_v5_three_records_and_large_counters(capture):
    rows = decode_v5(classify_datagrams(capture(
        v5(*[v5_record(proto=17, packets=1, octets=64)] * 3), v5(), v5(v5_record(octets=4_000_000_000))))).collect()
    assert sorted(r.bytes for r in rows) == [64, 64, 64, 4_000_000_000]


def test_errors(capture):
    good = v5(v5_record())
    bad = capture(bytes(10), b"", b"\x00", v5(v5_record(), count=2), b"\x00\x05" + bytes(8), b"\x00\x09" + bytes(17),
                  b"\x00\x0a" + bytes(13), b"\x00\x07" + bytes(60), good)
    found = [r.error for r in decode_errors(classify_datagrams(bad)).orderBy("seq").collect()]
    assert found == ["unsupported_version(0)", "too_short(2, 0)", "too_short(2, 1)", "length_mismatch(2, 1)",
                     "too_short(24, 10)", "too_short(20, 19)", "too_short(16, 15)", "unsupported_version(7)"]
    assert len(flows_of(bad)) == 1


def test_version_gate(capture):
    mixed = capture(v5(v5_record()), v9(), ipfix(), b"\x00")
    assert version_gate(mixed, []).count() == 4
    assert [r.seq for r in version_gate(mixed, [5]).collect()] == [0]
    assert version_gate(mixed, [9, 10]).count() == 2


def test_v9_template_only(capture):
    datagrams = capture(v9(cut(0, template(256, STANDARD))))
    assert flows_of(datagrams) == []
    (found,) = parse_templates(split_sets(classify_datagrams(datagrams))).collect()
    assert (found.template_id, found.total_length, len(found.fields)) == (256, 30, 10)


@pytest.mark.parametrize("pack, template_set", [(v9, 0), (ipfix, 2)])
def test_template_and_data(capture, pack, template_set):
    (row,) = flows_of(capture(pack(cut(template_set, template(256, STANDARD)), cut(256, record() + bytes(4)))))
    assert (row.src_ip, row.packets, row.bytes) == (0x0A000001, 100, 5000)
    assert (row.start_time, row.end_time, row.tcp_flags) == (1000, 2000, 2)


def test_data_before_template_is_dropped(capture):
    announce, data = cut(0, template(256, STANDARD)), cut(256, record())
    assert flows_of(capture(v9(data))) == []
    # In one packet, only what comes after the template resolves.
    assert len(flows_of(capture(v9(cut(256, record(ie1=1)), announce, cut(256, record(ie1=2)))))) == 1
    assert [r.bytes for r in flows_of(capture(v9(cut(256, record(ie1=1))), v9(announce), v9(cut(256, record(ie1=2)))))] == [2]


def test_templates_are_per_exporter_and_domain_but_not_per_format(capture):
    announce, data = cut(0, template(256, STANDARD)), cut(256, record())
    assert flows_of(capture(("a", v9(announce)), ("b", v9(data)))) == []
    assert flows_of(capture(v9(announce, domain=1), v9(data, domain=2))) == []
    assert len(flows_of(capture(v9(announce), ipfix(data)))) == 1


def test_redefinition(capture):
    short = [(8, 4), (12, 4), (4, 1), (2, 4), (1, 4)]
    rows = flows_of(capture(
        v9(cut(0, template(256, STANDARD))), v9(cut(256, record(ie1=1))), v9(cut(0, template(256, STANDARD))),
        v9(cut(0, template(256, short))), v9(cut(256, record(short, ie1=2)))))
    assert [(r.bytes, r.end_time) for r in rows] == [(1, 2000), (2, 0)]
    changed = capture(v9(cut(0, template(9000, [(8, 4), (12, 4)]) + template(9000, [(8, 4), (12, 4), (7, 2), (11, 2)]))))
    (kept,) = template_history(parse_templates(split_sets(classify_datagrams(changed)))).collect()
    assert kept.total_length == 12


def test_history_drops_repeats(capture):
    sent = capture(*[v9(cut(0, template(256, STANDARD)))] * 5, v9(cut(0, template(256, STANDARD[:5]))),
                   *[v9(cut(0, template(256, STANDARD)))] * 2)
    history = template_history(parse_templates(split_sets(classify_datagrams(sent)))).orderBy("from_pos").collect()
    assert [(h.total_length, h.to_pos is None) for h in history] == [(30, False), (13, False), (30, True)]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_flapping_template(spark, capture, limit):
    """One key whose layout changes with every second packet: thousands of versions."""
    narrow = [*STANDARD[:5], *STANDARD[6:]]
    packets, wanted = [], []
    for n in range(1500):
        fields = narrow if n % 2 else STANDARD
        packets += [v9(cut(0, template(256, fields))), v9(cut(256, record(fields, ie1=n)), cut(256, record(fields, ie1=n + 10_000)))]
        wanted += [] if n % 2 else [n, n + 10_000]
    found = sorted(r.bytes for r in decode_flows(capture(*packets), broadcast_layouts=limit).select("bytes").collect())
    assert found == sorted(wanted)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_versions_that_are_valid_for_long(spark, capture, limit):
    """Three versions over 10^9 packets; data at their borders and far inside."""
    narrow = STANDARD[:9]
    far = [0, 5, 6, 7, 10**6, 10**9 - 1, 10**9, 10**9 + 1, 10**9 + 4095, 10**9 + 4096, 3 * 10**9, 3 * 10**9 + 1]
    packets = {5: (STANDARD, 1), 10**9: (narrow, 2), 3 * 10**9: (STANDARD, 3)}
    rows, wanted, fields = [], [], None
    for seq in far:
        fields = packets[seq][0] if seq in packets else fields
        announce = [cut(0, template(256, fields))] if seq in packets else []
        before = [cut(256, record(old, ie1=seq % 10**9 + 7))] if (old := {10**9: STANDARD, 3 * 10**9: narrow}.get(seq)) else []
        rows.append((seq, v9(*before, *announce, cut(256, record(fields or STANDARD, ie1=seq % 10**9 + 1)))))
        wanted += [seq % 10**9 + 7] * len(before) + ([seq % 10**9 + 1] if fields else [])
    sent = spark.createDataFrame([(seq, moment(T0 + n), "127.0.0.1", bytearray(p)) for n, (seq, p) in enumerate(rows)], DATAGRAM_SCHEMA)
    assert sorted(r.bytes for r in decode_flows(sent, broadcast_layouts=limit).select("bytes").collect()) == sorted(wanted)
    cover = layout_cover(template_layouts(template_history(parse_templates(split_sets(classify_datagrams(sent))))))
    per_version = cover.groupBy("from_pos").count().collect()
    assert len(per_version) == 3 and max(r["count"] for r in per_version) < 64


def test_payloads_stay_where_they_are(capture):
    sent = capture(v9(cut(0, template(256, STANDARD))), v9(cut(0, template(256, STANDARD[:9]))), v9(cut(256, record())))
    plan = decode_flows(sent)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("BroadcastHashJoin") == 1


def test_dyadic_blocks(spark):
    rng = random.Random(4)
    spans = [(0, 0), (0, 63), (1, 62), (5, 5), (2**48 - 1, 2**48), (0, 2**49 - 1)]
    spans += [tuple(sorted((rng.randrange(2000), rng.randrange(2000)))) for _ in range(40)]
    got = spark.createDataFrame(spans, "a long, b long").select("a", "b", dyadic_blocks(F.col("a"), F.col("b")).alias("c")).collect()
    for a, b, blocks in got:
        pieces = sorted((x.block << x.level, (x.block + 1 << x.level) - 1) for x in blocks)
        assert pieces[0][0] == a and pieces[-1][1] == b
        assert all(q == p + 1 for (_, p), (q, _) in zip(pieces, pieces[1:]))
        assert len(blocks) <= 2 * (b - a + 1).bit_length()


def test_history_is_carried_over_blocks(capture, monkeypatch):
    """Versions, repeats and changes on either side of block borders."""
    monkeypatch.setattr(templates, "HISTORY_BLOCK", 3)
    layouts = {"A": STANDARD, "B": STANDARD[:9], "C": STANDARD[:8]}
    for sent in ("AAAAAAAAA", "ABABABABAB", "AAABBBAAAC", "A--------B-----B---A", "AAAA----AAAABBBBBBBBBC"):
        found = template_history(parse_templates(split_sets(classify_datagrams(capture(*[
            v9(cut(0, template(256, layouts[x]))) if x != "-" else v9() for x in sent]))))).orderBy("from_pos").collect()
        starts = [n for n, x in enumerate(sent) if x != "-" and x != sent[:n].replace("-", "")[-1:]]
        assert [r.from_pos >> 14 for r in found] == starts
        assert [r.to_pos and r.to_pos >> 14 for r in found] == [*starts[1:], None]


def test_withdrawn_template(capture):
    rows = flows_of(capture(
        ipfix(cut(2, template(256, STANDARD))), ipfix(cut(256, record())), ipfix(cut(2, template(256, []))),
        ipfix(cut(256, record()))))
    assert len(rows) == 1


def test_enterprise_fields():
    body = template(256, [(8, 4), (12, 4), (100, 4, 9876)])
    (found,) = read_templates(body, True)
    assert found["fields"][2] == {"type": 100, "len": 4, "enterprise": 9876}
    assert found["total_length"] == 12


def test_truncated_templates_end_the_set():
    whole, torn = template(256, STANDARD), template(257, STANDARD)[:-2]
    for vendor in (False, True):
        assert [t["template_id"] for t in read_templates(whole + torn, vendor)] == [256]
    assert [t["template_id"] for t in read_templates(template(256, [(8, 4, 1)])[:-2], True)] == []
    assert read_templates(template(256, [(1, 65535), (2, 65535)]), False)[0]["total_length"] == 65535


def test_vendor_field_never_maps(capture):
    fields = [(1, 4, 77), *STANDARD]
    data = (9).to_bytes(4, "big") + record()
    (row,) = flows_of(capture(ipfix(cut(2, template(256, fields)), cut(256, data))))
    assert row.bytes == 5000


def test_mapping_needs_exact_widths(capture):
    wide = [(k, 8 if k == 1 else w) for k, w in STANDARD]
    assert flows_of(capture(v9(cut(0, template(256, wide)), cut(256, record(wide))))) == []
    other_clock = [(150 if k == 22 else 151 if k == 21 else k, w) for k, w in STANDARD]
    (row,) = flows_of(capture(v9(cut(0, template(256, other_clock)), cut(256, record(other_clock)))))
    assert (row.start_time, row.end_time) == (0, 0)
    twice = [*STANDARD, (1, 4)]
    (row,) = flows_of(capture(v9(cut(0, template(256, twice)), cut(256, record(ie1=1) + (8).to_bytes(4, "big")))))
    assert row.bytes == 8


def test_malformed_sets_keep_earlier_rows(capture):
    announce, data = cut(0, template(256, STANDARD)), cut(256, record())
    assert len(flows_of(capture(v9(announce, data, cut(256, record(), length=400))))) == 1
    assert len(flows_of(capture(v9(announce, data, cut(256, b"", length=3), data)))) == 1
    # Option templates and reserved ids are skipped.
    assert len(flows_of(capture(v9(announce, cut(1, bytes(8)), cut(77, bytes(8)), data)))) == 1


def test_many_records_and_sets(capture):
    body = b"".join(record(ie1=n) for n in range(40))
    rows = flows_of(capture(v9(cut(0, template(256, STANDARD)), cut(256, body), cut(256, body))))
    assert sorted(r.bytes for r in rows) == sorted(list(range(40)) * 2)


def test_lookup_without_broadcast_agrees(capture):
    packets = [v9(cut(0, template(256, STANDARD)))]
    for n in range(40):
        packets.append(v9(cut(256, record(ie1=n))))
        if n % 10 == 9:
            packets.append(v9(cut(0, template(256, STANDARD if n % 20 == 9 else STANDARD[::-1]))))
    classified = classify_datagrams(capture(*packets))
    wide = decode_templated(classified)
    assert wide.count() == 40
    blocked = decode_templated(classified, broadcast_layouts=0)
    assert wide.exceptAll(blocked).count() == 0 and blocked.exceptAll(wide).count() == 0


def test_two_sources_are_merged(spark, capture, tmp_path):
    capture(v5(v5_record())).write.parquet(str(tmp_path / "a"))
    capture(ipfix(cut(2, template(256, STANDARD)), cut(256, record()))).write.parquet(str(tmp_path / "b"))
    merged = read_datagrams(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert decode_flows(merged).count() == 2
    assert decode_flows(merged, accepted=[5]).count() == 1
    assert read_datagrams(spark, str(tmp_path / "a")).count() == 1
