import json

import pytest
from moments import T0, moment
from pyspark.sql import functions as F

from weirgauge.operators import alerts as A
from weirgauge.streaming.metrics_stream import FIRED_SCHEMA


@pytest.fixture(scope="module")
def fired(spark):
    rows = [("udp_flood", "High", None, 10, ["one", 'two "quoted"'], moment(T0)),
            ("port_scan", "Medium", 16843009, 60, [], moment(T0 + 10_000)),
            ("udp_flood", "High", None, 10, ["three"], moment(T0 + 20_500)),
            ("destination_hotspot", "Medium", 134744072, 10, ["four"], moment(T0 + 86_400_000)),
            ("port_scan", "Medium", 16843009, 60, ["five"], moment(T0 + 86_400_000))]
    return spark.createDataFrame(rows, FIRED_SCHEMA)


@pytest.fixture(scope="module")
def stored(fired):
    return A.number_alerts(fired).cache()


def ids(frame):
    return [r.id for r in frame.collect()]


def test_numbering(stored):
    assert [(r.id, r.rule) for r in stored.orderBy("id").collect()] == [
        (1, "udp_flood"), (2, "port_scan"), (3, "udp_flood"), (4, "destination_hotspot"), (5, "port_scan")]


def test_append_continues_ids(fired, spark, tmp_path):
    path = str(tmp_path / "alerts")
    A.append_alerts(fired.where("rule = 'udp_flood'"), path)
    A.append_alerts(fired.where("rule <> 'udp_flood'"), path)
    A.append_alerts(fired, path)  # a repeated call adds nothing
    table = A.read_alerts(spark, path)
    assert sorted(ids(table)) == [1, 2, 3, 4, 5]
    assert {r.rule for r in table.where("id <= 2").collect()} == {"udp_flood"}


def test_lookups(stored):
    assert ids(A.alerts_recent(stored, 3)) == [5, 4, 3]
    assert ids(A.recent_alerts(stored)) == [5, 4, 3, 2, 1]
    assert ids(A.alert_by_id(stored, 2)) == [2] and ids(A.alert_by_id(stored, 99)) == []
    assert ids(A.alerts_by_ip(stored, "1.1.1.1", 10)) == [5, 2]
    assert ids(A.alerts_by_rule(stored, "udp_flood", 1)) == [3]
    assert {r.rule: r.alerts for r in A.count_by_rule(stored).collect()} == {
        "udp_flood": 2, "port_scan": 2, "destination_hotspot": 1}


def test_query_arguments(stored, spark):
    assert ids(A.query_alerts(stored, rule="udp_flood", ip="1.1.1.1")) == [3, 1]
    assert ids(A.query_alerts(stored, rule="udp_flood", ip="nonsense")) == [3, 1]
    assert ids(A.query_alerts(stored, ip="8.8.8.8")) == [4]
    assert ids(A.query_alerts(stored, limit=2)) == [5, 4]
    assert ids(A.query_alerts(stored, limit=0)) == []
    with pytest.raises(ValueError):
        A.query_alerts(stored, ip="nonsense")
    many = spark.range(300).select(
        (F.col("id") + 1).alias("id"), F.lit("r").alias("rule"), F.lit("High").alias("severity"),
        F.lit(None).cast("bigint").alias("target_ip"), F.lit(10).cast("bigint").alias("window_secs"),
        F.array(F.lit("x")).alias("indicators"), F.timestamp_millis(F.col("id")).alias("triggered_at"))
    assert A.query_alerts(many).count() == 20
    assert A.query_alerts(many, limit=500).count() == 100


def test_json(stored, fired):
    first, second, third = [json.loads(r.json) for r in A.alert_json(stored).orderBy("id").limit(3).collect()]
    assert list(first) == ["id", "rule", "severity", "target_ip", "window_secs", "indicators", "triggered_at"]
    assert first["target_ip"] is None and first["indicators"] == ["one", 'two "quoted"']
    assert second["target_ip"] == "1.1.1.1" and second["indicators"] == []
    assert (second["triggered_at"], third["triggered_at"]) == (
        "2024-01-01T00:00:10+00:00", "2024-01-01T00:00:20.500+00:00")
    payload = json.loads(A.alert_outbox(fired).orderBy("triggered_at").first().payload)
    assert payload["id"] is None and payload["triggered_at"] == "2024-01-01T00:00:00Z"


def test_text_round_trip(stored):
    again = A.normalize_alert_rows(A.alert_text_rows(stored))
    assert again.exceptAll(stored).count() == 0 and again.count() == 5


def test_tolerant_read(spark):
    rows = spark.createDataFrame([
        (1, "r", "Low", "1.1.1.1", 10, '["a"]', "2024-01-01T00:00:00+00:00"),
        (2, "r", "silly", "1.1.1", 10, "{", "yesterday"),
        (3, "r", "Medium", None, 10, '["a", 1]', "2024-01-01T00:00:00.25Z"),
        (4, "r", "high", "", 10, '"a"', ""),
    ], "id bigint, rule string, severity string, target_ip string, window_secs bigint, indicators string, triggered_at string")
    now = F.timestamp_millis(F.lit(5))
    found = A.normalize_alert_rows(rows, now).orderBy("id").select(
        "severity", "target_ip", "indicators", F.unix_millis("triggered_at").alias("ms")).collect()
    assert [tuple(r) for r in found][:2] == [("Low", 16843009, ["a"], T0), ("High", None, [], 5)]
    assert tuple(found[2]) == ("Medium", None, [], T0 + 250)
    assert tuple(found[3]) == ("High", None, [], 5)


@pytest.mark.parametrize("text, want", [
    ("[]", []), (' [ "a" , "b" ]\n', ["a", "b"]), ('["\\u00e9 \\"x\\" \\\\"]', ['é "x" \\']), ("[1,2]", []), ("[true]", []),
    ('[{"a":1}]', []), ('["a"] x', []), ('["a", 1]', []), ('["a", null]', []), ('["a",]', []), ('["a" "b"]', []), ('["a', []),
    ("", []), (None, []), ("null", []), ('[["a"]]', []), ('["\\q"]', [])])
def test_indicator_lists(spark, text, want):
    rows = spark.createDataFrame([(1, "r", "Low", None, 10, text, "")],
        "id bigint, rule string, severity string, target_ip string, window_secs bigint, indicators string, triggered_at string")
    assert A.normalize_alert_rows(rows, F.timestamp_millis(F.lit(5))).first().indicators == want
