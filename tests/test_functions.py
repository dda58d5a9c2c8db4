from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from weirgauge.functions import clock, net, numbers


def test_addresses(spark):
    texts = ["10.0.0.1", "255.255.255.255", "0.0.0.0", "256.1.1.1", "1.2.3", "01.2.3.4", "", None, "1.2.3.4 ", "1.2.3.4\n", "\n1.2.3.4"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        net.ip_number(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [167772161, 4294967295, 0, *[None] * 8]
    back = spark.createDataFrame([(167772161,), (4294967295,), (None,)], "n bigint").select(
        net.ip_text(F.col("n")).alias("t")).collect()
    assert [r.t for r in back] == ["10.0.0.1", "255.255.255.255", None]


def test_ip_literal():
    assert net.ip_literal("1.1.1.1") == 16843009
    with pytest.raises(ValueError):
        net.ip_literal("1.1.1")


def test_big_endian(spark):
    row = spark.createDataFrame([(bytearray(b"\x00\xee\x6b\x28\x00\x01\x02"),)], "b binary").select(
        net.uint_be(F.col("b"), 1, 4).alias("u32"), net.uint_be(F.col("b"), 5, 2).alias("u16"),
        net.hex_uint(F.hex("b"), 1, 4).alias("h32")).first()
    assert (row.u32, row.u16, row.h32) == (4_000_000_000, 258, 4_000_000_000)


def test_rounding_is_by_exact_value(spark):
    values = [0.0, 0.05, 0.15, 0.25, 0.35, 0.45, 0.5, 0.75, 1.25, 1.5, 2.5, 2.45, 99.95, 1234.05, 7.0, 0.04999]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", numbers.text_0(F.col("v")).alias("t0"), numbers.text_1(F.col("v")).alias("t1")).collect()
    for r in rows:
        assert r.t0 == str(Decimal(r.v).quantize(Decimal(1), ROUND_HALF_EVEN)), r.v
        assert r.t1 == str(Decimal(r.v).quantize(Decimal("0.1"), ROUND_HALF_EVEN)), r.v


def test_guarded_arithmetic(spark):
    row = spark.range(1).select(
        numbers.ratio(F.lit(1), F.lit(0)).alias("none"), numbers.ratio(F.lit(1), F.lit(4)).alias("quarter"),
        numbers.whole_quotient(F.lit(7), F.lit(2)).alias("three"),
        numbers.whole_quotient(F.lit(7), F.lit(0)).alias("zero"),
        numbers.saturating_minus(F.lit(3), F.lit(5)).alias("floor")).first()
    assert tuple(row) == (None, 0.25, 3, 0, 0)


def test_time_text(spark):
    row = spark.range(1).select(
        clock.whole_second_text(F.lit(1_709_210_096_999)).alias("a"),
        clock.rfc3339_text(F.lit(1_709_210_096_000_000)).alias("b"),
        clock.rfc3339_text(F.lit(1_709_210_096_120_000), "Z").alias("c"),
        clock.rfc3339_text(F.lit(1_709_210_096_000_007)).alias("d")).first()
    assert tuple(row) == ("2024-02-29T12:34:56Z", "2024-02-29T12:34:56+00:00", "2024-02-29T12:34:56.120Z",
                          "2024-02-29T12:34:56.000007+00:00")


def test_parse_rfc3339(spark):
    texts = ["2024-01-01T00:00:00Z", "2024-01-01T02:00:00+02:00", "2024-01-01 00:00:00.5Z", "2024-01-01T00:00:00",
             "2024-02-31T00:00:00Z", "soon", None, "2024-01-01t00:00:05z", "2024-01-01T00:00:60Z", "2024-12-31T23:59:60.5+00:00",
             "2024-01-01T00:00:61Z", "2024-01-01T00:00:00Z\n", " 2024-01-01T00:00:00Z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        F.unix_millis(clock.parse_rfc3339(F.col("t"))).alias("ms")).collect()
    base = 1_704_067_200_000
    want = [base, base, base + 500, None, None, None, None, base + 5000, base + 60_000, 1_735_689_600_500, None, None, None]
    assert [r.ms for r in rows] == want
    assert [clock.rfc3339_argument_ms(t) for t in texts] == want
