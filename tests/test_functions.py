import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickloom.functions.clock import parse_iso
from tickloom.functions.fixed_point import descale, mid_price, scale_text
from tickloom.functions.ids import name_uuid

SCALED = [
    ("0.123456789", 8, 12345678), ("-0.5239", 2, -52), ("1e-3", 8, 100000), ("1E2", 2, 10000), ("+7.", 2, 700),
    (".5", 2, 50), ("92233720368.54775807", 8, 2**63 - 1), ("92233720368.54775808", 8, None), ("1e30", 8, None),
    ("", 8, None), ("null", 8, None), (" 1.5", 8, None), ("1.5 ", 8, None), ("1,5", 2, None), ("0x1", 2, None),
    ("0.12345678901234567890e10", 8, 123456789012345678), ("0.000000000000000001234567891e18", 8, 123456789),
    ("1234567890123456789012345678901234567890e-30", 8, 123456789012345678), ("-" + "9" * 40 + "E-38", 2, -9999),
    ("1e99999999999", 8, None), ("0e5", 8, 0), ("1e-2147483647", 8, 0), ("-92233720368547758.08e0", 2, -(2**63)),
    ("0.0099999999999999999999999", 2, 0), ("1.23456789999999999", 8, 123456789), (".", 2, None), ("NaN", 2, None),
]


@pytest.mark.parametrize("text,places,want", SCALED)
def test_scale_text(spark, text, places, want):
    row = spark.createDataFrame([(text,)], "t string").select(scale_text(F.col("t"), places).alias("v")).first()
    assert row.v == want


def test_descale_and_mid_round_half_up(spark):
    rows = spark.createDataFrame(
        [(4200012345678, 4200012345679, 8), (105, 106, 2), (-5, -6, 8), (1, 2, 10), (2**63 - 1, 2**63 - 1, 0), (7, 8, 3)],
        "b bigint, a bigint, s int",
    ).select(descale(F.col("b"), F.col("s")).alias("d"), mid_price(F.col("b"), F.col("a"), F.col("s")).alias("m")).collect()
    assert [r.m for r in rows] == [
        Decimal("42000.12345679"), Decimal("1.05500000"), Decimal("-0.00000006"), Decimal("0E-8"),
        Decimal(2**63 - 1), Decimal("0.00750000"),
    ]
    assert rows[0].d == Decimal("42000.12345678") and rows[3].d == Decimal("0E-8") and rows[5].d == Decimal("0.007")


def test_negative_scale_gives_null_and_large_ones_round(spark):
    rows = spark.createDataFrame(
        [(1, -1), (1, 19), (5 * 10**18, 27), (-5 * 10**18, 27), (5 * 10**18 - 1, 27), (2**63 - 1, 19), (2**63 - 1, 400)], "v bigint, s int",
    ).select(descale(F.col("v"), F.col("s")).alias("d"))
    unit = Decimal("0.00000001")
    assert [r.d for r in rows.collect()] == [None, 0, unit, -unit, 0, Decimal("0.92233720"), 0]


def test_name_uuid_is_version_three(spark):
    import hashlib

    texts = [f"{i}|BTCUSDT|{i * 7}" for i in range(500)] + ["", "é|ü"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", name_uuid(F.col("t")).alias("u")).collect()
    for r in rows:
        assert r.u == str(uuid.UUID(bytes=hashlib.md5(r.t.encode()).digest(), version=3))


@pytest.mark.parametrize("text,ok", [
    ("2024-01-02T03:04:05.123456Z", True), ("2024-01-02T03:04Z", True), ("2024-01-02T03:04:05+02:00", True),
    ("2024-01-02T03:04:05", False), ("2024-01-02", False), ("yesterday", False), ("2024-13-02T03:04:05Z", False),
])
def test_iso_needs_an_offset(spark, text, ok):
    row = spark.createDataFrame([(text,)], "t string").select(parse_iso(F.col("t")).alias("v")).first()
    assert (row.v is not None) == ok
