"""Scalar functions on golden values."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shirabe.functions import dates, jsonx, text


@pytest.fixture
def value(spark):
    """Value of an expression over one text, typed as given."""

    def run(expr, raw, dtype="string"):
        df = spark.createDataFrame([(raw,)], f"c {dtype}")
        return df.select(expr(F.col("c"))).first()[0]

    return run


@pytest.mark.parametrize(
    "raw, want",
    [
        ("valid@example.com", True), ("invalid.email", False), ("test@domain.co.jp", True),
        ("@invalid.com", False), ("test@", False), (None, False),
    ],
)
def test_is_email(value, raw, want):
    assert value(text.is_email, raw) is want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("090-1234-5678", True), ("03-1234-5678", True), ("+81-90-1234-5678", True),
        ("090-123-456", False), ("abc-defg-hijk", False),
    ],
)
def test_is_phone(value, raw, want):
    assert value(text.is_phone, raw) is want


@pytest.mark.parametrize(
    "raw, want",
    [("2023-12-31", True), ("2023-02-29", False), ("2024-02-29", True), ("2023-13-01", False), ("1990-01-01", True)],
)
def test_is_date(value, raw, want):
    assert value(dates.is_date, raw) is want


@pytest.mark.parametrize("raw, want", [(25, True), (-5, False), (150, False), (0, True), (100, True)])
def test_in_range(value, raw, want):
    assert value(lambda c: text.in_range(c, 0, 100), raw, "int") is want


@pytest.mark.parametrize(
    "raw, want", [("　全角スペース　", "全角スペース"), ("UPPERCASE", "uppercase"), ("  trim spaces  ", "trim spaces")]
)
def test_normalise_key(value, raw, want):
    assert value(text.normalise_key, raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("  これは　テスト　データです。  ", "これは テスト データです。"),
        ("Phone: ０９０－１２３４－５６７８", "Phone: 090-1234-5678"),
        ("Name: 田中　太郎　　", "Name: 田中 太郎"),
    ],
)
def test_cleanse(value, raw, want):
    assert value(text.cleanse, raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("090-1234-5678", "090-1234-5678"), ("09012345678", "090-1234-5678"), ("090 1234 5678", "090-1234-5678"),
        ("+81-090-1234-5678", "090-1234-5678"), ("+81-90-1234-5678", None), ("03-1234-5678", None),
    ],
)
def test_phone_jp(value, raw, want):
    assert value(text.phone_jp, raw) == want


@pytest.mark.parametrize(
    "raw", ["2023/12/31", "2023-12-31", "31-Dec-2023", "2023年12月31日", "12/31/2023"]
)
def test_parse_date_any(value, raw):
    assert value(dates.parse_date_any, raw) == "2023-12-31"


def test_parse_date_any_rejects(value):
    assert value(dates.parse_date_any, "2023-02-29") is None
    assert value(dates.parse_date_any, "soon") is None


@pytest.mark.parametrize(
    "amount, src, dst, want", [(1000.0, "g", "kg", 1.0), (5000.0, "m", "km", 5.0), (100.0, "cm", "m", 1.0), (7.0, "x", "y", 7.0)]
)
def test_convert_unit(value, amount, src, dst, want):
    assert value(lambda c: text.convert_unit(c, F.lit(src), F.lit(dst)), amount, "double") == pytest.approx(want)


def test_encode(value):
    assert value(lambda c: text.encode(c, {"A": 3, "B": 2}), "A") == 3
    assert value(lambda c: text.encode(c, {"A": 3, "B": 2}), "Z") == 0
    assert value(lambda c: text.encode(c, {"A": 3, "B": 2}), None) == 0


@pytest.mark.parametrize("raw, want", [(None, "d"), ("", "d"), ("N/A", "d"), ("x", "x")])
def test_fill_blank(value, raw, want):
    assert value(lambda c: text.fill_blank(c, "d"), raw) == want


@pytest.mark.parametrize("raw, want", [(999, 120), (-5, 0), (45, 45), (None, None)])
def test_clamp(value, raw, want):
    assert value(lambda c: text.clamp(c, 0, 120), raw, "int") == want


def test_masks(value):
    assert value(text.mask_name, "田中太郎") == "田***"
    assert value(text.mask_email, "tanaka.taro@example.com") == "t**********@example.com"
    assert value(text.mask_email, "t@example.com") == "t@example.com"
    assert value(text.mask_phone, "090-1234-5678") == "090-****-5678"
    assert value(text.mask_card, "1234567890123456") == "************3456"


def test_padding_of_long_numbers(value):
    assert value(lambda c: text.zero_pad(c, 6), "1234567") == "234567"
    assert value(lambda c: text.zero_pad(c, 6), "45") == "000045"
    assert value(lambda c: text.numbered(c, 10), "12345678901") == "12345678901"
    assert value(lambda c: text.numbered(c, 10), "7") == "0000000007"


@pytest.mark.parametrize(
    "unit, a, b, want",
    [
        ("minute", "2024-01-01 00:00:59", "2024-01-01 00:01:01", 1),
        ("month", "2024-01-31 00:00:00", "2024-02-01 00:00:00", 1),
        ("day", "2024-01-01 23:59:59", "2024-01-02 00:00:00", 1),
        ("year", "2023-12-31 23:59:59", "2024-01-01 00:00:00", 1),
        ("second", "2024-01-01 00:00:00.9", "2024-01-01 00:00:01.1", 1),
        ("hour", "2024-01-01 01:59:59", "2024-01-01 00:00:00", -1),
    ],
)
def test_boundary_diff(spark, unit, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    got = df.select(dates.boundary_diff(unit, F.col("a").cast("timestamp_ntz"), F.col("b").cast("timestamp_ntz"))).first()[0]
    assert got == want


def test_jst_day_edge():
    assert dates.jst(datetime(2001, 6, 30, 15, 0)).strftime("%Y%m%d") == "20010701"
    assert dates.jst(datetime(2001, 6, 30, 14, 59)).strftime("%Y%m%d") == "20010630"
    assert dates.add_months(datetime(2001, 1, 1), -2) == datetime(2000, 11, 1)


@pytest.mark.parametrize("raw, want", [('{"a": 1}', True), ("[1]", True), ("12", False), ('{"a": ', False), ("", False), (None, False)])
def test_is_json(value, raw, want):
    assert value(jsonx.is_json, raw) is want


def test_flatten_json(spark, rows):
    doc = (
        '{"customer": {"id": 12345, "personal_info": {"name": "田中太郎", "address": {"prefecture": "東京都"}},'
        ' "orders": [{"order_id": "ORD001", "amount": 1500}, {"order_id": "ORD002"}], "tags": ["x", [1, 2]], "none": null}}'
    )
    df = spark.createDataFrame([(1, doc), (2, "{broken"), (3, None)], "id int, doc string")
    assert rows(jsonx.flatten_json(df, "id", "doc"), "path", "value") == sorted(
        [
            ("customer.id", "12345"),
            ("customer.personal_info.name", "田中太郎"),
            ("customer.personal_info.address.prefecture", "東京都"),
            ("customer.orders[0].order_id", "ORD001"),
            ("customer.orders[0].amount", "1500"),
            ("customer.orders[1].order_id", "ORD002"),
            ("customer.tags[0]", "x"),
            ("customer.tags[1]", "[1,2]"),
            ("customer.none", None),
        ]
    )


def test_flatten_json_keys_like_positions(spark, rows, plan):
    df = spark.createDataFrame([(1, '{"a]": [1, 2], "e": [], "o": {}, "l": [{"z": [7]}]}')], "id int, doc string")
    flat = jsonx.flatten_json(df, "id", "doc")
    assert rows(flat, "path", "value") == [("a][0]", "1"), ("a][1]", "2"), ("l[0].z[0]", "7")]
    assert "Python" not in plan(flat) and "Arrow" not in plan(flat)


def test_flatten_json_below_several_levels(spark, rows):
    deep = '{"a": ' * 11 + '[{"z": 1}, [2], {}]' + "}" * 11
    flat = jsonx.flatten_json(spark.createDataFrame([(1, deep), (2, "5"), (3, "[1, null]")], "id int, doc string"), "id", "doc")
    at = ".".join("a" * 11)
    assert rows(flat) == [(1, f"{at}[0].z", "1"), (1, f"{at}[1]", "[2]"), (2, "", "5"), (3, "[0]", "1"), (3, "[1]", None)]


def test_has_required(spark):
    df = spark.createDataFrame([("Test User", "m@x.jp"), ("", "m@x.jp"), (None, "m@x.jp"), ("　", "m@x.jp")], "name string, email string")
    assert [r[0] for r in df.select(text.has_required(df, ["name", "email"])).collect()] == [True, False, False, False]
    assert df.select(text.has_required(df, ["name", "phone"])).first()[0] is False
