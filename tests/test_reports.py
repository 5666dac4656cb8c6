"""Quality and revenue reports on golden and edge values."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shirabe.plans import marketing, quality

SALES = [
    (1, 1, "2024-01-15", 150.50), (2, 2, "2024-01-16", 275.25), (3, 1, "2024-01-17", 89.99),
    (4, 3, "2024-02-01", 450.00), (5, 2, "2024-02-02", 125.75),
]


def test_january_revenue(spark):
    sales = spark.createDataFrame([(*s, "completed") for s in SALES], "id int, client int, d string, amount double, state string")
    out = marketing.monthly_revenue(sales.withColumn("d", F.to_date("d")), "d", "amount", "state")
    january = out.filter("month = 1").first()
    assert (january.transaction_count, january.total_revenue) == (3, 515.74)


def test_rules_on_empty_and_null(spark):
    rules = [quality.Rule("filled", "c IS NOT NULL", 60.0, "High"), quality.Rule("short", "length(c) < 3", 10.0, "Low")]
    out = {r.rule_name: r for r in quality.run_rules(spark.createDataFrame([("a",), (None,), ("long",)], "c string"), rules).collect()}
    assert (out["filled"].valid_records, out["filled"].threshold_met) == (2, True)
    assert (out["short"].valid_records, out["short"].invalid_records) == (1, 2)
    empty = quality.run_rules(spark.createDataFrame([], "c string"), rules).first()
    assert (empty.total_records, empty.quality_score, empty.threshold_met) == (0, 0.0, False)


def test_rules_take_one_pass(spark, plan, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    rules = [quality.Rule(str(i), f"id > {i}", 1.0, "Low") for i in range(5)]
    assert plan(quality.rule_counts(spark.read.parquet(str(tmp_path / "t")), rules)).count("FileScan") == 1


def test_a_broken_rule_does_not_stop_the_others(spark):
    df = spark.createDataFrame([("1",), ("x",)], "c string")
    rules = [
        quality.Rule("filled", "c IS NOT NULL", 60.0, "High"), quality.Rule("no column", "d > 1", 1.0, "Low"),
        quality.Rule("no syntax", "c >", 1.0, "Low"), quality.Rule("fails on a row", "CAST(c AS INT) > 0", 1.0, "Low"),
    ]
    out = {r.rule_name: r for r in quality.run_rules(df, rules).collect()}
    assert out["filled"].quality_score == 100.0 and out["filled"].error_message is None
    for name in ("no column", "no syntax", "fails on a row"):
        assert out[name].quality_score == 0.0 and out[name].error_message and not out[name].threshold_met


def test_broken_rules_are_found_by_halving(spark, monkeypatch):
    df = spark.createDataFrame([("1",), ("x",)], "c string")
    rules = [quality.Rule(f"r{i}", "CAST(c AS INT) > 0" if i == 11 else "c IS NOT NULL", 50.0, "Low") for i in range(32)]
    passes, real = [], quality._valid_rows
    monkeypatch.setattr(quality, "_valid_rows", lambda df, some: (passes.append(len(some)), real(df, some))[1])
    out = {r.rule_name: r for r in quality.run_rules(df, rules).collect()}
    assert len(passes) == 11 and [n for n, r in out.items() if r.error_message] == ["r11"]
    assert all(r.total_records == 2 and r.valid_records == 2 * (n != "r11") for n, r in out.items())
    (alone,) = quality.run_rules(df, [rules[11]]).collect()
    assert (alone.total_records, alone.quality_score) == (2, 0.0) and alone.error_message


def test_custom_pattern_under_a_default_name(spark):
    df = spark.createDataFrame([("tel 0312345678",)], "t string")
    assert quality.scan_pii(df, ["t"], {"phone": "[0-9]{10}"}).first().hits == 1


def test_profile_counts_dominant_values(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "c string, n int")
    out = {r.column_name: r.anomaly_count for r in quality.profile(df, datetime(2024, 1, 1)).collect()}
    assert out == {"c": 1, "n": 0}


def test_profile_in_one_scan(spark, plan, tmp_path):
    layout = "c string, n double, at timestamp, day date, b binary, l array<int>, e string"
    data = [("a", 0.0, datetime(2023, 1, 1), None, b"x", [1], None), ("a", -0.0, datetime(2030, 1, 1), None, b"x", [1], None), (None, None, None, None, None, None, None), ("bcd", 1.5, datetime(2001, 1, 1), None, b"", [], None)]
    spark.createDataFrame(data, layout).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    found = quality.profile(df, datetime(2024, 1, 1), {"c": "^a"})
    text = plan(found)
    assert "Expand" not in text and text.count("FileScan") <= 2 * text.count("Initial Plan") + 1
    out = {r.column_name: r for r in found.collect()}
    got = {c: (r.total_records, r.null_count, r.distinct_count, r.anomaly_count) for c, r in out.items()}
    assert got == {"c": (4, 1, 2, 0), "n": (4, 1, 2, 0), "at": (4, 1, 3, 2), "day": (4, 4, 0, 0), "b": (4, 1, 2, 0), "l": (4, 1, 2, 0), "e": (4, 4, 0, 0)}
    assert (out["c"].min_value, out["c"].max_value, out["c"].avg_length) == ("a", "bcd", pytest.approx(5 / 3))
    assert out["c"].pattern_compliance == pytest.approx(200 / 3) and out["at"].pattern_compliance == pytest.approx(100 / 3)
    empty = quality.profile(df.limit(0), datetime(2024, 1, 1)).collect()
    assert sorted(r.column_name for r in empty) == sorted(df.columns) and all(r.total_records == 0 for r in empty)


def test_dominant_value(spark, rows):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), (None,)], "c string")
    assert rows(quality.dominant_values(df, ["c"])) == [("c", 1)]


@pytest.mark.parametrize("wanted, result", [((5, 4), "PASS"), ((5, 5), "FAIL")])
def test_assert_run(spark, wanted, result):
    at = datetime(2024, 1, 1, 12)
    log = spark.createDataFrame(
        [("n", datetime(2024, 1, 1, 11, 30), 5, 4), ("n", datetime(2024, 1, 1, 9), 9, 9)],
        "name string, at timestamp_ntz, input_rows bigint, output_rows bigint",
    )
    assert quality.assert_run(log, "n", *wanted, at).first().validation_result == result


def test_pii_counts_every_hit_in_long_text(spark):
    tail = "x " * 50_000
    text = f"{tail} a@b.co 123-45-6789 4111 1111 1111 1111 {tail} c@d.org 090-1234-5678"
    out = {r.scan: r.hits for r in quality.scan_pii(spark.createDataFrame([(text,), (None,)], "t string"), ["t"]).collect()}
    assert out == {"t:card": 1, "t:ssn": 1, "t:phone": 1, "t:email": 2}


def test_visibility(spark, rows):
    docs = spark.createDataFrame([(1, "a", 2), (2, "b", 0), (3, "c", 4)], "id int, owner string, rank int")
    users = spark.createDataFrame([("a", 2), ("b", 1), ("c", 3)], "user_id string, clearance int")
    grants = spark.createDataFrame([("a", 2), ("b", 1), ("a", 2)], "user_id string, id int")
    out = quality.visible_to(docs, users, grants, "id", "owner", "rank")
    assert rows(out, "user_id", "id") == [("a", 1), ("a", 2), ("b", 2)]
