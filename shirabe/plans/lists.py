"""Daily and weekly list extracts.

Each function takes the tables it needs by role and the run time, and returns the
list as one DataFrame plan. Where the list keeps one row per key after a join,
the joined sides are first reduced to their best row per join key: the sort order
ranks one side before the other, so the result is the same and a popular key
does not multiply.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shirabe.functions.dates import jst
from shirabe.operators.aggregate import flag_pivot
from shirabe.operators.change import append_new, flag_exists, lookback, new_rows, track_history, unless_processed
from shirabe.operators.join import exclude_multi, only_one_in_group, snapshot_changes
from shirabe.operators.project import before_month, current_month, date_window, stamp
from shirabe.operators.window import latest_per_key
from shirabe.session import stable

STAMP = "%Y/%m/%d %H:%M:%S"
Tables = dict[str, DataFrame]

# Bulk, instalment and mailed billing services are never chased.
BULK_SERVICES = ["11", "14", "15", "21", "13"]
UNCHANGED_SERVICES = ["11", "12", "13", "21"]

ACTIVE_GAS = "service_type = '001' AND transfer_type = '02' AND user_key_type = '003'"


def _ymd(as_of: datetime, days_back: int = 0) -> str:
    return (jst(as_of) - timedelta(days=days_back)).strftime("%Y%m%d")


def payment_alerts(tables: Tables, as_of: datetime) -> DataFrame:
    """Overdue unpaid transfers of current members, one row per member, contract, month and invoice.

    ``existing_flag`` tells whether the invoice is already in the alert history.
    """
    overdue = (
        tables["uncollected"]
        .filter("paid_flag = '0' AND refund_flag = '0' AND bill_state = '3' AND amount > 0 AND pay_method = '2'")
        .filter((F.col("due_ymd") < _ymd(as_of)) & ~F.col("service_class").isin(BULK_SERVICES))
        .select("pay_contract", "invoice_no", "mgmt_no", "fee_month", "due_ymd")
    )
    target = latest_per_key(overdue, ["pay_contract", "fee_month", "invoice_no"], ["due_ymd"], ["mgmt_no"])
    gas = tables["gas"].filter((F.col("contract_state") != "00") & ~F.col("service_class").isin(BULK_SERVICES))
    per_contract = latest_per_key(
        gas.select(
            F.col("pay_contract_no").cast("string").alias("pay_contract"),
            F.col("user_reg_no").cast("string").alias("user_reg"),
            F.col("pay_method").alias("gas_method"),
        ),
        ["pay_contract"],
        [F.col("user_reg").asc()],
    )
    owners = latest_per_key(
        tables["contracts"].filter("left_flag = 0").select("member_id", "pay_contract", "csv_ymd"),
        ["member_id", "pay_contract"],
        ["csv_ymd"],
    ).drop("csv_ymd")
    alerts = target.join(per_contract, "pay_contract").join(owners, "pay_contract")
    alerts = stamp(alerts, as_of, output_datetime=STAMP)
    return flag_exists(alerts, tables["history"], ["invoice_no", "mgmt_no"], "existing_flag")


def payment_alert_list(tables: Tables, as_of: datetime) -> DataFrame:
    """Alerts reduced to one row per invoice, the latest due date first."""
    alerts = payment_alerts(tables, as_of).drop("mgmt_no", "existing_flag")
    return latest_per_key(alerts, ["invoice_no"], ["due_ymd"], ["member_id"])


def payment_alert_history(tables: Tables, as_of: datetime) -> DataFrame:
    """Alert history after the run: new invoices start today, known ones move their last day."""
    current = payment_alerts(tables, as_of).select("invoice_no", "mgmt_no", "pay_contract", "member_id")
    return track_history(current, tables["history"], ["invoice_no", "mgmt_no"], jst(as_of).strftime("%Y/%m/%d"))


def payment_method_master(tables: Tables, as_of: datetime) -> DataFrame:
    """Payment method per unified customer and payment contract, newest usage record first."""
    usage = latest_per_key(
        tables["usage"].filter(ACTIVE_GAS).select("bx", "index_id", "user_key", "output_date"),
        ["bx", "user_key"],
        ["output_date"],
        ["index_id"],
    )
    gas = tables["gas"].select(
        F.col("user_reg_no").cast("string").alias("user_key"),
        "pay_contract_no",
        "contract_state",
        "pay_method",
        "service_class",
    )
    joined = usage.join(gas, "user_key")
    best = latest_per_key(
        joined,
        ["bx", "pay_contract_no"],
        ["output_date"],
        ["index_id", "user_key", "contract_state", "pay_method", "service_class"],
    )
    return stamp(best.drop("output_date", "user_key"), as_of, output_datetime=STAMP)


def payment_method_changed(tables: Tables, as_of: datetime, pair: dict[str, str]) -> DataFrame:
    """Customers who moved away from transfer payment since yesterday; empty if the pair was processed."""
    keys = ["contract_no", "pay_contract_no"]
    current = tables["gas"].filter(~F.col("service_class").isin(UNCHANGED_SERVICES))
    changed = snapshot_changes(tables["gas_previous"], current, keys, "pay_method", "2")
    changed = changed.select(F.col("user_reg_no").cast("string").alias("user_key")).distinct()
    usage = tables["usage"].filter(ACTIVE_GAS).select("bx", "index_id", "user_key", "output_date")
    best = latest_per_key(usage.join(changed, "user_key"), ["bx"], ["output_date"], ["index_id", "user_key"])
    out = stamp(best.drop("output_date"), as_of, output_datetime=STAMP)
    return unless_processed(tables["processed"], pair, out)


def opening_payment_guide(tables: Tables, as_of: datetime) -> DataFrame:
    """Openings of D-20 up to D-5 with their gas contract and unified customer."""
    opened = date_window(
        tables["openings"].filter("retail_kind = '1' AND error_state IN ('0', '2')").filter(
            F.col("reason_code").isin("11", "12")
        ),
        "work_ymd",
        as_of,
        20,
        5,
    ).select("case_no", "meter_no", "work_ymd")
    gas = tables["gas"].select(F.col("meter_no").cast("string"), F.col("user_reg_no").cast("string").alias("user_key"))
    gas = gas.join(opened, "meter_no", "left_semi").distinct()
    usage = tables["usage"].filter(ACTIVE_GAS).select("bx", "index_id", "user_key", "output_date")
    owners = latest_per_key(gas.join(usage, "user_key"), ["bx", "meter_no"], ["output_date"], ["index_id", "user_key"])
    return stamp(opened.distinct().join(owners, "meter_no").drop("output_date"), as_of, output_datetime=STAMP)


def thanks_history(tables: Tables, as_of: datetime) -> DataFrame:
    """Thanks history after the run: yesterday's first contracts of a person at a supply point."""
    contracts = tables["contracts"]
    started = tables["operations"].filter("status = '800' AND kind = 'ESST'").select("sa_id", "applied")
    target = contracts.filter((F.col("update_kind") == "A") & (F.col("registered_ymd") == _ymd(as_of, 1)))
    # Only the supply points of the day can matter.
    nearby = contracts.join(target.select("supply_point"), "supply_point", "left_semi")
    first = only_one_in_group(target, nearby, "supply_point", ["reg_no", "person", "kana", "phone"], "sa_id")
    columns = ["supply_point", "reg_no", "sa_id", "start_ymd", "applied", "contract_type"]
    batch = first.join(started, "sa_id").select(*columns).distinct()
    batch = batch.withColumn("run_ymd", F.lit(_ymd(as_of)))
    fresh = new_rows(batch, tables["history"], ["supply_point", "reg_no"])
    return tables["history"].unionByName(fresh)


def thanks_list(tables: Tables, as_of: datetime) -> DataFrame:
    """Thanks messages: history rows that started D-30 to D-25, with their current members."""
    due = date_window(thanks_history(tables, as_of), "start_ymd", as_of, 30, 25, closed="both")
    members = tables["members"].filter("left_flag = 0").select("member_id", "reg_no", "kind_code")
    return stamp(due.join(members, "reg_no").drop("run_ymd"), as_of, output_datetime=STAMP)


def repair_follow_up(tables: Tables, as_of: datetime) -> DataFrame:
    """Repairs of the last 21 days per meter and day with appliance flags, for unambiguous customers."""
    repairs = date_window(tables["repairs"], "completed_ymd", as_of, 21).filter(
        "meter_no <> '00000000000' AND inspected_ymd <> '00000000' AND field_code = '0301'"
    )
    kinds = {"11": "gas_appliance_flag", "1A": "wet_area_flag"}
    per_day = flag_pivot(
        repairs.filter(F.col("subject_code").isin(*kinds)), ["meter_no", "completed_ymd"], "subject_code", kinds
    )

    active = tables["usage"].filter("transfer_type = '02'")
    slots = F.array(*[F.struct(F.col(f"key_type{i}").alias("t"), F.col(f"service_key{i}").alias("k")) for i in (1, 2, 3)])
    owners = active.select("bx", F.explode(slots).alias("_s")).filter("_s.t = '001'")
    owners = owners.select("bx", F.col("_s.k").alias("meter_no"))
    # Read twice below: to thin out the usage records and for the list itself.
    clear = stable(exclude_multi(per_day, owners, "meter_no", "bx"))

    keys = F.array_distinct(F.array("service_key1", "service_key2", "service_key3"))
    unfolded = active.select("bx", "index_id", "output_date", F.explode(keys).alias("meter_no"))
    held = unfolded.join(clear, "meter_no", "left_semi")
    best = latest_per_key(held, ["bx", "meter_no"], ["output_date"], ["index_id"])
    return stamp(clear.join(best.drop("output_date"), "meter_no"), as_of, output_datetime=STAMP)


def moving_promotion(tables: Tables, as_of: datetime) -> DataFrame:
    """Moving forecasts of households under contract since before the month two months ago."""
    held = before_month(tables["gas"].filter("closed_ymd = '0'"), "opened", as_of, 2)
    held = held.select(F.col("meter_no").cast("string"), F.col("contract_no").cast("string"))
    dna = tables["client_dna"].dropna(subset=["meter_no", "contract_no", "forecast"])
    rows = dna.join(held, ["meter_no", "contract_no"], "left_semi").select("meter_no", "contract_no", "forecast").distinct()
    return stamp(rows, as_of, output_datetime=STAMP)


# Action point events and the remarks of their transactions.
ENTRY_KINDS = {"ap_gas": 1, "ap_power": 2, "ap_quiz": 3}
REMARK_KINDS = {"ガス使用量": 1, "電気使用量": 2, "クイズ回答": 3}


def action_point_entries(tables: Tables, as_of: datetime, first_run: datetime) -> DataFrame:
    """Entry table after the run: new (member, kind, day) entries of the last 30 days."""
    start = lookback(tables["entries"], as_of, 30, first_run)
    kind = F.coalesce(*[F.when(F.col("event_name") == n, F.lit(k)) for n, k in ENTRY_KINDS.items()], F.lit(99))
    batch = (
        tables["events"]
        .filter(F.col("event_name").isin(*ENTRY_KINDS) & F.col("member_id").isNotNull())
        .filter(F.col("event_time") >= F.lit(start.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz"))
        .select("member_id", kind.alias("point_kind"), F.to_date("event_time").alias("entry_date"))
        .distinct()
    )
    batch = batch.withColumn("registered_ymd", F.lit(_ymd(as_of)))
    return append_new(batch, tables["entries"], ["member_id", "point_kind", "entry_date"])


def action_point_current_month(tables: Tables, as_of: datetime, first_run: datetime) -> DataFrame:
    """Entries of the current calendar month."""
    month = current_month(action_point_entries(tables, as_of, first_run), "entry_date", as_of)
    rows = month.select("member_id", "point_kind", F.date_format("entry_date", "yyyy/MM/dd").alias("entry_date"))
    return stamp(rows, as_of, output_datetime=STAMP)


def action_point_transactions(tables: Tables, as_of: datetime, first_run: datetime) -> DataFrame:
    """Transaction history after the run: new (member, kind, day) of the last 14 days."""
    start = lookback(tables["history"], as_of, 14, first_run)
    kind = F.coalesce(*[F.when(F.col("remarks").startswith(p), F.lit(k)) for p, k in REMARK_KINDS.items()])
    batch = (
        tables["transactions"]
        .filter(F.col("point_code").isin("9002", "9009") & (F.col("processed_ymd") >= start.strftime("%Y%m%d")))
        .select("member_id", kind.alias("point_kind"), F.to_date("processed_ymd", "yyyyMMdd").alias("processed_date"))
        .filter("point_kind IS NOT NULL")
        .distinct()
        .withColumn("registered_ymd", F.lit(_ymd(as_of)))
    )
    return append_new(batch, tables["history"], ["member_id", "point_kind", "processed_date"])


def action_point_recent(tables: Tables, as_of: datetime, first_run: datetime) -> DataFrame:
    """Latest transaction per member and kind, for registered members under contract."""
    history = action_point_transactions(tables, as_of, first_run)
    latest = history.groupBy("member_id", "point_kind").agg(F.max("processed_date").alias("recent"))
    current = tables["members"].filter("left_flag = 0 AND reg_complete = 1").select("member_id")
    rows = latest.join(current, "member_id", "left_semi").join(tables["under_contract"], "member_id", "left_semi")
    rows = rows.select("member_id", "point_kind", F.date_format("recent", "yyyy/MM/dd").alias("recent_transaction_date"))
    return stamp(rows, as_of, output_datetime=STAMP)


def mail_list(rows: DataFrame, as_of: datetime, keys: list[str], mail: str = "mail") -> DataFrame:
    """Rows of a daily file, one per key with the greatest mail address."""
    best = latest_per_key(rows, keys, [F.col(mail).desc_nulls_last()])
    return stamp(best, as_of, csv_ymd="%Y%m%d", output_datetime=STAMP)


def mail_permission(tables: Tables, as_of: datetime) -> DataFrame:
    """Members with their mail services; open-ended dates get the last day of 9999."""
    services = tables["services"].withColumn("end_ymd", F.replace("end_ymd", F.lit("99999999"), F.lit("99991231")))
    return stamp(tables["members"].join(services, "member_id", "left"), as_of, output_datetime=STAMP)


def full_extract(df: DataFrame, as_of: datetime, columns: list[str] | None = None) -> DataFrame:
    """All rows (and columns, or the named ones) with the run stamp."""
    return stamp(df.select(*columns) if columns else df, as_of, output_datetime=STAMP)


def completed_contracts(tables: Tables, as_of: datetime) -> DataFrame:
    """New or switched contracts completed on the target day (D-1), with their active member."""
    target = tables["contracts"].filter(
        (F.col("registered_ymd") == _ymd(as_of, 1)) & (F.col("state") == "完了") & F.col("kind").isin("新規", "切替")
    )
    members = tables["members"].filter("state = '有効'").select("customer_no", "member_id")
    rows = target.join(members, "customer_no").drop("state", "registered_ymd").distinct()
    return stamp(rows, as_of, process_datetime=STAMP)


def repair_details(tables: Tables, as_of: datetime) -> DataFrame:
    """Finished or running appliance repairs requested on the target day (D-21)."""
    rows = tables["repairs"].filter(
        (F.col("requested_ymd") == _ymd(as_of, 21))
        & F.col("state").isin("完了", "対応中")
        & F.col("repair_kind").isin("ガス機器", "水まわり")
    )
    return stamp(rows.drop("state"), as_of, process_datetime=STAMP).orderBy("meter_no", "requested_ymd")
