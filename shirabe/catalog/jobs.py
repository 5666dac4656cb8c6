"""List extracts and mart builds on the test tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shirabe.catalog import roles
from shirabe.catalog.registry import Tables, query
from shirabe.functions import text
from shirabe.operators.join import multiply_rows
from shirabe.operators.project import dealt_for
from shirabe.plans import lists, marts
from shirabe.session import scratch_path
from shirabe.sources import readers, writers
from shirabe.sources.readers import values_df

AS_OF = roles.ORDERS_AS_OF
OUT = "'2001/07/01 01:30:00'"
ACTIVE = "service_type = '001' AND transfer_type = '02' AND user_key_type = '003'"

# ---------------------------------------------------------------- role tables


def uncollected(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    return t.orders.select(
        F.col("o_custkey").cast("string").alias("pay_contract"),
        key.alias("invoice_no"),
        (key % 1000).alias("mgmt_no"),
        F.date_format("o_orderdate", "yyyyMM").alias("fee_month"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("due_ymd"),
        F.col("o_totalprice").alias("amount"),
        F.when(F.col("o_orderstatus") == "F", "1").otherwise("0").alias("paid_flag"),
        F.when(key % 50 == 0, "1").otherwise("0").alias("refund_flag"),
        F.when(key % 3 == 0, "1").otherwise("3").alias("bill_state"),
        F.left("o_orderpriority", F.lit(1)).alias("pay_method"),
        F.concat(F.lit("1"), (key % 7).cast("string")).alias("service_class"),
    )


UNCOLLECTED = """uncollected AS (
  SELECT CAST(o_custkey AS VARCHAR) AS pay_contract, o_orderkey AS invoice_no, o_orderkey % 1000 AS mgmt_no,
         strftime(o_orderdate, '%Y%m') AS fee_month, strftime(o_orderdate, '%Y%m%d') AS due_ymd, o_totalprice AS amount,
         CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END AS paid_flag,
         CASE WHEN o_orderkey % 50 = 0 THEN '1' ELSE '0' END AS refund_flag,
         CASE WHEN o_orderkey % 3 = 0 THEN '1' ELSE '3' END AS bill_state, left(o_orderpriority, 1) AS pay_method,
         '1' || CAST(o_orderkey % 7 AS VARCHAR) AS service_class FROM orders)"""


def owner_contracts(t: Tables) -> DataFrame:
    """Identified contracts: two editions per customer."""
    twice = multiply_rows(t.customer.select("c_custkey"), 2, "n")
    key = F.col("c_custkey")
    return twice.select(
        F.concat(F.lit("M"), text.numbered(key, 8)).alias("member_id"),
        key.cast("string").alias("pay_contract"),
        key.cast("string").alias("reg_no"),
        F.concat(F.lit("200106"), F.col("n"), F.lit("0")).alias("csv_ymd"),
        F.when(key % 9 == 0, 1).otherwise(0).alias("left_flag"),
        F.concat(F.lit("K"), F.col("n")).alias("kind_code"),
    )


OWNERS = """owners AS (
  SELECT 'M' || CASE WHEN c_custkey > 99999999 THEN CAST(c_custkey AS VARCHAR) ELSE lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS member_id, CAST(c_custkey AS VARCHAR) AS pay_contract,
         CAST(c_custkey AS VARCHAR) AS reg_no, '200106' || CAST(n AS VARCHAR) || '0' AS csv_ymd,
         CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 0 END AS left_flag, 'K' || CAST(n AS VARCHAR) AS kind_code
  FROM customer, (SELECT unnest([1, 2]) AS n))"""


def alert_history(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    return t.orders.filter("o_orderdate < TIMESTAMP_NTZ '1997-01-01 00:00:00'").select(
        key.alias("invoice_no"),
        (key % 1000).alias("mgmt_no"),
        F.col("o_custkey").cast("string").alias("pay_contract"),
        F.lit("M-old").alias("member_id"),
        F.lit("2001/06/01").alias("first_seen"),
        F.lit("2001/06/15").alias("last_seen"),
    )


HISTORY = """history AS (SELECT o_orderkey AS invoice_no, o_orderkey % 1000 AS mgmt_no, CAST(o_custkey AS VARCHAR) AS pay_contract,
  'M-old' AS member_id, '2001/06/01' AS first_seen, '2001/06/15' AS last_seen FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01')"""


def _alert_tables(t: Tables) -> dict[str, DataFrame]:
    return {"uncollected": uncollected(t), "gas": roles.gas(t), "contracts": owner_contracts(t), "history": alert_history(t)}


BULK = "('11', '14', '15', '21', '13')"

ALERTS = f"""{UNCOLLECTED}, {roles.GAS}, {OWNERS}, {HISTORY},
target AS (SELECT DISTINCT pay_contract, invoice_no, mgmt_no, fee_month, due_ymd FROM uncollected
  WHERE paid_flag = '0' AND refund_flag = '0' AND bill_state = '3' AND due_ymd < '20010701' AND amount > 0 AND pay_method = '2'
    AND service_class NOT IN {BULK}),
joined AS (SELECT t.*, CAST(user_reg_no AS VARCHAR) AS user_reg, g.pay_method AS gas_method FROM target t
  JOIN gas g ON t.pay_contract = CAST(g.pay_contract_no AS VARCHAR) WHERE contract_state <> '00' AND service_class NOT IN {BULK}),
ranked AS (SELECT o.member_id, j.*, row_number() OVER (PARTITION BY member_id, j.pay_contract, fee_month, invoice_no
    ORDER BY csv_ymd DESC, due_ymd DESC, mgmt_no, user_reg, gas_method) AS rn
  FROM owners o JOIN joined j ON o.pay_contract = j.pay_contract AND o.left_flag = 0),
alerts AS (SELECT member_id, pay_contract, invoice_no, mgmt_no, fee_month, due_ymd, user_reg, gas_method, {OUT} AS output_datetime,
  CASE WHEN EXISTS (SELECT 1 FROM history h WHERE h.invoice_no = r.invoice_no AND h.mgmt_no = r.mgmt_no) THEN 1 ELSE 0 END AS existing_flag
  FROM ranked r WHERE rn = 1)"""


@query("job_payment_alerts", f"WITH {ALERTS} SELECT * FROM alerts")
def job_payment_alerts(t: Tables) -> DataFrame:
    return lists.payment_alerts(_alert_tables(t), AS_OF)


@query(
    "job_payment_alert_list",
    f"""WITH {ALERTS} SELECT member_id, pay_contract, invoice_no, fee_month, due_ymd, user_reg, gas_method, output_datetime FROM (
        SELECT *, row_number() OVER (PARTITION BY invoice_no ORDER BY due_ymd DESC, member_id) AS rn FROM alerts) WHERE rn = 1""",
)
def job_payment_alert_list(t: Tables) -> DataFrame:
    return lists.payment_alert_list(_alert_tables(t), AS_OF)


@query(
    "job_payment_alert_history",
    f"""WITH {ALERTS} SELECT h.invoice_no, h.mgmt_no, h.pay_contract, h.member_id, first_seen,
          CASE WHEN EXISTS (SELECT 1 FROM alerts a WHERE a.invoice_no = h.invoice_no AND a.mgmt_no = h.mgmt_no) THEN '2001/07/01'
            ELSE last_seen END AS last_seen FROM history h
        UNION ALL SELECT invoice_no, mgmt_no, pay_contract, member_id, '2001/07/01', '2001/07/01' FROM alerts WHERE existing_flag = 0""",
)
def job_payment_alert_history(t: Tables) -> DataFrame:
    return lists.payment_alert_history(_alert_tables(t), AS_OF)


@query(
    "job_payment_method_master",
    f"""WITH {roles.USAGE}, {roles.GAS} SELECT bx, index_id, pay_contract_no, contract_state, pay_method, service_class,
          {OUT} AS output_datetime FROM (
          SELECT *, row_number() OVER (PARTITION BY bx, pay_contract_no ORDER BY output_date DESC, index_id, user_key, contract_state,
            pay_method, service_class) AS rn FROM usage JOIN gas ON user_key = CAST(user_reg_no AS VARCHAR) WHERE {ACTIVE}) WHERE rn = 1""",
)
def job_payment_method_master(t: Tables) -> DataFrame:
    return lists.payment_method_master({"usage": roles.usage(t), "gas": roles.gas(t)}, AS_OF)


def _gas_days(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Yesterday's and today's gas contracts; some changed their payment method."""
    today = roles.gas(t).withColumns({"contract_no": F.col("user_reg_no")})
    before = today.withColumn("pay_method", F.when(F.col("contract_no") % 5 == 0, F.lit("2")).otherwise(F.col("pay_method")))
    return before, today


@query(
    "job_payment_method_changed",
    f"""WITH {roles.USAGE}, {roles.GAS}, changed AS (SELECT DISTINCT CAST(g.user_reg_no AS VARCHAR) AS user_key FROM gas g
          WHERE (g.user_reg_no % 5 = 0 OR g.pay_method = '2') AND g.pay_method <> '2' AND g.service_class NOT IN ('11', '12', '13', '21'))
        SELECT bx, index_id, user_key, {OUT} AS output_datetime FROM (SELECT u.*, row_number() OVER (PARTITION BY bx
          ORDER BY output_date DESC, index_id, u.user_key) AS rn FROM usage u JOIN changed c ON u.user_key = c.user_key WHERE {ACTIVE}) WHERE rn = 1""",
)
def job_payment_method_changed(t: Tables) -> DataFrame:
    before, today = _gas_days(t)
    processed = values_df(t.spark, [("20010628", "20010629")], "prev_day string, cur_day string")
    tables = {"gas": today, "gas_previous": before, "usage": roles.usage(t), "processed": processed}
    return lists.payment_method_changed(tables, AS_OF, {"prev_day": "20010629", "cur_day": "20010630"})


def openings(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    return t.orders.select(
        key.alias("case_no"),
        F.col("o_custkey").cast("string").alias("meter_no"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("work_ymd"),
        F.when(key % 10 == 0, "2").otherwise("1").alias("retail_kind"),
        F.concat(F.lit("1"), (key % 4).cast("string")).alias("reason_code"),
        (key % 3).cast("string").alias("error_state"),
    )


@query(
    "job_opening_payment_guide",
    f"""WITH {roles.USAGE}, o AS (SELECT o_orderkey AS case_no, CAST(o_custkey AS VARCHAR) AS meter_no, strftime(o_orderdate, '%Y%m%d') AS work_ymd
          FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 4 IN (1, 2) AND o_orderkey % 3 IN (0, 2)
            AND strftime(o_orderdate, '%Y%m%d') >= '20010611' AND strftime(o_orderdate, '%Y%m%d') < '20010626'),
        g AS (SELECT o.*, CAST(x.o_orderkey AS VARCHAR) AS gas_user FROM o JOIN orders x ON o.meter_no = CAST(x.o_custkey AS VARCHAR))
        SELECT bx, index_id, case_no, meter_no, work_ymd, user_key, {OUT} AS output_datetime FROM (
          SELECT g.*, bx, index_id, user_key, row_number() OVER (PARTITION BY bx, case_no, meter_no, work_ymd
            ORDER BY output_date DESC, index_id, user_key) AS rn FROM g JOIN usage ON user_key = gas_user WHERE {ACTIVE}) WHERE rn = 1""",
)
def job_opening_payment_guide(t: Tables) -> DataFrame:
    gas = roles.gas(t).withColumn("meter_no", F.col("pay_contract_no"))
    return lists.opening_payment_guide({"openings": openings(t), "gas": gas, "usage": roles.usage(t)}, AS_OF)


def power_contracts(t: Tables) -> DataFrame:
    """Electricity contracts with supply point and person attributes."""
    key = F.col("o_orderkey")
    return t.orders.select(
        key.alias("sa_id"),
        F.concat_ws("-", F.col("o_custkey").cast("string"), F.left("o_orderpriority", F.lit(1))).alias("supply_point"),
        F.when(key % 3 == 0, None).otherwise(F.col("o_custkey").cast("string")).alias("reg_no"),
        F.when(key % 4 == 0, None).otherwise(key % 23).alias("person"),
        (key % 41).alias("kana"),
        F.when(key % 5 == 0, None).otherwise(key % 53).alias("phone"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("start_ymd"),
        # Everything started since May is registered on one day, so that a daily run has rows at any scale.
        F.when(F.col("o_orderdate") >= F.lit("2001-05-01 00:00:00").cast("timestamp_ntz"), "20010630")
        .otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
        .alias("registered_ymd"),
        F.when(key % 7 == 0, "C").otherwise("A").alias("update_kind"),
        F.when(key % 2 == 0, "ESLVY").otherwise("ESOTH").alias("contract_type"),
    )


POWER = """power AS (SELECT o_orderkey AS sa_id, CAST(o_custkey AS VARCHAR) || '-' || left(o_orderpriority, 1) AS supply_point,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS reg_no,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 23 END AS person, o_orderkey % 41 AS kana,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 53 END AS phone, strftime(o_orderdate, '%Y%m%d') AS start_ymd,
  CASE WHEN o_orderdate >= TIMESTAMP '2001-05-01' THEN '20010630' ELSE strftime(o_orderdate, '%Y%m%d') END AS registered_ymd,
  CASE WHEN o_orderkey % 7 = 0 THEN 'C' ELSE 'A' END AS update_kind,
  CASE WHEN o_orderkey % 2 = 0 THEN 'ESLVY' ELSE 'ESOTH' END AS contract_type FROM orders)"""

# The thanks history: contracts started before 1996 were thanked before.
THANKS = f"""{POWER}, {OWNERS}, ops AS (SELECT l_orderkey AS sa_id, strftime(l_shipdate, '%Y%m%d') AS applied FROM lineitem
  WHERE l_linestatus = 'O' AND l_returnflag = 'N'),
old AS (SELECT supply_point, reg_no, sa_id, start_ymd, start_ymd AS applied, contract_type, '20010601' AS run_ymd FROM power WHERE start_ymd < '19960101'),
batch AS (SELECT DISTINCT c.supply_point, c.reg_no, c.sa_id, c.start_ymd, applied, c.contract_type, '20010701' AS run_ymd FROM power c JOIN ops o ON c.sa_id = o.sa_id
  WHERE update_kind = 'A' AND registered_ymd = '20010630' AND EXISTS (SELECT 1 FROM (SELECT count(DISTINCT ct.sa_id) AS n FROM power ct
    WHERE ct.supply_point = c.supply_point AND (ct.reg_no = c.reg_no OR ct.person = c.person OR ct.kana = c.kana OR ct.phone = c.phone)) WHERE n = 1)),
thanked AS (SELECT * FROM old UNION ALL SELECT * FROM batch b
  WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.supply_point = b.supply_point AND o.reg_no = b.reg_no))"""


def _thanks_tables(t: Tables) -> dict[str, DataFrame]:
    contracts = power_contracts(t)
    old = contracts.filter("start_ymd < '19960101'").select(
        "supply_point", "reg_no", "sa_id", "start_ymd", F.col("start_ymd").alias("applied"), "contract_type", F.lit("20010601").alias("run_ymd")
    )
    operations = t.lineitem.select(
        F.col("l_orderkey").alias("sa_id"),
        F.date_format("l_shipdate", "yyyyMMdd").alias("applied"),
        F.when(F.col("l_linestatus") == "O", "800").otherwise("100").alias("status"),
        F.when(F.col("l_returnflag") == "N", "ESST").otherwise("ESEN").alias("kind"),
    )
    return {"contracts": contracts, "operations": operations, "history": old, "members": owner_contracts(t)}


@query("job_thanks_history", f"WITH {THANKS} SELECT * FROM thanked")
def job_thanks_history(t: Tables) -> DataFrame:
    return lists.thanks_history(_thanks_tables(t), AS_OF)


@query(
    "job_thanks_list",
    f"""WITH {THANKS} SELECT supply_point, t.reg_no, sa_id, start_ymd, applied, contract_type, member_id, kind_code, {OUT} AS output_datetime
        FROM thanked t JOIN owners o ON t.reg_no = o.reg_no AND left_flag = 0 WHERE start_ymd BETWEEN '20010601' AND '20010606'""",
)
def job_thanks_list(t: Tables) -> DataFrame:
    return lists.thanks_list(_thanks_tables(t), AS_OF)


def repairs(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    return t.lineitem.select(
        F.when(F.col("l_orderkey") % 100 == 0, "00000000000").otherwise(F.col("l_orderkey").cast("string")).alias("meter_no"),
        F.date_format("l_shipdate", "yyyyMMdd").alias("completed_ymd"),
        F.when(F.col("l_linenumber") % 5 == 0, "00000000").otherwise(F.date_format("l_shipdate", "yyyyMMdd")).alias("inspected_ymd"),
        F.when(F.col("l_linenumber") == 7, "0302").otherwise("0301").alias("field_code"),
        F.when(flag == "N", "11").when(flag == "R", "1A").otherwise("12").alias("subject_code"),
    )


REPAIRS = """repairs AS (SELECT CASE WHEN l_orderkey % 100 = 0 THEN '00000000000' ELSE CAST(l_orderkey AS VARCHAR) END AS meter_no,
  strftime(l_shipdate, '%Y%m%d') AS completed_ymd, CASE WHEN l_linenumber % 5 = 0 THEN '00000000' ELSE strftime(l_shipdate, '%Y%m%d') END AS inspected_ymd,
  CASE WHEN l_linenumber = 7 THEN '0302' ELSE '0301' END AS field_code,
  CASE l_returnflag WHEN 'N' THEN '11' WHEN 'R' THEN '1A' ELSE '12' END AS subject_code FROM lineitem)"""


@query(
    "job_repair_follow_up",
    f"""WITH {roles.USAGE}, {REPAIRS}, active AS (SELECT * FROM usage WHERE transfer_type = '02'),
        r AS (SELECT meter_no, completed_ymd, max(CASE WHEN subject_code = '11' THEN '1' ELSE '0' END) AS gas_appliance_flag,
          max(CASE WHEN subject_code = '1A' THEN '1' ELSE '0' END) AS wet_area_flag FROM repairs
          WHERE meter_no <> '00000000000' AND inspected_ymd <> '00000000' AND completed_ymd >= '20010610' AND field_code = '0301'
            AND subject_code IN ('11', '1A') GROUP BY 1, 2),
        multi AS (SELECT k FROM (SELECT bx, service_key1 AS k FROM active WHERE key_type1 = '001' UNION SELECT bx, service_key2 FROM active
          WHERE key_type2 = '001' UNION SELECT bx, service_key3 FROM active WHERE key_type3 = '001') GROUP BY k HAVING count(*) > 1),
        kept AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM multi WHERE k = meter_no))
        SELECT bx, index_id, meter_no, completed_ymd, gas_appliance_flag, wet_area_flag, {OUT} AS output_datetime FROM (
          SELECT kept.*, bx, index_id, row_number() OVER (PARTITION BY bx, meter_no, completed_ymd ORDER BY output_date DESC, index_id) AS rn
          FROM kept JOIN active ON meter_no IN (service_key1, service_key2, service_key3)) WHERE rn = 1""",
)
def job_repair_follow_up(t: Tables) -> DataFrame:
    return lists.repair_follow_up({"repairs": repairs(t), "usage": roles.usage(t)}, AS_OF)


@query(
    "job_moving_promotion",
    f"""SELECT DISTINCT CAST(d.o_custkey AS VARCHAR) AS meter_no, CAST(d.o_orderkey AS VARCHAR) AS contract_no,
          round(d.o_totalprice % 100, 2) AS forecast, {OUT} AS output_datetime FROM orders d
        JOIN orders g ON d.o_custkey = g.o_custkey AND d.o_orderkey = g.o_orderkey
        WHERE d.o_orderkey % 13 <> 0 AND d.o_orderkey % 3 <> 0 AND g.o_orderkey % 11 <> 0 AND g.o_orderdate < TIMESTAMP '2001-05-01'""",
)
def job_moving_promotion(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    dna = t.orders.select(
        F.col("o_custkey").cast("string").alias("meter_no"),
        F.when(key % 13 != 0, key.cast("string")).alias("contract_no"),
        F.when(key % 3 != 0, F.round(F.col("o_totalprice") % 100, 2)).alias("forecast"),
    )
    gas = roles.gas(t).withColumns({"meter_no": F.col("pay_contract_no"), "contract_no": F.col("user_reg_no")})
    return lists.moving_promotion({"gas": gas, "client_dna": dna}, AS_OF)


# ---------------------------------------------------------------- action points

EV_AS_OF = roles.EVENTS_AS_OF
EV_OUT = "'2024/01/30 21:00:00'"
FIRST = datetime(2024, 1, 1)


def _entry_events(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    name = F.when(kind == "click", "ap_gas").when(kind == "view", "ap_power").when(kind == "purchase", "ap_quiz").otherwise(kind)
    member = F.when(F.col("user_id") % 20 != 0, F.col("user_id"))
    return t.events.select(member.alias("member_id"), name.alias("event_name"), F.col("ts").alias("event_time"))


ENTRY = """e AS (SELECT CASE WHEN user_id % 20 <> 0 THEN user_id END AS member_id, CASE event_type WHEN 'click' THEN 'ap_gas' WHEN 'view' THEN
  'ap_power' WHEN 'purchase' THEN 'ap_quiz' ELSE event_type END AS event_name, ts AS event_time FROM events),
entry AS (SELECT DISTINCT member_id, CASE event_name WHEN 'ap_gas' THEN 1 WHEN 'ap_power' THEN 2 WHEN 'ap_quiz' THEN 3 ELSE 99 END AS point_kind,
  CAST(event_time AS DATE) AS entry_date, event_time FROM e WHERE event_name IN ('ap_gas', 'ap_power', 'ap_quiz') AND member_id IS NOT NULL),
known AS (SELECT DISTINCT member_id, point_kind, entry_date, '20240115' AS registered_ymd FROM entry WHERE entry_date < DATE '2024-01-15'),
batch AS (SELECT DISTINCT member_id, point_kind, entry_date, '20240130' AS registered_ymd FROM entry WHERE event_time >= TIMESTAMP '2023-12-31'),
after AS (SELECT * FROM known UNION ALL SELECT * FROM batch b WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.member_id = b.member_id
  AND k.point_kind = b.point_kind AND k.entry_date = b.entry_date))"""


def _entry_tables(t: Tables) -> dict[str, DataFrame]:
    events = _entry_events(t)
    names = {n: k for n, k in lists.ENTRY_KINDS.items()}
    kind = F.coalesce(*[F.when(F.col("event_name") == n, F.lit(k)) for n, k in names.items()])
    known = (
        events.filter(F.col("event_name").isin(*names) & F.col("member_id").isNotNull())
        .select("member_id", kind.alias("point_kind"), F.to_date("event_time").alias("entry_date"))
        .filter("entry_date < DATE '2024-01-15'")
        .distinct()
        .withColumn("registered_ymd", F.lit("20240115"))
    )
    return {"events": events, "entries": known}


@query(
    "job_action_point_entries",
    f"WITH {ENTRY} SELECT member_id, point_kind, strftime(entry_date, '%Y-%m-%d') AS entry_date, registered_ymd FROM after",
)
def job_action_point_entries(t: Tables) -> DataFrame:
    out = lists.action_point_entries(_entry_tables(t), EV_AS_OF, FIRST)
    return out.withColumn("entry_date", F.col("entry_date").cast("string"))


@query(
    "job_action_point_current_month",
    f"""WITH {ENTRY} SELECT member_id, point_kind, strftime(entry_date, '%Y/%m/%d') AS entry_date, {EV_OUT} AS output_datetime FROM after
        WHERE entry_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'""",
)
def job_action_point_current_month(t: Tables) -> DataFrame:
    return lists.action_point_current_month(_entry_tables(t), EV_AS_OF, FIRST)


def _transaction_tables(t: Tables) -> dict[str, DataFrame]:
    kind, key = F.col("event_type"), F.col("event_id")
    remark = (
        F.when(kind == "click", F.concat(F.lit("ガス使用量"), F.col("props")))
        .when(kind == "view", F.concat(F.lit("電気使用量"), F.col("props")))
        .when(kind == "purchase", F.concat(F.lit("クイズ回答"), F.col("props")))
        .otherwise(F.lit("その他"))
    )
    code = F.when(key % 3 == 0, "9002").when(key % 3 == 1, "9009").otherwise("9001")
    rows = t.events.select(
        F.col("user_id").alias("member_id"),
        remark.alias("remarks"),
        code.alias("point_code"),
        F.date_format("ts", "yyyyMMdd").alias("processed_ymd"),
    )
    kinds = F.coalesce(*[F.when(F.col("remarks").startswith(p), F.lit(k)) for p, k in lists.REMARK_KINDS.items()])
    known = (
        rows.filter("processed_ymd < '20240120'")
        .select("member_id", kinds.alias("point_kind"), F.to_date("processed_ymd", "yyyyMMdd").alias("processed_date"))
        .filter("point_kind IS NOT NULL")
        .distinct()
        .withColumn("registered_ymd", F.lit("20240120"))
    )
    members = roles.members(t).withColumn("member_id", F.col("customer_no"))
    held = t.orders.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("member_id")).distinct()
    return {"transactions": rows, "history": known, "members": members, "under_contract": held}


TRANSACTIONS = """tr AS (SELECT user_id AS member_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 END AS point_kind,
  event_id % 3 < 2 AS coded, CAST(ts AS DATE) AS processed_date FROM events),
known AS (SELECT DISTINCT member_id, point_kind, processed_date, '20240120' AS registered_ymd FROM tr
  WHERE processed_date < DATE '2024-01-20' AND point_kind IS NOT NULL),
batch AS (SELECT DISTINCT member_id, point_kind, processed_date, '20240130' AS registered_ymd FROM tr WHERE coded AND point_kind IS NOT NULL
  AND processed_date >= DATE '2024-01-16'),
after AS (SELECT * FROM known UNION ALL SELECT * FROM batch b WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.member_id = b.member_id
  AND k.point_kind = b.point_kind AND k.processed_date = b.processed_date))"""


@query(
    "job_action_point_transactions",
    f"WITH {TRANSACTIONS} SELECT member_id, point_kind, strftime(processed_date, '%Y-%m-%d') AS processed_date, registered_ymd FROM after",
)
def job_action_point_transactions(t: Tables) -> DataFrame:
    out = lists.action_point_transactions(_transaction_tables(t), EV_AS_OF, FIRST)
    return out.withColumn("processed_date", F.col("processed_date").cast("string"))


@query(
    "job_action_point_recent",
    f"""WITH {TRANSACTIONS} SELECT member_id, point_kind, strftime(max(processed_date), '%Y/%m/%d') AS recent_transaction_date,
          {EV_OUT} AS output_datetime FROM after JOIN customer ON c_custkey = member_id AND c_custkey % 9 <> 0 AND c_custkey % 4 <> 0
        WHERE member_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1, 2""",
)
def job_action_point_recent(t: Tables) -> DataFrame:
    return lists.action_point_recent(_transaction_tables(t), EV_AS_OF, FIRST)


# ---------------------------------------------------------------- usage and customer marts


def _slots(code: str) -> str:
    whens = " ".join(f"WHEN key_type{s} = '{code}' THEN service_key{s}" for s in (1, 2, 3))
    return f"CASE {whens} ELSE NULL END"


@query(
    "job_usage_by_member",
    f"""WITH {roles.USAGE}, latest AS (SELECT * EXCLUDE (bx, line_no, quantity, user_key_type), CASE WHEN line_no = 7 THEN '017' ELSE user_key_type END AS user_key_type,
          CAST(quantity AS BIGINT) % 2 AS update_flag FROM usage),
        mk AS (SELECT o_orderkey AS index_id, 'M' || CAST(o_custkey AS VARCHAR) AS member_id FROM orders WHERE o_orderstatus <> 'P'),
        bk AS (SELECT o_orderkey AS index_id, 'B' || CAST(o_custkey AS VARCHAR) AS bx FROM orders WHERE o_orderpriority <> '5-LOW'),
        c AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY index_id, user_key_type, user_key, service_type, transfer_type, transfer_ymd,
          key_type1, key_type2, key_type3, service_key1, service_key2, service_key3, output_date ORDER BY update_flag DESC, amount) AS rn FROM latest l
          WHERE EXISTS (SELECT 1 FROM mk WHERE mk.index_id = l.index_id) AND user_key_type NOT IN ('017', '011')) WHERE rn = 1),
        d AS (SELECT bk.bx, mk.member_id, c.* FROM mk JOIN c ON c.index_id = mk.index_id LEFT JOIN bk ON bk.index_id = c.index_id),
        e AS (SELECT *, row_number() OVER (PARTITION BY bx, member_id, index_id, user_key_type, user_key, service_type, key_type1, service_key1,
          key_type2, service_key2, key_type3, service_key3, output_date, update_flag ORDER BY transfer_ymd DESC, transfer_type DESC, amount) AS rn FROM d)
        SELECT bx, member_id, index_id, {_slots('001')} AS key_1x, CASE WHEN user_key_type = '003' THEN user_key END AS key_3x,
          {_slots('004')} AS key_4x, {_slots('007')} AS sa_id, service_type, transfer_ymd FROM e WHERE rn = 1 AND transfer_type = '02'""",
)
def job_usage_by_member(t: Tables) -> DataFrame:
    usage = roles.usage(t)
    kind = F.when(F.col("line_no") == 7, "017").otherwise(F.col("user_key_type"))
    usage = usage.withColumns({"user_key_type": kind, "update_flag": F.col("quantity").cast("long") % 2}).drop("bx", "line_no", "quantity")
    owner = F.col("o_custkey").cast("string")
    members = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("index_id"), F.concat(F.lit("M"), owner).alias("member_id"))
    bx = t.orders.filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("index_id"), F.concat(F.lit("B"), owner).alias("bx"))
    return marts.usage_by_member({"usage": usage, "member_keys": members, "bx_keys": bx})


@query(
    "job_unified_customer_mart",
    f"""WITH {roles.USAGE}, mart AS (SELECT o_orderkey AS client_no, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS key_4x,
          CAST(o_orderkey AS VARCHAR) AS key_3x, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS lighting_sa,
          CAST(o_orderkey AS VARCHAR) AS power_sa FROM orders),
        g AS (SELECT * FROM (SELECT bx, {_slots('004')} AS k, index_id, output_date, transfer_ymd, row_number() OVER (PARTITION BY bx, {_slots('004')}
          ORDER BY output_date DESC, transfer_ymd DESC, index_id) AS rn FROM usage WHERE service_type = '001' AND transfer_type = '02') WHERE rn = 1),
        p AS (SELECT * FROM (SELECT bx, user_key, {_slots('007')} AS k, index_id, output_date, transfer_ymd, row_number() OVER (PARTITION BY bx, user_key, {_slots('007')}
          ORDER BY output_date DESC, transfer_ymd DESC, index_id) AS rn FROM usage WHERE service_type = '006' AND transfer_type = '02' AND user_key_type = '003') WHERE rn = 1)
        SELECT m.*, g.bx, g.index_id, g.output_date, g.transfer_ymd FROM mart m LEFT JOIN g ON m.key_4x = g.k WHERE m.key_4x IS NOT NULL
        UNION ALL SELECT m.*, p.bx, p.index_id, p.output_date, p.transfer_ymd FROM mart m LEFT JOIN p ON m.key_3x = p.user_key
          AND coalesce(m.lighting_sa, m.power_sa) = p.k WHERE m.key_4x IS NULL""",
)
def job_unified_customer_mart(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    text = key.cast("string")
    mart = t.orders.select(
        key.alias("client_no"),
        F.when(key % 3 != 0, text).alias("key_4x"),
        text.alias("key_3x"),
        F.when(key % 2 == 0, text).alias("lighting_sa"),
        text.alias("power_sa"),
    )
    return marts.unified_customer_mart({"usage": roles.usage(t), "mart": mart})


# ---------------------------------------------------------------- mail lists and extracts

MAIL_ROWS = f"""{roles.MEMBERS}, file AS (SELECT 'M' || CAST(customer_no AS VARCHAR) AS id_no, CAST(customer_no % 3 AS VARCHAR) AS point_kind,
  mail, CAST(customer_no % 12 AS VARCHAR) AS picture_month FROM members)"""


def _mail_file(t: Tables) -> DataFrame:
    """The daily tab-separated file, written from the members and read back strictly."""
    n = F.col("customer_no")
    rows = roles.members(t).select(
        F.concat(F.lit("M"), n.cast("string")).alias("id_no"),
        (n % 3).cast("string").alias("point_kind"),
        "mail",
        (n % 12).cast("string").alias("picture_month"),
    )
    folder = scratch_path(t.spark, "point_add")
    path = readers.dated_path(f"{folder}/%Y%m%d/point_add.tsv", AS_OF)
    rows.write.option("sep", "\t").csv(path)
    limits = {"id_no": 20, "point_kind": 4, "mail": 50, "picture_month": 2}
    return readers.read_or_empty(t.spark, path, rows.schema, sep="\t", max_rejects=0, max_length=limits)


@query(
    "job_point_grant_mail",
    f"""WITH {MAIL_ROWS} SELECT id_no, point_kind, picture_month, max(mail) AS mail, '20010701' AS csv_ymd, {OUT} AS output_datetime
        FROM file GROUP BY 1, 2, 3""",
)
def job_point_grant_mail(t: Tables) -> DataFrame:
    return lists.mail_list(_mail_file(t), AS_OF, ["id_no", "point_kind", "picture_month"])


@query(
    "job_point_lost_mail",
    f"""WITH {MAIL_ROWS} SELECT id_no, point_kind, picture_month, mail, '20010701' AS csv_ymd, {OUT} AS output_datetime FROM (
        SELECT *, row_number() OVER (PARTITION BY id_no ORDER BY mail DESC NULLS LAST, point_kind, picture_month) AS rn FROM file) WHERE rn = 1""",
)
def job_point_lost_mail(t: Tables) -> DataFrame:
    return lists.mail_list(_mail_file(t), AS_OF, ["id_no"])


@query(
    "job_registration_mail",
    f"""WITH {MAIL_ROWS} SELECT id_no, point_kind, max(mail) AS mail, '20010701' AS csv_ymd, {OUT} AS output_datetime FROM file GROUP BY 1, 2""",
)
def job_registration_mail(t: Tables) -> DataFrame:
    rows = _mail_file(t).drop("picture_month")
    out = lists.mail_list(rows, AS_OF, ["id_no", "point_kind"])
    folder = scratch_path(t.spark, "registration")
    writers.write_csv_gz(out, folder, "registration_%Y%m%d", AS_OF)
    return readers.read_delimited(t.spark, folder, out.schema, header=True)


@query(
    "job_mail_permission",
    f"""WITH {roles.MEMBERS} SELECT m.*, o_orderkey AS service_no, left(o_orderpriority, 1) AS service_code,
          CASE WHEN o_orderkey IS NULL THEN NULL WHEN o_orderstatus = 'O' THEN '99991231' ELSE strftime(o_orderdate, '%Y%m%d') END AS end_ymd,
          {OUT} AS output_datetime FROM members m LEFT JOIN orders ON customer_no = o_custkey""",
)
def job_mail_permission(t: Tables) -> DataFrame:
    services = t.orders.select(
        F.concat(F.lit("M"), text.numbered(F.col("o_custkey"), 8)).alias("member_id"),
        F.col("o_orderkey").alias("service_no"),
        F.left("o_orderpriority", F.lit(1)).alias("service_code"),
        F.when(F.col("o_orderstatus") == "O", "99999999").otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("end_ymd"),
    )
    return lists.mail_permission({"members": roles.members(t), "services": services}, AS_OF)


@query("job_identification_extract", f"WITH {OWNERS} SELECT member_id, reg_no, csv_ymd, kind_code, {OUT} AS output_datetime FROM owners")
def job_identification_extract(t: Tables) -> DataFrame:
    return lists.full_extract(owner_contracts(t), AS_OF, ["member_id", "reg_no", "csv_ymd", "kind_code"])


@query("job_line_link_extract", f"WITH {roles.MEMBERS} SELECT *, {OUT} AS output_datetime FROM members")
def job_line_link_extract(t: Tables) -> DataFrame:
    return lists.full_extract(roles.members(t), AS_OF)


@query("job_usage_extract", f"WITH {roles.USAGE} SELECT *, {OUT} AS output_datetime FROM usage")
def job_usage_extract(t: Tables) -> DataFrame:
    return lists.full_extract(roles.usage(t), AS_OF)


# ---------------------------------------------------------------- contract marts


@query(
    "job_contract_flags",
    """WITH own AS (SELECT 'M' || CAST(c_custkey AS VARCHAR) AS member_id, n AS branch_no, c_custkey FROM customer, (SELECT unnest([1, 2]) AS n)),
       full_flags AS (SELECT member_id, branch_no, 1 AS internal_gas, NULL AS gas_and_power FROM own JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'
         UNION ALL SELECT member_id, branch_no, NULL, 1 FROM own JOIN orders e ON e.o_custkey = c_custkey AND e.o_orderkey % 10 = 0
         JOIN orders g ON g.o_custkey = c_custkey AND g.o_orderstatus = 'F')
       SELECT member_id, branch_no, max(internal_gas) AS internal_gas, max(gas_and_power) AS gas_and_power, CAST(NULL AS INTEGER) AS external_gas,
         CAST(NULL AS INTEGER) AS external_gas_and_power, CAST(NULL AS INTEGER) AS power FROM full_flags GROUP BY 1, 2""",
)
def job_contract_flags(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    owners = multiply_rows(t.customer.select("c_custkey"), 2, "branch_no").select(
        F.concat(F.lit("M"), key.cast("string")).alias("member_id"), "branch_no", key.alias("reg_no")
    )
    gas = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("reg_no"))
    kind = F.when(F.col("o_orderkey") % 10 == 0, "ESLVY").otherwise("ESOTH")
    power = t.orders.select(F.col("o_custkey").alias("reg_no"), kind.alias("contract_type"))
    return marts.contract_flags({"contracts": owners, "gas": gas, "power": power})


PRESENCE = f"""{roles.USAGE}, presence AS (SELECT NULLIF(index_id, 5) AS member_id, max(CASE WHEN service_type = '001' THEN '1' ELSE '0' END) AS internal_area_gas,
  max(CASE WHEN service_type = '010' THEN '1' ELSE '0' END) AS external_area_gas, max(CASE WHEN service_type = '006' THEN '1' ELSE '0' END) AS power
  FROM usage WHERE transfer_type = '02' GROUP BY 1)"""


def _presence(t: Tables) -> DataFrame:
    rows = roles.usage(t).withColumn("member_id", F.nullif("index_id", F.lit(5)))
    return marts.contract_presence(rows, "member_id")


@query(
    "job_contract_presence",
    f"""WITH {PRESENCE} SELECT *, CASE WHEN internal_area_gas = '1' AND power = '1' THEN 'GAS_POWER' WHEN internal_area_gas = '1' THEN 'GAS_ONLY'
        WHEN power = '1' THEN 'POWER_ONLY' ELSE 'NO_CONTRACT' END AS contract_type FROM presence WHERE member_id IS NOT NULL""",
)
def job_contract_presence(t: Tables) -> DataFrame:
    return _presence(t)


@query(
    "job_contract_presence_counts",
    f"""WITH {PRESENCE} SELECT count(*) AS total_records, count(CASE WHEN internal_area_gas = '1' THEN 1 END) AS internal_gas_contracts,
        count(CASE WHEN external_area_gas = '1' THEN 1 END) AS external_gas_contracts, count(CASE WHEN power = '1' THEN 1 END) AS power_contracts,
        count(CASE WHEN internal_area_gas = '1' AND power = '1' THEN 1 END) AS gas_power_combined FROM presence WHERE member_id IS NOT NULL""",
)
def job_contract_presence_counts(t: Tables) -> DataFrame:
    return marts.presence_counts(_presence(t))


def _score_rows(t: Tables) -> DataFrame:
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    return t.customer.select(
        F.sha2(key.cast("string"), 256).alias("hashed_id"),
        F.when(key % 11 != 0, (key % 2).cast("string")).alias("internal_area_gas"),
        F.col("c_mktsegment").alias("internal_area_gas_menu"),
        F.when(balance >= 0, (key * 7919 % 100000) / 100000).cast("decimal(6,5)").alias("pv_score"),
        F.when(key % 7 != 0, (key % 100) / 2).cast("decimal(5,2)").alias("age_score"),
    )


@query(
    "job_contract_score_feed",
    """SELECT sha256(CAST(c_custkey AS VARCHAR)) AS user_id, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 2 = 1 END AS gas, c_mktsegment AS menu,
         CASE WHEN c_acctbal >= 0 THEN CAST(CAST((c_custkey * 7919 % 100000) / 100000.0 AS DECIMAL(6,5)) AS DOUBLE) END AS pv_score,
         CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 100) / 2.0::DOUBLE END AS age_score FROM customer""",
)
def job_contract_score_feed(t: Tables) -> DataFrame:
    docs = marts.contract_score_feed(
        _score_rows(t),
        "hashed_id",
        {
            "internal_area_gas": F.col("internal_area_gas").try_cast("boolean"),
            "internal_area_gas_menu": F.col("internal_area_gas_menu"),
        },
        {"pv_score": F.col("pv_score"), "age_score": F.col("age_score")},
    )
    folders = [scratch_path(t.spark, "feed") for _ in range(2)]
    writers.write_many(docs, [lambda df, f=f: writers.write_json(df, f, "score") for f in folders])
    back = readers.read_json(t.spark, folders[1], docs.schema)
    return back.select(
        "user_id",
        F.col("contract.internal_area_gas").alias("gas"),
        F.col("contract.internal_area_gas_menu").alias("menu"),
        F.col("score.pv_score").cast("double").alias("pv_score"),
        F.col("score.age_score").cast("double").alias("age_score"),
    )


@query(
    "job_contract_score_text",
    """SELECT sha256(CAST(c_custkey AS VARCHAR)) AS user_id, CASE WHEN c_custkey % 11 = 0 THEN 'Null' WHEN c_custkey % 2 = 1 THEN 'true' ELSE 'false' END AS gas,
         CASE WHEN c_acctbal < 0 THEN 'Null' ELSE printf('%.5f', CAST(CAST((c_custkey * 7919 % 100000) / 100000.0 AS DECIMAL(6,5)) AS DOUBLE)) END AS pv_score,
         CASE WHEN c_custkey % 7 = 0 THEN 'Null' ELSE CAST(CAST((c_custkey % 100) / 2.0 AS DECIMAL(5,2)) AS VARCHAR) END AS age_score FROM customer""",
)
def job_contract_score_text(t: Tables) -> DataFrame:
    docs = marts.contract_score_text(
        _score_rows(t), "hashed_id", ["internal_area_gas"], ["internal_area_gas_menu"], {"pv_score": "%.5f", "age_score": None}
    )
    return docs.select("user_id", F.col("contract.internal_area_gas").alias("gas"), "score.pv_score", "score.age_score")


@query(
    "job_member_master",
    f"""WITH k AS (SELECT o_custkey AS member_id, max(left(o_orderpriority, 1)) AS type_code FROM orders GROUP BY 1),
        l AS (SELECT user_id AS member_id, max(CASE WHEN event_type <> 'error' THEN 'U' || CAST(event_id AS VARCHAR) END) AS link_id,
          max(CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y%m%d') END) AS linked_on, count(CASE WHEN event_type <> 'error' THEN 1 END) AS link_count
          FROM events WHERE value > 5 GROUP BY 1)
        SELECT k.*, link_id, linked_on, link_count, c_mktsegment AS contract_flag, {OUT} AS process_datetime FROM k LEFT JOIN l ON k.member_id = l.member_id
        LEFT JOIN customer ON c_custkey = k.member_id AND c_acctbal > 0""",
)
def job_member_master(t: Tables) -> DataFrame:
    types = t.orders.select(F.col("o_custkey").alias("member_id"), F.left("o_orderpriority", F.lit(1)).alias("type_code"))
    links = t.events.select(
        F.col("user_id").alias("member_id"),
        F.concat(F.lit("U"), F.col("event_id").cast("string")).alias("link_id"),
        F.date_format("ts", "yyyyMMdd").alias("linked_on"),
        F.when(F.col("event_type") == "error", "1").otherwise("0").alias("cancelled"),
        F.when(F.col("value") > 5, "有効").otherwise("無効").alias("state"),
    )
    flags = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("member_id"), F.col("c_mktsegment").alias("contract_flag"))
    return marts.member_master({"member_types": types, "links": links, "flags": flags}, AS_OF)


# The wide layout of 533 columns: keys, 480 live columns in groups of four, and retired ones by year and number.
KEYS = {
    "c_custkey": "client_key",
    "c_name": "client_name",
    "c_acctbal": "balance",
    "c_mktsegment": "segment_code",
    "n_name": "area_name",
    "r_name": "district_name",
}
SOURCES = {
    "amount": "c_acctbal + {i}",
    "label": "concat(c_name, '-', '{i}')",
    "number": "c_custkey + {i}",
    "place": "concat(n_name, '/', '{i}')",
}
DERIVED = {f"src_{kind}_{i:03d}": text.format(i=i) for i in range(120) for kind, text in SOURCES.items()}
LIVE = KEYS | {name: name.replace("src_", "client_") for name in DERIVED}
RECAST = {d: "string" for d in LIVE.values() if d.startswith("client_number_")}
VARIED = ["client_key", "client_name", *[d for s, d in LIVE.items() if s in DERIVED and not s.startswith("src_place_")]]
RETIRED = {f"web_flag_{2010 + i // 48}_{i % 48:02d}": "string" for i in range(533 - len(LIVE))}


def _wide_sql() -> str:
    columns = [f"{s} AS {d}" for s, d in KEYS.items()]
    for name, text in DERIVED.items():
        target = LIVE[name]
        columns.append(f"CAST({text} AS VARCHAR) AS {target}" if target in RECAST else f"{text} AS {target}")
    columns += [f"CAST(NULL AS VARCHAR) AS {c}" for c in RETIRED]
    return f"SELECT {', '.join(columns)} FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query("job_wide_mart", _wide_sql())
def job_wide_mart(t: Tables) -> DataFrame:
    wide = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    wide = wide.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    layout = [*LIVE.values(), *RETIRED]
    rows = dealt_for(wide.select(*KEYS), len(layout), "c_custkey")
    wide = rows.select(*KEYS, *[F.expr(text).alias(name) for name, text in DERIVED.items()])
    out = marts.wide_copy(wide, LIVE, RETIRED, layout, RECAST)
    root = scratch_path(t.spark, "wide")
    return writers.publish(out, f"{root}/staging", f"{root}/main", "client_key", plain=VARIED)


@query(
    "job_completed_contracts",
    f"""SELECT DISTINCT o_orderkey AS contract_id, o_custkey AS customer_no, CASE WHEN o_orderpriority < '3' THEN '新規' ELSE '切替' END AS kind,
          'M' || CASE WHEN o_custkey > 99999999 THEN CAST(o_custkey AS VARCHAR) ELSE lpad(CAST(o_custkey AS VARCHAR), 8, '0') END AS member_id, {OUT} AS process_datetime FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE o_orderdate >= TIMESTAMP '2001-05-01' AND o_orderstatus <> 'P' AND o_orderpriority < '5' AND c_custkey % 9 <> 0""",
)
def job_completed_contracts(t: Tables) -> DataFrame:
    rank = F.col("o_orderpriority")
    contracts = t.orders.select(
        F.col("o_orderkey").alias("contract_id"),
        F.col("o_custkey").alias("customer_no"),
        F.when(F.col("o_orderdate") >= F.lit("2001-05-01 00:00:00").cast("timestamp_ntz"), "20010630").otherwise("20010629").alias("registered_ymd"),
        F.when(F.col("o_orderstatus") == "P", "受付").otherwise("完了").alias("state"),
        F.when(rank < "3", "新規").when(rank < "5", "切替").otherwise("解約").alias("kind"),
    )
    members = roles.members(t).withColumn("state", F.when(F.col("left_flag") == 0, "有効").otherwise("退会"))
    return lists.completed_contracts({"contracts": contracts, "members": members}, AS_OF)


@query(
    "job_repair_details",
    f"""SELECT CAST(l_orderkey AS VARCHAR) AS meter_no, strftime(l_shipdate, '%Y%m%d') AS requested_ymd,
          CASE WHEN l_returnflag = 'N' THEN 'ガス機器' ELSE '水まわり' END AS repair_kind, l_extendedprice AS amount, {OUT} AS process_datetime FROM lineitem
        WHERE strftime(l_shipdate, '%Y%m%d') = '20010610' AND l_returnflag <> 'A'""",
)
def job_repair_details(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    rows = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("meter_no"),
        F.date_format("l_shipdate", "yyyyMMdd").alias("requested_ymd"),
        F.when(flag == "N", "ガス機器").when(flag == "R", "水まわり").otherwise("その他").alias("repair_kind"),
        F.when(F.col("l_linestatus") == "O", "対応中").otherwise("完了").alias("state"),
        F.col("l_extendedprice").alias("amount"),
    )
    return lists.repair_details({"repairs": rows}, AS_OF)
