"""Roles the test tables play: usage services, gas contracts, members, messages.

Each role has a DataFrame builder and the same view as SQL text (a CTE body).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shirabe.catalog.registry import Tables
from shirabe.functions import text

# Run times (UTC) at which the registered queries are evaluated.
ORDERS_AS_OF = datetime(2001, 6, 30, 16, 30)  # already 1 July in Tokyo
EVENTS_AS_OF = datetime(2024, 1, 30, 12, 0)
DOCS_AS_OF = datetime(2024, 1, 31, 0, 0)

KEY_TYPES = ["key_type1", "key_type2", "key_type3"]
KEYS = ["service_key1", "service_key2", "service_key3"]


def _code(slot: int) -> Column:
    n = (F.col("l_linenumber") + slot) % 3
    return F.when(n == 0, "001").when(n == 1, "004").otherwise("007").alias(f"key_type{slot}")


def usage(t: Tables) -> DataFrame:
    """Usage services with three key slots."""
    supp = F.col("l_suppkey")
    return t.lineitem.select(
        supp.cast("string").alias("bx"),
        F.col("l_orderkey").alias("index_id"),
        F.when(F.col("l_orderkey") % 5 == 4, "004").otherwise("003").alias("user_key_type"),
        F.col("l_orderkey").cast("string").alias("user_key"),
        F.when(F.col("l_returnflag") == "N", "001").when(F.col("l_returnflag") == "R", "006").otherwise("010").alias("service_type"),
        F.when(F.col("l_linestatus") == "O", "02").otherwise("03").alias("transfer_type"),
        F.date_format("l_shipdate", "yyyyMMdd").alias("transfer_ymd"),
        *[_code(s) for s in (1, 2, 3)],
        F.col("l_orderkey").cast("string").alias("service_key1"),
        F.col("l_partkey").cast("string").alias("service_key2"),
        F.when(supp % 10 == 0, None).otherwise(supp.cast("string")).alias("service_key3"),
        F.col("l_shipdate").alias("output_date"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("amount"),
    )


def _code_sql(slot: int) -> str:
    return (
        f"CASE (l_linenumber + {slot}) % 3 WHEN 0 THEN '001' WHEN 1 THEN '004' ELSE '007' END AS key_type{slot}"
    )


USAGE = f"""usage AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS bx, l_orderkey AS index_id,
         CASE WHEN l_orderkey % 5 = 4 THEN '004' ELSE '003' END AS user_key_type,
         CAST(l_orderkey AS VARCHAR) AS user_key,
         CASE l_returnflag WHEN 'N' THEN '001' WHEN 'R' THEN '006' ELSE '010' END AS service_type,
         CASE l_linestatus WHEN 'O' THEN '02' ELSE '03' END AS transfer_type,
         strftime(l_shipdate, '%Y%m%d') AS transfer_ymd,
         {_code_sql(1)}, {_code_sql(2)}, {_code_sql(3)},
         CAST(l_orderkey AS VARCHAR) AS service_key1, CAST(l_partkey AS VARCHAR) AS service_key2,
         CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE CAST(l_suppkey AS VARCHAR) END AS service_key3,
         l_shipdate AS output_date, l_linenumber AS line_no, l_quantity AS quantity, l_extendedprice AS amount
  FROM lineitem)"""


def gas(t: Tables) -> DataFrame:
    """Gas contracts under contract; numeric registration numbers."""
    grade = F.left("o_orderpriority", F.lit(1))
    return t.orders.select(
        F.col("o_orderkey").alias("user_reg_no"),
        F.col("o_custkey").alias("pay_contract_no"),
        F.when(F.col("o_orderstatus") == "F", "00").otherwise("01").alias("contract_state"),
        grade.alias("pay_method"),
        F.concat(F.lit("1"), (F.col("o_orderkey") % 7).cast("string")).alias("service_class"),
        F.col("o_orderdate").alias("opened"),
        F.when(F.col("o_orderkey") % 11 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise("0").alias("closed_ymd"),
        F.col("o_totalprice").alias("billed"),
    )


GAS = """gas AS (
  SELECT o_orderkey AS user_reg_no, o_custkey AS pay_contract_no,
         CASE WHEN o_orderstatus = 'F' THEN '00' ELSE '01' END AS contract_state,
         left(o_orderpriority, 1) AS pay_method, '1' || CAST(o_orderkey % 7 AS VARCHAR) AS service_class,
         o_orderdate AS opened,
         CASE WHEN o_orderkey % 11 = 0 THEN strftime(o_orderdate, '%Y%m%d') ELSE '0' END AS closed_ymd,
         o_totalprice AS billed
  FROM orders)"""


def members(t: Tables) -> DataFrame:
    """Web members: id, contract customer, whether they left, mail address."""
    key = F.col("c_custkey")
    return t.customer.select(
        F.concat(F.lit("M"), text.numbered(key, 8)).alias("member_id"),
        key.alias("customer_no"),
        F.when(key % 9 == 0, 1).otherwise(0).alias("left_flag"),
        F.when(key % 4 == 0, 0).otherwise(1).alias("reg_complete"),
        F.when(key % 13 == 0, None).otherwise(F.concat(F.lower("c_mktsegment"), key.cast("string"), F.lit("@example.com"))).alias("mail"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").alias("nation_no"),
    )


MEMBERS = """members AS (
  SELECT 'M' || CASE WHEN c_custkey > 99999999 THEN CAST(c_custkey AS VARCHAR) ELSE lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS member_id, c_custkey AS customer_no,
         CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 0 END AS left_flag,
         CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1 END AS reg_complete,
         CASE WHEN c_custkey % 13 = 0 THEN NULL
              ELSE lower(c_mktsegment) || CAST(c_custkey AS VARCHAR) || '@example.com' END AS mail,
         c_mktsegment AS segment, c_acctbal AS balance, c_nationkey AS nation_no
  FROM customer)"""


def messages(t: Tables) -> DataFrame:
    """Mail log: one row per event, its type standing for the delivery status."""
    kind = F.col("event_type")
    status = (
        F.when(kind.isin("click", "view", "purchase"), "DELIVERED").when(kind == "error", "BOUNCED").otherwise("SENT")
    )
    return t.events.select(
        F.col("event_id").alias("message_id"),
        F.col("user_id").alias("client_id"),
        F.concat(F.lit("CAMPAIGN_"), (F.col("user_id") % 5).cast("string")).alias("campaign_id"),
        status.alias("status"),
        F.round("value").cast("long").alias("points"),
        F.col("ts").alias("sent_at"),
    )


MESSAGES = """messages AS (
  SELECT event_id AS message_id, user_id AS client_id, 'CAMPAIGN_' || CAST(user_id % 5 AS VARCHAR) AS campaign_id,
         CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'DELIVERED'
              WHEN event_type = 'error' THEN 'BOUNCED' ELSE 'SENT' END AS status,
         CAST(round(value) AS BIGINT) AS points, ts AS sent_at
  FROM events)"""


def clients(t: Tables) -> DataFrame:
    """Customer mart: segment, value, last transaction."""
    last = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_transaction"))
    joined = t.customer.join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    key = F.col("c_custkey")
    return joined.select(
        key.alias("client_id"),
        F.when(key % 17 == 0, None).otherwise(F.col("c_mktsegment")).alias("segment"),
        (F.col("c_acctbal") * 20).cast("decimal(18,2)").cast("double").alias("total_amount"),
        "last_transaction",
        ((key % 1000)).alias("score"),
    )


CLIENTS = """clients AS (
  SELECT c_custkey AS client_id, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_mktsegment END AS segment,
         CAST(CAST(c_acctbal * 20 AS DECIMAL(18,2)) AS DOUBLE) AS total_amount, last_transaction,
         c_custkey % 1000 AS score
  FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_transaction FROM orders GROUP BY 1) l
    ON c_custkey = o_custkey)"""


def engagement(t: Tables) -> DataFrame:
    """Marketing mart: engagement score, segments, preferences and last response."""
    key = F.col("c_custkey")
    n = key % 97
    return t.customer.filter("c_acctbal > -500").select(
        key.alias("client_id"),
        F.when(key % 19 == 0, None).otherwise((n / 9.7).cast("decimal(5,2)").cast("double")).alias("engagement_score"),
        F.when(n >= 65, "HIGH_VALUE").when(n >= 30, "MEDIUM_VALUE").otherwise("LOW_VALUE").alias("marketing_segment"),
        F.when(key % 3 == 0, "FINANCE").when(key % 3 == 1, "LIFESTYLE").otherwise("PREMIUM_BASIC").alias("preference"),
        (F.lit("1995-06-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((key % 3000).cast("int"))).alias("last_response"),
        (key % 2).cast("int").alias("opt_in_email"),
        F.when(key % 5 < 2, 1).otherwise(0).alias("opt_in_sms"),
    )


ENGAGEMENT = """engagement AS (
  SELECT c_custkey AS client_id,
         CASE WHEN c_custkey % 19 = 0 THEN NULL
              ELSE CAST(CAST((c_custkey % 97) / 9.7::DOUBLE AS DECIMAL(5,2)) AS DOUBLE) END AS engagement_score,
         CASE WHEN c_custkey % 97 >= 65 THEN 'HIGH_VALUE' WHEN c_custkey % 97 >= 30 THEN 'MEDIUM_VALUE'
              ELSE 'LOW_VALUE' END AS marketing_segment,
         CASE c_custkey % 3 WHEN 0 THEN 'FINANCE' WHEN 1 THEN 'LIFESTYLE' ELSE 'PREMIUM_BASIC' END AS preference,
         TIMESTAMP '1995-06-01 00:00:00' + to_days(CAST(c_custkey % 3000 AS INTEGER)) AS last_response,
         CAST(c_custkey % 2 AS INTEGER) AS opt_in_email, CASE WHEN c_custkey % 5 < 2 THEN 1 ELSE 0 END AS opt_in_sms
  FROM customer WHERE c_acctbal > -500)"""


def documents_json(t: Tables) -> DataFrame:
    """Raw JSON feed of three kinds, with broken, scalar and empty documents among them."""
    key = F.col("event_id")
    kind = F.when(key % 3 == 0, "customer").when(key % 3 == 1, "order").otherwise("product")
    field = F.when(key % 3 == 0, "id").when(key % 3 == 1, "order_id").otherwise("product_id")
    good = F.concat(F.lit('{"'), field, F.lit('": '), F.col("user_id").cast("string"), F.lit(', "data": '), F.col("props"), F.lit("}"))
    text = (
        F.when(key % 41 == 0, F.lit('{"broken": '))
        .when(key % 43 == 0, F.lit("12"))
        .when(key % 47 == 0, F.lit(""))
        .when(key % 53 == 0, None)
        .when(key % 59 == 0, F.col("props"))
        .otherwise(good)
    )
    return t.events.select(key.alias("id"), kind.alias("source_type"), text.alias("data_json"), F.col("ts").alias("created_at"))


DOCUMENTS_JSON = """raw AS (
  SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'customer' WHEN 1 THEN 'order' ELSE 'product' END AS source_type,
         CASE WHEN event_id % 41 = 0 THEN '{"broken": ' WHEN event_id % 43 = 0 THEN '12' WHEN event_id % 47 = 0 THEN ''
              WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 59 = 0 THEN props
              ELSE '{"' || CASE event_id % 3 WHEN 0 THEN 'id' WHEN 1 THEN 'order_id' ELSE 'product_id' END || '": '
                   || CAST(user_id AS VARCHAR) || ', "data": ' || props || '}' END AS data_json, ts AS created_at
  FROM events)"""
