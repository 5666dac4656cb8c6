"""Data-quality, lineage and audit queries on the test tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shirabe.catalog import roles
from shirabe.catalog.events import rounded
from shirabe.catalog.registry import Tables, query
from shirabe.catalog.scans import SNAPSHOTS, _snapshots
from shirabe.operators import join
from shirabe.operators.aggregate import count_rows, duplicates
from shirabe.plans import quality
from shirabe.plans.quality import Rule
from shirabe.session import scratch_path
from shirabe.sources import writers

AS_OF = roles.ORDERS_AS_OF

MAIL_SHAPE = r"^[^@]+@[^@]+\.[^@]+$"

RULES = [
    Rule("key_completeness", "member_id IS NOT NULL", 99.5, "Critical"),
    Rule("id_length", "length(member_id) = 9", 95.0, "High"),
    Rule("mail_format", "mail LIKE '%@%.%'", 98.0, "Medium"),
    Rule("balance_range", "balance BETWEEN 0 AND 9000", 90.0, "Low"),
]

_RULE_SQL = " UNION ALL ".join(
    f"""SELECT '{r.name}' AS rule_name, count(*) AS total_records, count(CASE WHEN {r.condition} THEN 1 END) AS valid_records,
  count(*) - count(CASE WHEN {r.condition} THEN 1 END) AS invalid_records,
  round(count(CASE WHEN {r.condition} THEN 1 END) * 100.0::DOUBLE / count(*), 4) AS quality_score,
  count(CASE WHEN {r.condition} THEN 1 END) * 100.0::DOUBLE / count(*) >= {r.threshold} AS threshold_met, '{r.severity}' AS severity, false AS failed FROM members"""
    for r in RULES
)
# A rule on a column the table does not have: it is reported, the others are scored.
BROKEN = Rule("broken", "no_such_column > 1", 50.0, "Low")
_RULE_SQL += " UNION ALL SELECT 'broken', count(*), 0, count(*), 0.0, false, 'Low', true FROM members"


@query("dq_rules", f"WITH {roles.MEMBERS} {_RULE_SQL}")
def dq_rules(t: Tables) -> DataFrame:
    report = quality.run_rules(roles.members(t), [*RULES, BROKEN])
    return rounded(report.withColumn("failed", F.col("error_message").isNotNull()).drop("error_message"), 4, "quality_score")


@query(
    "dq_label_rules",
    """WITH d AS (SELECT text, lang, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
       SELECT 'labelled' AS rule_name, count(*) AS total_records, count(quality) AS valid_records, count(*) - count(quality) AS invalid_records FROM d
       UNION ALL SELECT 'clean', count(*), count(CASE WHEN toxic = 0 AND quality = 1 THEN 1 END), count(*) - count(CASE WHEN toxic = 0 AND quality = 1 THEN 1 END) FROM d
       UNION ALL SELECT 'length_matches', count(*), count(CASE WHEN n_chars = length(text) THEN 1 END), count(*) - count(CASE WHEN n_chars = length(text) THEN 1 END) FROM d""",
)
def dq_label_rules(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left")
    rules = [
        Rule("labelled", "quality IS NOT NULL", 50.0, "Low"),
        Rule("clean", "toxic = 0 AND quality = 1", 50.0, "High"),
        Rule("length_matches", "n_chars = length(text)", 100.0, "Medium"),
    ]
    return quality.run_rules(rows, rules).select("rule_name", "total_records", "valid_records", "invalid_records")


def _profile_sql(column: str, kind: str) -> str:
    text = f"min({column}), max({column}), round(avg(length({column})), 4)"
    dominant = f"(SELECT count(*) FROM (SELECT {column} FROM p WHERE {column} IS NOT NULL GROUP BY 1 HAVING count(*) > (SELECT count(*) FROM p) * 0.5))"
    if kind == "mail":
        rest = f"{text}, round(count(CASE WHEN regexp_matches({column}, '{MAIL_SHAPE}') THEN 1 END) * 100.0::DOUBLE / count({column}), 4), {dominant}"
    elif kind == "text":
        rest = f"{text}, 100.0::DOUBLE, {dominant}"
    elif kind == "date":
        bad = f"count(CASE WHEN {column} > TIMESTAMP '2001-06-30 16:30:00' OR {column} < TIMESTAMP '1991-06-30 16:30:00' THEN 1 END)"
        shown = "'%Y-%m-%d %H:%M:%S'"
        rest = (
            f"strftime(min({column}), {shown}), strftime(max({column}), {shown}), 0.0::DOUBLE, "
            f"round((count({column}) - {bad}) * 100.0::DOUBLE / count({column}), 4), {bad}"
        )
    else:
        rest = "CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 0.0::DOUBLE, 100.0::DOUBLE, CAST(0 AS BIGINT)"
    return f"SELECT '{column}', count(*), count(*) - count({column}), count(DISTINCT {column}), {rest} FROM p"


PROFILED = {"segment": "text", "mail": "mail", "balance": "number", "opened": "date"}


@query(
    "dq_profile",
    f"""WITH {roles.MEMBERS}, p AS (SELECT segment, mail, balance, o_orderdate AS opened FROM members LEFT JOIN orders
          ON customer_no = o_custkey)
        SELECT * FROM ({' UNION ALL '.join(_profile_sql(c, k) for c, k in PROFILED.items())})
        x(column_name, total_records, null_count, distinct_count, min_value, max_value, avg_length, pattern_compliance, anomaly_count)""",
)
def dq_profile(t: Tables) -> DataFrame:
    orders = t.orders.select(F.col("o_custkey").alias("customer_no"), F.col("o_orderdate").alias("opened"))
    rows = roles.members(t).join(orders, "customer_no", "left").select(*PROFILED)
    return rounded(quality.profile(rows, AS_OF, {"mail": MAIL_SHAPE}), 4, "avg_length", "pattern_compliance")


@query(
    "dq_dominant_values",
    """SELECT 'segment' AS column_name, count(*) AS dominant_values FROM (SELECT c_mktsegment FROM customer GROUP BY 1 HAVING count(*) > (SELECT count(*) FROM customer) * 0.5)
       UNION ALL SELECT 'overdrawn', count(*) FROM (SELECT c_acctbal < 0 FROM customer GROUP BY 1 HAVING count(*) > (SELECT count(*) FROM customer) * 0.5)""",
)
def dq_dominant_values(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") < 0).alias("overdrawn"))
    return quality.dominant_values(rows, ["segment", "overdrawn"])


@query(
    "dq_trace",
    """WITH f AS (SELECT count(*) AS n FROM lineitem WHERE l_linestatus = 'O'), d AS (SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber
         FROM lineitem WHERE l_linestatus = 'O'))
       SELECT 1::BIGINT AS step_order, 'filter' AS step_name, (SELECT count(*) FROM lineitem) AS before_count, f.n AS after_count,
         round(f.n * 100.0::DOUBLE / (SELECT count(*) FROM lineitem), 4) AS retention_rate FROM f
       UNION ALL SELECT 2, 'deduplicate', f.n, d.n, round(d.n * 100.0::DOUBLE / f.n, 4) FROM f, d""",
)
def dq_trace(t: Tables) -> DataFrame:
    raw = t.lineitem.select("l_orderkey", "l_linenumber", "l_linestatus")
    kept = raw.filter("l_linestatus = 'O'").select("l_orderkey", "l_linenumber")
    return rounded(quality.trace([("filter", raw, kept), ("deduplicate", kept, kept.distinct())]), 4, "retention_rate")


@query(
    "dq_row_checks",
    """SELECT o_orderkey, CASE WHEN NULLIF(o_orderstatus, 'P') IS NULL OR NULLIF(o_orderkey, 5) IS NULL THEN 0 ELSE 1 END AS is_complete,
         CASE WHEN o_totalprice BETWEEN 1000 AND 400000 THEN 1 ELSE 0 END AS amount_valid,
         CASE WHEN regexp_matches(period, '^.{4}Q[1-4]$') OR regexp_matches(period, '^.{4}-..$') THEN 1 ELSE 0 END AS period_valid,
         CASE WHEN regexp_matches(o_orderpriority || CASE WHEN o_orderkey % 9 = 0 THEN '<&>' ELSE '' END, '[<>&"'']') THEN 1 ELSE 0 END AS has_special_chars
       FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') || 'Q' || CAST(o_orderkey % 6 AS VARCHAR)
         WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y%m') END AS period FROM orders)""",
)
def dq_row_checks(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    quarter = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("Q"), (key % 6).cast("string"))
    period = (
        F.when(key % 3 == 0, quarter)
        .when(key % 3 == 1, F.date_format("o_orderdate", "yyyy-MM"))
        .otherwise(F.date_format("o_orderdate", "yyyyMM"))
    )
    rows = t.orders.select(
        "o_orderkey",
        F.nullif(key, F.lit(5)).alias("connection"),
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        "o_totalprice",
        period.alias("period"),
        F.concat("o_orderpriority", F.when(key % 9 == 0, "<&>").otherwise("")).alias("reason"),
    )
    checks = {
        "amount_valid": F.col("o_totalprice").between(1000, 400000),
        "period_valid": F.col("period").rlike("^.{4}Q[1-4]$") | F.col("period").rlike("^.{4}-..$"),
        "has_special_chars": F.col("reason").rlike("[<>&\"']"),
    }
    return quality.row_checks(rows, ["connection", "status"], checks).select("o_orderkey", "is_complete", *checks)


@query(
    "dq_duplicates",
    """SELECT l_orderkey, l_linenumber, count(*) AS duplicate_count, min(l_extendedprice) AS first_id, max(l_extendedprice) AS last_id
       FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def dq_duplicates(t: Tables) -> DataFrame:
    return duplicates(t.lineitem, ["l_orderkey", "l_linenumber"], "l_extendedprice")


@query(
    "dq_integrity_summary",
    f"""WITH {roles.CLIENTS}, {roles.MESSAGES}
        SELECT 'clients' AS table_name, 'null_segments' AS check_name, count(*) AS total_records, count(CASE WHEN segment IS NULL THEN 1 END) AS bad_records FROM clients
        UNION ALL SELECT 'clients', 'negative_amounts', count(*), count(CASE WHEN total_amount < 0 THEN 1 END) FROM clients
        UNION ALL SELECT 'clients', 'invalid_scores', count(*), count(CASE WHEN score < 0 OR score > 900 THEN 1 END) FROM clients
        UNION ALL SELECT 'messages', 'negative_points', count(*), count(CASE WHEN points < 0 THEN 1 END) FROM messages
        UNION ALL SELECT 'messages', 'invalid_statuses', count(*), count(CASE WHEN status NOT IN ('DELIVERED', 'BOUNCED', 'FAILED') THEN 1 END) FROM messages""",
)
def dq_integrity_summary(t: Tables) -> DataFrame:
    return quality.integrity_summary(
        {
            "clients": (
                roles.clients(t),
                {
                    "null_segments": F.col("segment").isNull(),
                    "negative_amounts": F.col("total_amount") < 0,
                    "invalid_scores": (F.col("score") < 0) | (F.col("score") > 900),
                },
            ),
            "messages": (
                roles.messages(t),
                {
                    "negative_points": F.col("points") < 0,
                    "invalid_statuses": ~F.col("status").isin("DELIVERED", "BOUNCED", "FAILED"),
                },
            ),
        }
    )


@query(
    "dq_type_check",
    """WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END AS code,
         CASE WHEN c_custkey % 3 = 0 THEN '2023-02-29' ELSE '2024-02-29' END AS day FROM customer)
       SELECT c_custkey, CASE WHEN code IS NULL OR try_cast(code AS INTEGER) IS NOT NULL THEN 'OK' ELSE 'ERROR' END AS code_format,
         CASE WHEN try_cast(day AS DATE) IS NOT NULL THEN 'OK' ELSE 'ERROR' END AS day_format FROM d""",
)
def dq_type_check(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    rows = t.customer.select(
        "c_custkey",
        F.when(key % 4 == 0, None).when(key % 4 == 1, F.col("c_name")).otherwise(key.cast("string")).alias("code"),
        F.when(key % 3 == 0, "2023-02-29").otherwise("2024-02-29").alias("day"),
    )
    return quality.type_check(rows, ["c_custkey"], {"code": "int", "day": "date"})


@query(
    "dq_rule_flags",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice < 50000 THEN 'WARNING: small finished order' ELSE 'OK' END AS size_check,
         CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 'WARNING: urgent order pending' ELSE 'OK' END AS urgency_check,
         CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'Invalid priority code' ELSE 'OK' END AS code_check FROM orders""",
)
def dq_rule_flags(t: Tables) -> DataFrame:
    status, price, rank = F.col("o_orderstatus"), F.col("o_totalprice"), F.col("o_orderpriority")
    rules = {
        "size_check": ((status == "F") & (price < 50000), "WARNING: small finished order"),
        "urgency_check": ((rank == "1-URGENT") & (status == "P"), "WARNING: urgent order pending"),
        "code_check": (~rank.isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "Invalid priority code"),
    }
    return quality.rule_flags(t.orders, ["o_orderkey"], rules)


@query(
    "dq_orphans",
    "SELECT count(*) AS mismatch_count FROM lineitem LEFT JOIN orders ON l_partkey = o_orderkey AND o_orderstatus = 'F' WHERE o_orderkey IS NULL",
)
def dq_orphans(t: Tables) -> DataFrame:
    finished = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_partkey"))
    return quality.orphans(t.lineitem.select("l_partkey"), finished, ["l_partkey"])


@query(
    "dq_contract",
    """SELECT c AS column_name, present, type_match, allowed, CASE WHEN c = 'segment' THEN (SELECT count(*) FROM customer WHERE c_custkey % 17 = 0) ELSE 0 END AS null_keys,
         (SELECT count(*) FROM customer) AS total_records, 5::BIGINT AS column_count
       FROM (VALUES ('client_id', true, true, true), ('segment', true, true, true), ('score', true, false, true), ('ssn', false, false, false))
         v(c, present, type_match, allowed)""",
)
def dq_contract(t: Tables) -> DataFrame:
    expected = {"client_id": "bigint", "segment": "string", "score": "int", "ssn": "string"}
    return quality.check_contract(roles.clients(t), expected, ["client_id", "segment"], ["ssn"])


@query(
    "dq_reconcile",
    f"""WITH {SNAPSHOTS} SELECT coalesce(p.o_orderkey, c.o_orderkey) AS o_orderkey, CASE WHEN p.o_orderkey IS NOT NULL THEN 1 END AS a_rows,
        CASE WHEN c.o_orderkey IS NOT NULL THEN 1 END AS b_rows, CASE WHEN c.o_orderkey IS NULL THEN 'MISSING_IN_B'
          WHEN p.o_orderkey IS NULL THEN 'MISSING_IN_A' ELSE 'OK' END AS consistency_status FROM prev p FULL JOIN cur c ON p.o_orderkey = c.o_orderkey""",
)
def dq_reconcile(t: Tables) -> DataFrame:
    prev, cur = _snapshots(t)
    return join.reconcile(prev, cur, "o_orderkey")


@query(
    "dq_stage_counts",
    f"""WITH {SNAPSHOTS} SELECT 'TEMP_TABLE' AS stage, count(*) AS record_count, count(DISTINCT o_custkey) AS unique_keys FROM prev
        UNION ALL SELECT 'MAIN_TABLE', count(*), count(DISTINCT o_custkey) FROM cur""",
)
def dq_stage_counts(t: Tables) -> DataFrame:
    prev, cur = _snapshots(t)
    return quality.stage_counts({"TEMP_TABLE": prev, "MAIN_TABLE": cur}, "o_custkey")


@query(
    "dq_assert_run",
    """SELECT 'load_orders' AS name, count(*) AS expected_input, count(*) AS actual_input, count(*) AS expected_output, count(*) AS actual_output,
         'PASS' AS validation_result FROM orders UNION ALL
       SELECT 'load_customers', 0, count(*), 0, count(*), 'FAIL' FROM customer""",
)
def dq_assert_run(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "runs")
    n, m = [df.agg(count_rows("n")).first()["n"] for df in (t.orders, t.customer)]
    at = AS_OF - timedelta(minutes=20)
    writers.log_run(t.spark, folder, "r0", "load_orders", "Succeeded", at - timedelta(minutes=5), 1, 1)
    writers.log_run(t.spark, folder, "r1", "load_orders", "Succeeded", at, n, n)
    log = writers.log_run(t.spark, folder, "r2", "load_customers", "Succeeded", at, m, m)
    return quality.assert_run(log, "load_orders", n, n, AS_OF).unionAll(quality.assert_run(log, "load_customers", 0, 0, AS_OF))


@query(
    "dq_assert_min",
    """SELECT 'orders' AS table_name, count(*) AS actual_count, 100::BIGINT AS expected_count, count(*) >= 100 AS validation_passed FROM orders
       UNION ALL SELECT 'region', count(*), 100, count(*) >= 100 FROM region""",
)
def dq_assert_min(t: Tables) -> DataFrame:
    return quality.assert_min(t.orders, "orders", 100).unionAll(quality.assert_min(t.region, "region", 100))


VALID = "json_valid(data_json) AND left(ltrim(data_json), 1) IN ('{', '[')"
KEY_PATHS = {"customer": "$.id", "order": "$.order_id", "product": "$.product_id"}


@query(
    "dq_json_quality",
    f"""WITH {roles.DOCUMENTS_JSON} SELECT source_type, count(*) AS total_records, count(CASE WHEN {VALID} THEN 1 END) AS valid_records,
        count(CASE WHEN json_valid(data_json) AND json_extract_string(data_json, CASE source_type WHEN 'customer' THEN '$.id' WHEN 'order' THEN '$.order_id'
          ELSE '$.product_id' END) IS NOT NULL THEN 1 END) AS records_with_id, count(CASE WHEN length(data_json) > 0 THEN 1 END) AS non_empty_records,
        round(avg(length(data_json)), 4) AS avg_data_size, round(count(CASE WHEN {VALID} THEN 1 END) * 100.0::DOUBLE / count(*), 4) AS quality_percentage
        FROM raw GROUP BY 1""",
)
def dq_json_quality(t: Tables) -> DataFrame:
    out = quality.json_quality(roles.documents_json(t), "source_type", "data_json", KEY_PATHS)
    return rounded(out, 4, "avg_data_size", "quality_percentage")


@query(
    "dq_stage_summary",
    f"""WITH {roles.DOCUMENTS_JSON}, c AS (SELECT source_type, count(*) AS n, count(CASE WHEN {VALID} THEN 1 END) AS ok FROM raw GROUP BY 1)
        SELECT source_type, 'EXTRACTION' AS stage, 1 AS stage_order, n AS record_count, 'SUCCESS' AS status FROM c
        UNION ALL SELECT source_type, 'TRANSFORMATION', 2, ok, CASE WHEN ok = n THEN 'SUCCESS' ELSE 'PARTIAL_SUCCESS' END FROM c
        UNION ALL SELECT source_type, 'LOADING', 3, ok, 'SUCCESS' FROM c""",
)
def dq_stage_summary(t: Tables) -> DataFrame:
    return quality.stage_summary(roles.documents_json(t), "source_type", "data_json")


@query(
    "dq_protection_status",
    """WITH m AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'a***@example.com' WHEN 1 THEN 'ENC_' || sha256(c_name) ELSE lower(c_name) || '@example.com' END AS mail FROM customer)
       SELECT c_custkey, length(mail) AS mail_length, CASE WHEN mail LIKE '%***%' THEN 'MASKED' WHEN mail LIKE 'ENC#_%' ESCAPE '#' THEN 'ENCRYPTED' ELSE 'PLAIN' END AS status FROM m""",
)
def dq_protection_status(t: Tables) -> DataFrame:
    key, name = F.col("c_custkey"), F.col("c_name")
    mail = (
        F.when(key % 3 == 0, "a***@example.com")
        .when(key % 3 == 1, F.concat(F.lit("ENC_"), F.sha2(name, 256)))
        .otherwise(F.concat(F.lower(name), F.lit("@example.com")))
    )
    return t.customer.select("c_custkey", F.length(mail).cast("long").alias("mail_length"), quality.protection_status(mail).alias("status"))


def _scan_sql(column: str, name: str, pattern: str) -> str:
    hits = f"len(regexp_extract_all({column}, '{pattern}'))"
    return (
        f"SELECT '{column}:{name}' AS scan, count(*) AS total_records, count(CASE WHEN {hits} > 0 THEN 1 END) AS rows_with_hits, "
        f"CAST(coalesce(sum({hits}), 0) AS BIGINT) AS hits FROM d"
    )


@query(
    "dq_pii_scan",
    """WITH d AS (SELECT text, text || CASE doc_id % 4 WHEN 0 THEN ' 4111-1111-1111-1111 ' WHEN 1 THEN ' 123-45-6789 ' WHEN 2 THEN ' 090-1234-5678 '
         ELSE ' a.b@example.co.jp x@y.org' END AS seeded FROM documents) """
    + " UNION ALL ".join(_scan_sql(c, n, p) for c in ("text", "seeded") for n, p in quality.LEAKS.items()),
)
def dq_pii_scan(t: Tables) -> DataFrame:
    seed = F.col("doc_id") % 4
    leak = (
        F.when(seed == 0, " 4111-1111-1111-1111 ")
        .when(seed == 1, " 123-45-6789 ")
        .when(seed == 2, " 090-1234-5678 ")
        .otherwise(" a.b@example.co.jp x@y.org")
    )
    return quality.scan_pii(t.documents.select("text", F.concat("text", leak).alias("seeded")), ["text", "seeded"])


@query(
    "dq_pii_conversations",
    "WITH d AS (SELECT text FROM conversations) " + " UNION ALL ".join(_scan_sql("text", n, p) for n, p in quality.LEAKS.items()),
)
def dq_pii_conversations(t: Tables) -> DataFrame:
    return quality.scan_pii(t.conversations, ["text"])


@query(
    "dq_retention_report",
    """SELECT 'orders' AS table_name, count(*) AS total_records, count(CASE WHEN o_orderdate < TIMESTAMP '1999-06-30 16:30:00' THEN 1 END) AS old_records_2y,
         count(CASE WHEN o_orderdate < TIMESTAMP '1996-06-30 16:30:00' THEN 1 END) AS old_records_5y FROM orders
       UNION ALL SELECT 'lineitem', count(*), count(CASE WHEN l_shipdate < TIMESTAMP '1999-06-30 16:30:00' THEN 1 END),
         count(CASE WHEN l_shipdate < TIMESTAMP '1996-06-30 16:30:00' THEN 1 END) FROM lineitem""",
)
def dq_retention_report(t: Tables) -> DataFrame:
    return quality.retention_report({"orders": (t.orders, "o_orderdate"), "lineitem": (t.lineitem, "l_shipdate")}, AS_OF)


@query(
    "dq_lineage_summary",
    """SELECT 'orders' AS target_table, o_orderstatus AS data_source, count(*) AS record_count, min(o_orderdate) AS earliest_processed,
         max(o_orderdate) AS latest_processed FROM orders GROUP BY 2
       UNION ALL SELECT 'events', 'EVENT_SYSTEM', count(*), min(ts), max(ts) FROM events""",
)
def dq_lineage_summary(t: Tables) -> DataFrame:
    return quality.lineage_summary(
        {"orders": (t.orders, F.col("o_orderstatus"), "o_orderdate"), "events": (t.events, F.lit("EVENT_SYSTEM"), "ts")}
    )


@query(
    "dq_access_audit",
    """SELECT user_id, count(*) AS access_attempts, count(CASE WHEN event_type <> 'error' THEN 1 END) AS successful_access,
         count(DISTINCT props) AS unique_resources FROM events WHERE ts >= TIMESTAMP '2024-01-29 12:00:00' GROUP BY 1""",
)
def dq_access_audit(t: Tables) -> DataFrame:
    granted = F.col("event_type") != "error"
    return quality.access_audit(t.events, "user_id", "ts", granted, "props", roles.EVENTS_AS_OF)


@query(
    "dq_score_trend",
    """SELECT event_type AS rule_name, round(avg(value), 4) AS avg_quality_score, count(*) AS total_executions,
         count(CASE WHEN value >= 10 THEN 1 END) AS passed_count FROM events WHERE ts >= TIMESTAMP '2024-01-23 12:00:00' GROUP BY 1""",
)
def dq_score_trend(t: Tables) -> DataFrame:
    results = t.events.select(F.col("event_type").alias("rule_name"), "value", "ts")
    return rounded(quality.score_trend(results, "rule_name", "value", F.col("value") >= 10, "ts", roles.EVENTS_AS_OF), 4, "avg_quality_score")


@query(
    "dq_ops_summary",
    """SELECT o_orderpriority AS stage, count(*) AS total_tasks, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS completed,
         count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS running, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS pending,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice) AS avg_cost, max(o_totalprice) AS max_cost, max(o_orderdate) AS last_occurrence FROM orders GROUP BY 1""",
)
def dq_ops_summary(t: Tables) -> DataFrame:
    states = {"F": "completed", "O": "running", "P": "pending"}
    out = quality.ops_summary(t.orders, "o_orderpriority", "o_orderstatus", states, "o_totalprice", "o_orderdate")
    return out.withColumnRenamed("o_orderpriority", "stage")


@query(
    "dq_error_log",
    """SELECT event_type, user_id % 3 AS severity, count(*) AS error_count, max(ts) AS last_occurrence FROM events GROUP BY 1, 2""",
)
def dq_error_log(t: Tables) -> DataFrame:
    log = t.events.withColumn("severity", F.col("user_id") % 3)
    return quality.error_summary(log, ["event_type", "severity"], "ts")


@query(
    "dq_reconcile_counts",
    f"""WITH {SNAPSHOTS}, n AS (SELECT (SELECT count(*) FROM prev) AS source_count, (SELECT count(*) FROM cur) AS target_count)
        SELECT source_count, target_count, round(abs(source_count - target_count)::DOUBLE / source_count, 6) AS diff_ratio,
          abs(source_count - target_count)::DOUBLE / source_count <= 0.05 AS within_tolerance, target_count > 0 AS no_data_loss FROM n""",
)
def dq_reconcile_counts(t: Tables) -> DataFrame:
    prev, cur = _snapshots(t)
    return rounded(quality.reconcile_counts(prev, cur, 0.05), 6, "diff_ratio")


@query(
    "dq_visible_to",
    """WITH d AS (SELECT o_orderkey, o_custkey, CAST(left(o_orderpriority, 1) AS INTEGER) AS rank FROM orders),
       u AS (SELECT c_custkey AS user_id, CAST(c_custkey % 6 AS INTEGER) AS clearance FROM customer),
       p AS (SELECT o_custkey AS user_id, o_orderkey, rank FROM d UNION SELECT l_suppkey, o_orderkey, rank FROM d JOIN lineitem ON l_orderkey = o_orderkey)
       SELECT p.user_id, o_orderkey, rank, clearance FROM p JOIN u ON u.user_id = p.user_id WHERE clearance >= rank""",
)
def dq_visible_to(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", F.left("o_orderpriority", F.lit(1)).cast("int").alias("rank"))
    users = t.customer.select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 6).cast("int").alias("clearance"))
    grants = t.lineitem.select(F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("o_orderkey"))
    return quality.visible_to(rows, users, grants, "o_orderkey", "o_custkey", "rank")


@query(
    "dq_sensitive_summary",
    f"""WITH {roles.MEMBERS} SELECT 'email_addresses' AS data_type, count(*) AS total_count, count(CASE WHEN mail LIKE '%@example.com' THEN 1 END) AS first_pattern,
        count(CASE WHEN mail LIKE '%@%' AND mail NOT LIKE '%***%' THEN 1 END) AS second_pattern FROM members WHERE mail IS NOT NULL
        UNION ALL SELECT 'client_identifiers', count(*), count(CASE WHEN length(member_id) >= 9 THEN 1 END),
        count(CASE WHEN regexp_matches(member_id, '[0-9]{{5}}') THEN 1 END) FROM members""",
)
def dq_sensitive_summary(t: Tables) -> DataFrame:
    members = roles.members(t)
    mail, ident = F.col("mail"), F.col("member_id")
    return quality.pattern_counts(
        {
            "email_addresses": (members, "mail", mail.endswith("@example.com"), mail.contains("@") & ~mail.contains("***")),
            "client_identifiers": (members, "member_id", F.length(ident) >= 9, ident.rlike("[0-9]{5}")),
        }
    )
