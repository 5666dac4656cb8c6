"""Scan, sink and table-write queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shirabe.catalog import roles
from shirabe.catalog.registry import Tables, query
from shirabe.functions.dates import jst
from shirabe.operators import change, project
from shirabe.operators.aggregate import count_rows
from shirabe.operators.window import latest_per_key
from shirabe.session import scratch_path
from shirabe.sources import readers, writers

ORDER_COLUMNS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
ORDER_NAMES = [c.split()[0] for c in ORDER_COLUMNS.split(", ")]
SOURCE = f"SELECT {', '.join(ORDER_NAMES)} FROM orders"


def _schema(t: Tables, ddl: str):
    return t.spark.createDataFrame([], ddl).schema


@query("scan_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def scan_table(t: Tables) -> DataFrame:
    orders = readers.read_table(t.spark, "orders", t.folder)
    return orders.filter(F.col("o_orderstatus") == "O").select("o_orderkey", "o_custkey", "o_totalprice")


@query("scan_delimited_strict", SOURCE)
def scan_delimited_strict(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "tsv")
    t.orders.select(*ORDER_NAMES).write.option("sep", "\t").csv(path)
    return readers.read_delimited(
        t.spark, path, _schema(t, ORDER_COLUMNS), sep="\t", max_rejects=0, max_length={"o_orderpriority": 20}
    )


@query("scan_delimited_header", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def scan_delimited_header(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    rows.write.option("header", True).option("quoteAll", True).option("escape", "\\").csv(path)
    return readers.read_delimited(t.spark, path, header=True).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("scan_json", "SELECT event_id, user_id, event_type, value, props FROM events")
def scan_json(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "json")
    rows = t.events.select("event_id", "user_id", "event_type", "value", "props")
    rows.write.json(path)
    return readers.read_json(t.spark, path, rows.schema)


@query(
    "scan_dated",
    "SELECT event_id, user_id, value FROM events WHERE strftime(ts + INTERVAL 9 HOUR, '%Y%m%d') = '20240130'",
)
def scan_dated(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "dated")
    day = F.date_format(F.from_utc_timestamp("ts", "Asia/Tokyo"), "yyyyMMdd")
    table = writers.write_dated(t.events.select("event_id", "user_id", "value", day.alias("dt")), path)
    return readers.read_dated(table, roles.EVENTS_AS_OF).drop("dt")


@query("scan_or_empty", SOURCE)
def scan_or_empty(t: Tables) -> DataFrame:
    path, schema = scratch_path(t.spark, "arrived"), _schema(t, ORDER_COLUMNS)
    t.orders.select(*ORDER_NAMES).write.csv(path)
    present = readers.read_or_empty(t.spark, path, schema, max_rejects=0)
    absent = readers.read_or_empty(t.spark, scratch_path(t.spark, "missing"), schema)
    return present.unionByName(absent)


@query("scan_scalar", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def scan_scalar(t: Tables) -> DataFrame:
    newest = readers.scalar(t.orders.agg(F.max("o_orderdate").alias("d")), "d")
    return t.orders.filter(F.col("o_orderdate") == F.lit(newest)).select("o_orderkey", "o_totalprice")


@query(
    "scan_generate_rows",
    """SELECT 'PERF_' || CASE WHEN o_orderkey > 9999999999 THEN CAST(o_orderkey AS VARCHAR) ELSE lpad(CAST(o_orderkey AS VARCHAR), 10, '0') END AS customer_id,
              'perf_test_' || CAST(o_orderkey AS VARCHAR) || '@example.com' AS email_address,
              CASE WHEN o_orderkey % 2 = 0 THEN 'key_4x_' || CAST(o_orderkey AS VARCHAR) END AS key_4x,
              CASE WHEN o_orderkey % 3 = 0 THEN 'key_3x_' || CAST(o_orderkey AS VARCHAR) END AS key_3x,
              sha256('PERF_' || CAST(o_orderkey AS VARCHAR)) AS code FROM orders""",
)
def scan_generate_rows(t: Tables) -> DataFrame:
    return readers.generate_rows(t.orders, "o_orderkey", {"key_4x": 2, "key_3x": 3})


@query(
    "scan_values",
    """SELECT o_orderkey, label FROM orders JOIN (VALUES ('F', 'finished'), ('O', 'open')) v(code, label)
       ON o_orderstatus = code""",
)
def scan_values(t: Tables) -> DataFrame:
    codes = readers.values_df(t.spark, [("F", "finished"), ("O", "open")], "code string, label string")
    return t.orders.join(codes, F.col("o_orderstatus") == F.col("code")).select("o_orderkey", "label")


@query("sink_csv_gz", "SELECT c_custkey, c_name, NULLIF(c_mktsegment, 'BUILDING') AS seg, c_acctbal FROM customer")
def sink_csv_gz(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "gz")
    rows = t.customer.select("c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"), "c_acctbal")
    writers.write_csv_gz(rows, folder, "members_%Y%m%d", roles.ORDERS_AS_OF)
    return readers.read_delimited(t.spark, folder, rows.schema, header=True)


@query("sink_header_only", """SELECT '"c_custkey","c_name"' AS value""")
def sink_header_only(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "header")
    none = t.customer.filter(F.col("c_acctbal") > 1e9).select("c_custkey", "c_name")
    writers.write_csv_gz(none, folder, "members", files=1)
    return t.spark.read.text(folder)


@query(
    "sink_json",
    """SELECT c_custkey AS user_id, c_mktsegment AS segment, c_acctbal AS balance,
              CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS name FROM customer""",
)
def sink_json(t: Tables) -> DataFrame:
    name = F.when(F.col("c_acctbal") < 0, None).otherwise(F.col("c_name"))
    docs = project.nest(
        t.customer.withColumnRenamed("c_custkey", "user_id"),
        ["user_id"],
        {"contract": {"segment": F.col("c_mktsegment"), "name": name}, "score": {"balance": F.col("c_acctbal")}},
    )
    folder = scratch_path(t.spark, "docs")
    writers.write_json(docs, folder, "feed", keep_nulls=True)
    back = readers.read_json(t.spark, folder, docs.schema)
    return back.select("user_id", "contract.segment", "score.balance", "contract.name")


@query(
    "sink_fan_out",
    """SELECT 'a' AS sink, o_orderkey, o_totalprice FROM orders
       UNION ALL SELECT 'b', o_orderkey, o_totalprice FROM orders""",
)
def sink_fan_out(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_totalprice")
    folders = [scratch_path(t.spark, "fan") for _ in "ab"]
    writers.write_many(rows, [lambda df, f=f: df.write.parquet(f) for f in folders])
    first, second = [t.spark.read.parquet(f).withColumn("sink", F.lit(s)) for f, s in zip(folders, "ab")]
    return first.unionByName(second)


@query("write_overwrite", "SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders")
def write_overwrite(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "refresh")
    table = writers.overwrite_table(t.orders.select("o_orderkey", "o_totalprice"), folder)
    return writers.overwrite_table(table.withColumn("o_totalprice", F.col("o_totalprice") * 2), folder)


@query("write_append", "SELECT o_orderkey, o_orderstatus FROM orders")
def write_append(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "append")
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    writers.append_table(rows.filter("o_orderstatus = 'F'"), folder)
    return writers.append_table(rows.filter("o_orderstatus <> 'F'"), folder)


@query("write_publish", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def write_publish(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "publish")
    return writers.publish(t.customer.select("c_custkey", "c_name", "c_acctbal"), f"{root}/staging", f"{root}/main", "c_custkey")


def _snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Yesterday's order table, and today's: old orders gone, new ones added, some changed."""
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    prev = rows.filter("o_orderdate < TIMESTAMP_NTZ '2001-01-01 00:00:00'").drop("o_orderdate")
    moved = F.when(F.col("o_totalprice") > 400000, F.lit("2-HIGH")).otherwise(F.col("o_orderpriority"))
    cur = rows.filter("o_orderdate >= TIMESTAMP_NTZ '1995-07-01 00:00:00'").drop("o_orderdate")
    return prev, cur.withColumn("o_orderpriority", moved)


SNAPSHOTS = """prev AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders
         WHERE o_orderdate < TIMESTAMP '2001-01-01'),
 cur AS (SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 400000 THEN '2-HIGH' ELSE o_orderpriority END AS o_orderpriority,
         o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1995-07-01')"""


@query(
    "write_upsert",
    f"WITH {SNAPSHOTS} SELECT * FROM cur UNION ALL SELECT * FROM prev WHERE o_orderkey NOT IN (SELECT o_orderkey FROM cur)",
)
def write_upsert(t: Tables) -> DataFrame:
    prev, cur = _snapshots(t)
    return change.upsert(prev, cur, ["o_orderkey"])


@query(
    "write_update_from",
    f"""WITH {SNAPSHOTS} SELECT p.o_orderkey, p.o_custkey, coalesce(c.o_orderpriority, p.o_orderpriority) AS o_orderpriority,
        p.o_totalprice FROM prev p LEFT JOIN cur c ON p.o_orderkey = c.o_orderkey""",
)
def write_update_from(t: Tables) -> DataFrame:
    prev, cur = _snapshots(t)
    return change.update_from(prev, cur, ["o_orderkey"], {"o_orderpriority": F.col("src_o_orderpriority")})


@query(
    "write_flag_exists",
    """SELECT c_custkey, c_name, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)
       THEN 1 ELSE 0 END AS existing_flag FROM customer""",
)
def write_flag_exists(t: Tables) -> DataFrame:
    big = t.orders.filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return change.flag_exists(t.customer.select("c_custkey", "c_name"), big, ["c_custkey"], "existing_flag")


@query(
    "write_update_where",
    """SELECT o_orderkey, CASE WHEN o_totalprice < 5000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders""",
)
def write_update_where(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return change.update_where(rows, F.col("o_totalprice") < 5000, {"o_orderstatus": F.lit("X")})


@query(
    "write_delete_where",
    """SELECT o_orderkey, o_orderdate, NULLIF(o_orderstatus, 'P') AS status FROM orders
       WHERE NOT coalesce(NULLIF(o_orderstatus, 'P') = 'F', false)
         AND o_orderdate >= TIMESTAMP '2001-06-30 16:30:00' - INTERVAL 365 DAY""",
)
def write_delete_where(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderdate", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return change.retain(change.delete_where(rows, F.col("status") == "F"), "o_orderdate", roles.ORDERS_AS_OF, 365)


@query(
    "write_run_log",
    """SELECT 'r1' AS run_id, 'Succeeded' AS status, (SELECT count(*) FROM orders) AS input_rows,
              (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS output_rows""",
)
def write_run_log(t: Tables) -> DataFrame:
    folder, start = scratch_path(t.spark, "runs"), roles.ORDERS_AS_OF
    writers.log_run(t.spark, folder, "r1", "open_orders", "Running", start)
    counts = t.orders.agg(count_rows("n"), F.count_if(F.col("o_orderstatus") == "O").alias("m")).first()
    log = writers.log_run(t.spark, folder, "r1", "open_orders", "Succeeded", jst(start), counts["n"], counts["m"])
    return latest_per_key(log, ["run_id"], ["at"]).select("run_id", "status", "input_rows", "output_rows")
