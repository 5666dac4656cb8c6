"""Join and aggregation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shirabe.catalog import roles
from shirabe.catalog.registry import Tables, query
from shirabe.catalog.scans import SNAPSHOTS, _snapshots
from shirabe.operators import aggregate, join
from shirabe.operators.aggregate import count_rows, distinct_of_bitmaps, id_bitmaps, mean_amount, merge_bitmaps, money, pct
from shirabe.session import stored

# ---------------------------------------------------------------- joins


@query(
    "join_inner_multi",
    f"""WITH {SNAPSHOTS} SELECT p.o_orderkey, p.o_custkey, p.o_orderpriority AS before, c.o_orderpriority AS after
        FROM prev p JOIN cur c ON p.o_orderkey = c.o_orderkey AND p.o_custkey = c.o_custkey""",
)
def join_inner_multi(t: Tables) -> DataFrame:
    prev, cur = _snapshots(t)
    left = prev.select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("before"))
    return left.join(cur.select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("after")), ["o_orderkey", "o_custkey"])


@query(
    "join_cast",
    f"""WITH {roles.USAGE}, {roles.GAS} SELECT bx, line_no, amount, user_reg_no, pay_method FROM usage
        JOIN gas ON user_key = CAST(user_reg_no AS VARCHAR)""",
)
def join_cast(t: Tables) -> DataFrame:
    return join.join_cast(roles.usage(t), roles.gas(t), "user_key", "user_reg_no").select(
        "bx", "line_no", "amount", "user_reg_no", "pay_method"
    )


@query(
    "join_with_predicates",
    f"""WITH {roles.USAGE}, {roles.GAS} SELECT bx, line_no, amount, user_reg_no FROM usage
        JOIN gas ON index_id = user_reg_no AND user_key_type = '003' AND service_type = '001' AND transfer_type = '02'""",
)
def join_with_predicates(t: Tables) -> DataFrame:
    active = roles.usage(t).filter("user_key_type = '003' AND service_type = '001' AND transfer_type = '02'")
    return active.join(roles.gas(t), F.col("index_id") == F.col("user_reg_no")).select("bx", "line_no", "amount", "user_reg_no")


@query(
    "join_left",
    "SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
)
def join_left(t: Tables) -> DataFrame:
    placed = t.orders.select("o_custkey", "o_orderkey")
    return t.customer.select("c_custkey", "c_name").join(placed, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")


@query(
    "join_left_coalesce",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, s_name FROM lineitem LEFT JOIN supplier
       ON s_suppkey = coalesce(NULLIF(l_suppkey, 7), l_orderkey % 100) AND s_nationkey > 5""",
)
def join_left_coalesce(t: Tables) -> DataFrame:
    key = F.coalesce(F.nullif("l_suppkey", F.lit(7)), F.col("l_orderkey") % 100)
    left = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", key.alias("k"))
    right = t.supplier.filter("s_nationkey > 5").select("s_suppkey", "s_name")
    return left.join(right, F.col("k") == F.col("s_suppkey"), "left").drop("k", "s_suppkey")


@query(
    "join_left_recent",
    f"""WITH {roles.MESSAGES} SELECT c_custkey, count(message_id) AS recent_messages FROM customer LEFT JOIN messages
        ON c_custkey = client_id AND sent_at >= TIMESTAMP '2024-01-23 12:00:00' GROUP BY 1""",
)
def join_left_recent(t: Tables) -> DataFrame:
    recent = roles.messages(t).filter(F.col("sent_at") >= F.lit("2024-01-23 12:00:00").cast("timestamp_ntz"))
    counts = recent.groupBy(F.col("client_id").alias("c_custkey")).agg(count_rows("n"))
    return t.customer.select("c_custkey").join(counts, "c_custkey", "left").select(
        "c_custkey", F.coalesce("n", F.lit(0)).alias("recent_messages")
    )


@query(
    "join_any_slot",
    """SELECT o_orderkey, l_orderkey, l_linenumber, l_extendedprice FROM orders JOIN lineitem
       ON o_orderkey IN (l_orderkey, l_partkey, l_suppkey)""",
)
def join_any_slot(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    joined = join.join_any_slot(t.orders.select("o_orderkey"), lines, "o_orderkey", ["l_orderkey", "l_partkey", "l_suppkey"])
    return joined.select("o_orderkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "join_any_key",
    """SELECT o_orderkey, l_orderkey, l_linenumber, l_extendedprice FROM orders JOIN lineitem
       ON o_orderkey = l_orderkey OR o_custkey = l_partkey""",
)
def join_any_key(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    pairs = [("o_orderkey", "l_orderkey"), ("o_custkey", "l_partkey")]
    joined = join.join_any_key(t.orders.select("o_orderkey", "o_custkey"), lines, pairs)
    return joined.select("o_orderkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "join_full_outer",
    f"""WITH {SNAPSHOTS} SELECT p.o_orderkey AS prev_key, c.o_orderkey AS cur_key, p.o_orderpriority AS before,
        c.o_orderpriority AS after FROM prev p FULL JOIN cur c ON p.o_orderkey = c.o_orderkey""",
)
def join_full_outer(t: Tables) -> DataFrame:
    prev, cur = _snapshots(t)
    left = prev.select(F.col("o_orderkey").alias("prev_key"), F.col("o_orderpriority").alias("before"))
    right = cur.select(F.col("o_orderkey").alias("cur_key"), F.col("o_orderpriority").alias("after"))
    return left.join(right, F.col("prev_key") == F.col("cur_key"), "full")


@query(
    "join_semi",
    "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)",
)
def join_semi(t: Tables) -> DataFrame:
    big = t.orders.filter("o_totalprice > 480000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey", "c_name").join(big, "c_custkey", "left_semi")


@query(
    "join_anti",
    """SELECT k, c_name FROM (SELECT NULLIF(c_custkey, 3) AS k, c_name FROM customer)
       WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = k AND o_totalprice > 300000)""",
)
def join_anti(t: Tables) -> DataFrame:
    rows = t.customer.select(F.nullif("c_custkey", F.lit(3)).alias("k"), "c_name")
    return rows.join(t.orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("k")), "k", "left_anti")


@query(
    "join_exclude_multi",
    """SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (
         SELECT l_partkey FROM (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem WHERE l_quantity > 35)
         GROUP BY 1 HAVING count(*) > 1)""",
)
def join_exclude_multi(t: Tables) -> DataFrame:
    many = t.lineitem.filter("l_quantity > 35").select("l_partkey", "l_returnflag")
    return join.exclude_multi(t.customer.select("c_custkey", "c_name"), many, "c_custkey", "l_returnflag", "l_partkey")


def _contracts(t: Tables) -> DataFrame:
    """Electricity contracts at supply points, with person attributes that may be NULL."""
    key = F.col("o_orderkey")
    return t.orders.select(
        key.alias("sa_id"),
        F.col("o_custkey").alias("supply_point"),
        F.when(key % 3 == 0, None).otherwise(F.col("o_custkey")).alias("reg_no"),
        F.when(key % 4 == 0, None).otherwise(key % 23).alias("person"),
        (key % 41).alias("kana"),
        F.when(key % 5 == 0, None).otherwise(key % 53).alias("phone"),
        "o_orderdate",
        "o_orderstatus",
    )


CONTRACTS = """contracts AS (
  SELECT o_orderkey AS sa_id, o_custkey AS supply_point,
         CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS reg_no,
         CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 23 END AS person, o_orderkey % 41 AS kana,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 53 END AS phone, o_orderdate, o_orderstatus
  FROM orders)"""


@query(
    "join_only_one_in_group",
    f"""WITH {CONTRACTS} SELECT sa_id, supply_point FROM contracts c WHERE EXISTS (
          SELECT 1 FROM (SELECT count(DISTINCT ct.sa_id) AS n FROM contracts ct WHERE ct.supply_point = c.supply_point
            AND (ct.reg_no = c.reg_no OR ct.person = c.person OR ct.kana = c.kana OR ct.phone = c.phone)) WHERE n = 1)""",
)
def join_only_one_in_group(t: Tables) -> DataFrame:
    rows = _contracts(t)
    out = join.only_one_in_group(rows, rows, "supply_point", ["reg_no", "person", "kana", "phone"], "sa_id")
    return out.select("sa_id", "supply_point")


@query(
    "join_outlier_count",
    """WITH s AS (SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS d
         FROM lineitem GROUP BY 1, 2)
       SELECT s.l_returnflag, s.l_linestatus, n AS measurement_count, round(m, 2) AS avg_value, round(d, 2) AS std_deviation,
         (SELECT count(*) FROM lineitem l WHERE l.l_returnflag = s.l_returnflag AND l.l_linestatus = s.l_linestatus
            AND (l.l_extendedprice > m + 2 * d OR l.l_extendedprice < m - 2 * d)) AS anomaly_count FROM s""",
)
def join_outlier_count(t: Tables) -> DataFrame:
    out = join.outlier_count(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return out.select(
        "l_returnflag",
        "l_linestatus",
        "measurement_count",
        F.round("avg_value", 2).alias("avg_value"),
        F.round("std_deviation", 2).alias("std_deviation"),
        "anomaly_count",
    )


@query(
    "join_latest_log",
    """SELECT c_custkey, o_orderkey, o_orderdate FROM customer JOIN orders o ON c_custkey = o_custkey
       WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders x WHERE x.o_custkey = o.o_custkey)""",
)
def join_latest_log(t: Tables) -> DataFrame:
    log = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return join.join_latest(t.customer.select("c_custkey"), log, "c_custkey", "o_orderdate")


@query(
    "join_preaggregated",
    """SELECT c_custkey, c_name, last_order FROM customer
       LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
)
def join_preaggregated(t: Tables) -> DataFrame:
    last = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_order"))
    return t.customer.select("c_custkey", "c_name").join(last, "c_custkey", "left")


@query("join_recombine", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def join_recombine(t: Tables) -> DataFrame:
    parts = [t.customer.select("c_custkey", c) for c in ("c_name", "c_acctbal", "c_mktsegment")]
    return join.recombine(parts, "c_custkey")


@query(
    "join_detect_delta",
    f"""WITH {SNAPSHOTS} SELECT c.o_orderkey, c.o_orderpriority, p.o_orderkey IS NULL AS is_new,
        coalesce(p.o_orderkey IS NOT NULL AND p.o_orderpriority <> c.o_orderpriority, false) AS is_updated
        FROM cur c LEFT JOIN prev p ON p.o_orderkey = c.o_orderkey""",
)
def join_detect_delta(t: Tables) -> DataFrame:
    columns = ["o_custkey", "o_orderpriority", "o_totalprice"]
    prev, cur = [s.withColumn("hash", join.row_hash(columns)) for s in _snapshots(t)]
    return join.detect_delta(cur, prev, "o_orderkey", "hash").select("o_orderkey", "o_orderpriority", "is_new", "is_updated")


@query(
    "join_snapshot_changes",
    f"""WITH {SNAPSHOTS} SELECT c.o_orderkey, c.o_custkey, c.o_orderpriority, c.o_totalprice FROM prev p
        JOIN cur c ON p.o_orderkey = c.o_orderkey AND p.o_custkey = c.o_custkey
        WHERE p.o_orderpriority = '1-URGENT' AND c.o_orderpriority <> '1-URGENT'""",
)
def join_snapshot_changes(t: Tables) -> DataFrame:
    prev, cur = _snapshots(t)
    return join.snapshot_changes(prev, cur, ["o_orderkey", "o_custkey"], "o_orderpriority", "1-URGENT").select(*cur.columns)


@query(
    "join_json_field",
    """SELECT event_id, s_name FROM events LEFT JOIN supplier ON json_extract_string(props, '$.k') = CAST(s_suppkey AS VARCHAR)""",
)
def join_json_field(t: Tables) -> DataFrame:
    rows = join.join_json(t.events.select("event_id", "props"), "props", "$.k", t.supplier.select("s_suppkey", "s_name"), "s_suppkey")
    return rows.select("event_id", "s_name")


@query("join_multiply_rows", "SELECT o_orderkey, n FROM orders, (SELECT unnest([1, 2, 3]) AS n)")
def join_multiply_rows(t: Tables) -> DataFrame:
    return join.multiply_rows(t.orders.select("o_orderkey"), 3, "n")


# ---------------------------------------------------------------- aggregations


@query(
    "agg_group_by",
    """SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(c_acctbal) AS avg_amount, max(c_acctbal) AS max_amount,
              min(c_acctbal) AS min_amount, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total FROM customer GROUP BY 1""",
)
def agg_group_by(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_mktsegment").agg(
        count_rows("n"),
        mean_amount(F.col("c_acctbal")).alias("avg_amount"),
        F.max("c_acctbal").alias("max_amount"),
        F.min("c_acctbal").alias("min_amount"),
        F.sum(money(F.col("c_acctbal"))).cast("double").alias("total"),
    )


@query(
    "agg_global",
    """SELECT count(*) AS total, count(DISTINCT o_custkey) AS customers, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice) AS avg_amount,
              max(o_totalprice) AS hi, min(o_totalprice) AS lo FROM orders""",
)
def agg_global(t: Tables) -> DataFrame:
    return t.orders.agg(
        count_rows("total"),
        F.countDistinct("o_custkey").alias("customers"),
        mean_amount(F.col("o_totalprice")).alias("avg_amount"),
        F.max("o_totalprice").alias("hi"),
        F.min("o_totalprice").alias("lo"),
    )


@query(
    "agg_conditional",
    """SELECT l_returnflag, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS open_lines,
              CAST(sum(CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END) AS DOUBLE) AS discounted_qty FROM lineitem GROUP BY 1""",
)
def agg_conditional(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count_if(F.col("l_linestatus") == "O").alias("open_lines"),
        F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).otherwise(0)).alias("discounted_qty"),
    )


@query(
    "agg_flag_pivot",
    f"""WITH {roles.USAGE} SELECT bx, max(CASE WHEN service_type = '001' THEN '1' ELSE '0' END) AS gas,
        max(CASE WHEN service_type = '006' THEN '1' ELSE '0' END) AS power,
        max(CASE WHEN service_type = '099' THEN '1' ELSE '0' END) AS other FROM usage WHERE transfer_type = '02' GROUP BY 1""",
)
def agg_flag_pivot(t: Tables) -> DataFrame:
    active = roles.usage(t).filter("transfer_type = '02'")
    return aggregate.flag_pivot(active, ["bx"], "service_type", {"001": "gas", "006": "power", "099": "other"})


@query(
    "agg_conditional_max",
    """SELECT o_custkey, max(CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END) AS open_priority,
              max(CASE WHEN o_orderstatus = 'O' THEN o_orderdate END) AS open_date,
              count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS open_count FROM orders GROUP BY 1""",
)
def agg_conditional_max(t: Tables) -> DataFrame:
    live = F.col("o_orderstatus") == "O"
    return t.orders.groupBy("o_custkey").agg(
        F.max(F.when(live, F.col("o_orderpriority"))).alias("open_priority"),
        F.max(F.when(live, F.col("o_orderdate"))).alias("open_date"),
        F.count_if(live).alias("open_count"),
    )


@query(
    "agg_collapse_flags",
    """SELECT o_custkey, max(gas) AS gas, max(power) AS power FROM (
         SELECT o_custkey, 1 AS gas, CAST(NULL AS INTEGER) AS power FROM orders WHERE o_orderstatus = 'F'
         UNION ALL SELECT o_custkey, NULL, 1 FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1""",
)
def agg_collapse_flags(t: Tables) -> DataFrame:
    gas = t.orders.filter("o_orderstatus = 'F'").select("o_custkey", F.lit(1).alias("gas"))
    power = t.orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey", F.lit(1).alias("power"))
    return aggregate.collapse_flags([gas, power], ["o_custkey"])


@query("agg_having", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def agg_having(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(count_rows("n")).filter("n > 1")


@query(
    "agg_distinct_count",
    """SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers,
              count(DISTINCT CAST(o_custkey AS VARCHAR) || '|' || o_orderpriority) AS pairs,
              count(*) - count(DISTINCT o_custkey) AS repeats FROM orders""",
)
def agg_distinct_count(t: Tables) -> DataFrame:
    pair = F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority")
    out = t.orders.agg(count_rows("n"), F.countDistinct("o_custkey").alias("customers"), F.countDistinct(pair).alias("pairs"))
    return out.withColumn("repeats", F.col("n") - F.col("customers"))


@query(
    "agg_band",
    """SELECT event_type, count(*) AS measurement_count, round(avg(value), 4) AS avg_value, round(stddev_samp(value), 4) AS std_deviation,
              round(avg(value) + 2 * stddev_samp(value), 4) AS upper_threshold,
              round(avg(value) - 2 * stddev_samp(value), 4) AS lower_threshold FROM events GROUP BY 1""",
)
def agg_band(t: Tables) -> DataFrame:
    out = join.band(t.events, ["event_type"], "value")
    rounded = ("avg_value", "std_deviation", "upper_threshold", "lower_threshold")
    return out.withColumns({c: F.round(c, 4) for c in rounded})


@query(
    "agg_ratio",
    """SELECT c_nationkey, round(count(CASE WHEN c_acctbal < 0 THEN 1 END) * 100.0::DOUBLE / NULLIF(count(*), 0), 4) AS overdrawn_pct,
              round(count(*) * 100.0::DOUBLE / NULLIF(count(CASE WHEN c_acctbal < -990 THEN 1 END), 0), 4) AS guarded FROM customer GROUP BY 1""",
)
def agg_ratio(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    return t.customer.groupBy("c_nationkey").agg(
        F.round(pct(F.count_if(F.col("c_acctbal") < 0), n), 4).alias("overdrawn_pct"),
        F.round(pct(n, F.count_if(F.col("c_acctbal") < -990)), 4).alias("guarded"),
    )


@query(
    "agg_string_agg",
    """SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities,
              string_agg(o_orderpriority, ', ' ORDER BY o_orderpriority) AS all_priorities FROM orders GROUP BY 1""",
)
def agg_string_agg(t: Tables) -> DataFrame:
    codes = aggregate.string_agg(t.orders, ["o_custkey"], "o_orderpriority", "priorities", distinct=True)
    return codes.join(aggregate.string_agg(t.orders, ["o_custkey"], "o_orderpriority", "all_priorities"), "o_custkey")


@query(
    "agg_latest_value",
    """SELECT o_custkey, max(o_orderdate) AS last_date, arg_max(o_totalprice, o_orderdate + to_microseconds(o_orderkey)) AS last_price
       FROM orders GROUP BY 1""",
)
def agg_latest_value(t: Tables) -> DataFrame:
    newest = F.struct("o_orderdate", "o_orderkey")
    return t.orders.groupBy("o_custkey").agg(
        F.max("o_orderdate").alias("last_date"), F.max_by("o_totalprice", newest).alias("last_price")
    )


@query(
    "agg_calendar",
    """SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS n,
              CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders GROUP BY 1, 2""",
)
def agg_calendar(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.groupBy(F.year(d).cast("long").alias("year"), F.month(d).cast("long").alias("month")).agg(
        count_rows("n"), F.sum(money(F.col("o_totalprice"))).cast("double").alias("revenue")
    )


@query(
    "agg_distinct_rollup",
    """SELECT 'month' AS level, year(o_orderdate) AS year, month(o_orderdate) AS month, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 2, 3
       UNION ALL SELECT 'year', year(o_orderdate), NULL, count(DISTINCT o_custkey) FROM orders GROUP BY 2""",
)
def agg_distinct_rollup(t: Tables) -> DataFrame:
    d = F.col("day")
    days = stored(id_bitmaps(t.orders.withColumn("day", F.col("o_orderdate").cast("date")), ["day"], "o_custkey"), "days")
    dated = days.select(F.year(d).cast("long").alias("year"), F.month(d).cast("long").alias("month"), "id_range", "ids")
    months = merge_bitmaps(dated, ["year", "month"])
    by_month = distinct_of_bitmaps(months, ["year", "month"], "customers").select(F.lit("month").alias("level"), "year", "month", "customers")
    by_year = distinct_of_bitmaps(months, ["year"], "customers")
    return by_month.unionByName(by_year.select(F.lit("year").alias("level"), "year", F.lit(None).cast("long").alias("month"), "customers"))


@query(
    "agg_of_agg",
    """SELECT o_orderpriority, count(*) AS customers, round(avg(n), 4) AS avg_orders, max(n) AS max_orders FROM (
         SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""",
)
def agg_of_agg(t: Tables) -> DataFrame:
    per = t.orders.groupBy("o_orderpriority", "o_custkey").agg(count_rows("n"))
    return per.groupBy("o_orderpriority").agg(
        count_rows("customers"), F.round(F.avg("n"), 4).alias("avg_orders"), F.max("n").alias("max_orders")
    )


@query(
    "agg_coverage",
    f"""WITH {roles.CLIENTS} SELECT round(count(client_id) * 100.0::DOUBLE / count(*), 4) AS client_id_coverage_pct,
        round(count(segment) * 100.0::DOUBLE / count(*), 4) AS segment_coverage_pct,
        round(count(last_transaction) * 100.0::DOUBLE / count(*), 4) AS last_transaction_coverage_pct,
        count(*) AS total_records FROM clients""",
)
def agg_coverage(t: Tables) -> DataFrame:
    out = aggregate.coverage(roles.clients(t), ["client_id", "segment", "last_transaction"])
    return out.select(*[F.round(c, 4).alias(c) if c.endswith("pct") else F.col(c) for c in out.columns])


@query(
    "agg_size_stats",
    """SELECT lang, count(*) AS record_count, round(avg(length(text)), 4) AS avg_record_size, max(length(text)) AS max_record_size,
              min(length(text)) AS min_record_size, CAST(sum(length(text)) AS BIGINT) AS total_data_size FROM documents GROUP BY 1""",
)
def agg_size_stats(t: Tables) -> DataFrame:
    out = aggregate.size_stats(t.documents, ["lang"], "text")
    return out.withColumn("avg_record_size", F.round("avg_record_size", 4))
