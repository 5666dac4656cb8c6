"""Projection, set, sort and window queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shirabe.catalog import roles
from shirabe.catalog.registry import Tables, query
from shirabe.operators import project, sets, window
from shirabe.session import scratch_path
from shirabe.sources import paging
from shirabe.sources.readers import values_df

# ---------------------------------------------------------------- projections

MAPPING = {
    "o_orderkey": "contract_number",
    "o_custkey": "customer_number",
    "o_orderstatus": "status_code",
    "o_totalprice": "billed_amount",
    "c_name": "customer_name",
    "c_mktsegment": "segment_code",
    "n_name": "region_name",
}


@query(
    "proj_mapping",
    """SELECT o_orderkey AS contract_number, o_custkey AS customer_number, o_orderstatus AS status_code,
              o_totalprice AS billed_amount, c_name AS customer_name, c_mktsegment AS segment_code, n_name AS region_name
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)
def proj_mapping(t: Tables) -> DataFrame:
    wide = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return project.project_mapping(wide, MAPPING)


@query(
    "proj_null_columns",
    """SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_name, c_acctbal, CAST(NULL AS VARCHAR) AS web_flag_2018
       FROM customer""",
)
def proj_null_columns(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal")
    return project.null_columns(rows, {"c_name": "string", "web_flag_2018": "string"})


@query(
    "proj_from_config",
    """SELECT c_custkey, c_acctbal, CAST(NULL AS VARCHAR) AS c_mktsegment, CAST(NULL AS VARCHAR) AS opening_flag_2018
       FROM customer""",
)
def proj_from_config(t: Tables) -> DataFrame:
    config = values_df(
        t.spark, [("c_mktsegment", "string"), ("opening_flag_2018", "string")], "alias_name string, data_type string"
    )
    return project.project_from_config(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), config)


@query(
    "proj_stamp",
    "SELECT c_custkey, '2001/07/01 01:30:00' AS output_datetime, '20010701' AS csv_ymd FROM customer",
)
def proj_stamp(t: Tables) -> DataFrame:
    return project.stamp(
        t.customer.select("c_custkey"), roles.ORDERS_AS_OF, output_datetime="%Y/%m/%d %H:%M:%S", csv_ymd="%Y%m%d"
    )


@query("proj_all_plus", "SELECT *, o_totalprice * 1.1::DOUBLE AS with_tax FROM orders")
def proj_all_plus(t: Tables) -> DataFrame:
    return t.orders.withColumn("with_tax", F.col("o_totalprice") * 1.1)


@query(
    "proj_code_filters",
    """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
       WHERE o_orderstatus <> 'P' AND o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED')
         AND o_totalprice > 1000 AND NULLIF(o_orderpriority, '1-URGENT') IS NOT NULL""",
)
def proj_code_filters(t: Tables) -> DataFrame:
    return t.orders.filter(
        (F.col("o_orderstatus") != "P")
        & ~F.col("o_orderpriority").isin("5-LOW", "4-NOT SPECIFIED")
        & (F.col("o_totalprice") > 1000)
        & F.nullif("o_orderpriority", F.lit("1-URGENT")).isNotNull()
    ).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(
    "proj_date_window",
    """SELECT o_orderkey, 'left' AS closed FROM orders
       WHERE o_orderdate >= TIMESTAMP '2001-06-11' AND o_orderdate < TIMESTAMP '2001-06-26'
       UNION ALL SELECT o_orderkey, 'both' FROM orders
       WHERE strftime(o_orderdate, '%Y%m%d') BETWEEN '20010601' AND '20010606'""",
)
def proj_date_window(t: Tables) -> DataFrame:
    native = project.date_window(t.orders, "o_orderdate", roles.ORDERS_AS_OF, 20, 5)
    texts = t.orders.withColumn("ymd", F.date_format("o_orderdate", "yyyyMMdd"))
    both = project.date_window(texts, "ymd", roles.ORDERS_AS_OF, 30, 25, closed="both")
    left = native.select("o_orderkey", F.lit("left").alias("closed"))
    return left.unionAll(both.select("o_orderkey", F.lit("both").alias("closed")))


@query(
    "proj_current_month",
    """SELECT o_orderkey, o_orderdate FROM orders
       WHERE o_orderdate >= TIMESTAMP '2001-07-01' AND o_orderdate < TIMESTAMP '2001-08-01'""",
)
def proj_current_month(t: Tables) -> DataFrame:
    return project.current_month(t.orders, "o_orderdate", roles.ORDERS_AS_OF).select("o_orderkey", "o_orderdate")


@query("proj_before_month", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '2001-05-01'")
def proj_before_month(t: Tables) -> DataFrame:
    return project.before_month(t.orders, "o_orderdate", roles.ORDERS_AS_OF, 2).select("o_orderkey", "o_orderdate")


@query(
    "proj_like",
    """SELECT p_partkey, p_name FROM part
       WHERE p_name LIKE 'red%' OR p_name LIKE '%bolt%' OR regexp_matches(p_brand, '^Brand#[1-2][0-9]$')""",
)
def proj_like(t: Tables) -> DataFrame:
    name = F.col("p_name")
    return t.part.filter(
        name.startswith("red") | name.contains("bolt") | F.col("p_brand").rlike("^Brand#[1-2][0-9]$")
    ).select("p_partkey", "p_name")


@query("proj_distinct", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def proj_distinct(t: Tables) -> DataFrame:
    return t.orders.select("o_custkey", "o_orderstatus").distinct()


@query(
    "proj_case_bucket",
    """SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'VIP' WHEN o_totalprice >= 150000 THEN 'GOLD'
              WHEN o_totalprice >= 50000 THEN 'SILVER' ELSE 'BRONZE' END AS tier,
              CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderpriority = '1-URGENT' THEN 'now' ELSE NULL END AS action
       FROM orders""",
)
def proj_case_bucket(t: Tables) -> DataFrame:
    tiers = [(300000, "VIP"), (150000, "GOLD"), (50000, "SILVER")]
    actions = [(F.col("o_orderstatus") == "F", "done"), (F.col("o_orderpriority") == "1-URGENT", "now")]
    return t.orders.select(
        "o_orderkey",
        project.bucket(F.col("o_totalprice"), tiers, "BRONZE").alias("tier"),
        project.label_when(actions, None).alias("action"),
    )


def _slot_sql(code: str) -> str:
    whens = " ".join(f"WHEN key_type{s} = '{code}' THEN service_key{s}" for s in (1, 2, 3))
    return f"CASE {whens} ELSE NULL END"


@query(
    "proj_slot_lookup",
    f"""WITH {roles.USAGE} SELECT index_id, line_no, amount, {_slot_sql('001')} AS key_1x, {_slot_sql('004')} AS key_4x,
        {_slot_sql('007')} AS sa_id FROM usage""",
)
def proj_slot_lookup(t: Tables) -> DataFrame:
    named = {"key_1x": "001", "key_4x": "004", "sa_id": "007"}
    looked = [project.slot_lookup(c, roles.KEY_TYPES, roles.KEYS).alias(n) for n, c in named.items()]
    return roles.usage(t).select("index_id", "line_no", "amount", *looked)


@query(
    "proj_null_handling",
    f"""WITH {roles.CLIENTS} SELECT client_id, coalesce(segment, 'UNKNOWN') AS segment,
        coalesce(total_amount, 0) AS total_amount, NULLIF(score, 0) AS score FROM clients""",
)
def proj_null_handling(t: Tables) -> DataFrame:
    return roles.clients(t).select(
        "client_id",
        F.coalesce("segment", F.lit("UNKNOWN")).alias("segment"),
        F.coalesce("total_amount", F.lit(0.0)).alias("total_amount"),
        F.nullif("score", F.lit(0)).alias("score"),
    )


@query(
    "proj_nest",
    """SELECT c_custkey AS user_id, c_custkey % 2 = 1 AS gas, c_mktsegment AS menu,
              CAST(CAST(c_acctbal AS DECIMAL(9,2)) AS VARCHAR) AS score FROM customer""",
)
def proj_nest(t: Tables) -> DataFrame:
    flag = (F.col("c_custkey") % 2).cast("string")
    nested = project.nest(
        t.customer.withColumnRenamed("c_custkey", "user_id").withColumn("c_custkey", F.col("user_id")),
        ["user_id"],
        {
            "contract": {"gas": flag.try_cast("boolean"), "menu": F.col("c_mktsegment")},
            "score": {"balance": F.col("c_acctbal").cast("decimal(9,2)")},
        },
    )
    return nested.select(
        "user_id", "contract.gas", "contract.menu", F.col("score.balance").cast("string").alias("score")
    )


@query(
    "proj_stringify",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey,
              CASE WHEN c_acctbal < 0 THEN 'Null' ELSE printf('%.5f', c_acctbal) END AS score,
              CASE WHEN c_mktsegment = 'BUILDING' THEN 'Null' ELSE c_mktsegment END AS menu FROM customer""",
)
def proj_stringify(t: Tables) -> DataFrame:
    rows = t.customer.select(
        "c_custkey",
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("score"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("menu"),
    )
    return project.stringify(rows, {"c_custkey": None, "score": "%.5f", "menu": None})


# ---------------------------------------------------------------- windows


@query(
    "win_latest_per_key",
    """SELECT o_custkey, o_orderpriority, o_orderkey, o_orderdate FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS rn
         FROM orders) WHERE rn = 1""",
)
def win_latest_per_key(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate")
    return window.latest_per_key(rows, ["o_custkey", "o_orderpriority"], ["o_orderdate"], ["o_orderkey"])


@query(
    "win_dedupe_max",
    f"""WITH {roles.MEMBERS} SELECT segment, nation_no, max(mail) AS mail FROM members GROUP BY 1, 2""",
)
def win_dedupe_max(t: Tables) -> DataFrame:
    rows = roles.members(t).select("segment", "nation_no", "mail")
    return window.latest_per_key(rows, ["segment", "nation_no"], [F.col("mail").desc_nulls_last()])


@query(
    "win_dedupe_except",
    """SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, max(l_quantity) AS l_quantity
       FROM lineitem GROUP BY 1, 2, 3, 4""",
)
def win_dedupe_except(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    return window.dedupe_except(rows, ["l_quantity"], ["l_quantity"])


@query(
    "win_latest_then_filter",
    f"""WITH {roles.USAGE} SELECT bx, service_type, index_id, transfer_ymd, line_no, amount FROM (
          SELECT *, row_number() OVER (PARTITION BY bx, service_type, user_key
            ORDER BY transfer_ymd DESC, transfer_type DESC, line_no, amount, quantity) AS rn FROM usage)
        WHERE rn = 1 AND transfer_type = '02'""",
)
def win_latest_then_filter(t: Tables) -> DataFrame:
    newest = window.latest_per_key(
        roles.usage(t), ["bx", "service_type", "user_key"], ["transfer_ymd", "transfer_type"], ["line_no", "amount", "quantity"]
    )
    return newest.filter("transfer_type = '02'").select("bx", "service_type", "index_id", "transfer_ymd", "line_no", "amount")


@query(
    "win_rank_and_avg",
    """SELECT c_custkey, c_mktsegment, c_acctbal,
              row_number() OVER (PARTITION BY upper(c_mktsegment) ORDER BY c_acctbal DESC, c_custkey DESC) AS rank_in_group,
              round(avg(c_acctbal) OVER (PARTITION BY upper(c_mktsegment)), 4) AS group_avg FROM customer""",
)
def win_rank_and_avg(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal", F.upper("c_mktsegment").alias("seg"))
    ranked = window.with_group_stats(rows, ["seg"], "c_acctbal", "c_custkey")
    return ranked.withColumn("group_avg", F.round("group_avg", 4)).drop("seg")


@query(
    "win_lag_change",
    """SELECT o_custkey, o_orderkey, o_totalprice, lag(o_totalprice) OVER w AS prev_value,
              round(o_totalprice - lag(o_totalprice) OVER w, 2) AS value_change,
              round(CASE WHEN lag(o_totalprice) OVER w > 0 THEN
                (o_totalprice - lag(o_totalprice) OVER w) * 100.0::DOUBLE / lag(o_totalprice) OVER w ELSE 0 END, 4) AS change_percentage
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def win_lag_change(t: Tables) -> DataFrame:
    out = window.with_change(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice")
    return out.select(
        "o_custkey",
        "o_orderkey",
        "o_totalprice",
        "prev_value",
        F.round("value_change", 2).alias("value_change"),
        F.round("change_percentage", 4).alias("change_percentage"),
    )


@query(
    "win_trend",
    """WITH m AS (SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n FROM lineitem GROUP BY 1, 2)
       SELECT l_suppkey, month, n, lag(n) OVER w AS prev_value, n - lag(n) OVER w AS value_change,
         CASE WHEN lag(n) OVER w IS NULL THEN 'Initial Window' WHEN n > lag(n) OVER w THEN 'Increasing Trend'
              WHEN n < lag(n) OVER w THEN 'Decreasing Trend' ELSE 'Stable Trend' END AS trend_direction
       FROM m WINDOW w AS (PARTITION BY l_suppkey ORDER BY month)""",
)
def win_trend(t: Tables) -> DataFrame:
    months = t.lineitem.groupBy("l_suppkey", F.date_trunc("month", "l_shipdate").alias("m")).agg(
        F.count(F.lit(1)).alias("n")
    )
    out = window.trend(months, ["l_suppkey"], ["m"], "n")
    return out.withColumn("month", F.date_format("m", "yyyy-MM")).drop("m")


@query(
    "win_sessionize",
    """WITH f AS (SELECT event_id, user_id, ts, CASE WHEN date_diff('minute', lag(ts) OVER w, ts) > 30 THEN 1 ELSE 0 END AS o
         FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       SELECT event_id, user_id, CAST(sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_id FROM f""",
)
def win_sessionize(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "ts")
    return window.sessionize(rows, ["user_id"], "ts", "event_id").select("event_id", "user_id", "session_id")


@query("win_number_rows", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_no FROM orders")
def win_number_rows(t: Tables) -> DataFrame:
    return window.number_rows(t.orders.select("o_orderkey"), ["o_orderkey"])


# ---------------------------------------------------------------- sorts and sets


@query("set_order_by", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def set_order_by(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query(
    "set_priority_order",
    """SELECT o_orderstatus, count(*) AS n, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS position
       FROM orders GROUP BY 1""",
)
def set_priority_order(t: Tables) -> DataFrame:
    counts = t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("position", sets.priority_order("o_orderstatus", ["P", "O"])).orderBy("position")


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_k(t: Tables) -> DataFrame:
    return sets.top_k(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 100)


@query("top_zero_layout", "SELECT o_orderkey, o_orderstatus FROM orders")
def top_zero_layout(t: Tables) -> DataFrame:
    layout = sets.schema_only(t.orders.select("o_orderkey", "o_orderstatus"))
    return layout.unionByName(t.orders.select("o_orderstatus", "o_orderkey"))


@query("top_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 200")
def top_page(t: Tables) -> DataFrame:
    return sets.page(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice"), F.col("o_orderkey")], 200, 50)


@query(
    "top_deep_page",
    """SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50
       OFFSET (SELECT CAST(floor(count(*) * 0.9) AS BIGINT) FROM orders)""",
)
def top_deep_page(t: Tables) -> DataFrame:
    folder, order = scratch_path(t.spark, "pages"), ["o_totalprice", "o_orderkey"]
    paging.write_sorted(t.orders.select("o_orderkey", "o_totalprice", "o_orderdate"), folder, order, ranges=16)
    return paging.read_page(t.spark, folder, order, int(t.orders.count() * 0.9), 50)


@query(
    "set_union_distinct",
    """SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0""",
)
def set_union_distinct(t: Tables) -> DataFrame:
    finished = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return sets.union_distinct([finished, t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("k"))])


@query(
    "set_union_summaries",
    """SELECT 'orders' AS label, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer
       UNION ALL SELECT 'lineitem', count(*) FROM lineitem""",
)
def set_union_summaries(t: Tables) -> DataFrame:
    parts = [
        getattr(t, name).agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.lit(name))
        for name in ("orders", "customer", "lineitem")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "set_unpivot_slots",
    f"""WITH {roles.USAGE} SELECT bx, line_no, amount, key_type1 AS key_type, service_key1 AS key FROM usage
        UNION ALL SELECT bx, line_no, amount, key_type2, service_key2 FROM usage
        UNION ALL SELECT bx, line_no, amount, key_type3, service_key3 FROM usage""",
)
def set_unpivot_slots(t: Tables) -> DataFrame:
    return sets.unpivot_slots(roles.usage(t), ["bx", "line_no", "amount"], list(zip(roles.KEY_TYPES, roles.KEYS)))


@query(
    "set_above_avg",
    """SELECT c_custkey, c_acctbal FROM customer
       WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_mktsegment = 'BUILDING')
         AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""",
)
def set_above_avg(t: Tables) -> DataFrame:
    rows = sets.above_avg(t.customer.select("c_custkey", "c_acctbal", "c_mktsegment"), "c_acctbal", F.col("c_mktsegment") == "BUILDING")
    big = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return rows.join(big, "c_custkey", "left_semi").select("c_custkey", "c_acctbal")


@query(
    "set_cte_chain",
    """WITH a AS (SELECT o_custkey, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY 1),
            b AS (SELECT c_mktsegment, n, total FROM a JOIN customer ON o_custkey = c_custkey),
            c AS (SELECT c_mktsegment, sum(n) AS n, sum(total) AS total FROM b GROUP BY 1)
       SELECT c_mktsegment, CAST(n AS BIGINT) AS n, CAST(total AS DOUBLE) AS total FROM c WHERE n > 100""",
)
def set_cte_chain(t: Tables) -> DataFrame:
    per = t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total")
    )
    joined = per.join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    out = joined.groupBy("c_mktsegment").agg(F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"))
    return out.filter("n > 100")
