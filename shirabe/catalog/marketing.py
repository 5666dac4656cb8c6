"""Marketing and revenue reports on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shirabe.catalog import roles
from shirabe.catalog.events import rounded
from shirabe.catalog.registry import Tables, query
from shirabe.plans import marketing

AS_OF = roles.ORDERS_AS_OF
SENT_AS_OF = roles.EVENTS_AS_OF


def _tables(t: Tables) -> dict[str, DataFrame]:
    return {"messages": roles.messages(t), "clients": roles.clients(t), "engagement": roles.engagement(t)}


@query(
    "mkt_segment_summary",
    f"""WITH {roles.ENGAGEMENT} SELECT marketing_segment, count(*) AS customer_count, round(avg(engagement_score), 4) AS avg_engagement,
        count(CASE WHEN opt_in_email = 1 THEN 1 END) AS email_opt_ins, count(CASE WHEN opt_in_sms = 1 THEN 1 END) AS sms_opt_ins
        FROM engagement WHERE marketing_segment IN ('HIGH_VALUE', 'MEDIUM_VALUE', 'LOW_VALUE') GROUP BY 1""",
)
def mkt_segment_summary(t: Tables) -> DataFrame:
    out = marketing.segment_summary({"engagement": roles.engagement(t)}, ["HIGH_VALUE", "MEDIUM_VALUE", "LOW_VALUE"])
    return rounded(out, 4, "avg_engagement")


@query(
    "mkt_campaign_performance",
    f"""WITH {roles.MESSAGES} SELECT campaign_id, count(*) AS emails_sent, CAST(sum(points) AS BIGINT) AS total_points_granted,
        count(CASE WHEN status = 'DELIVERED' THEN 1 END) AS delivered_count, count(CASE WHEN status = 'BOUNCED' THEN 1 END) AS bounced_count,
        round(count(CASE WHEN status = 'DELIVERED' THEN 1 END)::DOUBLE / count(*), 6) AS delivery_rate FROM messages GROUP BY 1""",
)
def mkt_campaign_performance(t: Tables) -> DataFrame:
    return rounded(marketing.campaign_performance(_tables(t)), 6, "delivery_rate")


@query(
    "mkt_engagement_levels",
    f"""WITH {roles.MESSAGES}, {roles.ENGAGEMENT} SELECT m.client_id, engagement_score, count(message_id) AS email_interactions,
        CAST(sum(points) AS BIGINT) AS total_points_received, date_diff('day', last_response, TIMESTAMP '2001-06-30 16:30:00') AS days_since_last_response,
        CASE WHEN engagement_score >= 8 AND count(message_id) >= 3 THEN 'HIGHLY_ENGAGED' WHEN engagement_score >= 6 AND count(message_id) >= 2
          THEN 'MODERATELY_ENGAGED' WHEN engagement_score >= 4 THEN 'LOW_ENGAGED' ELSE 'DISENGAGED' END AS engagement_level
        FROM engagement m LEFT JOIN messages p ON m.client_id = p.client_id WHERE engagement_score IS NOT NULL
        GROUP BY m.client_id, engagement_score, last_response""",
)
def mkt_engagement_levels(t: Tables) -> DataFrame:
    return marketing.engagement_levels(_tables(t), AS_OF)


@query(
    "mkt_daily_deliverability",
    f"""WITH {roles.MESSAGES} SELECT strftime(sent_at, '%Y-%m-%d') AS send_date, count(*) AS total_sent,
        count(CASE WHEN status = 'DELIVERED' THEN 1 END) AS delivered, count(CASE WHEN status = 'BOUNCED' THEN 1 END) AS bounced,
        count(CASE WHEN status = 'FAILED' THEN 1 END) AS failed, round(count(CASE WHEN status = 'DELIVERED' THEN 1 END)::DOUBLE / count(*), 6) AS success_rate
        FROM messages WHERE sent_at >= TIMESTAMP '2024-01-23 12:00:00' GROUP BY 1""",
)
def mkt_daily_deliverability(t: Tables) -> DataFrame:
    out = marketing.daily_deliverability(_tables(t), SENT_AS_OF)
    return rounded(out, 6, "success_rate").withColumn("send_date", F.col("send_date").cast("string"))


@query(
    "mkt_lifetime_value",
    f"""WITH {roles.CLIENTS}, {roles.ENGAGEMENT} SELECT c.client_id, segment, total_amount AS current_value, engagement_score,
        date_diff('month', last_transaction, TIMESTAMP '2001-06-30 16:30:00') AS months_since_last_transaction,
        round(CASE WHEN total_amount >= 100000 AND engagement_score >= 8 THEN total_amount * 1.5::DOUBLE
          WHEN total_amount >= 50000 AND engagement_score >= 6 THEN total_amount * 1.3::DOUBLE
          WHEN total_amount >= 10000 AND engagement_score >= 4 THEN total_amount * 1.1::DOUBLE ELSE total_amount * 0.9::DOUBLE END, 4) AS estimated_lifetime_value
        FROM clients c LEFT JOIN engagement m ON c.client_id = m.client_id WHERE total_amount IS NOT NULL""",
)
def mkt_lifetime_value(t: Tables) -> DataFrame:
    return rounded(marketing.lifetime_value(_tables(t), AS_OF), 4, "estimated_lifetime_value")


@query(
    "mkt_churn_risk",
    f"""WITH {roles.CLIENTS}, {roles.ENGAGEMENT}, {roles.MESSAGES}, d AS (SELECT c.client_id, segment,
          date_diff('day', last_transaction, TIMESTAMP '2001-06-30 16:30:00') AS days_inactive, engagement_score AS s, count(message_id) AS n
        FROM clients c LEFT JOIN engagement m ON c.client_id = m.client_id LEFT JOIN messages p ON c.client_id = p.client_id
          AND sent_at >= TIMESTAMP '2023-12-31 12:00:00' WHERE last_transaction IS NOT NULL GROUP BY 1, 2, 3, 4)
        SELECT client_id, segment, days_inactive, s AS engagement_score, n AS recent_email_interactions,
          CASE WHEN days_inactive > 180 AND (s IS NULL OR s < 4) THEN 'HIGH_RISK' WHEN days_inactive > 90 AND (s IS NULL OR s < 6) THEN 'MEDIUM_RISK'
            WHEN days_inactive > 30 THEN 'LOW_RISK' ELSE 'ACTIVE' END AS churn_risk_level FROM d""",
)
def mkt_churn_risk(t: Tables) -> DataFrame:
    return marketing.churn_risk(_tables(t), AS_OF, SENT_AS_OF)


@query(
    "mkt_campaign_roi",
    f"""WITH {roles.MESSAGES} SELECT campaign_id, count(*) AS emails_sent, CAST(sum(points) AS BIGINT) AS campaign_cost,
        count(CASE WHEN status = 'DELIVERED' THEN 1 END) * 100 AS estimated_revenue,
        round(CASE WHEN sum(points) > 0 THEN (count(CASE WHEN status = 'DELIVERED' THEN 1 END) * 100.0::DOUBLE - sum(points)) / sum(points) ELSE 0 END, 6) AS roi_ratio
        FROM messages WHERE sent_at >= TIMESTAMP '2023-12-31 12:00:00' GROUP BY 1 HAVING count(*) >= 1""",
)
def mkt_campaign_roi(t: Tables) -> DataFrame:
    return rounded(marketing.campaign_roi(_tables(t), SENT_AS_OF), 6, "roi_ratio")


@query(
    "mkt_cross_sell",
    f"""WITH {roles.CLIENTS}, {roles.ENGAGEMENT} SELECT c.client_id, segment, total_amount, marketing_segment, preference,
        CASE WHEN segment = 'PREMIUM' AND preference NOT LIKE '%FINANCE%' THEN 'FINANCIAL_PRODUCTS'
          WHEN total_amount >= 50000 AND preference NOT LIKE '%LIFESTYLE%' THEN 'LIFESTYLE_SERVICES'
          WHEN engagement_score >= 7 AND preference NOT LIKE '%PREMIUM%' THEN 'PREMIUM_SERVICES' ELSE 'STANDARD_OFFERS' END AS cross_sell_opportunity
        FROM (SELECT * REPLACE (CASE WHEN segment = 'BUILDING' THEN 'PREMIUM' ELSE segment END AS segment) FROM clients) c
        JOIN engagement m ON c.client_id = m.client_id WHERE total_amount >= 10000 AND engagement_score >= 5""",
)
def mkt_cross_sell(t: Tables) -> DataFrame:
    tables = _tables(t)
    named = F.when(F.col("segment") == "BUILDING", "PREMIUM").otherwise(F.col("segment"))
    return marketing.cross_sell({**tables, "clients": tables["clients"].withColumn("segment", named)})


@query(
    "mkt_ab_comparison",
    f"""WITH {roles.MESSAGES} SELECT campaign_id, count(*) AS total_sends, count(CASE WHEN status = 'DELIVERED' THEN 1 END) AS deliveries,
        round(avg(points), 4) AS avg_points, round(count(CASE WHEN status = 'DELIVERED' THEN 1 END)::DOUBLE / count(*), 6) AS delivery_rate
        FROM messages WHERE campaign_id IN ('CAMPAIGN_0', 'CAMPAIGN_1') GROUP BY 1""",
)
def mkt_ab_comparison(t: Tables) -> DataFrame:
    out = marketing.ab_comparison(_tables(t), ["CAMPAIGN_0", "CAMPAIGN_1"])
    return rounded(rounded(out, 4, "avg_points"), 6, "delivery_rate")


@query(
    "mkt_journeys",
    f"""WITH {roles.CLIENTS}, {roles.ENGAGEMENT}, {roles.MESSAGES}, p AS (SELECT client_id, max(sent_at) - INTERVAL 9000 DAY AS mail FROM messages GROUP BY 1)
        SELECT c.client_id, date_diff('day', last_transaction, last_response) AS transaction_to_marketing_days,
          date_diff('day', last_response, mail) AS marketing_to_email_days,
          CASE WHEN last_transaction > last_response AND last_transaction > mail THEN 'TRANSACTION_DRIVEN'
            WHEN last_response > last_transaction AND last_response > mail THEN 'MARKETING_DRIVEN'
            WHEN mail > last_transaction AND mail > last_response THEN 'EMAIL_DRIVEN' ELSE 'MIXED_JOURNEY' END AS journey_type
        FROM clients c LEFT JOIN engagement m ON c.client_id = m.client_id LEFT JOIN p ON c.client_id = p.client_id WHERE last_transaction IS NOT NULL""",
)
def mkt_journeys(t: Tables) -> DataFrame:
    tables = _tables(t)
    earlier = tables["messages"].withColumn("sent_at", F.expr("sent_at - INTERVAL 9000 DAY"))
    return marketing.journeys({**tables, "messages": earlier})


@query(
    "mkt_monthly_revenue",
    """SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS transaction_count,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice) AS avg_transaction_value,
         max(o_totalprice) AS max_transaction, min(o_totalprice) AS min_transaction FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2""",
)
def mkt_monthly_revenue(t: Tables) -> DataFrame:
    return marketing.monthly_revenue(t.orders, "o_orderdate", "o_totalprice", "o_orderstatus", "F")


@query(
    "mkt_segment_metrics",
    """WITH m AS (SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice) AS mean, date_diff('day', max(o_orderdate), TIMESTAMP '2001-06-30 16:30:00') AS idle
         FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2)
       SELECT c_mktsegment, count(*) AS customer_count, round(avg(n), 4) AS avg_transactions_per_customer, round(avg(spent), 2) AS avg_lifetime_value,
         round(avg(mean), 2) AS avg_order_value, round(avg(idle), 4) AS avg_days_since_purchase FROM m GROUP BY 1""",
)
def mkt_segment_metrics(t: Tables) -> DataFrame:
    sales = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    out = marketing.segment_metrics(t.customer, sales, "c_custkey", "c_mktsegment", "o_totalprice", "o_orderdate", AS_OF)
    return rounded(
        rounded(out, 4, "avg_transactions_per_customer", "avg_days_since_purchase"), 2, "avg_lifetime_value", "avg_order_value"
    )


@query(
    "mkt_product_performance",
    """SELECT p_partkey, p_type, p_name, CAST(sum(l_quantity) AS DOUBLE) AS total_quantity_sold,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue, round(avg(l_extendedprice / l_quantity), 4) AS avg_selling_price,
         count(*) AS number_of_sales FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 2, 3""",
)
def mkt_product_performance(t: Tables) -> DataFrame:
    products = t.part.withColumnRenamed("p_partkey", "l_partkey")
    out = marketing.product_performance(products, t.lineitem, "l_partkey", ["p_type", "p_name"], "l_quantity", "l_extendedprice")
    return rounded(out, 4, "avg_selling_price").withColumnRenamed("l_partkey", "p_partkey")
