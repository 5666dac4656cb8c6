"""Marketing and revenue reports."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shirabe.functions.dates import boundary_diff
from shirabe.operators.aggregate import count_rows, mean_amount, money
from shirabe.operators.project import label_when

Tables = dict[str, DataFrame]


def _at(moment: datetime) -> Column:
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def segment_summary(tables: Tables, segments: list[str]) -> DataFrame:
    """Customers, engagement and opt-ins per marketing segment."""
    return (
        tables["engagement"]
        .filter(F.col("marketing_segment").isin(segments))
        .groupBy("marketing_segment")
        .agg(
            count_rows("customer_count"),
            F.avg("engagement_score").alias("avg_engagement"),
            F.count_if(F.col("opt_in_email") == 1).alias("email_opt_ins"),
            F.count_if(F.col("opt_in_sms") == 1).alias("sms_opt_ins"),
        )
    )


def campaign_performance(tables: Tables) -> DataFrame:
    """Sent, delivered and bounced messages, points and delivery rate per campaign."""
    delivered = F.count_if(F.col("status") == "DELIVERED")
    return (
        tables["messages"]
        .groupBy("campaign_id")
        .agg(
            count_rows("emails_sent"),
            F.sum("points").alias("total_points_granted"),
            delivered.alias("delivered_count"),
            F.count_if(F.col("status") == "BOUNCED").alias("bounced_count"),
            _share(delivered, F.count(F.lit(1))).alias("delivery_rate"),
        )
    )


def engagement_levels(tables: Tables, as_of: datetime) -> DataFrame:
    """Engagement level per customer from score and number of messages."""
    mails = tables["messages"].groupBy("client_id").agg(count_rows("_n"), F.sum("points").alias("total_points_received"))
    rows = tables["engagement"].filter("engagement_score IS NOT NULL").join(mails, "client_id", "left")
    n, score = F.coalesce("_n", F.lit(0)), F.col("engagement_score")
    # Bounds and labels.
    levels = [
        ((score >= 8) & (n >= 3), "HIGHLY_ENGAGED"),
        ((score >= 6) & (n >= 2), "MODERATELY_ENGAGED"),
        (score >= 4, "LOW_ENGAGED"),
    ]
    return rows.select(
        "client_id",
        "engagement_score",
        n.alias("email_interactions"),
        "total_points_received",
        boundary_diff("day", F.col("last_response"), _at(as_of)).alias("days_since_last_response"),
        label_when(levels, "DISENGAGED").alias("engagement_level"),
    )


def daily_deliverability(tables: Tables, as_of: datetime, days: int = 7) -> DataFrame:
    """Delivery outcome per day of the trailing days."""
    recent = tables["messages"].filter(F.col("sent_at") >= _at(as_of - timedelta(days=days)))

    def status(s: str) -> Column:
        return F.count_if(F.col("status") == s)

    return recent.groupBy(F.to_date("sent_at").alias("send_date")).agg(
        count_rows("total_sent"),
        status("DELIVERED").alias("delivered"),
        status("BOUNCED").alias("bounced"),
        status("FAILED").alias("failed"),
        _share(status("DELIVERED"), F.count(F.lit(1))).alias("success_rate"),
    )


def lifetime_value(tables: Tables, as_of: datetime) -> DataFrame:
    """Estimated lifetime value: present value times the multiplier of its tier."""
    scores = tables["engagement"].select("client_id", "engagement_score")
    rows = tables["clients"].filter("total_amount IS NOT NULL").join(scores, "client_id", "left")
    value, score = F.col("total_amount"), F.col("engagement_score")
    factor = (
        F.when((value >= 100000) & (score >= 8), 1.5)
        .when((value >= 50000) & (score >= 6), 1.3)
        .when((value >= 10000) & (score >= 4), 1.1)
        .otherwise(0.9)
    )
    return rows.select(
        "client_id",
        "segment",
        value.alias("current_value"),
        "engagement_score",
        boundary_diff("month", F.col("last_transaction"), _at(as_of)).alias("months_since_last_transaction"),
        (value * factor).alias("estimated_lifetime_value"),
    )


def churn_risk(tables: Tables, as_of: datetime, messages_as_of: datetime | None = None) -> DataFrame:
    """Churn risk from inactivity and engagement, with the messages of the last 30 days."""
    since = (messages_as_of or as_of) - timedelta(days=30)
    mails = tables["messages"].filter(F.col("sent_at") >= _at(since)).groupBy("client_id").agg(count_rows("_n"))
    scores = tables["engagement"].select("client_id", "engagement_score")
    rows = tables["clients"].filter("last_transaction IS NOT NULL").join(scores, "client_id", "left").join(mails, "client_id", "left")
    idle, score = boundary_diff("day", F.col("last_transaction"), _at(as_of)), F.col("engagement_score")
    # Bounds and labels.
    levels = [
        ((idle > 180) & (score.isNull() | (score < 4)), "HIGH_RISK"),
        ((idle > 90) & (score.isNull() | (score < 6)), "MEDIUM_RISK"),
        (idle > 30, "LOW_RISK"),
    ]
    return rows.select(
        "client_id",
        "segment",
        idle.alias("days_inactive"),
        "engagement_score",
        F.coalesce("_n", F.lit(0)).alias("recent_email_interactions"),
        label_when(levels, "ACTIVE").alias("churn_risk_level"),
    )


def campaign_roi(tables: Tables, as_of: datetime, days: int = 30) -> DataFrame:
    """Estimated revenue (100 per delivery) against points spent, per campaign."""
    recent = tables["messages"].filter(F.col("campaign_id").isNotNull() & (F.col("sent_at") >= _at(as_of - timedelta(days=days))))
    out = recent.groupBy("campaign_id").agg(
        count_rows("emails_sent"),
        F.sum("points").alias("campaign_cost"),
        (F.count_if(F.col("status") == "DELIVERED") * 100).alias("estimated_revenue"),
    )
    roi = F.when(F.col("campaign_cost") > 0, (F.col("estimated_revenue") - F.col("campaign_cost")) / F.col("campaign_cost"))
    return out.filter("emails_sent >= 1").withColumn("roi_ratio", F.coalesce(roi, F.lit(0.0)))


def cross_sell(tables: Tables) -> DataFrame:
    """Next offer per valuable, engaged customer."""
    marks = tables["engagement"].select("client_id", "engagement_score", "marketing_segment", "preference")
    rows = tables["clients"].filter("total_amount >= 10000").join(marks.filter("engagement_score >= 5"), "client_id")
    likes = F.col("preference")
    # Bounds and labels.
    offers = [
        ((F.col("segment") == "PREMIUM") & ~likes.contains("FINANCE"), "FINANCIAL_PRODUCTS"),
        ((F.col("total_amount") >= 50000) & ~likes.contains("LIFESTYLE"), "LIFESTYLE_SERVICES"),
        ((F.col("engagement_score") >= 7) & ~likes.contains("PREMIUM"), "PREMIUM_SERVICES"),
    ]
    return rows.select(
        "client_id",
        "segment",
        "total_amount",
        "marketing_segment",
        "preference",
        label_when(offers, "STANDARD_OFFERS").alias("cross_sell_opportunity"),
    )


def ab_comparison(tables: Tables, campaigns: list[str]) -> DataFrame:
    """Deliveries and average points of the compared campaigns."""
    delivered = F.count_if(F.col("status") == "DELIVERED")
    return (
        tables["messages"]
        .filter(F.col("campaign_id").isin(campaigns))
        .groupBy("campaign_id")
        .agg(
            count_rows("total_sends"),
            delivered.alias("deliveries"),
            F.avg("points").alias("avg_points"),
            _share(delivered, F.count(F.lit(1))).alias("delivery_rate"),
        )
    )


def journeys(tables: Tables) -> DataFrame:
    """Which of transaction, campaign response and mail came last, per customer."""
    mails = tables["messages"].groupBy("client_id").agg(F.max("sent_at").alias("mail"))
    responses = tables["engagement"].select("client_id", "last_response")
    rows = tables["clients"].filter("last_transaction IS NOT NULL").join(responses, "client_id", "left").join(mails, "client_id", "left")
    bought, answered, mail = F.col("last_transaction"), F.col("last_response"), F.col("mail")
    # Bounds and labels.
    kinds = [
        ((bought > answered) & (bought > mail), "TRANSACTION_DRIVEN"),
        ((answered > bought) & (answered > mail), "MARKETING_DRIVEN"),
        ((mail > bought) & (mail > answered), "EMAIL_DRIVEN"),
    ]
    return rows.select(
        "client_id",
        boundary_diff("day", bought, answered).alias("transaction_to_marketing_days"),
        boundary_diff("day", answered, mail).alias("marketing_to_email_days"),
        label_when(kinds, "MIXED_JOURNEY").alias("journey_type"),
    )


def monthly_revenue(sales: DataFrame, date: str, amount: str, state: str, done: str = "completed") -> DataFrame:
    """Completed sales per calendar month."""
    value = money(F.col(amount))
    return (
        sales.filter(F.col(state) == done)
        .groupBy(F.year(date).cast("long").alias("year"), F.month(date).cast("long").alias("month"))
        .agg(
            count_rows("transaction_count"),
            F.sum(value).cast("double").alias("total_revenue"),
            mean_amount(F.col(amount)).alias("avg_transaction_value"),
            F.max(amount).alias("max_transaction"),
            F.min(amount).alias("min_transaction"),
        )
    )


def segment_metrics(customers: DataFrame, sales: DataFrame, key: str, segment: str, amount: str, date: str, as_of: datetime) -> DataFrame:
    """Average sales, spend and recency of the customers of each segment."""
    per = sales.groupBy(key).agg(
        count_rows("_n"),
        F.sum(money(F.col(amount))).cast("double").alias("_spent"),
        mean_amount(F.col(amount)).alias("_mean"),
        boundary_diff("day", F.max(date), _at(as_of)).alias("_idle"),
    )
    rows = customers.filter(F.col(segment).isNotNull()).join(per, key, "left")
    return rows.groupBy(segment).agg(
        count_rows("customer_count"),
        F.avg(F.coalesce("_n", F.lit(0))).alias("avg_transactions_per_customer"),
        F.avg("_spent").alias("avg_lifetime_value"),
        F.avg("_mean").alias("avg_order_value"),
        F.avg("_idle").alias("avg_days_since_purchase"),
    )


def product_performance(products: DataFrame, sales: DataFrame, key: str, describe: list[str], quantity: str, amount: str) -> DataFrame:
    """Quantity, revenue, average price and number of sales per product.

    Sales are added up per product before the join, so a best-seller is one row there.
    """
    per = sales.groupBy(key).agg(
        F.sum(quantity).alias("total_quantity_sold"),
        F.sum(money(F.col(amount))).cast("double").alias("total_revenue"),
        F.avg(F.try_divide(amount, quantity)).alias("avg_selling_price"),
        count_rows("number_of_sales"),
    )
    return products.select(key, *describe).join(per, key)
