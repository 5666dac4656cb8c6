"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shirabe.catalog import roles
from shirabe.catalog.registry import Tables, query
from shirabe.functions import dates, jsonx, text

FORMS = 6


def by_form(key: Column, forms: list[Column]) -> Column:
    """One of several written forms, by key."""
    out = forms[-1]
    for i, form in enumerate(forms[:-1]):
        out = F.when(key % len(forms) == i, form).otherwise(out)
    return out


@query(
    "fn_strings",
    """SELECT c_custkey, upper(c_mktsegment) AS upper_seg, length(c_name) AS name_length, left(c_name, 4) AS prefix,
              right(c_name, 3) AS suffix, c_name || '/' || c_mktsegment AS joined,
              concat(c_name, NULLIF(c_mktsegment, 'BUILDING')) AS skipping_null,
              replace(c_mktsegment, 'BUILDING', '99991231') AS replaced FROM customer""",
)
def fn_strings(t: Tables) -> DataFrame:
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    return t.customer.select(
        "c_custkey",
        F.upper(seg).alias("upper_seg"),
        F.length(F.rtrim(name)).cast("long").alias("name_length"),
        F.left(name, F.lit(4)).alias("prefix"),
        F.right(name, F.lit(3)).alias("suffix"),
        F.concat(name, F.lit("/"), seg).alias("joined"),
        F.concat_ws("", name, F.nullif(seg, F.lit("BUILDING"))).alias("skipping_null"),
        F.replace(seg, F.lit("BUILDING"), F.lit("99991231")).alias("replaced"),
    )


@query("fn_zero_pad", "SELECT o_orderkey, right('000000' || CAST(o_orderkey AS VARCHAR), 6) AS padded FROM orders")
def fn_zero_pad(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", text.zero_pad(F.col("o_orderkey"), 6).alias("padded"))


_SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(
    "fn_cleanse",
    f"""SELECT doc_id, translate(trim(regexp_replace('　 ' || text || ' ０９０－１２３４　', '{_SPACES}', ' ', 'g')),
               '０１２３４５６７８９－', '0123456789-') AS cleansed FROM documents""",
)
def fn_cleanse(t: Tables) -> DataFrame:
    dirty = F.concat(F.lit("　 "), F.col("text"), F.lit(" ０９０－１２３４　"))
    return t.documents.select("doc_id", text.cleanse(dirty).alias("cleansed"))


@query(
    "fn_phone",
    """WITH p AS (SELECT c_custkey, '090' || lpad(CAST(c_custkey % 100000000 AS VARCHAR), 8, '0') AS d FROM customer),
       q AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN d WHEN 1 THEN left(d, 3) || '-' || substr(d, 4, 4) || '-' || substr(d, 8)
         WHEN 2 THEN left(d, 3) || ' ' || substr(d, 4, 4) || ' ' || substr(d, 8) WHEN 3 THEN '+81-' || d
         WHEN 4 THEN '03-1234-5678' ELSE NULL END AS phone, d FROM p)
       SELECT c_custkey, phone, CASE WHEN c_custkey % 6 < 4 THEN left(d, 3) || '-' || substr(d, 4, 4) || '-' || substr(d, 8) END AS normal FROM q""",
)
def fn_phone(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    d = F.concat(F.lit("090"), F.lpad((key % 100000000).cast("string"), 8, "0"))
    a, b, c = F.left(d, F.lit(3)), F.substring(d, 4, 4), F.substring(d, 8, 4)
    forms = [
        d,
        F.concat_ws("-", a, b, c),
        F.concat_ws(" ", a, b, c),
        F.concat(F.lit("+81-"), d),
        F.lit("03-1234-5678"),
        F.lit(None).cast("string"),
    ]
    written = t.customer.select("c_custkey", by_form(key, forms).alias("phone"))
    return written.withColumn("normal", text.phone_jp(F.col("phone")))


@query(
    "fn_parse_dates",
    """WITH w AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y/%m/%d')
         WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y')
         WHEN 3 THEN strftime(o_orderdate, '%d-%b-%Y') WHEN 4 THEN strftime(o_orderdate, '%Y年%m月%d日')
         ELSE '2023-02-' || CAST(20 + o_orderkey % 12 AS VARCHAR) END AS written FROM orders)
       SELECT o_orderkey, strftime(coalesce(try_strptime(written, '%Y/%m/%d'), try_strptime(written, '%Y-%m-%d'),
         try_strptime(written, '%m/%d/%Y'), try_strptime(written, '%d-%b-%Y'), try_strptime(written, '%Y年%m月%d日')), '%Y-%m-%d') AS iso FROM w""",
)
def fn_parse_dates(t: Tables) -> DataFrame:
    key, d = F.col("o_orderkey"), "o_orderdate"
    forms = [
        F.date_format(d, "yyyy/MM/dd"),
        F.date_format(d, "yyyy-MM-dd"),
        F.date_format(d, "MM/dd/yyyy"),
        F.date_format(d, "dd-MMM-yyyy"),
        F.date_format(d, "yyyy年MM月dd日"),
        F.concat(F.lit("2023-02-"), (20 + key % 12).cast("string")),
    ]
    return t.orders.select("o_orderkey", dates.parse_date_any(by_form(key, forms)).alias("iso"))


@query(
    "fn_convert_unit",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, round(l_quantity * CASE l_linenumber % 5 WHEN 0 THEN 0.001::DOUBLE
              WHEN 1 THEN 0.001::DOUBLE WHEN 2 THEN 0.01::DOUBLE WHEN 3 THEN 1.0::DOUBLE / 3600 ELSE 1.0::DOUBLE END, 6) AS converted FROM lineitem""",
)
def fn_convert_unit(t: Tables) -> DataFrame:
    pairs = [("g", "kg"), ("m", "km"), ("cm", "m"), ("seconds", "hours"), ("litre", "gallon")]
    n = F.col("l_linenumber")
    src, dst = by_form(n, [F.lit(a) for a, _ in pairs]), by_form(n, [F.lit(b) for _, b in pairs])
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        F.round(text.convert_unit(F.col("l_quantity"), src, dst), 6).alias("converted"),
    )


@query(
    "fn_encode",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 0 END AS grade,
              CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 0 END
              + CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 0 END AS composite FROM orders""",
)
def fn_encode(t: Tables) -> DataFrame:
    grade = text.encode(F.col("o_orderstatus"), {"F": 3, "O": 2})
    level = text.encode(F.col("o_orderpriority"), {"1-URGENT": 3, "2-HIGH": 2})
    return t.orders.select("o_orderkey", grade.alias("grade"), (grade + level).alias("composite"))


@query(
    "fn_fill_blank",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 1, 2) THEN 'Unknown' ELSE c_mktsegment END AS segment FROM customer""",
)
def fn_fill_blank(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    raw = F.when(key % 5 == 0, None).when(key % 5 == 1, "").when(key % 5 == 2, "N/A").otherwise(F.col("c_mktsegment"))
    return t.customer.select("c_custkey", text.fill_blank(raw, "Unknown").alias("segment"))


@query("fn_clamp", "SELECT c_custkey, least(greatest(c_acctbal, 0.0::DOUBLE), 120.0::DOUBLE) AS clamped FROM customer")
def fn_clamp(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", text.clamp(F.col("c_acctbal"), 0.0, 120.0).alias("clamped"))


@query(
    "fn_dates",
    """SELECT event_id, date_diff('second', TIMESTAMP '2024-01-01 00:00:00.5', ts) AS d_second,
              date_diff('minute', TIMESTAMP '2023-12-31 23:59:59', ts) AS d_minute,
              date_diff('hour', TIMESTAMP '2023-12-31 23:59:59', ts) AS d_hour, date_diff('day', ts, TIMESTAMP '2024-01-31') AS d_day,
              date_diff('month', TIMESTAMP '2023-10-31', ts) AS d_month, date_diff('year', TIMESTAMP '2021-12-31', ts) AS d_year,
              strftime(last_day(ts), '%Y-%m-%d') AS month_end, strftime(ts + INTERVAL 30 DAY, '%Y/%m/%d') AS later,
              strftime(ts - INTERVAL 2 MONTH, '%Y%m%d') AS earlier, year(ts) AS y, month(ts) AS m, hour(ts) AS h FROM events""",
)
def fn_dates(t: Tables) -> DataFrame:
    ts = F.col("ts")

    def at(s: str) -> Column:
        return F.lit(s).cast("timestamp_ntz")

    return t.events.select(
        "event_id",
        dates.boundary_diff("second", at("2024-01-01 00:00:00.5"), ts).alias("d_second"),
        dates.boundary_diff("minute", at("2023-12-31 23:59:59"), ts).alias("d_minute"),
        dates.boundary_diff("hour", at("2023-12-31 23:59:59"), ts).alias("d_hour"),
        dates.boundary_diff("day", ts, at("2024-01-31 00:00:00")).alias("d_day"),
        dates.boundary_diff("month", at("2023-10-31 00:00:00"), ts).alias("d_month"),
        dates.boundary_diff("year", at("2021-12-31 00:00:00"), ts).alias("d_year"),
        F.date_format(F.last_day(ts), "yyyy-MM-dd").alias("month_end"),
        F.date_format(F.date_add(ts, 30), "yyyy/MM/dd").alias("later"),
        F.date_format(F.add_months(ts, -2), "yyyyMMdd").alias("earlier"),
        F.year(ts).cast("long").alias("y"),
        F.month(ts).cast("long").alias("m"),
        F.hour(ts).cast("long").alias("h"),
    )


@query("fn_to_jst", "SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y/%m/%d %H:%M:%S') AS tokyo FROM events")
def fn_to_jst(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.date_format(dates.to_jst(F.col("ts")), "yyyy/MM/dd HH:mm:ss").alias("tokyo"))


@query(
    "fn_time_bucket",
    """SELECT event_id, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS five,
              time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01') AS ten FROM events""",
)
def fn_time_bucket(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.events.select("event_id", dates.bucket_start(ts, 5).alias("five"), dates.bucket_start(ts, 10).alias("ten"))


@query(
    "fn_math",
    """SELECT o_orderkey, round(o_totalprice, 1) AS rounded, abs(100000 - o_totalprice) AS away, o_orderkey % 7 AS remainder,
              o_orderkey // 7 AS quotient, CAST(CAST(o_totalprice AS DECIMAL(10,2)) AS VARCHAR) AS exact FROM orders""",
)
def fn_math(t: Tables) -> DataFrame:
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey",
        F.round(price, 1).alias("rounded"),
        F.abs(100000 - price).alias("away"),
        (key % 7).alias("remainder"),
        F.expr("o_orderkey div 7").alias("quotient"),
        price.cast("decimal(10,2)").cast("string").alias("exact"),
    )


@query(
    "fn_safe_cast",
    """WITH d AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN c_name
         WHEN 2 THEN '2024-02-30' ELSE '2024-02-29' END AS raw FROM customer)
       SELECT c_custkey, try_cast(raw AS BIGINT) AS as_int, strftime(try_cast(raw AS DATE), '%Y-%m-%d') AS as_date,
              CASE WHEN raw IN ('0', '1') THEN raw = '1' END AS as_flag FROM d""",
)
def fn_safe_cast(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    raw = by_form(key, [key.cast("string"), F.col("c_name"), F.lit("2024-02-30"), F.lit("2024-02-29")])
    rows = t.customer.select("c_custkey", raw.alias("raw"))
    c = F.col("raw")
    return rows.select(
        "c_custkey",
        text.safe_cast(c, "bigint").alias("as_int"),
        F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.safe_cast(c, "date")).cast("string").alias("as_date"),
        text.safe_cast(c, "boolean").alias("as_flag"),
    )


@query(
    "fn_json",
    f"""WITH {roles.DOCUMENTS_JSON} SELECT id, coalesce(json_valid(data_json) AND left(ltrim(data_json), 1) IN ('{{', '['), false) AS is_json,
        CASE WHEN json_valid(data_json) THEN json_extract_string(data_json, '$.order_id') END AS order_id,
        CASE WHEN json_valid(data_json) THEN try_cast(json_extract_string(data_json, '$.data.k') AS BIGINT) END AS k FROM raw""",
)
def fn_json(t: Tables) -> DataFrame:
    doc = F.col("data_json")
    valid = F.try_parse_json(doc).isNotNull()
    return roles.documents_json(t).select(
        "id",
        jsonx.is_json(doc).alias("is_json"),
        F.when(valid, jsonx.json_value(doc, "$.order_id")).alias("order_id"),
        F.when(valid, jsonx.json_amount(doc, "$.data.k", "bigint")).alias("k"),
    )


@query(
    "fn_flatten_json",
    """WITH d AS (SELECT event_id, '{"customer": {"id": ' || CAST(user_id AS VARCHAR) || ', "kind": "' || event_type
              || '", "orders": [' || props || ', ' || props || ', 7]}}' AS doc FROM events)
       SELECT event_id, 'customer.id' AS path, CAST(json_extract(doc, '$.customer.id') AS VARCHAR) AS value FROM d
       UNION ALL SELECT event_id, 'customer.kind', json_extract_string(doc, '$.customer.kind') FROM d
       UNION ALL SELECT event_id, 'customer.orders[0].k', json_extract_string(doc, '$.customer.orders[0].k') FROM d
       UNION ALL SELECT event_id, 'customer.orders[1].k', json_extract_string(doc, '$.customer.orders[1].k') FROM d
       UNION ALL SELECT event_id, 'customer.orders[2]', json_extract_string(doc, '$.customer.orders[2]') FROM d""",
)
def fn_flatten_json(t: Tables) -> DataFrame:
    doc = F.format_string(
        '{"customer": {"id": %d, "kind": "%s", "orders": [%s, %s, 7]}}', "user_id", "event_type", "props", "props"
    )
    return jsonx.flatten_json(t.events.select("event_id", doc.alias("doc")), "event_id", "doc")


@query(
    "fn_validators",
    r"""WITH v AS (SELECT c_custkey,
         CASE c_custkey % 5 WHEN 0 THEN 'member' || CAST(c_custkey AS VARCHAR) || '@mail.example.net' WHEN 1 THEN 'no-at-sign.example'
           WHEN 2 THEN '@nobody.example' WHEN 3 THEN 'half@' ELSE NULL END AS mail,
         CASE c_custkey % 5 WHEN 0 THEN '080-2345-6789' WHEN 1 THEN '+81-80-2345-6789' WHEN 2 THEN '080-234-567'
           WHEN 3 THEN 'xyz-uvwx-rstu' ELSE NULL END AS phone,
         CASE c_custkey % 5 WHEN 0 THEN '2021-02-29' WHEN 1 THEN '2020-02-29' WHEN 2 THEN '2021-13-05' WHEN 3 THEN '1985-06-07' ELSE NULL END AS day,
         CASE c_custkey % 5 WHEN 0 THEN ' 　' WHEN 1 THEN NULL ELSE c_name END AS name, c_acctbal FROM customer)
       SELECT c_custkey, coalesce(regexp_matches(mail, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$'), false) AS mail_ok,
         coalesce(regexp_matches(phone, '^\d{2,4}-\d{4}-\d{4}$') OR regexp_matches(phone, '^\+\d{1,3}-\d{2,4}-\d{4}-\d{4}$'), false) AS phone_ok,
         try_strptime(day, '%Y-%m-%d') IS NOT NULL AS day_ok, c_acctbal BETWEEN 0 AND 5000 AS amount_ok,
         c_custkey % 5 NOT IN (0, 1) AND mail IS NOT NULL AS required_ok FROM v""",
)
def fn_validators(t: Tables) -> DataFrame:
    key, none = F.col("c_custkey"), F.lit(None).cast("string")
    mails = [F.concat(F.lit("member"), key.cast("string"), F.lit("@mail.example.net")), F.lit("no-at-sign.example"), F.lit("@nobody.example"), F.lit("half@"), none]
    phones = [F.lit("080-2345-6789"), F.lit("+81-80-2345-6789"), F.lit("080-234-567"), F.lit("xyz-uvwx-rstu"), none]
    days = [F.lit("2021-02-29"), F.lit("2020-02-29"), F.lit("2021-13-05"), F.lit("1985-06-07"), none]
    names = [F.lit(" 　"), none, F.col("c_name"), F.col("c_name"), F.col("c_name")]
    rows = t.customer.select(
        "c_custkey",
        "c_acctbal",
        by_form(key, mails).alias("mail"),
        by_form(key, phones).alias("phone"),
        by_form(key, days).alias("day"),
        by_form(key, names).alias("name"),
    )
    return rows.select(
        "c_custkey",
        text.is_email(F.col("mail")).alias("mail_ok"),
        text.is_phone(F.col("phone")).alias("phone_ok"),
        dates.is_date(F.col("day")).alias("day_ok"),
        text.in_range(F.col("c_acctbal"), 0, 5000).alias("amount_ok"),
        text.has_required(rows, ["name", "mail"]).alias("required_ok"),
    )


@query(
    "fn_masks",
    f"""WITH {roles.MEMBERS} SELECT member_id, left(segment, 1) || repeat('*', length(segment) - 1) AS name,
        left(mail, 1) || repeat('*', position('@' IN mail) - 2) || substr(mail, position('@' IN mail)) AS mail,
        '090-****-' || lpad(CAST(customer_no % 10000 AS VARCHAR), 4, '0') AS phone,
        '************' || lpad(CAST(customer_no % 10000 AS VARCHAR), 4, '0') AS card FROM members""",
)
def fn_masks(t: Tables) -> DataFrame:
    tail = F.lpad((F.col("customer_no") % 10000).cast("string"), 4, "0")
    return roles.members(t).select(
        "member_id",
        text.mask_name(F.col("segment")).alias("name"),
        text.mask_email(F.col("mail")).alias("mail"),
        text.mask_phone(F.concat(F.lit("090-1234-"), tail)).alias("phone"),
        text.mask_card(F.concat(F.lit("123456789012"), tail)).alias("card"),
    )
