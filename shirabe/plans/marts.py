"""Mart builds: usage at member grain, unified customer mart, flags, member master, JSON feed, wide copy."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shirabe.operators.aggregate import collapse_flags, flag_pivot
from shirabe.operators.project import label_when, nest, null_columns, project_mapping, slot_lookup, stamp, stringify
from shirabe.operators.window import dedupe_except, latest_per_key

Tables = dict[str, DataFrame]

SLOT_TYPES = ["key_type1", "key_type2", "key_type3"]
SLOT_KEYS = ["service_key1", "service_key2", "service_key3"]


def usage_by_member(tables: Tables) -> DataFrame:
    """Usage services at member grain with the keys taken out of their slots.

    Rows of identified members lose repeats that differ in the update flag only,
    get member and unified customer, and count only if their newest row is active.
    """
    members = tables["member_keys"].select("index_id", "member_id")
    latest = (
        tables["usage"].join(members.select("index_id"), "index_id", "left_semi").filter("user_key_type NOT IN ('017', '011')")
    )
    unique = dedupe_except(latest, ["update_flag", "amount"], ["update_flag", F.col("amount").asc()])
    # Member and unified customer are the same for all rows of an index, so the
    # newest row can be chosen before they are joined.
    moving = ["transfer_ymd", "transfer_type", "amount"]
    keys = [c for c in unique.columns if c not in moving]
    current = latest_per_key(unique, keys, ["transfer_ymd", "transfer_type"], ["amount"]).filter("transfer_type = '02'")
    bx = tables["bx_keys"].select("index_id", "bx")
    current = current.join(members, "index_id").join(bx, "index_id", "left")
    return current.select(
        "bx",
        "member_id",
        "index_id",
        slot_lookup("001", SLOT_TYPES, SLOT_KEYS).alias("key_1x"),
        F.when(F.col("user_key_type") == "003", F.col("user_key")).alias("key_3x"),
        slot_lookup("004", SLOT_TYPES, SLOT_KEYS).alias("key_4x"),
        slot_lookup("007", SLOT_TYPES, SLOT_KEYS).alias("sa_id"),
        "service_type",
        "transfer_ymd",
    )


def unified_customer_mart(tables: Tables) -> DataFrame:
    """Customer mart with unified customer ids; unmatched customers stay.

    Gas customers match by gas contract, others by registration number and
    electricity contract; one usage record per customer and key, the newest.
    """
    usage = tables["usage"].filter("transfer_type = '02'")
    dates = ["output_date", "transfer_ymd"]
    gas = usage.filter("service_type = '001'").select(
        "bx", slot_lookup("004", SLOT_TYPES, SLOT_KEYS).alias("key_4x"), "index_id", *dates
    )
    gas = latest_per_key(gas, ["bx", "key_4x"], dates, ["index_id"])
    power = usage.filter("service_type = '006' AND user_key_type = '003'").select(
        "bx",
        F.col("user_key").alias("key_3x"),
        slot_lookup("007", SLOT_TYPES, SLOT_KEYS).alias("sa_id"),
        "index_id",
        *dates,
    )
    power = latest_per_key(power, ["bx", "key_3x", "sa_id"], dates, ["index_id"])

    mart = tables["mart"]
    with_gas = mart.filter("key_4x IS NOT NULL").join(gas, "key_4x", "left")
    rest = mart.filter("key_4x IS NULL").withColumn("_sa", F.coalesce("lighting_sa", "power_sa"))
    found = power.withColumnsRenamed({"key_3x": "_3x", "sa_id": "_sa_id"})
    on = (rest["key_3x"] == found["_3x"]) & (rest["_sa"] == found["_sa_id"])
    without = rest.join(found, on, "left").drop("_sa", "_3x", "_sa_id")
    return with_gas.unionByName(without)


def contract_flags(tables: Tables) -> DataFrame:
    """1 per contract kind and member branch: gas, and gas with electricity."""
    owners = tables["contracts"].select("member_id", "branch_no", "reg_no")
    gas_keys = tables["gas"].select("reg_no").distinct()
    bundled = tables["power"].filter("contract_type IN ('ESLVY', 'ESOLY')").select("reg_no").distinct()
    has_gas = owners.join(gas_keys, "reg_no", "left_semi")
    gas = has_gas.select("member_id", "branch_no", F.lit(1).alias("internal_gas"))
    both = has_gas.join(bundled, "reg_no", "left_semi").select("member_id", "branch_no", F.lit(1).alias("gas_and_power"))
    merged = collapse_flags([gas, both], ["member_id", "branch_no"])
    return null_columns(merged, {"external_gas": "int", "external_gas_and_power": "int", "power": "int"})


def contract_presence(usage: DataFrame, member: str) -> DataFrame:
    """'1'/'0' per service kind and member over active services, with the contract class."""
    codes = {"001": "internal_area_gas", "010": "external_area_gas", "006": "power"}
    flags = flag_pivot(usage.filter("transfer_type = '02'"), [member], "service_type", codes)
    gas, power = F.col("internal_area_gas") == "1", F.col("power") == "1"
    # Bounds and labels.
    kinds = [(gas & power, "GAS_POWER"), (gas, "GAS_ONLY"), (power, "POWER_ONLY")]
    return flags.filter(F.col(member).isNotNull()).withColumn("contract_type", label_when(kinds, "NO_CONTRACT"))


def presence_counts(presence: DataFrame) -> DataFrame:
    """Validation counts of the contract presence table."""
    gas, out, power = [F.col(c) == "1" for c in ("internal_area_gas", "external_area_gas", "power")]
    return presence.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(gas).alias("internal_gas_contracts"),
        F.count_if(out).alias("external_gas_contracts"),
        F.count_if(power).alias("power_contracts"),
        F.count_if(gas & power).alias("gas_power_combined"),
    )


def contract_score_feed(df: DataFrame, user: str, contract: dict[str, Column], score: dict[str, Column]) -> DataFrame:
    """(user_id, contract{…}, score{…}) documents."""
    return nest(df.withColumnRenamed(user, "user_id"), ["user_id"], {"contract": contract, "score": score})


def contract_score_text(df: DataFrame, user: str, flags: list[str], texts: list[str], scores: dict[str, str | None]) -> DataFrame:
    """The same documents with every field as text, missing ones as ``Null``."""
    typed = df.withColumns({c: F.col(c).try_cast("boolean") for c in flags})
    shown = stringify(typed, {**{c: None for c in flags + texts}, **scores})
    return nest(
        shown.withColumnRenamed(user, "user_id"),
        ["user_id"],
        {"contract": {c: F.col(c) for c in flags + texts}, "score": {c: F.col(c) for c in scores}},
    )


def member_master(tables: Tables, as_of: datetime) -> DataFrame:
    """Member type, active chat links and contract flag per member."""
    kinds = tables["member_types"].groupBy("member_id").agg(F.max("type_code").alias("type_code"))
    live = F.col("cancelled") == "0"
    links = (
        tables["links"]
        .filter("state = '有効'")
        .groupBy("member_id")
        .agg(
            F.max(F.when(live, F.col("link_id"))).alias("link_id"),
            F.max(F.when(live, F.col("linked_on"))).alias("linked_on"),
            F.count_if(live).alias("link_count"),
        )
    )
    rows = kinds.filter("member_id IS NOT NULL").join(links, "member_id", "left")
    return stamp(rows.join(tables["flags"], "member_id", "left"), as_of, process_datetime="%Y/%m/%d %H:%M:%S")


def wide_copy(
    df: DataFrame, mapping: dict[str, str], retired: dict[str, str], layout: list[str], recast: dict[str, str] | None = None
) -> DataFrame:
    """Wide mart in a fixed layout: renamed live columns, some of another type, typed NULLs for retired ones, one select each."""
    filled = null_columns(project_mapping(df, mapping), retired)
    types = recast or {}
    return filled.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in layout])
