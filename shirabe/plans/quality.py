"""Data-quality, lineage, reconciliation, masking and audit operators."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shirabe.functions.jsonx import is_json, json_value
from shirabe.operators.aggregate import count_rows, mean_amount, pct


@dataclass(frozen=True)
class Rule:
    """A quality rule: rows meeting ``condition`` (a full boolean expression) are valid."""

    name: str
    condition: str
    threshold: float
    severity: str


def stack(row: DataFrame, parts: list[tuple[str, dict[str, Column]]], label: str) -> DataFrame:
    """Turn a one-row aggregate into one labelled row per part."""
    structs = [F.struct(F.lit(n).alias(label), *[c.alias(k) for k, c in cols.items()]) for n, cols in parts]
    return row.select(F.explode(F.array(*structs)).alias("_p")).select("_p.*")


def _rule_error(df: DataFrame, rule: Rule) -> str | None:
    """Why a rule cannot be planned on the table, None if it can."""
    try:
        df.select(F.expr(rule.condition).cast("boolean")).schema  # noqa: B018  planned, not run
    except AnalysisException as broken:
        return str(broken).strip().splitlines()[0]
    return None


def rule_counts(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row: all rows, and those that meet each rule, in one pass."""
    counts = [F.count_if(F.coalesce(F.expr(r.condition).cast("boolean"), F.lit(False))).alias(f"_v{i}") for i, r in enumerate(rules)]
    return df.agg(F.count(F.lit(1)).alias("_n"), *counts)


def _valid_rows(df: DataFrame, rules: list[Rule]) -> tuple[int, list[int]]:
    total, *valid = rule_counts(df, rules).first()
    return total, valid


def _counts(df: DataFrame, rules: list[Rule], errors: dict[str, str | None]) -> tuple[int | None, dict[str, int]]:
    """Rows and valid rows of each rule; a list that fails is halved until the broken rule stands alone."""
    try:
        total, counts = _valid_rows(df, rules)
        return total, {r.name: n for r, n in zip(rules, counts, strict=True)}
    except PySparkException as broken:
        if len(rules) == 1:
            errors[rules[0].name] = str(broken).strip().splitlines()[0]
        if len(rules) <= 1:
            return None, {}
    half = len(rules) // 2
    (first, some), (second, others) = _counts(df, rules[:half], errors), _counts(df, rules[half:], errors)
    return first if first is not None else second, {**some, **others}


def run_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """All rules in one pass: counts, score, whether the threshold is met, and the error of a rule that cannot be run.

    A rule that does not fit the table or fails on its rows has score 0 and its error; the
    others are scored all the same. A rule that fails while running costs two passes per halving of the list of rules.
    """
    errors = {r.name: _rule_error(df, r) for r in rules}
    total, valid = _counts(df, [r for r in rules if errors[r.name] is None], errors)
    if total is None:
        total = df.count()
    rows = []
    for r in rules:
        good = valid.get(r.name, 0)
        score = good * 100.0 / total if total else 0.0
        met = errors[r.name] is None and score >= r.threshold
        rows.append((r.name, total, good, total - good, score, met, r.severity, errors[r.name]))
    schema = (
        "rule_name string, total_records long, valid_records long, invalid_records long, quality_score double, "
        "threshold_met boolean, severity string, error_message string"
    )
    return df.sparkSession.createDataFrame(rows, schema)


def profile(df: DataFrame, as_of: datetime, patterns: dict[str, str] | None = None) -> DataFrame:
    """Column profile: nulls, distinct values, extremes, length, compliance and anomalies.

    Text: compliance with a pattern (100 without one) and whether one value fills
    more than half of the rows. Dates: future or older than ten years are anomalies.

    One scan: rows are unfolded to (column, value) and counted, each task sending a row per distinct value; everything else comes
    from these counts, so a pattern is tried once per distinct value, not once per row.
    """
    patterns = patterns or {}
    now = F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    old = F.lit(as_of.replace(year=as_of.year - 10).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    entries, kinds = [], []
    for i, field in enumerate(df.schema.fields):
        c, time = F.col(field.name), F.lit(None).cast("timestamp_ntz")
        text = isinstance(field.dataType, T.StringType)
        dated = isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
        if dated:
            time = c.cast("timestamp_ntz")
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            c = c + F.lit(0.0)  # a negative zero is a zero
        shown = F.to_json(F.struct(c.alias("v"))) if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.hex(c) if isinstance(field.dataType, T.BinaryType) else c.cast("string")
        shown = F.when(F.col(field.name).isNotNull(), shown)
        entries.append(F.struct(F.lit(i).alias("i"), F.when(F.lit(not dated), shown).alias("v"), time.alias("t")))
        kinds.append("text" if text else "date" if dated else "other")
    long = df.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")
    values = long.groupBy("i", "v", "t").agg(count_rows("n"))
    filled = F.col("v").isNotNull() | F.col("t").isNotNull()
    met = F.lit(None).cast("boolean")
    for i, field in enumerate(df.schema.fields):
        if kinds[i] == "text" and field.name in patterns:
            met = F.when(F.col("i") == i, F.col("v").rlike(patterns[field.name])).otherwise(met)
    shape = "yyyy-MM-dd HH:mm:ss"
    totals = values.groupBy("i").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(filled, F.col("n")).otherwise(0)).alias("filled"),
        F.count_if(filled).alias("distinct"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
        F.min("t").alias("first"),
        F.max("t").alias("last"),
        F.sum(F.col("n") * F.length("v")).alias("chars"),
        F.sum(F.when(met, F.col("n")).otherwise(0)).alias("met"),
        F.sum(F.when((F.col("t") > now) | (F.col("t") < old), F.col("n")).otherwise(0)).alias("odd"),
        F.max(F.when(filled, F.col("n"))).alias("top"),
    )
    # A table without rows still has its columns; the frame below has a row per column.
    names = [(i, f.name, kinds[i], f.name in patterns) for i, f in enumerate(df.schema.fields)]
    listed = df.sparkSession.createDataFrame(names, "i int, column_name string, kind string, checked boolean")
    out = listed.join(totals, "i", "left").na.fill(0, ["total", "filled", "distinct", "met", "odd"])
    text, dated = F.col("kind") == "text", F.col("kind") == "date"
    share = lambda part: F.coalesce(pct(part, F.col("filled")), F.lit(0.0))
    # More than half of the rows can hold for one value only.
    dominant = F.when(F.col("top") > F.col("total") * 0.5, 1).otherwise(0).cast("long")
    return out.select(
        "column_name",
        F.col("total").alias("total_records"),
        (F.col("total") - F.col("filled")).alias("null_count"),
        F.col("distinct").alias("distinct_count"),
        F.when(text, F.col("low")).when(dated, F.date_format("first", shape)).alias("min_value"),
        F.when(text, F.col("high")).when(dated, F.date_format("last", shape)).alias("max_value"),
        F.when(text, F.coalesce(F.try_divide("chars", "filled"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("avg_length"),
        F.when(text & F.col("checked"), share(F.col("met"))).when(dated, share(F.col("filled") - F.col("odd"))).otherwise(F.lit(100.0)).alias("pattern_compliance"),
        F.when(text, dominant).when(dated, F.col("odd")).otherwise(F.lit(0).cast("long")).alias("anomaly_count"),
    )


def dominant_values(df: DataFrame, columns: list[str], share: float = 0.5) -> DataFrame:
    """Per text column, how many values fill more than ``share`` of all rows.

    All columns are counted in one pass; a task sends one row per distinct value.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])
    long = df.select(F.explode(entries).alias("_e")).select("_e.*")
    counts = long.groupBy("column_name", "v").agg(count_rows("n"))
    totals = counts.groupBy("column_name").agg(
        F.sum("n").alias("total"), F.max(F.when(F.col("v").isNotNull(), F.col("n"))).alias("top")
    )
    # More than half of the rows can hold for one value only.
    return totals.select("column_name", F.when(F.col("top") > F.col("total") * share, 1).otherwise(0).cast("long").alias("dominant_values"))


def trace(steps: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """Rows before and after each step, and the share kept."""
    out = None
    for order, (name, before, after) in enumerate(steps, start=1):
        b = before.agg(count_rows("before_count"))
        a = after.agg(count_rows("after_count"))
        row = b.select(
            F.lit(order).cast("long").alias("step_order"), F.lit(name).alias("step_name"), "before_count", a.scalar().alias("after_count")
        )
        row = row.withColumn("retention_rate", F.coalesce(pct(F.col("after_count"), F.col("before_count")), F.lit(0.0)))
        out = row if out is None else out.unionAll(row)
    return out


def row_checks(df: DataFrame, required: list[str], checks: dict[str, Column]) -> DataFrame:
    """1/0 flags per row: all required columns filled, and each named check."""
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(c).isNotNull()
    flags = {"is_complete": complete.cast("int")}
    flags |= {n: F.coalesce(c, F.lit(False)).cast("int") for n, c in checks.items()}
    return df.withColumns(flags)


def integrity_summary(tables: dict[str, tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """One row per table and check: total rows and offending rows."""
    out = None
    for table, (df, checks) in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(f"_{n}") for n, c in checks.items()])
        parts = [(n, {"total_records": F.col("_n"), "bad_records": F.col(f"_{n}")}) for n in checks]
        part = stack(row, parts, "check_name").withColumn("table_name", F.lit(table))
        out = part if out is None else out.unionByName(part)
    return out


def type_check(df: DataFrame, keep: list[str], types: dict[str, str]) -> DataFrame:
    """'OK'/'ERROR' per column: NULL or castable to the type."""
    return df.select(
        *keep,
        *[
            F.when(F.col(c).isNull() | F.col(c).try_cast(t).isNotNull(), "OK").otherwise("ERROR").alias(f"{c}_format")
            for c, t in types.items()
        ],
    )


def rule_flags(df: DataFrame, keep: list[str], rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """Per rule the warning text where its condition holds, else 'OK'."""
    return df.select(*keep, *[F.when(c, w).otherwise("OK").alias(n) for n, (c, w) in rules.items()])


def orphans(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Number of rows of ``a`` with filled keys that have no match in ``b``."""
    filled = a.dropna(subset=on)
    return filled.join(b.select(*on), on, "left_anti").agg(count_rows("mismatch_count"))


def check_contract(df: DataFrame, expected: dict[str, str], keys: list[str], forbidden: list[str] = ()) -> DataFrame:
    """Layout and key check: one row per expected column with type match and key NULLs."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    nulls = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(k).isNull()).alias(f"_{k}") for k in keys])
    parts = []
    for name, dtype in expected.items():
        found = name in actual
        parts.append(
            (
                name,
                {
                    "present": F.lit(found),
                    "type_match": F.lit(found and actual[name] == dtype),
                    "allowed": F.lit(name not in forbidden),
                    "null_keys": F.col(f"_{name}") if name in keys else F.lit(0).cast("long"),
                    "total_records": F.col("_n"),
                    "column_count": F.lit(len(actual)).cast("long"),
                },
            )
        )
    return stack(nulls, parts, "column_name")


def stage_counts(stages: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows and distinct keys per stage."""
    out = None
    for name, df in stages.items():
        row = df.agg(count_rows("record_count"), F.countDistinct(key).alias("unique_keys"))
        row = row.withColumn("stage", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def assert_run(log: DataFrame, name: str, input_rows: int, output_rows: int, as_of: datetime) -> DataFrame:
    """PASS/FAIL of the newest run of the last hour against expected row counts."""
    since = F.lit((as_of - timedelta(hours=1)).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    recent = log.filter((F.col("name") == name) & (F.col("at") >= since))
    newest = recent.agg(F.max_by(F.struct("input_rows", "output_rows"), "at").alias("_r"))
    ok = F.coalesce((F.col("_r.input_rows") == input_rows) & (F.col("_r.output_rows") == output_rows), F.lit(False))
    return newest.select(
        F.lit(name).alias("name"),
        F.lit(input_rows).cast("long").alias("expected_input"),
        F.col("_r.input_rows").alias("actual_input"),
        F.lit(output_rows).cast("long").alias("expected_output"),
        F.col("_r.output_rows").alias("actual_output"),
        F.when(ok, "PASS").otherwise("FAIL").alias("validation_result"),
    )


def assert_min(df: DataFrame, name: str, least: int) -> DataFrame:
    """Whether a table has at least ``least`` rows."""
    return df.agg(count_rows("actual_count")).select(
        F.lit(name).alias("table_name"),
        "actual_count",
        F.lit(least).cast("long").alias("expected_count"),
        (F.col("actual_count") >= least).alias("validation_passed"),
    )


def json_quality(df: DataFrame, kind: str, text: str, key_paths: dict[str, str]) -> DataFrame:
    """Per kind: valid documents, documents with the key of their kind, empty ones, size, quality."""
    has_key = F.lit(False)
    for value, path in key_paths.items():
        has_key = has_key | ((F.col(kind) == value) & json_value(F.col(text), path).isNotNull())
    valid = F.count_if(is_json(F.col(text)))
    return df.groupBy(kind).agg(
        count_rows("total_records"),
        valid.alias("valid_records"),
        F.count_if(has_key).alias("records_with_id"),
        F.count_if(F.coalesce(F.length(text) > 0, F.lit(False))).alias("non_empty_records"),
        F.avg(F.length(text)).alias("avg_data_size"),
        pct(valid, F.count(F.lit(1))).alias("quality_percentage"),
    )


def stage_summary(df: DataFrame, kind: str, text: str) -> DataFrame:
    """Extract / transform / load counts per kind with their status, from one pass."""
    counts = df.groupBy(kind).agg(count_rows("_n"), F.count_if(is_json(F.col(text))).alias("_ok"))
    state = F.when(F.col("_ok") == F.col("_n"), "SUCCESS").otherwise("PARTIAL_SUCCESS")
    stages = [("EXTRACTION", "_n", F.lit("SUCCESS")), ("TRANSFORMATION", "_ok", state), ("LOADING", "_ok", F.lit("SUCCESS"))]
    entries = [
        F.struct(F.lit(s).alias("stage"), F.lit(i).alias("stage_order"), F.col(c).alias("record_count"), st.alias("status"))
        for i, (s, c, st) in enumerate(stages, start=1)
    ]
    return counts.select(kind, F.explode(F.array(*entries)).alias("_s")).select(kind, "_s.*")


# Patterns of leaked personal data.
LEAKS = {
    "card": r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"\b0\d{1,3}-\d{4}-\d{4}\b",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
}


# A text without this mark cannot match, and looking for it is far cheaper than the pattern.
MARKS = {"email": "@", "ssn": "-", "phone": "-"}


def scan_pii(df: DataFrame, columns: list[str], patterns: dict[str, str] = LEAKS, marks: dict[str, str] | None = None) -> DataFrame:
    """Per column and pattern: rows with a hit and hits in all, over the whole text, in one pass.

    ``marks`` names a text that every match of a pattern holds; by default only the default patterns have one.
    """
    marks = marks if marks is not None else MARKS if patterns is LEAKS else {}

    def count(column: str, name: str, pattern: str) -> Column:
        hits = F.regexp_count(F.col(column), F.lit(pattern))
        return F.when(F.col(column).contains(marks[name]), hits).otherwise(0) if name in marks else hits

    scans = {f"{c}:{name}": count(c, name, p).alias(f"_{i}_{j}") for i, c in enumerate(columns) for j, (name, p) in enumerate(patterns.items())}
    # Each pattern runs once per text; the aggregate below reads its count twice.
    counted = df.select(*columns).select(*scans.values())
    names = dict(zip(scans, counted.columns))
    aggs = [F.count(F.lit(1)).alias("_n")]
    parts = []
    for scan, c in names.items():
        aggs += [F.count_if(F.col(c) > 0).alias(f"_r{c}"), F.sum(c).cast("long").alias(f"_h{c}")]
        hits = F.coalesce(F.col(f"_h{c}"), F.lit(0).cast("long"))
        parts.append((scan, {"total_records": F.col("_n"), "rows_with_hits": F.col(f"_r{c}"), "hits": hits}))
    return stack(counted.agg(*aggs), parts, "scan")


def protection_status(text: Column) -> Column:
    """MASKED, ENCRYPTED or PLAIN by the marks a protected value carries."""
    return F.when(text.contains("***"), "MASKED").when(text.startswith("ENC_"), "ENCRYPTED").otherwise("PLAIN")


def retention_report(tables: dict[str, tuple[DataFrame, str]], as_of: datetime, years: tuple[int, ...] = (2, 5)) -> DataFrame:
    """Rows older than each number of years, per table."""
    out = None
    for name, (df, ts) in tables.items():
        old = [
            F.count_if(F.col(ts) < F.lit(as_of.replace(year=as_of.year - y).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")).alias(f"old_records_{y}y")
            for y in years
        ]
        row = df.filter(F.col(ts).isNotNull()).agg(count_rows("total_records"), *old).withColumn("table_name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def lineage_summary(tables: dict[str, tuple[DataFrame, Column, str]]) -> DataFrame:
    """Rows, first and last time per target table and source."""
    out = None
    for name, (df, source, ts) in tables.items():
        part = (
            df.filter(F.col(ts).isNotNull())
            .groupBy(source.alias("data_source"))
            .agg(count_rows("record_count"), F.min(ts).alias("earliest_processed"), F.max(ts).alias("latest_processed"))
            .withColumn("target_table", F.lit(name))
        )
        out = part if out is None else out.unionByName(part)
    return out


def reconcile_counts(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """Source against target row count: relative difference within tolerance, nothing lost entirely."""
    row = a.agg(count_rows("source_count")).withColumn("target_count", b.agg(count_rows("_n")).scalar())
    ratio = F.when(
        F.col("source_count") > 0, F.abs(F.col("source_count") - F.col("target_count")) / F.col("source_count")
    ).otherwise(F.lit(0.0))
    return row.withColumns(
        {
            "diff_ratio": ratio,
            "within_tolerance": ratio <= tolerance,
            "no_data_loss": (F.col("source_count") == 0) | (F.col("target_count") > 0),
        }
    )


def visible_to(df: DataFrame, users: DataFrame, grants: DataFrame, row_id: str, owner: str, rank: str) -> DataFrame:
    """(user, row) pairs a user may read among rows granted to them or owned by them.

    ``users`` has user_id and clearance, ``grants`` user_id and the row id. Owner and
    grants give the candidate pairs by equi joins; the clearance then filters them.
    """
    owned = df.select(F.col(owner).alias("user_id"), row_id, rank)
    shared = grants.join(df.select(row_id, rank), row_id).select("user_id", row_id, rank)
    pairs = owned.unionByName(shared).distinct()
    return pairs.join(users, "user_id").filter(F.col("clearance") >= F.col(rank)).select("user_id", row_id, rank, "clearance")


def access_audit(log: DataFrame, user: str, ts: str, granted: Column, resource: str, as_of: datetime, days: int = 1) -> DataFrame:
    """Attempts, successes and distinct resources per user over the trailing days."""
    since = F.lit((as_of - timedelta(days=days)).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    return (
        log.filter(F.col(ts) >= since)
        .groupBy(user)
        .agg(
            count_rows("access_attempts"),
            F.count_if(granted).alias("successful_access"),
            F.countDistinct(resource).alias("unique_resources"),
        )
    )


def score_trend(results: DataFrame, rule: str, score: str, passed: Column, ts: str, as_of: datetime, days: int = 7) -> DataFrame:
    """Average score, runs and passed runs per rule over the trailing days."""
    since = F.lit((as_of - timedelta(days=days)).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    return (
        results.filter(F.col(ts) >= since)
        .groupBy(rule)
        .agg(F.avg(score).alias("avg_quality_score"), count_rows("total_executions"), F.count_if(passed).alias("passed_count"))
    )


def ops_summary(log: DataFrame, stage: str, state: str, states: dict[str, str], cost: str, ts: str) -> DataFrame:
    """Tasks per stage and state, with cost and last time."""
    return log.groupBy(stage).agg(
        count_rows("total_tasks"),
        *[F.count_if(F.col(state) == value).alias(name) for value, name in states.items()],
        mean_amount(F.col(cost)).alias("avg_cost"),
        F.max(cost).alias("max_cost"),
        F.max(ts).alias("last_occurrence"),
    )


def error_summary(log: DataFrame, kinds: list[str], ts: str) -> DataFrame:
    """Errors per kind with their last time."""
    return log.groupBy(*kinds).agg(count_rows("error_count"), F.max(ts).alias("last_occurrence"))


def pattern_counts(scans: dict[str, tuple[DataFrame, str, Column, Column]]) -> DataFrame:
    """Per data type: filled values and how many match each of two patterns."""
    out = None
    for name, (df, column, first, second) in scans.items():
        row = (
            df.filter(F.col(column).isNotNull())
            .agg(count_rows("total_count"), F.count_if(first).alias("first_pattern"), F.count_if(second).alias("second_pattern"))
            .withColumn("data_type", F.lit(name))
        )
        out = row if out is None else out.unionByName(row)
    return out
