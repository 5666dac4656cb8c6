"""Incremental loads, histories and keyed table changes, as frame-to-frame functions."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shirabe.functions.dates import jst
from shirabe.operators.window import latest_per_key, number_rows
from shirabe.session import stored


def _side_by_side(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on keys in which NULL equals NULL: each table once, its row as a struct ``_t`` or ``_s``."""
    left = target.select(F.struct(*target.columns).alias("_t"), *[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)])
    right = source.select(F.struct(*source.columns).alias("_s"), *[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)])
    on = [F.col(f"_t{i}").eqNullSafe(F.col(f"_s{i}")) for i in range(len(keys))]
    return left.join(right, reduce(lambda a, b: a & b, on), "full")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: list[Column | str] = ()) -> DataFrame:
    """Matched keys take the source row, new keys are added.

    Of source rows of one key the first under ``order`` counts (columns falling; the
    other columns break ties). A NULL key is a key like any other.
    """
    joined = _side_by_side(target, latest_per_key(source, keys, list(order)), keys)
    given = F.col("_s").isNotNull()
    return joined.select(*[F.when(given, F.col(f"_s.{c}")).otherwise(F.col(f"_t.{c}")).alias(c) for c in target.columns])


def update_from(
    target: DataFrame, source: DataFrame, on: list[str], changes: dict[str, Column], when: Column | None = None
) -> DataFrame:
    """Set columns where the key has a match; of several source rows the lowest is taken.

    Expressions in ``changes`` may name columns of ``source`` as ``src_<name>``.
    """
    unique = latest_per_key(source, on, []).select(
        *[F.col(k) for k in on], *[F.col(c).alias(f"src_{c}") for c in source.columns], F.lit(True).alias("_hit")
    )
    hit = F.col("_hit").isNotNull() if when is None else F.col("_hit").isNotNull() & when
    joined = target.join(unique, on, "left")
    return joined.select(
        *[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in target.columns]
    )


def flag_exists(df: DataFrame, other: DataFrame, on: list[str], name: str) -> DataFrame:
    """1 where the key occurs in ``other``, else 0."""
    known = other.select(*on).distinct().withColumn("_hit", F.lit(1))
    return df.join(known, on, "left").select(*df.columns, F.coalesce("_hit", F.lit(0)).alias(name))


def update_where(df: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in changes.items()})


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true; unknown keeps the row."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def retain(df: DataFrame, ts: str, as_of: datetime, days: int) -> DataFrame:
    """Drop rows older than ``days`` days before the run time."""
    bound = (as_of - timedelta(days=days)).strftime("%Y-%m-%d %H:%M:%S")
    return delete_where(df, F.col(ts) < F.lit(bound).cast(df.schema[ts].dataType))


def lookback(target: DataFrame, as_of: datetime, days: int, first_run: datetime) -> datetime:
    """Lower bound of the next load: run day less ``days``, from ``first_run`` if the target is empty."""
    start = first_run if target.isEmpty() else jst(as_of).replace(hour=0, minute=0, second=0, microsecond=0)
    return start - timedelta(days=days)


def new_rows(batch: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch whose key the target does not have."""
    return batch.join(target.select(*keys), keys, "left_anti").select(*batch.columns)


def append_new(batch: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Target plus the new rows of the batch."""
    return target.unionByName(new_rows(batch, target, keys))


def track_history(current: DataFrame, history: DataFrame, keys: list[str], day: str) -> DataFrame:
    """First/last-seen history: new keys start today, seen keys move their last day.

    ``history`` has the columns of ``current`` plus ``first_seen`` and ``last_seen``;
    a known key keeps its stored columns. Current rows of one key count once; a NULL
    key is a key like any other.
    """
    joined = _side_by_side(history, latest_per_key(current, keys, []), keys)
    known, seen = F.col("_t").isNotNull(), F.col("_s").isNotNull()
    dates = {
        "first_seen": F.when(known, F.col("_t.first_seen")).otherwise(F.lit(day)),
        "last_seen": F.when(seen, F.lit(day)).otherwise(F.col("_t.last_seen")),
    }
    stored_ = lambda c: F.when(known, F.col(f"_t.{c}")).otherwise(F.col(f"_s.{c}"))
    return joined.select(*[(dates[c] if c in dates else stored_(c)).alias(c) for c in history.columns])


def since_watermark(df: DataFrame, marks: DataFrame, source: str, key: str) -> DataFrame:
    """Rows beyond the last processed id of their source (``<source>_source`` in the marks)."""
    tagged = df.withColumn("_source", F.concat(F.col(source), F.lit("_source")))
    joined = tagged.join(marks.select(F.col("source_name").alias("_source"), "last_processed_id"), "_source", "left")
    fresh = joined.filter(F.col(key) > F.coalesce("last_processed_id", F.lit(-1)))
    return fresh.select(*df.columns)


def advance_watermark(marks: DataFrame, batch: DataFrame, source: str, key: str) -> DataFrame:
    """Marks moved to the highest id of the batch; sources without rows stay."""
    highest = batch.groupBy(F.concat(F.col(source), F.lit("_source")).alias("source_name")).agg(
        F.max(key).alias("_top")
    )
    joined = marks.join(highest, "source_name", "left")
    moved = F.col("_top").isNotNull()
    changes = {
        "last_processed_id": F.coalesce("_top", "last_processed_id"),
        "processing_status": F.when(moved, "completed").otherwise(F.col("processing_status")),
    }
    return joined.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in marks.columns])


def freshness(df: DataFrame, marks: DataFrame, source: str, ts: str, as_of: datetime) -> DataFrame:
    """Rows per source in all, in the last day and the last hour, with the source's mark."""

    def since(hours: int) -> Column:
        bound = (as_of - timedelta(hours=hours)).strftime("%Y-%m-%d %H:%M:%S")
        return F.col(ts) > F.lit(bound).cast(df.schema[ts].dataType)

    counts = df.groupBy(source).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(since(24)).alias("recent_records"),
        F.count_if(since(1)).alias("very_recent_records"),
        F.min(ts).alias("earliest_timestamp"),
        F.max(ts).alias("latest_timestamp"),
    )
    named = counts.withColumn("_source", F.concat(F.col(source), F.lit("_source")))
    joined = named.join(marks.withColumnRenamed("source_name", "_source"), "_source", "left")
    return joined.select(
        *counts.columns,
        F.coalesce("last_processed_id", F.lit(0)).alias("last_processed_id"),
        F.coalesce("processing_status", F.lit("unknown")).alias("processing_status"),
        (F.col("recent_records") * 100.0 / F.col("total_records")).alias("recent_data_percentage"),
    )


def unless_processed(state: DataFrame, pair: dict[str, object], result: DataFrame) -> DataFrame:
    """``result``, or its empty layout when the snapshot pair is already in the state table."""
    done = state
    for column, value in pair.items():
        done = done.filter(F.col(column) == F.lit(value))
    return result if done.isEmpty() else result.limit(0)


def bucket_of(keys: list[str], buckets: int) -> Column:
    """Bucket of a key; a NULL key is a key like any other."""
    return F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\x00null")) for k in keys]), F.lit(buckets))


def changed_buckets(src: DataFrame, tgt: DataFrame, keys: list[str], hash_col: str, buckets: int = 4096) -> DataFrame:
    """Buckets of keys (column ``_bucket``) in which two snapshots differ.

    Each side is reduced to a digest per bucket: its rows, and two 64-bit sums over key and content hash. Equal digests mean equal
    rows; only digests meet, at most ``buckets`` a side.
    """

    def digests(df: DataFrame, suffix: str) -> DataFrame:
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in (*keys, hash_col)]
        sums = [F.bit_xor(F.xxhash64(F.lit(seed), *parts)).alias(f"x{seed}{suffix}") for seed in (1, 2)]
        # Equal rows cancel in an exclusive or, so their number goes with it, also in a plain sum.
        weight = F.sum(F.xxhash64(F.lit(3), *parts).cast("decimal(20,0)")).alias(f"x3{suffix}")
        return df.groupBy(bucket_of(keys, buckets).alias("_bucket")).agg(F.count(F.lit(1)).alias(f"n{suffix}"), *sums, weight)

    both = digests(src, "_s").join(digests(tgt, "_t"), "_bucket", "full")
    same = reduce(lambda a, b: a & b, [F.col(f"{c}_s").eqNullSafe(F.col(f"{c}_t")) for c in ("n", "x1", "x2", "x3")])
    return both.filter(~same).select("_bucket")


def delta_upsert(src: DataFrame, tgt: DataFrame, key: str, hash_col: str, buckets: int = 4096) -> DataFrame:
    """Target after inserting new rows and replacing rows whose hash differs.

    Snapshots are compared by buckets of keys first: rows of equal buckets go through as they are, only the others are joined. A day with
    few changes joins few rows, an unchanged one none.
    """
    spread = stored(changed_buckets(src, tgt, [key], hash_col, buckets), "buckets")
    bucketed = lambda df: df.withColumn("_bucket", bucket_of([key], buckets))
    # At most ``buckets`` numbers.
    marked = F.broadcast(spread)
    kept = bucketed(tgt).join(marked, "_bucket", "left_anti").select(*tgt.columns)
    fresh, old = [bucketed(df).join(marked, "_bucket", "left_semi").drop("_bucket") for df in (src, tgt)]
    joined = _side_by_side(old, latest_per_key(fresh, [key], []), [key])
    same = F.col(f"_s.{hash_col}").eqNullSafe(F.col(f"_t.{hash_col}"))
    taken = F.col("_s").isNotNull() & (F.col("_t").isNull() | ~same)
    changed = joined.select(*[F.when(taken, F.col(f"_s.{c}")).otherwise(F.col(f"_t.{c}")).alias(c) for c in tgt.columns])
    return kept.unionByName(changed)


# Counters of one histogram pass that come to the driver.
HISTOGRAM_CELLS = 1 << 16


def keys_at(df: DataFrame, key: str, ranks: list[int], low: int, high: int) -> dict[int, int]:
    """Integer keys at the given ranks (from 1) of a unique key, without sorting the rows.

    A pass counts keys in equal cells of the interval that holds a rank, with each cell's least and greatest key; the next looks
    into the cells that hold ranks only. An interval shrinks by ``HISTOGRAM_CELLS`` over the number of such cells per pass, and a rank that is
    the first or last of its cell is found at once. All rows are read in each pass, but a few counters are all that moves.
    """
    value = F.col(key).cast("bigint")
    found: dict[int, int] = {}
    # Disjoint intervals with the rows before them and the ranks they hold.
    open_ = [(low, high, 0, sorted(set(ranks)))] if ranks else []
    while open_:
        cells = max(HISTOGRAM_CELLS // len(open_), 2)
        steps = [max(-(-(hi - lo + 1) // cells), 1) for lo, hi, _, _ in open_]
        place = F.lit(None).cast("struct<i:int,cell:bigint>")
        for i, ((lo, hi, _, _), step) in reversed(list(enumerate(zip(open_, steps, strict=True)))):
            cell = F.struct(F.lit(i).alias("i"), F.floor((value - F.lit(lo)) / F.lit(step)).cast("bigint").alias("cell")) if hi - lo < 1 << 52 else F.struct(
                F.lit(i).alias("i"), F.expr(f"(cast(`{key}` as decimal(20,0)) - {lo}) div {step}").cast("bigint").alias("cell")
            )
            place = F.when(value.between(F.lit(lo), F.lit(hi)), cell).otherwise(place)
        rows = df.select(place.alias("_p"), value.alias("_k")).filter(F.col("_p").isNotNull())
        counted = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_k").alias("least"), F.max("_k").alias("most"))
        by_interval: dict[int, list] = {}
        for r in sorted(counted.collect(), key=lambda r: r["least"]):
            by_interval.setdefault(r["_p"]["i"], []).append((r["n"], r["least"], r["most"]))
        following = []
        for i, (_, _, before, wanted) in enumerate(open_):
            for n, least, most in by_interval.get(i, []):
                inside = [r for r in wanted if before < r <= before + n]
                found.update({r: least if r == before + 1 else most for r in inside if r in (before + 1, before + n) or least == most})
                left = [r for r in inside if r not in found]
                if left:
                    following.append((least, most, before, left))
                before += n
        open_ = following
    return found


def spans(df: DataFrame, key: str, n: int) -> DataFrame:
    """Row spans of a table for loading it in pieces: count div ``n`` rows each, in key order.

    A remainder makes one span more. ``key`` is unique. For whole-number, date and time keys the bounds are found by
    histograms, for other types by numbering the sorted rows.
    """
    kind = df.schema[key].dataType
    ways = {
        "date": (F.unix_date(F.col(key)), F.date_from_unix_date),
        "timestamp": (F.unix_micros(F.col(key)), F.timestamp_micros),
        "timestamp_ntz": (F.unix_micros(F.col(key).cast("timestamp")), lambda c: F.timestamp_micros(c).cast("timestamp_ntz")),
    }
    to, back = ways.get(kind.simpleString(), (F.col(key), lambda c: c.cast(kind)))
    if kind.simpleString() not in ways and not isinstance(kind, T.IntegralType):
        numbered = number_rows(df.select(key), [key])
        part = F.floor((F.col("row_no") - 1) / max(df.count() // n, 1))
        return numbered.groupBy(part.alias("span")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("row_count"))
    placed = df.select(to.cast("bigint").alias("_key"))
    low, high, total = placed.agg(F.min("_key"), F.max("_key"), F.count(F.lit(1))).first()
    size = max(total // n, 1)
    edges = [(i // size, i + 1, min(i + size, total)) for i in range(0, total, size)]
    at = keys_at(placed, "_key", [rank for _, first, last in edges for rank in (first, last)], low, high) if total else {}
    rows = [(span, at[first], at[last], last - first + 1) for span, first, last in edges]
    out = df.sparkSession.createDataFrame(rows, "span bigint, low bigint, high bigint, row_count bigint")
    return out.select("span", back(F.col("low")).cast(kind).alias("low"), back(F.col("high")).cast(kind).alias("high"), "row_count")


def apply_deletes(target: DataFrame, daily: DataFrame, key: str, flag: str = "is_deleted") -> DataFrame:
    """Target without the keys the daily feed marks as deleted."""
    gone = daily.filter(F.col(flag) == 1).select(key)
    return target.join(gone, key, "left_anti")
