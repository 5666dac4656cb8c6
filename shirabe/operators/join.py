"""Join operators. Rewrites here avoid the nested-loop plans Spark would pick."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def join_cast(a: DataFrame, b: DataFrame, ka: str, kb: str, to: str = "string", how: str = "inner") -> DataFrame:
    """Equi join in which the key of ``b`` is first cast to the type ``to``."""
    keyed = b.withColumn("_cast_key", F.col(kb).try_cast(to))
    return a.join(keyed, a[ka] == keyed["_cast_key"], how).drop("_cast_key")


def join_any_slot(a: DataFrame, b: DataFrame, key: str, slots: list[str]) -> DataFrame:
    """Inner join ``a.key IN (b.slot1, b.slot2, ...)`` as a hash join.

    The distinct keys of each row of ``b`` are unfolded, so a pair matches once
    however many slots hold the key.
    """
    unfolded = b.withColumn("_slot_key", F.explode(F.array_distinct(F.array(*slots))))
    return a.join(unfolded, a[key] == unfolded["_slot_key"]).drop("_slot_key")


def join_any_key(a: DataFrame, b: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Inner join on ``a.x1 = b.y1 OR a.x2 = b.y2 OR ...`` as a union of hash joins.

    Branch n keeps only the pairs no earlier branch has matched, so no row ids
    and no final distinct are needed.
    """
    branches = []
    for n, (ka, kb) in enumerate(pairs):
        on = a[ka] == b[kb]
        for pa, pb in pairs[:n]:
            on = on & ~F.coalesce(a[pa] == b[pb], F.lit(False))
        branches.append(a.join(b, on))
    return reduce(DataFrame.unionAll, branches)


def exclude_multi(a: DataFrame, b: DataFrame, key: str, of: str, b_key: str | None = None) -> DataFrame:
    """Drop rows of ``a`` whose key maps to more than one value of ``of`` in ``b``."""
    name = b_key or key
    pairs = b.select(name, of).distinct()
    ambiguous = pairs.groupBy(F.col(name).alias(key)).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return a.join(ambiguous, key, "left_anti")


def only_one_in_group(
    candidates: DataFrame, rows: DataFrame, block: str, any_of: list[str], distinct: str
) -> DataFrame:
    """Candidates whose look-alikes in the block hold exactly one value of ``distinct``.

    A row of ``rows`` is a look-alike when it shares the block and at least one of
    the attributes ``any_of``. One value only means that the lowest and highest
    value over all look-alikes agree. Attributes are unfolded, so one aggregate and
    one join serve them all, and no pairs are formed, whatever the size of a block.
    """
    attributes = lambda: F.explode(
        F.array(*[F.struct(F.lit(i).alias("n"), F.col(a).cast("string").alias("v")) for i, a in enumerate(any_of)])
    ).alias("_a")
    spans = (
        rows.select(F.col(block).alias("_block"), F.col(distinct).alias("_d"), attributes())
        .filter(F.col("_block").isNotNull() & F.col("_a.v").isNotNull())
        .groupBy("_block", "_a")
        .agg(F.min("_d").alias("_low"), F.max("_d").alias("_high"))
    )
    # The block and the attributes alone decide, so equal ones are judged once and whole rows move once.
    deciding = list(dict.fromkeys([block, *any_of]))
    judged = candidates.select(*deciding).distinct()
    unfolded = judged.select(F.struct(*deciding).alias("_row"), F.col(block).alias("_block"), attributes())
    kept = (
        unfolded.join(spans, ["_block", "_a"])
        .groupBy("_row")
        .agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
        .filter("_low = _high")
        .select(*[F.col(f"_row.{c}").alias(f"_k{i}") for i, c in enumerate(deciding)])
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(deciding)])
    return candidates.join(kept, same, "left_semi")


def outlier_count(df: DataFrame, keys: list[str], value: str, k: float = 2) -> DataFrame:
    """Per group: mean, deviation, the mean ± k deviations band and the rows outside it."""
    stats = band(df, keys, value, k)
    joined = df.select(*keys, value).join(stats.select(*keys, "lower_threshold", "upper_threshold"), keys)
    outside = (F.col(value) > F.col("upper_threshold")) | (F.col(value) < F.col("lower_threshold"))
    counts = joined.groupBy(*keys).agg(F.count_if(outside).alias("anomaly_count"))
    return stats.join(counts, keys)


def band(df: DataFrame, keys: list[str], value: str, k: float = 2) -> DataFrame:
    """Mean ± k sample standard deviations of each group."""
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("measurement_count"),
        F.avg(value).alias("avg_value"),
        F.stddev_samp(value).alias("std_deviation"),
    )
    spread = F.col("std_deviation") * k
    return stats.withColumns(
        {"upper_threshold": F.col("avg_value") + spread, "lower_threshold": F.col("avg_value") - spread}
    )


def join_latest(a: DataFrame, log: DataFrame, key: str, ts: str) -> DataFrame:
    """Join the rows of the newest log time of each key (all rows of that time)."""
    ranked = log.withColumn("_rank", F.rank().over(Window.partitionBy(key).orderBy(F.desc(ts))))
    return a.join(ranked.filter(F.col("_rank") == 1).filter(F.col(ts).isNotNull()).drop("_rank"), key)


def recombine(parts: list[DataFrame], key: str) -> DataFrame:
    """Join column blocks that share one unique key side by side."""
    return reduce(lambda x, y: x.join(y, key), parts)


def row_hash(columns: list[str]) -> Column:
    """Content hash of a row; NULL and empty text differ. Each part goes with its length, so no separator can be imitated."""
    text = [F.col(c).cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit("="), t), F.lit("-")) for t in text]
    return F.sha2(F.concat_ws("|", *parts), 256)


def detect_delta(src: DataFrame, tgt: DataFrame, key: str, hash_col: str) -> DataFrame:
    """Source rows flagged ``is_new`` or ``is_updated`` against the target."""
    known = tgt.select(F.col(key).alias("_key"), F.col(hash_col).alias("_hash"))
    joined = src.join(known, src[key] == known["_key"], "left")
    changed = F.col("_key").isNotNull() & ~F.col(hash_col).eqNullSafe(F.col("_hash"))
    return joined.select(
        *src.columns,
        F.col("_key").isNull().alias("is_new"),
        F.coalesce(changed, F.lit(False)).alias("is_updated"),
    )


def snapshot_changes(prev: DataFrame, cur: DataFrame, keys: list[str], col: str, from_value: str) -> DataFrame:
    """Rows of ``cur`` whose ``col`` was ``from_value`` in ``prev`` and is something else now."""
    before = prev.filter(F.col(col) == from_value).select(*keys)
    return cur.filter(F.col(col) != from_value).join(before, keys)


def join_json(a: DataFrame, text: str, path: str, b: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join on a field inside a JSON column, compared as text."""
    keyed = a.withColumn("_json_key", F.get_json_object(text, path))
    return keyed.join(b, keyed["_json_key"] == b[key].cast("string"), how).drop("_json_key")


def multiply_rows(df: DataFrame, times: int, name: str) -> DataFrame:
    """Each row ``times`` times with a running number, without a cross join."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(times))))


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full outer comparison of two keyed tables, one row per key.

    Both sides are first reduced to a row per key, so a repeated key cannot
    multiply or pile up in the join.
    """
    left = a.groupBy(key).agg(F.count(F.lit(1)).alias("a_rows"))
    right = b.groupBy(key).agg(F.count(F.lit(1)).alias("b_rows"))
    state = F.when(F.col("b_rows").isNull(), "MISSING_IN_B").when(F.col("a_rows").isNull(), "MISSING_IN_A")
    return left.join(right, key, "full").withColumn("consistency_status", state.otherwise("OK"))


