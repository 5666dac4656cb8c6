"""JSON columns: validity, path lookup and flattening."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shirabe.session import stored


def is_json(text: Column) -> Column:
    """True for a JSON object or array; scalars do not count as documents."""
    opened = F.ltrim(text).substr(1, 1).isin("{", "[")
    return F.coalesce(opened & F.try_parse_json(text).isNotNull(), F.lit(False))


def json_value(text: Column, path: str) -> Column:
    """Scalar at ``path`` as text, NULL when absent."""
    return F.get_json_object(text, path)


def json_amount(text: Column, path: str, to: str = "decimal(10,2)") -> Column:
    """Number at ``path``, NULL when absent or not a number."""
    return F.get_json_object(text, path).try_cast(to)


LEVELS = 4  # levels opened in one plan


def _opened(level: DataFrame, doc_id: str) -> DataFrame:
    """The entries of containers in their place; other rows, and arrays directly inside an array, stay."""
    spark = level.sparkSession
    inner = level.lateralJoin(spark.tvf.variant_explode_outer(F.when(F.col("_open"), F.col("_v")).outer()))
    dotted = F.when(F.col("_at") == "", F.col("key")).otherwise(F.concat("_at", F.lit("."), "key"))
    numbered = F.concat("_at", F.lit("["), F.col("pos").cast("string"), F.lit("]"))
    # An empty container gives one row without a position.
    kept = inner.filter(~F.col("_open") | F.col("pos").isNotNull())
    return _judged(
        kept.select(
            doc_id,
            F.when(~F.col("_open"), F.col("_at")).when(F.col("_array"), numbered).otherwise(dotted).alias("_at"),
            F.when(F.col("_open"), F.col("value")).otherwise(F.col("_v")).alias("_v"),
            F.when(F.col("_open"), F.col("_array")).otherwise(F.col("_listed")).alias("_listed"),
        )
    )


def _judged(level: DataFrame) -> DataFrame:
    """Whether the value of each row is to be opened."""
    kind = F.schema_of_variant("_v")
    array = kind.startswith("ARRAY") & ~F.col("_listed")
    return level.withColumns({"_array": array, "_open": kind.startswith("OBJECT") | array})


def flatten_json(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, path, value) rows: objects as dotted keys, arrays as ``key[i]``.

    Documents are opened until no container is left, some levels in each plan; only what is still open then is written and
    opened further. An array directly inside an array stays one JSON
    text, as do its contents. Broken documents and empty containers give no rows.
    """
    level = df.select(doc_id, F.lit("").alias("_at"), F.try_parse_json(text).alias("_v"), F.lit(False).alias("_listed"))
    level = _judged(level.filter(F.col("_v").isNotNull()))
    done: list[DataFrame] = []
    while True:
        for _ in range(LEVELS):
            level = _opened(level, doc_id)
        rows = stored(level, "level")
        done.append(rows.filter(~F.col("_open")).select(doc_id, F.col("_at").alias("path"), F.col("_v").cast("string").alias("value")))
        level = rows.filter("_open")
        if level.isEmpty():
            return reduce(DataFrame.unionAll, done)
