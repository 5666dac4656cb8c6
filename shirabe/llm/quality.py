"""Quality rules whose cutoffs are chosen under a bound on false rejections.

Labelled rows are split by key in two halves. The fitting half orders steps (rule, cutoff) into
one path, those that reject most bad rows for each good one first; a row's step is the first
that rejects it. The holdout half then certifies, in each stratum by itself, how far along the
path one may go: steps are tested in order, each by the exact binomial tail of the good rows
rejected so far, and the first failure ends the walk. Testing in a fixed order keeps the error
of a whole walk at that of one test; the error is divided by the number of strata
(Bonferroni). So with probability ``1 - error`` no stratum loses more than a share ``risk`` of
its good rows, over all rules together. A stratum with too few labels rejects nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shirabe.llm import words as w
from shirabe.operators.skew import join_null_safe
from shirabe.session import stored

BLANKS = b" \t\n\x0b\x0c\r"
INNER = bytes(range(0x80, 0xC0))  # bytes of a code point after its first
CAPITALS, DIGITS, MARKS = bytes(range(65, 91)), bytes(range(48, 58)), b"!?"
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_digits", "n_marks"]

# Rules: a share of thousandths, high values are bad.
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "marks": ("n_marks", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "repeats": ("n_repeat_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "long_words": ("word_chars", "n_words"),
}
# Cutoffs of every rule, fixed before any row is seen: about four steps in each doubling.
GRID = sorted({round(2 ** (i / 4)) for i in range(57)})


def repeat_words(ids: np.ndarray, starts: np.ndarray, window: int = 5) -> np.ndarray:
    """Per text, its words in windows that occur twice or more in it; windows are compared word by word, through names."""
    order, names, same = w.sorted_names(ids)
    again = w.repeated(order, same)
    at, names = np.flatnonzero(again), names[again]  # a word that occurs once is in no repeated window
    singles, first = names, at
    for size in range(1, window):
        joint = np.searchsorted(first, at + size)
        both = np.flatnonzero((joint < len(first)) & (first[np.minimum(joint, len(first) - 1)] == at + size)) if len(first) else np.zeros(0, np.int64)
        width = int(singles.max()) + 1 if len(singles) else 1
        order, made, same = w.sorted_names(names[both] * width + singles[joint[both]])
        again = w.repeated(order, same)
        at, names = at[both][again], made[again]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return covered[starts[1:]] - covered[starts[:-1]]


def lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one."""
    held = [line for line in text.split(b"\n") if line.strip(BLANKS)]
    return len(held), len(held) - len(set(held))


def counted(df: DataFrame, key: str = "doc_id", text: str = "text", extra: list[str] = ()) -> DataFrame:
    """One row per row of ``df``: key, the columns of ``extra`` and the counts of the whole text.

    ``n_words``; ``word_chars``, code points in words; ``n_symbols``, characters of ``#*$%&|<>``; ``n_dup_lines``, lines with
    a word that equal an earlier one; ``n_repeat_words``, words in windows of five found twice or more in
    the text; then lines with a word, capitals A-Z, digits 0-9 and ``!?``. A null text counts as an empty one.
    """
    numbered = df.select(F.struct(F.col(key).alias("key"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(extra)]).alias("k"), F.col(text).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in w.blocks(batches):
            split = [t.split() for t in texts]
            ids, starts = w.named(split)
            rows = [
                (len(words), len(t.translate(None, BLANKS + INNER)), *[len(t) - len(t.translate(None, of)) for of in (SYMBOLS, CAPITALS, DIGITS, MARKS)], *lines(t))
                for words, t in zip(split, texts, strict=True)
            ]
            n, chars, symbols, capitals, digits, marks, held, copies = np.array(rows, np.int64).T
            values = [n, chars, symbols, copies, repeat_words(ids, starts), held, capitals, digits, marks]
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(v) for v in values]], names=["k", *COUNTS])

    layout = f"k {numbered.schema['k'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in COUNTS)
    named = [F.col("k.key").alias(key), *[F.col(f"k.x{i}").alias(c) for i, c in enumerate(extra)]]
    return numbered.mapInArrow(run, layout).select(*named, *COUNTS)


def base_failed() -> Column:
    """Fewer than ten words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def share(rule: str) -> Column:
    """Value of a rule in whole thousandths; 0 where there is nothing to divide by."""
    part, whole = RULES[rule]
    return F.when(F.col(whole) > 0, F.floor(1000 * F.col(part) / F.col(whole))).otherwise(F.lit(0)).cast("bigint")


def level_of(value: Column) -> Column:
    """Number of grid cutoffs that a value reaches."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in GRID]), lambda cutoff: cutoff <= value))


def labels_of(labels: DataFrame, key: str = "doc_id", quality: str = "quality") -> DataFrame:
    """(key, good) of every labelled key. Rows without key or label are no labels; of several labels of one key the worst counts."""
    given = labels.where(F.col(key).isNotNull() & F.col(quality).isNotNull())
    return given.groupBy(F.col(key)).agg((F.min(quality) > 0).alias("good"))


def path(rows: DataFrame, lift: float = 10.0) -> list[tuple[str, int]]:
    """Steps (rule, cutoff) in the order in which they are tried, from labelled ``rows`` with ``good``.

    A step is a grid cutoff of a rule that rejects bad rows the next higher cutoff lets pass; the rows it adds must be
    ``lift`` times as large a share of the bad rows as of the good ones (with one good row more, so that a few bad
    rows alone prove nothing). Steps of the highest ratio come first. Only counts per rule and
    cutoff reach the driver.
    """
    totals = rows.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
    good, bad = totals[0], totals[1]
    if not good or not bad:
        return []
    cells = F.array(*[F.struct(F.lit(rule).alias("rule"), level_of(share(rule)).alias("level")) for rule in RULES])
    counts = rows.select("good", F.explode(cells).alias("c")).where("c.level > 0").groupBy("c.rule", "c.level").agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")
    )
    steps = []
    for rule, cells in pd.DataFrame(counts.collect(), columns=["rule", "level", "good", "bad"]).groupby("rule"):
        by_level = {row.level: (row.good, row.bad) for row in cells.itertuples()}
        passed_good = 0
        for level in range(len(GRID), 0, -1):
            more_good, more_bad = by_level.get(level, (0, 0))
            passed_good += more_good
            if more_bad:
                odds = (more_bad / bad) / ((passed_good + 1) / good)
                if odds < lift:
                    break
                steps.append((-odds, rule, -GRID[level - 1]))
                passed_good = 0
    return [(rule, -cutoff) for _, rule, cutoff in sorted(steps)]


def step_of(steps: list[tuple[str, int]]) -> Column:
    """Number of the first step that rejects a row; null if none does."""
    found = []
    for rule in RULES:
        own = [(cutoff, i) for i, (name, cutoff) in enumerate(steps) if name == rule]
        value, chain = share(rule), F.lit(None).cast("int")
        for cutoff, i in reversed(own):
            chain = F.when(value >= cutoff, F.lit(i)).otherwise(chain)
        found.append(chain)
    return F.array_min(F.array(*found))


def tail(rejected: int, n: int, risk: float) -> float:
    """Probability of at most ``rejected`` of ``n`` where each is rejected with probability ``risk``: the exact binomial sum.

    Terms are added from the largest down, each from the one before, until they no longer count.
    """
    if rejected >= n:
        return 1.0
    if rejected > n * risk:  # above the mean the other tail is the short one
        return 1.0 - tail(n - rejected - 1, n, 1.0 - risk)
    log = math.lgamma(n + 1) - math.lgamma(rejected + 1) - math.lgamma(n - rejected + 1)
    term = math.exp(log + rejected * math.log(risk) + (n - rejected) * math.log1p(-risk))
    total, i = term, rejected
    while i and term > total * 1e-17:
        term *= i / (n - i + 1) * (1 - risk) / risk
        total, i = total + term, i - 1
    return min(total, 1.0)


def certified(holdout: DataFrame, stratum: str, steps: int, risk: float, error: float) -> DataFrame:
    """(stratum, n_good, last_step, n_rejected): how far each stratum may go; -1 where no step passes.

    ``holdout`` has the stratum and ``_step`` of good rows. Counts per stratum and step are added up first, so a
    group of the last step has ``steps`` rows and one at most.
    """
    counts = holdout.groupBy(F.col(stratum).alias("stratum"), F.coalesce("_step", F.lit(steps)).alias("step")).agg(F.count("*").alias("n"))
    strata = counts.agg(F.count_distinct(F.struct("stratum")).alias("strata"))
    kind = holdout.schema[stratum].dataType.simpleString()

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        n, allowed = int(group["n"].sum()), error / int(group["strata"].iloc[0])
        at = dict(zip(group["step"], group["n"], strict=True))
        last, lost, rejected = -1, 0, 0
        for step in range(steps):
            rejected += int(at.get(step, 0))
            if tail(rejected, n, risk) > allowed:
                break
            last, lost = step, rejected
        return pd.DataFrame({"stratum": group["stratum"].iloc[:1], "n_good": [n], "last_step": [last], "n_rejected": [lost]})

    # One row, of one number: no side of this join grows.
    return counts.join(F.broadcast(strata)).groupBy("stratum").applyInPandas(walk, f"stratum {kind}, n_good bigint, last_step int, n_rejected bigint")


def judge(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    risk: float = 0.05,
    error: float = 0.05,
    lift: float = 10.0,
) -> DataFrame:
    """One row per row of ``df``: key, ``stratum``, counts, ``base_failed``, ``step``, ``rule``, ``cutoff``, ``last_step`` and ``kept``.

    ``rule`` and ``cutoff`` name the first step of the path that rejects the row, null if none does; the row is kept if it
    passes the base and its stratum is not certified up to that step. Risk is measured over good labelled rows that
    pass the base. Null keys carry no label, a null stratum is a stratum of its own, repeated keys
    keep their rows; without labels the base alone decides.
    """
    fixed = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(stratum).alias("stratum"))
    counts = stored(counted(fixed, "key", "text", ["stratum"]).withColumn("base_failed", base_failed()), "counts")
    given = labels_of(labels, key).select(F.col(key).alias("key"), "good")
    known = stored(counts.where("not base_failed").join(given, "key"), "labelled")
    fitting = F.crc32(F.col("key").cast("string")) % 2 == 0
    steps = path(known.where(fitting), lift)
    step = step_of(steps) if steps else F.lit(None).cast("int")
    bounds = certified(known.where(~fitting & F.col("good")).withColumn("_step", step), "stratum", len(steps), risk, error)
    judged = join_null_safe(counts.withColumn("step", step), bounds.select("stratum", "last_step"), ["stratum"])
    named = lambda i: reduce(lambda rest, s: F.when(F.col("step") == s[0], F.lit(s[1][i])).otherwise(rest), enumerate(steps), F.lit(None))
    return judged.select(
        F.col("key").alias(key),
        "stratum",
        *COUNTS,
        "base_failed",
        "step",
        named(0).cast("string").alias("rule"),
        named(1).cast("bigint").alias("cutoff"),
        "last_step",
        (~F.col("base_failed") & F.coalesce(F.col("step") > F.col("last_step"), F.lit(True))).alias("kept"),
    )
