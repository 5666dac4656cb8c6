"""Personal data by base patterns and bootstrapped contexts; DataFrame and SQL functions only.

Spans of four base kinds are the seeds. The word before a span, the two words before it and
the word behind it are its lexical patterns; a ``:`` or ``=`` behind a word belongs to it, with
blanks around it or not. Patterns and what stands at them form a graph: a pattern is trusted as
far as its occurrences in the whole corpus have trusted instances beside them, an instance as far
as its best pattern is. After some rounds, identifiers of no base kind at trusted patterns are
added as spans of kind ``context``: words before an identifier decide, and the word behind it
where no pattern before it has enough seeds.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shirabe.llm.common import materialise

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Possessive forms and the guards before a run match the same
# texts as the plain forms, without their quadratic time and deep recursion on long runs.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TOKEN = "[A-Za-z0-9._%+@#/()-]"
CANDIDATE = rf"(?<!{TOKEN})(?={TOKEN}*[0-9]{{3}}){TOKEN}*[A-Za-z0-9]"
SIGNS = r"(?<!\s)\s*+[:=][\s:=]*+"  # written as ": " behind the word
EDGES = r"""(?<!\S)["'(\[<{,;.]++|(?<!["')\]>},;.])["')\]>},;.]++(?=:?(?:\s|$))"""  # no part of a word
BEFORE = r"""(?<![^\s:=])(?:[^\s:=]++[\s:=]++){1,3}["'(\[<{]?$"""  # three words that end where a span starts, or fewer
OPENING = r"""["'(\[<{]$"""
BEHIND = r"""^["')\]>},;.]*+\s++([^\s:=]++)[\s:=]"""
RESIDUES = 1 << 16


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also if ``use`` takes it inside a function over an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


STRETCH = 256  # matches placed with one running sum


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern as structs of start, end (code points, from 0) and value, in order.

    Places are running sums of the lengths of gaps and matches: first within stretches of matches, then over the stretches, so that an
    array that grows by one is never long and 100,000 matches take seconds.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    sums = F.array().cast("array<int>")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["value"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def add(state: Column, part: Column) -> Column:
        return F.struct((state["at"] + part["at"]).alias("at"), F.concat(state["sums"], F.array(state["at"])).alias("sums"))

    def moved(part: Column, by: Column) -> Column:
        return F.transform(part["spans"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value")))

    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    begin = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def by_stretch(whole: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / STRETCH).cast("int"))
        return F.transform(numbers, lambda i: F.aggregate(F.slice(whole, i * STRETCH + 1, STRETCH), begin, step))

    def placed(parts: Column) -> Column:
        starts = F.aggregate(parts, F.struct(F.lit(0).alias("at"), sums.alias("sums")), add, lambda s: s["sums"])
        return F.flatten(F.zip_with(parts, starts, moved))

    return F.when(F.size(found) > STRETCH, bound(bound(pairs, by_stretch), placed)).when(
        F.size(found) > 0, F.aggregate(pairs, begin, step, lambda s: s["spans"])
    ).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(each, F.lit(0), lambda s, d: s + d) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match of a base pattern counts."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        digits = F.translate(value, " -", "")
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by kind as listed, then start."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def of_kind(kind: str) -> Column:
        spans = F.filter(located(text, PATTERNS[kind]), lambda s: valid(kind, s["value"]))
        if NEEDS[kind]:
            spans = F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(none)
        named = lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))
        return F.transform(spans, named)

    return F.concat(*(of_kind(kind) for kind in KINDS))


def plain(text: Column) -> Column:
    """Text as pattern words: lower case, no quotes, brackets or stops at the edges of a word, signs as a colon at its end."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, SIGNS, ": "), EDGES, ""))


def last_words(before: Column, whole: Column) -> Column:
    """One and two words at the end of a string as patterns; its first word counts only if the string is ``whole`` to the left."""

    def of(words: Column) -> Column:
        at = lambda i: F.get(words, F.size(words) - i - 1)  # noqa: E731  # the last element is empty
        known = lambda i: (F.size(words) > i + F.when(whole | (F.size(words) > 3), 0).otherwise(1)) & F.rtrim(at(i), F.lit(":")).rlike(".")
        one = F.when(known(1), F.concat(F.lit("1 "), at(1)))
        return F.array(one, F.when(known(1) & known(2), F.concat(F.lit("2 "), at(2), F.lit(" "), at(1))))

    tail = F.regexp_replace(F.regexp_extract(before, BEFORE, 0), OPENING, "")
    return bound(F.split(plain(tail), r"\s++"), of)


def next_word(behind: Column) -> Column:
    """The word a string starts with, behind a blank, as a pattern."""
    word = plain(F.regexp_extract(behind, BEHIND, 1))
    return F.when(word != "", F.concat(F.lit("r "), word))


def patterns_at(text: Column, pattern: str, counts: Callable[[Column], Column]) -> Column:
    """Lexical patterns of every match of a regular expression, in order; none for a match that does not count.

    The words are looked for from the second match before to the second behind, so that no stretch of a text is
    read more than a few times; a word glued together from more matches than that is no pattern.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def near(match: Column) -> Column:
        part = lambda array, i: F.coalesce(F.when(i >= 0, F.get(match[array], i)), F.lit(""))
        before = lambda i: F.concat(part("found", i - 2), part("gaps", i - 1), part("found", i - 1), part("gaps", i))
        end = lambda i: F.when(i + 2 >= F.size(match["found"]), " ").otherwise("")
        behind = lambda i: F.concat(part("gaps", i + 1), part("found", i + 1), part("gaps", i + 2), end(i))
        words = lambda i: F.concat(last_words(before(i), i < 2), F.array(next_word(behind(i))))
        none = F.array().cast("array<string>")
        return F.transform(match["found"], lambda v, i: F.when(counts(v), F.array_compact(words(i))).otherwise(none))

    none = F.array().cast("array<array<string>>")
    return F.when(F.size(found) > 0, bound(F.struct(found.alias("found"), gaps.alias("gaps")), near)).otherwise(none)


def scanned(df: DataFrame, key: str, text: str) -> DataFrame:
    """(row, key, base, seen): per document its base spans, and all instances with the patterns at them."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(key).alias("key"), whole.alias("text"))
    rows = rows.withColumn("row", F.md5(F.concat_ws("\0", F.col("key").cast("string"), "text")))
    rows = rows.withColumn("base", base_spans(F.col("text")))

    def instance(seed: bool):
        return lambda s, patterns: F.struct(
            F.lit(seed).alias("seed"), s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(s["value"]).alias("value"), patterns.alias("patterns")
        )

    def seeds(kind: str) -> Column:
        at = F.filter(F.zip_with(located(F.col("text"), PATTERNS[kind]), patterns_at(F.col("text"), PATTERNS[kind], partial(valid, kind)), instance(True)), lambda s: F.size(s["patterns"]) > 0)
        return F.when(F.exists("base", lambda b: b["kind"] == kind), at).otherwise(at_none)

    at_none = F.array().cast("array<struct<seed:boolean,start:int,end:int,value:bigint,patterns:array<string>>>")
    others = F.zip_with(located(F.col("text"), CANDIDATE), patterns_at(F.col("text"), CANDIDATE, lambda v: F.lit(True)), instance(False))
    # Base spans without patterns stay among the instances: candidates that touch them are none.
    bare = F.transform("base", lambda b: instance(True)(b, F.array().cast("array<string>")))
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("row", "key", base.alias("base"), F.concat(*(seeds(kind) for kind in KINDS), bare, others).alias("seen"))


def clear(instances: DataFrame) -> DataFrame:
    """Instances without the candidates that share a place with a base span of their text."""
    # Both windows end at the current row: one that began there would be computed anew for every row.
    rising, falling = (F.asc("start"), F.desc("seed")), (F.desc("start"), F.asc("seed"))
    upto = lambda order: Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("seed"), F.col("end"))).over(upto(rising))
    following = F.min(F.when(F.col("seed"), F.col("start"))).over(upto(falling))
    touched = (F.coalesce("_reach", F.lit(0)) > F.col("start")) | (F.coalesce("_next", F.col("end")) < F.col("end"))
    placed = instances.withColumn("_reach", reach).withColumn("_next", following)
    return placed.where(F.col("seed") | ~touched).where(F.size("patterns") > 0).drop("_reach", "_next")


def occurrences(df: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often each pattern occurs in all texts, whatever stands at it.

    Words, then patterns, first pass a literal table of 2^16 hash residues, whatever the number
    of patterns, and are counted before the shuffle.
    """
    residue = lambda c: F.pmod(F.xxhash64(c), F.lit(RESIDUES)).cast("int")
    unmarked = lambda c: F.rtrim(c, F.lit(":"))

    def table(of: Column) -> Column:
        spots = {r[0] for r in patterns.select(residue(of)).distinct().collect()}  # 2^16 numbers at most
        return F.from_json(F.lit(json.dumps([int(i in spots) for i in range(RESIDUES)])), "array<int>")

    last = table(unmarked(F.substring_index("pattern", " ", -1)))
    known = table(F.col("pattern"))
    words = df.where(F.col(text).isNotNull()).select(F.split(plain(F.col(text).cast("string")), r"\s++").alias("words"))
    pair = lambda w, p: F.struct(w.alias("w"), p.alias("p"))
    each = words.select(F.explode(F.zip_with("words", F.slice(F.concat(F.array(F.lit("")), "words"), 1, F.size("words")), pair)).alias("e")).select("e.w", "e.p")
    near = each.where(F.get(last, residue(unmarked(F.col("w")))) == 1)
    here = F.array(F.concat(F.lit("1 "), "w"), F.concat(F.lit("2 "), "p", F.lit(" "), "w"), F.concat(F.lit("r "), unmarked(F.col("w"))))
    spots = near.select(F.explode(here).alias("pattern")).where(F.get(known, residue(F.col("pattern"))) == 1)
    return spots.groupBy("pattern").agg(F.count("*").alias("total")).join(patterns.select("pattern"), "pattern")


def contexts(df: DataFrame, text: str, instances: DataFrame, rounds: int, support: int) -> DataFrame:
    """(pattern, score): how far patterns are trusted after some rounds.

    A pattern needs ``support`` different seeds. Its trust is the trust of all instances
    at it over all its occurrences; an instance that is no seed has that of its best pattern.
    """
    backed = (
        instances.where("seed").groupBy("pattern", "value").agg(F.count("*").alias("n")).groupBy("pattern").agg(F.count("*").alias("seeds"))
    ).where(F.col("seeds") >= support)
    backed = materialise(backed, "backed")
    totals = materialise(occurrences(df, text, backed), "totals")
    edges = instances.join(backed.select("pattern"), "pattern").groupBy("pattern", "value", "seed").agg(F.count("*").alias("n"))
    edges = materialise(edges, "edges")
    trusted = edges.select("value").distinct().withColumn("t", F.lit(0.0))
    for _ in range(rounds):
        weight = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("t", F.lit(0.0))) * F.col("n")
        scores = (
            edges.join(trusted, "value", "left")
            .groupBy("pattern")
            .agg(F.sum(weight).alias("mass"))
            .join(totals, "pattern")
            .select("pattern", F.least(F.col("mass") / F.col("total"), F.lit(1.0)).alias("score"))
        )
        scores = materialise(scores, "scores")
        trusted = edges.where("not seed").join(scores, "pattern").groupBy("value").agg(F.max("score").alias("t"))
    return scores


def find(df: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 3, support: int = 5, trust: float = 0.5) -> DataFrame:
    """(key, base, added): base spans and spans found by context, as arrays of structs of kind, start and end.

    Null and empty texts have no spans; repeated rows get the same spans.
    """
    rows = materialise(scanned(df, key, text), "scanned")
    found = clear(rows.select("row", F.explode("seen").alias("i")).select("row", "i.*"))
    instances = materialise(found.withColumn("pattern", F.explode("patterns")).drop("patterns"), "instances")
    scores = contexts(df, text, instances.drop("start", "end"), rounds, support)
    behind = F.col("pattern").startswith("r ")
    judged = F.coalesce(F.max(F.when(~behind, F.col("score"))), F.max("score"))
    new = (
        instances.where("not seed")
        .join(scores, "pattern")
        .groupBy("row", "start", "end")
        .agg(judged.alias("score"))
        .where(F.col("score") >= trust)
        .select("row", F.struct(F.lit("context").alias("kind"), "start", "end").alias("span"))
        .groupBy("row")
        .agg(F.sort_array(F.collect_set("span")).alias("added"))  # no more than the spans of one document
    )
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return rows.join(new, "row", "left").select(F.col("key").alias(key), "base", F.coalesce("added", empty).alias("added"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
