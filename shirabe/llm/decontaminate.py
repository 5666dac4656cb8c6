"""Benchmark decontamination on templates.

Numbers, units and names become typed placeholders, so a question with other numbers or
names has the same template. A text has three forms: its case-folded words without slots,
so that case and punctuation do not matter; its template; and the template that also takes
capitalised words at the start of a sentence as names. Windows of words of documents and
benchmark items are joined on their hash, form by form. Windows of one alignment count
together, and only if their slots agree: one value of the item stands for one value of the
document. A name of several words is one slot. An inserted or deleted word moves the rest of
an item, so neighbouring alignments also count together if their slots agree with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shirabe.llm.common import lean, materialise, sent
from shirabe.llm.hashing import GOLDEN, MIX1, U64, mix, run_hashes, slices

# Units that make a slot after a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb ml l gal s sec min h hr ms hz khz mhz ghz b kb mb gb tb w kw v a k c f "
    "second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres "
    "kilometer kilometers kilometre kilometres inch inches foot feet mile miles gram grams kilogram kilograms pound pounds "
    "ounce ounces liter liters litre litres gallon gallons dollar dollars cent cents euro euros usd eur percent degree degrees"
).split()

SURFACE, TEMPLATE, LEADING = 0, 1, 2  # forms: words as they are; with slots; with names at the start of a sentence too
OTHER, LETTER, DIGIT, BLANK = 0, 1, 2, 3
NUMBER, UNIT, NAME = (mix(np.array([n], U64) * GOLDEN)[0] for n in (1, 2, 3))
PIECE = 1 << 20
FILTER_BITS = 23  # the filter of benchmark windows has 2^23 entries, however large the benchmark is


def letter_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, lower case, is upper case) of every code point."""
    kind, low, upper = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for point in range(0x110000):
        sign = chr(point)
        if sign.isalpha():
            kind[point] = LETTER
            folded = sign.lower()
            if folded != sign:
                upper[point] = True
                low[point] = ord(folded[0])
        elif sign.isdigit():
            kind[point] = DIGIT
        elif sign.isspace():
            kind[point] = BLANK
    return kind, low, upper


class Templates:
    """Template words of texts: runs of letters or of digits, with their surface as the value of a slot."""

    def __init__(self, tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.kind, self.low, self.upper = tables or letter_tables()
        self.breaks = np.zeros(0x110000, bool)
        self.breaks[[ord(c) for c in ".!?:;\n\"'()"]] = True
        self.units = np.sort(np.array([self._one(u) for u in UNITS], U64))

    def _one(self, word: str) -> np.uint64:
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        return run_hashes(points, np.array([0]), np.array([len(points)]))[0]

    def forms(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(template word, slot value or 0, its place in its text, number of template words of each text) of some texts, in each form."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[points]
        wordy = (kind == LETTER) | (kind == DIGIT)
        edge = np.ones(len(points), bool)
        edge[1:] = kind[1:] != kind[:-1]
        starts = np.flatnonzero(edge & wordy)
        closing = np.ones(len(points), bool)
        closing[:-1] = edge[1:]
        ends = np.flatnonzero(closing & wordy) + 1
        if not len(starts):
            return [(np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64))] * 3
        number = kind[starts] == DIGIT
        # 1,000.5 is one number: a point or comma alone between two runs of digits joins them.
        gap = starts[1:] - ends[:-1]
        mark = points[np.minimum(ends[:-1], len(points) - 1)]
        joined = np.zeros(len(starts), bool)
        joined[1:] = number[1:] & number[:-1] & (gap == 1) & ((mark == 46) | (mark == 44))
        heads = np.flatnonzero(~joined)
        ends = ends[np.append(heads[1:], len(starts)) - 1]
        starts, number = starts[heads], number[heads]

        surface = run_hashes(self.low[points], starts, ends)
        # A name is capitalised and not in capitals; at the start of a sentence it may be a name or any word.
        broken = np.concatenate([[0], np.cumsum(self.breaks[points])])
        middle = np.zeros(len(starts), bool)
        middle[1:] = broken[starts[1:]] == broken[ends[:-1]]
        second = np.minimum(starts + 1, len(points) - 1)
        capital = ~number & self.upper[points[starts]] & (ends - starts > 1) & ~self.upper[points[second]]
        unit = np.zeros(len(starts), bool)
        at = np.minimum(np.searchsorted(self.units, surface), len(self.units) - 1)
        unit[1:] = number[:-1] & (self.units[at[1:]] == surface[1:]) & ~number[1:]
        first = np.concatenate([[0], np.cumsum(lengths)])
        begins = np.searchsorted(starts, first)
        counts = np.diff(begins)
        place = np.arange(len(starts)) - np.repeat(begins[:-1], counts)
        # Words with nothing but blanks or a hyphen between them are one name.
        solid = np.concatenate([[0], np.cumsum((kind != BLANK) & (points != 45))])
        close = np.zeros(len(starts), bool)
        close[1:] = middle[1:] & (solid[starts[1:]] == solid[ends[:-1]])
        out = [(surface, np.zeros(len(surface), U64), place, counts)]
        for name in (capital & middle, capital):
            more = np.zeros(len(starts), bool)
            more[1:] = name[1:] & name[:-1] & close[1:]
            heads = np.flatnonzero(~more)
            rank = np.arange(len(starts)) - heads[np.cumsum(~more) - 1]
            value = np.add.reduceat(mix(surface ^ (rank.astype(U64) * GOLDEN)), heads)
            template = surface.copy()
            template[name], template[unit], template[number] = NAME, UNIT, NUMBER
            values = np.where((name | unit | number)[heads], value, U64(0))
            out.append((template[heads], values, place[heads], np.diff(np.searchsorted(heads, begins))))
        return out


def solid_windows(values: np.ndarray, first: np.ndarray, width: int, form: int) -> np.ndarray:
    """Which windows have enough words that are no slot: half of them, except in the form without slots.

    Templates of little but numbers or names stand in tables and lists of any kind.
    """
    if form == SURFACE:
        return np.ones(len(first), bool)
    plain = np.concatenate([[0], np.cumsum(values == 0)])
    return 2 * (plain[first + width] - plain[first]) >= width


def windows(template: np.ndarray, counts: np.ndarray, width: int, form: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word overall, text, first word in the text) of all windows of ``width`` words inside one text."""
    n = len(template) - width + 1
    if n <= 0:
        return np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(3))
    hashes = np.full(n, U64(4 * width + form), U64)
    for k in range(width):
        hashes = (hashes ^ template[k : k + n]) * MIX1
        hashes ^= hashes >> U64(29)
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = np.flatnonzero(owner[:n] == owner[width - 1 :])
    begins = np.cumsum(counts) - counts
    return mix(hashes[inside]), inside, owner[inside], inside - begins[owner[inside]]


WINDOW = "hash bigint, at int, word int, width int, form int, slots binary"


def _rows(keys: pa.Array, hashes, first, owner, at, width: int, form: int, values: np.ndarray, place: np.ndarray, kept: np.ndarray) -> pa.RecordBatch:
    slots = [values[f : f + width].tobytes() if values[f : f + width].any() else b"" for f in first[kept]]
    return pa.RecordBatch.from_arrays(
        [
            keys.take(pa.array(owner[kept])),
            pa.array(hashes[kept].view(np.int64)),
            pa.array(at[kept].astype(np.int32)),
            pa.array(place[first[kept]].astype(np.int32)),
            pa.array(np.full(len(kept), width, np.int32)),
            pa.array(np.full(len(kept), form, np.int32)),
            pa.array(slots, pa.binary()),
        ],
        names=["key", "hash", "at", "word", "width", "form", "slots"],
    )


def item_windows(benchmark: DataFrame, key: str, text: str, width: int, least_words: int, made: Broadcast) -> DataFrame:
    """Windows of all benchmark items; an item of fewer than ``width`` words is one window, under ``least_words`` without slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Templates(made.value)
        for batch in batches:
            for i, text_ in enumerate(batch.column(1).to_pylist()):
                for form, (template, values, place, counts) in enumerate(maker.forms([text_ or ""])):
                    own = min(width, len(template))
                    if (own >= least_words or form == SURFACE and own) and batch.column(0)[i].is_valid:
                        found = windows(template, counts, own, form)
                        kept = np.flatnonzero(solid_windows(values, found[1], own, form))
                        yield _rows(batch.column(0).slice(i, 1), *found, own, form, values, place, kept)

    kind = benchmark.schema[key].dataType.simpleString()
    return benchmark.select(F.col(key), F.col(text).cast("string")).mapInArrow(lean(run), f"key {kind}, {WINDOW}")


def candidate_windows(docs: DataFrame, key: str, text: str, widths: list[int], least_words: int, marked: np.ndarray, made: Broadcast) -> DataFrame:
    """Windows of whole documents that the filter of benchmark windows lets through, also some others.

    A window of fewer than ``least_words`` words is the whole document: so few words also stand in texts of any kind.
    """
    shared = sent(docs, np.packbits(marked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Templates(made.value)
        known = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in slices([len(t) + 1 for t in texts], PIECE):
                for form, (template, values, place, counts) in enumerate(maker.forms(texts[lo:hi])):
                    for width in widths:
                        found = windows(template, counts, width, form)
                        kept = known[found[0] >> U64(64 - FILTER_BITS)] & solid_windows(values, found[1], width, form)
                        kept = np.flatnonzero(kept if width >= least_words else kept & (counts[found[2]] == width))
                        if len(kept):
                            yield _rows(keys.slice(lo, hi - lo), *found, width, form, values, place, kept)
                    del template, values, place, counts

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(lean(run), f"key {kind}, {WINDOW}")


def agreeing(df: DataFrame, by: list[str]) -> DataFrame:
    """The matched windows of those alignments, named by ``by``, whose slots agree: one value of the document for one of the item."""
    conflicts = (
        df.where("octet_length(item_slots) > 0")
        .selectExpr(*by, "explode(sequence(0, cast(octet_length(item_slots) / 8 as int) - 1)) as i", "item_slots", "doc_slots")
        .selectExpr(*by, "hex(substring(item_slots, i * 8 + 1, 8)) as item_value", "hex(substring(doc_slots, i * 8 + 1, 8)) as doc_value")
        .where("item_value <> '0000000000000000'")
        .groupBy(*by, "item_value")
        .agg(F.min("doc_value").alias("a"), F.max("doc_value").alias("b"))
        .where("a <> b")
        .select(by)
        .distinct()
    )
    return df.join(conflicts, by, "left_anti")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
    width: int = 8,
    least_words: int = 5,
    share: float = 0.5,
    passage: int = 32,
) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, share, first_word) of documents that hold a benchmark item, also with other slots.

    A pair is reported if the item's windows found in one alignment with consistent slots, or in
    neighbouring ones, are at least ``share`` of the item's windows or as many as ``passage``
    words in a row have. Alignments are neighbours if their shifts differ by no more than the
    item has windows. An item of fewer than ``least_words`` words is reported where it is the
    whole document. Null texts and keys match nothing. The best alignment is reported, the
    earliest on ties. Windows with slots count only if half of their words are no slots, on both
    sides. Keys are of any type; repeated keys stand together.
    """
    made = sent(docs, letter_tables())  # one entry per code point, about 7 MB
    items = materialise(item_windows(benchmark, item_key, text, width, least_words, made), "items")
    # Bounded by the filter's size, not by the benchmark's.
    spots = items.select(F.shiftrightunsigned("hash", 64 - FILTER_BITS).alias("spot")).distinct().toArrow().column(0).to_numpy()
    marked = np.zeros(1 << FILTER_BITS, bool)
    marked[spots] = True
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    if not widths:
        widths = [width]
    found = candidate_windows(docs, doc_key, text, widths, least_words, marked, made)
    matched = (
        found.join(
            items.select(F.col("key").alias("item"), "hash", "width", "form", F.col("at").alias("item_at"), F.col("slots").alias("item_slots")),
            ["hash", "width", "form"],
        )
        .where("key is not null")
        .selectExpr("key as doc", "item", "form", "at - item_at as shift", "word", "hash", "item_at", "slots as doc_slots", "item_slots")
    )
    matched = materialise(matched, "matched")
    pair, found_at = ["doc", "item", "form"], [F.countDistinct("item_at", "hash").alias("windows"), F.min("word").alias("first_word")]
    # Windows of equal rows count once, on both sides.
    totals = items.groupBy(F.col("key").alias("item"), "form").agg(F.countDistinct("at", "hash").alias("item_windows"))
    single = materialise(agreeing(matched, [*pair, "shift"]), "agreeing")
    before = Window.partitionBy(*pair).orderBy("shift")
    groups = (
        single.select(*pair, "shift")
        .distinct()
        .join(totals, ["item", "form"])
        .withColumn("new", F.coalesce(F.col("shift") - F.lag("shift").over(before) > F.col("item_windows"), F.lit(False)).cast("int"))
        .select(*pair, "shift", F.sum("new").over(before).alias("near"))
    )
    several = groups.groupBy(*pair, "near").agg(F.count("*").alias("n"), F.min("shift").alias("least")).where("n > 1")
    grouped = single.join(groups.join(several, [*pair, "near"]), [*pair, "shift"]).drop("shift").withColumnRenamed("least", "shift")
    aligned = (
        single.groupBy(*pair, "shift").agg(*found_at)
        .unionByName(agreeing(grouped, [*pair, "shift"]).groupBy(*pair, "shift").agg(*found_at))
        .join(totals, ["item", "form"])
        .withColumn("share", F.col("windows") / F.col("item_windows"))
        .where((F.col("share") >= share) | (F.col("windows") > passage - width))
    )
    best = Window.partitionBy("doc", "item").orderBy(F.desc("windows"), "shift", "form")
    return (
        aligned.withColumn("_r", F.row_number().over(best))
        .where("_r = 1")
        .select(F.col("doc").alias(doc_key), F.col("item").alias(item_key), "windows", "item_windows", "share", "first_word")
    )


def clean(docs: DataFrame, hits: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """The documents without a hit."""
    return docs.join(hits.select(doc_key).distinct(), doc_key, "left_anti").select(docs.columns)
