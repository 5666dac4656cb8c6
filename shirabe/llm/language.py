"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (1 to 3) present in
both, normalised by their own counts: a blended-spectrum presence kernel. A
Nystroem map through a fixed number of landmark texts makes it a feature space, in which
one-versus-rest ridge regression is fitted. Batches of texts are scored by two
matrix products: presence by landmarks, then landmarks by languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shirabe.llm.common import give_back, sent, unused

SYMBOLS = 64
SPACE = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
PIECE = 1 << 20
BATCH = 256
UNKNOWN = "und"


def symbol_table() -> np.ndarray:
    """Symbol of each code point: 1 to 26 for a to z, 27 to 63 for other letters, 0 for the rest; case is folded."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        letter = chr(point)
        if letter.isalpha():
            low = ord(letter.lower()[0])
            table[point] = low - 96 if 97 <= low <= 122 else 27 + low % 37
    return table


def gram_codes(text: str, table: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
    """Codes of all 1- to 3-grams of a text, a piece at a time, and whether the piece has a letter.

    Runs of non-letters count as one blank; a text begins and ends with one.
    Pieces overlap by two symbols, so no n-gram is lost.
    """
    tail = np.zeros(1, np.int32)
    for start in range(0, len(text), PIECE):
        piece = text[start : start + PIECE]
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        last = np.zeros(int(start + PIECE >= len(text)), np.int32)
        signs = np.concatenate([tail, table[points], last]).astype(np.int32)
        kept = np.ones(len(signs), bool)
        kept[1:] = (signs[1:] | signs[:-1]) != 0
        signs = signs[kept]
        two = signs[:-1] * SYMBOLS + signs[1:]
        three = two[:-1] * SYMBOLS + signs[2:]
        yield np.concatenate([signs, two + SYMBOLS, three + (SYMBOLS + SYMBOLS**2)]), bool(signs.any())
        tail = signs[-2:]


@dataclass
class Model:
    """A fitted classifier; its size depends on the parameters alone."""

    table: np.ndarray
    columns: np.ndarray  # feature of each n-gram code, the last one for n-grams of no landmark
    landmarks: np.ndarray  # features by landmarks, normalised
    weights: np.ndarray  # landmarks by languages
    languages: list[str]

    def presence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """0/1 features of each text and whether it has a letter."""
        found = np.zeros((len(texts), self.landmarks.shape[0] + 1), np.float32)
        lettered = np.zeros(len(texts), bool)
        for row, text in enumerate(texts):
            for codes, letters in gram_codes(text or "", self.table):
                found[row, self.columns[codes]] = 1
                lettered[row] |= letters
        return found[:, :-1], lettered

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each text; ``und`` without a letter or a learned language."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        found, lettered = self.presence(texts)
        kernel = (found @ self.landmarks) / np.sqrt(np.maximum(found.sum(axis=1, keepdims=True), 1))
        marks = kernel @ self.weights
        best = marks.argmax(axis=1)
        score = np.clip((marks.max(axis=1) + 1) / 2, 0, 1)
        return (
            [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)],
            np.where(lettered, score, 0.0).astype(float),
        )


def sample(df: DataFrame, key: str, text: str, lang: str, rows: int, labels: int) -> list[tuple[str, np.ndarray]]:
    """(language, n-gram codes) of labelled texts: as many of each language, one at least, and at most ``max(rows, labels)`` in all.

    Texts are drawn by the hash of key and text; equal rows count once. The ``labels`` most frequent languages are learned. A hash
    bound lets about three times as many rows through as are wanted, the first in hash order are taken. The
    codes are made on the executors; each text gives at most ``SPACE`` of them.
    """
    hashed = F.pmod(F.xxhash64(F.lit("sample"), F.col(key), F.col(text)), F.lit(1 << 40)) / float(1 << 40)
    labelled = df.select(F.col(lang).alias("lang"), F.col(text).alias("text"), hashed.alias("h"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).orderBy(F.desc("n"), "lang").limit(labels)
    known = df.sparkSession.createDataFrame(counts.collect(), counts.schema)
    each = max(1, rows // max(1, known.count()))
    # The first row of each label is let through, so none goes without; ``labels`` rows at most are broadcast.
    limits = F.broadcast(known.select("lang", F.greatest(F.lit(3.0 * each) / F.col("n"), "least").alias("limit")))
    near = labelled.join(limits, "lang").where("h <= limit").groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("h")
    table = symbol_table()

    @F.pandas_udf("binary")
    def codes(texts: pd.Series) -> pd.Series:
        def one(value):
            parts = [np.unique(c) for c, _ in gram_codes(value or "", table)]
            return (np.unique(np.concatenate(parts)) if parts else np.zeros(0)).astype(np.int32).tobytes()

        return texts.map(one)

    drawn = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= each)
    found = drawn.select("lang", "h", codes("text").alias("codes")).collect()
    found.sort(key=lambda r: (r["h"], r["lang"], bytes(r["codes"])))
    return [(r["lang"], np.frombuffer(bytes(r["codes"]), np.int32)) for r in found]


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = 1600, landmarks: int = 128, ridge: float = 1e-2, labels: int = 256) -> Model:
    """Fit on a sample of at most ``rows`` labelled texts, or one per language (the documented bounds); rows without text or label are left out.

    The ``labels`` most frequent languages are learned; texts of others are taken for one of these.

    Landmarks are the first texts of each language in hash order. Features are
    the n-grams present in at least two landmarks, or in one if there are too few texts for that.
    """
    drawn = [x for x in sample(df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()), key, text, lang, rows, labels) if len(x[1])]
    languages = sorted({x[0] for x in drawn})
    table = symbol_table()
    if not drawn:
        return Model(table, np.zeros(SPACE, np.int32), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), [])
    # Long texts hold most n-grams of a language, short ones look like what they are: take every length.
    chosen = [x for language in languages for x in [y for y in drawn if y[0] == language][: max(1, landmarks // len(languages))]][:rows]
    spread = np.bincount(np.concatenate([c for _, c in chosen]), minlength=SPACE)
    features = np.flatnonzero(spread >= (2 if len(chosen) > 2 * len(languages) else 1))
    columns = np.full(SPACE, len(features), np.int32)
    columns[features] = np.arange(len(features), dtype=np.int32)

    def matrix(items) -> np.ndarray:
        out = np.zeros((len(items), len(features) + 1), np.float32)
        for row, (_, codes) in enumerate(items):
            out[row, columns[codes]] = 1
        out = out[:, :-1]
        return out / np.sqrt(np.maximum(out.sum(axis=1, keepdims=True), 1))

    marks = matrix(chosen)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    mapped = np.concatenate([(matrix(drawn[i : i + rows]) @ marks.T).astype(np.float64) for i in range(0, len(drawn), rows)]) @ root
    goal = np.array([[1.0 if x[0] == language else -1.0 for language in languages] for x in drawn])
    solved = np.linalg.solve(mapped.T @ mapped + ridge * len(drawn) / 100 * np.eye(mapped.shape[1]), mapped.T @ goal)
    return Model(table, columns, np.ascontiguousarray(marks.T), (root @ solved).astype(np.float32), languages)


def predicted(df: DataFrame, model: Model, text: str = "text") -> Column:
    """Struct of ``lang_pred`` and ``score`` for each whole text; the model is broadcast, its size is bounded by its parameters."""
    shared = sent(df, model)

    @F.pandas_udf("lang_pred string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        for texts in batches:
            names, scores = [], []
            for start in range(0, len(texts), BATCH):
                name, score = fitted.predict([t if isinstance(t, str) else None for t in texts[start : start + BATCH]])
                names += name
                scores.append(score)
            yield pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores) if scores else []})
        give_back()

    return scored(F.col(text))


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``; columns of these names are replaced."""
    kept, made = [c for c in df.columns if c.lower() not in ("lang_pred", "score")], unused(df, "_p")
    return df.withColumn(made, predicted(df, model, text)).select(*kept, f"{made}.lang_pred", f"{made}.score")


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of the key as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))
