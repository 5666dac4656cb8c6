"""Runs of periodic words: a dictionary of basic factors over the words of each text.

Factors of 1, 2, 4, ... words are named by joining the names of two halves. At length L
the next occurrence of a factor at most twice L further on is its successor, and positions
whose successors are q away form the progressions i, i + q, i + 2q, ... that propose the
period q. If q is at most L, neighbouring progressions of one difference cover a run
exactly: no factor inside has a nearer occurrence (that would give the run a smaller
period), and the factors over its ends differ from those q further on. So joining
neighbouring progressions extends a proposal to its maximal run. A period longer than L
is left to the next length, where it is at most L; each period thus belongs to the one
length with L / 2 < q <= L, and no run is found twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shirabe.llm import words as w


def runs(ids: np.ndarray, least: int = 6, power: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every maximal run of ``ids`` of at least ``least`` and ``power`` (3 or more) periods, by start, then period."""
    if power < 3:
        raise ValueError("a run holds three periods or more")
    at, keys, length = np.arange(len(ids)), ids, 1
    found: list[np.ndarray] = []
    while len(at):
        order, names, same = w.sorted_names(keys)
        left, right = at[order[:-1][same]], at[order[1:][same]]
        gap = right - left
        near = (gap <= length) & (2 * gap > length)
        where = np.argsort(left[near])
        left, gap = left[near][where], gap[near][where]
        if len(left):
            begins = np.flatnonzero(np.concatenate([[True], (np.diff(left) != 1) | (np.diff(gap) != 0)]))
            ends = np.concatenate([begins[1:], [len(left)]]) - 1
            size = left[ends] - left[begins] + gap[begins] + length
            enough = size >= np.maximum(least, power * gap[begins])
            found.append(np.stack([left[begins], size, gap[begins]])[:, enough])
        # A factor that occurs once is in no run of a longer period.
        again = w.repeated(order, same)
        keys, at = w.joined(names[again], at[again], length)
        length *= 2
    start, size, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    by = np.lexsort((period, start))
    return start[by], size[by], period[by]


def kept_words(n: int, start: np.ndarray, size: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether each of ``n`` words stays: those that runs hold after their first period go."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + size, -1)
    return np.cumsum(edge[:-1]) == 0


def find(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 6, power: int = 4) -> DataFrame:
    """One row per row of ``df``: key, ``n_words``, ``runs`` (array of start, length, period) and ``collapsed``.

    Runs are those of at least ``least`` words and ``power`` periods, by start, then period; runs of
    different periods may overlap. ``collapsed`` is the text without the words that a run holds after its
    first period, joined by one blank. Null and empty texts have no runs and an empty ``collapsed``.
    Keys may be null, repeated and of any type; other columns are not carried along. A text is one
    task's work, in memory that grows with its length alone.
    """
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in w.blocks(batches):
            split = [t.split() for t in texts]
            ids, starts = w.named(split)
            start, size, period = runs(ids, least, power)
            kept = kept_words(len(ids), start, size, period)
            cuts = np.searchsorted(start, starts).astype(np.int32)
            owner = np.repeat(np.arange(len(split)), np.diff(cuts))
            parts = [pa.array(x) for x in (start - starts[owner], size, period)]
            listed = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
            short = []
            for words, lo, hi in zip(split, starts[:-1], starts[1:], strict=True):
                stays = kept[lo:hi]
                short.append(b" ".join(words if stays.all() else [words[i] for i in np.flatnonzero(stays)]))
            columns = [keys, pa.array(np.diff(starts)), listed, pa.array(short, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_words", "runs", "collapsed"])

    layout = f"key {kind.simpleString()}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return df.select(F.col(key), F.col(text).cast("binary")).mapInArrow(run, layout).withColumnRenamed("key", key)
