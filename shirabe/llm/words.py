"""Words of whole texts as integer names, a block of documents at a time.

A word is a run of bytes without blank, tab, line feed, vertical tab, form feed and
carriage return, which is what ``bytes.split`` cuts out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text taken at once; one longer text is a block of its own.
BLOCK_BYTES = 1 << 22


def blocks(batches: Iterator[pa.RecordBatch], block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(keys, texts) of some rows at a time, from batches of a key and a binary text; a null text is empty."""
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        lo, held = 0, 0
        for hi in range(len(texts)):
            size = len(texts[hi].as_buffer() or b"") if texts[hi].is_valid else 0
            if hi > lo and held + size > block_bytes:
                yield keys.slice(lo, hi - lo), [t or b"" for t in texts.slice(lo, hi - lo).to_pylist()]
                lo, held = hi, 0
            held += size
        if lo < len(texts):
            yield keys.slice(lo), [t or b"" for t in texts.slice(lo).to_pylist()]


def named(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of all texts in one row, and where each text starts and the last one ends.

    Equal words of one text have one name; names of different texts differ, so no factor
    that crosses the end of a text occurs twice.
    """
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(words) for words in texts], out=starts[1:])
    ids = np.empty(starts[-1], np.int64)
    given = 0
    for words, lo, hi in zip(texts, starts[:-1], starts[1:], strict=True):
        index = {word: given + i for i, word in enumerate(dict.fromkeys(words))}
        given += len(index)
        ids[lo:hi] = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    return ids, starts


def sorted_names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, names, same): a stable order of ``keys``, their ranks, and whether neighbours in that order are equal."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    names = np.empty(len(keys), np.int64)
    names[order] = np.concatenate([[0], np.cumsum(~same)]) if len(keys) else 0
    return order, names, same


def repeated(order: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice


def joined(names: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of factors made of that at ``i`` and that at ``i + step``, for the positions of ``at`` (rising) where both are named."""
    after = np.searchsorted(at, at + step)
    both = np.flatnonzero((after < len(at)) & (at[np.minimum(after, len(at) - 1)] == at + step)) if len(at) else np.zeros(0, np.int64)
    width = int(names.max()) + 1 if len(names) else 1
    return names[both] * width + names[after[both]], at[both]
