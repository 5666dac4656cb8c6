"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words.

The rank map is a literal: a perfect hash from a pair of token ids to the id of their
concatenation, which is its rank. ``Folder`` folds the merges with Spark's higher-order
functions, for columns of words. ``encode`` is for corpora: it cuts blocks of documents into words
in Arrow batches, folds the same merges over all distinct words of a block at once,
and puts the words of each document together. No row is shuffled, and no document split.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shirabe.llm.common import lean, sent

# The word pattern of the rank files. Classes: letter, number, white space, anything else.
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

PAIR = 1 << 16  # ids are below this
NONE = 1 << 62  # an empty slot of the rank map
FOLD_BYTES = 64  # longer words are merged with a heap, as folding takes their length squared
BLOCK_CHARS = 1 << 20
SPELLED = 1 << 18  # words of a group of documents that is put together at once


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def classes() -> np.ndarray:
    """Class of every code point."""
    points = "".join(chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000)
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = "".join(regex.findall(pattern, points))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


def word_starts(points: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Marks the first code point of every word; ``first`` marks the first one of every text.

    A word is a run of one class with one blank before it, or a contraction. Of
    white space before a word the last character stands alone, or goes with the
    word if it is a blank.
    """
    n = len(points)
    kind = table[points]
    space = kind == SPACE
    starts = first.copy()
    starts[1:] |= kind[1:] != kind[:-1]
    last = np.ones(n, bool)  # the next code point is in another run or text
    last[:-1] = starts[1:]
    closing = np.ones(n, bool)
    closing[:-1] = first[1:]
    # White space that other text follows: its last character leaves the run.
    starts |= space & last & ~closing
    # A blank goes with what follows it.
    after = np.zeros(n, bool)
    after[1:] = (points[:-1] == 32) & ~space[1:] & ~first[1:]
    starts &= ~after
    # Contractions: an apostrophe that begins a word, alone in its run.
    quote = np.flatnonzero((points == 39) & starts & last & ~closing)
    if len(quote):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        ends = np.concatenate([first, np.ones(2, bool)])
        done = np.zeros(len(quote), bool)
        for tail in CONTRACTIONS:
            hit = ~done & ~ends[quote + 1] & (padded[quote + 1] == ord(tail[0]))
            if len(tail) == 2:
                hit &= ~ends[quote + 2] & (padded[quote + 2] == ord(tail[1]))
            at = quote[hit]
            starts[at + 1] = False
            following = at + 1 + len(tail)
            starts[following[following < n]] = True
            done |= hit
    return starts


def split_words(texts: list[str], table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the number of words of each text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    filled = np.flatnonzero(lengths)
    first = np.zeros(len(points), bool)
    first[(np.cumsum(lengths) - lengths)[filled]] = True
    starts = word_starts(points, first, table) if len(points) else first
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    at = np.cumsum(width) - width
    offsets = np.append(at[starts], int(width.sum())).astype(np.int64)
    words = pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(whole.encode())]
    )
    counts = np.zeros(len(texts), np.int64)
    counts[filled] = np.add.reduceat(starts, (np.cumsum(lengths) - lengths)[filled]) if len(filled) else 0
    return words, counts


def rank_table(ranks: dict[bytes, int]) -> tuple[list[int], list[int], int, int]:
    """Perfect hash (displacements, entries) of all mergeable pairs of ids.

    The entry of a pair is ``(left * 2^16 + right) * 2^16 + rank``, found at
    ``(pair % slots + displacement[pair % buckets]) % slots``.
    """
    if max(ranks.values()) >= PAIR:
        raise ValueError("ids of 16 bits are expected")
    pairs = [
        (ranks[token[:cut]] * PAIR + ranks[token[cut:]], rank)
        for token, rank in ranks.items()
        for cut in range(1, len(token))
        if token[:cut] in ranks and token[cut:] in ranks
    ]
    # Two primes whose product is above any pair: pairs of one bucket never share a slot.
    buckets = 65537
    slots = max(131101, 2 * len(pairs))
    while any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        slots += 1
    groups: dict[int, list[tuple[int, int]]] = {}
    for pair, rank in pairs:
        groups.setdefault(pair % buckets, []).append((pair, rank))
    entries, moves = [NONE] * slots, [0] * buckets
    for bucket, items in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
        move = 0
        while any(entries[(pair % slots + move) % slots] != NONE for pair, _ in items):
            move += 1
        moves[bucket] = move
        for pair, rank in items:
            entries[(pair % slots + move) % slots] = pair * PAIR + rank
    return moves, entries, buckets, slots


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long word: the same merges, the next one taken from a heap."""
    n = len(word)
    ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(start: int) -> None:
        follower = ends[start]
        if follower < n:
            rank = ranks.get(word[start : ends[follower]])
            if rank is not None:
                heapq.heappush(heap, (rank, start, ends[follower]))

    for start in range(n):
        offer(start)
    while heap:
        _, start, end = heapq.heappop(heap)
        follower = ends[start] if alive[start] else n
        if follower >= n or not alive[start] or ends[follower] != end:
            continue
        alive[follower] = False
        ends[start] = end
        if end < n:
            before[end] = start
        offer(start)
        if before[start] >= 0:
            offer(before[start])
    out, start = [], 0
    while start < n:
        out.append(ranks[word[start : ends[start]]])
        start = ends[start]
    return out


class Ranks:
    """A vocabulary with its rank map as arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        moves, entries, self.buckets, self.slots = rank_table(ranks)
        self.moves, self.entries = np.array(moves, np.int64), np.array(entries, np.int64)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.ranks = ranks
        pieces: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            pieces[rank] = token
        self.pieces = pieces

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, below 2^16; larger for pairs without one."""
        pair = left * PAIR + right
        return self.entries[(pair % self.slots + self.moves[pair % self.buckets]) % self.slots] ^ (pair * PAIR)

    def fold(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merge words of one length, a row of byte ids each: (rows, their ids) by final length.

        Each step merges the pair of least rank, leftmost first, in every word that
        has one, so the words left all get shorter by one.
        """
        rows, done = np.arange(len(ids)), []
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            if ids.shape[1] == 1:
                done.append((rows, ids))
                break
            spot = ranks.argmin(axis=1)
            low = ranks[np.arange(len(rows)), spot]
            going = low < PAIR
            if not going.all():
                done.append((rows[~going], ids[~going]))
                rows, ids, ranks, spot, low = rows[going], ids[going], ranks[going], spot[going], low[going]
                if not len(rows):
                    break
            line = np.arange(len(rows))
            ids[line, spot] = low
            kept = np.ones(ids.shape, bool)
            kept[line, spot + 1] = False
            ids = ids[kept].reshape(len(rows), -1)
            kept = np.ones(ranks.shape, bool)
            kept[line, spot] = False
            ranks = ranks[kept].reshape(len(rows), -1)
            left = np.flatnonzero(spot > 0)
            ranks[left, spot[left] - 1] = self.rank(ids[left, spot[left] - 1], ids[left, spot[left]])
            right = np.flatnonzero(spot < ids.shape[1] - 1)
            ranks[right, spot[right]] = self.rank(ids[right, spot[right]], ids[right, spot[right] + 1])
        return done

    def words(self, words: pa.Array) -> pa.ListArray:
        """Ids of each of a list of words."""
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.frombuffer(b"".join(words.to_pylist()), np.uint8)
        begins = np.cumsum(sizes) - sizes
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            if size > FOLD_BYTES:
                for one in at:
                    word = data[begins[one] : begins[one] + size].tobytes()
                    found.append((np.array([one]), np.array([merge_long(word, self.ranks)], np.int64)))
            else:
                bytes_ = data[begins[at][:, None] + np.arange(size)]
                found += [(at[rows], ids) for rows, ids in self.fold(self.byte_ids[bytes_])]
        lengths = np.zeros(len(words), np.int64)
        for rows, ids in found:
            lengths[rows] = ids.shape[1]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.empty(ends[-1], np.int32)
        for rows, ids in found:
            flat[ends[rows][:, None] + np.arange(ids.shape[1])] = ids
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def encode(
    df: DataFrame, ranks: dict[bytes, int], key: str = "doc_id", text: str = "text", spelled: bool = False, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """One row per document: key, ``n_tokens``, ``ids`` and ``decoded`` (the bytes of the ids).

    ``ids`` are an array, or if ``spelled`` decimal numbers joined by one blank.
    Null and empty texts have no ids. Repeated and null keys keep their rows.
    Other columns are not carried along.
    """
    table = classes()
    shared = sent(df, Ranks(ranks))  # as large as the vocabulary

    def block(keys: list, texts: list[str], held: Ranks, pieces: pa.Array) -> Iterator[pa.RecordBatch]:
        words, counts = split_words(texts, table)
        listed = words.dictionary_encode()
        index = listed.indices.to_numpy(zero_copy_only=False)
        ids = held.words(listed.dictionary)
        sizes = ids.value_lengths().to_numpy(zero_copy_only=False)
        texts_of = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, ids.values.cast(pa.string())), " ") if spelled else None
        decoded = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, pieces.take(ids.values)), pa.scalar(b"", pa.binary()))
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        totals = np.concatenate([[0], np.cumsum(sizes[index])]).astype(np.int64)
        n_tokens = totals[ends[1:]] - totals[ends[:-1]]
        # Some documents at a time, so that only a part of the block is spelled out at once.
        hi = 0
        while hi < len(counts):
            lo, hi = hi, max(hi + 1, int(np.searchsorted(ends, ends[hi] + SPELLED, side="right")) - 1)
            taken = pa.array(index[ends[lo] : ends[hi]])
            cuts = pa.array((ends[lo : hi + 1] - ends[lo]).astype(np.int32))
            if spelled:
                listed_ids = pc.binary_join(pa.ListArray.from_arrays(cuts, texts_of.take(taken)), " ")
            else:
                tokens = totals[ends[lo : hi + 1]]
                listed_ids = pa.ListArray.from_arrays(pa.array((tokens - tokens[0]).astype(np.int32)), ids.take(taken).flatten())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[lo:hi], pa.int64()),
                    pa.array(n_tokens[lo:hi], pa.int64()),
                    listed_ids,
                    pc.binary_join(pa.ListArray.from_arrays(cuts, decoded.take(taken)), pa.scalar(b"", pa.binary())),
                ],
                names=["key", "n_tokens", "ids", "decoded"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        pieces = pa.array(held.pieces, pa.binary())
        keys, texts, chars = [], [], 0
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(k)
                texts.append(t or "")
                chars += len(texts[-1])
                if chars >= block_chars:
                    yield from block(keys, texts, held, pieces)
                    keys, texts, chars = [], [], 0
        if keys:
            yield from block(keys, texts, held, pieces)

    encoded = df.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(
        lean(run), f"key bigint, n_tokens bigint, ids {'string' if spelled else 'array<int>'}, decoded binary"
    )
    return encoded.withColumnRenamed("key", key)


class Folder:
    """Column expressions that encode and decode one word with literal tables."""

    def __init__(self, ranks: dict[bytes, int]):
        moves, entries, self.buckets, self.slots = rank_table(ranks)
        self.moves = F.from_json(F.lit(json.dumps(moves)), "array<bigint>")
        self.entries = F.from_json(F.lit(json.dumps(entries)), "array<bigint>")
        pieces: list[str | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            pieces[rank] = base64.b64encode(token).decode()
        self.pieces = F.from_json(F.lit(json.dumps(pieces)), "array<binary>")

    def rank(self, left: Column, right: Column) -> Column:
        """Rank of a pair, below 2^16; larger if the pair has none, null beyond the word's end."""
        pair = left * PAIR + right
        slot = (pair % self.slots + F.get(self.moves, (pair % self.buckets).cast("int"))) % self.slots
        return F.get(self.entries, slot.cast("int")).bitwiseXOR(pair * PAIR)

    def encode(self, word: Column) -> Column:
        """Ids of a word given as the ids of its bytes: merge the pair of least rank, leftmost first, until none is left."""

        def merge(state: Column, at: Column) -> Column:
            ids, ranks, low, spot = state["ids"], state["ranks"], at["low"], at["spot"]
            left = F.when(spot > 1, F.array(self.rank(F.get(ids, spot - 2), low))).otherwise(F.array().cast("array<bigint>"))
            return F.struct(
                F.concat(F.slice(ids, 1, spot - 1), F.array(low), F.slice(ids, spot + 2, F.size(ids))).alias("ids"),
                F.concat(
                    F.slice(ranks, 1, F.greatest(spot - 2, F.lit(0))),
                    left,
                    F.array(self.rank(low, F.get(ids, spot + 1))),
                    F.slice(ranks, spot + 2, F.size(ids)),
                ).alias("ranks"),
            )

        def step(state: Column, _: Column) -> Column:
            low = F.array_min(state["ranks"])
            at = F.array(F.struct(low.alias("low"), F.array_position(state["ranks"], low).cast("int").alias("spot")))
            return F.when(low < PAIR, F.get(F.transform(at, lambda a: merge(state, a)), F.lit(0))).otherwise(state)

        ids = word.cast("array<bigint>")
        start = F.struct(ids.alias("ids"), F.zip_with(ids, F.slice(ids, 2, F.size(ids)), self.rank).alias("ranks"))
        return F.aggregate(F.slice(word, 2, F.size(word)), start, step, lambda s: s["ids"])

    def decode(self, ids: Column) -> Column:
        """Bytes of a list of ids: their binary pieces, concatenated."""
        return F.aggregate(ids, F.lit(b""), lambda done, i: F.concat(done, F.get(self.pieces, i.cast("int"))))
