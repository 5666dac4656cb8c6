"""Texts made to be slow: very many equal lines, stray tags and matches."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from shirabe.llm import pages, pii


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("matches", [pages.MATCHES, 3])
def test_common_lines_are_a_longest_subsequence(monkeypatch, matches):
    monkeypatch.setattr(pages, "MATCHES", matches)
    picked = random.Random(matches)
    for _ in range(300):
        kinds = picked.choice([1, 2, 5])
        a, b = ([picked.randrange(kinds) for _ in range(picked.randint(0, 25))] for _ in "ab")
        found = pages.common(a, b)
        rest = iter(b)
        assert len(found) == longest(a, b) and found == sorted(set(found)) and all(a[i] in rest for i in found)


def test_pages_in_linear_time():
    start = time.perf_counter()
    assert pages.common([1, *[7] * 100_000, 2], [3, *[7] * 100_000, 4]) == list(range(1, 100_001))
    assert pages.lines_of("<span>" * 100_000 + "</b>" * 100_000 + "x") == [("x", pages.OUTSIDE)]
    assert time.perf_counter() - start < 30


def test_class_words_inside_an_article():
    page = (
        '<article><p>one</p><div class="share-price">two</div><p class="search results">three</p><div class="share-buttons">no</div>'
        '<div class="related-posts">no</div></article><div class="share-price">no</div>'
    )
    lines = pages.lines_of(page)
    assert [text for text, place in lines if place == pages.INSIDE] == ["one", "two", "three"]
    assert lines[-1][1] == pages.DROPPED


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 700])
def test_places_of_matches(spark, n):
    text = "é漢 " + "".join(f"u{i}@x{'y' * (i % 3)}.org," for i in range(n)) + " end"
    (row,) = spark.createDataFrame([(text,)], "text string").select(pii.located(F.col("text"), pii.PATTERNS["email"]).alias("s")).collect()
    assert len(row.s) == n and all(text[s.start : s.end] == s.value and "@" in s.value for s in row.s)


def test_many_matches_in_one_text(spark):
    df = spark.range(1).select(F.repeat(F.lit("a.b@example.org "), 100_000).alias("text")).select(F.size(pii.located(F.col("text"), pii.PATTERNS["email"])))
    start = time.perf_counter()
    assert df.first()[0] == 100_000
    assert time.perf_counter() - start < 60
