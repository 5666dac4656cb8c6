"""Prefix tries, periodic runs and risk-controlled rules: brute force and edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shirabe.llm import periodic, prefix_trie, quality, queries, tour
from shirabe.llm import words as w

# --- prefix trie --------------------------------------------------------------------------------

CONVERSATIONS = "conv_id long, turn long, role string, text string, depth string, x string, n string"


def nodes_of(rows, head, base):
    """All nodes by plain loops over whole prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in own.items()}
    whole = {c: own.get(base(c), [])[: head(c)] + turns[head(c) :] for c, turns in own.items()}
    members, children, sums, out = defaultdict(list), defaultdict(list), {}, []
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].append(prefix)
    for prefix in sorted(members, key=len, reverse=True):
        below = [sums[p] for p in children[prefix]]
        own_saved = (len(members[prefix]) - 1) * len(prefix[-1][1]) if prefix else 0
        sums[prefix] = (sum(b[0] for b in below) or 1, own_saved + sum(b[1] for b in below))
        ends = ",".join(str(c) for c in sorted(members[prefix]) if len(whole[c]) == len(prefix))
        parent = min(members[prefix[:-1]]) if prefix else None
        out.append((min(members[prefix]), len(prefix), parent, len(members[prefix]), len(children[prefix]), *sums[prefix], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def crc_head(c):
    return zlib.crc32(str(c).encode()) % 6


def hundred(c):
    return c - (c % 100 if c >= 0 else -(-c % 100))


def built(spark, rows, bound=tour.BOUND, stretch=tour.STRETCH, head=None):
    df, conv = spark.createDataFrame(rows, CONVERSATIONS), F.col("conv_id")
    steps = prefix_trie.rebuilt(prefix_trie.numbered(df), head if head is not None else F.crc32(conv.cast("string")) % 6, conv - conv % 100, 5)
    return prefix_trie.trie(steps, bound, stretch)


def conversations(seed):
    """Shared beginnings, missing and short first conversations, nulls, ties, repeated rows, negative ids."""
    picked, rows = random.Random(seed), []
    for c in [*picked.sample(range(-150, 420), 60), 7, 8, 9]:
        for turn in range(picked.choice([1, 1, 2, 4, 9])):
            rows.append((c, picked.choice([turn, turn, None]), picked.choice(["user", "bot", None, ""]), picked.choice(["a", "b", "", None, "é漢"]), "d", "x", "n"))
    return rows + rows[:5] + [(None, 1, "user", "lost", "d", "x", "n")] + [(300, i, "user", str(i % 3), "d", "x", "n") for i in range(150)]


@pytest.mark.parametrize("bound, stretch", [(tour.BOUND, tour.STRETCH), (5, 16)])
def test_trie_against_loops(spark, bound, stretch):
    rows = conversations(bound)
    got = sorted((tuple(r)[:8] for r in built(spark, rows, bound, stretch).collect()), key=str)
    assert got == nodes_of(rows, crc_head, hundred)


def test_many_copies_and_many_children(spark):
    rows = [(c, 0, "user", "same", "", "", "") for c in range(1, 900)] + [(c, 0, "user", str(c), "", "", "") for c in range(1000, 1500)]
    got = sorted((tuple(r)[:8] for r in built(spark, rows, head=F.lit(0)).collect()), key=str)
    assert got == nodes_of(rows, lambda c: 0, hundred)


def test_trie_edge_cases(spark):
    assert built(spark, []).collect() == []
    assert built(spark, [(None, 0, "user", "a", "", "", "")]).collect() == []
    # Conversation 101 lacks its first one, and all its turns lie in what that would give: it is empty, and ends at the root.
    lone = next(c for c in range(101, 200) if crc_head(c) >= 1)
    (root,) = built(spark, [(lone, 0, "user", "a", "", "", "")]).collect()
    assert tuple(root)[:7] == (lone, 0, None, 1, 0, 1, 0) and root.ends_sha256 == hashlib.sha256(str(lone).encode()).hexdigest()


def test_tour_places_are_those_of_a_walk(spark):
    picked, parents = random.Random(2), [None]
    parents += [picked.randrange(i) for i in range(1, 300)]
    depth, children = [0] * 300, defaultdict(list)
    for i in range(1, 300):
        depth[i] = depth[parents[i]] + 1
        children[parents[i]].append(i)
    order, stack, places = 0, [(0, False)], {}
    while stack:
        node, leaving = stack.pop()
        places.setdefault(node, []).append(order)
        order += 1
        if not leaving:
            stack += [(node, True), *[(c, False) for c in reversed(children[node])]]
    df = spark.createDataFrame([(i, depth[i], parents[i], i) for i in range(300)], "node long, depth long, parent long, weight long")
    for bound in (1000, 7):
        got = {r.node: r for r in tour.subtree_sums(df, bound=bound, stretch=32).collect()}
        assert {i: [r.entered, r.left] for i, r in got.items()} == places
        for i in range(300):
            below = [j for j in range(300) if places[i][0] <= places[j][0] and places[j][1] <= places[i][1]]
            assert (got[i].subtree_weight, got[i].n_leaves) == (sum(below), sum(not children[j] for j in below))


def test_long_digest_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    ends = spark.range(1000).selectExpr("cast(id % 3 = 0 as bigint) as depth", "1L as x", "2L as y", "(id * 37) % 1000 as conv_id")
    got = {r.depth: r.ends_sha256 for r in prefix_trie.end_digests(ends).collect()}
    ids = [sorted(i * 37 % 1000 for i in range(1000) if (i % 3 == 0) == bool(k)) for k in (0, 1)]
    assert got == {k: hashlib.sha256(",".join(map(str, ids[k])).encode()).hexdigest() for k in (0, 1)}


# --- periodic runs ------------------------------------------------------------------------------


def plain_runs(items, least=6, power=4):
    """Maximal stretches of every period, each under its smallest one."""
    found = {}
    for q in range(1, len(items) // power + 1):
        i = 0
        while i + q < len(items):
            j = i
            while j + q < len(items) and items[j] == items[j + q]:
                j += 1
            if j - i + q >= max(least, power * q) and j > i:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic_items(picked):
    n = picked.randint(0, 90)
    items = [picked.randrange(picked.randint(1, 4)) for _ in range(n)]
    for _ in range(picked.randint(0, 3)):
        if n > 4:
            p, a = picked.randint(1, n // 4), picked.randrange(n)
            for i in range(a + p, min(n, a + picked.randint(0, n))):
                items[i] = items[i - p]
    return items


@pytest.mark.parametrize("least, power", [(6, 4), (1, 3), (12, 5)])
def test_runs_against_loops(least, power):
    picked = random.Random(power)
    for _ in range(400):
        items = periodic_items(picked)
        got = periodic.runs(np.array(items, np.int64), least, power)
        assert [tuple(int(x) for x in r) for r in zip(*got, strict=True)] == plain_runs(items, least, power)


def test_runs_of_texts(spark):
    picked = random.Random(9)
    texts = [" ".join("abcd"[i] for i in periodic_items(picked)) for _ in range(60)]
    texts += [None, "", " \t\n", "x y " * 9, "　 " * 8, "a " * 5, "a " * 6, "é漢 z " * 40, "\x00 \x00 " * 4]
    data = [(i, t, "r", 1) for i, t in enumerate(texts)] + [(None, "b " * 7, "r", 1), (3, texts[3], "r", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, runs string, key int").repartition(3)
    for r in periodic.find(df).collect():
        text = "b " * 7 if r.doc_id is None else texts[r.doc_id]
        items = (text or "").encode().split()
        expected = plain_runs(items)
        gone = {i for s, n, q in expected for i in range(s + q, s + n)}
        assert r.n_words == len(items) and [tuple(x) for x in r.runs] == expected
        assert r.collapsed == b" ".join(x for i, x in enumerate(items) if i not in gone).decode()
    assert periodic.find(df.limit(0)).collect() == []
    named = spark.createDataFrame([("k", "a " * 8)], "id string, body string")
    assert [(r.id, [tuple(x) for x in r.runs]) for r in periodic.find(named, "id", "body").collect()] == [("k", [(0, 8, 1)])]


def test_a_very_long_text_takes_little(spark):
    ids = np.concatenate([np.arange(200_000), np.tile(np.arange(1000), 300), np.zeros(200_000, np.int64)])
    start, size, period = periodic.runs(ids)
    assert (period.tolist(), start.tolist()) == ([1000, 1], [200_000, 500_000])
    assert size.tolist() == [300_001, 200_000]  # the first zero continues the numbers


def test_words_go_round(spark):
    text = " ".join(f"w{i}" for i in range(97)) + "  \n end"
    rows = {r.doc_id: r.text for r in queries.looped(spark.range(300).selectExpr("id as doc_id", f"'{text}' as text")).collect()}
    words = text.split()
    for i, got in rows.items():
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert got == (text if h % 10 else " ".join(words[j if j < a else a + (j - a) % p] for j in range(n)))


# --- quality rules ------------------------------------------------------------------------------


def plain_counts(text):
    words = text.encode().split()
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(5)}
    held = [line for line in text.split("\n") if line.encode().split()]
    return len(words), sum(len(x.decode()) for x in words), sum(text.count(c) for c in "#*$%&|<>"), len(held) - len(set(held)), len(covered)


def test_counts_against_loops(spark):
    picked = random.Random(4)
    texts = ["".join(picked.choices("ab \n#é漢| \t", k=picked.randint(0, 200))) for _ in range(150)]
    texts += ["one two three four five six " * 3, "x y\r\nx y\nx y\n x y", "", None, "\n \n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    for r in quality.counted(df).collect():
        assert tuple(r)[1:6] == plain_counts(texts[r.doc_id] or "")
    assert quality.counted(df.limit(0)).collect() == []


def test_binomial_tail_is_exact():
    for n, risk in [(1, 0.3), (7, 0.05), (60, 0.02), (40, 0.9)]:
        p = Fraction(risk)
        for k in range(n + 1):
            exact = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert quality.tail(k, n, risk) == pytest.approx(float(exact), rel=1e-9, abs=1e-12)
    assert quality.tail(900, 100_000, 0.01) == pytest.approx(6.8e-4, rel=0.1)


def labelled(picked, n, bad, noise=0.0):
    """Texts of which ``bad`` are full of symbols; a part ``noise`` of the good ones is as well."""
    rows = []
    for i in range(n):
        good = picked.random() >= bad
        odd = not good or picked.random() < noise
        words = [picked.choice("abcdefghijklmnop") * picked.randint(2, 6) + str(picked.random())[2:4] for _ in range(30)]
        rows.append((i, " ".join(x + "###" * odd for x in words), picked.choice(["en", "de", None]), int(good)))
    return rows


def test_symbols_are_learned_and_good_rows_stay(spark):
    rows = labelled(random.Random(1), 1500, 0.3)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").withColumn("kept", F.lit("clash"))
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] % 3], "doc_id long, quality int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == 1500
    for r in got:
        assert r.kept == bool(rows[r.doc_id][3]) and (r.kept or r.rule in ("symbols", "long_words"))


def test_no_stratum_loses_more_than_the_risk(spark):
    """Good rows of one stratum look bad: it keeps them, the others still reject."""
    rows = labelled(random.Random(2), 1200, 0.3)
    rows = [(i, " ".join(x.rstrip("#") + "###" for x in t.split()) if lang == "de" else t, lang, good) for i, t, lang, good in rows]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    got = quality.judge(docs, labels, lift=1.5).collect()
    for lang in ("en", "de", None):
        good = [r for r in got if r.stratum == lang and rows[r.doc_id][3]]
        assert sum(not r.kept for r in good) <= 0.05 * len(good)
    assert all(not r.kept for r in got if r.stratum == "en" and not rows[r.doc_id][3])


def test_bounds_hold_in_most_trials(spark):
    """With a rule that truly rejects more than the risk, hardly any of many strata is certified."""
    picked, risk = random.Random(3), 0.05
    rows = [(f"s{i}", 0 if picked.random() < 1.2 * risk else None) for i in range(150) for _ in range(200)]
    found = quality.certified(spark.createDataFrame(rows, "stratum string, _step int"), "stratum", 1, risk, 0.05 * 150).collect()
    assert len(found) == 150 and sum(r.last_step >= 0 for r in found) <= 0.05 * 150
    alone = spark.createDataFrame([(None, None)] * 200 + [(None, 1)] * 2, "stratum string, _step int")
    (row,) = quality.certified(alone, "stratum", 3, risk, 0.05).collect()
    assert (row.stratum, row.n_good, row.last_step, row.n_rejected) == (None, 202, 2, 2)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None), (None, "a b c d e f g h i j", "x"), (None, "a b c d e f g h i j", "x"), (2, "", "x")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame([(None, 0), (1, None), (2, 1), (2, 0), (2, 0)], "doc_id long, quality int")
    assert [(r.doc_id, r.good) for r in quality.labels_of(odd).collect()] == [(2, False)]
    for labels in (none, odd):
        got = sorted(((r.doc_id, r.base_failed, r.kept) for r in quality.judge(docs, labels).collect()), key=str)
        assert got == [(1, True, False), (2, True, False), (None, False, True), (None, False, True)]
    assert quality.judge(docs.limit(0), odd).collect() == []


# --- blocks -------------------------------------------------------------------------------------


def test_blocks_keep_order_and_limits():
    texts = [b"a" * n for n in (3, 9, 1, 1, 20, 2)] + [None, b""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts, pa.binary())], names=["k", "t"])
    got = [(keys.to_pylist(), [len(t) for t in held]) for keys, held in w.blocks(iter([batch]), 10)]
    assert got == [([0], [3]), ([1, 2], [9, 1]), ([3], [1]), ([4], [20]), ([5, 6, 7], [2, 0, 0])]
    assert list(w.blocks(iter([batch.slice(0, 0)]))) == []
