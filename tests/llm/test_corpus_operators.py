"""Archives, sharding, search, decontamination and set joins: brute force and edge cases."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import re
import struct
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shirabe.llm import common, decontaminate, jaccard, mtree, ring, warc

DOCS = "doc_id long, text string, size long, mark string"  # the last two clash with own names

# --- archives -----------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, sha string, head long"


def test_archive_round_trip(spark, tmp_path):
    texts = ["<p>same</p>"] * 40 + [None, "", "x" * 300_000, "é漢"] + [f"<p>{i}</p>" for i in range(30)]
    data = [(i, f"http://a.org/{i}\r\nX: y", t, "", 0) for i, t in enumerate(texts)]
    path = str(tmp_path / "warc")
    made = warc.write(spark.createDataFrame(data, PAGES).repartition(4), path, "page_id", "url", "html", roll_bytes=4000)
    assert len(made["files"]) > 4 and made["records"] == len(data)
    found = {int(r.key): r for r in warc.read(spark, path).collect()}
    last = {t or "": i for i, t in enumerate(texts)}
    for i, text in enumerate(texts):
        payload, head = (text or "").encode(), last[text or ""]
        expected = (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if head == i else "revisit", None if head == i else str(head))
        r = found[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == expected
        assert r.payload is None if head != i else bytes(r.payload) == payload
    again = str(tmp_path / "again")
    warc.write(spark.createDataFrame(data, PAGES).repartition(4), again, "page_id", "url", "html", roll_bytes=4000)
    assert json.loads(Path(path, "manifest.json").read_text()) == json.loads(Path(again, "manifest.json").read_text())


def test_archive_edge_cases(spark, tmp_path):
    empty = spark.createDataFrame([], PAGES)
    assert warc.write(empty, str(tmp_path / "e"), "page_id", "url", "html")["files"] == []
    assert warc.read(spark, str(tmp_path / "e")).collect() == []
    rows = [(7, "u", "a", "", 0), (7, "u", "a", "", 0), (None, "u", "a", "", 0), (3, None, "b", "", 0)]
    warc.write(spark.createDataFrame(rows, PAGES), str(tmp_path / "r"), "page_id", "url", "html")
    found = sorted((str(r.key), r.record_type, str(r.refers_to)) for r in warc.read(spark, str(tmp_path / "r")).collect())
    assert found == [("3", "response", "None"), ("7", "response", "None"), ("7", "response", "None"), ("None", "revisit", "7")]
    with pytest.raises(FileNotFoundError):
        warc.read(spark, str(tmp_path / "none"))
    file = next((tmp_path / "r").glob("*.warc.gz"))
    file.write_bytes(file.read_bytes()[:-9])
    with pytest.raises(Exception, match="cut off|damaged|records"):
        warc.read(spark, str(tmp_path / "r")).collect()


# --- sharding -----------------------------------------------------------------------------------


def test_ring_is_balanced_and_gapless(spark):
    data = [(i, "x" * (i % 50)) for i in range(1003)] + [(5, "same")] * 700 + [(None, None)] * 3
    df = spark.createDataFrame(data, "doc_id long, text string")
    found = ring.shard(df, ["doc_id", "text"], shards=7, replicas=8, cell_rows=64).collect()
    assert len(found) == len(data)
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = sorted(len(s) for s in slots.values())
    assert sizes[-1] - sizes[0] <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert ring.shard(df.limit(0), ["doc_id", "text"]).collect() == []


def test_ring_placement_overflows_clockwise():
    assert ring.place([5, 1, 0], [0, 1, 2], [2, 2, 2]) == [(0, 0, 2, 0, 0), (1, 0, 1, 1, 0), (0, 2, 3, 1, 1), (0, 3, 5, 2, 0)]
    counts = [random.Random(3).randint(0, 30) for _ in range(64)]
    owners = [s for _, s in ring.virtual_nodes(8, 8)]
    placed = ring.place(counts, owners, ring.capacities(sum(counts), 8))
    assert sum(e - s for _, s, e, _, _ in placed) == sum(counts)


def test_ring_by_loops(spark):
    keys = random.Random(9).sample(range(10**9), 900)
    found = {r.doc_id: r for r in ring.shard(spark.createDataFrame([(k,) for k in keys], "doc_id long"), ["doc_id"], shards=6, replicas=5, cell_rows=16).collect()}
    nodes, bounds = ring.virtual_nodes(6, 5), ring.capacities(len(keys), 6)
    at = {k: int.from_bytes(xxhash.xxh64(struct.pack("<q", k), seed=42).digest(), "big", signed=True) for k in keys}
    arc = {k: next((i for i, (place, _) in enumerate(nodes) if at[k] <= place), 0) for k in keys}
    assert {k: found[k].home for k in keys} == {k: nodes[arc[k]][1] for k in keys}
    owned = [sum(r.home == s for r in found.values()) for s in range(6)]
    stayed = [sum(r.home == s == r.shard for r in found.values()) for s in range(6)]
    assert stayed == [min(o, b) for o, b in zip(owned, bounds, strict=True)]
    # A fresh walk, one key at a time: after the owners, the rest of each arc goes on clockwise to a shard with room.
    load, moved = stayed[:], {}
    for i in range(len(nodes)):
        for _ in range(sum(arc[k] == i and found[k].shard != found[k].home for k in keys)):
            step = (i + 1) % len(nodes)
            while load[nodes[step][1]] == bounds[nodes[step][1]]:
                step = (step + 1) % len(nodes)
            shard = nodes[step][1]
            load[shard] += 1
            moved[i, shard] = moved.get((i, shard), 0) + 1
    got = {}
    for k, r in found.items():
        if r.shard != r.home:
            got[arc[k], r.shard] = got.get((arc[k], r.shard), 0) + 1
    assert got == moved and moved


def test_most_keys_stay_when_a_shard_is_added(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    before = {r.doc_id: r.shard for r in ring.shard(df, ["doc_id"], shards=8).collect()}
    after = {r.doc_id: r.shard for r in ring.shard(df, ["doc_id"], shards=9).collect()}
    assert sum(before[k] != after[k] for k in before) < 0.35 * len(before)


def test_write_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    ring.write_shards(df, ring.shard(df, ["doc_id"], shards=4), ["doc_id"], str(tmp_path / "out"), pieces=2)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(f"t{i}" for i in range(50))


# --- search -------------------------------------------------------------------------------------


def brute_top(ids, vectors, every, k):
    whole = np.floor(256 * vectors)
    out = []
    for i in np.flatnonzero(ids % every == 0):
        scores = whole @ whole[i]
        near = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), n + 1, int(ids[j]), int(scores[j])) for n, j in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "copies"])
def test_top_k_is_exact(spark, kind):
    picked = np.random.default_rng(1)
    vectors = picked.normal(size=(700, 12)).astype(np.float32).astype(float)
    if kind == "copies":
        vectors[:300] = vectors[0]
    data = [(i, [float(x) for x in v], "c") for i, v in enumerate(vectors)]
    odd = [(None, [1.0] * 12, "c"), (9000, None, "c"), (9050, [float("nan")] * 12, "c"), (9100, [None] + [1.0] * 11, "c"), (9150, [float("inf")] * 12, "c"), (9200, [], "c")]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, score string")
    tree = mtree.MTree(mtree.quantised(df, "vec_id", "embedding", 256), page=8, subtree=100, sample=64)
    assert len(tree.directory["parent"]) > 3
    found = tree.search(tree.rows.where("id % 50 = 0"), 5)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect())
    assert got == brute_top(np.arange(700), vectors, 50, 5)


def clustered(picked, rows, clusters):
    """Vectors of one norm in tight clusters, so that near ones have the large products."""
    vectors = np.repeat(picked.normal(size=(clusters, 16)), rows // clusters, axis=0) + 0.02 * picked.normal(size=(rows, 16))
    return np.floor(256 * 40 * vectors / np.linalg.norm(vectors, axis=1)[:, None])


def test_subtree_nodes_cover_their_entries_and_skip_most_products():
    picked = np.random.default_rng(2)
    shares = []
    for rows in (1000, 10_000):
        vectors = clustered(picked, rows, rows // 20)
        space = mtree.Space(16, float((vectors**2).sum(axis=1).max()))
        lifted = space.lift(vectors)
        tree = mtree.Subtree.grow(lifted, lifted[0], 32)
        assert sorted(tree.order.tolist()) == list(range(rows))
        lifted, entries = lifted[tree.order], vectors[tree.order].astype(np.int64)
        levels = {0: 0}
        for node in range(len(tree.begin)):
            centre = space.lift(vectors[:1])[0] if tree.centre[node] < 0 else lifted[tree.centre[node]]
            away = np.linalg.norm(lifted[tree.begin[node] : tree.end[node]] - centre, axis=1)
            assert away.max() <= tree.radius[node] + 1e-3
            if tree.child[node]:
                kids = range(tree.child[node], tree.child[node] + tree.children[node])
                levels |= {kid: levels[node] + 1 for kid in kids}
                assert [tree.begin[kids[0]], *(tree.end[kid] for kid in kids)] == [*(tree.begin[kid] for kid in kids), tree.end[node]]
            else:
                assert tree.end[node] - tree.begin[node] <= 32 and np.abs(away - tree.to_leaf[tree.begin[node] : tree.end[node]]).max() < 1e-2
        assert max(levels.values()) >= 2
        computed = 0
        for query in range(0, rows, rows // 50):
            own = entries[query]
            to_root = float(space.away((own**2).sum(), entries @ own)[np.flatnonzero(tree.order == 0)[0]])
            found, cost = tree.nearest(entries, own, to_root, 5, -(2.0**62), space, lambda places: (places, np.ones(len(places), bool)))
            scores = entries @ own
            assert [(-s, place) for s, _, place in found] == [(scores[j], j) for j in np.lexsort((np.arange(rows), -scores))[:5]]
            computed += cost
        shares.append(computed / (50 * rows))
    assert shares[0] < 0.5 and shares[1] < shares[0] / 2


def test_search_computes_few_of_all_products(spark):
    vectors = clustered(np.random.default_rng(3), 6000, 300) / 256
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    tree = mtree.MTree(mtree.quantised(df, "vec_id", "embedding", 256), page=16, subtree=400)
    found = tree.search(tree.rows.where("id % 50 = 0"), 5)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()) == brute_top(np.arange(6000), vectors, 50, 5)
    costs = [r.computed for r in tree.computed.collect()]
    assert len(costs) == 120 and sum(costs) < 0.25 * 120 * 6000


def test_top_k_of_repeated_ids_copies_and_large_norms(spark):
    schema = "vec_id long, embedding array<double>"
    big = float(1 << 20)  # times 256: products beyond 2^53, kept exact
    rows = [(0, [1.0, big + 1 / 256]), (1, [3.0, big]), (2, [2.0, big]), (3, [5.0, 7.0]), (3, [5.0, 7.0]), (4, [1e300, 1.0])]
    found = mtree.top_k(spark.createDataFrame(rows, schema), "vec_id", "embedding", 50, 5).orderBy("rank").collect()
    whole = [[int(256 * x) for x in v] for _, v in rows]
    score = lambda j: whole[0][0] * whole[j][0] + whole[0][1] * whole[j][1]
    assert [(r.vec_id, r.score) for r in found] == [(1, score(1)), (2, score(2)), (3, score(3)), (3, score(3))]
    # Of vectors of one id the least asks, and none of its rows is its own neighbour.
    rows = [(50, [2.0]), (50, [1.0]), (50, [2.0]), (7, [4.0]), (8, [4.0]), (9, [2.0])]
    found = mtree.top_k(spark.createDataFrame(rows, schema), "vec_id", "embedding", 50, 2).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in found] == [(50, 1, 7, 1 << 18), (50, 2, 8, 1 << 18)]


def test_top_k_edge_cases(spark):
    schema = "vec_id long, embedding array<float>"
    assert mtree.top_k(spark.createDataFrame([], schema), "vec_id", "embedding", 50, 5).collect() == []
    assert mtree.top_k(spark.createDataFrame([(0, [1.0])], schema), "vec_id", "embedding", 50, 5).collect() == []
    found = mtree.top_k(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0])], schema), "vec_id", "embedding", 50, 5)
    assert [(r.rank, r.vec_id, r.score) for r in found.orderBy("rank").collect()] == [(1, 2, 65536), (2, 1, 0)]


# --- decontamination ----------------------------------------------------------------------------

ITEM = "Today we learn that Maria has 1,000 apples and she gives 3 apples to Paul who then eats 3 apples quickly."


def test_templates_and_slots(spark):
    docs = [
        (1, "Noise here. Today we learn that Anna has 15 apples and she gives 4 apples to Peter who then eats 4 apples quickly. More.", 1, "m"),
        (2, "Today we learn that Anna has 15 apples and she gives 4 apples to Peter who then eats 9 apples quickly.", 1, "m"),  # 3 stands for 4 and 9
        (3, ITEM.upper(), 1, "m"), (4, None, 1, "m"), (5, "", 1, "m"), (6, "Today we learn that Maria has", 1, "m"), (7, "word " * 50_000 + ITEM, 1, "m"),
        (7, ITEM + " " + ITEM, 1, "m"), (None, ITEM, 1, "m"), (8, "it weighs 5 kg and runs 10 km in the rain", 1, "m"),
    ]
    bench = [(70, ITEM), (71, None), (72, "x"), (73, "it weighs 7 lb and runs 12 mi in the rain"), (73, "it weighs 7 lb and runs 12 mi in the rain")]
    found = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.share for r in found.collect()}
    assert {(1, 70), (7, 70), (8, 73)} <= set(got) and (2, 70) not in got and not {4, 5, 6, None} & {d for d, _ in got}
    kept = decontaminate.clean(spark.createDataFrame(docs, DOCS), found)
    assert kept.columns == ["doc_id", "text", "size", "mark"] and {r.doc_id for r in kept.collect()} >= {2, 4, 5, 6, None}


def test_case_and_names_at_the_start_of_a_sentence(spark):
    other = "Alice has 5 apples. Bob has 3 pears. Carol gives 2 plums to Dave. How many does Erin eat?"
    docs = [
        (3, ITEM.upper(), 1, "m"), (4, ITEM.lower(), 1, "m"), (5, ITEM.replace(".", ""), 1, "m"),
        (6, '"Zoe has 7 apples. Yan has 4 pears. Xenia gives 6 plums to Will. How many does Vera eat?"', 1, "m"),
        (7, "Zoe has 7 apples. Yan has 4 pears. Xenia gives 6 plums to Will. Why is it so late?", 1, "m"),
        (8, "Nothing of the kind stands in this text, which has as many words as the others have.", 1, "m"),
    ]
    bench = [(70, ITEM), (71, other)]
    found = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(3, 70), (4, 70), (5, 70), (6, 71), (7, 71)}


def test_moved_long_and_short_items(spark):
    words = [f"q{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    named = "we know that {} has 5 pens and that {} has 3 pens and that {} has 4 pens in a box"
    bench = [(1, " ".join(words[:40])), (2, " ".join(words)), (3, named.format("Ann", "Ben", "Cleo")), (4, "What is love?"), (5, "x")]
    docs = [
        (1, " ".join([*words[:20], "new", *words[20:40]]), 1, ""), (2, " ".join(words[100:150]), 1, ""), (3, " ".join(words[100:120]), 1, ""),
        (4, named.format("Mary Ann", "Jo Sue Lee", "Max"), 1, ""), (5, "what is LOVE", 1, ""), (6, "we ask what is love and x and more", 1, ""),
        (7, " ".join([*words[:20], *words[60:70], *words[20:40]]), 1, ""), (8, named.format("Ann", "Ann", "Cleo"), 1, ""),
    ]
    found = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.windows, r.item_windows) for r in found.collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 2), (4, 3), (5, 4), (7, 1), (7, 2), (8, 3)} and got[1, 1] == (26, 33) and got[2, 2] == (43, 193)


def test_verbatim_items_by_brute_force(spark):
    picked = random.Random(6)
    words = ["".join(picked.choices("abcdefgh", k=picked.randint(2, 6))) for _ in range(400)]
    items = [" ".join(picked.choices(words, k=picked.randint(15, 40))) for _ in range(20)]
    docs = []
    for i in range(150):
        body = picked.choices(words, k=picked.randint(0, 120))
        if i % 3 == 0:
            body.insert(picked.randint(0, len(body)), items[picked.randrange(20)])
        docs.append((i, " ".join(body), 0, ""))
    expected = {(d, k) for d, t, _, _ in docs for k, item in enumerate(items) if item in t}
    found = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected


def test_decontamination_of_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, ITEM, 0, "")], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, bench).collect() == []
    assert decontaminate.contaminated(docs.limit(0), spark.createDataFrame([(1, ITEM)], bench.schema)).collect() == []


# --- set join -----------------------------------------------------------------------------------


def shingles(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_classes(texts: dict) -> dict:
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = top(a), top(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def changed(words: list[str], times: int, picked: random.Random) -> str:
    words = list(words)
    for _ in range(times):
        at = picked.randrange(len(words))
        action = picked.random()
        if action < 0.4:
            words[at] = f"w{picked.randrange(10**6)}"
        elif action < 0.7 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, f"w{picked.randrange(10**6)}")
    return " ".join(words)


def test_classes_by_brute_force(spark):
    picked, texts = random.Random(8), {}
    for length in (1, 2, 4, 5, 6, 7, 9, 12, 17, 25, 40, 70, 120, 300):
        for _ in range(4):
            base = [f"v{picked.randrange(3000)}" for _ in range(length)]
            for _ in range(7):
                texts[len(texts)] = changed(base, picked.randint(0, 1 + length // 40), picked)
    line = "one very common line that many texts share in full and more"
    for _ in range(80):
        texts[len(texts)] = line + " " + " ".join(f"u{picked.randrange(10**6)}" for _ in range(picked.randint(1, 14)))
    for extra in (None, "", "  \n", "The SAME text", "the same\ttext", "É A b c d e", "é a b c d e"):
        texts[len(texts)] = extra
    texts.update({len(texts) + i: line for i in range(30)})
    docs = spark.createDataFrame([(i, t, 0, "") for i, t in texts.items()], DOCS).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs).collect()}
    assert got == brute_classes(texts)


def test_large_clusters_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 6)
    picked, texts = random.Random(9), {}
    base = [f"v{i}" for i in range(150)]
    for i in range(60):
        texts[i] = changed(base, picked.randint(0, 5), picked)
    docs = spark.createDataFrame([(i, t, 0, "") for i, t in texts.items()], DOCS)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs).collect()} == brute_classes(texts)


def test_links_of_very_long_texts(spark):
    words = lambda of: F.transform(F.sequence(F.lit(1), F.lit(800_000)), of)
    spelled = lambda i: F.concat(F.lit("w"), i.cast("string"))
    own = lambda i: F.when((i % 100_000 == 0) & (F.col("id") > 0), F.lit("x")).otherwise(spelled(i))
    docs = spark.range(2).select(F.col("id").alias("doc_id"), F.concat_ws(" ", words(own)).alias("text"))
    bands = jaccard.Bands(80)
    plain, deleting = bands.allocation(bands.band(799_996))
    assert plain + deleting > 1 << 15
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(docs).collect()}
    assert got == {(0, 799_996, 0), (1, 799_996, 0)}


def test_set_join_edge_cases(spark):
    assert jaccard.classes(spark.createDataFrame([], DOCS)).collect() == []
    data = [(2, "a b c d e f", 0, ""), (2, "a b c d e f", 0, ""), (None, "a b c d e f", 0, ""), (1, None, 0, ""), (None, "", 0, ""), (9, "q r s t u v w " * 3000, 0, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(spark.createDataFrame(data, DOCS)).collect()), key=str)
    assert got == sorted([(2, 2, 2), (2, 2, 2), (None, 2, 2), (1, 0, 1), (None, 0, None), (9, 7, 9)], key=str)


def test_bands_cover_all_similar_sizes():
    bands = jaccard.Bands(80)
    for size in range(1, 400):
        low, high = bands.edges(bands.band(size))
        assert low <= size <= high and bands.band(size * 100 // 80) - bands.band(size) in (0, 1)
        plain, deleting = bands.allocation(bands.band(size))
        assert plain + 2 * deleting > bands.difference(bands.band(size))


def test_components_of_no_edges(spark):
    late = spark.range(100).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a % 7 > b * 100").repartition(3)
    for edges in (spark.createDataFrame([], "a long, b long"), spark.createDataFrame([(1, 1)], "a long, b long"), late):
        assert common.components(edges).isEmpty()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 102), (102, 101), (200, 200)] + [(500 + i, 500) for i in range(40)]
    found = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 1 for i in range(2, 31)) and found[101] == found[102] == 100 and 200 not in found
    assert all(found[500 + i] == 500 for i in range(1, 40))
