"""The corpus pipeline against a brute-force version on planted documents."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from shirabe.llm import bpe, language


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    picked, path = random.Random(11), str(tmp_path_factory.mktemp("corpus"))
    words = ["".join(picked.choices("abcdefghij", k=picked.randint(2, 7))) for _ in range(500)]
    texts = {i: " ".join(picked.choices(words, k=picked.randint(30, 90))) for i in range(60)}
    items = {i: " ".join(picked.choices(words, k=25)) for i in range(5)}
    texts[60], texts[61] = texts[3], texts[4] + " extra"  # copies
    texts[62] = texts[5] + " " + items[2]  # contaminated
    texts[63] = texts[7] + f' token = "{hashlib.sha1(b"k").hexdigest()}" ' + texts[8]
    texts[64], texts[65], texts[66] = None, "", "12 34 !!"
    rows = [(i, t, "en" if i % 2 else "de", "src1", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts


def test_stages_take_effect(spark, folder):
    path, texts = folder
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(got) == set(range(60)) | {63}
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, row in got.items():
        text = texts[i].replace(hashlib.sha1(b"k").hexdigest(), "[SECRET]")
        assert row.ids == encoding.encode_ordinary(text) and row.n_tokens == len(row.ids)
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_keep_columns_and_extra_ones(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").selectExpr("*", "1 as score", "'m' as mark", "2 as key")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).columns == docs.columns
        assert stage(spark, docs.limit(0), folder[0]).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder[0]).collect() == []


def test_documents_without_labels_stay(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 34 !!", None), (3, None, None), (4, "\u6f22\u5b57", None)], "doc_id long, text string, lang string")
    got = corpus_pipeline.identify_language(spark, docs, "").collect()
    assert sorted((r.doc_id, r.lang) for r in got) == [(1, "und"), (4, "und")]


def test_each_of_many_labels_is_learned(spark):
    docs = spark.range(40).selectExpr("id as doc_id", "concat('text of ', id, ' some words') as text", "concat('l', id % 20) as lang")
    assert len(language.fit(docs, rows=10, landmarks=4).languages) == 20


def test_one_row_of_each_group_stays(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    own = "quite another text with words that no other row of this small table has"
    rows = [(1, text), (2, text), (2, own), (3, "a text of its own"), (3, "a text of its own"), (None, text), (None, "a null id with its own text"), (None, "a null id with its own text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, text), (2, own), (3, "a text of its own"), (None, "a null id with its own text")], key=str)


def test_stages_with_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    own = ["_key", "_copy", "_n", "_p", "_before", "row_key", "copy", "found", "before", "number", "first", "rows", "lang_pred", "score", "component_id", "key", "hash"]
    odd = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in own])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, folder[0])
        assert got.columns == odd.columns, name
        rows = got.where("doc_id < 60").collect()
        assert len(rows) == 60
        for r in rows:
            assert [r[c] for c in own] == [f"{c}{r.doc_id}" for c in own], name


def test_each_row_is_decontaminated_by_its_own_text(spark, folder):
    path, texts = folder
    item = spark.read.parquet(f"{path}/benchmark.parquet").where("item_id = 2").first().text
    docs = spark.createDataFrame([(1, texts[1]), (1, f"{texts[2]} {item}"), (None, item), (None, texts[3]), (4, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_contaminated(spark, docs, path).collect()), key=str)
    assert got == sorted([(1, texts[1]), (None, texts[3]), (4, None)], key=str)


def test_tables_of_numbers_stay(spark, tmp_path):
    """Documents and items of little but different numbers or names share templates, not content."""
    picked = random.Random(8)
    numbers = lambda n: " ".join(f"{picked.randrange(10**6)}.{picked.randrange(100):02d}" for _ in range(n))
    prices = lambda n: "; ".join(f"{picked.choice(['Tea', 'Salt', 'Rice', 'Oil', 'Milk'])} {picked.randrange(900)} usd" for _ in range(n))
    question = "A train leaves at {} km per hour and meets another train that left {} hours before; how far did {} walk to reach it"
    items = [numbers(60) for _ in range(12)] + [prices(30) for _ in range(12)] + [question.format(80, 3, "Maria")]
    docs = [numbers(200) for _ in range(20)] + [prices(90) for _ in range(20)] + ["x y z " + question.format(95, 7, "Otto") + " end"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == list(range(40))


def test_the_bound_of_the_language_sample_holds(spark):
    one = spark.range(6000).selectExpr("1L as doc_id", "'the same words again' as text", "'en' as lang")
    assert len(language.sample(one, "doc_id", "text", "lang", 100, 256)) == 1
    ids = spark.range(6000).selectExpr("1L as doc_id", "concat('words of text ', id) as text", "'en' as lang")
    assert 60 < len(language.sample(ids, "doc_id", "text", "lang", 100, 256)) <= 100
    many = spark.range(3000).selectExpr("id as doc_id", "concat('words of text ', id) as text", "concat('l', id) as lang")
    assert len(language.sample(many, "doc_id", "text", "lang", 100, 256)) == 256
