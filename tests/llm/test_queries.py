"""Every registered query of the subpackage on the smallest test tables: columns, types, keys, and SQL or a direct computation."""

from __future__ import annotations

import base64
import hashlib
import os
import zlib

import public_tokenizers
import pytest
import regex
import tiktoken
from check_oracle import compare, connect
from pyspark.sql import functions as F

from shirabe.llm import bpe
from shirabe.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

# The columns the queries promise, by number; the first one or two name a row.
COLUMNS = {
    1: "page_id bigint, url string, text string, n_chars bigint",
    2: "doc_id bigint, held_out boolean, lang_pred string, score double",
    3: "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    4: "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    5: "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    7: "query_id bigint, rank int, vec_id bigint, score bigint",
    8: "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    10: "doc_id bigint, n_shingles bigint, component_id bigint",
    11: "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    12: "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    13: "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
}
NUMBERS = {int(name[2:].split("_")[0]): name for name in QUERIES if name.startswith("op")}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def result(spark):
    """Rows of a query as dictionaries, computed once."""
    known = {}

    def run(number: int):
        if number not in known:
            known[number] = QUERIES[NUMBERS[number]](spark, FOLDER).toPandas()
        return known[number]

    return run


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("select doc_id, text from documents").fetchall())


def test_all_thirteen_are_registered():
    assert sorted(NUMBERS) == list(range(1, 14))


@pytest.mark.parametrize("number", sorted(COLUMNS))
def test_columns(spark, number):
    types = dict(QUERIES[NUMBERS[number]](spark, FOLDER).dtypes)
    wanted = dict(c.split() for c in COLUMNS[number].split(", "))
    assert {c: types.get(c) for c in wanted} == wanted


@pytest.mark.parametrize("number", [7, 10, 11, 12])
def test_sql(result, duck, number):
    assert compare(NUMBERS[number], result(number), duck.execute(SQL[NUMBERS[number]]).df()) is None


@pytest.mark.parametrize("number", [2, 3, 4, 8, 13])
def test_one_row_per_document(result, texts, number):
    assert sorted(result(number)["doc_id"]) == sorted(texts)


def test_tokens_are_those_of_the_library(result, texts):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in result(3).itertuples():
        ids = encoding.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_emails_of_whole_texts(result, texts):
    email = regex.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for r in result(4).itertuples():
        assert r.n_email == sum(1 for _ in email.finditer(texts[r.doc_id] or ""))
        kinds = [s.split(":")[0] for s in r.spans.split(",") if s]
        assert [kinds.count(k) for k in ("email", "ip", "card", "phone")] == [r.n_email, r.n_ip, r.n_card, r.n_phone]


def test_records_of_pages(result, duck):
    pages = {k: (html or "").encode() for k, html in duck.execute("select page_id, html from pages").fetchall()}
    last = {}
    for k in sorted(pages):
        last[pages[k]] = k
    found = result(5)
    assert sorted(found["page_id"]) == sorted(pages)
    for r in found.itertuples():
        body = pages[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        if last[body] == r.page_id:
            assert r.record_type == "response" and r.refers_to != r.refers_to
        else:
            assert (r.record_type, r.refers_to) == ("revisit", last[body])


def test_shards_of_documents(result, texts):
    found = result(8)
    assert set(found["law"]) == {"rows"}
    sizes = found.groupby("shard").size()
    assert sorted(sizes.index) == list(range(16)) and sizes.max() - sizes.min() <= 1
    for _, part in found.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    for r in found.itertuples():
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 1, zlib.crc32(body))


def test_held_out_texts_are_not_learned(result):
    for r in result(2).itertuples():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1


def test_main_texts_of_pages(result, duck):
    found = result(1)
    assert sorted(found["page_id"]) == sorted(k for (k,) in duck.execute("select page_id from pages").fetchall())
    assert (found["text"].str.len() == found["n_chars"]).all() and not found["text"].str.contains(r"^\s|\s$|\n\n|  ").any()


def test_secrets_and_benchmark_items_are_of_known_rows(spark, texts):
    for number in (6, 9):
        rows = QUERIES[NUMBERS[number]](spark, FOLDER)
        assert rows.where(F.col("doc_id").isNull()).count() == 0
        assert {r.doc_id for r in rows.select("doc_id").distinct().collect()} <= set(texts)
