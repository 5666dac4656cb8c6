"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.llm import bpe, decontaminate, jaccard, language, mtree, pages, periodic, pii, prefix_trie, quality, ring, secrets, warc
from shirabe.llm.registry import QUERIES, SQL, query, table
from shirabe.session import scratch_path

__all__ = ["QUERIES", "SQL"]


@query("op1_url_differencing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return pages.extract(table(spark, folder, "pages"))


@query("op2_string_kernel_language")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = table(spark, folder, "documents")
    kept = docs.where(~language.held_out() & F.col("doc_id").isNotNull())
    return language.identify(docs, language.fit(kept)).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def vocabulary() -> dict[bytes, int]:
    """Ranks of the public byte-level vocabulary."""
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op3_bpe_round_trip")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document and the bytes they decode to, as digests."""
    return bpe.encode(table(spark, folder, "documents"), vocabulary(), spelled=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op8_ring_shards")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in shards 0 to 15; counts differ by one at most (law ``rows``)."""
    docs = table(spark, folder, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    return ring.shard(docs, ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home"
    )


JACCARD_SQL = r"""WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
       s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM t),
       n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
       x AS (SELECT doc_id, unnest(g) AS g FROM s),
       p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
       l AS (SELECT a, b FROM p JOIN n i ON i.doc_id = a JOIN n j ON j.doc_id = b WHERE 100 * c >= 80 * (i.n + j.n - c)),
       e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
       r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a)
       SELECT n.doc_id, n.n AS n_shingles, min(root) AS component_id FROM n JOIN r USING (doc_id) GROUP BY 1, 2"""


@query("op10_jaccard_components", JACCARD_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents linked by 5-word shingles with Jaccard similarity 0.8 or more."""
    return jaccard.classes(table(spark, folder, "documents"))


@query("op4_contextual_pii")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document: base spans and those found by context."""
    found = pii.find(table(spark, folder, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"),
        pii.written(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_context"),
    )


@query("op5_warc_round_trip")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written as a WARC record and read back from the archive."""
    path = scratch_path(spark, "warc")
    warc.write(table(spark, folder, "pages"), path, "page_id", "url", "html")
    return warc.read(spark, path).select(
        F.col("key").cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


@query("op9_template_decontamination")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a document and a benchmark item it holds, also with other numbers, names or units."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op6_forest_secrets")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of secrets in every document, scored by the forest; ``kept`` ones are findings."""
    docs = table(spark, folder, "documents")
    found = secrets.scan(docs, secrets.train(secrets.labelled_findings(docs)))
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "score", "kept")


TOP_K_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
         WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
       s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
         FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
       r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
       SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@query("op7_mtree_top_k", TOP_K_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """The five largest inner products of every fiftieth vector, on integer components."""
    found = mtree.top_k(table(spark, folder, "embeddings"), "vec_id", "embedding", every=50, k=5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


# CRC-32 of a decimal number, bit by bit: -1 stands for one shift of the register.
CRC_SQL = """xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(CAST({} AS VARCHAR), ''),
         lambda d: [CAST(ascii(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
         lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END))"""

TRIE_SQL = f"""WITH RECURSIVE o AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
       c AS (SELECT c, c - c % 100 AS b, {CRC_SQL.format('c')} % 6 AS h FROM (SELECT DISTINCT c FROM o)),
       u AS (SELECT c.c, o.n, 0 AS own, o.r, o.t FROM c JOIN o ON o.c = c.b AND o.n <= c.h
         UNION ALL SELECT c.c, o.n, 1, o.r, o.t FROM c JOIN o ON o.c = c.c AND o.n > c.h),
       a AS (SELECT c.c, coalesce(list(sha256(length(u.r) || ':' || u.r || u.t) ORDER BY own, n) FILTER (WHERE u.c IS NOT NULL), []) AS k,
         coalesce(list(length(u.t) ORDER BY own, n) FILTER (WHERE u.c IS NOT NULL), []) AS s FROM c LEFT JOIN u ON u.c = c.c GROUP BY 1),
       m AS (SELECT c, d, array_to_string(k[1:d], ',') AS p, CASE WHEN d > 0 THEN array_to_string(k[1:d - 1], ',') END AS pp,
           CASE WHEN d > 0 THEN s[d] ELSE 0 END AS w, d = len(k) AS ends FROM a, LATERAL (SELECT unnest(range(0, len(k) + 1)) AS d)),
       v AS (SELECT p, d, any_value(pp) AS pp, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
           sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
       k AS (SELECT v.p, v.d, count(x.p) AS n_children FROM v LEFT JOIN v x ON x.pp = v.p AND x.d = v.d + 1 GROUP BY 1, 2),
       g AS (SELECT p AS top, d AS td, p, d, pp, w, n_convs FROM v
         UNION ALL SELECT g.top, g.td, x.p, x.d, x.pp, x.w, x.n_convs FROM g JOIN v x ON x.pp = g.p AND x.d = g.d + 1),
       z AS (SELECT top AS p, td AS d, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves, CAST(sum((g.n_convs - 1) * g.w) AS BIGINT) AS saved_tokens
         FROM g JOIN k ON k.p = g.p AND k.d = g.d GROUP BY 1, 2)
       SELECT v.conv_id, v.d AS depth, q.conv_id AS parent_conv_id, v.n_convs, k.n_children, z.n_leaves, z.saved_tokens, v.ends_sha256
       FROM v JOIN k USING (p, d) JOIN z USING (p, d) LEFT JOIN v q ON q.p = v.pp AND q.d = v.d - 1"""


@query("op11_prefix_trie", TRIE_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the trie of conversations, each begun with up to five turns of the first of its hundred."""
    conv = F.col("conv_id")
    turns = prefix_trie.numbered(table(spark, folder, "conversations"))
    steps = prefix_trie.rebuilt(turns, F.crc32(conv.cast("string")) % 6, conv - conv % 100, longest=5)
    return prefix_trie.trie(steps).drop("entered", "left")


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where the words of some documents, by the checksum of their id, go round from a place on."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    drawn = F.crc32(F.col("doc_id").cast("string"))
    parts = docs.select("doc_id", "text", F.when((drawn % 10 == 0) & F.col("text").isNotNull(), words).alias("w"), F.floor(drawn / 10).alias("g"))
    n = F.size("w")
    begun = parts.withColumn("a", F.when(n > 0, F.col("g") % n))
    turned = begun.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])), ' ')")
    return turned.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


RUNS_SQL = rf"""WITH t AS (SELECT doc_id, row_number() OVER () AS id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         {CRC_SQL.format('doc_id')} AS h FROM documents),
       y AS (SELECT doc_id, id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN h // 10 % len(w) END AS a, h // 10 AS g FROM t),
       x AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM y),
       z AS (SELECT id, n, unnest(list_transform(range(0, n), lambda i: struct_pack(i := i, v := w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END])), recursive := true) FROM x),
       e AS (SELECT l.id, l.i, r.i - l.i AS q FROM z l JOIN z r ON l.id = r.id AND l.v = r.v AND r.i > l.i AND 4 * (r.i - l.i) <= l.n),
       k AS (SELECT id, q, i, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS b FROM e),
       s AS (SELECT id, q, min(i) AS s, count(*) + q AS len FROM k GROUP BY id, q, b HAVING count(*) + q >= greatest(6, 4 * q)),
       r AS (SELECT id, s, len, min(q) AS q FROM s GROUP BY 1, 2, 3),
       m AS (SELECT id, count(*) AS n_runs, arg_min({{'s': s, 'l': len, 'q': q}}, {{'l': -len, 's': s, 'q': q}}) AS best,
         string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM r GROUP BY 1),
       c AS (SELECT id, string_agg(v, ' ' ORDER BY i) AS kept FROM z WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.id = z.id AND z.i >= r.s + r.q AND z.i < r.s + r.len) GROUP BY 1)
       SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli,
         sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM t LEFT JOIN m USING (id) LEFT JOIN c USING (id)"""


@query("op12_periodic_runs", RUNS_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of periodic words of every document, its longest one and digests of all runs and of the text without repetitions."""
    found = periodic.find(looped(table(spark, folder, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    spelled = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("m"), F.array_join(spelled, "").alias("r"), "collapsed").select(
        "doc_id",
        "n_runs",
        (-F.col("m.s")).alias("start"),
        F.col("m.l").alias("length"),
        (-F.col("m.p")).alias("period"),
        F.expr("1000 * m.l div -m.p").alias("exponent_milli"),
        F.sha2("r", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op13_risk_controlled_rules")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every document and whether it passes the base and the cutoffs certified for its language."""
    return quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("stratum").alias("lang"), "rule", "cutoff"
    )
