"""Secret scans with a random forest against false positives; DataFrame and SQL functions only.

Candidates are long tokens with a digit, values of any length after a credential word, and
blocks of private keys from BEGIN to END. The forest looks at their length,
characters and transitions, at how much of them is dictionary words, at the path and at
the neighbouring words. It is trained by Spark ML on labelled findings and then written as
a column expression, so scanning and redacting a document takes one pass and no shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shirabe.llm.common import materialise
from shirabe.llm.pii import located

SIGN = "[A-Za-z0-9+/_-]"
PADDED = "(?![A-Za-z0-9+/_=-])"  # '=' inside a run parts a name and its value, at the end it is padding
TOKEN = rf"(?<!{SIGN})(?={SIGN}{{16}}|{SIGN}{{15}}={PADDED}|{SIGN}{{14}}=={PADDED})(?={SIGN}*[0-9]){SIGN}++(?:={{1,2}}{PADDED})?"
KEY_NAME = "PRIVATE KEY(?: BLOCK)?-----"
# A key that has no END is the lines of base64 after its header.
KEY_BLOCK = (
    rf"-----BEGIN [A-Z0-9 ]{{0,40}}{KEY_NAME}(?:\s*+[A-Za-z-]{{1,40}}: [^\n]{{0,200}}\n){{0,8}}(?:[^-]*+-----END [A-Z0-9 ]{{0,40}}{KEY_NAME}"
    r"|(?:(?:\s|\\[rn]){0,8}[A-Za-z0-9+/=]{40,}+){0,400}(?:\s++[A-Za-z0-9+/=]++\s*+$)?)"
)
ASSIGNED = (
    r"(?<=[=:]\s{0,3}[\"'`]?)(?<=(?i:pass(?:word|wd|phrase)|(?<![a-z])pwd|secret|token|api[_-]?key|[_-]key|credentials?|(?<![a-z])auth(?:orization)?)"
    r"[\"'`]?\s{0,3}[=:]\s{0,3}[\"'`]?)(?!(?i:bearer|basic|token)\s)"
)
BEARER = r"(?<=(?i:bearer|basic)\s)(?=\S{0,200}[0-9])"
VALUE = r"[^\s\"'`<>,;&)\]}]++"
CANDIDATE = f"{KEY_BLOCK}|(?:{ASSIGNED}|{BEARER}){VALUE}|{TOKEN}"
BEFORE, AFTER = 48, 24  # characters of context
MARK = "[SECRET]"

# Word lists of the features.
DICTIONARY = (
    "example sample dummy fake test demo placeholder change changeme password passwd secret token user admin default "
    "your insert here todo none null true false value string name key api file path class version release build "
    "data time date page image index main home content"
).split()
CREDENTIAL = "token secret password passwd pwd key apikey auth authorization bearer credential credentials login private access".split()
DIGEST = "commit sha sha1 sha256 sha512 md5 hash checksum digest revision rev etag uuid guid id version fingerprint integrity".split()
TEST_PATH = "test tests example examples sample samples mock mocks fixture fixtures doc docs demo".split()

FEATURES = (
    "length digits upper lower signs distinct entropy changes vowels repeats hexadecimal dictionary header "
    "credential_before digest_before assigned quoted word_after test_path"
).split()


def words_in(text: Column, words: list[str]) -> Column:
    """Whether one of the words stands in a text, between non-letters."""
    return text.rlike(rf"(?<![a-z])(?:{'|'.join(words)})(?![a-z])").cast("double")


def features(value: Column, before: Column, after: Column, path: Column) -> Column:
    """Features of a candidate as an array, in the order of ``FEATURES``."""
    size = F.greatest(F.length(value), F.lit(1)).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(value, pattern, "")) / size
    low, signs = F.lower(value), F.split(value, "")
    # A letter per class of character; its changes are the transitions.
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "#"), "[a-z]", "a"), "[A-Z]", "A"), "[^#aA]", "-")
    runs = F.regexp_replace(kinds, r"(.)\1+", "$1")
    counts = F.transform(F.array_distinct(signs), lambda s: F.size(F.filter(signs, lambda t: t == s)) / size)
    entropy = F.aggregate(counts, F.lit(0.0), lambda total, p: total - p * F.log2(p))
    uncovered = F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")
    near = F.lower(F.regexp_replace(before, "([a-z])([A-Z])", "$1_$2"))
    return F.array(
        F.least(size, F.lit(200.0)),
        share("[^0-9]"),
        share("[^A-Z]"),
        share("[^a-z]"),
        share("[A-Za-z0-9]"),
        F.size(F.array_distinct(signs)) / size,
        entropy,
        F.length(runs) / size,
        F.length(F.regexp_replace(low, "[^aeiou]", "")) / size,
        1 - F.length(F.regexp_replace(value, r"(.)\1+", "$1")) / size,
        value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        1 - F.length(uncovered) / size,
        value.startswith("-----BEGIN").cast("double"),
        words_in(F.regexp_replace(near, "_", " "), CREDENTIAL),
        words_in(F.regexp_replace(near, "_", " "), DIGEST),
        near.rlike(r"[=:]\s*[\"'`]?$").cast("double"),
        near.rlike(r"[\"'`]$").cast("double"),
        F.lower(after).rlike(r"^[\"'`]?\s+[^\W\d_]").cast("double"),
        words_in(F.lower(F.coalesce(path, F.lit(""))), TEST_PATH),
    )


def context(text: Column, c: Column) -> tuple[Column, Column]:
    """Characters before and after a candidate."""
    before = F.substring(text, F.greatest(c["start"] - BEFORE, F.lit(0)) + 1, F.least(c["start"], F.lit(BEFORE)))
    return before, F.substring(text, c["end"] + 1, F.lit(AFTER))


def labelled_findings(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = 400) -> DataFrame:
    """(value, before, after, path, label): findings with known labels, made from ``rows`` documents at most.

    The tables have no labelled findings, so they are written here as they occur: keys made of
    a document's digest in credential contexts, and digests, identifiers, numbers and
    placeholders where those stand. The scanner's own candidates in them are the rows. Any table of these columns can be given to ``train``.
    """
    drawn = docs.where(F.col(text).isNotNull()).select(
        F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.xxhash64(text).cast("string")), 512).alias("h"),
        F.slice(F.regexp_extract_all(F.substring(text, 1, 400), F.lit(r"\p{L}{2,}"), F.lit(0)), 1, 8).alias("w"),
    )
    drawn = drawn.orderBy("h").limit(rows)
    word = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit("word"))
    cut = lambda at, n: F.substring("h", at, n)
    packed = F.regexp_replace(F.base64(F.unhex(cut(1, 96))), "=", "")
    capital = F.upper(F.translate(cut(30, 32), "01abcdef89", "QRSTUVWXYZ"))
    number = F.translate(cut(5, 16), "abcdef", "123456")
    dashed = F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))
    plain = F.concat(word(0), F.lit(" "), word(1), F.lit(" "))
    quoted, ends, ended = F.lit('" '), F.concat(F.lit(" "), word(2)), F.lit("\n")
    true, false = 1.0, 0.0
    made = [
        (cut(1, 40), F.concat(plain, F.lit('token = "')), F.concat(quoted, word(2)), true),
        (cut(50, 32), F.concat(plain, F.lit("secret: ")), ends, true),
        (F.substring(packed, 1, 32), F.concat(word(3), F.lit(" api_key = '")), F.lit("' "), true),
        (F.concat(F.lit("AKIA"), F.substring(capital, 1, 16)), F.lit("access_key="), ended, true),
        (F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(packed, "[+/]", "x"), 1, 36)), F.lit("Authorization: Bearer "), ended, true),
        (F.concat(F.lit("sk-"), F.substring(packed, 5, 44)), F.concat(plain, F.lit("password: ")), ends, true),
        (F.lit("-----BEGIN RSA PRIVATE KEY-----"), ended, ended, true),
        (F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), packed, F.lit("\n-----END RSA PRIVATE KEY-----")), ended, ended, true),
        (F.concat(F.lit("-----BEGIN PRIVATE KEY-----\n"), F.repeat(F.concat(packed, F.lit("\n")), 12), packed), plain, ended, true),
        (F.concat(F.lit("-----BEGIN EC PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n"), F.repeat(F.concat(cut(1, 64), F.lit("\n")), 12), cut(65, 64)), plain, ended, true),
        (cut(50, 32), F.concat(plain, F.lit("api_key=")), ends, true),
        (F.concat(F.initcap(word(1)), cut(3, 3), F.lit("!"), F.substring(number, 1, 2)), F.concat(plain, F.lit('password = "')), quoted, true),
        (cut(9, 10), F.concat(plain, F.lit("passwd=")), ended, true),
        (F.concat(F.lower(word(0)), F.lit("-"), cut(7, 4), F.substring(number, 1, 2)), F.concat(plain, F.lit("pwd: ")), ends, true),
        (F.lower(word(0)), F.concat(plain, F.lit("password: ")), ends, false),
        (word(2), F.lit("token = "), ended, false),
        (F.lower(word(1)), F.lit('secret: "'), quoted, false),
        (F.lit("getpass.getpass("), F.lit("password = "), F.lit(")\n"), false),
        (F.lit("${API_TOKEN}"), F.lit("token="), ended, false),
        (F.lit("changeme"), F.lit("password="), ended, false),
        (F.lit("********"), F.lit("password: "), ended, false),
        (cut(60, 40), F.concat(plain, F.lit("commit ")), ends, false),
        (cut(1, 64), F.concat(word(4), F.lit(" sha256: ")), ended, false),
        (dashed, F.concat(plain, F.lit("id = ")), ends, false),
        (number, plain, ends, false),
        (number, F.concat(plain, F.lit("number ")), ends, false),
        (F.concat_ws("-", F.lower(word(0)), F.lower(word(1)), F.lower(word(2)), F.lower(word(3)), F.lit("2024")), plain, ends, false),
        (F.concat_ws("_", word(3), word(4), word(5), F.substring(number, 1, 3)), F.concat(plain, F.lit("file = ")), ends, false),
        (F.concat(word(0), word(1), word(2), word(3), F.substring(number, 1, 2)), plain, ends, false),
        (F.lit("your-api-key-here-12345"), F.lit('api_key = "'), quoted, false),
        (F.concat(F.lit("xxxxxxxxxxxxxxxxxxxx"), F.substring(number, 1, 4)), F.lit('token = "'), quoted, false),
        (F.concat(F.lit("example_token_value_"), F.substring(number, 1, 3)), F.lit("token: "), ended, false),
        (F.concat_ws("/", F.lit("path"), word(1), word(2), F.lit("release2"), word(3)), plain, ends, false),
        (F.lit("000000000000000000000000"), F.lit('secret = "'), quoted, false),
    ]
    paths = F.array(F.lit("src/main.py"), F.lit("tests/test_main.py"), F.lit(""), F.lit("src7"), F.lit("docs/readme.md"))
    written = F.array(
        *(F.struct(F.concat(b, v, a).alias("text"), F.length(b).alias("at"), F.length(F.concat(b, v)).alias("upto"), F.lit(y).alias("label")) for v, b, a, y in made)
    )
    each = drawn.select(F.explode(written).alias("f"), F.get(paths, (F.pmod(F.xxhash64("h"), F.lit(5))).cast("int")).alias("path")).select("f.*", "path")
    found = each.withColumn("c", F.explode(located(F.col("text"), CANDIDATE))).where("c.start < upto and c.end > at")
    return found.select("c.value", *(x.alias(n) for x, n in zip(context(F.col("text"), F.col("c")), ("before", "after"), strict=True)), "path", "label")


@dataclass
class Forest:
    """Trees as nested tuples (feature, threshold, left, right), or 0.0 or 1.0 for a leaf."""

    trees: list

    def score(self, row: Column) -> Column:
        """Share of the trees that vote for a secret."""

        def tree(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, threshold, left, right = node
            return F.when(F.get(row, F.lit(feature)) <= threshold, tree(left)).otherwise(tree(right))

        total = tree(self.trees[0])
        for node in self.trees[1:]:
            total = total + tree(node)
        return total / float(len(self.trees))


def parsed(text: str) -> list:
    """Trees of a forest from Spark's description of the model."""
    trees, lines = [], iter(text.splitlines()[1:])

    def node():
        line = next(lines).strip()
        if line.startswith("Predict:"):
            return float(line.split(":")[1])
        feature, threshold = re.match(r"If \(feature (\d+) <= ([-0-9.Ee]+)\)", line).groups()
        left = node()
        next(lines)  # the matching "Else"
        return (int(feature), float(threshold), left, node())

    for line in lines:
        if line.strip().startswith("Tree "):
            trees.append(node())
    return trees


def train(labelled: DataFrame, trees: int = 25, depth: int = 6, seed: int = 7) -> Forest:
    """A forest from labelled findings (value, before, after, path, label); their number is the caller's bound. Without any it keeps nothing."""
    row = features(*(F.col(c) for c in ("value", "before", "after", "path")))
    # Spark ML reads its rows several times: findings and features are made once, and its plans are short.
    made = materialise(labelled.select("label", row.alias("f")), "features")
    if made.isEmpty():
        return Forest([0.0])
    wide = made.select("label", *(F.get("f", F.lit(i)).alias(n) for i, n in enumerate(FEATURES)))
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(wide).select("label", "features")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(ready)
    return Forest(parsed(model.toDebugString))


def findings(text: Column, path: Column, forest: Forest) -> Column:
    """Candidates of a text as structs of start, end (code points), value, and the forest's score."""

    def scored(c: Column) -> Column:
        row = F.array(features(c["value"], *context(text, c), path))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"), F.get(F.transform(row, forest.score), F.lit(0)).alias("score"))

    return F.transform(located(text, CANDIDATE), scored)


def scan(df: DataFrame, forest: Forest, key: str = "doc_id", text: str = "text", path: str = "source", least: float = 0.5) -> DataFrame:
    """(key, start, end, value, score, kept): every candidate of every text, and whether the forest keeps it.

    Null and empty texts have none.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = df.select(F.col(key).alias("_key"), F.col(path).cast("string").alias("_path"), whole.alias("_text"))
    exploded = found.select(F.col("_key").alias(key), F.explode(findings(F.col("_text"), F.col("_path"), forest)).alias("_f"))
    return exploded.select(key, "_f.start", "_f.end", "_f.value", "_f.score").withColumn("kept", F.col("score") >= least)


def redact(df: DataFrame, forest: Forest, text: str = "text", path: str = "source", least: float = 0.5) -> DataFrame:
    """``df`` with the kept findings of ``text`` replaced by ``[SECRET]``; other texts stay as they are, null ones null."""
    kept = F.filter(findings(F.col(text), F.col(path).cast("string"), forest), lambda f: f["score"] >= least)

    def step(state: Column, f: Column) -> Column:
        piece = F.substring(F.col(text), state["at"] + 1, f["start"] - state["at"])
        return F.struct(f["end"].alias("at"), F.concat(state["out"], piece, F.lit(MARK)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.length(text) - s["at"]))
    bound = F.transform(F.array(kept), lambda k: F.when(F.size(k) > 0, F.aggregate(k, start, step, rest)).otherwise(F.col(text)))
    return df.withColumn(text, F.get(bound, F.lit(0)))
