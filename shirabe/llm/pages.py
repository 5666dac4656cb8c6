"""Main text of web pages by differencing against the page with the nearest URL.

Pages of a host are sorted by path; each is paired with the neighbour that shares
the longest start of the path. Text lines of a pair are aligned by their longest common
subsequence, and shared lines are deleted as the site's template. Markup that says what
it is comes first: lines of an article stay, also if two pages share them (copies, quoted
lines), and menus, footers, adverts and the like go, also if no neighbour has them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shirabe.llm.common import materialise

# Elements and names of HTML.
SKIPPED = frozenset(
    "head title script style noscript template nav header footer aside form button select textarea iframe object svg canvas dialog menu".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMES = frozenset(
    "ad ads adv adbox adslot adsense alert banner banners breadcrumb breadcrumbs consent discussion disqus feedback footer gdpr header "
    "login masthead menu menus modal nav navbar navigation notice notices overlay pagination popup popover promo promotion rail "
    "recommendations recommended related replies responses search share sharing sidebar signup social toast toolbar topbar widget widgets".split()
)
LAYOUT = frozenset(
    "area article articles aside bar block bottom box btn button buttons col column container content count entries form group head icon icons inline inner "
    "item items label left link links list main outer panel post posts right row section site slot stories story text title top unit wrap wrapper".split()
)
STEMS = ("advert", "comment", "cookie", "newsletter", "sidebar", "sponsor", "subscri")
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form navigation search".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
INSIDE, OUTSIDE, DROPPED, NESTED = 0, 1, 2, 3  # in an article; in none; in markup that is no text; in an article in such markup
SKIP, CARD, HOLDER = 1, 2, 3  # skipped; an article in a skipped element; one that may hold articles: an aside, comments and the like


class Lines(HTMLParser):
    """Text lines of a page and where each stands."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []  # element, whether and how it is skipped, whether it is an article
        self.holder: int | None = None  # depth of the outermost holder
        self.since = 0  # lines before it
        self.open: Counter[str] = Counter()  # open elements of each name
        self.parts: list[str] = []
        self.lines: list[tuple[str, int]] = []

    def place(self) -> int:
        if self.stack and self.stack[-1][1]:
            return NESTED if self.stack[-1][1] == CARD else DROPPED
        return INSIDE if self.stack and self.stack[-1][2] else OUTSIDE

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.place()))
        self.parts = []

    def pop_to(self, depth: int, closed: bool = False) -> None:
        if len(self.stack) > depth:
            if any(tag in BLOCKS or skipped for tag, skipped, _ in self.stack[depth:]):
                self.cut()
            if self.holder is not None and self.holder >= depth:
                tag = self.stack[self.holder][0]
                if not (closed and self.holder == depth) and tag != "p" and tag not in CLOSES:
                    # It was not closed, so the articles after it are the page's own.
                    self.lines[self.since :] = [(t, INSIDE if p == NESTED else p) for t, p in self.lines[self.since :]]
                self.holder = None
            self.open.subtract(tag for tag, _, _ in self.stack[depth:])
            del self.stack[depth:]

    def push(self, tag: str, skipped: int, article: bool) -> None:
        self.stack.append((tag, skipped, article))
        self.open[tag] += 1

    def handle_starttag(self, tag: str, attrs) -> None:
        skipped = self.stack[-1][1] if self.stack else 0
        article = bool(self.stack) and self.stack[-1][2]
        if tag in BLOCKS:
            self.cut()
            # Blocks end an open paragraph; list items, cells and the like end their predecessor.
            ended = CLOSES.get(tag, set()) | {"p"}
            for depth in range(len(self.stack) - 1, max(-1, len(self.stack) - 6), -1):
                name = self.stack[depth][0]
                if name in ended:
                    self.pop_to(depth)
                    break
                if name in BLOCKS and name != "p":
                    break
            skipped = self.stack[-1][1] if self.stack else 0
            article = bool(self.stack) and self.stack[-1][2]
        if tag in VOID:
            return
        given = dict(attrs)
        role = (given.get("role") or "").lower()
        begins = tag in ("article", "main") or role == "main"
        if begins and skipped and not article:
            root = next(d for d, (_, how, _) in enumerate(self.stack) if how)
            if tag == "article" and self.stack[root][1] != SKIP:
                # A comment or a card, unless what holds it turns out not to be closed.
                self.push(tag, CARD, False)
                return
            # An article inside a menu: that one was not closed.
            self.pop_to(root)
            skipped = 0
        own = self.marked(tag, given, role, article or skipped == CARD)
        if begins:
            own = CARD if tag == "article" and own == HOLDER else 0
        if own and skipped in (0, CARD):
            self.cut()
            if own == HOLDER and not skipped:
                self.holder, self.since = len(self.stack), len(self.lines)
            skipped = own
        self.push(tag, skipped, article or (begins and not skipped))

    @staticmethod
    def marked(tag: str, given: dict, role: str, article: bool) -> int:
        """Whether an element is no part of the text, and how; an article's own header is part of it."""
        if tag in SKIPPED and not (article and tag == "header") or role in ROLES or "hidden" in given:
            return HOLDER if tag == "aside" else SKIP
        if "display:none" in (given.get("style") or "").replace(" ", "").lower():
            return SKIP
        if tag in ("html", "body", "p", "h1", "h2", "h3", "h4", "h5", "h6") and not given.get("class"):
            return 0
        if tag in ("html", "body"):
            return 0
        names = f"{given.get('class') or ''} {given.get('id') or ''}".lower().replace("-", " ").replace("_", " ").split()
        named = [n in NAMES and not (article and n == "header") for n in names]
        # In an article a name among other words may be about its topic (share-price, search results): all must be words of layout.
        found = any(named) and (not article or all(known or n in LAYOUT or n.isdigit() for n, known in zip(names, named, strict=True)))
        return HOLDER if found or any(n.startswith(STEMS) for n in names) else 0

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:  # nothing to close: the stack need not be searched
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                self.pop_to(depth, closed=True)
                return

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def lines_of(html: str | None) -> list[tuple[str, int]]:
    """(text, place) of every line of a page."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.cut()
    parser.pop_to(0)
    return parser.lines


def main_text(lines: list[str], places: bytes, shared: set[int]) -> list[str]:
    """The lines of a page's text: those of its article if that is the main part of the page.

    Otherwise lines outside count too, without the shared ones, or articles in skipped markup if there is more in them.
    """
    sizes = [0] * 4
    for i, (line, place) in enumerate(zip(lines, places, strict=True)):
        sizes[place] += 0 if place == OUTSIDE and i in shared else len(line)
    if sizes[INSIDE] and sizes[INSIDE] >= sizes[OUTSIDE]:
        kept = (INSIDE,)
    else:
        kept = (INSIDE, OUTSIDE if sizes[OUTSIDE] >= sizes[NESTED] else NESTED)
    return [t for i, (t, p) in enumerate(zip(lines, places, strict=True)) if p in kept and not (p == OUTSIDE and i in shared)]


# Pairs of equal lines up to which a chain of matches is kept in memory.
MATCHES = 1 << 17


def common(a: list[int], b: list[int]) -> list[int]:
    """Indices of the lines of ``a`` in a longest common subsequence with ``b``.

    Equal starts and ends are taken off. What is left goes to a chain of matches if few lines are equal; otherwise ``a`` is
    halved where the longest subsequence passes, found with a bit per line of ``b``, so many equal lines take neither time nor memory
    by the product of their numbers. Both ways give a longest one.
    """
    out: list[int] = []
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        lo, hi, start, end = open_.pop()
        while lo < hi and start < end and a[lo] == b[start]:
            out.append(lo)
            lo, start = lo + 1, start + 1
        while lo < hi and start < end and a[hi - 1] == b[end - 1]:
            out.append(hi - 1)
            hi, end = hi - 1, end - 1
        if lo == hi or start == end:
            continue
        there = Counter(b[start:end])
        if sum(there[x] for x in a[lo:hi]) <= MATCHES or hi - lo == 1:
            out += [lo + i for i in chain_of(a[lo:hi], b[start:end])]
            continue
        middle = (lo + hi) // 2
        before = lengths(a[lo:middle], b[start:end])
        after = lengths(a[middle:hi][::-1], b[start:end][::-1])[::-1]
        cut = start + int((before + after).argmax())
        open_ += [(lo, middle, start, cut), (middle, hi, cut, end)]
    return sorted(out)


def lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of ``a`` with the first 0, 1, ... len(b) lines of ``b``.

    The bits of one long number stand for the lines of ``b``; a line of ``a`` takes one addition. Zeros are where the length grows.
    """
    n = len(b)
    wanted, spots = set(a), {}
    for j, line in enumerate(b):
        if line in wanted:
            spots.setdefault(line, []).append(j)
    masks = {}
    for line, at in spots.items():
        bits = np.zeros(n, np.uint8)
        bits[at] = 1
        masks[line] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    row = full = (1 << n) - 1
    for line in a:
        mask = masks.get(line)
        if mask is not None:
            met = row & mask
            row = ((row + met) | (row - met)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes((n + 7) // 8, "little"), np.uint8), count=n, bitorder="little")
    return np.concatenate([[0], np.cumsum(bits == 0)])


def chain_of(a: list[int], b: list[int]) -> list[int]:
    """Indices of ``a`` in a longest chain of matches that rises in both lists."""
    spots: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        spots.setdefault(b[j], []).append(j)
    ends: list[int] = []
    last: list[tuple[int, tuple | None]] = []
    for i, line in enumerate(a):
        for j in spots.get(line, ()):
            k = bisect_left(ends, j)
            node = (i, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(node)
            else:
                ends[k], last[k] = j, node
    chain, node = [], last[-1] if last else None
    while node:
        chain.append(node[0])
        node = node[1]
    return chain[::-1]


def neighbours(pages: DataFrame) -> DataFrame:
    """(row, before, after): the rows next to each one in the order of host, path and row, null at a host's ends.

    Rows are sorted by range, so a large host is spread over tasks. The two rows at the
    ends of each task's range are completed on the driver: two keys per task.
    """
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = pages.select("row", "host", "path").repartitionByRange(parts, "host", "path", "row").sortWithinPartitions("host", "path", "row")
    fields = pa.schema(
        [("row", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("before", pa.int64()), ("before_path", pa.string()),
         ("after", pa.int64()), ("after_path", pa.string()), ("part", pa.int32()), ("edge", pa.int32())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, held = TaskContext.get().partitionId(), None, None

        def made(row, prior, following) -> dict:
            near = {"part": part, "edge": (prior is None) + 2 * (following is None)}
            for name, other in (("before", prior), ("after", following)):
                same = other is not None and other["host"] == row["host"]
                near |= {name: other["row"] if same else None, f"{name}_path": other["path"] if same else None}
            return row | near

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held is not None:
                    out.append(made(held, before, row))
                before, held = held, row
            yield pa.RecordBatch.from_pylist(out, schema=fields)
        if held is not None:
            yield pa.RecordBatch.from_pylist([made(held, before, None)], schema=fields)

    schema = "row long, host string, path string, before long, before_path string, after long, after_path string, part int, edge int"
    found = materialise(ordered.mapInArrow(run, schema), "neighbours")
    ends = sorted(found.where("edge > 0").collect(), key=lambda r: (r["part"], r["edge"] & 2))
    fixed = []
    for at, row in enumerate(ends):
        now = row.asDict()
        for name, other, bit in (("before", at - 1, 1), ("after", at + 1, 2)):
            if row["edge"] & bit and 0 <= other < len(ends) and ends[other]["host"] == row["host"]:
                now |= {name: ends[other]["row"], f"{name}_path": ends[other]["path"]}
        fixed.append(tuple(now[f] for f in found.columns))
    return found.where("edge = 0").union(spark.createDataFrame(fixed, found.schema))


def nearest(pages: DataFrame) -> DataFrame:
    """(row, partner): the neighbour in URL order with the longer common start of the path, the one before on ties."""
    start = lambda other: F.aggregate(
        F.zip_with(F.split("path", "/"), F.split(other, "/"), lambda a, b: a.eqNullSafe(b)),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, same: F.struct((s["n"] + F.when(s["on"] & same, 1).otherwise(0)).alias("n"), (s["on"] & same).alias("on")),
        lambda s: s["n"],
    )
    near = neighbours(pages)
    first = F.when(F.col("after").isNull() | (F.col("before").isNotNull() & (start("before_path") >= start("after_path"))), F.col("before"))
    return near.select("row", first.otherwise(F.col("after")).alias("partner")).where("partner is not null")


def parsed(df: DataFrame, html: str) -> DataFrame:
    """``df`` with ``lines`` (texts), ``places`` and ``marks`` (hashes) of the page's lines, instead of ``html``."""
    kept = [f for f in df.schema if f.name != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(html)
            rest = [batch.column(i) for i in range(batch.num_columns) if i != at]
            for lo in range(0, batch.num_rows, 256):
                found = [lines_of(t.as_py()) for t in batch.column(at)[lo : lo + 256]]
                yield pa.RecordBatch.from_arrays(
                    [*(c[lo : lo + 256] for c in rest), pa.array([[t for t, _ in f] for f in found], pa.list_(pa.string())),
                     pa.array([bytes(p for _, p in f) for f in found], pa.binary())],
                    names=[*(f.name for f in kept), "lines", "places"],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    out = df.mapInArrow(run, f"{schema}, lines array<string>, places binary")
    return out.withColumn("marks", F.transform("lines", lambda x: F.xxhash64(x)))


def shared_lines(slim: DataFrame) -> DataFrame:
    """(row, shared): indices of the lines that a page shares with the page of the nearest URL."""
    pairs = nearest(slim.select("row", "host", "path"))
    other = slim.select(F.col("row").alias("partner"), F.col("marks").alias("other_marks"))
    both = slim.select("row", "marks").join(pairs, "row").join(other, "partner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, mine, theirs = (batch.column(i).to_pylist() for i in range(3))
            found = [common(a, b) for a, b in zip(mine, theirs, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["row", "shared"])

    return both.select("row", "marks", "other_marks").mapInArrow(run, "row long, shared array<int>")


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars, n_lines, n_shared) of every page.

    Text is the article's lines; on a page without an article or main element, or with more text
    outside it, all lines but those of menus and the like and those outside that are shared with
    the page of the nearest URL. Null html is
    empty; repeated rows get the same text; a page alone on its host is compared with none;
    a null URL is a host of its own.
    """
    rows = df.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    rows = rows.withColumn("row", F.xxhash64("key", "url", "html"))
    pages = parsed(rows, "html")
    bare = F.regexp_replace(F.coalesce("url", F.lit("")), r"[?#].*$", "")
    slim = materialise(
        pages.select("row", F.regexp_extract(bare, r"^[A-Za-z]+://([^/]*)", 1).alias("host"),
                     F.regexp_replace(bare, r"^[A-Za-z]+://[^/]*|(\.html?|/)$", "").alias("path"), "marks").dropDuplicates(["row"]), "lines",
    )
    joined = pages.join(shared_lines(slim), "row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, shown = [], []
            for lines, places, shared in zip(*(batch.column(n).to_pylist() for n in ("lines", "places", "shared")), strict=True):
                kept = main_text(lines, places, set(shared or ()))
                texts.append("\n".join(kept))
                shown.append(len(shared or ()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64)),
                 pa.array([len(x) for x in batch.column("lines").to_pylist()], pa.int32()), pa.array(shown, pa.int32())],
                names=["key", "url", "text", "n_chars", "n_lines", "n_shared"],
            )

    kind = df.schema[key].dataType.simpleString()
    out = joined.select("key", "url", "lines", "places", "shared").mapInArrow(
        run, f"key {kind}, url string, text string, n_chars long, n_lines int, n_shared int"
    )
    return out.withColumnsRenamed({"key": key, "url": url})
