"""Main text of web pages by nearest-URL page differencing.

A first pass leaves hashes of each page's lines; these are sorted by host and URL path over range partitions, so a large
host spreads over many tasks, and each page is paired with the nearest page before it that isn't a near copy of it (the
first ones of a host with the first such page behind them). Pages of a host with equal lines are one in this and lose the
same lines. A second pass takes from each page the lines that the pairing has named, so whole pages are never shuffled
unless these names are too many to broadcast. All text lines of both, in menus and articles alike, are aligned by longest
common subsequence, and lines that they share are deleted: menus, notices and the like recur, articles don't. Markup
speaks beside it, where there is any: lines of elements that are boilerplate by name, role or class go also where the
other page has them not, and lines in an article or main element stay even if it has them, as an article may quote a
passage that others quote; of a header inside it, links and lists go. A page with no other page than near copies is kept.

The stream carries the last page and the one that it was paired with. Pages that have no partner so far, at the start of
a host or partition, are paired in a second step, by a window over one row per host and partition of what was carried.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueframe.llm.common import read, slices, staged

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CUT = frozenset("aside button canvas dialog footer form head header iframe menu nav noscript object select svg template textarea title".split())
RAW = "script|style|textarea|title|noscript|template|svg|iframe"
CUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar "
    "navigation newsletter notice notices notification pager pagination popup promo promotion recommended related reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*>?|[^<]+|<",  # the second form: an open quote ends with its tag
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
SPACES = re.compile(r"\s+")
PROPERTY = frozenset("has with no without is not of".split())  # a name with one of these tells of a wrapper
HEADS = frozenset("banner header masthead".split())
LINKS = frozenset("a dl menu ol table ul".split())  # of a header inside an article these go
NEAR = 0.8  # share of a page's text in shared lines that makes it a near copy


def _named(value: str) -> str:
    """The word for boilerplate that a class or id tells of, or "": a name's last word, or the first one of the only name.

    Names with a word for a mere property tell nothing.
    """
    names = [[w for w in re.split(r"[^a-z0-9]+", x) if w] for x in value.split()]
    for parts in names:
        for w in (parts[-1:] + parts[: len(names) == 1]) if PROPERTY.isdisjoint(parts[:-1]) else ():
            if w in CUT_WORDS:
                return w
    return ""


def _cut(name: str, attributes: str) -> int:
    """2 for an element that is boilerplate, 1 for one that only its class or id says so of, -1 for a header by name, else 0."""
    if name in CUT:
        return 2
    soft = 0
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in CUT_ROLES:
            return 2
        word = _named(value) if key in ("class", "id") and name not in ("body", "html", "article", "main") else ""
        if word:
            soft = 1 if soft == 1 or word not in HEADS else -1
    return soft


LOOSE, KEPT, MARKED = 0, 1, 2  # kinds of lines: go if shared, stay, go


def lines(page: str) -> tuple[list[str], list[int]]:
    """The text blocks of a page and their kinds.

    KEPT: in an article or main element; MARKED: in an element that is boilerplate by its markup, or a link or list of a
    header inside an article. An element that only
    its class or id names is none if it holds an article or main element or over four fifths of the page's text.
    """
    blocks: list[tuple[list[tuple[int, bool, str]], int]] = []
    text: list[tuple[int, bool, str]] = []  # the innermost named element, -1 for none, whether it is cut, and a text
    named: list[tuple[int, bool]] = []  # of each named element, the one around it, and whether it is in an article
    size, holds = [], []
    stack: list[tuple[str, bool, int, int, bool]] = [("", False, LOOSE, -1, False)]  # name, cut, kind, named, header of an article

    def close() -> None:
        if text:
            blocks.append((text.copy(), stack[-1][2]))
            text.clear()

    for m in TOKEN.finditer(page):
        slash, name, attributes = m.group(2, 3, 4) if m[3] else m.group(5, 6, 7)
        if name is None:
            if m[0][0] != "<" or m[0] == "<":
                text.append((stack[-1][3], stack[-1][1], m[0]))
            continue
        name = name.lower()
        if name in BLOCK:
            close()
        elif name == "br":
            text.append((stack[-1][3], stack[-1][1], " "))
        if slash:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in BLOCK:  # an open paragraph ends here
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK:
                    break
        if name not in VOID:  # a slash before the end of a tag means nothing in HTML
            _, cut, kind, outer, head = stack[-1]
            how = 0 if cut else _cut(name, attributes)
            inside = kind != LOOSE or head
            if inside and (name == "header" or how < 0):  # an article's own header holds its title
                head, kind, how = True, LOOSE, 0
            elif head and name in LINKS:
                how = 2
            elif head and (name in HEADINGS or name in ("p", "blockquote")) or name in ("article", "main"):
                head, kind = False, KEPT
            if how in (1, -1):
                named.append((outer, inside))
                size.append(0), holds.append(False)
                outer = len(named) - 1
            if name in ("article", "main") and not cut and outer >= 0:
                holds[outer] = True
            stack.append((name, cut or how == 2, kind, outer, head))
    close()
    if named:
        whole = 0
        for parts, _ in blocks:
            for k, cut, x in parts:
                if not cut:
                    n = len("".join(x.split()))
                    whole += n
                    if k >= 0:
                        size[k] += n
        for k in range(len(named) - 1, -1, -1):
            outer, inside = named[k]
            if outer >= 0:
                size[outer] += size[k]
                holds[outer] |= holds[k]
            holds[k] &= not inside  # an article in the comments of an article doesn't save them
        gone = []
        for k, (outer, _) in enumerate(named):
            gone.append(outer >= 0 and gone[outer] or not (holds[k] or 5 * size[k] > 4 * whole))
        blocks = [([(k, cut or k >= 0 and gone[k], x) for k, cut, x in parts], kind) for parts, kind in blocks]
    out, kinds = [], []
    for parts, own in blocks:
        for kind in (own, MARKED):
            block = SPACES.sub(" ", html.unescape("".join(x for _, cut, x in parts if cut == (kind == MARKED)))).strip()
            if block:
                out.append(block)
                kinds.append(kind)
    return out, kinds


# --- alignment -------------------------------------------------------------------------------------------------------


def _rows(a: list, b: list, keep: bool) -> list[int]:
    """Bit-parallel lengths: bit j of row i is 0 where the common subsequence of a[:i] and b[:j + 1] is longer than that of a[:i] and b[:j]."""
    at: dict = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, [full]
    for x in a:
        hit = v & at.get(x, 0)
        v = ((v + hit) | (v - hit)) & full
        if keep:
            rows.append(v)
    return rows if keep else [v]


def common(a: list, b: list, memory: int = 1 << 30) -> set[int]:
    """The places in a of a longest common subsequence with b. Above `memory` bits a is halved first."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out = {*range(lo), *range(len(a) - hi, len(a))}
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not x or not y:
        return out
    if len(x) > 1 and len(x) * len(y) > memory:
        half = len(x) // 2
        front, back = _rows(x[:half], y, False)[0], _rows(x[half:][::-1], y[::-1], False)[0]
        ahead, behind = [0], [0]
        for j in range(len(y)):
            ahead.append(ahead[-1] + (not front >> j & 1))
            behind.append(behind[-1] + (not back >> j & 1))
        cut = max(range(len(y) + 1), key=lambda j: ahead[j] + behind[len(y) - j])
        return out | {lo + i for i in common(x[:half], y[:cut], memory)} | {lo + half + i for i in common(x[half:], y[cut:], memory)}
    rows, i, j = _rows(x, y, True), len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.add(lo + i)
        elif rows[i] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return out


def shared_lines(own: list[int], kinds: list[int], other: list[int] | None) -> list[int]:
    """The places of the lines that go because the paired page has them; none if nothing of the page would be left."""
    loose = [i for i, k in enumerate(kinds) if k != KEPT] if other else []
    out = sorted(loose[i] for i in common([own[i] for i in loose], other)) if loose else []
    return out if {i for i, k in enumerate(kinds) if k != MARKED} - set(out) else []


# --- pairing ---------------------------------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?(.*)$", 1)


STEP = pa.schema([("host", pa.string()), ("part", pa.int32()), ("sig", pa.int64()), ("kind", pa.string()), ("shared", pa.list_(pa.int32())), ("own", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int8())), ("size", pa.list_(pa.int32()))])
FIELDS = "page_id long, url string, key long, host string, path string"


def paired(own: list[int], kinds: list[int], size: list[int], others: list[list[int] | None]) -> tuple[int, list[int]]:
    """Which of others is the first that the page isn't a near copy of (-1: none), and the places of the lines that go."""
    size = [0 if k == MARKED else n for n, k in zip(size, kinds, strict=True)]
    for k, other in enumerate(others):
        if other and sum(size[i] for i in common(own, other)) < max(1, NEAR * sum(size)):
            return k, shared_lines(own, kinds, other)
    return -1, []


def _hashed(rows: DataFrame) -> DataFrame:
    """The line hashes of each distinct page, written as a table: what pairing moves instead of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in slices(batches, "html"):
            pages = [lines(h) for h in batch.column("html").to_pylist()]
            own = [[xxh3_64_intdigest(x) - 2**63 for x in p[0]] for p in pages]
            columns = [batch.column(c) for c in ("page_id", "url", "key", "host", "path")]
            size = pa.array([[len(x) for x in p[0]] for p in pages], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.list_(pa.int64())), pa.array([p[1] for p in pages], pa.list_(pa.int8())), size], ["page_id", "url", "key", "host", "path", "own", "kinds", "size"])

    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).select("page_id", "url", "key", "host", "path", "html")
    rows = rows.mapInArrow(run, f"{FIELDS}, own array<long>, kinds array<tinyint>, size array<int>").dropDuplicates(["page_id", "url", "key"])
    return staged(rows.withColumn("sig", F.xxhash64("own", "kinds")), "page-lines")


def decisions(hashed: DataFrame) -> DataFrame:
    """(page_id, url, key, shared) of the pages that lose lines."""
    order = ["host", "path", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), []
        host, last, other, open_ = None, None, None, False  # open_: no page of this host and partition had a partner so far

        def put(sig: int | None, kind: str, *lists: list | None) -> None:
            out.append(dict(zip(STEP.names, (host, part, sig, kind, *lists, *[None] * (4 - len(lists))), strict=True)))

        for batch in batches:
            for found, sig, own, kinds, size in zip(*(batch.column(c).to_pylist() for c in ("host", "sig", "own", "kinds", "size")), strict=True):
                if found != host:  # what the first host of a partition carries, also if it ends here, stands for it
                    if last:
                        put(None, "last", None, last)
                    host, last, other, open_ = found, None, None, True
                k, shared = paired(own, kinds, size, [last, other])
                if k < 0:
                    put(sig, "waits", None, own, kinds, size)
                else:
                    if open_:
                        put(None, "first", None, own)
                        open_ = False
                    if k == 0:
                        other = last
                    if shared:
                        put(sig, "done", shared)
                last = own
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, STEP)
                    out.clear()
        if last:
            put(None, "last", None, last)
            put(None, "other", None, other)
        if out:
            yield pa.RecordBatch.from_pylist(out, STEP)

    # one page stands for all of its host with the same lines
    pages = hashed.where(F.size("own") > 0).groupBy("host", "sig").agg(F.min(F.struct("path", "own", "kinds", "size")).alias("x")).select("host", "x.*", "sig")
    steps = pages.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "host string, part int, sig long, kind string, shared array<int>, own array<long>, kinds array<tinyint>, size array<int>")
    steps = staged(steps, "page-pairs")
    carried = steps.where("kind in ('first', 'last', 'other')").groupBy("host", "part").agg(*(F.first(F.when(F.col("kind") == c, F.col("own")), True).alias(c) for c in ("first", "last", "other")))
    by = Window.partitionBy("host").orderBy("part")
    earlier, later = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    # behind the page's own partition: its first page with a partner, else the last page of one after it
    sides = {"a": F.last("last", True).over(earlier), "b": F.last("other", True).over(earlier), "c": F.last("first", True).over(earlier), "d": F.first("first", True).over(later), "e": F.lead("last").over(by), "f": F.first("last", True).over(earlier)}
    carried = carried.withColumns(sides).select("host", "part", F.array(*"abcdef").alias("others"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [paired(*x[:3], x[3] or [])[1] for x in zip(*(batch.column(c).to_pylist() for c in ("own", "kinds", "size", "others")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("sig"), pa.array(shared, pa.list_(pa.int32()))], ["host", "sig", "shared"])

    waiting = steps.where("kind = 'waits'").select("host", "part", "sig", "own", "kinds", "size").join(carried, ["host", "part"])
    waiting = waiting.select("host", "sig", "own", "kinds", "size", "others").mapInArrow(again, "host string, sig long, shared array<int>")
    both = steps.where("kind = 'done'").select("host", "sig", "shared").unionByName(waiting).where("size(shared) > 0")
    return staged(hashed.select("page_id", "url", "key", "host", "sig").join(both, ["host", "sig"]).select("page_id", "url", "key", "shared"), "shared-lines")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages (page_id, url, html). Two line feeds part the blocks of a text.

    A null or empty page has the empty text; pages without a host are paired among themselves; repeated rows (equal in
    all three columns) are one page when paired, and get equal texts. Other columns are not read. No rows give no rows.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("key", F.xxhash64("html"))
    gone = decisions(_hashed(rows)).select(*(F.col(c).alias(f"_{c}") for c in ("page_id", "url", "key", "shared")))
    same = F.col("page_id").eqNullSafe(F.col("_page_id")) & F.col("url").eqNullSafe(F.col("_url")) & (F.col("key") == F.col("_key"))
    joined = rows.join(gone, same, "left").select("page_id", "url", "html", F.col("_shared").alias("shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = []
            for page, shared in zip(batch.column("html").to_pylist(), batch.column("shared").to_pylist(), strict=True):
                (own, kinds), drop = lines(page), set(shared or ())
                texts.append("\n\n".join(x for i, x in enumerate(own) if kinds[i] != MARKED and i not in drop))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
