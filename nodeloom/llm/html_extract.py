"""Main text of web pages: nearest-URL page differencing.

1. Each page is read into lines, one for each block element, with character references
   decoded and white space folded. What markup itself declares to be no article goes at once:
   scripts, styles, comments, forms, and elements whose tag, role, class or id says menu,
   header, footer, sidebar, notice, advert or reader comments. Lines within an ``article`` or
   ``main`` element are declared to be the article.
2. All other lines are undeclared. Pages of a host with the very same lines, declared ones
   included, are copies: the one with the least path stands for all of them, and what is deleted
   from it is deleted from its copies. These pages are sorted by host and URL path, and each is
   paired with the neighbour that shares the longer beginning of the path. The two pages'
   undeclared lines are aligned by a longest common subsequence, and lines that both have are
   deleted: they belong to the template.

Only hashes of undeclared lines leave their page's task for the comparison. Pages are dealt by
range over (host, path, id), so a host with a third of all pages is spread, and the first and
last page of each range are given to the ranges beside it.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, cut, hot_keys, packed, scratch

RANGE_ROWS = 2000

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "textarea", "title", "xmp", "noembed", "noframes"}
DROPPED = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "head", "label", "fieldset", "canvas", "audio", "video"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol",
    "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "toolbar"}
#: Words of class names and ids that declare an element to be no article.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "banner", "nav", "navbar", "navigation",
    "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "widget", "cookie", "cookies", "consent", "gdpr", "notice",
    "popup", "modal", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "related", "comment", "comments", "disqus", "pagination", "pager",
    "toolbar", "skip", "search",
}

_PART = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.S)
_WORD = re.compile(r"[a-z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

ARTICLE, OPEN = 1, 0


def _declared_away(tag: str, attrs: str) -> bool:
    if tag in DROPPED:
        return True
    if not attrs or tag in ("body", "html", "article", "main"):
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            for one in value.split():
                if any(w in NAMES for w in _WORD.findall(_HUMP.sub(" ", one).lower())):
                    return True
        elif name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
            return True
    return " hidden" in re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs.lower()).replace("=", "= ")


def lines_of(page: str) -> list[tuple[int, str]]:
    """(ARTICLE or OPEN, text) of each line of a page that markup does not declare away.

    Tags may be left open: ``p`` and ``li`` end where the next one begins, an end tag closes
    what is open within its element, and one that closes nothing is passed over.
    """
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, whether it drops, whether it is an article
    dropped = article = 0
    words: list[str] = []

    def end() -> None:
        if words:
            text = _SPACE.sub(" ", html.unescape("".join(words))).strip()
            words.clear()
            if text:
                out.append((ARTICLE if article else OPEN, text))

    def pop() -> None:
        nonlocal dropped, article
        _, drops, main = stack.pop()
        dropped -= drops
        article -= main

    at, size = 0, len(page)
    while at < size:
        m = _PART.match(page, at)
        if m is None:
            if not dropped:
                words.append(page[at])
            at += 1
            continue
        at = m.end()
        cdata, closing, tag, attrs, text = m.groups()
        if text is not None or cdata is not None:
            if not dropped:
                words.append(text if cdata is None else cdata)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS and not dropped:
            end()
        elif tag == "br":
            words.append(" ")
        if closing:
            if any(t == tag for t, _, _ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else (size if tag in ("script", "style", "textarea", "title", "xmp") else at)
            continue
        if tag in VOID or attrs.rstrip().endswith("/"):
            continue
        if tag in BLOCKS and stack and stack[-1][0] == "p":
            pop()
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            near = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in (tag, "ul", "ol", "dl", "table")), -1)
            if near >= 0 and stack[near][0] == tag:
                while len(stack) > near:
                    pop()
        drops, main = _declared_away(tag, attrs), tag in ("article", "main") or 'role="main"' in attrs
        # Sections that an article carries in its own header stay, menus and the like do not.
        if drops and tag == "header" and article:
            drops = False
        stack.append((tag, drops, main))
        dropped += drops
        article += main
    if not dropped:
        end()
    return out


#: Cells of an alignment whose rows of bits are kept; larger ones are halved first.
CELLS = 1 << 24


def _row(x: list[int], y: list[int]) -> int:
    """Bits of the places in y; bit j is 0 where the common subsequence of x and y[: j + 1] is longer than without y[j]."""
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for v in x:
        hit = row & where.get(v, 0)
        row = (row + hit | row - hit) & full
    return row


def _lengths(x: list[int], y: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of x and each beginning of y."""
    row = _row(x, y)
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def _aligned(x: list[int], y: list[int]) -> list[int]:
    """Places in x of a longest common subsequence, from the rows of bits of all lines of x."""
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    row, rows = full, []
    for v in x:
        hit = row & where.get(v, 0)
        row = (row + hit | row - hit) & full
        rows.append(row)
    i, j, found = len(x) - 1, len(y) - 1, []
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:
            j -= 1
        elif i and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            found.append(i)
            i, j = i - 1, j - 1
    return found[::-1]


def common_lines(a: list[int], b: list[int], cells: int = CELLS) -> list[int]:
    """Places in ``a`` of the lines of a longest common subsequence of a and b.

    Equal beginnings and ends are matched first. The middle is solved by rows of bits; where
    these would be more than ``cells``, a is halved, b is split where the lengths from both
    sides add up to the most, and the parts are solved one by one, so memory stays in
    proportion to the pages.
    """
    found: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            found.append(i)
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            found.append(n)
        if i == n or j == m:
            continue
        x, y = a[i:n], b[j:m]
        if len(x) * len(y) <= cells or len(x) == 1:
            found += [i + p for p in _aligned(x, y)]
            continue
        half = len(x) // 2
        split = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        todo += [(i, i + half, j, j + split), (i + half, n, j + split, m)]
    return sorted(found)


def _shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _differences(group: pa.Table) -> pa.Table:
    rows = sorted(zip(group["host"].to_pylist(), group["path"].to_pylist(), group["key"].to_pylist(), group["lines"].to_pylist(), group["beside"].to_pylist(), strict=True), key=lambda r: r[:3])
    keys, gone = [], []
    for k, (host, path, key, own, beside) in enumerate(rows):
        if beside or not own:
            continue
        best, most = None, -1
        for j in (k - 1, k + 1):
            if 0 <= j < len(rows) and rows[j][0] == host and (n := _shared(path, rows[j][1])) > most:
                best, most = rows[j][3], n
        if best and (places := common_lines(own, best)):
            keys.append(key)
            gone.append(places)
    return pa.table({"key": pa.array(keys, pa.int64()), "gone": pa.array(gone, pa.list_(pa.int32()))})


def _host_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", carry: list[str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``row`` (struct of the columns ``carry``, all by default), ``text`` of each page.

    text is the page's main text, its blocks joined by a line feed; empty for null or empty
    pages and for those without main text. Pages without a URL form a host of their own; pages
    that repeat an id or URL are paired like any others; copies of a page have one text; a page
    that is alone in its host, but for copies, keeps its undeclared lines. Whole pages are read,
    however long; an empty table gives an empty result; extra columns travel inside ``row`` only.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 128):
                got = [lines_of(x or "") for x in batch.column(1).slice(i, 128).to_pylist()]
                texts = [[t for _, t in page] for page in got]
                marks = [[None if kind == ARTICLE else int.from_bytes(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) for kind, t in page] for page in got]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 128), pa.array(texts, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.int64()))], schema.names)

    host, path = _host_path(pages[url_col])
    plain = pages.select(F.struct(packed(pages, carry).alias("row"), host.alias("host"), path.alias("path")).alias("own"), pages[html_col].cast("string").alias("html"))
    schema = plain.select("own", F.expr("cast(array() as array<string>)").alias("texts"), F.expr("cast(array() as array<long>)").alias("marks")).schema
    parsed = plain.mapInArrow(read, schema).withColumn("key", F.monotonically_increasing_id())
    parsed = cut(parsed.select("key", "own.row", "own.host", "own.path", "texts", "marks", F.unhex(F.sha2(F.to_json(F.struct("texts", F.transform("marks", lambda m: m.isNull()).alias("kind"))), 256)).alias("d")), result=True)
    with scratch():
        gone = cut(_deleted(parsed, range_rows), result=True)
    out = attach(parsed, gone, ["host", "d"], cut(hot_keys(parsed, ["host", "d"], parsed.count())))
    # ``gone`` counts undeclared lines only: put their places back among all lines, and keep the others.
    places = F.expr("filter(sequence(0, size(marks)), i -> i < size(marks) and marks[i] is not null)")
    out = out.withColumn("places", places).withColumn("away", F.expr("transform(gone, g -> places[g])"))
    stay = F.expr("array_except(filter(sequence(0, size(texts)), i -> i < size(texts)), coalesce(away, cast(array() as array<int>)))")
    return out.withColumn("stay", stay).select("row", F.array_join(F.expr("transform(stay, i -> texts[i])"), "\n").alias("text"))


def _deleted(parsed: DataFrame, range_rows: int) -> DataFrame:
    """host, d (digest of all lines), gone (places among the undeclared lines) of pages that lose some."""
    open_ = parsed.select("host", "path", "key", "d", F.filter("marks", lambda m: m.isNotNull()).alias("lines")).where(F.size("lines") > 0)
    first = open_.groupBy("host", "d").agg(F.min(F.struct("path", "key")).alias("first"))
    open_ = cut(open_.join(first.select(F.col("first.key").alias("key")), "key", "left_semi"))
    ranges = max(1, -(-open_.count() // range_rows))
    dealt = cut(open_.repartitionByRange(ranges, "host", "path", "key").withColumn("part", F.spark_partition_id()))
    order = F.struct("host", "path", "key")
    ends = dealt.groupBy("part").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    line = Window.orderBy("part")  # a row for each range
    ends = ends.select(F.lag("part").over(line).alias("before"), "first", F.lead("part").over(line).alias("after"), "last")
    guests = ends.select(F.col("before").alias("to"), "first.*").union(ends.select(F.col("after").alias("to"), "last.*")).where("to is not null")
    guests = guests.join(dealt.select("key", "lines"), "key").select(F.col("to").alias("part"), "host", "path", "key", "lines", F.lit(True).alias("beside"))
    both = dealt.drop("d").withColumn("beside", F.lit(False)).unionByName(guests)
    gone = both.groupBy("part").applyInArrow(_differences, "key long, gone array<int>")
    return dealt.select("host", "d", "key").join(gone, "key").select("host", "d", "gone")


def op5_html_extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    got = main_text(pages, carry=["page_id", "url"])
    return got.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))
