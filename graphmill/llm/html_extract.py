"""Main text of pages by differencing each page against the nearest URLs of its host.

Pages stand in the order of host and URL path.  Each is cut into text lines (blocks), and lines that it shares with its
nearest neighbour, aligned by longest common subsequence, are the site's and go, inside an article element as outside it.
A neighbour that carries the same article can't tell the article's lines from the site's; the next nearest is taken then.  What
no neighbour can tell is left to the markup: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments.
"""
from __future__ import annotations

import html as entities
import itertools
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, small_batches, table

#: rows on either side among which a page's neighbour is looked for
REACH = 2
#: what pages are sorted by
PLACE = (("host", "string"), ("path", "string"), ("page_id", "bigint"), ("h", "bigint"))
#: bounds that are compared at once; the square of it is the most buckets that pages are dealt into
GROUP = 128
#: places of two pages' lines that are traced at once
CELLS = 1 << 26
#: elements whose text is never read
RAW = {"script", "style", "template", "noscript", "svg", "math", "iframe", "object", "canvas", "audio", "video", "head", "textarea", "select", "option"}
#: those of them that don't end a text line
UNSEEN = {"script", "style", "template", "noscript"}
#: elements around an article
AROUND = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
#: elements that own what lies inside
OWN = {"article", "main"}
#: elements without an end tag
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: elements that don't end a text line
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br"}
#: words of class, id and role values that name what isn't article, outside one
NAMES = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|popup|modal|overlay|sidebar|side-bar|menu|navbar|nav|navigation|breadcrumbs?|header|masthead|footer|comments?|replies|reply|discussion|disqus|related|recommended|share|sharing|social|newsletter|subscribe|signup|login|search|toolbar|widget|pagination|pager)(?:$|[\s_-])", re.I)
#: whole names that do so inside an article too: those of adverts and of what readers write
INSIDE = re.compile(r"(?:^|\s)(?:ad|ads|advert|adverts|advertisement|sponsored|comment|comments|comment-list|comments-area|replies|disqus_thread)(?:$|\s)", re.I)
OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
LABEL = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
STOP = re.compile(r"[>=]")
VALUE = re.compile(r"\s*([\"']?)")
BODY = re.compile(r"<body", re.I)
END_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


class _Page:
    """A page's text, with searches that never look twice for what isn't there."""

    def __init__(self, text: str):
        self.text, self.n, self.none = text, len(text), set()

    def find(self, what: str, at: int) -> int:
        """The next ``what``, or -1."""
        if what in self.none:
            return -1
        k = self.text.find(what, at)
        if k < 0:
            self.none.add(what)
        return k

    def past(self, what: str, at: int) -> int:
        k = self.find(what, at)
        return self.n if k < 0 else k + len(what)

    def tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag: quotes count only where a value begins, and only in pairs."""
        while self.find(">", at) >= 0:
            m = STOP.search(self.text, at)
            if m[0] == ">":
                return m.start()
            v = VALUE.match(self.text, m.end())
            at = v.end()
            if v[1] and (k := self.find(v[1], at)) >= 0:
                at = k + 1
        return -1


def lines(page: str) -> list[tuple[str, bool, bool]]:
    """(text, inside an article, named as not article) of each non-empty block, in page order."""
    p = _Page(page)
    out, text = [], []
    stack: list[tuple[str, int, int]] = []  # element, depth of own and of around when it opened
    opened: Counter = Counter()
    own = around = 0
    at, n = 0, len(page)

    def flush():
        if text:
            line = " ".join("".join(text).split())
            text.clear()
            if line:
                out.append((line, own > 0, around > 0))

    while at < n:
        m = OPEN.search(page, at)
        if m is None:
            text.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            text.append(entities.unescape(page[at:m.start()]))
        at = m.end()
        if not m[5]:
            at = p.past("-->" if m[1] else "]]>" if m[2] else ">", at)
            continue
        end = p.tag_end(at)
        if end < 0:  # no tag ends any more
            text.append(entities.unescape(page[m.start():]))
            break
        tag, closing, rest, at = m[5].lower(), m[4], page[at:end], end + 1
        if tag in RAW and not closing and not rest.endswith("/"):
            if tag not in UNSEEN:
                flush()
            e = END_RAW[tag].search(page, at)
            if e is None and tag == "head":
                e = BODY.search(page, at)
                at = e.start() if e else n
            else:
                at = e.end() if e else n
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if closing:
            while opened[tag]:  # what is passed over is closed as well
                top, own, around = stack.pop()
                opened[top] -= 1
                if top == tag:
                    break
        elif tag not in VOID and not rest.endswith("/"):
            if tag in ("p", "li", "td", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                _, own, around = stack.pop()
                opened[tag] -= 1
            stack.append((tag, own, around))
            opened[tag] += 1
            label = " ".join(a or b or c for a, b, c in LABEL.findall(rest)) if rest else ""
            inside = own > 0 or tag in OWN
            if (tag in AROUND and not (tag == "header" and own)) or (label and tag not in ("html", "body") and (INSIDE if inside else NAMES).search(label)):
                around += 1
            if tag in OWN:
                own += 1
    flush()
    return out


def _rows_of(a: list, b: list) -> list[int]:
    """After each line of ``a``, the places of ``b`` at which the longest common subsequence doesn't grow, as the bits of a number."""
    where: dict = {}
    for k, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << k
    every = (1 << len(b)) - 1
    out, v = [], every
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & every
        out.append(v)
    return out


def _growth(v: int, m: int) -> list[int]:
    """Lengths of the longest common subsequence with the first 0, 1, .. m lines of ``b``."""
    out = [0]
    for bit in bin(v + (1 << m))[:2:-1]:
        out.append(out[-1] + (bit == "0"))
    return out


def _aligned(a: list, b: list, base: int, found: set) -> None:
    n, m = len(a), len(b)
    if not n or not m:
        return
    if n * m > CELLS and n > 1:  # in halves, so that memory stays linear
        h = n // 2
        up = _growth(_rows_of(a[:h], b)[-1], m)
        down = _growth(_rows_of(a[h:][::-1], b[::-1])[-1], m)
        cut = max(range(m + 1), key=lambda j: up[j] + down[m - j])
        _aligned(a[:h], b[:cut], base, found)
        _aligned(a[h:], b[cut:], base + h, found)
        return
    rows = _rows_of(a, b)
    i, j = n, m
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.add(base + i)


def common(a: list[str], b: list[str]) -> set[int]:
    """Indices of ``a`` in a longest common subsequence with ``b``, bit by bit: a line costs the length of ``b`` in machine words, however often lines repeat."""
    i, n, m = 0, len(a), len(b)
    while i < min(n, m) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(n, m) - i and a[n - 1 - j] == b[m - 1 - j]:
        j += 1
    found = set(range(i)) | set(range(n - j, n))
    either = set(a[i:n - j]) & set(b[i:m - j])  # lines of one side only can't be common
    at = [k for k in range(i, n - j) if a[k] in either]
    inner: set[int] = set()
    _aligned([a[k] for k in at], [x for x in b[i:m - j] if x in either], 0, inner)
    return found | {at[k] for k in inner}


Blocks = list[tuple[str, bool, bool]]


def carries(page: Blocks, shared: set[int]) -> bool:
    """Whether a neighbour that shares these lines has the page's article too: lines of more than half of its characters."""
    own = [i for i, (_, own, around) in enumerate(page) if own and not around]
    return 2 * sum(len(page[i][0]) for i in own if i in shared) > sum(len(page[i][0]) for i in own)


def article(page: Blocks, neighbours: list[Blocks]) -> list[str]:
    """Blocks that are the page's own, given its neighbours, nearest first.

    The lines shared with the nearest one that doesn't carry the same article go.  If all carry it, the nearest one's shared lines
    outside the article go.
    """
    gone: set[int] = set()
    own = [x[0] for x in page]
    for k, other in enumerate(neighbours):
        shared = common(own, [x[0] for x in other])
        if not carries(page, shared):
            gone = shared
            break
        if k == 0:
            gone = {i for i in shared if not page[i][1]}
    return [t for i, (t, _, around) in enumerate(page) if not around and i not in gone]


def _shared_run(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _extract(batches):
    """Rows (bucket, mine, host, path, page_id, url, html), sorted: a page's neighbours are up to REACH rows before and after it on the same host, those that differ in text, nearest path first."""
    def pages():
        for b in batches:
            for bucket, mine, host, path, i, u, h in zip(*(b.column(k).to_pylist() for k in range(7))):
                yield (bucket, host), path, i, u, lines(h or ""), mine

    def result(around, k):
        where, path, i, u, page, _ = around[k]
        near = sorted((x for x in around if x[0] == where and x[4] != page), key=lambda x: -_shared_run(x[1], path))
        text = "\n\n".join(article(page, [x[4] for x in near]))
        return i, u, text, len(text)

    rows, size = [], 0
    held: deque = deque(maxlen=2 * REACH + 1)
    for x in itertools.chain(pages(), [None] * REACH):
        held.append(x)
        k = len(held) - 1 - REACH
        if k >= 0 and held[k] is not None and held[k][5]:
            # the order of distance breaks ties of the path: sorting is stable
            by_distance = sorted((j for j in range(len(held)) if held[j] is not None), key=lambda j: abs(j - k))
            rows.append(result([held[j] for j in by_distance], 0))
            size += rows[-1][3]
        if size > 4 << 20 or len(rows) >= 1000:
            yield _rows(rows)
            rows, size = [], 0
    if rows:
        yield _rows(rows)


def _rows(rows):
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _bucket(key, bounds: list):
    """How many of the sorted ``bounds`` are at most ``key``, by groups of GROUP."""
    if not bounds:
        return F.lit(0)
    lit = lambda x: F.struct(*(F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(x, PLACE)))
    groups = [bounds[i:i + GROUP] for i in range(0, len(bounds), GROUP)]
    heads = F.array(*(lit(g[0]) for g in groups))
    group = F.size(F.filter(heads, lambda x: x <= key)) - 1
    inside = F.get(F.array(*(F.array(*(lit(x) for x in g)) for g in groups)), group)
    return F.when(group < 0, F.lit(0)).otherwise(group * GROUP + F.size(F.filter(inside, lambda x: x <= key)))


def extract(pages: DataFrame, buckets: int | None = None) -> DataFrame:
    """page_id, url, text, n_chars, a row a page.

    A null or empty html, or one without text, gives the empty text.  Blocks are white-space folded, trimmed and joined by a blank line.
    Pages whose URL is null or without a host stand together as one host.  Pages stand in the order of host, path, page_id and a
    hash of the html; repeated rows are next to each other, each has its row, and as they don't differ in text they are no neighbours.
    Of neighbours whose paths are equally near, the row that is fewer places away counts, then the one before.  A page without a
    neighbour is judged by its markup alone.

    Rows are dealt into ranges, which splits hot hosts; the bounds are rows of a sample by hash, and a range also has the
    rows just beyond its ends, and no range is shorter than that reach, so results don't hang on where the bounds are.
    """
    spark = pages.sparkSession
    small_batches(spark)
    # several ranges a task, so that what hashing deals to each is even
    n = min(buckets or 8 * partitions(spark), GROUP * GROUP)
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), "^www\\.", "")
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    p = pages.select(host.alias("host"), path.alias("path"), F.col("page_id").cast("long").alias("page_id"), F.xxhash64("html").alias("h"), "url", "html")
    places = [name for name, _ in PLACE]
    key = F.struct(*places)
    order = materialize(p.select(*places).distinct(), "page-order")
    rate = max(1, order.count() // (8 * n))
    sample = [tuple(r) for r in order.where(F.pmod(F.xxhash64(*places), F.lit(rate)) == 0).orderBy(*places).limit(64 * n).collect()]
    # every range holds REACH rows or more, so that the rows beside it are all in the ranges beside it
    step = max(REACH, -(-len(sample) // n))
    bounds = [sample[i] for i in range(step, len(sample) - REACH + 1, step)]
    typed = [(h, q, i, x) for h, q, i, x in bounds if i is not None]
    order = order.withColumn("bucket", _bucket(key, typed))
    # the rows at the ends of each range, as context of the range beside it: at most 2 * REACH a range
    at = lambda *by: F.row_number().over(Window.partitionBy("bucket").orderBy(*by))
    ends = order.withColumn("a", at(*places)).withColumn("z", at(*(F.desc(c) for c in places))).where(f"a <= {REACH} or z <= {REACH}")
    beside = F.filter(F.array(F.when(F.col("a") <= REACH, F.col("bucket") - 1), F.when(F.col("z") <= REACH, F.col("bucket") + 1)), lambda x: x.isNotNull())
    ends = ends.select(*(F.col(c).alias(c + "2") for c in places), beside.alias("beside"))
    same = F.expr(" and ".join(f"{c} <=> {c}2" for c in places))
    all_ = p.withColumn("own", _bucket(key, typed)).join(F.broadcast(ends), same, "left")
    all_ = all_.select("host", "path", "page_id", "h", "url", "html", F.posexplode(F.concat(F.array("own"), F.coalesce("beside", F.array().cast("array<int>")))).alias("pos", "bucket"))
    all_ = all_.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", *places)
    return all_.select("bucket", (F.col("pos") == 0).alias("mine"), "host", "path", "page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
