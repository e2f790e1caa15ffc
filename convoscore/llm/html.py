"""Main text of web pages by nearest-URL page differencing.

Pages become lines (the blocks of their text) that know their containers.  Pages of a host are sorted by path; each is
compared with the neighbour whose path shares the longest prefix and that is no copy of it: their lines are aligned by a
longest common subsequence, and shared lines are deleted as the site's template.

Differencing can't tell two kinds of lines: what the article shares with its neighbour (a common sentence) and what is not
the article but differs from page to page (adverts, comments, menus made for the page).  There markup breaks the tie:
lines of containers that are marked up as the article return to it, elsewhere shared lines stay deleted; and elements that
can't be article text never count.  A page that has only copies around it keeps its lines.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements whose content is not text, elements that start a block, elements without content.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "title", "textarea", "xmp", "math", "object", "canvas")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, roles and words in class or id that mark what is not the article.
SKIPPED = frozenset("nav footer aside form button select menu dialog head".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
SKIPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification disclaimer newsletter subscribe subscription sidebar rail menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar masthead topbar footer comment comments disqus respond replies reply discussion related recommended recommendations share sharing social widget popup modal overlay login signup skip adbox adslot adsbygoogle commentlist cookiebar cookiebanner sidenav sitenav siteheader sitefooter pagefooter".split()
)
HEADER_WORDS = frozenset("header head".split())
CONTENT_WORDS = frozenset("article articlebody post entry story content maincontent bodytext".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    rf"""|<(?P<raw>{"|".join(RAW)})\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attr2>[^>]*)(?:>|\Z)""",
    re.S | re.I,
)
_ATTR = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+|[0-9]+")
#: Class names that begin so tell what the page has or lacks elsewhere, not what the element is.
_ELSEWHERE = re.compile(r"\b(?:has|with|no|without|show|hide)[-_]\S+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _nature(name: str, attr: str, inside_article: bool) -> tuple[bool, bool]:
    """(skipped, article) for an element."""
    values = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attr)} if attr.strip(" /") else {}
    named = re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{values.get('class', '')} {values.get('id', '')}").lower()
    words = set(_WORD.findall(_ELSEWHERE.sub(" ", named)))
    role = values.get("role", "").lower()
    skipped = (
        name in SKIPPED or role in SKIPPED_ROLES or "hidden" in values or values.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(values.get("style", "")))
        or name == "header" and not inside_article
        or name not in ("body", "html", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6") and (bool(words & SKIPPED_WORDS) or bool(words & HEADER_WORDS) and not inside_article)
        or name == "article" and bool(words & {"comment", "comments", "reply", "sponsored", "related", "teaser"})
    )
    article = name in ("article", "main") or role in ("main", "article") or values.get("itemprop", "").lower() == "articlebody" or name in ("div", "section", "td") and bool(words & CONTENT_WORDS)
    return skipped, article and not skipped


def parse(html: str) -> tuple[list[str], list[int], list[int], list[bool]]:
    """(lines, container of each line, parent of each container, whether a container is marked as the article).

    Lines of skipped elements are left out.  Container 0 is the page.  Malformed pages never fail: an end tag closes the
    nearest open element of its name, or nothing."""
    lines, where, parents, marked = [], [], [-1], [False]
    open_: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # name, container, skipped, in an article
    run: list[str] = []

    def flush():
        text = " ".join(unescape("".join(run)).split())
        run.clear()
        if text and not open_[-1][2]:
            lines.append(text)
            where.append(open_[-1][1])

    at = 0
    for token in _TOKEN.finditer(html):
        if token.start() > at:
            run.append(html[at : token.start()])
        at = token.end()
        name = (token["name"] or token["name2"] or "").lower()
        if not name:
            continue
        if name == "br" or name in ("td", "th"):
            run.append(" ")
        if name in BLOCKS:
            flush()
        if token["close"] or token["close2"]:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i][0] == name:
                    if open_[-1][2] != open_[i - 1][2]:
                        flush()
                    del open_[i:]
                    break
        elif name not in VOID and (name in BLOCKS or name in ("td", "button", "select") or (token["attr"] or token["attr2"] or "").strip()):
            if name in ("p", "li", "option", "dt", "dd") and open_[-1][0] == name:
                open_.pop()
            _, box, skipped, inside = open_[-1]
            odd, article = _nature(name, token["attr"] or token["attr2"] or "", inside)
            if odd and not skipped:
                flush()
            if not (skipped or odd) and name in ("article", "main", "section", "div", "body", "td"):
                parents.append(box)
                marked.append(article)
                box = len(parents) - 1
            open_.append((name, box, skipped or odd, inside or article))
    run.append(html[at:])
    flush()
    return lines, where, parents, marked


def _direct(a: list, b: list) -> list[tuple[int, int]]:
    """Bit-parallel LCS: a row of the table is one integer."""
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, v = [], full
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not (i and not rows[i - 1] >> (j - 1) & 1):
                j -= 1
                out.append((i, j))
    return out[::-1]


def _lengths(a: list, b: list):
    """The LCS length of ``a`` with every prefix of ``b``."""
    import numpy as np

    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes((len(b) + 7) // 8, "little"), np.uint8), bitorder="little", count=len(b))
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence.  Lines that only one side has are left out first; long rests are
    halved (Hirschberg), which keeps memory in proportion to the lines."""
    in_b, in_a = set(b), set(a)
    ia, ib = [i for i, x in enumerate(a) if x in in_b], [j for j, x in enumerate(b) if x in in_a]

    def align(ia, ib):
        if not ia or not ib:
            return []
        if len(ia) * len(ib) <= 1 << 22:
            return [(ia[i], ib[j]) for i, j in _direct([a[i] for i in ia], [b[j] for j in ib])]
        mid = len(ia) // 2
        if not mid:
            return next(([(ia[0], j)] for j in ib if a[ia[0]] == b[j]), [])
        head = _lengths([a[i] for i in ia[:mid]], [b[j] for j in ib])
        tail = _lengths([a[i] for i in ia[: mid - 1 : -1]], [b[j] for j in ib[::-1]])
        k = int((head + tail[::-1]).argmax())
        return align(ia[:mid], ib[:k]) + align(ia[mid:], ib[k:])

    return align(ia, ib)


def main_text(lines: list[str], where: list[int], parents: list[int], marked: list[bool], shared: set[int]) -> str:
    """The article's lines, joined by empty lines.  ``shared``: indexes of the lines that differencing deleted.

    All lines of containers marked as the article; if none of them is the page's own, then the page's own lines too, as
    the article may be a copy or lie elsewhere.  Without markup, all lines of the page's own."""
    if len(shared) == len(lines):  # a copy of its neighbour tells nothing
        shared = set()
    article = [False] * len(parents)
    for box in range(1, len(parents)):  # parents come before their children
        article[box] = marked[box] or article[parents[box]]
    inside = [i for i, box in enumerate(where) if article[box]]
    own = [i for i in range(len(lines)) if i not in shared]
    if inside and not shared.issuperset(inside):
        own = inside
    return "\n\n".join(lines[i] for i in sorted({*inside, *own}))


def url_key(url: str) -> tuple[str, str]:
    """(host, path) without scheme, port, query, fragment, and a leading www."""
    rest = re.sub(r"^[a-zA-Z][\w+.-]*:", "", url or "").lstrip("/")
    host, _, path = rest.partition("/")
    host = host.rpartition("@")[2].partition(":")[0].partition("?")[0].partition("#")[0].lower()
    return host.removeprefix("www."), re.split(r"[?#]", path, maxsplit=1)[0].rstrip("/")


_PAGE = "part int, page_id long, url string, host string, path string, lines array<string>, box array<int>, parent array<int>, marked array<boolean>"


_TEXT = "page_id long, url string, text string, n_chars long"
_NAMES = ("part", "page_id", "url", "host", "path", "lines", "box", "parent", "marked")
_BORDER_NAMES = (*_NAMES, "seq", "guest", "fresh")
_ORDER = ("host", "path", "page_id", "url")


def _place(page_id, url) -> tuple:
    """What pages are sorted by, as Spark sorts ``_ORDER``: nulls first, text by code points."""
    return (*url_key(url), page_id is not None, page_id or 0, url is not None, url or "")


def _pages(columns: list, names: tuple = _NAMES):
    import pyarrow as pa

    kinds = {"part": pa.int32(), "page_id": pa.int64(), "lines": pa.list_(pa.string()), "box": pa.list_(pa.int32()), "parent": pa.list_(pa.int32()), "marked": pa.list_(pa.bool_()), "seq": pa.int64(), "guest": pa.bool_(), "fresh": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k, pa.string())) for k, c in zip(names, columns, strict=True)], list(names))


def _parse_pages(bounds: list[tuple]):
    def parse_pages(batches):
        from bisect import bisect_right

        from .common import pieces

        for batch in pieces(batches, 256):
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            pages = [parse(x or "") for x in batch.column(2).to_pylist()]
            places = [_place(i, u) for i, u in zip(ids, urls, strict=True)]
            yield _pages([[bisect_right(bounds, x) for x in places], ids, urls, [x[0] for x in places], [x[1] for x in places], *([p[i] for p in pages] for i in range(4))])

    return parse_pages


def _bounds(pages: DataFrame, parts: int) -> list[tuple]:
    """Places that cut the pages into ``parts`` ranges of about the same size, from a sample of their urls."""
    every = max(1, pages.count() // (SAMPLE * parts))
    sample = sorted(_place(*row) for row in pages.filter(F.pmod(F.xxhash64("page_id", "url"), F.lit(every)) == 0).select("page_id", "url").distinct().collect())
    return sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []


def _near(a: str, b: str) -> int:
    from os.path import commonprefix

    return len(commonprefix([a, b]))


#: Pages are copies of each other if one of them has less than this share of its text for itself.
COPY = 0.1
#: Sampled urls for each range of pages.
SAMPLE = 40
#: Pages of a run of copies that are held in memory; more go to a temporary file.
HELD = 256


def _meet(a, b, known: list) -> tuple[bool, list[tuple[int, int]]]:
    """(whether two pages are copies, index pairs of their shared lines); ``known`` has the answers for the last pairs.

    A page without text tells nothing, so it counts as a copy."""
    for x, y, answer in known:
        if x is a and y is b:
            return answer
    pairs = common_lines(a["lines"], b["lines"])
    same = sum(len(a["lines"][i]) for i, _ in pairs)
    answer = any(n - same <= COPY * n for n in (sum(map(len, x["lines"])) for x in (a, b))), pairs
    known[:] = [(a, b, answer), *known[:2]]
    return answer


def _finish(page, before, after, known: list):
    """Row of a page, differenced against the nearer one of ``before`` and ``after``, the pages around its run (or None)
    that are no copies of it."""
    best, shared = -1, set()
    if before and not (met := _meet(before, page, known))[0]:
        best, shared = _near(before["path"], page["path"]), {j for _, j in met[1]}
    if after and _near(after["path"], page["path"]) > best and not (met := _meet(page, after, known))[0]:
        shared = {i for i, _ in met[1]}
    text = main_text(page["lines"], page["box"], page["parent"], page["marked"], shared)
    return page["page_id"], page["url"], text, len(text)


class _Run:
    """Neighbouring pages of a host, each a copy of the one before it.  A long run goes to a temporary file."""

    def __init__(self, page, before):
        self.before, self.last, self.held, self.file = before, page, [page], None

    def add(self, page):
        import pickle
        import tempfile

        self.last = page
        self.held.append(page)
        if len(self.held) >= HELD:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(self.held, self.file)
            self.held = []

    def pages(self):
        import pickle

        if self.file:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield from pickle.load(self.file)
            self.file.close()
        yield from self.held


def _runs(pages, known: list):
    """(run, page after it or None) of pages in order of host and path; a fresh page is known to be no copy of the one
    before it."""
    run = None
    for page in pages:
        if run is None:
            run = _Run(page, None)
        elif run.last["host"] != page["host"]:
            yield run, None
            run = _Run(page, None)
        elif not page.get("fresh") and _meet(run.last, page, known)[0]:
            run.add(page)
        else:
            yield run, page
            run = _Run(page, run.last)
    if run is not None:
        yield run, None


def _ends(batches, known: list):
    """(run, page after it or None, whether it is the first of its range, whether the last)."""
    from itertools import groupby

    for _, pages in groupby((page for batch in batches for page in batch.to_pylist()), key=lambda page: page["part"]):
        held, first = None, True
        for item in _runs(pages, known):
            if held:
                yield *held, first, False
                first = False
            held = item
        yield *held, first, True


def _texts(found):
    """Batches of rows out of (run, page after it) pairs."""
    import pyarrow as pa

    def emit(rows):
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "url", "text", "n_chars"])

    known, rows = next(found), []
    for run, after in found:
        for page in run.pages():
            if not page.get("guest"):
                rows.append(_finish(page, run.before, after, known))
            if len(rows) >= 1000:
                yield emit(rows)
                rows = []
    yield emit(rows)


def _difference(batches):
    """Rows of a range's pages in order of host and path, but for its first and its last run.  Holds two runs of copies
    and the pages around them, whatever the size of a host."""

    def inner():
        yield (known := [])
        yield from ((run, after) for run, after, first, last in _ends(batches, known) if not (first or last))

    return _texts(inner())


def _borders(batches):
    """The pages of a range's first and last run, in order, with the page that ends the one and begins the other; those
    are guests, which only serve as neighbours."""

    def pages():
        for run, after, first, last in _ends(batches, []):
            if first:
                yield from ((page, False, False) for page in run.pages())
                if after and not last:
                    yield after, True, True
            elif last:
                if run.before:
                    yield run.before, True, True
                yield from ((page, False, k == 0) for k, page in enumerate(run.pages()))

    rows = []
    for seq, (page, guest, fresh) in enumerate(pages()):
        rows.append((*(page[k] for k in _NAMES), seq, guest, fresh))
        if len(rows) >= 1000:
            yield _pages(list(zip(*rows, strict=True)), _BORDER_NAMES)
            rows = []
    if rows:
        yield _pages(list(zip(*rows, strict=True)), _BORDER_NAMES)


def _difference_borders(batches):
    """Rows of the pages that ``_borders`` gave, in order of host, range and place."""

    def whole():
        yield (known := [])
        yield from _runs((page for batch in batches for page in batch.to_pylist()), known)

    return _texts(whole())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (empty if there is none), n_chars.

    The whole html is read, however long; null counts as empty.  Other columns are ignored, ids may be null or repeated,
    each row is a page of its own, and an empty table gives an empty result.  A null or odd url gives an empty host, whose pages are compared with
    each other like any host's.  Pages with the same url are neighbours in order of id; a page without a neighbour keeps
    all that its markup does not rule out.  The large shuffle carries lines, by ranges of (host, path, id, url), so that
    a host with a third of all pages is cut like any other; a small one brings the pages at the ranges' borders together,
    so that the ranges don't show in the result.
    """
    from .common import n_shuffle

    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    parts = n_shuffle(pages.sparkSession)
    bounds = _bounds(pages, parts)
    parsed = pages.mapInArrow(_parse_pages(bounds), _PAGE)
    placed = parsed.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", *_ORDER)
    borders = placed.mapInArrow(_borders, f"{_PAGE}, seq long, guest boolean, fresh boolean")
    borders = borders.repartition(parts, "host").sortWithinPartitions("host", "part", "seq")
    return placed.mapInArrow(_difference, _TEXT).unionByName(borders.mapInArrow(_difference_borders, _TEXT))
