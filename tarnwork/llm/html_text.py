"""Main text of web pages by nearest-URL page differencing.

Every page is cut into lines, one per block of text, in page order. Within
each host, pages are ordered by URL path and each is paired with the nearer of
its two neighbours. The lines of the pair are aligned by a longest common
subsequence, and lines that both share are deleted.

Differencing alone gives wrong results where menus and adverts are filled anew
for each page, and where articles themselves recur on pages beside each other.
So two kinds of lines are decided by markup: what stands in elements that
declare themselves as menus, headers, footers, sidebars, notices, adverts,
forms or comments is never text, and what stands in the page's article elements
is not deleted. Differencing decides all other lines; where that would leave
nothing of a page (the neighbour is a copy), it does not count.

A form, or an element whose class or id names a menu, an advert and the like,
may also be what a page is wrapped in. It counts as text if no article or main
part is outside of such elements and it holds ``HOLDS_PAGE`` of the page's text.
Names count as whole words of a class; inside an article only where the class
says nothing else, and never on paragraphs, headings and the like. A header in
the article or main part of a page belongs to it.

Parsing takes one pass over a page, whatever is broken in it, and an alignment
takes memory in proportion to the lines. Only line hashes of a neighbour meet a
page, and hosts are cut into ranges of paths, so a hot host is many tasks.

Defined cases: null html counts as empty, an empty page has an empty text; a
null or odd url is a host of its own name; the nearer of two neighbours shares
more leading segments of its path, then has a number of segments closer to the
page's, then comes before; ties of the path go by page_id, then url; repeated
rows are neighbours of each other; a page alone on its host has no neighbour; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import collections
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import deal

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("html body option optgroup".split())
SAME_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
# Elements and names that declare what is not the article.
NEVER = frozenset("head script style noscript template svg iframe object canvas audio video nav footer aside button select textarea input dialog menu".split())
OUTSIDE_ONLY = frozenset(["header"])
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
#: Parts of a class or id that name what is no text, words that go with them, and beginnings of such parts.
NAMES = frozenset(
    "ad ads adsense banner banners cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay newsletter newsletters subscribe subscription signup login "
    "sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs toolbar topbar masthead footer comment comments respond replies disqus "
    "share sharing social related recommended pagination pager skiplink".split()
)
WITH_NAMES = frozenset(
    "box bar block list link links button buttons icon icons section area container wrapper wrap inner outer form post posts article articles story stories item items title heading header top bottom left right main site page slot unit panel media reader thread clearfix row col".split()
)
BEGINNINGS = ("advert", "sponsor", "promo")
#: Of those, what names what readers wrote: it holds the page only where there is no other text.
READERS = re.compile(r"comment|respond|replies|disqus", re.I)
#: Elements of running text, which no name inside an article makes an advert or a menu.
TEXT_ELEMENTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td th dd dt figcaption".split())
#: Share of a page's text from which an element that is named or a form holds the page, if nothing outside such elements is called the article.
HOLDS_PAGE = 0.8
#: What an article element itself has to be called to be no article, and what is a header outside of one.
NOT_THE_ARTICLE = re.compile(r"(?:^|\s)(?:comments?|comment-\S+|reader-comments?|teaser|related|recommended|ads?|advert\S*|promo\S*|sponsored)(?:$|\s)", re.I)
HEADER_NAMES = re.compile(r"(?:^|\s)(?:header|site-?header|page-?header|masthead|top|brand|logo|copyright|legal|imprint)(?:$|\s)", re.I)
MAIN_NAMES = re.compile(r"(?:^|\s)(?:main|content|main-content|article|article-body|post|post-content|entry|entry-content|story|page-content)(?:$|\s)", re.I)
#: Elements whose content is no markup.
RAW = {name: re.compile(rf"</{name}\s*+>", re.I) for name in "script style textarea title noscript iframe template svg".split()}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: What is left of a tag: quotes hold a value only after an equals sign, and only where they are closed.
REST = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+")
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _named(token: str) -> tuple[bool, bool]:
    """Whether a class or id names what is no text, and whether it says nothing else."""
    parts = token.lower().replace("side-bar", "sidebar").replace("skip-link", "skiplink").replace("_", "-").split("-")
    names = [x in NAMES or x.startswith(BEGINNINGS) for x in parts]
    whole = all(n or x in WITH_NAMES or x.isdigit() or not x for n, x in zip(names, parts, strict=True))
    return any(names) and whole, whole


def _declares(name: str, attributes: str, around: int) -> tuple[bool, bool, int]:
    """Whether an element is no text, whether it is none unless it holds the page, and how much it is the article: 2 article, 1 main, 0 neither.

    around is how much of the article the element stands in.
    """
    if name in NEVER or (name in OUTSIDE_ONLY and not around):
        return True, False, 0
    soft = name == "form"
    rank = 2 if name == "article" else 1 if name == "main" else 0
    if attributes and name not in ("html", "body"):
        found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)}
        style, role = found.get("style", "").replace(" ", "").lower(), found.get("role", "").lower()
        if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style or role in ROLES:
            return True, False, 0
        names = f"{found.get('class', '')} {found.get('id', '')}"
        if rank:
            soft |= bool(NOT_THE_ARTICLE.search(names))
        elif around < 2:
            soft |= any(_named(x)[0] for x in names.split()) or (not around and bool(HEADER_NAMES.search(names)))
        elif name not in TEXT_ELEMENTS:
            said = [_named(x) for x in names.split()]
            soft |= any(x for x, _ in said) and all(x for _, x in said)
        if not rank and (role == "main" or found.get("itemprop") == "articleBody" or MAIN_NAMES.search(names)):
            rank = 1
        soft |= role == "form"
    return False, soft, 0 if soft else rank


def _closed(attributes: str) -> bool:
    """Whether a tag closes itself: a slash after white space or a quote; after an unquoted value it is the value's."""
    return attributes.endswith("/") and (len(attributes) == 1 or attributes[-2] in " \t\n\f\r\"'")


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, attributes): text with the text as name, open and close tags; comments, declarations and raw content are left out.

    Each character is looked at a bounded number of times: what is never closed goes on to the end of the page.
    """
    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at:
            yield "text", page[at:start], ""
        if start == n:
            return
        following = page[start + 1 : start + 2]
        if following in ("!", "?"):
            closing = "-->" if page.startswith("<!--", start) else ">"
            end = page.find(closing, start + 2)
            at = n if end < 0 else end + len(closing)
            continue
        m = TAG.match(page, start)
        if not m:
            if following == "/":
                end = page.find(">", start)
                at = n if end < 0 else end + 1
            else:
                yield "text", "<", ""
                at = start + 1
            continue
        end = REST.match(page, m.end()).end()
        if end >= n:
            return
        attributes, at = page[m.end() : end], end + 1
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
        elif name in RAW:
            if name == "textarea":
                yield "text", " ", ""
            if not _closed(attributes):
                closed = RAW[name].search(page, at)
                at = closed.end() if closed else n
        else:
            yield "open", name, attributes


def lines_of(page: str) -> list[tuple[str, bool, int, int]]:
    """The lines of a page: text, whether it can be text of the article, rank and number of the element that may be the article."""
    out: list[tuple[str, bool, int, int, int]] = []
    # open elements: name, not text, rank, number of the element the rank comes from, the nearest element around that may be no text
    stack: list[tuple[str, bool, int, int, int]] = [("", False, 0, 0, 0)]
    above, needs = [0], [0.0]
    held: collections.Counter[str] = collections.Counter()
    parts: list[str] = []
    numbered = 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                _, never, rank, number, inside = stack[-1]
                out.append((text, not never, rank, number, inside))
            parts.clear()

    def cut(i: int) -> None:
        for s in stack[i:]:
            held[s[0]] -= 1
        del stack[i:]

    def pop(names: tuple[str, ...], until: frozenset) -> None:
        if not any(held[x] for x in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                flush()
                cut(i)
                return
            if stack[i][0] in until:
                return

    scope = frozenset("table td th ul ol dl button body html".split())
    for kind, name, attributes in _tokens(page):
        if kind == "text":
            parts.append(name)
            continue
        if kind == "close":
            if name in VOID:
                continue
            if not held[name]:
                if name in BLOCKS:
                    flush()
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    if name in BLOCKS or any(s[0] in BLOCKS for s in stack[i:]) or stack[i][1] != stack[i - 1][1] or stack[i][4] != stack[i - 1][4]:
                        flush()
                    cut(i)
                    break
            continue
        if name in BLOCKS:
            flush()
        if name in CLOSES_P:
            pop(("p",), scope if stack[-1][0] == "p" else scope | BLOCKS - {"p"})
        if name in SAME_KIND and name != "p":
            pop(SAME_KIND[name], scope - {"td", "th"} if name in ("tr", "td", "th") else scope)
        if name in VOID:
            if name in ("br", "hr", "img"):
                parts.append(" ")
            continue
        _, never, rank, number, inside = stack[-1]
        own_never, own_soft, own_rank = (True, False, 0) if never else _declares(name, attributes, rank)
        if own_soft or (own_never and not never):
            flush()
        if own_rank > rank:
            numbered += 1
            rank, number = own_rank, numbered
        if own_soft:
            needs.append(1.0 if READERS.search(attributes) else HOLDS_PAGE)
            above.append(inside)
            inside = len(above) - 1
        if not _closed(attributes):
            stack.append((name, own_never, rank, number, inside))
            held[name] += 1
    flush()
    gone = _no_text(out, above, needs)
    return [(text, may and not gone[inside], rank, number) for text, may, rank, number, inside in out]


def _no_text(lines: list[tuple[str, bool, int, int, int]], above: list[int], needs: list[float]) -> list[bool]:
    """Whether lines in each of the elements that are no text unless they hold the page are none; above has the element around each, 0 is no element, needs the share of the text to hold.

    All are none if the article or main part of the page is outside of them;
    else those that hold most of the page's text are let go, from the outside
    in, until it is.
    """
    size, ranked = [0] * len(above), set()
    for text, may, rank, _, inside in lines:
        if may:
            size[inside] += len(text)
            ranked |= {inside} if rank else set()
    for i in range(len(above) - 1, 0, -1):
        size[above[i]] += size[i]
    gone, outside = [False] * len(above), 0 in ranked
    for i in range(1, len(above)):
        gone[i] = gone[above[i]] or outside or not size[0] or size[i] < needs[i] * size[0]
        outside |= not gone[i] and i in ranked
    return gone


def candidates(lines: list[tuple[str, bool, int, int]]) -> list[tuple[bool, bool]]:
    """Of each line whether it may be text, and whether it is for sure: it stands in an article."""
    return [(may, may and rank == 2) for _, may, rank, _ in lines]


def _states(x: list[int], y: list[int]) -> Iterator[int]:
    """After each element of x, the bits of y's places at which the length of the common subsequence does not grow."""
    places: dict[int, int] = {}
    for j, v in enumerate(y):
        places[v] = places.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    state = full
    for v in x:
        u = state & places.get(v, 0)
        state = ((state + u) | (state - u)) & full
        yield state


#: Bits of states that an alignment holds at once; beyond, it is halved first.
STATE_BITS = 64_000_000


def _lengths(x: list[int], y: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of x and the first j of y, for each j."""
    state = (1 << len(y)) - 1
    for state in _states(x, y):
        pass
    bits = np.unpackbits(np.frombuffer(state.to_bytes(len(y) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(y)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _aligned(x: list[int], y: list[int]) -> list[bool]:
    """Which elements of x are in a longest common subsequence of x and y."""
    if len(x) > 1 and len(x) * len(y) > STATE_BITS:
        half = len(x) // 2
        left, right = _lengths(x[:half], y), _lengths(x[half:][::-1], y[::-1])[::-1]
        at = int(np.argmax(left + right))
        return _aligned(x[:half], y[:at]) + _aligned(x[half:], y[at:])
    shared = [False] * len(x)
    full = (1 << len(y)) - 1
    states = list(_states(x, y))
    # zero bits of a state mark where the length grows; walk back from the end
    top, need = len(y), (~states[-1] & full).bit_count() if x else 0
    for i in range(len(x) - 1, -1, -1):
        if not need:
            break
        before = ~(states[i - 1] if i else full) & ((1 << top) - 1)
        if before.bit_count() == need:
            continue
        # x[i] takes the last place at which the length grows to need
        shared[i] = True
        top = (~states[i] & ((1 << top) - 1)).bit_length() - 1
        need -= 1
    return shared


def common_lines(a: list[int], b: list[int]) -> list[bool]:
    """Which of a's lines are in a longest common subsequence of a and b, in memory in proportion to both."""
    n, m = len(a), len(b)
    head = 0
    while head < n and head < m and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < n - head and tail < m - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    both = set(a[head : n - tail]) & set(b[head : m - tail])
    # what only one side has cannot be shared
    at = [i for i in range(head, n - tail) if a[i] in both]
    shared = [True] * head + [False] * (n - head - tail) + [True] * tail
    for i, kept in zip(at, _aligned([a[i] for i in at], [v for v in b[head : m - tail] if v in both]), strict=True):
        shared[i] = kept
    return shared


def main_text(kept: list[str], sure: list[bool], hashes: list[int], marks: list[int], near: list[int] | None) -> str:
    """The text of a page: kept are its possible lines, sure those of articles, marks their places among all lines, near the neighbour's lines."""
    if near is None or all(sure):
        return "\n\n".join(kept)
    shared = common_lines(hashes, near)
    left = [t for t, ok, i in zip(kept, sure, marks, strict=True) if ok or not shared[i]]
    return "\n\n".join(left or kept)


URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)"


def _parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, kept, sure, hashes, marks of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("kept", "sure", "hashes", "marks")}
            for page in batch.column(2):
                lines = lines_of(page.as_py() or "")
                found = candidates(lines)
                out["kept"].append([x[0] for x, (may, _) in zip(lines, found, strict=True) if may])
                out["sure"].append([sure for may, sure in found if may])
                out["hashes"].append(np.array([xxhash.xxh3_64_intdigest(x[0].encode("utf-8", "surrogatepass")) for x in lines], dtype=np.uint64).view(np.int64))
                out["marks"].append([i for i, (may, _) in enumerate(found) if may])
            kinds = {"kept": pa.list_(pa.string()), "sure": pa.list_(pa.bool_()), "hashes": pa.list_(pa.int64()), "marks": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, kinds[k]) for k, v in out.items())], ["page_id", "url", *out])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, kept array<string>, sure array<boolean>, hashes array<long>, marks array<int>")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of each page of (page_id, url, html)."""
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, URL, 1))
    path = F.regexp_replace(F.regexp_extract(url, URL, 2), r"(?:/|\.html?)$", "")
    # host, path, id: text that orders pages as wanted
    key = F.concat(host, F.lit("\x01"), path, F.lit("\x01"), F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0"), F.lit("\x01"), url)
    keyed = _parsed(pages).withColumn("key", key)
    dealt = deal(keyed, "key", keys=pages.select(F.col("page_id").cast("long").alias("page_id"), "url").select(key.alias("key")))
    order = Window.partitionBy("block").orderBy("guest", "key")
    part = lambda c, i: F.get(F.split(c, "\x01"), F.lit(i))
    around = dealt.select("*", *[f(c).over(order).alias(f"{n}_{c}") for n, f in (("before", F.lag), ("after", F.lead)) for c in ("key", "hashes")])
    same = lambda n: part(F.col(f"{n}_key"), 0) == part(F.col("key"), 0)
    segments = lambda c: F.split(part(c, 1), "/")

    def far(n: str) -> Column:
        """Smaller is nearer: segments that the paths do not share at their start, then the difference of their numbers."""
        own, other = segments(F.col("key")), segments(F.col(f"{n}_key"))
        run = F.aggregate(F.zip_with(own, other, lambda x, y: x.eqNullSafe(y)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")), lambda s, same: F.struct((s["n"] + (s["open"] & same).cast("int")).alias("n"), (s["open"] & same).alias("open")))
        return F.struct(-run["n"], F.abs(F.size(own) - F.size(other)))

    near = (
        F.when(F.coalesce(same("before"), F.lit(False)) & F.coalesce(same("after"), F.lit(False)), F.when(far("before") <= far("after"), F.col("before_hashes")).otherwise(F.col("after_hashes")))
        .when(same("before"), F.col("before_hashes"))
        .when(same("after"), F.col("after_hashes"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True)
            texts = [main_text(kept, sure, hashes, marks, other) for kept, sure, hashes, marks, other in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    paired = around.where("guest = 0").select("page_id", "url", "kept", "sure", "hashes", "marks", near.alias("near"))
    return paired.mapInArrow(run, "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the main text of every page."""
    from .common import table

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
