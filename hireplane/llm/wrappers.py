"""Main text of web pages by union-free wrapper inference.

Pages of one host are token streams: block tags and text slots (inline tags are
part of the text). Within a page, groups of tokens that repeat side by side
become one repeated group. Streams of a host are then aligned one after the
other with the wrapper so far: equal tokens stay, texts that differ become open
slots, tokens that only one side has become optional groups, and an optional
group like the one before it makes that one repeated. All pages take part:
streams of one structure are added up first, in the tasks and after a shuffle by
host and structure; the different ones are aligned in the order of their
digests in two steps (host and salt, then host). So no host's pages meet in one
task, and the wrapper does not depend on the order or the files of the pages.

Marks are votes of a slot. A slot counts its pages, those that fill it inside an
article (``article``, ``main`` or their roles), those that fill it in navigation,
page headers, footers, asides, forms, notices, adverts and comments, known by
tag, role, class or id (whole names, and compounds of known words only), and
those that fill it with link text; it keeps its text while all pages agree. A
slot is main if no more pages fill it beside their article than in it (pages that
mark no article do not vote on this), and dropped if at least half of its pages
say so. Slots of unlike marks are aligned only where nothing of their own kind
fits, and those of an article never with dropped ones.

Each page is matched with its host's wrapper and all its blocks are read by
their slots. A block that finds none goes the way that most of the host's blocks
with its mark go. Pages without main text keep their other blocks, without
slots of link text and without fixed slots: neither optional nor repeated, with
one text on all of at least ``ALIKE`` pages. A host on which nothing varies has
no fixed slots.

Blocks keep the page's order, one per line; references are decoded, runs of
white space are one blank. Formulas are text. A quote opens an attribute value
only after an equals sign. Null or empty html gives an empty text; so do pages
without kept text. Null urls form one host. Repeated pages are separate rows.
Unclosed tags end with the block or container around them, unclosed comments
and scripts with the page. Beyond ``ALIGN_CELLS`` an alignment is cut at keys that
both streams have once, so it may match fewer tokens; what it leaves goes by marks.
"""

from __future__ import annotations

import hashlib
import html as html_module
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hireplane.llm import batches as B
from hireplane.llm.components import stored

ALIKE = 3
SALTS = 32
BROADCAST_CHARS = 16_000_000
ALIGN_CELLS = 1 << 18
ALIGN_PART = 256

#: Attributes up to the end of a tag: a quote opens a value only after an equals sign.
ATTRIBUTES = r"""(?:[^>=/]++|/=?+|=++\s*+(?:"[^"]*+"|'[^']*+'|[^>\s]*+)(?:\s*+=)?+)*+"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({ATTRIBUTES})>|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "title", "select", "object", "canvas", "annotation", "annotation-xml"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br",
    "math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "mstyle", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup",
    "munder", "mover", "munderover", "mtable", "mtr", "mtd", "mpadded", "mphantom",
}
CONTAINERS = {
    "html", "head", "body", "nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "ul", "ol", "dl", "table",
    "menu", "dialog", "figure", "blockquote", "button", "fieldset", "details",
}
MAIN_TAGS = {"article", "main"}
DROPPED_TAGS = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "button"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu"}
DROPPED_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "consent", "cookie", "cookies", "discussion", "disqus", "footer", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "popup", "promo", "promotion", "related", "replies", "respond", "share", "sharing", "sidebar",
    "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Words that may stand beside a dropped word in one class or id; with any other word the name is not a mark.
BESIDE = {
    "area", "article", "articles", "author", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container",
    "content", "fixed", "form", "global", "group", "heading", "icons", "inner", "item", "items", "left", "link", "links", "list", "main",
    "media", "mobile", "news", "outer", "page", "panel", "post", "posts", "primary", "reader", "right", "row", "secondary", "section", "site",
    "slot", "sticky", "stories", "story", "text", "title", "top", "unit", "user", "wrap", "wrapper", "zone",
}


@lru_cache(maxsize=100_000)
def _name(token: str) -> str:
    return re.split(r"[.@]", token, maxsplit=1)[0]


@lru_cache(maxsize=100_000)
def _role(token: str) -> str:
    """What an element is by its token (tag, names of class and id, role): main, header, dropped or empty."""
    name, (marks, _, role) = _name(token), token.partition("@")
    words: set[str] = set()
    for mark in marks.split(".")[1:]:
        parts = set(mark.split("-"))
        if parts <= DROPPED_WORDS | BESIDE | {"header"}:
            words |= parts
    if name in ("html", "body"):
        return ""
    if name in MAIN_TAGS or role in MAIN_TAGS:
        return "main"
    if name == "header" or "header" in words:
        return "header"
    return "dropped" if name in DROPPED_TAGS or role in DROPPED_ROLES or words & DROPPED_WORDS else ""


def step(stack: list[str], token: str) -> None:
    """Open or close containers. A close tag ends everything back to its open tag, a body ends the head."""
    if token[0] == "/":
        for i in range(len(stack) - 1, -1, -1):
            if _name(stack[i]) == token[1:]:
                del stack[i:]
                return
        return
    if token.startswith("body"):
        stack[:] = [x for x in stack if _name(x) != "head"]
    if _name(token) in CONTAINERS or _role(token):
        stack.append(token)


@lru_cache(maxsize=100_000)
def judged(path: tuple[str, ...]) -> str:
    """What a slot at this path of containers holds: main, dropped or other."""
    inside = False
    for token in path:
        role = _role(token)
        if role == "dropped" or role == "header" and not inside:
            return "dropped"
        inside |= role == "main"
    return "main" if inside else "other"


class Page:
    """Blocks (text, mark) and token stream of one page; marks are main, dropped, beside (an article) and other (no article)."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str]] = []
        self.tokens: list[list] = []
        self._stack: list[str] = []
        self._text: list[str] = []
        self._linked, self._in_link = 0, 0
        self._read(source)
        if any(mark == "main" for _, mark in self.blocks):
            self.blocks = [(text, "beside" if mark == "other" else mark) for text, mark in self.blocks]
            for token, (_, mark) in zip((t for t in self.tokens if t[0] == "#"), self.blocks):
                token[5] = int(mark == "beside")

    def _flush(self) -> None:
        raw = "".join(self._text)
        self._text = []
        linked, self._linked = self._linked, 0
        text = " ".join(html_module.unescape(raw).split())
        if text:
            path = tuple(self._stack)
            mark = judged(path)
            self.tokens.append(["#", checksum(text), 1, int(mark == "main"), int(mark == "dropped"), 0, int(linked >= 0.8 * len(raw))])
            self.blocks.append((text, mark))

    def _open(self, name: str, attributes: str) -> None:
        self._flush()
        marks = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
        names = sorted({"-".join(re.findall("[a-z]+", w)) for w in f"{marks.get('class', '')} {marks.get('id', '')}".split()} - {""})
        token = name + "".join("." + w for w in names) + ("@" + marks["role"] if marks.get("role") else "")
        self.tokens.append(["t", token])
        step(self._stack, token)

    def _close(self, name: str) -> None:
        self._flush()
        step(self._stack, "/" + name)
        if name not in ("p", "li", "dt", "dd", "td", "th", "tr", "option"):
            self.tokens.append(["t", "/" + name])

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            m = TOKEN.match(source, at)
            if m is None:  # a lone "<" that opens a tag never closed
                at += 1
                continue
            at = m.end()
            closing, name, attributes, text = m.groups()
            if text is not None:
                self._text.append(text)
                self._linked += len(text) if self._in_link else 0
            elif name:
                name = name.lower()
                if name in RAW and not closing:
                    if not attributes.endswith("/"):
                        stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
                        at = stop.end() if stop else end
                    self._text.append(" ")
                elif name in RAW:
                    pass
                elif name in INLINE:
                    if name == "a":
                        self._in_link = 0 if closing else 1
                    elif name == "br":
                        self._text.append(" ")
                elif closing:
                    self._close(name)
                else:
                    self._open(name, attributes)
        self._flush()


def checksum(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


# A wrapper is a list of items: ["t", tag], ["g", repeated, optional, items] and slots ["#", checksum of the text or null if it
# varies, times filled, times in the article, dropped, beside the article, link text, numbers of a page's blocks].
# The last is there while a page is matched only.


def _slot(item: list) -> str:
    """Key of a slot by its votes: main, dropped or neither."""
    if len(item) < 6:
        return "#"
    n, n_main, n_dropped, n_beside = item[2:6]
    return "#+" if n_main and n_main >= n_beside else "#-" if n_dropped and 2 * n_dropped >= n else "#"


def shape(items: list) -> tuple:
    """Structure without texts."""
    return tuple(item[1] if item[0] == "t" else _slot(item) if item[0] == "#" else (item[1], shape(item[3])) for item in items)


def _numbered(items: list) -> np.ndarray:
    """One number per shape of an item."""
    known: dict = {}
    return np.array([known.setdefault(x, len(known)) for x in shape(items)], dtype=np.int32)


def fold_repeats(items: list) -> list:
    """Groups that stand side by side twice or more, as one repeated group; short periods first, of any length.

    Each period is one comparison of the numbered stream with itself, so a stream
    of n items costs n * n / 2 byte-wise steps at most.
    """
    numbers, period = _numbered(items), 1
    while 2 * period <= len(items):
        same = numbers[period:] == numbers[:-period]
        if np.count_nonzero(same) < period:
            period += 1
            continue
        ends = np.append(np.flatnonzero(~same), len(same))
        run = ends[np.searchsorted(ends, np.arange(len(same)))] - np.arange(len(same))
        starts = np.flatnonzero(run >= period).tolist()
        out: list = []
        i = 0
        for at in starts:
            if at < i or period == 1 and items[at][0] == "g":
                continue
            n = 1 + int(run[at]) // period
            group = items[at : at + period]
            for k in range(1, n):
                group = align(group, items[at + k * period : at + (k + 1) * period])
            out += [*items[i:at], ["g", True, False, group]]
            i = at + n * period
        if i:
            items = out + items[i:]
            numbers = _numbered(items)
        period += 1
    return items


def _key(item: list) -> str:
    return item[1] if item[0] == "t" else _slot(item) if item[0] == "#" else "(" + (_key(item[3][0]) if item[3] else "")


def _merged(a: list, b: list) -> list:
    """One slot for two: votes add up, the text stays while it is the same."""
    return ["#", a[1] if a[1] == b[1] else None, *(x + y for x, y in zip(a[2:], b[2:]))]


def _both(a: list, b: list) -> list:
    """One item for two with the same key."""
    if a[0] == "t":
        return a
    return _merged(a, b) if a[0] == "#" else ["g", a[1] or b[1], a[2] or b[2], align(a[3], b[3])]


def added(a: list, b: list) -> list:
    """One stream for two of the same shape, in whatever order they come."""
    return [
        x if x[0] == "t" else _merged(x, y) if x[0] == "#" else ["g", x[1], x[2] or y[2], added(x[3], y[3])] for x, y in zip(a, b)
    ]


def _longest_common(xs: list[str], ys: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; time and memory are the product of the lengths."""
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i in range(len(xs) - 1, -1, -1):
        for j in range(len(ys) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if xs[i] == ys[j] else max(best[i + 1][j], best[i][j + 1])
    pairs = []
    i = j = 0
    while i < len(xs) and j < len(ys):
        if xs[i] == ys[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs


def _anchors(xs: list[str], ys: list[str]) -> list[tuple[int, int]]:
    """Places of keys that either side has once, as many of them as are in the same order on both sides."""
    once = lambda keys: {k for k, n in Counter(keys).items() if n == 1}
    both = once(xs) & once(ys)
    place = {k: j for j, k in enumerate(ys) if k in both}
    tails: list[int] = []
    chains: list[tuple] = []  # the last pair of the best chain of each length, with the chain before it
    for i, k in enumerate(xs):
        if k in both:
            at = bisect_left(tails, place[k])
            link = (i, place[k], chains[at - 1] if at else None)
            if at == len(tails):
                tails.append(place[k])
                chains.append(link)
            else:
                tails[at], chains[at] = place[k], link
    out, link = [], chains[-1] if chains else None
    while link:
        out.append(link[:2])
        link = link[2]
    return out[::-1]


def matched(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a common subsequence of the items' keys, in order; in the gaps, slots without a mark fit any slot."""
    ka, kb = [_key(x) for x in a], [_key(x) for x in b]
    pairs = _common(ka, kb)
    gaps = []
    i = j = 0
    for x, y in [*pairs, (len(a), len(b))]:
        if i < x and j < y:
            # Marked slots meet slots without a mark, not each other: each mark in turn is read as none.
            for mark in ("+", "-"):
                left, right = ([k.replace("#" + mark, "#") for k in keys] for keys in (ka[i:x], kb[j:y]))
                if (left, right) != (ka[i:x], kb[j:y]) and (more := _common(left, right)):
                    gaps += [(i + p, j + q) for p, q in more]
                    break
        i, j = x + 1, y + 1
    return sorted(pairs + gaps)


def _common(ka: list[str], kb: list[str]) -> list[tuple[int, int]]:
    """Places of a common subsequence of two lists of keys, in order.

    It is a longest one up to ``ALIGN_CELLS``. Longer streams are first cut at
    keys that both have once, or else into as many even parts, so that time
    stays near the length of the page.
    """
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(ka), 0, len(kb))]
    while todo:
        x0, x1, y0, y1 = todo.pop()
        while x0 < x1 and y0 < y1 and ka[x0] == kb[y0]:
            pairs.append((x0, y0))
            x0, y0 = x0 + 1, y0 + 1
        while x0 < x1 and y0 < y1 and ka[x1 - 1] == kb[y1 - 1]:
            x1, y1 = x1 - 1, y1 - 1
            pairs.append((x1, y1))
        xs, ys = ka[x0:x1], kb[y0:y1]
        if len(xs) * len(ys) <= ALIGN_CELLS:
            pairs += [(x0 + i, y0 + j) for i, j in _longest_common(xs, ys)] if xs and ys else []
            continue
        cuts = [(x0 + i, y0 + j) for i, j in _anchors(xs, ys)]
        pairs += cuts
        if cuts:
            for (i, j), (k, m) in zip([(x0 - 1, y0 - 1), *cuts], [*cuts, (x1, y1)]):
                todo.append((i + 1, k, j + 1, m))
        else:
            n = -(-max(len(xs), len(ys)) // ALIGN_PART)
            todo += [(x0 + len(xs) * i // n, x0 + len(xs) * (i + 1) // n, y0 + len(ys) * i // n, y0 + len(ys) * (i + 1) // n) for i in range(n)]
    return sorted(pairs)


def align(a: list, b: list) -> list:
    """One wrapper for both streams."""
    out: list = []

    def only(items: list) -> None:
        """Items of one side: an optional group, or a repetition of the group before."""
        at = 0
        while at < len(items) and out and out[-1][0] == "g" and shape(items[at : at + len(out[-1][3])]) == shape(out[-1][3]):
            size = len(out[-1][3])
            out[-1] = ["g", True, out[-1][2], align(out[-1][3], items[at : at + size])]
            at += size
        items = items[at:]
        if len(items) == 1 and items[0][0] == "g":
            out.append(["g", items[0][1], True, items[0][3]])
        elif items:
            out.append(["g", False, True, items])

    i = j = 0
    for x, y in [*matched(a, b), (len(a), len(b))]:
        only(a[i:x])
        only(b[j:y])
        if x < len(a):
            out.append(_both(a[x], b[y]))
        i, j = x + 1, y + 1
    return out


class Slots:
    """A host's wrapper with its slots judged: main, dropped, fixed or other."""

    def __init__(self, wrapper: list, n_pages: int):
        self._n, self._kinds = n_pages, set()
        self._usual: dict[str, Counter] = {mark: Counter() for mark in ("main", "dropped", "beside", "other")}
        self._items = self._judge(wrapper, False, False)
        self._varies = bool(self._kinds & {"main", "other"})

    def _judge(self, items: list, repeated: bool, optional: bool) -> list:
        """Items with the kind of each slot; optional groups that do not repeat are opened."""
        out: list = []
        for item in items:
            if item[0] == "g":
                inner = self._judge(item[3], repeated or item[1], optional or item[2])
                out += [["g", item[1], item[2], inner]] if item[1] else inner
            elif item[0] == "#":
                _, text, n, n_main, n_dropped, n_beside, n_links = item
                alike = text is not None and not (repeated or optional) and n == self._n >= ALIKE
                kind = {"#+": "main", "#-": "dropped"}.get(_slot(item)) or ("links" if 2 * n_links > n else "fixed" if alike else "other")
                self._kinds.add(kind)
                n_other = n - n_main - n_dropped - n_beside
                for mark, votes in (("main", n_main), ("dropped", n_dropped), ("beside", n_beside), ("other", n_other)):
                    self._usual[mark][kind] += votes
                out.append([*item, kind])
            else:
                out.append(item)
        return out

    def usual(self, mark: str) -> str:
        """The kind that most of the host's blocks with this mark have; without any, no kind of its own."""
        votes = {kind: n for kind, n in self._usual[mark].items() if n and kind != "fixed"}
        return max(sorted(votes), key=votes.__getitem__) if votes else "other"

    def of(self, page: Page) -> dict[int, str]:
        """Kind of each block of a page that has a slot in the wrapper, by its number."""
        numbers = iter(range(len(page.blocks)))
        found: dict[int, str] = {}
        self._match(self._items, fold_repeats([[*t, [next(numbers)]] if t[0] == "#" else t for t in page.tokens]), found)
        return found if self._varies else {k: "other" if v == "fixed" else v for k, v in found.items()}

    def _match(self, ours: list, theirs: list, found: dict[int, str]) -> None:
        """Slots to blocks by a common subsequence; what it leaves between is matched again with its groups opened."""
        i = j = 0
        for x, y in [*matched(ours, theirs), (len(ours), len(theirs))]:
            left, right = ours[i:x], theirs[j:y]
            if left and right and any(item[0] == "g" for item in left + right):
                self._match(*[[e for item in side for e in (item[3] if item[0] == "g" else [item])] for side in (left, right)], found)
            if x < len(ours):
                if ours[x][0] == "g":
                    self._match(ours[x][3], theirs[y][3], found)
                elif ours[x][0] == "#":
                    found.update(dict.fromkeys(theirs[y][-1], ours[x][-1]))
            i, j = x + 1, y + 1


def main_text(page: Page, slots: Slots) -> str:
    """Text of a page's main slots, one block per line; without any, that of its other slots."""
    found = slots.of(page)
    kinds = [found.get(k) or slots.usual(mark) for k, (_, mark) in enumerate(page.blocks)]
    wanted = "main" if "main" in kinds else "other"
    return "\n".join(text for (text, _), kind in zip(page.blocks, kinds) if kind == wanted)


PARTIAL = "host string, salt int, digest string, n bigint, wrapper string"


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    host, salt, digest, n, wrapper = (list(c) for c in zip(*rows)) if rows else ([], [], [], [], [])
    return pa.RecordBatch.from_arrays(
        [pa.array(host, pa.string()), pa.array(salt, pa.int32()), pa.array(digest, pa.string()), pa.array(n, pa.int64()), pa.array(wrapper, pa.string())],
        names=["host", "salt", "digest", "n", "wrapper"],
    )


def _fold_pages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch of pages, host and structure: the streams of that structure added up."""
    for piece in B.pieces(batches, "html", 8 << 20):
        known: dict[tuple[str, str], tuple[int, list]] = {}
        for host, source in zip(piece.column("host").to_pylist(), piece.column("html").to_pylist()):
            stream = fold_repeats(Page(source or "").tokens)
            key = host, hashlib.md5(json.dumps(shape(stream)).encode()).hexdigest()
            n, so_far = known.get(key, (0, None))
            known[key] = n + 1, stream if so_far is None else added(so_far, stream)
        yield _pack([(h, int(d[:8], 16) % SALTS, d, n, json.dumps(w)) for (h, d), (n, w) in known.items()])


def _fold_wrappers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host, salt and digest to one row for each host and salt: equal structures added up, the others aligned."""
    key, n, wrapper = None, 0, None
    digest, stream = None, None

    def grown() -> list:
        return stream if wrapper is None else align(wrapper, stream)

    for batch in batches:
        done = []
        for row in batch.to_pylist():
            this, new = (row["host"], row["salt"]), json.loads(row["wrapper"])
            if this == key and row["digest"] == digest:
                stream, n = added(stream, new), n + row["n"]
                continue
            if key is not None:
                wrapper = grown()
                if this != key:
                    done.append((*key, "", n, json.dumps(wrapper)))
                    n, wrapper = 0, None
            key, digest, stream, n = this, row["digest"], new, n + row["n"]
        yield _pack(done)
    if key is not None:
        yield _pack([(*key, "", n, json.dumps(grown()))])


def infer(pages: DataFrame) -> DataFrame:
    """host, n (pages), wrapper from all rows of (host, html)."""
    partial = pages.mapInArrow(_fold_pages, PARTIAL)
    salted = partial.repartition("host", "salt").sortWithinPartitions("host", "salt", "digest").mapInArrow(_fold_wrappers, PARTIAL)
    steps = salted.select("host", F.lit(0).alias("salt"), F.format_string("%02d", "salt").alias("digest"), "n", "wrapper")
    whole = steps.repartition("host").sortWithinPartitions("host", "digest").mapInArrow(_fold_wrappers, PARTIAL)
    return whole.select("host", "n", "wrapper")


def host_of(url: Column) -> Column:
    """The host in lower case; text without a scheme is taken whole up to the first slash."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text. Wrappers go to the tasks by broadcast up to a measured size, by a join on the host beyond it."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    found = stored(infer(rows.select("host", "html")), "wrappers")
    size = found.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    kind = pages.schema[id_col].dataType.simpleString()
    shared = None
    if size <= BROADCAST_CHARS:
        shared = rows.sparkSession.sparkContext.broadcast({r["host"]: (r["n"], r["wrapper"]) for r in found.collect()})
        rows = rows.withColumn("n", F.lit(0).cast("bigint")).withColumn("wrapper", F.lit(None).cast("string"))
    else:
        rows = rows.join(found, "host", "left")
    rows = rows.select("id", "url", "html", "host", "n", "wrapper")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Slots] = {}
        for piece in B.pieces(batches, "html"):
            texts = []
            for host, source, n, wrapper in zip(*(piece.column(c).to_pylist() for c in ("host", "html", "n", "wrapper"))):
                if shared is not None:
                    n, wrapper = shared.value[host]
                if host not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[host] = Slots(json.loads(wrapper), n)
                texts.append(main_text(Page(source or ""), known[host]))
            yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])

    return rows.mapInArrow(run, f"id {kind}, url string, text string").withColumnRenamed("id", id_col)
