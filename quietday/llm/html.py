"""HTML extraction: boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of its elements with the text runs between them. Each element has
features (its tag, attribute tokens, those of its ancestors, subtree text density, links, place among
siblings and in the page), and boosted trees give the probability that it belongs to the main
text. Decoding takes the likeliest choice in which nothing below a dropped element is kept,
by dynamic programming over the tree.

The trees are trained here, on pages that `training_pages` composes from a fixed seed.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietday.llm import boosting
from quietday.llm.common import bounded, small_batches, text_or_empty
from quietday.llm.html_training import training_pages

# Element names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th"
    " thead tr ul".split()
)
#: Elements whose text belongs to the block around them, if the trees keep it.
INLINE = frozenset("noscript canvas audio video svg".split())
#: Elements without markup inside whose text a page doesn't show.
HIDDEN = frozenset("script style textarea template iframe title noembed noframes".split())
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption option optgroup legend summary button".split())
SAME_LEVEL = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
TAG_KINDS = {
    "p": 0, "h1": 1, "h2": 1, "h3": 1, "h4": 1, "h5": 1, "h6": 1, "hgroup": 1, "li": 2, "dt": 2, "dd": 2, "ul": 3, "ol": 3, "dl": 3, "menu": 3,
    "div": 4, "center": 4, "section": 5, "article": 6, "main": 6, "nav": 7, "search": 7, "header": 8, "footer": 9, "address": 9, "aside": 10, "dialog": 10,
    "form": 11, "fieldset": 11, "button": 11, "select": 11, "option": 11, "legend": 11, "table": 12, "tr": 12, "td": 12, "th": 12, "tbody": 12, "thead": 12,
    "tfoot": 12, "caption": 12, "pre": 13, "blockquote": 13, "figure": 14, "figcaption": 14, "body": 15, "html": 15,
    "noscript": 16, "canvas": 16, "audio": 16, "video": 16, "svg": 16,
}
KINDS = 18
# Words in class, id and role attributes, by what they speak of.
TOKENS = {
    "advert": "ad ads adv advert advertisement adsense adslot banner sponsor sponsored promo promotion promoted partner",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc toolbar tabs skip links topics tags tag categories",
    "reply": "comment comments reply replies respond discussion disqus responses feedback thread reviews",
    "notice": "cookie cookies consent notice notices gdpr banner popup modal overlay alert alertdialog warning paywall disclaimer privacy message",
    "form": "form search subscribe subscription newsletter signup login register contact input",
    "side": "aside sidebar side widget widgets related recommended recommendations more popular trending rail complementary secondary teaser teasers",
    "foot": "footer foot copyright colophon legal bottom contentinfo sitemap",
    "head": "header head masthead topbar logo brand site banner top",
    "share": "share sharing social follow facebook twitter author byline meta timestamp date print",
    "main": "article content post entry main story body text maincontent page prose article-body markdown entry-content",
}
WORDS = {w: i for i, ws in reversed(list(enumerate(TOKENS.values()))) for w in ws.split()}

# A tag ends at the first > outside quoted values; where a page has no such end, at the first > of any kind. No part
# is tried twice, so the time is in proportion to the page.
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>")
_LAX_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)([^>]*+)>")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in (*HIDDEN, "xmp")}
_ATTR = re.compile(r"(?:^|[\s\"'])(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_KEEP = re.compile(r"\bdata-keep\b")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


class Page:
    """The elements of one page in document order, and its text runs as (element, text, link characters, block).

    Runs with one block number stand in one block, however many elements share it.
    """

    __slots__ = ("tags", "attrs", "parents", "runs", "_stack", "_open", "_parts", "_linked", "_block", "_link")

    def __init__(self, source: str):
        self.tags: list[str] = ["html"]
        self.attrs: list[str] = [""]
        self.parents: list[int] = [-1]
        self.runs: list[tuple[int, str, int, int]] = []
        self._stack = [0]  # open elements
        self._open: dict[str, list[int]] = defaultdict(list)  # their places in the stack by name
        self._parts: list[str] = []
        self._linked = self._block = 0
        self._link = False
        self._parse(source)

    def _text(self, piece: str) -> None:
        self._parts.append(piece)
        if self._link:
            self._linked += len(piece)

    def _end_run(self) -> None:
        if self._parts:
            text = entities.unescape("".join(self._parts))
            if text:
                self.runs.append((self._stack[-1], text, self._linked, self._block))
            self._parts, self._linked = [], 0

    def _end_block(self) -> None:
        self._end_run()
        self._block += 1
        self._link = False

    def _push(self, name: str, attrs: str) -> None:
        self.tags.append(name)
        self.attrs.append(attrs)
        self.parents.append(self._stack[-1])
        self._open[name].append(len(self._stack))
        self._stack.append(len(self.tags) - 1)

    def _top(self) -> str:
        return self.tags[self._stack[-1]]

    def _pop(self) -> None:
        self._open[self.tags[self._stack.pop()]].pop()

    def _close(self, names: Iterable[str], stop: Iterable[str] = ()) -> None:
        """Closes the nearest open element of `names` and all in it, if none of `stop` is nearer."""
        nearest = lambda kinds: max((self._open[k][-1] for k in kinds if self._open[k]), default=0)
        at = nearest(names)
        if at > nearest(stop):
            while len(self._stack) > at:
                self._pop()

    def _parse(self, source: str) -> None:
        at = look = 0
        pattern = _TAG
        while True:
            lt = source.find("<", look)
            if lt < 0:
                self._text(source[at:])
                break
            sign = source[lt + 1 : lt + 2]
            after = source[lt + 2 : lt + 3] if sign == "/" else sign
            named = after.isascii() and after.isalpha()
            if not named and sign not in ("/", "!", "?"):
                look = lt + 1
                continue
            if lt > at:
                self._text(source[at:lt])
            if not named:
                if source.startswith("<!--", lt):
                    end = lt + 4 if source.startswith((">", "->"), lt + 4) else source.find("-->", lt + 4)
                else:
                    end = source.find(">", lt + 2)
                if end < 0:
                    break
                at = look = source.index(">", end) + 1
                continue
            m = pattern.match(source, lt)
            if not m:  # the page ends inside a tag or an open quote
                pattern = _LAX_TAG
                m = pattern.match(source, lt)
                if not m:
                    break
            at = look = m.end()
            name = m[1].lower()
            if name in _RAW_END:
                if sign == "/":
                    continue
                tail = _RAW_END[name].search(source, at)
                if name == "xmp":
                    self._end_block()
                    self._text(source[at : tail.start() if tail else len(source)].replace("&", "&amp;"))
                    self._end_block()
                end = source.find(">", tail.end()) if tail else -1
                if end < 0:
                    break
                at = look = end + 1
            elif sign == "/":
                self._end_tag(name)
            else:
                self._start_tag(name, m[2])
        self._end_block()

    def _end_tag(self, name: str) -> None:
        if name == "a":
            self._link = False
        elif name == "br":
            self._text(" ")
        elif name in INLINE:
            self._end_run()
            self._close([name], BLOCKS)
        elif name in BLOCKS and name not in ("html", "body"):
            self._end_block()
            self._close([name], ["table"] if name in ("p", "li", "div") else ())

    def _start_tag(self, name: str, attrs: str) -> None:
        if name == "a":
            self._link = True
        elif name == "br":
            self._text(" ")
        elif name in INLINE:
            self._end_run()
            self._push(name, attrs)
        elif name in ("html", "body", "hr"):
            self._end_block()
            if name == "body":
                self.attrs[0] += " " + attrs
        elif name in BLOCKS:
            self._end_block()
            if name in CLOSES_P and self._top() == "p":
                self._pop()
            if name in SAME_LEVEL:
                while self._top() == "p":
                    self._pop()
                self._close(*SAME_LEVEL[name])
            if name in ("tr", "tbody", "thead", "tfoot"):
                while self._top() in SAME_LEVEL[name][0]:
                    self._pop()
            self._push(name, attrs)


def _tokens(attrs: str) -> np.ndarray:
    out = np.zeros(len(TOKENS))
    if "=" in attrs:
        for m in _ATTR.finditer(attrs):
            for w in _WORD.findall(_CAMEL.sub(" ", m[1] or m[2] or m[3] or "").lower()):
                if (i := WORDS.get(w)) is not None:
                    out[i] += 1
    return out


def features(page: Page) -> np.ndarray:
    """A row for each block element."""
    n = len(page.tags)
    parents = page.parents
    own = {"chars": np.zeros(n), "links": np.zeros(n), "words": np.zeros(n), "stops": np.zeros(n), "runs": np.zeros(n), "tags": np.ones(n), "ps": np.zeros(n)}
    before, total = np.zeros(n), 0
    first_run = {}
    for node, text, linked, _ in page.runs:
        text = text.strip()
        if not text:
            continue
        first_run.setdefault(node, total)
        size = len(text)
        own["chars"][node] += size
        own["links"][node] += min(linked, size)
        own["words"][node] += text.count(" ") + 1
        own["stops"][node] += text.count(".") + text.count(",") + text.count("?") + text.count("!")
        own["runs"][node] += 1
        total += size
    direct = own["chars"].copy()
    kinds = np.array([TAG_KINDS.get(t, KINDS - 1) for t in page.tags])
    own["ps"] = (kinds == 0).astype(float)
    last = np.zeros(n)
    for node in range(n):
        last[node] = first_run.get(node, -1)
    start = last.copy()
    depth = np.zeros(n)
    tokens = np.array([_tokens(a) for a in page.attrs])
    above = np.zeros((n, len(TOKENS)))
    inside = np.zeros((n, 6))  # under nav, header, footer, aside, form, article/main
    marks = {7: 0, 8: 1, 9: 2, 10: 3, 11: 4, 6: 5}
    index, siblings = np.zeros(n), np.zeros(n)
    same = np.zeros(n)
    children: list[list[int]] = [[] for _ in range(n)]
    for v in range(1, n):
        p = parents[v]
        depth[v] = depth[p] + 1
        above[v] = above[p] + tokens[p]
        inside[v] = inside[p]
        if (k := marks.get(int(kinds[p]))) is not None:
            inside[v, k] = 1
        index[v] = len(children[p])
        children[p].append(v)
    for p in range(n):
        ch = children[p]
        for v in ch:
            siblings[v] = len(ch)
        if ch:
            tags = Counter(page.tags[v] for v in ch)
            for v in ch:
                same[v] = tags[page.tags[v]] / len(ch)
    for v in range(n - 1, 0, -1):
        p = parents[v]
        for x in own.values():
            x[p] += x[v]
        if start[v] >= 0 and (start[p] < 0 or start[v] < start[p]):
            start[p] = start[v]
    before = np.where(start < 0, 0, start) / max(total, 1)
    up = np.maximum(np.array(parents), 0)
    chars = own["chars"]
    logs = np.log1p
    cols = [
        logs(chars), logs(direct), own["links"] / np.maximum(chars, 1), own["words"] / np.maximum(chars, 1), own["stops"] / np.maximum(own["words"], 1),
        logs(own["tags"]), chars / own["tags"], logs(own["ps"]), logs(own["runs"]), chars / max(total, 1), before, depth, index, siblings, same,
        logs(chars[up]), chars / np.maximum(chars[up], 1), own["links"][up] / np.maximum(chars[up], 1), logs(own["ps"][up]),
    ]
    one_hot = kinds[:, None] == np.arange(KINDS)[None, :]
    parent_hot = (kinds[up][:, None] == np.arange(KINDS)[None, :]) & (np.arange(n) > 0)[:, None]
    return np.concatenate([np.stack(cols, 1), np.minimum(tokens, 3), np.minimum(above, 3), inside, one_hot, parent_hot], 1)


def decode(page: Page, p: np.ndarray) -> list[bool]:
    """Which elements to keep: the likeliest choice in which nothing below a dropped element is kept."""
    n = len(page.tags)
    keep, drop = np.log(p + 1e-9), np.log(1 - p + 1e-9)
    below = drop.copy()  # all of the subtree dropped
    gain = keep.copy()
    for v in range(n - 1, 0, -1):
        parent = page.parents[v]
        below[parent] += below[v]
        gain[parent] += max(gain[v], below[v])
    out = [True] * n
    for v in range(1, n):
        out[v] = out[page.parents[v]] and bool(gain[v] >= below[v])
    return out


def labels(page: Page) -> np.ndarray:
    """1 for marked elements of a training page and the elements around them."""
    y = np.array([1.0 if _KEEP.search(a) else 0.0 for a in page.attrs])
    for v in range(len(y) - 1, 0, -1):
        y[page.parents[v]] = max(y[page.parents[v]], y[v])
    y[0] = 1.0
    return y


_models: list[boosting.Trees] = []


def model() -> boosting.Trees:
    """Trained once in a process; the same in all, as pages and fit are deterministic."""
    if not _models:
        pages = [Page(x) for x in training_pages()]
        _models.append(boosting.train(np.concatenate([features(p) for p in pages]), np.concatenate([labels(p) for p in pages])))
    return _models[0]


def kept_text(page: Page, keep: list[bool]) -> str:
    """The kept runs in page order: those of a block with white space as one space, blocks joined by one line feed."""
    blocks: dict[int, list[str]] = {}
    for node, text, _, block in page.runs:
        if keep[node]:
            blocks.setdefault(block, []).append(text)
    lines = (_SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(sources: list[str], trees: boosting.Trees) -> list[str]:
    """The main text of each page."""
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    rows = [features(p) for p in pages]
    p, at, out = trees.predict(np.concatenate(rows)), 0, []
    for page, row in zip(pages, rows, strict=True):
        out.append(kept_text(page, decode(page, p[at : at + len(row)])))
        at += len(row)
    return out


def main_text(pages: DataFrame, trees: boosting.Trees | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars (its code points).

    Null or empty html has an empty text. White space inside a block is one space, a line break too;
    character references are decoded; blocks are joined by one line feed. Nothing else is dropped
    or cut. Unclosed elements end where HTML ends them; a page may end anywhere, and a tag that it ends in is no
    text. Elements nest to any depth, and the time is in proportion to the page's length. Repeated rows
    give repeated rows; an empty table gives none; other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(trees or model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2):
            texts = extract(batch.column(2).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
