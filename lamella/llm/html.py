"""Main text of web pages as a maximum-scoring run of words and tags.

A page is scanned into blocks of text. A block's words score the log-odds that they are content, a logistic model over
the elements around them: tag names, class names and the words in these, whether an article stands around or beside
them, how much of them is links. Tags score below zero. Words whose log-odds are negative are boilerplate and drop out
with their tags; over what is left, one linear scan finds the contiguous run with the largest sum. All weights come
from the labelled pages in ``lamella.llm.layouts``.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm import layouts
from lamella.llm.common import slices

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)(?=(?:[^"']|"[^"]*"|'[^']*')*$)""")

# Fixed values of HTML: elements by what a reader sees of them.
#: Elements whose content isn't text to a reader; it ends at their own end tag only.
RAW = frozenset("script style noscript template title textarea iframe svg annotation object canvas select option xmp noembed noframes audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end the running block of text when they start and when they end.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Open items that a start tag ends, and the lists that they end in.
ITEMS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",)}
#: Elements that hold content and boilerplate alike: their names say nothing.
PLAIN = frozenset("html body div section span p ul ol li a table tbody thead tfoot tr td th dl dd dt center".split())

#: Words of a class name that make it tell how a page is laid out, and those that make a header the content's own.
LAYOUT_WORDS = frozenset("with has no layout without".split())
CONTENT_WORDS = frozenset("article post entry content story".split())


@dataclass(slots=True)
class Block:
    text: str
    tags: list[str]  # block tags met since the last block
    words: int
    score: float  # log-odds of one of its words
    features: frozenset[str] | None = None  # kept only where no weights are given


def features(tag: str, attrs: str, inside: bool) -> list[str]:
    """What an element is known by: its tag, class names, ids, roles and labels, and the words of these. The page's own
    elements, and names that only tell a layout (``with-sidebar``), say nothing about their content. A header inside an
    article is another thing than a page's."""
    header = "inner-header" if inside else "header"
    found = [] if tag in PLAIN else [header if tag == "header" else tag]
    if tag in ("html", "body"):
        return []
    for name, value in _ATTR.findall(attrs) if "=" in attrs else ():
        name = name.lower()
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            for one in html.unescape(value.strip("\"'")).split():
                words = [p.lower() for p in _PART.findall(one)]
                if not words or LAYOUT_WORDS & set(words):
                    continue
                if "header" in words and CONTENT_WORDS & set(words):
                    words = ["content", "header"]
                elif words == ["header"]:
                    words = [header]
                found.append("." + "-".join(words))
                found += [f"~{w}" for w in words]
        elif name == "aria-hidden" and "true" in value.lower():
            found.append("hidden")
    if _HIDDEN.search(attrs) or "display:none" in attrs.replace(" ", "").lower():
        found.append("hidden")
    return found


class _Scan:
    """One pass over a page. Each open element keeps only its own features; what all of them weigh together is carried
    along, every feature once, so deep nesting costs no more than its length."""

    def __init__(self, weights: dict[str, float] | None):
        self.w = weights
        self.out: list[Block] = []
        self.around: list[tuple[bool, int, bool]] = []  # by block: inside an article, heading under an inner header, mostly links
        self.stack: list[tuple[str, list[str], float]] = []
        self.opened: Counter[str] = Counter()
        self.active: Counter[str] = Counter()
        self.total = 0.0
        self.buffer: list[str] = []
        self.tags: list[str] = []
        self.linked = self.links = self.frames = 0
        self.framed = False

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer.clear()
        if text:
            heading = any(self.opened[h] > 0 for h in HEADING)
            inside = self.frames > 0
            linked = not inside and not heading and self.linked > 0.6 * len(text)
            own = frozenset(self.active) if self.w is None else None
            self.out.append(Block(text, self.tags, text.count(" ") + 1, self.total, own))
            self.around.append((inside, heading, linked))
            if heading and self.w and self.active.get("inner-header"):
                self.out[-1].score -= self.w.get("inner-header", 0.0)
            self.tags = []
        self.linked = 0

    def push(self, name: str, attrs: str) -> None:
        own = features(name, attrs, self.frames > 0)
        self.stack.append((name, own, self.total))
        self.opened[name] += 1
        for f in own:
            self.active[f] += 1
            if self.w is not None and self.active[f] == 1:
                self.total += self.w.get(f, 0.0)
            if f in FRAMES:
                self.frames += 1
                self.framed = True

    def close(self, i: int) -> None:
        for name, own, _ in reversed(self.stack[i:]):
            self.opened[name] -= 1
            for f in own:
                self.active[f] -= 1
                if not self.active[f]:
                    del self.active[f]
                self.frames -= f in FRAMES
        self.total = self.stack[i][2]
        del self.stack[i:]

    def finish(self) -> list[Block]:
        """Blocks with what only the whole page tells: whether an article stands beside them."""
        for b, (inside, heading, linked) in zip(self.out, self.around):
            more = [f for f, on in (("inside", inside), ("beside", self.framed and not inside), ("heading", heading), ("linked", linked), ("prose", b.words >= 8)) if on]
            if self.w is None:
                own = b.features - {"inner-header"} if heading else b.features
                b.features = frozenset((*own, *more, "any"))
            else:
                b.score += self.w.get("any", 0.0) + sum(self.w.get(f, 0.0) for f in more)
        return self.out


#: What an article's own text stands in.
FRAMES = frozenset(("article", "main", ".main", ".article", ".article-body"))


def blocks(page: str, weights: dict[str, float] | None = None) -> list[Block]:
    """All blocks of a page in order, by a forgiving scan: unclosed and stray tags do no harm."""
    s = _Scan(weights)
    endless: set[str] = set()  # raw elements that no end tag follows
    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            text = html.unescape(text)
            s.buffer.append(text)
            s.linked += len(text) if s.links else 0
        if not m:
            break
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        closing = bool(m[1])
        if name in RAW and not closing:
            if not m[3].rstrip().endswith("/") and name not in endless:
                e = re.compile(rf"</{re.escape(name)}\s*[^<>]*>", re.I).search(page, at)
                if not e:
                    endless.add(name)
                at = e.end() if e else (end if name in ("script", "style", "template", "svg") else at)
            continue
        if name in ("td", "th") or name == "br":
            s.buffer.append(" ")
        if name == "a":
            s.links = 0 if closing else 1
        if name in BLOCK:
            s.flush()
            s.links = 0
            if name not in ("html", "body"):
                s.tags.append(name)
        if name in VOID:
            continue
        if closing:
            if s.opened[name] > 0:
                s.close(next(i for i in range(len(s.stack) - 1, -1, -1) if s.stack[i][0] == name))
            continue
        if name in BLOCK and s.stack and s.stack[-1][0] == "p":
            s.close(len(s.stack) - 1)
        if name in ITEMS and (s.opened[name] > 0 or (name in ("dt", "dd") and s.opened["dt"] + s.opened["dd"] > 0)):
            for i in range(len(s.stack) - 1, -1, -1):
                if s.stack[i][0] in ITEMS[name]:
                    break
                if s.stack[i][0] == name or {s.stack[i][0], name} == {"dt", "dd"}:
                    s.close(i)
                    break
        if (name in BLOCK or "=" in m[3] or "hidden" in m[3] or name in ("button", "label")) and not m[3].rstrip().endswith("/"):
            s.push(name, m[3])
    s.flush()
    return s.finish()


# ---- weights ----------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def weights() -> dict[str, float]:
    """``learned`` from all labelled pages."""
    return learned(layouts.pages())


def learned(pages: Sequence[tuple[str, str]], ridge: float = 0.1, steps: int = 25) -> dict[str, float]:
    """Weights from (page, mark) pairs; words of the content begin with the mark. Of features: a logistic model fitted
    by Newton's method to all words, under a ridge. Of a tag, as "<tag": minus the logarithm of 1 + how much more often
    it comes for a word of boilerplate than for a word of content; never above zero."""
    rows: Counter[tuple[frozenset[str], bool]] = Counter()
    tags: dict[bool, Counter[str]] = {True: Counter(), False: Counter()}
    for page, mark in pages:
        for b in blocks(page):
            good = b.text.startswith(mark)
            rows[b.features, good] += b.words
            tags[good].update(b.tags)
    names = sorted({f for own, _ in rows for f in own})
    at = {f: i for i, f in enumerate(names)}
    x, y, n = np.zeros((len(rows), len(names))), np.zeros(len(rows)), np.zeros(len(rows))
    for i, ((own, good), count) in enumerate(rows.items()):
        x[i, [at[f] for f in own]] = 1
        y[i], n[i] = good, count
    w = np.zeros(len(names))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(names)), x.T @ (n * (y - p)) - ridge * w)
        w += step
        if abs(step).max() < 1e-6:
            break
    out = dict(zip(names, w.tolist()))
    total = {good: sum(c for (_, g), c in rows.items() if g == good) for good in (True, False)}
    for t in {*tags[True], *tags[False]}:
        rate = {good: (tags[good][t] + 0.5) / (total[good] + 1) for good in (True, False)}
        out["<" + t] = -TAG_SHARE * math.log1p(rate[False] / rate[True])
    return out


#: How much a tag's weight counts beside a word's.
TAG_SHARE = 0.1


def values(found: Sequence[Block], w: dict[str, float]) -> list[float]:
    """What each block adds to a run: its words' log-odds and its tags' weights. Of c tags of one name between two blocks
    1 + log c count, so that mere nesting doesn't part them."""
    return [b.words * b.score + sum(w.get("<" + t, 0.0) * (1 + math.log(c)) for t, c in Counter(b.tags).items()) for b in found]


def best_run(scores: Sequence[float]) -> tuple[int, int]:
    """(start, end) of the contiguous run with the largest sum, the earliest and shortest of equals; (0, 0) if no sum
    is positive. One pass."""
    best, run, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, run = total, (start, i + 1)
    return run


def main_text(page: str | None, w: dict[str, float] | None = None) -> str:
    """The page's main text: blocks joined by two newlines; empty without any."""
    w = weights() if w is None else w
    found = [b for b in blocks(page, w) if b.score > 0] if page else []
    start, end = best_run(values(found, w))
    return "\n\n".join(b.text for b in found[start:end])


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per row: the id, url, text (main text of the whole page, empty if there is none or the page is null) and n_chars
    (its code points). Ids and urls may be null or repeat: each row has its own result. Broken markup is read as far
    as it goes. A very long or deeply nested page takes memory in proportion to its length. Of equally good runs the
    earliest is taken. An empty table gives an empty result. Other columns are ignored."""
    w = weights()

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([main_text(t, w) for part in slices(a) for t in part], pa.string())

    out = pages.select(F.col(page_id), F.col(url), run(F.col(page)).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))
