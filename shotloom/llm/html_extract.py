"""Main text of web pages as the maximum-scoring run of their tokens.

Every word of a page scores by where it stands: the learned weights of the elements around it, of the words in their
class, id and role, and of the share of its block that is links; every tag scores below zero. One linear scan finds the
run of tokens with the largest sum. Inside it, blocks whose words score below zero (a notice or an advert amid the
article) are left out. Weights come from labelled pages (``html_pages``) by logistic regression when a session starts.

Defined cases: a null or empty page, one without words and one whose words all score below zero have the empty text;
markup that isn't closed is closed where its parent ends or the page does; character references are decoded once,
after markup is found; scripts, styles, titles, templates, forms' choices, comments and unclosed markup of these kinds to
the page's end never are text; a line break element is white space; repeated rows give a row each; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_pages import labelled_page

PAGES, EPOCHS = 500, 400
#: A tag's score; a word's is its log odds of being content, within LIMIT of zero.
TAG_SCORE, LIMIT = -0.02, 6.0
#: What words that score below zero count for, so that the run can pass an advert amid the article.
ISLAND = 0.02
# fixed values: elements by kind, of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template svg math iframe object select option datalist noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("article aside body div footer form header main nav ol section table td th ul blockquote".split())
_P_CLOSERS = _SCOPE - {"td", "th", "body"} | frozenset("h1 h2 h3 h4 h5 h6 hr pre p dl figure figcaption address details".split())

_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")


def _features(tag: str, attrs: str) -> tuple[str, ...]:
    """The element's name, and the words of its class, id and role; those of short marks are kept, as pages repeat them."""
    return _kept_features(tag, attrs) if len(attrs) < 200 else _read_features(tag, attrs)


def _read_features(tag: str, attrs: str) -> tuple[str, ...]:
    out = [f"<{tag}>"]
    for m in _ATTR.finditer(attrs):
        out += [f".{w}" for w in _NAME.findall((m[2] or m[3] or m[4] or "").lower())]
    return tuple(dict.fromkeys(out))


_kept_features = lru_cache(maxsize=4096)(_read_features)


class Block:
    """Text between block-level tags: its parts, the tags before it, and what stands around it: facts, or their score."""

    __slots__ = ("around", "link_words", "parts", "score", "tags", "words")

    def __init__(self, around: tuple, score: float, tags: int):
        self.parts, self.around, self.score, self.tags, self.words, self.link_words = [], around, score, tags, 0, 0


class _Next:
    """Where a pattern comes next, for positions that only rise: text without it is passed once."""

    def __init__(self, pattern: str, page: str):
        self.find, self.page, self.since, self.found = re.compile(pattern).search, page, 0, -1

    def __call__(self, at: int) -> int:
        if not self.since <= at <= self.found:
            m = self.find(self.page, at)
            self.since, self.found = at, m.start() if m else len(self.page)
        return self.found


class _Cursor:
    """Marks of a page from left to right, in time that is linear in its length."""

    def __init__(self, page: str):
        self.page, self.n = page, len(page)
        self.open, self.close, self.name_end, self.special = (_Next(x, page) for x in ("<", ">", r"[\s/>]", "[>\"']"))
        self.last = {q: page.rfind(q) for q in "\"'"}
        self.hopeless: set[int] = set()  # quotes outside of quotes after which no mark ends

    def _end(self, at: int) -> int:
        """Where the > is that ends a mark, outside of quotes; -1 if there is none."""
        seen = []
        while (at := self.special(at)) < self.n and at not in self.hopeless:
            quote = self.page[at]
            if quote == ">":
                return at
            seen.append(at)
            if self.last[quote] <= at:
                break
            at = self.page.find(quote, at + 1) + 1
        self.hopeless.update(seen)
        return -1

    def mark(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, "/" or "", element, attributes) of the next mark; comments and declarations have no element."""
        page, n = self.page, self.n
        while (at := self.open(at)) < n:
            after = page[at + 1 : at + 2]
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, end + 3 if end >= 0 else n, "", "", ""
            slash = "/" if after == "/" else ""
            first = page[at + 2 : at + 3] if slash else after
            if after in ("!", "?") and after:
                end = self.close(at)
                if end < n:
                    return at, end + 1, "", "", ""
            elif first.isascii() and first.isalpha():
                begin = at + 1 + len(slash)
                stop = self.name_end(begin)
                if self.close(stop) < n:
                    end = self._end(stop)
                    end = end if end >= 0 else self.close(stop)
                    return at, end + 1, slash, page[begin:stop].lower(), page[stop:end]
            at += 1
        return None


class _Open:
    """The open elements, where each kind of them stands, and the facts that they add; push and pop cost what they add."""

    def __init__(self, learned: dict[str, float] | None):
        self.learned, self.elements, self.facts, self.places = learned, [], set(), {}
        self.kinds, self.lists = {"block": [], "scope": [], "scope but cells": []}, {}

    def push(self, tag: str, attrs: str) -> None:
        new = [f for f in _features(tag, attrs) if f not in self.facts]
        self.facts.update(new)
        score = self.score + (sum(self.learned.get(f, 0.0) for f in new) if self.learned else 0.0)
        for place in self._lists(tag):
            place.append(len(self.elements))
        self.elements.append((tag, new, score))

    def _lists(self, tag: str) -> list[list[int]]:
        """The lists of places that an element stands in."""
        if tag not in self.lists:
            of = [self.places.setdefault(tag, [])]
            of += [self.kinds["block"]] * (tag not in INLINE) + [self.kinds["scope"]] * (tag in _SCOPE)
            self.lists[tag] = of + [self.kinds["scope but cells"]] * (tag in _SCOPE and tag not in ("td", "th"))
        return self.lists[tag]

    @property
    def score(self) -> float:
        return self.elements[-1][2] if self.elements else 0.0

    def pop_to(self, k: int) -> None:
        while len(self.elements) > k:
            tag, new, _ = self.elements.pop()
            self.facts.difference_update(new)
            for place in self._lists(tag):
                place.pop()

    def last(self, tag: str) -> int:
        return places[-1] if (places := self.places.get(tag)) else -1

    def kind(self, name: str) -> int:
        return self.kinds[name][-1] if self.kinds[name] else -1

    def close(self, tag: str) -> None:
        """An inline element is closed only inside the block that it stands in."""
        k = self.last(tag)
        if k >= 0 and (tag not in INLINE or k > self.kind("block")):
            self.pop_to(k)

    def shut_before(self, tag: str) -> None:
        """Close what the opening of an element closes, within the scope it stands in."""
        shut = CLOSES.get(tag, set()) | ({"p"} if tag in _P_CLOSERS else set())
        k = max((self.last(t) for t in shut), default=-1)
        if k >= 0 and k >= self.kind("scope but cells" if tag == "tr" else "scope"):
            self.pop_to(k)


def blocks_of(page: str, learned: dict[str, float] | None = None) -> list[Block]:
    """The page's text blocks in order, with the score of what stands around each; without ``learned``, with its facts."""
    cursor, open_, out = _Cursor(page), _Open(learned), []
    now: Block | None = None
    tags, at, n = 0, 0, len(page)
    lower = None

    def put(text: str) -> None:
        nonlocal now, tags
        if not text:
            return
        if now is None:
            if text.isspace():
                return
            now = Block(() if learned is not None else tuple(open_.facts), open_.score, tags)
            tags = 0
            out.append(now)
        now.parts.append(text)
        if open_.last("a") >= 0:
            now.link_words += len(text.split())

    while at < n:
        m = cursor.mark(at)
        if m is None:
            rest = page[at:]
            cut = re.search(r"<[a-zA-Z/!]", rest)
            put(rest[: cut.start()] if cut else rest)
            break
        start, end, closing, tag, attrs = m
        put(page[at:start])
        at = end
        if not tag:
            continue
        if not closing and tag in RAW and not attrs.endswith("/"):
            lower = page.lower() if lower is None else lower
            lower = lower if len(lower) == n else re.sub("[A-Z]", lambda x: x[0].lower(), page)
            end = lower.find(f"</{tag}", at)
            stop = page.find(">", end) if end >= 0 else -1
            at = stop + 1 if stop >= 0 else n
            if tag not in ("svg", "math"):
                now = None
            tags += 1
            continue
        tags += 1
        if tag == "br":
            put(" ") if now is not None else None
            continue
        if tag not in INLINE:
            now = None
        if tag in VOID:
            continue
        if closing:
            open_.close(tag)
            continue
        open_.shut_before(tag)
        if not attrs.endswith("/"):
            open_.push(tag, attrs)
    for b in out:
        b.parts = [" ".join(_html.unescape("".join(b.parts)).split())]
        b.words = len(b.parts[0].split())
    return [b for b in out if b.words]


def _own_facts(block: Block) -> list[str]:
    """What a block's words are judged by beside the elements around it."""
    share = block.link_words / max(1, block.words)
    return [*(["linked"] if share > 0.5 else ["part linked"] if share > 0.2 else []), "any"]


@lru_cache(maxsize=1)
def weights(pages: int = PAGES, epochs: int = EPOCHS) -> dict[str, float]:
    """Log odds of content for every fact, learned from labelled pages."""
    rows, y = [], []
    for seed in range(pages):
        page = labelled_page(seed)
        marked = "".join(h + (t if t is not None else "") for h, t, _ in page)
        truth: dict[str, bool] = {t: c for _, t, c in page if t is not None}
        for b in blocks_of(marked):
            if b.parts[0] in truth:
                rows.append([*b.around, *_own_facts(b)])
                y.append(truth[b.parts[0]])
    names = {f: k for k, f in enumerate(sorted({f for r in rows for f in r}))}
    x = np.zeros((len(rows), len(names)))
    for k, r in enumerate(rows):
        x[k, [names[f] for f in r]] = 1
    w, target, pull = np.zeros(len(names)), np.array(y, float), 1e-5
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, epochs + 1):
        g = x.T @ (1 / (1 + np.exp(-x @ w)) - target) / len(x) + pull * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return {f: float(w[k]) for f, k in names.items()}


def best_run(scores: list[float]) -> tuple[int, int]:
    """(first, end) of the run with the largest sum, the shortest from its start on; empty if none is above zero."""
    best = total = 0.0
    region, start = (0, 0), 0
    for k, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += x
        if total > best:
            best, region = total, (start, k + 1)
    return region


def extract(page: str | None, learned: dict[str, float]) -> str:
    """The main text of one page."""
    found = blocks_of(page, learned) if page else []
    scores, runs = [], []
    for b in found:
        score = max(-LIMIT, min(LIMIT, b.score + sum(learned.get(f, 0.0) for f in _own_facts(b))))
        scores.append(score)
        # a block's tags, then its words
        runs += [TAG_SCORE * b.tags, score * b.words * (1 if score > 0 else ISLAND)]
    first, end = best_run(runs)
    return "\n".join(b.parts[0] for b, s in zip(found[first // 2 : (end + 1) // 2], scores[first // 2 : (end + 1) // 2], strict=True) if s > 0)


def extract_pages(pages: DataFrame, *carry: str) -> DataFrame:
    """The carried columns and ``text``, the main text, of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(weights())
    rows = pages.select(F.col("html").cast("string").alias("html"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"))

    def run(batches):
        for batch in batches:
            text = [extract(h.as_py(), shared.value) for h in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(text, pa.string())], names=["row", "text"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string").select("row.*", "text")
