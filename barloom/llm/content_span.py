"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of text runs and tags. Words score positive, tags negative, with weights learned
from labelled pages (those that mark their one main region); one linear scan finds
the contiguous stretch with the largest sum. Elements whose name, class, id or role speaks against content (menus,
adverts, comments and so on) are not cut out: their words stand in the sequence with a lower score, the lower the
stronger the names, and words whose score is not positive give no text. So one such name on a wrapper
takes nothing away where it is only a modifier (``has-sidebar``, ``notice-board``). Only scripts, styles, the head and the like are
passed over unread.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.samples import smallest

#: Bound of the labelled pages that the weights are counted on.
FIT_PAGES = 2000

#: Fixed lists: elements that mark the main region, that hold raw text, that have no end, that stay inside a line.
REGION = frozenset(("article", "main"))
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt",
                    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label"))
#: Elements that a new one of the same list ends, up to the list that holds them.
ITEMS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
#: Score that a word gets on top where an element of this name is open.
STRONG, WEAK = -3.0, -0.6
ELEMENTS = dict.fromkeys(("head", "nav", "footer", "header", "aside", "menu", "dialog", "form", "button", "select", "object", "canvas", "audio", "video"), STRONG)
#: Of these a main region inside is free: they cannot hold one, so they are unclosed or wrap the page.
WRAPS = frozenset(("head", "nav", "header", "footer", "form", "menu"))
#: Parts of class, id and role names of what is no content; a name counts by its last telling part.
MARKS = frozenset(("ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent",
                   "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "share", "sharing", "social", "related",
                   "recommended", "recommendations", "sidebar", "widget", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "comment",
                   "comments", "reply", "replies", "respond", "disqus", "footer", "header", "masthead", "toolbar", "login", "signup", "search", "complementary", "contentinfo"))
#: Marks that count wherever they stand in a name.
ANYWHERE = frozenset(("advert", "advertisement", "sponsored", "cookie", "cookies", "consent", "newsletter", "related", "recommended", "comment", "comments", "disqus"))
#: Parts that tell where or how a thing is, not what it is; what follows the second list is not the thing itself.
PLACES = frozenset(("list", "area", "section", "box", "wrap", "wrapper", "container", "block", "item", "items", "body", "content", "text", "title", "form", "slot", "unit", "links", "link", "left",
                    "right", "top", "bottom", "primary", "secondary", "main", "inner", "outer", "bar", "panel", "col", "column", "row", "thread", "level", "sticky", "fixed", "holder", "group"))
WITH = frozenset(("has", "with", "no", "without", "show", "hide", "is"))
#: Parts that make a header one of the article.
OWN = frozenset(("article", "entry", "post", "content", "story", "page"))
NEVER_MARKED = frozenset(("html", "body", "main", "h1", "h2", "h3", "h4", "h5", "h6"))

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""([a-z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


@dataclass(frozen=True)
class Weights:
    """Score of a word, of tags by name (closing tags with a slash; ``unseen`` for others), and of class names that the labelled pages told of."""

    word: float = 1.0
    tags: dict[str, float] = field(default_factory=dict)
    names: dict[str, float] = field(default_factory=dict)
    unseen: float = -0.6

    def of(self, tag: str) -> float:
        return self.tags.get(tag, self.unseen)


@functools.lru_cache(maxsize=20_000)
def mark_of(name: str) -> float:
    """How much one class, id or role name speaks against content: STRONG, WEAK where a mark is only a modifier, or 0."""
    parts = [p for p in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", name).lower()) if p]
    cut = next((i for i, p in enumerate(parts) if p in WITH), len(parts))
    parts = parts[:cut]
    if not MARKS.intersection(parts):
        return 0.0
    if parts[-1] == "header" and OWN.intersection(parts[:-1]) - {"page"}:
        return 0.0
    telling = [p for p in parts if p not in PLACES] or parts
    return STRONG if telling[-1] in MARKS or ANYWHERE.intersection(parts) else WEAK


@dataclass(frozen=True)
class Item:
    """A run of text, or a tag (``/name`` closes): ``mark`` is what the open elements add to the score of a word, ``region`` whether a main one is open."""

    kind: str
    value: str
    mark: float = 0.0
    region: bool = False
    names: tuple[str, ...] = ()


def names_of(attrs: str) -> tuple[tuple[str, ...], bool]:
    """Class, id and role names, and whether the element is hidden."""
    names: list[str] = []
    hidden = False
    for key, value in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role"):
            names += value.split()
        hidden |= key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.lower().replace(" ", "")
    return tuple(names), hidden


def tags_of(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', run, ''), ('raw', name, '') and ('tag', name or /name, attributes) by one forward scan.

    A tag that does not end, a comment or a raw element without an end reach to the end of the page, so nothing is scanned twice.
    """
    at, text, size = 0, 0, len(page)
    while True:
        start = page.find("<", at)
        if start < 0:
            break
        mark = page[start + 1:start + 2]
        m = NAME.match(page, start + 1)
        if not m and mark not in ("!", "?", "/"):
            at = start + 1
            continue
        if start > text:
            yield "text", page[text:start], ""
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = text = size if end < 0 else end + 3
        elif not m:
            end = page.find(">", start)
            at = text = size if end < 0 else end + 1
        else:
            end = m.end()
            while (stop := STOP.search(page, end)) and stop[0] != ">":
                close = page.find(stop[0], stop.end())
                end = stop.end() if close < 0 else close + 1
                if close < 0:
                    # a quote that does not end is an ordinary character, and so are those of its kind after it
                    stop = page.find(">", end)
                    end = size if stop < 0 else stop
            at = text = size if stop is None else (stop.end() if not isinstance(stop, int) else stop + 1)
            name = m[0].lower()
            if stop is not None:
                yield "tag", name, page[m.end():at - 1]
                if name in RAW:
                    end_tag = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                    at = text = end_tag.end() if end_tag else size
        if at >= size:
            break
    if text < size:
        yield "text", page[text:], ""


def parts(page: str | None, learned: dict[str, float] | None = None) -> list[Item]:
    """The page as items in order, each with the marks of the elements it lies in."""
    learned = learned or {}
    out: list[Item] = []
    # name, names, and what holds outside of the element: its mark, whether a region is open, whether a mark is of more than a wrapper
    opened: list[tuple[str, tuple[str, ...], float, bool, bool]] = []
    count: Counter = Counter()
    mark, region, firm = 0.0, False, False

    def close() -> str:
        nonlocal mark, region, firm
        name, _, mark, region, firm = opened.pop()
        count[name] -= 1
        return name

    for kind, name, attrs in tags_of(page or ""):
        if kind == "text":
            out.append(Item("text", name, mark, region, opened[-1][1] if opened else ()))
            continue
        if name in RAW or name.lstrip("/") in RAW:
            continue
        if name[0] == "/":
            inner = mark
            if count[name[1:]] > 0:
                while close() != name[1:]:
                    inner = mark
            out.append(Item("tag", name, min(inner, mark), region))
            continue
        # ends that the page leaves out
        if opened and opened[-1][0] == "p" and name not in INLINE and name != "br":
            close()
        if name in ITEMS and count[name] > 0:
            for i in range(len(opened) - 1, max(-1, len(opened) - 9), -1):
                if opened[i][0] in ITEMS[name]:
                    break
                if opened[i][0] == name:
                    while len(opened) > i:
                        close()
                    break
        if name == "body" and count["head"] > 0:
            while close() != "head":
                pass
        names, hidden = names_of(attrs) if attrs else ((), False)
        own = 0.0
        if hidden:
            own = 2 * STRONG
        elif name not in NEVER_MARKED:
            own = min([0.0, *[min(mark_of(n), learned.get(n, 0.0)) for n in names]])
        own_firm = own < 0 or name in ELEMENTS and name not in WRAPS
        if name in ELEMENTS and not (name == "header" and region):
            own = min(own, ELEMENTS[name])
        outside = mark, region, firm
        if name in REGION and own == 0 and not firm:
            mark = 0.0
        mark += own
        out.append(Item("tag", name, mark, region, names))
        if name in VOID or attrs.endswith("/"):
            mark = outside[0]
        else:
            opened.append((name, names, *outside))
            count[name] += 1
            region, firm = region or name in REGION and mark == 0, firm or own_firm
    return out


def scores(items: list[Item], weights: Weights) -> list[float]:
    """Words by the weight and their marks; tags by name. What is marked inside a main region costs nothing: it is left out there."""
    out = []
    for i in items:
        if i.kind == "text":
            word = weights.word + i.mark
            out.append(0.0 if i.region and word <= 0 else len(i.value.split()) * word)
        else:
            out.append(0.0 if i.mark <= STRONG and i.region else weights.of(i.value))
    return out


def best_run(values: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the largest positive sum; the first and longest such run. Empty if there is none."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, v in enumerate(values):
        if total <= 0:
            total, start = 0.0, i
        total += v
        if total > best:
            best, best_at = total, (start, i + 1)
    return best_at


def main_text(page: str | None, weights: Weights) -> str:
    """Text of the best region; blocks and runs of white space become one space."""
    items = parts(page, weights.names)
    start, end = best_run(scores(items, weights))
    run = []
    for i in items[start:end]:
        if i.kind == "text" and weights.word + i.mark > 0:
            run.append(html.unescape(i.value))
        elif i.kind == "text" or i.value.lstrip("/") not in INLINE:
            run.append(" ")
    return " ".join("".join(run).split())


def tally(page: str | None) -> Counter:
    """Counts of words and tags inside and outside the main region, and of words below each class name; none if the page does not mark exactly one region.

    Tags in marked elements tell nothing: their marks do.
    """
    items = parts(page)
    opens = [i for i, x in enumerate(items) if x.kind == "tag" and x.value in REGION and x.mark == 0]
    if len(opens) != 1:
        return Counter()
    start = opens[0]
    end = next((i for i in range(start, len(items)) if items[i].value == f"/{items[start].value}" and items[i].kind == "tag"), None)
    if end is None:
        return Counter()
    out: Counter = Counter()
    for i, x in enumerate(items):
        inside = start < i < end
        n = len(x.value.split()) if x.kind == "text" else 1
        if x.kind == "text":
            for name in x.names:
                out[(f".{name}", inside)] += n
        if x.mark == 0:
            out[("" if x.kind == "text" else x.value, inside)] += n
    return out


def weights_of(counts: dict[tuple[str, bool], int]) -> Weights:
    """Log odds of lying inside, words held above and tags below zero; class names that hold words outside only lower these."""
    def odds(tag: str) -> float:
        return float(np.log((counts.get((tag, True), 0) + 1) / (counts.get((tag, False), 0) + 1)))

    if not counts:
        return Weights()
    most = lambda t: 6.0 if t.lstrip("/") in REGION else 3.0
    tags = {t: -float(np.clip(0.6 - 0.1 * odds(t) if odds(t) > 0 else 0.6 - 2 * odds(t), 0.02, most(t))) for t, _ in counts if t and t[0] != "."}
    names = {t[1:]: max(STRONG, 0.5 * odds(t)) for t, _ in counts if t[:1] == "." and odds(t) < -3}
    return Weights(float(np.clip(odds(""), 1.0, 1.5)), tags, names)


def trained(pages: DataFrame, key: str = "page_id", page: str = "html", fit_pages: int = FIT_PAGES) -> Weights:
    """Weights counted on at most ``fit_pages`` pages, those with the smallest hashes of the key."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for value in b.column(0):
                total.update(tally(value.as_py()))
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()),
                                          pa.array([total[k] for k in keys], pa.int64())], names=["tag", "inside", "n"])

    sample = smallest(pages.select(key, page), F.col(key), fit_pages).select(page)
    rows = sample.mapInArrow(count, "tag string, inside boolean, n long").groupBy("tag", "inside").agg(F.sum("n").alias("n")).collect()
    return weights_of({(r["tag"], r["inside"]): r["n"] for r in rows})


def text_of(page: Column, weights: Weights) -> Column:
    @F.arrow_udf("string")
    def content_text(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py(), weights) for p in pages], pa.string())

    return content_text(page)


def extracted(pages: DataFrame, weights: Weights, page: str = "html", text: str = "text") -> DataFrame:
    """``pages`` without the html, with the main ``text`` ('' if there is none, or the html is null).

    Rows are judged alone: no shuffle, whole pages; an empty table gives an empty one.
    """
    return pages.select(*[c for c in pages.columns if c not in (page, text)], text_of(F.col(page), weights).alias(text))
