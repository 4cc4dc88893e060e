"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of tags and words. Words score positive, tags negative, by weights counted on labelled pages: those
whose markup names their main part (one `article` or `main` element). One linear scan finds the contiguous region with
the greatest sum; its text, without parts that are no article (menus, forms, adverts, comments, ...), is the result.
A part is known by its names. What holds an article or main is no part, whatever its names; comments and elements such
as `nav` are parts whatever their size. On pages without an article or main, class names also stand on wrappers of the
text: there the scores decide between a named part and what lies outside of it.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|title|svg|math|object)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PART = re.compile(r"[a-z]+|[0-9]+")
# Element names of HTML.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup td th time tt u var wbr br".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NAMES = INLINE | VOID | set(
    "address article aside blockquote body button caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head "
    "header hgroup html legend li main menu nav ol optgroup option p picture pre section select summary table tbody tfoot thead tr ul video audio canvas map".split()
)
MAIN = {"article", "main"}
APART = set("nav footer aside button select menu option audio video canvas map head".split())
WRAPPING = set("form dialog fieldset legend".split())  # apart as well, but a page may lie in one
# Words in class, id and role that name a part of a page which is no article.
APART_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted menu nav navbar navigation breadcrumb breadcrumbs sidebar aside widget "
    "widgets footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments commentlist commenting disqus respond reply replies pagination pager search skip toolbar copyright complementary contentinfo dialog alert hidden".split()
)
HEADER_WORDS = {"header", "head", "topbar"}
MOST_WRAPPERS = 8  # of those within each other; named parts further in are parts
COMMENT_WORDS = set("comment comments commentlist commenting disqus respond reply replies".split())
# With one of these a class tells how a part is laid out ("no-sidebar", "ad-free"), not what it is.
LAYOUT_WORDS = set("no non not has with without free less fixed".split())


@dataclass
class Run:
    """A stretch of a page: a tag (words None) or the text between two tags."""

    kind: tuple
    text: str | None = None
    words: int = 0
    apart: bool = False
    breaks: bool = False
    inside: bool = False
    nested: bool = False  # a tag within a part that is apart; the part counts once, by its own tags
    element: int = -1
    outer: int = -1


# How sure the names of an element say that it is no article.
NOT, NAMED, SURE, COMMENTS = range(4)


@dataclass
class Element:
    parent: int
    named: int = NOT
    inside: bool = False
    main: int = -1  # the outermost article or main it lies in, maybe itself
    resets: bool = False  # a main, or an article in no other article (an article in an article is a comment, say)
    in_article: bool = False
    in_comments: bool = False
    holds: bool = False
    apart: bool = False
    open: bool = False  # a named part that the scores may still take for the text


def _settle(elements: list[Element], runs: list[Run]) -> None:
    """Tell the parts that are apart, now that it is known what each element holds, and complete the runs."""
    if any(e.resets and not e.in_comments for e in elements):
        for e in elements:  # an article among comments is one of them; but if it is the only one, it is the article
            e.resets = e.resets and not e.in_comments
    for e in reversed(elements):
        if e.parent >= 0:
            elements[e.parent].holds |= e.holds or e.resets
    bare = not any(e.resets for e in elements)
    for e in elements:
        e.apart = e.named > NOT and not e.holds
        e.open = bare and e.named == NAMED
        if not e.resets and e.parent >= 0:
            e.open &= not elements[e.parent].apart or elements[e.parent].open
            e.apart |= elements[e.parent].apart
    _complete(elements, runs)


def _complete(elements: list[Element], runs: list[Run]) -> None:
    for run in runs:
        if run.kind != ("space",):
            run.apart = run.element >= 0 and elements[run.element].apart
            run.nested = run.outer >= 0 and elements[run.outer].apart
            run.kind = (*run.kind[: 3 if run.kind[0] == "word" else 2], run.apart)


def _opened(elements: list[Element], runs: list[Run], part: int) -> None:
    """Take a named part, and the open ones it lies in, for wrappers."""
    wrappers, e = set(), part
    while e >= 0:
        wrappers.add(e)
        e = elements[e].parent
    for i, e in enumerate(elements):
        if i in wrappers:
            e.apart, e.named = False, NOT
        elif not e.resets and e.parent >= 0:
            e.apart = (e.named > NOT and not e.holds) or elements[e.parent].apart
    _complete(elements, runs)


def _names(name: str, attributes: str, within_main: bool) -> int:
    """What an element's name and attributes say of it."""
    told = SURE if name in APART or (name == "header" and not within_main) else NAMED if name in WRAPPING else NOT
    if not attributes.strip():
        return told
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            told = max(told, SURE)
        if key in ("class", "id", "role") and name not in ("html", "body", "article", "main"):
            for one in value.split():
                parts = set(PART.findall(one))
                if parts & LAYOUT_WORDS:
                    continue
                if parts & COMMENT_WORDS:
                    told = COMMENTS
                elif parts & APART_WORDS or (not within_main and parts & HEADER_WORDS):
                    told = max(told, NAMED)
    return told


def tokens(page: str) -> list[Run]:
    """The runs of a page in order. Contents of scripts, styles and the like, comments and declarations are left out."""
    return _read(page)[1]


def _read(page: str) -> tuple[list[Element], list[Run]]:
    """The elements and runs of a page, in time linear in its length."""
    out: list[Run] = []
    elements: list[Element] = []
    stack: list[tuple[str, int, str]] = []  # name, element, innermost block
    opened: Counter = Counter()  # names on the stack
    position = 0

    def text(value: str) -> None:
        words = len(value.split())
        if words:
            _, element, block = stack[-1] if stack else ("", -1, "")
            kind = ("word", block if block in NAMES else "other", any(n == "a" for n, _, _ in stack[-4:]))
            out.append(Run(kind, value, words, inside=element >= 0 and elements[element].inside, element=element))
        elif value:
            out.append(Run(("space",), value))

    for m in TOKEN.finditer(page):
        if m.start() > position:
            text(page[position : m.start()])
        position = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        element = stack[-1][1] if stack else -1
        outer = element
        if m[2]:
            while opened[name]:  # what was opened since is closed with it
                last, element, _ = stack.pop()
                opened[last] -= 1
                if last == name:
                    outer = elements[element].parent
                    break
        else:
            if name == "p" and stack and stack[-1][0] == "p":
                stack.pop()
                opened["p"] -= 1
                outer = stack[-1][1] if stack else -1
            above = elements[outer] if outer >= 0 else Element(-1)
            element = len(elements)
            told = _names(name, m[4], above.inside)
            elements.append(
                Element(
                    outer,
                    told,
                    above.inside or name in MAIN,
                    element if name in MAIN and above.main < 0 else above.main,
                    name == "main" or (name == "article" and not above.in_article),
                    above.in_article or name == "article",
                    above.in_comments or told == COMMENTS,
                )
            )
            if name not in VOID and not m[0].endswith("/>"):
                stack.append((name, element, name if name not in INLINE else stack[-1][2] if stack else ""))
                opened[name] += 1
        inside = element >= 0 and elements[element].inside
        out.append(Run(("tag", name if name in NAMES else "other"), None, 0, False, name not in INLINE, inside, False, element, outer))
    if position < len(page):
        text(page[position:])
    _settle(elements, out)
    return elements, out


@dataclass(frozen=True)
class Weights:
    """Score of a word or a tag by kind; kinds never seen take the default of their sort."""

    by_kind: dict = field(default_factory=dict)
    word: float = 1.0
    tag: float = -0.4

    def of(self, run: Run) -> float:
        if run.nested:
            return 0.0
        if run.text is None:
            return self.by_kind.get(run.kind, 7 * self.tag if run.apart else self.tag)
        return 0.0 if run.apart else run.words * self.by_kind.get(run.kind, self.word)  # words that are left out choose no region


def best_region(scores: list[float]) -> tuple[int, int]:
    """The half-open range with the greatest positive sum, the first of equals; (0, 0) if there is none."""
    best, total, start, region = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, region = total, (start, i + 1)
    return region


def _scores(runs: list[Run], weights: Weights) -> list[float]:
    return [weights.of(r) if r.kind != ("space",) else 0.0 for r in runs]


def _unwrapped(elements: list[Element], runs: list[Run], weights: Weights) -> None:
    """Open named parts that are wrappers: where an article or main has no words besides, the one that scores most in it;
    on a page without these, one whose own best region scores more than the rest of the page."""
    for _ in range(MOST_WRAPPERS):
        plain = {elements[r.element].main for r in runs if r.words and r.element >= 0 and not r.apart}
        outermost = [i for i, e in enumerate(elements) if e.apart and e.named == NAMED and not (e.parent >= 0 and elements[e.parent].apart)]
        only = [i for i in outermost if elements[i].main >= 0 and elements[i].main not in plain and not elements[i].holds]
        candidates = only or [i for i in outermost if elements[i].open]
        if not candidates:
            return
        first = {i: n for n, i in enumerate(candidates)}
        part = [-1] * len(elements)  # the candidate an element lies in
        for i, e in enumerate(elements):
            part[i] = first.get(i, part[e.parent] if e.parent >= 0 else -1)
        own: list[list[float]] = [[] for _ in candidates]
        for run in runs:
            n = part[run.element] if run.element >= 0 else -1
            if n >= 0 and run.kind != ("space",):
                kind = (*run.kind[:-1], False)
                own[n].append(weights.of(Run(kind, run.text, run.words)))
        best = max(range(len(candidates)), key=lambda n: (_sum(own[n]), -n))
        if not any(own) or (not only and _sum(own[best]) <= _sum(_scores(runs, weights))):
            return
        _opened(elements, runs, candidates[best])


def _sum(scores: list[float]) -> float:
    a, b = best_region(scores)
    return sum(scores[a:b])


def main_text(page: str, weights: Weights) -> str:
    """The blocks of the best region, joined by two line ends; empty if there is none."""
    elements, runs = _read(page)
    _unwrapped(elements, runs, weights)
    a, b = best_region(_scores(runs, weights))
    blocks: list[list[str]] = [[]]
    for run in runs[a:b]:
        if run.breaks:
            blocks.append([])
        elif run.text is None:
            if run.kind[1] in ("br", "td", "th", "img"):
                blocks[-1].append(" ")
        elif not run.apart:
            blocks[-1].append(run.text)
    told = (" ".join(html.unescape("".join(block)).split()) for block in blocks)
    return "\n\n".join(block for block in told if block)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, inside, outside) of the labelled pages of a task."""
    seen: Counter = Counter()
    for batch in batches:
        for page in batch.column(0).to_pylist():
            if page and len(re.findall(r"<(?:article|main)\b", page, re.I)) == 1:
                for run in tokens(page):
                    if run.kind != ("space",) and not run.nested:
                        seen[run.kind, run.inside] += run.words or 1
    kinds = sorted({kind for kind, _ in seen}, key=json.dumps)
    yield pa.RecordBatch.from_arrays([pa.array([json.dumps(k) for k in kinds], pa.string()), *(pa.array([seen[k, side] for k in kinds], pa.int64()) for side in (True, False))], ["kind", "inside", "outside"])


def fit(pages: DataFrame, *, html_column: str = "html", tag_cost: float = 3.0, prior: float = 2.0) -> Weights:
    """Weights counted on all pages with exactly one main element; the driver sees one row per kind, a few hundred.

    A word weighs the share of its kind that lies inside main parts, a tag minus (tag_cost times the share that lies
    outside, plus a tenth). Tags inside a part that is
    apart (a menu, an advert, ...) count nothing: the part costs its own two tags. Without labelled pages the defaults hold.
    """
    rows = pages.select(html_column).mapInArrow(_count, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()
    by_kind = {}
    for kind, i, o in rows:
        k = tuple(json.loads(kind))
        share = (i + prior * (not k[-1])) / (i + o + prior)
        by_kind[k] = share if k[0] == "word" else -(tag_cost * (1 - share) + 0.1)
    return Weights(by_kind)


def extract(pages: DataFrame, weights: Weights, *, carry: tuple[str, ...] = ("page_id", "url"), html_column: str = "html") -> DataFrame:
    """The columns named in carry and `text` of every page.

    Null and empty pages, and pages without words, have an empty text. Whole pages are read whatever their length;
    broken markup is read as browsers do roughly: an end tag closes all elements opened since. Equal pages get equal
    texts; repeated rows stay; empty input gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [main_text(page, weights) if page else "" for page in batch.column(len(carry)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), pa.array(told, pa.string())], [*carry, "text"])

    rows = pages.select(*carry, F.col(html_column).alias("_html"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, "text string"]))
