"""HTML extraction by a maximum-scoring subsequence with learned weights.

A page is a sequence of word and tag tokens. A word scores +1, or -1 inside a
container that labelled pages show to hold boilerplate (little, if that lies in content); a tag scores a negative
weight. The contiguous run of the highest sum, found by one linear scan, is the
content region. Inside it, words of boilerplate containers are left out too.

Weights come from pages that label themselves: text inside ``<article>`` is
content, the rest is not. Tag weights follow the share of a tag's occurrences
outside articles; a container (tag name, first or last word of a class or id) is
boilerplate by the log-odds of the words inside it, with fixed prior counts for
usual names.

The region is one run: of several articles far apart on a page the one of most
words is the text.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import read_table, thrifty

#: Labelled pages that weights are fitted on, in expectation, and least words or tags that a learned name needs among them.
SAMPLE_PAGES, LEAST = 2000, 5
#: What a boilerplate word costs inside a content container, which goes on after it; outside it costs 1.
INNER = 0.02
#: Words that the prior of a usual name counts for.
PRIOR = 200

# Names of HTML elements and usual class words.
SKIPPED = frozenset("template noscript svg select object canvas math button".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog".split())
CONTENT_TAGS = frozenset("article main".split())
CONTAINERS = BOILERPLATE_TAGS | CONTENT_TAGS | frozenset("div section ul ol li dl table thead tbody tr td th p figure figcaption blockquote span details summary fieldset body center".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer form header login masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related reply respond replies share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets alert".split())
CONTENT_WORDS = frozenset("article articlebody content entry main post story text".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|iframe|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z|</?[a-zA-Z][^>]*>", re.S | re.I)
_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS - {'option', 'legend'}, key=len, reverse=True))})\b", re.I)
_CLOSER = {t: re.compile(rf"</{t}\s*>", re.I) for t in SKIPPED}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


class Weights:
    """Container log-odds (positive: content) and tag penalties."""

    def __init__(self, containers: dict[str, float], tags: dict[str, float]):
        self.containers, self.tags = containers, tags

    def of(self, tag: str, attributes: str) -> float:
        """What a container says of the words in it: below 0 boilerplate, above content, 0 nothing."""
        if "hidden" in attributes or "display" in attributes:
            if _HIDDEN.search(attributes):
                return -9.0
        said = [self.containers.get("<" + tag, 0.0)]
        if attributes:
            said += [self.containers.get(w, 0.0) for w in class_words(attributes)]
        return min(said) if min(said) < 0 else max(said)


def class_words(attributes: str) -> list[str]:
    """First and last word of each class, id and role: what stands between says what a thing isn't as often as what it is."""
    names = [n for m in _NAMES.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").lower().split()]
    parts = [[w for w in _SPLIT.split(n) if w] for n in names]
    return [w for p in parts if p for w in ((p[0], p[-1]) if len(p) > 1 else p)]


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes) and ("close", tag, "") in page order.

    Elements without text of their own are passed over to their end tag, or
    without one to the next block; only raw text runs on to the end of the page.
    """
    at, unclosed = 0, set()
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        yield ("close" if m[2] else "open"), tag, m[4] or ""
        if tag in SKIPPED and not m[2] and not m[0].endswith("/>"):
            end = None if tag in unclosed else _CLOSER[tag].search(page, at)
            if end is None:
                unclosed.add(tag)  # there is none further on either
                end = _BLOCK_TAG.search(page, at)
                at = end.start() if end else len(page)
            else:
                at = end.end()
    if at < len(page):
        yield "text", page[at:], ""


def _walk(page: str, weights: Weights | None) -> Iterator[tuple[str, str, list]]:
    """Tokens with the stack of open containers, each [tag, verdict, class words, whether content is around it]."""
    stack: list[list] = []
    for kind, what, attributes in tokens(page):
        if kind == "open" and what in CONTAINERS:
            if what in ("p", "li", "td", "tr") and stack and stack[-1][0] == what or what in BLOCKS and stack and stack[-1][0] == "p":
                stack.pop()
            plain = "div" if what == "header" and any(s[0] == "article" for s in stack) else what  # an article's own header holds its title
            verdict = weights.of(plain, attributes) if weights else 0.0
            if not verdict and stack:
                verdict = stack[-1][1]
            elif stack and stack[-1][1] < 0:
                verdict = min(verdict, stack[-1][1])  # nothing inside boilerplate is content
            within = bool(stack) and (stack[-1][3] or stack[-1][1] > 0)
            stack.append([what, verdict, class_words(attributes) if weights is None and attributes else (), within])
        elif kind == "close" and what in CONTAINERS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == what:
                    del stack[i:]
                    break
        yield kind, what, stack


def main_text(page: str | None, weights: Weights) -> str:
    """The main text of a page: blocks joined by line feeds; empty if there is none."""
    scores: list[float] = []
    items: list[tuple[str, str]] = []  # ("word run", text), ("block", "") or ("inline", "")
    for kind, what, stack in _walk(page or "", weights):
        if kind == "text":
            text = htmllib.unescape(what)
            n = len(text.split())
            good = not stack or stack[-1][1] >= 0
            items.append(("text" if good else "other", text))
            scores.append(float(n) if good else -INNER * n if stack[-1][3] else -float(n))
        else:
            items.append(("block", "") if what in BLOCKS else ("text" if not stack or stack[-1][1] >= 0 else "other", " ") if what == "br" else ("inline", ""))
            scores.append(-weights.tags.get(what, 0.05))
    lo, hi = best_run(scores)
    blocks: list[str] = []
    held: list[str] = []
    for kind, text in items[lo:hi]:
        if kind == "text":
            held.append(text)
        elif kind == "block":
            blocks.append(" ".join("".join(held).split()))
            held = []
    blocks.append(" ".join("".join(held).split()))
    return "\n".join(b for b in blocks if b)


def best_run(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run of the highest positive sum, the first and shortest of equals; (0, 0) if none is positive."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, bounds = total, (start, i + 1)
    return bounds


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        inside, outside = Counter(), Counter()
        for page in batch.column(0).to_pylist():
            for kind, what, stack in _walk(page, None):
                labelled = any(s[0] == "article" for s in stack)
                to = inside if labelled else outside
                if kind == "text":
                    n = len(what.split())
                    for name in {"<" + s[0] for s in stack} | {w for s in stack for w in s[2]}:
                        to[name] += n
                else:
                    to["/" + what] += 1
        names = sorted(inside.keys() | outside.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[n] for n in names], pa.int64()), pa.array([outside[n] for n in names], pa.int64())], ["name", "inside", "outside"])


def fit_weights(pages: DataFrame, sample: int = SAMPLE_PAGES) -> Weights:
    """Weights from about ``sample`` pages with an article, drawn where they are read; of the prior alone if there are none."""
    labelled = pages.select("page_id", "html").where("html is not null and contains(lower(html), '<article')")
    share = min(1.0, sample / max(labelled.count(), 1))
    some = labelled.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("html")
    counts = some.mapInArrow(thrifty(_counted), "name string, inside long, outside long").groupBy("name").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
    containers, tags = {}, {}
    for name, i, o in counts.where(F.col("i") + F.col("o") >= LEAST).collect():  # names of a bounded sample
        if name[0] == "/":
            tags[name[1:]] = 0.02 + 0.06 * (o + 1) / (i + o + 2)
        elif name[0] == "<" and name[1:] not in BOILERPLATE_TAGS | CONTENT_TAGS:
            continue  # plain containers say nothing by themselves
        else:
            containers[name] = math.log((i + 1 + _prior(name, CONTENT_TAGS, CONTENT_WORDS)) / (o + 1 + _prior(name, BOILERPLATE_TAGS, BOILERPLATE_WORDS)))
    for name in ["<" + t for t in BOILERPLATE_TAGS | CONTENT_TAGS] + sorted(BOILERPLATE_WORDS | CONTENT_WORDS):
        containers.setdefault(name, math.log((1 + _prior(name, CONTENT_TAGS, CONTENT_WORDS)) / (1 + _prior(name, BOILERPLATE_TAGS, BOILERPLATE_WORDS))))
    return Weights(containers, tags)


def _prior(name: str, tags: frozenset, names: frozenset) -> int:
    return PRIOR if (name[1:] in tags if name[0] == "<" else name in names) else 0


def extract_pages(pages: DataFrame, weights: Weights) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html).

    Null and empty html give an empty text, as does a page whose words are all
    boilerplate. Repeated rows are extracted each; other columns are not read.
    Cut-off pages and unclosed elements are read as far as they go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(p, weights) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(thrifty(run), "page_id long, url string, text string, n_chars long")


def op9_main_text(spark, sf_dir: str) -> DataFrame:
    """All pages, weights fitted on those that have an article."""
    pages = read_table(spark, sf_dir, "pages")
    return extract_pages(pages, fit_weights(pages))
