"""HTML extraction by tag-path ratios.

A page is a sequence of text runs, each under a path of tags from the root. Text length outside of links, number of runs and
punctuation are added up per path; a path's ratio is its text per run, fused with its punctuation per run. The ratios, in page
order of the paths, are smoothed by a Gaussian and fused with the unsmoothed ones. What tags and class names say is a prior
weight on the result, not a verdict. Paths that reach a share of the page's mean are content (``content_paths``): their runs
are the main text. Headings and list items are short, so the blocks that stand beside content in one element are added,
unless their own weight or links speak against them.

The scanner and all passes over elements take time in proportion to the page, whatever its markup.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Fixed values of HTML: elements without content, raw text, blocks, and start tags that close an open element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math title xmp object".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = ("ul", "ol", "dl", "table", "select", "menu")
#: Elements that are hardly ever part of an article.
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog button select label input".split())
#: Words that say the same of an element if a name in its class or its id or role begins or ends with one.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert advertisement advertising banner sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments reply replies discussion respond disqus cookie cookies consent notice notices alert popup modal newsletter subscribe signup share sharing social related recommended widget toolbar complementary contentinfo search login".split()
)
ARTICLE_TAGS = ("article", "main")
#: Those that say so of an article element too.
READER_WORDS = frozenset("comment comments reply replies related recommended sponsored promo".split())

#: Prior weights of paths through a boilerplate element, and through an article.
BOILERPLATE_PRIOR, ARTICLE_PRIOR = 1e-3, 10.0
#: Content paths have this share of the page's mean ratio, and the least ratio at all.
SHARE, LEAST = 0.02, 1.0
#: How much of a link's text counts.
LINKED = 0.1

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile("([^\\s=/>\"']+)(?:\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+))?")
_PART = re.compile(r"[^\W_]+")
_PUNCT = re.compile(r"[.,;:!?]")


@dataclass
class Page:
    """The elements of a page, parents before children, and its text runs. Element 0 is the page itself."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    odd: list[bool] = field(default_factory=lambda: [False])  # boilerplate by its own tag, class, id or role
    runs: list[tuple[int, int, str, bool]] = field(default_factory=list)  # element, block, text (" " for white space), in a link


class _Scanner:
    """Where tags end; each character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.n, self.unclosed = page, len(page), set()

    def tag_end(self, at: int) -> int:
        """The place after the tag whose name ends at ``at``: quoted values are skipped, a quote that never closes is a character."""
        while (found := _STOP.search(self.page, at)) is not None:
            mark, at = found[0], found.end()
            if mark == ">":
                return at
            back = at - 2
            while back > 0 and self.page[back].isspace():
                back -= 1
            if self.page[back] == "=" and mark not in self.unclosed:
                close = self.page.find(mark, at)
                if close < 0:
                    self.unclosed.add(mark)
                else:
                    at = close + 1
        return self.n

    def tokens(self) -> Iterator[tuple[str, str, str]]:
        """("text", text, ""), ("start", tag, attributes) and ("end", tag, ""); raw elements and comments are left out."""
        page, at, n = self.page, 0, self.n
        while at < n:
            i = page.find("<", at)
            if i < 0:
                yield "text", page[at:], ""
                return
            if i > at:
                yield "text", page[at:i], ""
            if page.startswith("<!--", i):
                end = page.find("-->", i + 4)
                at = end + 3 if end >= 0 else n
            elif page.startswith("<![CDATA[", i):
                end = page.find("]]>", i)
                yield "text", page[i + 9 : end if end >= 0 else n], ""
                at = end + 3 if end >= 0 else n
            elif page.startswith(("<!", "<?"), i):
                end = page.find(">", i)
                at = end + 1 if end >= 0 else n
            elif (name := _NAME.match(page, i + 2 if page.startswith("</", i) else i + 1)) is None:
                yield "text", "<", ""
                at = i + 1
            elif page.startswith("</", i):
                end = page.find(">", name.end())
                at = end + 1 if end >= 0 else n
                yield "end", name[0].lower(), ""
            else:
                tag, at = name[0].lower(), self.tag_end(name.end())
                attributes = page[name.end() : at]
                yield "start", tag, attributes
                if tag in RAW and not attributes.rstrip("> ").endswith("/"):
                    close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    at = close.end() if close else n


def _named_boilerplate(attributes: str, allowed: frozenset[str]) -> bool:
    for name, value in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            for word in value.strip("\"'").lower().split():
                parts = _PART.findall(word)
                if parts and BOILERPLATE_WORDS.intersection((parts[0], parts[-1])) - allowed:
                    return True
    return False


def parse(text: str) -> Page:
    """The elements and text runs of a page. Broken markup is read as browsers do in the common cases: start tags close open
    paragraphs and list items, an end tag closes what is open inside it, and the end of the page closes everything."""
    page = Page()
    stack: list[int] = [0]
    places: dict[str, list[int]] = {}  # of each open tag, its places in the stack
    block = links = articles = 0

    def close(depth: int) -> None:
        nonlocal links, articles
        while len(stack) > depth:
            tag = page.tag[stack.pop()]
            places[tag].pop()
            links -= tag == "a"
            articles -= tag in ARTICLE_TAGS

    for kind, tag, rest in _Scanner(text).tokens():
        if kind == "text":
            page.runs.append((stack[-1], block, " " if tag.isspace() else tag, links > 0))
            continue
        if tag in BLOCK:
            block += 1
        if kind == "end":
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in CLOSES_P and places.get("p"):
            close(places["p"][-1])
        if tag in SIBLINGS:
            inner = max((places[t][-1] for t in LISTS if places.get(t)), default=0)
            level = [open_[k] for t in SIBLINGS[tag] if (open_ := places.get(t)) and (k := bisect_right(open_, inner)) < len(open_)]
            if level:
                close(min(level))
        if tag in VOID or tag in RAW or rest.rstrip("> ").endswith("/"):
            continue
        allowed = BOILERPLATE_WORDS - READER_WORDS if tag in ARTICLE_TAGS else frozenset(("header", "masthead")) if articles else frozenset()
        named = tag not in ("html", "body") and bool(rest) and _named_boilerplate(rest, allowed)
        page.odd.append(tag in BOILERPLATE_TAGS or (tag == "header" and not articles) or named)
        page.parent.append(stack[-1])
        page.tag.append(tag)
        places.setdefault(tag, []).append(len(stack))
        stack.append(len(page.tag) - 1)
        links += tag == "a"
        articles += tag in ARTICLE_TAGS
    return page


@dataclass
class Paths:
    """The distinct paths of a page's blocks: of each element its path, and per path its prior weight and its sums."""

    of: list[int]
    prior: np.ndarray
    sums: np.ndarray  # characters, runs, punctuation, characters in links


def tag_paths(page: Page) -> Paths:
    """Paths go through block elements; a boilerplate element is another step than a plain one of its tag.

    A form or a named element around an article, a main element or a first heading is no boilerplate, nor is a form with two
    thirds of the page's text: some sites wrap whole pages in them.
    """
    n = len(page.tag)
    size, holds = [0] * n, [False] * n
    for element, _, text, _ in page.runs:
        size[element] += len(text) if text != " " else 0
    for i in range(n - 1, 0, -1):
        size[page.parent[i]] += size[i]
        holds[page.parent[i]] |= holds[i] or page.tag[i] in (*ARTICLE_TAGS, "h1")
    known: dict[tuple[int, str, bool], int] = {}
    of, prior = [0] * n, [1.0]
    low, high = [False], [False]
    for i in range(1, n):
        tag, up = page.tag[i], of[page.parent[i]]
        odd = page.odd[i]
        if odd and (tag == "form" or tag not in BOILERPLATE_TAGS | {"header"}) and (holds[i] or (tag == "form" and 3 * size[i] >= 2 * size[0])):
            odd = False
        if tag not in BLOCK and not odd:
            of[i] = up
            continue
        step = (up, tag, odd)
        if step not in known:
            known[step] = len(prior)
            low.append(low[up] or odd)
            high.append(high[up] or tag in ARTICLE_TAGS)
            prior.append((BOILERPLATE_PRIOR if low[-1] else 1.0) * (ARTICLE_PRIOR if high[-1] else 1.0))
        of[i] = known[step]
    sums = np.zeros((len(prior), 4))
    for element, _, text, linked in page.runs:
        if text != " ":
            length = len(text.strip())
            sums[of[element]] += (length, 1, len(_PUNCT.findall(text)), length if linked else 0)
    return Paths(of, np.array(prior), sums)


def path_ratios(paths: Paths) -> np.ndarray:
    """The fused ratio of each path; 0 for paths without text. Smoothing is a Gaussian over the paths with text, in the order of
    their first appearance, whose reach grows with the square root of their number."""
    chars, runs, punct, linked = paths.sums.T
    some = np.flatnonzero(runs)
    fused = np.zeros(len(runs))
    if len(some):
        ratio = (chars - (1 - LINKED) * linked)[some] / runs[some] * (1 + punct[some] / runs[some])
        reach = max(1, int(np.sqrt(len(some)) // 2))
        kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / max(0.5, reach / 2)) ** 2)
        smooth = np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), mode="valid")
        fused[some] = np.sqrt(ratio * smooth) * paths.prior[some]
    return fused


def content_paths(paths: Paths, share: float = SHARE, least: float = LEAST) -> np.ndarray:
    """Which paths are content: their fused ratio is ``least`` or more and reaches ``share`` of the page's mean. In the mean a
    path counts by its characters and its prior weight."""
    fused, weight = path_ratios(paths), paths.sums[:, 0] * paths.prior
    mean = float((fused * weight).sum() / weight.sum()) if weight.sum() else 0.0
    return (paths.sums[:, 1] > 0) & (fused >= max(least, share * mean))


def content_elements(page: Page, share: float = SHARE, least: float = LEAST) -> list[bool]:
    """Which elements' own text is content: those of content paths, and those beside them.

    An element stands beside content if it or an element around it is a child of one whose own children are content, or of
    an article or main element with content in it. Its path must not be boilerplate nor mostly links.
    """
    paths = tag_paths(page)
    chosen = content_paths(paths, share, least)
    n = len(page.tag)
    own, inside, direct = [False] * n, [False] * n, [False] * n
    for element, _, text, _ in page.runs:
        if text != " " and chosen[paths.of[element]]:
            own[element] = inside[element] = True
    up = [0] * n  # the closest block element around
    for i in range(1, n):
        above = page.parent[i]
        up[i] = above if page.tag[above] in BLOCK or not above else up[above]
    for i in range(n - 1, 0, -1):
        inside[page.parent[i]] |= inside[i]
        if own[i]:
            direct[up[i] if page.tag[i] in BLOCK else up[up[i]]] = True
    beside = [False] * n
    beside[0] = own[0] or direct[0]
    for i in range(1, n):
        beside[i] = beside[page.parent[i]] or direct[i] or (page.tag[i] in ARTICLE_TAGS and inside[i])
    fit = (paths.prior >= 1.0) & (2 * paths.sums[:, 3] <= paths.sums[:, 0])
    if not chosen.any():
        return [False] * n
    return [bool(chosen[paths.of[i]] or (beside[i] and fit[paths.of[i]])) for i in range(n)]


def main_text(text: str | None, share: float = SHARE, least: float = LEAST) -> str:
    """The article's text: white space inside a block is one space, blocks are joined by one space. Empty if there is none."""
    if not text:
        return ""
    page = parse(text)
    keep = content_elements(page, share, least)
    blocks: dict[int, list[str]] = {}
    for element, block, run, _ in page.runs:
        if run == " ":
            if block in blocks:
                blocks[block].append(" ")
        elif keep[element]:
            blocks.setdefault(block, []).append(run)
    done = (" ".join(_html.unescape("".join(parts)).split()) for parts in blocks.values())
    return " ".join(b for b in done if b)


def plain_text(text: str | None) -> str:
    """All visible text of a page, one line a block: what a plain-text conversion record holds."""
    blocks: dict[int, list[str]] = {}
    for _, block, run, _ in parse(text or "").runs:
        blocks.setdefault(block, []).append(run)
    done = (" ".join(_html.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(b for b in done if b)


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with a column of main text, by batches of rows: a narrow stage whose memory is one batch of pages.

    A null or empty page has an empty text; every row stays, repeated ones too; a column already called ``into`` is replaced;
    an empty table gives an empty result.
    """
    fields = [f for f in pages.schema.fields if f.name != into]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
            yield pa.record_batch([*batch.columns[:-1], texts], names=[*names, into])

    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    return pages.select(*columns, F.col(f"`{html}`").alias("page")).mapInArrow(run, StructType([*fields, StructField(into, StringType())]))
