"""HTML extraction by consensus host paths.

A first pass parses each page, drops what is never article text (by element,
role, or words in class and id, unless the element holds the article), and scores the containers: a block of text gives
its unlinked characters to the container it stands in, half to the next one out,
and so on. Containers are named by their generalised path of tags and classes
(digits removed, ids ignored), and every page votes for its paths with their
shares of its score. Spark adds the votes up per host and path and keeps each
host's winner. The second pass extracts the containers on the winning path of the
page's host, widened to the nearest article or main around them, in page order; a page that lacks it (or whose host is unknown) uses
its own best container.

Scale: votes are summed within map tasks, so a host with a third of all pages
costs one row per path and task. Winners meet the pages by a join on host, which
Spark broadcasts only below its size threshold and AQE splits where one host is
hot. Parsing is one scan of the page, linear in its length at any nesting, and a path is a digest, as long at any depth.

Defined results: null or empty html gives an empty text; a null url is no host. Repeated
pages are extracted each (and vote each). Class words and forms drop no element that
holds the article (``_left_out``). Tags that never end are text, as is what follows them;
a tag whose quotes never close ends at its first ``>``. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Scratch, map_arrow, read

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: A tag's rest with ends inside quotes passed over.
_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
CONTAINERS = frozenset("article main section div td body blockquote center".split())
BLOCKS = CONTAINERS | frozenset("address aside dd details dialog dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li nav ol p pre table tbody thead tfoot tr th ul caption summary".split())
DROPPED = frozenset("head nav header footer aside button select option menu dialog object svg canvas audio video".split()) | RAW
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
#: A class or id with one of these words names no article text.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice alert popup modal overlay"
    " newsletter subscribe signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments reply replies"
    " disqus share sharing social pagination pager toolbar hidden".split()
)
#: These do so outside an article or main, or where most of the text is linked.
DOUBTFUL_WORDS = frozenset("header related recommended".split())
#: A class that begins with one of these tells what there is or isn't, and names nothing.
TELLS = frozenset("has no not with without show hide".split())
#: Never dropped for a class: they hold the article.
KEPT = frozenset("html body article main".split())
#: Elements that tell where the article is.
TELLING = ("article", "main", "h1")
#: An element that opens closes the last open one of the first names, unless one of the second opened since.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
_WATCHED = {name: [k for k, (closed, holders) in CLOSES.items() if name in closed or name in holders] for name in {n for pair in CLOSES.values() for names in pair for n in names}}


@dataclass(slots=True)
class Container:
    path: str
    parent: int  # -1: none
    whole: int = -1  # the nearest article or main that it is or stands in; -1: none
    score: float = 0.0


@dataclass(slots=True)
class Mark:
    """An element that its class words, or being a form or an article's header, would drop; the first stands for the page."""

    parent: int  # -1: none
    within: int  # so many articles and mains
    doubtful: bool = False
    chars: int = 0  # unlinked
    linked: int = 0
    holds: list[int] = field(default_factory=lambda: [0] * len(TELLING))


@dataclass(slots=True)
class Page:
    containers: list[Container] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # container, text, linked characters


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _hidden(name: str, attributes: dict[str, str]) -> bool:
    if name in KEPT or not attributes:
        return False
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in DROPPED_ROLES


def _class_words(name: str, attributes: dict[str, str]) -> set[str]:
    if name in KEPT or not attributes:
        return set()
    out = set()
    for key in ("class", "id"):
        for one in attributes.get(key, "").split():
            words = [w.lower() for w in _WORD.findall(one)]
            if words and (len(words) == 1 or words[0] not in TELLS):
                out.update(words)
    return out


def _step(name: str, attributes: dict[str, str]) -> str:
    classes = sorted({_DIGITS.sub("", c).lower() for c in attributes.get("class", "").split()} - {""})
    return ".".join([name, *classes])


def _under(path: str, step: str) -> str:
    """A container's path as a digest of the path above and its own step, followed by the step: as long at any depth."""
    return f"{hashlib.blake2b(f'{path}>{step}'.encode('utf-8', 'replace'), digest_size=12).hexdigest()}:{step}"


@dataclass(slots=True)
class _Open:
    name: str
    dropped: bool
    linked: bool
    container: int
    mark: int
    block: int  # the place of the innermost open block, itself included
    within: int  # open articles and mains, itself included
    inline: dict[str, int] | None  # of a block: the open elements right in it that are none, by name


class _Parser:
    """One scan of a page. What is open is found by counts and by the places of watched names, never by a search, so
    the work grows with the page's length at any nesting."""

    def __init__(self, html: str):
        self.html = html
        self.containers = [Container("", -1)]
        self.marks = [Mark(-1, 0)]
        self.blocks: list[tuple[int, list[tuple[str, int, bool]]]] = []
        self.stack = [_Open("", False, False, 0, 0, 0, 0, {})]
        self.opened: dict[str, int] = {}  # open blocks by name
        self.watched: dict[str, list[int]] = {k: [] for k in CLOSES}
        self.buffer: list[tuple[str, int, bool]] = []  # text, mark, whether linked
        self.quotes_end = True  # no tag so far whose quotes are open to the end
        self.scan()
        self.close_to(1)
        self.flush(0)

    def flush(self, container: int) -> None:
        if self.buffer:
            self.blocks.append((container, self.buffer))
            self.buffer = []

    def close_to(self, at: int) -> None:
        stack = self.stack
        while len(stack) > at:
            top = stack.pop()
            if top.inline is not None:
                self.flush(top.container)
                self.opened[top.name] -= 1
                for k in _WATCHED.get(top.name, ()):
                    self.watched[k].pop()
            else:
                stack[top.block].inline[top.name] -= 1

    def scan(self) -> None:
        html, pos, end, last = self.html, 0, len(self.html), self.html.rfind(">")
        while pos < end:
            at = html.find("<", pos)
            if at < 0 or at > last:  # no tag ends from here on
                self.text(html[pos:])
                return
            if at > pos:
                self.text(html[pos:at])
            if html.startswith("<!--", at):
                stop = html.find("-->", at + 4)
                pos = end if stop < 0 else stop + 3
            elif html.startswith(("<!", "<?"), at):
                pos = html.find(">", at) + 1
            elif (name := _NAME.match(html, at + 1)) is None:
                self.text("<")
                pos = at + 1
            else:
                stop = _QUOTED.match(html, name.end()) if self.quotes_end else None
                self.quotes_end = self.quotes_end and stop is not None
                pos = stop.end() if stop else html.find(">", at) + 1
                if name[1]:
                    self.closing(name[2].lower())
                else:
                    pos = self.opening(name[2].lower(), html[name.end() : pos - 1], pos)

    def text(self, raw: str) -> None:
        top = self.stack[-1]
        if not top.dropped:
            text = unescape(raw) if "&" in raw else raw
            self.buffer.append((text, top.mark, top.linked))
            size = len("".join(text.split()))
            mark = self.marks[top.mark]
            if top.linked:
                mark.linked += size
            else:
                mark.chars += size

    def closing(self, name: str) -> None:
        stack = self.stack
        if name in BLOCKS:
            if not self.opened.get(name):
                return
        elif not stack[stack[-1].block].inline.get(name):  # strayed from its block
            return
        at = len(stack) - 1
        while stack[at].name != name:  # all on the way are closed too
            at -= 1
        self.close_to(at)

    def opening(self, name: str, rest: str, pos: int) -> int:
        stack, block = self.stack, name in BLOCKS
        if name in VOID:
            top = stack[-1]
            if name in ("br", "wbr", "img", "hr") and not top.dropped:
                self.buffer.append((" " if name != "wbr" else "", top.mark, False))
                if name == "hr":
                    self.flush(top.container)
            return pos
        if block and stack[stack[-1].block].name == "p":
            self.close_to(stack[-1].block)
        if name in CLOSES and self.watched[name] and stack[self.watched[name][-1]].name in CLOSES[name][0]:
            self.close_to(self.watched[name][-1])
        top = stack[-1]
        if rest.endswith("/") and not block and (len(rest) == 1 or rest[-2] in " \t\r\n\"'"):  # else the end of a bare value
            return pos
        attributes = _attributes(rest) if rest.strip(" /") else {}
        mark, inner = top.mark, top.within + (name in ("article", "main"))
        own_header = name == "header" and top.within > 0
        dropped = top.dropped or name in DROPPED and not own_header or _hidden(name, attributes)
        if not dropped:
            words = _class_words(name, attributes)
            named = own_header or name == "form" or not words.isdisjoint(DROPPED_WORDS)
            if named or not words.isdisjoint(DOUBTFUL_WORDS):
                self.marks.append(Mark(mark, top.within, not named))
                mark = len(self.marks) - 1
            if name in TELLING:
                self.marks[mark].holds[TELLING.index(name)] += 1
        container = top.container
        if block:
            self.flush(container)
            if name in CONTAINERS and not dropped:
                above = self.containers[container]
                here = len(self.containers)
                self.containers.append(Container(_under(above.path, _step(name, attributes)), container, here if name in ("article", "main") else above.whole))
                container = here
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(self.html, pos)
            close = self.html.find(">", stop.end()) if stop else -1
            return close + 1 if close >= 0 else len(self.html)
        stack.append(_Open(name, dropped, top.linked or name == "a", container, mark, len(stack) if block else top.block, inner, {} if block else None))
        if block:
            self.opened[name] = self.opened.get(name, 0) + 1
            for k in _WATCHED.get(name, ()):
                self.watched[k].append(len(stack) - 1)
        else:
            inline = stack[top.block].inline
            inline[name] = inline.get(name, 0) + 1
        return pos


def _left_out(marks: list[Mark]) -> list[bool]:
    """Which marks are dropped: all but those that hold the article, which hold the page's every h1; outside of any
    article or main, all of those; or more than half of the unlinked text, with no article or main elsewhere. A
    doubtful mark inside an article or main is dropped only if most of its text is linked."""
    for mark in reversed(marks[1:]):  # parents come first
        above = marks[mark.parent]
        above.chars += mark.chars
        above.linked += mark.linked
        above.holds = [a + b for a, b in zip(above.holds, mark.holds, strict=True)]
    page = marks[0]

    def keeps(mark: Mark) -> bool:
        every = [n > 0 and n == of for n, of in zip(mark.holds, page.holds, strict=True)]
        alone = sum(page.holds[:2]) == sum(mark.holds[:2]) + mark.within
        if mark.doubtful and mark.within and mark.chars > mark.linked:
            return True
        return alone and 2 * mark.chars > page.chars or every[2] or not mark.within and any(every)

    out = [False]
    for mark in marks[1:]:
        out.append(out[mark.parent] or not keeps(mark))
    return out


def parse(html: str) -> Page:
    """The page's containers with their scores, and its kept blocks of text, in page order.

    White space is what Python's ``str.split`` takes for it: ASCII blanks, U+001C to U+001F, U+0085, no-break and other spaces.
    """
    found = _Parser(html)
    out, page = _left_out(found.marks), Page(found.containers)
    for container, parts in found.blocks:
        kept = [(text, linked) for text, mark, linked in parts if not out[mark]]
        if text := " ".join("".join(t for t, _ in kept).split()):
            linked = min(sum(len(t) for t, is_linked in kept if is_linked), len(text))
            page.blocks.append((container, text, linked))
            worth, at = float(max(0, len(text) - 2 * linked)), container
            while at >= 0 and worth >= 0.5:
                page.containers[at].score += worth
                worth, at = worth / 2, page.containers[at].parent
    return page


def votes(html: str) -> list[tuple[str, float]]:
    """(path, share of the page's score) of every container with a score."""
    found: dict[str, float] = {}
    for c in parse(html).containers:
        if c.score:
            found[c.path] = found.get(c.path, 0.0) + c.score
    total = sum(found.values())
    return [(path, value / total) for path, value in found.items()]


def extract(html: str, path: str | None) -> str:
    """The text of the containers on the path, or else of the page's best container, each widened to its article or main."""
    page = parse(html)
    inside = [path is not None and c.path == path for c in page.containers]
    if not any(inside):
        best = max(range(len(page.containers)), key=lambda i: (page.containers[i].score, -i))
        inside = [i == best for i in range(len(page.containers))]
    for i in [page.containers[i].whole for i, chosen in enumerate(inside) if chosen]:
        if i >= 0:
            inside[i] = True
    for i, c in enumerate(page.containers):  # parents come first
        inside[i] = inside[i] or c.parent >= 0 and inside[c.parent]
    return " ".join(text for at, text, _ in page.blocks if inside[at])


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def winning_paths(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """host, path: the path with the largest sum of votes of each host."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for name, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for path, share in votes(html or ""):
                    for column, value in zip(out, (name, path, share), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], ["host", "path", "share"])

    rows = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where("host <> ''")
    cast = map_arrow(rows, vote, "host string, path string, share double")
    # whole thousandths, so that sums don't depend on their order
    summed = cast.groupBy("host", "path").agg(F.sum(F.round(F.col("share") * 1000).cast("bigint")).alias("votes"))
    return summed.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))


def extracted(pages: DataFrame, scratch: Scratch, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Per page: the kept columns, text and n_chars. ``keep`` may not name those two."""
    winners = scratch.cut(winning_paths(pages, html_col, url_col), "winning-paths")
    rows = pages.select(*keep, F.col(html_col).alias("_html"), host(F.col(url_col)).alias("_host"))
    rows = rows.join(winners.select(F.col("host").alias("_host"), F.col("path").alias("_path")), "_host", "left").select(*keep, "_html", "_path")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keep)
        for batch in batches:
            texts = [extract(html or "", path) for html, path in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return map_arrow(rows, make, rows.select(*keep).schema.add("text", "string").add("n_chars", "long"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read(spark, sf_dir, "pages"), Scratch(spark, "op3"))
