"""Main text of web pages by text-to-tag ratio.

The standard library's streaming parser turns a page into lines (its text blocks), each in its innermost container. A line has
a ratio of characters to tags; the logarithms of the ratios are smoothed by a Gaussian over neighbouring lines, and lines at or above a
threshold between the two clusters of values are dense. The content region is the smallest container that holds HELD of the dense
text. Inside it, a container made of links whose text is hardly dense (a menu) goes as well; all other lines stay, short ones too.

Elements and names only veto, and a veto yields where it would take the content: a form goes unless it holds an article or main element, or WRAPS of the text
with prose in it and no article beside it; a header inside the region keeps its lines if it has the region's highest heading (not where the region is the
whole body). The veto of an element inside a line ends with the line's block if the element is never closed, and a marked container that is never closed
yields if nothing else is left. A list of links between dense lines of the region is content. What markup names as a menu, header, footer, sidebar, notice, advert, form, script, style or reader
comment is left out of the lines from the start, by element, role, class or id. A class, id or role names such a thing if its name is one of
MARKS, ends in one or in one and TAILS ("site-footer", "ad-container"; not "has-sidebar" or "search-results"); "header" doesn't count
in articles and headings, and a paragraph, heading or other line goes only by a name that is a mark as a whole. These names leave out no main element
and no article, nor what holds one, but for reader comments, which stay out as articles too. The region is never narrowed below an article or a
main element, nothing but what is marked goes from an article, and articles beside the region's article stay.

Character references are decoded, white space inside a block becomes one space, and blocks are joined by an empty line in page order. A null or
empty page, or one without text, gives an empty text. Unclosed elements end with what encloses them. Of equally dense containers the outer one is taken.
Each row gives one row, repeated rows and ids too; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Width of the Gaussian in lines, and the share of the page's dense text that the content region holds.
SIGMA, HELD = 1.5, 0.95
#: A container goes as a menu if less than MENU[0] of its text is dense and MENU[1] of it or more stands in links.
MENU = (0.4, 0.5)
#: Share of the text from which a form is the page's frame, and letters of a line of prose.
WRAPS, PROSE = 0.8, 80
#: Fixed lists of elements and of words in classes, ids and roles.
SKIPPED = frozenset("nav footer aside script style noscript template iframe svg canvas object button select textarea menu dialog title audio video map datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html head body article main section div header form ul ol dl table figure details center fieldset".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr caption blockquote pre address figcaption summary hr legend".split()) | CONTAINERS
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup sidebar sidenav menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead topbar comment comments disqus reply replies respond "
    "discussion share sharing social related recommended widget widgets toolbar login search complementary contentinfo".split()
)
#: What of these stands for reader comments; words that may follow a mark; words that make a name tell of something else's layout.
COMMENTS = frozenset("comment comments disqus reply replies respond discussion".split())
TAILS = frozenset("area list box container wrapper wrap inner section block button buttons link links item items bar group panel column col row unit slot posts articles stories form toggle icon icons left right top bottom".split())
LAYOUT = frozenset("has with no without is not non hide show".split())
_TOKENS = re.compile(r"[a-z]+")


def marks_of(names: str) -> set[str]:
    """The marks that a class, id or role attribute names."""
    found = set()
    for name in names.split():
        words = _TOKENS.findall(name.split("--")[0])
        if LAYOUT.isdisjoint(words):
            while words and words[-1] in TAILS:
                words.pop()
            found.update(MARKS.intersection(words[-1:]))
    return found


class Reader(HTMLParser):
    """Collects a page's lines and the tree of its containers."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: Text, tags, characters in links, and the innermost container of each line.
        self.lines: list[tuple[str, int, int, int]] = []
        #: The enclosing container of each container, and whether it is an article or main element.
        self.parents, self.semantic, self.names = [0], [False], [""]
        #: For each line the marked elements it is in, as numbers; by number whether only a main element, not an article, lifts the mark.
        self.within: list[tuple[int, ...]] = []
        self.comments: list[bool] = []
        self.lifted: set[int] = set()
        #: The level of the heading that a line is, else 7; by number what was marked (form, header, a tag, or the rest of an element inside a line), and its container.
        self.levels: list[int] = []
        self.kinds: list[str] = []
        self.places: list[int] = []
        #: What stands behind the block in which a marked element inside a line began; marked elements that were never closed.
        self.rest: dict[int, int] = {}
        self.unclosed: set[int] = set()
        self.level = 7
        self.words: list[str] = []
        self.tags = self.links = self.linked = 0
        #: Open containers: (element, left out, container, is in an article or main element, marked elements around).
        self.open: list[tuple[str, bool, int, bool, tuple[int, ...]]] = [("", False, 0, False, ())]

    def end_line(self) -> None:
        _, out, region, _, within = self.open[-1]
        text = " ".join("".join(self.words).split())
        if text and not out:
            self.lines.append((text, max(1, self.tags), self.linked, region))
            self.within.append(within)
            self.levels.append(self.level)
        self.words, self.tags, self.linked, self.level = [], 0, 0, 7

    def mark(self, kind: str, region: int, comment: bool = False) -> int:
        self.kinds.append(kind)
        self.places.append(region)
        self.comments.append(comment)
        return len(self.kinds) - 1

    def end_block(self) -> None:
        """What follows in a marked element inside a line is marked apart, as the element may never be closed."""
        first = len(self.open)
        while self.open[first - 1][0] and self.open[first - 1][0] not in BLOCKS and self.open[first - 1][0] not in SKIPPED:
            first -= 1
        for k in range(first, len(self.open)):
            tag, out, region, semantic, within = self.open[k]
            for w in within:
                if self.kinds[w] == tag and w not in self.rest:
                    self.rest[w] = self.mark("rest", region)
            self.open[k] = (tag, out, region, semantic, tuple(self.rest.get(w, w) for w in within))

    def leave(self, first: int) -> None:
        """The open elements from first on end without an end tag of theirs."""
        for tag, _, _, _, within in self.open[first:]:
            self.unclosed.update(w for w in within[-1:] if self.kinds[w] == tag)
            self.lifted.update(w for w in within if self.kinds[w] == "rest" and tag not in BLOCKS and tag not in SKIPPED)
        del self.open[first:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCKS or tag in SKIPPED:
            self.end_line()
            self.end_block()
            self.tags, self.level = 1, int(tag[1]) if tag in HEADINGS else 7
            if self.open[-1][0] == "p" or tag == self.open[-1][0] in ("li", "dt", "dd", "tr"):
                self.open.pop()  # its end tag may be left out
        elif tag in ("br", "td", "th", "img", "wbr"):
            self.words.append(" " if tag != "wbr" else "")
        elif tag == "a":
            self.links = int(any(k == "href" for k, _ in attrs))
        if tag not in CONTAINERS and tag not in SKIPPED and not attrs:
            return
        _, out, region, semantic, within = self.open[-1]
        named = {k: (v or "").lower() for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden", "style")}
        marks = set().union(*(marks_of(named[k]) for k in ("class", "id", "role") if k in named)) if tag not in ("html", "body", "main") else set()
        if tag not in CONTAINERS:  # a line goes only by a whole name
            marks &= {name for k in ("class", "id", "role") for name in named.get(k, "").split()}
        if semantic or tag in HEADINGS:
            marks.discard("header")
        if tag == "article":
            marks &= COMMENTS
        hidden = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "")
        leave = out or tag in SKIPPED or hidden
        soft = "form" if tag == "form" else "header" if tag == "header" and not semantic else ""
        if tag not in CONTAINERS and tag not in SKIPPED:
            marks, leave = marks | ({"hidden"} if hidden else set()), out
            if not marks or out or tag in ("br", "hr", "img", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed", "track"):
                return
            self.end_line()  # a paragraph or a span that is left out
        elif not leave and tag in CONTAINERS:
            self.parents.append(region)
            self.semantic.append(tag in ("article", "main"))
            self.names.append(tag)
            region = len(self.parents) - 1
        if tag in ("article", "main") and not leave and not marks:
            held = any(self.comments[w] for w in within)  # an article among reader comments is one of them
            self.lifted.update(w for w in within if tag == "main" or not held)
        if soft and not leave:
            within = (*within, self.mark(soft, region))
        if marks - {soft}:
            within = (*within, self.mark(tag, region, not marks.isdisjoint(COMMENTS)))
        self.open.append((tag, leave, region, semantic or tag in ("article", "main"), within))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a" or tag in CONTAINERS:
            self.links = 0
        if tag in BLOCKS or tag in SKIPPED:
            self.end_line()
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                self.end_line()
                self.leave(k + 1)
                self.open.pop()
                break
            if self.open[k][0] in CONTAINERS and tag not in CONTAINERS and tag not in SKIPPED:
                break

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in CONTAINERS or tag in SKIPPED:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if not self.open[-1][1]:
            self.words.append(data)
            self.linked += self.links * len(data.strip())

    def close(self) -> None:
        super().close()
        self.end_line()
        self.leave(1)
        self.lift_wrappers()

    def around(self, region: int) -> list[int]:
        """A container and those that hold it."""
        found = [region]
        while found[-1]:
            found.append(self.parents[found[-1]])
        return found

    def vetoes(self) -> list[set[int]]:
        """For each line the marks on it that hold."""
        return [set(within) - self.lifted for within in self.within]

    def lift_wrappers(self) -> None:
        """Forms that are the frame of the page, and, where nothing else is left, a container that was never closed."""
        for last in (False, True):
            vetoes = self.vetoes()
            free = [k for k, v in enumerate(vetoes) if not v]
            if last and free:
                return
            single: dict[int, list[int]] = {}
            for k, v in enumerate(vetoes):
                if len(v) == 1:
                    single.setdefault(next(iter(v)), []).append(k)
            size = {w: sum(len(self.lines[k][0]) for k in lines) for w, lines in single.items() if any(len(self.lines[k][0]) >= PROSE and 2 * self.lines[k][2] < len(self.lines[k][0]) for k in lines)}
            if last:
                size = {w: n for w, n in size.items() if w in self.unclosed and self.kinds[w] in CONTAINERS and not self.comments[w]}
            else:
                others, articles = sum(len(self.lines[k][0]) for k in free), {c for k in free for c in self.around(self.lines[k][3]) if self.semantic[c]}
                size = {w: n for w, n in size.items() if self.kinds[w] == "form" and n >= WRAPS * (n + others) and articles.issubset(self.around(self.places[w]))}
            if size:
                self.lifted.add(max(size, key=lambda w: (size[w], -w)))

    def headlines(self, region: int, free: list[int]) -> set[int]:
        """Headers inside the region that hold its highest heading, by number."""
        if self.names[region] in ("", "html", "body"):
            return set()
        found: dict[int, list[int]] = {}
        for k, v in enumerate(self.vetoes()):
            if len(v) == 1 and self.kinds[w := next(iter(v))] == "header" and region in self.around(self.parents[self.places[w]]):
                found.setdefault(w, []).append(k)
        best = min((self.levels[k] for k in free if region in self.around(self.lines[k][3])), default=7)
        return {w for w, lines in found.items() if min(self.levels[k] for k in lines) < best and 2 * sum(self.lines[k][2] for k in lines) < sum(len(self.lines[k][0]) for k in lines)}


def smoothed(ratio: np.ndarray) -> np.ndarray:
    """A Gaussian over neighbouring lines, with weights that sum to 1 at the ends too."""
    width = int(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-width, width + 1) / SIGMA) ** 2)
    full = np.convolve(ratio, kernel)[width : width + len(ratio)]
    return full / np.convolve(np.ones(len(ratio)), kernel)[width : width + len(ratio)]


def threshold(values: np.ndarray) -> float:
    """The midpoint between two clusters of values, by two-means from the extremes."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        middle = (low + high) / 2
        under, over = values[values < middle], values[values >= middle]
        if not len(under) or not len(over):
            break
        new = float(under.mean()), float(over.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str | None) -> str:
    """The main text of one page."""
    reader = Reader()
    reader.feed(html or "")
    reader.close()
    vetoes = reader.vetoes()
    free = [k for k, v in enumerate(vetoes) if not v]
    lines = [reader.lines[k] for k in free]
    if not lines:
        return ""
    size = np.array([len(line[0]) for line in lines], float)
    values = smoothed(np.log1p(size / np.array([line[1] for line in lines])))
    kept, region = content(reader.parents, reader.semantic, np.array([line[3] for line in lines]), size, size * (values >= threshold(values)), np.array([line[2] for line in lines], float))
    headers = reader.headlines(region, [k for k, keep in zip(free, kept, strict=True) if keep])
    stay = {k for k, keep in zip(free, kept, strict=True) if keep} | {k for k, v in enumerate(vetoes) if v and v <= headers}
    return "\n\n".join(reader.lines[k][0] for k in sorted(stay))


def content(parents: list[int], semantic: list[bool], place: np.ndarray, size: np.ndarray, dense: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, int]:
    """Which lines are content, by their containers, sizes, dense sizes and characters in links; and the content region."""
    sums = np.zeros((3, len(parents)))
    for k, x in enumerate((size, dense, linked)):
        np.add.at(sums[k], place, x)
    for c in range(len(parents) - 1, 0, -1):  # a container's number is higher than that of what holds it
        sums[:, parents[c]] += sums[:, c]
    whole, thick, links = sums
    children: dict[int, list[int]] = {}
    for c in range(1, len(parents)):
        children.setdefault(parents[c], []).append(c)
    region = 0
    while not semantic[region]:
        inner = [c for c in children.get(region, ()) if thick[c] >= HELD * thick[0]]
        if not inner:
            break
        region = inner[0]
    inside, protected = np.zeros(len(parents), bool), np.zeros(len(parents), bool)
    inside[region] = True
    if semantic[region]:  # articles beside it are content too
        inside[[c for c in children[parents[region]] if semantic[c]]] = True
    own = np.flatnonzero((place == region) & (dense > 0))  # the region's dense lines outside any container
    between = set(place[own[0] : own[-1]].tolist()) if len(own) else set()
    for c in range(1, len(parents)):
        protected[c] = protected[parents[c]] or semantic[c] or parents[c] == region and c in between
        menu = not protected[c] and thick[c] < MENU[0] * whole[c] and links[c] >= MENU[1] * whole[c]
        inside[c] = (inside[c] or inside[parents[c]]) and (c == region or not menu)
    return inside[place], region


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page (id_col, url_col, text, n_chars)."""
    src = df.select(id_col, url_col, html_col)
    kinds = [f.dataType.simpleString() for f in src.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [main_text(x.as_py()) for x in part[2]]
                yield pa.RecordBatch.from_arrays([part[0], part[1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return src.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars bigint")
