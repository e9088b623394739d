"""Main text of web pages by smoothed text-to-tag ratios.

The standard library's parser streams events.  They become lines, one per block of the page, each
with its text, the tags met in it, and the innermost container it stands in.  A line's text-to-tag
ratio is smoothed over its neighbours by a Gaussian; in parts that the markup names as something
else (menus, adverts, comments...) only a share of it counts.  Two clusters of square roots,
one of them held at zero, set the threshold above which a line is content.

The content lines select the regions, from the page inwards.  A container most of whose own lines
are content, or an article or main element most of whose text is, is a region and gives all its
lines, short ones too; parts inside it go only if most of their text is not content and the markup
names them as something else or, outside an article, they are mostly links.  In any other container
each part is judged on its own.  Headings just before a region's first line belong to it.  If no
container is a region, the content lines themselves are the text.

Defined results
    null or empty html, and pages without text, give the empty text; repeated rows are read
    each on its own; malformed pages are read as far as their events go, in time linear in their
    length; an empty table gives an empty result; columns other than those named are ignored,
    whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm._shared import table, text_or_empty

#: Elements by what they do to the lines of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article aside body details dialog div dl fieldset figure footer form header html main menu nav ol section table td ul".split())
#: Never shown as text: the page's head, scripts, styles, controls of forms, embedded media.
SKIPPED = frozenset("audio canvas datalist embed head iframe noembed noframes noscript optgroup script select style template textarea video".split())
#: Named as something else by the element itself, a header only outside an article or main element.
APART = frozenset("aside dialog footer form header menu nav".split())
#: What a head may hold; anything else ends it, as its end tag may be missing.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that name a part as something else.
NAMED = frozenset(
    "ad ads adv advert advertisement advertising adbox adsbygoogle alert announcement banner breadcrumb breadcrumbs "
    "comment comments commentlist complementary consent contentinfo cookie cookies copyright disclaimer disqus feedback "
    "footer gdpr hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification "
    "outbrain overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toc toolbar topbar "
    "widget widgets".split()
)
PARTS = re.compile(r"[^A-Za-z]+")
SPACE = re.compile(r"\s+")
SIGMA, REACH = 1.0, 3
#: What share of a ratio counts in a part named as something else: by a whole word, or by a word in a longer name.
WHOLE, PARTLY = 0.02, 0.1


class _Line:
    __slots__ = ("inside", "linked", "parts", "tag", "tags", "text")

    def __init__(self, inside: int, tag: str) -> None:
        self.inside, self.tag, self.tags, self.linked, self.parts, self.text = inside, tag, 0, 0, [], ""


def _named_apart(attrs: list[tuple[str, str | None]]) -> float:
    """The share of ratios that counts inside an element of these attributes: 0 if it isn't shown at all."""
    share = 1.0
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            lowered = value.lower()
            if not NAMED.isdisjoint(lowered.split()):
                share = min(share, WHOLE)
            elif not NAMED.isdisjoint(PARTS.split(lowered)):
                share = min(share, PARTLY)
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return 0.0
    return share


class PageLines(HTMLParser):
    """Turns the events of a page into lines.  Of each container it keeps the one around it, its
    element, the share of ratios that counts in it and whether it is named as something else itself."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.parents, self.kinds, self.shares, self.apart = [-1], ["page"], [1.0], [False]
        #: Open elements that matter: (tag, container or -1, whether it is left out).
        self._open: list[tuple[str, int, bool]] = []
        self._opened: Counter[str] = Counter()
        self._inside, self._out, self._main, self._links = 0, 0, 0, 0
        self._line = _Line(0, "")

    def _break(self, tag: str = "") -> None:
        line = self._line
        if line.parts and (text := SPACE.sub(" ", "".join(line.parts)).strip()):
            line.text = text
            self.lines.append(line)
        elif line.tags and self.lines:
            self.lines[-1].tags += line.tags
        self._line = _Line(self._inside, tag)

    def _close(self, k: int) -> None:
        """Close the open elements from the k-th on."""
        for tag, container, out in reversed(self._open[k:]):
            self._opened[tag] -= 1
            self._out -= out
            self._main -= tag in MAIN
            if container >= 0:
                self._inside = self.parents[container]
        del self._open[k:]

    def _end_head(self, at_body: bool) -> None:
        """Close an open head; what it has left out inside goes with it only where the body begins."""
        if not self._out or not self._opened["head"]:
            return
        outs = [k for k, x in enumerate(self._open) if x[2]]
        if self._open[outs[0]][0] == "head" and (at_body or len(outs) == 1):
            self._close(outs[0])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD:
            self._end_head(tag == "body")
        if tag in VOID:
            if tag == "hr":
                self._break()
            elif tag == "br" and not self._out:
                self._line.parts.append(" ")
            self._line.tags += 1
            return
        share = 1.0 if tag in ("html", "body") else _named_apart(attrs)
        if tag in MAIN and not self._out and self._opened["nav"] + self._opened["menu"] > 0:
            # An article inside a menu: the menu's end tag is missing.
            self._break()
            self._close(next(k for k, x in enumerate(self._open) if x[0] in ("nav", "menu")))
        if tag in APART and not (tag == "header" and self._main):
            share = min(share, WHOLE)
        out = tag in SKIPPED or not share or (tag == "title" and self._opened["head"] > 0)
        if tag in BLOCKS:
            self._break(tag)
        container = -1
        if tag in CONTAINERS:
            container = len(self.parents)
            self.parents.append(self._inside)
            self.kinds.append(tag)
            self.shares.append(max(1e-9, self.shares[self._inside] * share))
            self.apart.append(share < 1)
            self._inside = container
            self._line.inside = container
        if container >= 0 or out:
            self._open.append((tag, container, out))
            self._opened[tag] += 1
            self._out += out
            self._main += tag in MAIN
        self._links += tag == "a"
        self._line.tags += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._break()
        if self._opened[tag] > 0:
            self._close(next(k for k in range(len(self._open) - 1, -1, -1) if self._open[k][0] == tag))
        if tag == "a" and self._links:
            self._links -= 1
        self._line.inside = self._inside
        self._line.tags += 1

    def handle_data(self, data: str) -> None:
        if self._out and not data.isspace():
            self._end_head(False)
        if not self._out:
            self._line.parts.append(data)
            if self._links:
                self._line.linked += len(data)

    def finish(self) -> list[_Line]:
        self.close()
        self._break()
        return self.lines


def _smooth(ratios: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    return np.convolve(ratios, kernel / kernel.sum(), "full")[REACH : REACH + len(ratios)]


def _threshold(values: np.ndarray) -> float:
    """Half the centre of the upper of two clusters, the lower being held at zero."""
    centre = float(values.max())
    for _ in range(50):
        upper = values[values >= centre / 2]
        new = float(upper.mean())
        if abs(new - centre) < 1e-9:
            break
        centre = new
    return centre / 2


def content_lines(lines: list[_Line], shares: list[float]) -> list[bool]:
    """Which lines are content, from their ratios alone."""
    ratios = _smooth(np.array([len(x.text) / max(1, x.tags) for x in lines]))
    values = np.sqrt(ratios * np.array([shares[x.inside] for x in lines]))
    return (values >= _threshold(values)).tolist()


def regions(page: PageLines, content: list[bool]) -> list[bool]:
    """Which lines belong to the main text, given which are content."""
    count, parents = len(page.parents), page.parents
    own, own_content, linked = [0] * count, [0] * count, [0] * count
    for line, chosen in zip(page.lines, content, strict=True):
        own[line.inside] += len(line.text)
        own_content[line.inside] += len(line.text) * chosen
        linked[line.inside] += min(line.linked, len(line.text))
    total, total_content = own.copy(), own_content.copy()
    for k in range(count - 1, 0, -1):
        for sums in (total, total_content, linked):
            sums[parents[k]] += sums[k]
    region, dropped, in_main = [False] * count, [False] * count, [False] * count
    for k in range(count):
        above = parents[k]
        in_main[k] = page.kinds[k] in MAIN or (k > 0 and in_main[above])
        mostly = 2 * total_content[k] >= total[k] > 0
        if k and (dropped[above] or region[above]):
            other = page.apart[k] or (2 * linked[k] > total[k] and not in_main[k])
            dropped[k] = dropped[above] or (other and not mostly)
            region[k] = not dropped[k]
        else:
            region[k] = 2 * own_content[k] >= own[k] > 0 or (page.kinds[k] in MAIN and mostly)
    kept = [region[line.inside] for line in page.lines]
    if not any(kept):
        return content
    for k in range(len(kept) - 2, -1, -1):
        if kept[k + 1] and page.lines[k].tag in HEADINGS and not dropped[page.lines[k].inside] and page.shares[page.lines[k].inside] == page.shares[page.lines[k + 1].inside]:
            kept[k] = True
    return kept


def main_text(html: str) -> str:
    """The main text of a page, its blocks joined by line feeds."""
    page = PageLines()
    page.feed(html)
    lines = page.finish()
    if not lines:
        return ""
    kept = regions(page, content_lines(lines, page.shares))
    return "\n".join(line.text for line, stays in zip(lines, kept, strict=True) if stays)


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", keep: tuple[str, ...] = ("page_id", "url"), reader: Callable[[str], str] = main_text) -> DataFrame:
    """The columns ``keep`` of each page and its main text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([reader(h) for h in batch.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*keep, text_col])

    rows = pages.select(*keep, text_or_empty(html_col).alias("html_source"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, `{text_col}` string")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
