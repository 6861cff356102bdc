"""Main text of web pages: text-to-tag ratio of lines, Gaussian smoothing, threshold clustering.

Standard-library parser events cut a page into lines at block elements; head, p, li,
dt, dd and the parts of tables close where HTML closes them without an end tag. Elements
that are page furniture by tag, role, class or id are dropped with all that they
hold. The text-to-tag ratios of the other lines are smoothed along the page and
split in two clusters at the threshold where a two-means iteration settles; the
dense cluster marks content. An element whose class or id only has a furniture word
beside others is dropped if less than half of its text is dense. The region is the
innermost article, main, section, division or body that holds all of the content, or
the article or main around it, and every line of it is kept, so neither a dense line
nor a short paragraph between long ones is ever lost; where there is no article or main, headlines and
paragraphs beside it are kept too. A form is dropped unless it holds most of the page's text.

Defined results: a null or empty page, or one with furniture only, gives an empty
text; unclosed and misnested tags close with the element around them; a page cut off
in the middle keeps what came before; repeated rows and an empty table are as any
other; further columns of the input are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed HTML element names.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img".split())
FURNITURE = frozenset("script style noscript template nav footer aside button select textarea input option iframe object svg canvas dialog menu head title".split())
REGIONS = frozenset("article main section div body td".split())
#: Words of a class, id or role that mark furniture.
MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer "
    "login masthead menu modal nav navbar navigation newsletter notice popup promo promoted related reply replies respond share sharing sidebar signup "
    "social sponsor sponsored subscribe toolbar widget".split()
)
#: Standard deviation of the smoothing, in lines.
SIGMA = 1.0
#: Elements that stay in an open head; those that close an open p, and those that an open p ends at.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
ENDS_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing "
    "main menu nav ol p pre search section summary table ul xmp".split()
)
AROUND_P = frozenset("applet button caption html marquee object table td template th".split())
#: Elements that an open li, dt or dd ends at.
AROUND_ITEM = frozenset(
    "applet article aside blockquote body button caption center details dir dl fieldset figcaption figure footer form header hgroup html iframe main marquee "
    "menu nav object ol pre search section select summary table tbody td template tfoot th thead tr ul".split()
)
ITEMS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}
#: Where a part of a table belongs: what is open within that closes.
GROUPS = frozenset("table tbody tfoot thead".split())
PARTS = {"tr": GROUPS, "td": GROUPS | {"tr"}, "th": GROUPS | {"tr"}} | {t: frozenset(["table"]) for t in ("caption", "colgroup", "tbody", "tfoot", "thead")}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_WORDS = re.compile(r"[a-z]+")


class _Lines(HTMLParser):
    """Lines of a page: text, tags met in it, the innermost region and the innermost doubtful element around it.

    Regions and doubtful elements are numbered as they open, so each is greater than what it
    is in, and what is in it has the numbers up to its last one. Counts of open elements by
    tag spare a search for one that is not open, so a page takes time in proportion to its length.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []
        self.count: Counter[str] = Counter()
        self.off = 0
        self.doubts: list[int] = [0]
        self.doubt_in: list[int] = [0]
        self.wholes: set[int] = set()
        self.regions: list[int] = [0]
        self.region_in: list[int] = [0]
        self.region_last: dict[int, int] = {}
        self.blocks: list[str] = [""]
        self.form = self.forms = 0
        self.parts: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, int, int]] = []
        self.form_of: list[int] = []
        self.block_of: list[str] = []

    def _cut(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.tags, self.regions[-1], self.doubts[-1]))
                self.form_of.append(self.form)
                self.block_of.append(self.blocks[-1])
            self.parts = []
        self.tags = 0

    def _furniture(self, tag: str, attrs: list[tuple[str, str | None]]) -> float:
        """1 for page furniture, 0.5 for what only has a word of it in a longer name, else 0."""
        if tag in FURNITURE:
            return 1
        if tag == "header":
            return not (self.count["article"] or self.count["main"])
        if tag in ("html", "body"):
            return 0
        marks = frozenset(["comment"]) if tag in ("article", "main") else MARKS
        out = 0.0
        for key, value in attrs:
            value = (value or "").lower()
            if marks is MARKS and (key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value)):
                return 1
            if key == "class" or marks is MARKS and key in ("id", "role"):
                for name in value.split():
                    words = _WORDS.findall(name)
                    if words and marks.issuperset(words):
                        return 1
                    if not marks.isdisjoint(words):
                        out = 0.5
        return out

    def _pop(self) -> str:
        name, off, doubt = self.open.pop()
        self.count[name] -= 1
        self.off -= off
        if doubt:
            self.doubts.pop()
        if name not in INLINE:
            self.blocks.pop()
        if name == "form" and not self.count["form"]:
            self.form = 0
        if name in REGIONS:
            self.region_last[self.regions.pop()] = len(self.region_in) - 1
        return name

    def _ends(self, tags: frozenset[str], around: frozenset[str]) -> None:
        """Close the innermost open element of ``tags`` that is not outside one of ``around``."""
        if not any(self.count[t] for t in tags):
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                while len(self.open) > k:
                    self._pop()
                return
            if self.open[k][0] in around:
                return

    def _implied(self, tag: str) -> None:
        """Close what HTML closes where ``tag`` starts."""
        if self.open and self.open[-1][0] == "head" and tag not in IN_HEAD:
            self._pop()
        if tag in ITEMS:
            self._ends(ITEMS[tag], AROUND_ITEM)
        if tag in ENDS_P:
            self._ends(frozenset(["p"]), AROUND_P)
        if tag in PARTS and any(self.count[t] for t in PARTS[tag]):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in PARTS[tag]:
                    while len(self.open) > k + 1:
                        self._pop()
                    break
                if self.open[k][0] in ("table", "template"):
                    break

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag not in INLINE
        if block:
            self._cut()
        self._implied(tag)
        self.tags += 1
        if tag in VOID:
            return
        found = self._furniture(tag, attrs)
        off, doubt = found == 1, 0
        if found == 0.5:
            doubt = len(self.doubt_in)
            self.doubt_in.append(self.doubts[-1])
            self.doubts.append(doubt)
        self.off += off
        self.open.append((tag, off, doubt))
        self.count[tag] += 1
        if block:
            self.blocks.append(tag)
        if tag == "form" and not self.form:
            self.forms += 1
            self.form = self.forms
        if tag in REGIONS:
            region = len(self.region_in)
            self.region_in.append(self.regions[-1])
            self.regions.append(region)
            if tag in ("article", "main"):
                self.wholes.add(region)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._cut()
        self.tags += 1
        self._ends(frozenset([tag]), AROUND_P if tag == "p" else frozenset())

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and not data.isspace():
            self._pop()
        if not self.off:
            self.parts.append(data)

    def close(self) -> None:
        super().close()
        self._cut()


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """``values`` under a Gaussian kernel, normalised at both ends."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(values, kernel, "full")[reach : reach + len(values)] / np.convolve(np.ones(len(values)), kernel, "full")[reach : reach + len(values)]


def dense(values: np.ndarray) -> np.ndarray:
    """Mark the upper of two clusters: the threshold halves the means of its two sides."""
    cut = values.mean()
    for _ in range(50):
        high, low = values[values >= cut], values[values < cut]
        if not len(low) or not len(high):
            break
        new = (high.mean() + low.mean()) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return values >= cut


def main_text(html: str | None) -> str:
    """The article of one page; empty if there is none."""
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.close()
    lines, blocks = page.lines, page.block_of
    if page.forms:
        # A form is furniture, unless the page is built inside it: then most of the text is.
        size = Counter()
        for form, (text, *_) in zip(page.form_of, lines, strict=True):
            size[form] += len(text)
        total = sum(size.values())
        fine = [form == 0 or 2 * size[form] > total for form in page.form_of]
        lines, blocks = ([x for x, f in zip(y, fine, strict=True) if f] for y in (lines, blocks))
    if not lines:
        return ""
    lengths = np.array([len(text) for text, *_ in lines], float)
    ratio = lengths / np.maximum(1, [tags for _, tags, *_ in lines])
    content = dense(smoothed(ratio))
    # Text that is dense, less text that is not, in each doubtful element.
    weight = [0.0] * len(page.doubt_in)
    for mark, size, (*_, doubt) in zip(content, lengths, lines, strict=True):
        weight[doubt] += size if mark else -size
    for doubt in range(len(weight) - 1, 0, -1):
        weight[page.doubt_in[doubt]] += weight[doubt]
    stays = [True] * len(weight)
    for doubt in range(1, len(weight)):
        stays[doubt] = stays[page.doubt_in[doubt]] and weight[doubt] >= 0
    kept = [(text, mark, region, block) for mark, block, (text, _, region, doubt) in zip(content, blocks, lines, strict=True) if stays[doubt]]
    marked = [region for _, mark, region, _ in kept if mark] or [region for *_, region, _ in kept]
    if not marked:
        return ""
    # Regions that hold all of the marked lines; the greatest number is the innermost.
    held = [0] * len(page.region_in)
    for region in marked:
        held[region] += 1
    for region in range(len(held) - 1, 0, -1):
        held[page.region_in[region]] += held[region]
    common = [region for region, n in enumerate(held) if n == len(marked)]
    best = next((r for r in reversed(common) if r in page.wholes), common[-1])
    last = page.region_last.get(best, len(held) - 1)
    # Without an article or main, a headline or paragraph beside the region belongs to it too.
    beside = ("h1", "p") if best not in page.wholes else ()
    return " ".join(text for text, _, region, block in kept if best <= region <= last or block in beside)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with the main text and its length in code points."""
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(_texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
