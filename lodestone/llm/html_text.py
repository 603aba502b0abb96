"""Main text of HTML pages: parser events, text-to-tag ratios, Gaussian smoothing and threshold clustering."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common as C

#: Elements without an end, those that end a block of text, those that hold regions, and those whose text is never read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
HOLDERS = frozenset("article aside blockquote body div fieldset figure footer form header html main nav section table td".split())
NEVER = frozenset("aside audio button canvas datalist dialog footer form head iframe math menu nav noscript object option script select style svg template textarea title video".split())
MAIN = frozenset("article main".split())
#: Words in class or id, and roles, of what isn't the article; the words of PAGE only outside an article.
BOILER = frozenset("ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus gdpr login menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: Words that may stand beside one of BOILER in a name inside an article, and words that an id there may have for itself: it
#: often names a section of the text.
BESIDE = frozenset("area bar block bottom box btn button buttons center container content feed field footer form group header icon icons inline inner item items left link links list main media message module outer panel post posts reader right row section site slot space text thread title toolbar top unit user view wrap wrapper zone".split())
ANCHORS = frozenset("banner login menu modal notice notices promotion reply respond share sharing social subscription".split())
PAGE = frozenset("copyright footer header legal masthead site title top".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Reach and width of the smoothing in blocks; a region's peak must come to this share of the ratios' standard deviation.
REACH, SIGMA, SHARE = 2, 1.0, 0.5
#: Ratios count in the deviation up to this many scaled median deviations over the median of those above 0.
SPREAD = 3.0
#: A marked section that opens with a name and a bracket, and the end of a declaration's inner part.
SECTION, INNER_END = re.compile(r"<!\[[^\[\]<>]*\["), re.compile(r"\]\s*>")
#: Holders that stand inside running text: one that is only a link is no menu.
RUNNING = frozenset("blockquote figure table td".split())
#: A line inside an article that ends in one of these is a sentence, though all of it be a link.
SENTENCE_ENDS = frozenset(".!?;:…。！？»”\"'")
PARTS = re.compile(r"[a-z]+")
SPLIT_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Lines(HTMLParser):
    """Parser events as lines, one for each block of text: (text, tags since the line before, characters inside links, region, inside an article)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.open: list[tuple[str, bool, int, bool]] = []  # name, unread, region, inside an article
        self.text: list[str] = []
        self.names: Counter[str] = Counter()  # of open
        self.tags = self.linked = 0
        self.regions = [""]  # the element of each region
        self.first: tuple[int, bool] | None = None

    def _now(self) -> tuple[str, bool, int, bool]:
        return self.open[-1] if self.open else ("", False, 0, False)

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            region, main = self.first or (0, False)
            linked = 0 if main and text[-1] in SENTENCE_ENDS and " " in text else self.linked
            self.lines.append((text, self.tags, min(linked, len(text)), region, main))
            self.tags = 0
        self.text, self.linked, self.first = [], 0, None

    def _unread(self, tag: str, attrs: dict[str, str | None], main: bool) -> bool:
        if tag in NEVER or tag == "header" and not main or "hidden" in attrs or attrs.get("aria-hidden") == "true" or (attrs.get("role") or "").lower() in ROLES:
            return True
        if "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
            return True
        named = " ".join(SPLIT_CASE.sub(" ", attrs.get(x) or "").lower() for x in ("class", "id"))
        words = set(PARTS.findall(named))
        if tag in ("html", "body", "main"):
            return False
        if tag == "article":
            return bool(words & {"comment", "comments", "reply", "ad", "ads", "advert", "promo", "sponsored", "related"})
        if main:
            return self._marked(attrs)
        return bool(words & BOILER) or bool(words & (PAGE - {"title", "site", "top"}))

    @staticmethod
    def _marked(attrs: dict[str, str | None]) -> bool:
        """Whether one whole name in class or id is a word of BOILER, with words of BESIDE or more such words at most."""
        for x in ("class", "id"):
            for name in (attrs.get(x) or "").split():
                words = set(PARTS.findall(SPLIT_CASE.sub(" ", name).lower()))
                own = words & BOILER
                if own and words <= BOILER | BESIDE and not (x == "id" and own == words and own <= ANCHORS):
                    return True
        return False

    def parse_comment(self, i: int, report: int = 1) -> int:
        """As the standard parser, but `<!-->` and `<!--->` are whole comments, and one without an end goes to the page's end."""
        for whole in ("<!-->", "<!--->"):
            if self.rawdata.startswith(whole, i):
                return i + len(whole)
        end = super().parse_comment(i, report)
        return end if end >= 0 else len(self.rawdata)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
            return
        if tag in BLOCKS:
            self.end_line()
            if tag == "p" or tag in HOLDERS or tag[0] == "h" and tag[1:].isdigit():  # an open paragraph ends here
                self._close("p", HOLDERS)
            elif tag == "li":
                self._close("li", frozenset(("ul", "ol", "menu")))
        if tag in VOID:
            return
        _, unread, region, main = self._now()
        if tag in HOLDERS:
            region = len(self.regions)
            self.regions.append(tag)
        self.names[tag] += 1
        self.open.append((tag, unread or self._unread(tag, dict(attrs), main), region, main or tag in MAIN))

    def _close(self, tag: str, within: frozenset[str] = frozenset()) -> None:
        """Closes the last open element of that name, if it is open inside the last of within, and all in it."""
        if not self.names[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.names.subtract(x[0] for x in self.open[i:])
                del self.open[i:]
                return
            if self.open[i][0] in within:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        self._close(tag)

    def parse_html_declaration(self, i: int) -> int:
        """As the standard parser, but a document type with an inner part ends behind that, and any marked section is passed over."""
        raw = self.rawdata
        if raw.startswith("<![", i):
            section = SECTION.match(raw, i)
            end = raw.find("]]>" if section else ">", i)
            if end < 0 and section:
                end, section = raw.find(">", i), None
            return len(raw) if end < 0 else end + (3 if section else 1)
        if raw[i : i + 9].lower() == "<!doctype" and 0 <= raw.find("[", i) < raw.find(">", i) and (end := INNER_END.search(raw, i)):
            return end.end()
        return super().parse_html_declaration(i)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        _, unread, region, main = self._now()
        if unread:
            return
        if self.first is None and not data.isspace():
            self.first = region, main
        self.text.append(data)
        if self.names["a"]:
            self.linked += len(data)


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """A Gaussian mean over REACH neighbours on each side; at the ends over those that there are."""
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    full = np.convolve(ratios, kernel)[REACH : REACH + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[REACH : REACH + len(ratios)]


def deviation(ratios: np.ndarray) -> float:
    """The ratios' standard deviation, where one far above the others counts as SPREAD scaled median deviations over their median."""
    own = ratios[ratios > 0]
    if not len(own):
        return 0.0
    middle = float(np.median(own))
    return float(np.minimum(ratios, middle + SPREAD * 1.4826 * float(np.median(np.abs(own - middle)))).std())


def main_text(html: str | None) -> str:
    """The blocks of the content regions in page order, joined by two line ends; empty for a null or empty page or one without content.

    A line's ratio is its characters outside links over the tags since the line before; ratios are smoothed over the
    neighbouring lines. A region, the lines that one element holds without a break, is content if its peak comes to SHARE
    of the ratios' deviation (the region with the highest peak always is), unless most of its text is links.
    Where a region inside article or main is content, all there count but those of links (cells, quotes and sentences of links
    stay), and no others. Declarations and marked sections of any form are passed over, and a comment without an end reaches
    to the page's end."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = parser.lines
    if not lines:
        return ""
    ratios = np.array([(len(t) - linked) / max(1, tags) for t, tags, linked, _, _ in lines])
    smooth = smoothed(ratios)
    least = min(SHARE * deviation(ratios), float(smooth.max()))
    found, inside, at = [], [], 0
    for (region, main), run in groupby(lines, key=lambda x: (x[3], x[4])):
        own = list(run)
        peak = float(smooth[at : at + len(own)].max())
        at += len(own)
        if main and parser.regions[region] in RUNNING or sum(x[2] for x in own) <= 0.5 * sum(len(x[0]) for x in own):
            if main:
                inside.append((main, [x[0] for x in own]))
            if peak >= least:
                found.append((main, [x[0] for x in own]))
    if any(main for main, _ in found):
        found = inside
    return "\n\n".join(t for _, own in found for t in own)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars (code points) in place of html_col, row by row: repeated rows come out alike, an empty table gives no rows; columns named text or n_chars are replaced."""
    C.small_batches(pages.sparkSession)

    rows = pages.select(*[c for c in pages.columns if c not in ("text", "n_chars") or c == html_col])
    rest = [c for c in rows.columns if c != html_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*rest, "text", "n_chars"])

    schema = rows.select(*rest, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return rows.select(*rest, html_col).mapInArrow(work, schema)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract() of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


QUERIES = {"op6_html": op6_html}
SQL: dict[str, str] = {}
