"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines, one for each block element; elements that can't belong to
an article by their kind (menus, page footers, asides, forms, scripts), role or whole
class name (adverts, comments) go with it. The lengths of the lines' text, without that
of links, summed over sliding windows of lines, show where text surges and where it
dives to nothing; the lines between the two are the main text. Where a page says what its
articles are, each of them has a distribution of its own, in which any text is a surge:
only what lies before the first and after the last of its text, lines of links, is left
out. Elsewhere a stretch must surge to 86 characters in three lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tabulith.llm.common import map_arrow, strings

#: Lines in a window, and the characters that a window must hold where text surges
#: (less where no window of the page has as many).
WINDOW, SURGE = 3, 86
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_COMMENT_END = re.compile(r"--!?>")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
_DROPPED = frozenset(
    "nav header footer aside form button select option input textarea fieldset script style noscript template iframe object embed applet svg canvas audio video map dialog menu head title datalist".split()
)
_MAIN = frozenset(("article", "main"))
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split()
)
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Whole class names and identifiers of what is no part of an article.
_NOISE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle adslot ad-slot ad-unit ad-box ad-container ad-wrapper ad-banner ad-label ads-container google-ad"
    " banner-ad text-ad sponsored sponsored-content comments comment comment-list commentlist comments-area comment-section comments-section reader-comments user-comments disqus_thread"
    " sidebar side-bar menu main-menu nav navbar navigation breadcrumb breadcrumbs cookie-notice cookie-banner cookie-consent cookies newsletter newsletter-signup share-buttons"
    " social-share pagination pager site-header site-footer page-header page-footer".split()
)
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())


def _is_noise(name: str, raw: str) -> bool:
    """Whether an element's attributes say that it is no part of an article."""
    if "=" not in raw and "hidden" not in raw:
        return False
    for key, *values in _ATTRIBUTE.findall(raw):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if key == "role" and value.strip() in _NOISE_ROLES:
            return True
        if key in ("class", "id") and name not in ("html", "body", "main") and not _NOISE.isdisjoint(value.split()):
            return True
    return False


class _Lines:
    """The block lines of one page: text, characters that count (outside links, or in a heading), number of the main element (0: none).

    One scan; every element is opened and closed once, whatever the nesting.
    """

    def __init__(self, html: str) -> None:
        self.found: list[tuple[str, int, int]] = []
        self.text: list[str] = []
        self.weight = 0
        self.mains = 0
        self.main_of_text = 0
        # open elements: name, whether text in it is dropped, its main element, whether it is a link, whether it is in a heading
        self.open: list[tuple[str, bool, int, bool, bool]] = [("", False, 0, False, False)]
        # where the open elements of each name are, and those that neither an inline element nor a paragraph is
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]
        self._read(html)
        self._end_line()

    def _end_line(self) -> None:
        line = " ".join("".join(self.text).split())
        if line:
            self.found.append((line, self.weight, self.main_of_text))
        self.text, self.weight = [], 0

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            begin = html.find("<", at)
            begin = end if begin < 0 else begin
            if begin > at:
                self._say(html[at:begin])
            if begin == end:
                return
            tag = _TAG.match(html, begin)
            if tag:
                at = self._end_of_tag(html, tag.end())
                name = tag[2].lower()
                if tag[1]:
                    self._close(name)
                    continue
                self._start(name, html[tag.end() : at])
                if name in _RAW and self.open[-1][0] == name:
                    close = _RAW[name].search(html, at)
                    at = close.start() if close else end
            elif html.startswith("<!--", begin):
                if html.startswith((">", "->"), begin + 4):
                    at = html.find(">", begin) + 1
                else:
                    close = _COMMENT_END.search(html, begin + 4)
                    at = close.end() if close else end
            elif html.startswith(("<!", "<?", "</"), begin):
                close = html.find(">", begin)
                at = end if close < 0 else close + 1
            else:
                self._say("<")
                at = begin + 1

    def _end_of_tag(self, html: str, at: int) -> int:
        """One past a tag's end. A quote that nothing closes is a sign like any other."""
        while stop := _STOP.search(html, at):
            if stop[0] == ">":
                return stop.end()
            close = html.find(stop[0], stop.end())
            if close < 0:
                close = html.find(">", stop.end()) - 1
                if close < 0:
                    return len(html)
            at = close + 1
        return len(html)

    def _say(self, words: str) -> None:
        _, dropped, main, link, heading = self.open[-1]
        if dropped:
            return
        if "&" in words:
            words = unescape(words)
        if self.text and main != self.main_of_text:
            self._end_line()
        self.main_of_text = main
        self.text.append(words)
        if heading or not link:
            self.weight += len("".join(words.split()))

    def _push(self, name: str, dropped: bool, main: int, link: bool, heading: bool) -> None:
        self.places.setdefault(name, []).append(len(self.open))
        if name not in _INLINE and name != "p":
            self.blocks.append(len(self.open))
        self.open.append((name, dropped, main, link, heading))

    def _pop_to(self, k: int) -> None:
        for name, *_ in self.open[k:]:
            self.places[name].pop()
        del self.open[k:]
        while self.blocks[-1] >= k:
            self.blocks.pop()

    def _start(self, name: str, raw: str) -> None:
        if name == "br":
            self.text.append(" ")
            return
        if name not in _INLINE:
            self._end_line()
        if name in _VOID:
            return
        if name in _ENDS_P:
            self._close_implied(("p",))
        if name in _SAME:
            self._close_implied(_SAME[name])
        noise = _is_noise(name, raw)
        if name in _MAIN and not noise:
            # an element that should have ended before an article begins
            k = len(self.open)
            while k > 1 and self.open[k - 1][1]:
                k -= 1
            self._pop_to(k)
        above, dropped, main, link, heading = self.open[-1]
        if name in _MAIN and not dropped and not noise and not main:
            self.mains += 1
            main = self.mains
        heading = heading or name in _HEADING
        if not dropped and name in _DROPPED:
            # the heading of an article may stand in a header of its own
            self._push(name, True, main if name == "header" and main > 0 else -1, link, heading)
        elif dropped and name in _HEADING and above == "header" and main > 0:
            self._push(name, noise, main, link, heading)
        else:
            self._push(name, dropped or noise, main, link or name == "a", heading)

    def _last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else 0

    def _close_implied(self, names: Iterable[str]) -> None:
        """Closes the last of ``names``, if no other block was opened in it."""
        k = max(map(self._last, names))
        if k and k >= self.blocks[-1]:
            self._pop_to(k)
            self._end_line()

    def _close(self, name: str) -> None:
        if name not in _INLINE:
            self._end_line()
        k = self._last(name)
        if not k or (name in _INLINE and (k < self.blocks[-1] or k < self._last("p"))):
            return
        self._pop_to(k)


def between_surge_and_dive(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """The first and one past the last line of every stretch of text, in order.

    Block i is the text of lines i to i + window - 1. A stretch goes from where blocks
    hold text to where a whole block holds nothing, and must surge: hold ``surge``
    characters in a block, or as many as the richest block of all if that is fewer.
    """
    n = len(lengths)
    blocks = [sum(lengths[i : i + window]) for i in range(n)]
    least = min(surge, max(blocks, default=0))
    spans, i = [], 0
    while i < n and least > 0:
        if not blocks[i]:
            i += 1
            continue
        begin = i
        while i < n and blocks[i]:
            i += 1
        if max(blocks[begin:i]) >= least:
            end = i
            while not lengths[begin]:
                begin += 1
            while not lengths[end - 1]:
                end -= 1
            spans.append((begin, end))
    return spans


def main_text(html: str | None) -> str:
    """The main text of a page, a line for each block; empty if there is none.

    All articles of a page come in order, each from its first surge to its last dive; one
    of links alone comes whole. A page without any has the richest of its stretches.
    """
    found = _Lines(html or "").found
    lines: list[str] = []
    articles: dict[int, list[tuple[str, int]]] = {}
    for text, weight, main in found:
        if main > 0:
            articles.setdefault(main, []).append((text, weight))
    for own in articles.values():
        spans = between_surge_and_dive([weight for _, weight in own], surge=1) or [(0, len(own))]
        lines += [text for text, _ in own[spans[0][0] : spans[-1][1]]]
    if not articles:
        lengths = [weight for _, weight, _ in found]
        spans = between_surge_and_dive(lengths)
        if spans:
            begin, end = max(spans, key=lambda s: (sum(lengths[slice(*s)]), -s[0]))
            lines = [text for text, _, _ in found[begin:end]]
    return "\n".join(lines)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of every row of ``pages``.

    Reads ``page_id``, ``url`` and ``html``, whatever else is there. A null or empty page,
    and one without text outside menus and the like, has an empty text. Repeated rows are
    read each. An empty table gives no rows. One pass, no shuffle; memory is that of the
    longest page, time grows in line with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in strings(batch.column("html"))]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_arrow(pages.select("page_id", "url", "html"), run, f"page_id {kind}, url string, text string, n_chars long")
