"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser sends events; blocks of text are the page's lines.  A line's ratio is its
characters over the tags around it.  The ratios are smoothed along the page with a Gaussian, and a two-means
threshold parts dense lines from sparse ones.  Lines belong to regions: the outermost article or main element,
or else the innermost sectioning container.  A region is content if it holds a dense line, and then its lines are
kept, short ones too, but for

* parts that their element, role, id or class marks as menus, headers, footers, sidebars, notices, adverts, forms,
  scripts, styles or reader comments;
* containers inside an article whose text is for the greater part in sparse lines and in links: menus that nothing
  marks.

With article or main elements on the page, other regions count only if together they have more dense text than the
longest article has, and then articles count that have a dense line and are at least half as long as the longest
other region.

A mark is a word of a class, id or role; inside an article it must be a whole class or id (or all its words but
general ones like ``box`` and ``list``), and the ids of headings and paragraphs are no marks.  A form is a page's
own wrapping, not a mark, if it holds most of the text.

Elements need not be closed: inline markup and paragraphs are never on the stack, an end tag closes what is
open inside its element.  An article or main inside a menu, advert or notice that is closed after it belongs to
that part, unless it is longer than all other text; one inside an unclosed part is the page's.

Defined results: null or empty html gives empty text; character references are decoded; white space in a block
becomes one space, and blocks are joined by one space; repeated rows each get their row; an empty table gives an
empty table.  Broken markup stops nothing and takes time in proportion to the page's length, however long: a
declaration such as ``<![if x]>`` ends at the next ``>``; a comment that never ends is none; a tag whose ``>`` never
comes is text; a quote in a tag that is never closed is taken out.  If quotes around all later ``>`` keep a tag open, it
and later tags like it lose their own quotes; quotes in text stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.session import prepared

SIGMA = 1.5
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("head title script style noscript template svg math iframe object canvas audio video map".split())
_APART = frozenset("nav footer aside form dialog menu select button textarea fieldset".split())
_TRACKED = frozenset("div section article main header ul ol dl table td th body figure details blockquote center".split()) | _NEVER | _APART
_REGIONS = frozenset("div section td body center".split())
#: Words of a class, id or role that mark a part as not the article's.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements adsense adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox newsletter subscribe subscription signup signin login paywall sidebar sidebars rail widget widgets nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager masthead topbar toolbar footer footnav copyright legal comments comment commentlist disqus respond replies reply share sharing social related recommended recommendations teaser trending popular search searchbox skip hidden contentinfo complementary alertdialog form".split()
)
_COMMENTS = frozenset("comments comment commentlist disqus respond replies reply".split())
#: Words that say nothing of a part beside a mark.
_PLAIN = frozenset("box block list wrap wrapper container bar links buttons posts items icons unit slot section inner outer".split())
_TEXT = frozenset("h1 h2 h3 h4 h5 h6 p".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _mark(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> str | None:
    """Why a part isn't the article's; ``form`` of a form that nothing else marks."""
    if tag in _NEVER or tag in _APART and tag != "form":
        return tag
    if tag == "form":
        return _mark("div", [(k, re.sub("form", " ", v or "", flags=re.I)) if k in ("class", "id", "role") else (k, v) for k, v in attrs], inside) or tag
    if tag == "header" and not inside:
        return tag
    if not attrs or tag in ("html", "body", "article", "main") and not any(k == "class" or k == "id" for k, _ in attrs):
        return None
    for name, value in attrs:
        if name in ("class", "id", "role"):
            if inside and name != "role":
                if name == "id" and tag in _TEXT:
                    continue
                tokens = [{w.lower() for w in _WORD.findall(t)} for t in (value or "").split()]
                words = set().union(*(t for t in tokens if t <= _MARKS | _PLAIN))
            else:
                words = {w.lower() for w in _WORD.findall(value or "")}
            found = words & _MARKS if tag not in ("html", "body", "main") else set()
            if tag == "article":
                found &= _COMMENTS
            if found:
                return "comment" if found & _COMMENTS else min(found)
            if "header" in words and not inside and tag not in ("html", "body"):
                return "header"
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value or ""):
            return "hidden"
    return None


_ATTRIBUTES = r"""(?:[\s/]++|=[\s=]*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+)|[^\s/>=]++)*+"""
_RAW = "|".join(rf"(?i:<{name}(?=[\s/>]){_ATTRIBUTES}>(?>.*?</\s*{name}\s*>|.*+))" for name in ("script", "style"))
#: Markup that the parser gets through in one pass.
_SOUND = re.compile(
    rf"""(?:[^<]++
    | <(?![!?/A-Za-z])
    | <!--(?>.*?--\s*>)
    | <!(?i:doctype)[^>]*+>
    | </[^>]*+>
    | {_RAW}
    | <(?!(?i:script|style)[\s/>])[A-Za-z][^\s/>]*+{_ATTRIBUTES}>
    )*+""",
    re.S | re.X,
)


_TAG = re.compile(rf"<[A-Za-z][^\s/>]*+{_ATTRIBUTES}")
_WHOLE = re.compile(_TAG.pattern + ">")
_QUOTE, _MARKUP = re.compile("[\"']"), re.compile("<[A-Za-z][^>]*+>")


def repaired(html: str) -> str:
    """The page without what the parser can't read or reads again and again; sound pages stay as they are.

    A quote that is never closed is the last of its kind, so there are two such places at most; a tag that never ends
    as its quotes pair up with later ones is mended with all later ones, once.
    """
    out, at = [], 0
    while True:
        end = _SOUND.match(html, at).end()
        out.append(html[at:end])
        if end == len(html):
            return "".join(out)
        close = html.find(">", end)
        if html.startswith("<!--", end):  # none of the later ones ends either
            html, at = html[end:].replace("<!--", " "), 0
        elif close < 0:
            return "".join([*out, html[end:].replace("<", "&lt;")])
        elif html[end + 1] in "!?":
            at = close + 1
        else:
            stop = _TAG.match(html, end).end()
            if stop < len(html):
                quote = _QUOTE.search(html, stop).start()
                html, at = html[end:quote] + " " + html[quote + 1 :], 0
            else:
                last = html.rfind(">") + 1
                html, at = _MARKUP.sub(lambda m: m[0] if _WHOLE.fullmatch(m[0]) else _QUOTE.sub(" ", m[0]), html[end:last]) + html[last:], 0


class Lines(HTMLParser):
    """Collects every block's text, tags, length in links and part; parts are the tracked elements, numbered from 1.

    Decisions about parts follow when the page is read, as whether a part is closed, or holds most text, is only
    known then.  A part's number is greater than that of the part around it.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.around, self.mark, self.region, self.own = [0], [None], [0], [False]
        self.closed = [False]
        self.stack: list[tuple[str, int, int]] = []  # tag, part, unread before it
        self.open: Counter[str] = Counter()
        self.pieces: list[str] = []
        self.tags = self.links = self.unread = self.part = 0
        self.linked = False

    def flush(self) -> None:
        if self.pieces:
            if text := " ".join("".join(self.pieces).split()):
                self.lines.append((text, self.tags, self.links, self.part))
                self.tags = 0
            self.pieces, self.links = [], 0

    def pop(self) -> str:
        tag, ended, self.unread = self.stack.pop()
        self.part = self.around[ended]
        self.ended = ended
        self.open[tag] -= 1
        return tag

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag not in _INLINE:
            self.flush()
        if tag == "a":
            self.linked = True
        if tag in _VOID:
            return
        if tag in ("p", "li") and self.open[tag] and self.stack[-1][0] == tag:
            self.pop()
        inside = self.own[self.region[self.part]]
        mark = _mark(tag, attrs, inside)
        if tag not in _TRACKED and mark is None and not self.open[tag]:
            return
        if mark is not None:
            self.flush()
        new = len(self.around)
        article = tag in ("article", "main") and not inside
        self.around.append(self.part)
        self.mark.append(mark)
        self.closed.append(False)
        self.own.append(article)
        self.region.append(new if article or tag in _REGIONS and not inside else self.region[self.part])
        self.stack.append((tag, new, self.unread))
        self.open[tag] += 1
        self.part = new
        self.unread += mark in _NEVER

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in _INLINE:
            self.flush()
        if tag == "a":
            self.linked = False
        if self.open[tag]:
            self.flush()
            while self.pop() != tag:
                pass
            self.closed[self.ended] = True

    def handle_data(self, data: str) -> None:
        if not self.unread:
            self.pieces.append(data)
            self.links += len(data) if self.linked else 0

    def unmarked(self) -> list[tuple[str, int, int, int]]:
        """The lines that are in no marked part; tags around the others count for the next line."""
        n = len(self.around)
        dropped, hard, shut, doubtful = ([False] * n for _ in range(4))
        for p in range(1, n):
            q, mark = self.around[p], self.mark[p]
            marked = mark is not None and mark != "form"
            hard[p] = hard[q] or mark in _NEVER or mark in ("comment", "hidden")
            shut[p] = shut[q] or marked and self.closed[p]
            dropped[p], doubtful[p] = dropped[q] or marked, doubtful[q]
            if dropped[q] and not hard[q] and not marked and self.own[p]:
                # an article that begins inside a marked part
                dropped[p], doubtful[p] = False, shut[q]
        held = [0] * n
        for text, *_, p in self.lines:
            held[p] += 0 if dropped[p] else len(text)
        for p in range(n - 1, 0, -1):
            held[self.around[p]] += held[p]
        wraps = [2 * h > held[0] for h in held]
        for p in range(1, n):
            dropped[p] = dropped[p] or self.mark[p] == "form" and not wraps[p] or dropped[self.around[p]] and not self.own[p]
        length = [0] * n
        for text, *_, p in self.lines:
            length[self.region[p]] += 0 if dropped[p] else len(text)
        sure = sum(len(text) for text, *_, p in self.lines if not dropped[p] and not doubtful[p])
        out, tags_before = [], 0
        for text, tags, links, p in self.lines:
            tags_before += tags
            if not dropped[p] and not (doubtful[p] and length[self.region[p]] <= sure):
                out.append((text, tags_before, links, p))
                tags_before = 0
        return out

    def menus(self, lines: list[tuple[str, int, int, int]], dense: np.ndarray) -> list[bool]:
        """Whether each part lies in a container of an article whose text is mostly in sparse lines and in links."""
        n = len(self.around)
        size, links, thick = [0] * n, [0] * n, [0] * n
        for (text, _, linked, p), ok in zip(lines, dense.tolist(), strict=True):
            size[p] += len(text)
            links[p] += linked
            thick[p] += len(text) if ok else 0
        for p in range(n - 1, 0, -1):
            for count in (size, links, thick):
                count[self.around[p]] += count[p]
        out = [False] * n
        for p in range(1, n):
            inner = self.own[self.region[p]] and self.region[p] != p
            out[p] = out[self.around[p]] or inner and 2 * thick[p] < size[p] < 2 * links[p]
        return out


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing, normalised at the ends."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(values, kernel)[reach:-reach] / np.convolve(np.ones(len(values)), kernel)[reach:-reach]


def threshold(values: np.ndarray) -> float:
    """The border between the two means that values fall around; the least value if they are all alike."""
    low, high = values.min(), values.max()
    for _ in range(20):
        border = (low + high) / 2
        upper = values >= border
        if upper.all() or not upper.any():
            return float(values.min())
        new = values[~upper].mean(), values[upper].mean()
        if new == (low, high):
            break
        low, high = new
    return float((low + high) / 2)


def dense_lines(lines: list[tuple[str, int, int, int]]) -> np.ndarray:
    """Whether each line's smoothed text-to-tag ratio, on a logarithmic scale, is over the threshold."""
    ratio = np.log1p(smoothed(np.array([len(text) / max(tags, 1) for text, tags, *_ in lines])))
    return ratio >= threshold(ratio)


def main_text(html: str) -> str:
    """The text of a page's article."""
    page = Lines()
    page.feed(repaired(html))
    page.close()
    page.flush()
    lines = page.unmarked()
    if not lines:
        return ""
    dense = dense_lines(lines)
    thick, size = Counter(), Counter()
    for (text, *_, p), ok in zip(lines, dense.tolist(), strict=True):
        size[page.region[p]] += len(text)
        thick[page.region[p]] += len(text) if ok else 0
    articles, others = ({r: n for r, n in size.items() if page.own[r] == own} for own in (True, False))
    if not articles or sum(thick[r] for r in others) > max(articles.values()):
        longest = max(others.values())
        articles = others | {r: n for r, n in articles.items() if 2 * n >= longest}
    chosen = {r for r in articles if thick[r]} | {max(articles, key=articles.__getitem__)}
    menu = page.menus(lines, dense)
    kept = [text for text, *_, p in lines if page.region[p] in chosen and not menu[p]]
    return " ".join(kept or [text for text, *_, p in lines if page.region[p] in chosen])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(page_id, the kept columns, text, n_chars) of every row."""
    prepared(pages.sparkSession)
    source = pages.select(F.col(id_col).alias("page_id"), *keep, F.col(html_col).alias("html"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py() or "") for h in b.column(b.num_columns - 1)]
            yield pa.record_batch([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return source.mapInArrow(run, schema)
