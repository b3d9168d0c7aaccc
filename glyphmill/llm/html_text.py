"""Operator 7: main text of web pages by the distribution of line blocks.

Markup is stripped into lines, one for each block of the page, and every line weighs its characters of text. What the page says of itself changes
the weights. Lines in elements that hold no article text (menus, headers, footers, sidebars, dialogs, forms, controls), or in ones whose
class, id or role is a plain name of such a thing, weigh nothing; where that element turns out to hold the page's main element, its heading or
most of its text, as a form or a layout may, its names count for nothing. Names that may be words of an article just as well (discussion, related,
search ...) or that come with other words (related-work) are evidence only: with other words none, alone they halve the weight. Names never
speak against an article or main element, unless it is one of comments or teasers beside another. If the page marks its article, lines outside
weigh nothing; if not, lines that are mostly links do.

Over the weights slides a window of DEPTH lines. Where its sum reaches SURGE the text surges, and where it is nothing the text has dived:
the lines between the last dive before the first surge and the end that weigh something are the text, and so is a doubtful element only where
its own windows surge. In a marked article all lines that weigh something surge, and on a page without a surge the weighty lines are the text.

Defined results: null and empty html, and pages without text, give the empty string and 0; end tags may be missing, as HTML
allows, and elements that are never closed hide nothing; a page of any length is read whole; repeated rows are extracted
each; rows without an id or url keep their nulls; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Lines in the sliding window, and the characters in it that make a surge outside a marked article; what a doubtful character weighs.
DEPTH, SURGE, DOUBT = 3, 60, 0.5
#: A line outside a marked article whose share of link text is larger weighs nothing.
LINKS = 0.5
#: A form with a larger share of the page's text is the page. An article inside main with a smaller share of its text is not the whole.
WRAPS = 0.5
#: The same share of an element named like a part of a layout.
LAYOUT_WRAPS = 0.8

_TAG = re.compile(r"<!--|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_NAMES = re.compile(r"(?<![\w:.-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_MAIN = re.compile(r"(?<![\w:.-])role\s*=\s*[\"']?main\b(?![\w-])", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements that stand in a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noframes xmp".split())
#: Elements that show no text of their own, and those of them that hold no blocks.
CONTROLS = frozenset("button select option optgroup datalist noscript template svg iframe object canvas math audio video map".split())
SHALLOW = frozenset("button select option optgroup datalist".split())
#: Elements of the page's head.
HEAD = frozenset("title meta link script style base noscript template".split())
#: Elements that hold no article text.
OUTSIDE = frozenset("nav aside footer menu dialog".split())
#: Words in class, id or role that mark the same: of a layout, which may wrap the article; of other things; and those that articles use as well.
LAYOUT = frozenset("nav navbar navigation menu footer sidebar widget toolbar pagination pager breadcrumb breadcrumbs copyright complementary contentinfo overlay".split())
MARKS = LAYOUT | frozenset("ad ads adv advert adverts advertisement advertising promo sponsor sponsored banner cookie cookies consent notice popup modal newsletter subscribe teaser teasers comment comments disqus login signup".split())
DOUBTFUL = frozenset("social share sharing search related recommended reply replies respond discussion".split())
#: Words that say where or in what form a thing is, not what it is about.
FORMS = frozenset("a s area article articles bar block body bottom box btn button buttons col column columns container content count desktop entry fb fixed footer form global group head header icon icons inline inner item items left link links list lower main middle mobile module nav outer page panel post posts primary right row section secondary set site slot small sticky story tab tabs text thread threads title top unit upper view wp wrap wrapper zone".split())
HEADERS = frozenset(["header", "masthead"])
#: First words of names that tell of something else: what a page has or lacks, and what a post is about.
ABOUT = frozenset("has no with without not is hide show js supports category tag topic term format type status".split())
NEVER = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
#: What the start of an element ends: those of its name that are open in the nearest of the elements after the colon.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}


@dataclass(eq=False)
class Zone:
    """An element without article text, or a doubtful one: why, and what it wraps."""

    why: str
    article: bool = False
    main: bool = False
    heading: bool = False

    def wraps(self, lenient: bool) -> bool:
        """A zone around the main element or the heading is a layout; leniently, so is one around an article, but for comments and teasers."""
        if self.why in ("element", "header"):
            return self.main
        return self.main or self.heading or lenient and self.article and self.why in ("layout", "form", "doubtful")


@dataclass
class Line:
    text: str
    linked: int
    zones: tuple[Zone, ...]
    article: int
    main: bool


def words_of(name: str) -> list[str]:
    """The words of a name; two known ones that are written together are two."""
    out = []
    for part in (p.lower() for p in _PARTS.findall(name)):
        known = MARKS | DOUBTFUL
        cut = next((k for k in range(2, len(part) - 1) if part[:k] in known and part[k:] in FORMS or part[:k] in FORMS and part[k:] in known), 0) if part not in known | FORMS else 0
        out += [part[:cut], part[cut:]] if cut else [part]
    return out


def named(attributes: str, in_article: bool) -> str:
    """What the names of an element say of it: named (a plain name of what is no article), layout, doubtful, or an empty string."""
    found = set()
    for given in _NAMES.findall(attributes):
        for name in "".join(given).split():
            words = words_of(name)
            if not words or words[0] in ABOUT:
                continue
            marks, doubts = MARKS.intersection(words), DOUBTFUL.intersection(words)
            plain = FORMS.union(MARKS, DOUBTFUL).issuperset(words)
            if marks and plain:
                found.add("layout" if LAYOUT & marks else "named")
            elif marks or doubts and plain:
                found.add("doubtful")
            elif not in_article and not HEADERS.isdisjoint(words):
                found.add("layout")
    return next((why for why in ("named", "layout", "doubtful") if why in found), "")


def tag_after(html: str, at: int) -> int:
    return after.start() if (after := _TAG.search(html, at)) else len(html)


class Page:
    """The lines of a page, read tag by tag with a stack of open elements."""

    def __init__(self, html: str):
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.linked = 0
        self.in_link = False
        self.stack: list[tuple[str, Zone | None, bool]] = []
        self.mains = 0
        self.open: Counter[str] = Counter()
        self.zones: tuple[Zone, ...] = ()
        self.articles = self.hidden = 0
        self.read(html)
        self.flush()

    def flush(self) -> None:
        if self.text:
            joined = " ".join(unescape("".join(self.text)).split())
            if joined:
                self.lines.append(Line(joined, self.linked, self.zones, self.articles if self.open["article"] else 0, self.mains > 0))
            self.text = []
        self.linked = 0

    def add(self, piece: str) -> None:
        if self.hidden:
            return
        self.text.append(piece)
        if self.in_link:
            self.linked += len(" ".join(unescape(piece).split()))

    def push(self, name: str, zone: Zone | None = None, main: bool = False) -> None:
        self.stack.append((name, zone, main))
        self.mains += main
        self.open[name] += 1
        self.hidden += name in CONTROLS
        if zone:
            self.zones += (zone,)

    def pop(self) -> str:
        name, zone, main = self.stack.pop()
        self.mains -= main
        self.open[name] -= 1
        self.hidden -= name in CONTROLS
        if zone:
            self.zones = self.zones[:-1]
        return name

    def pop_to(self, names: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        """Closes the innermost of names, and all in it, unless it is outside the innermost of within."""
        if any(self.open[n] for n in names):
            for name, _, _ in reversed(self.stack):
                if name in within:
                    return
                if name in names:
                    while self.pop() not in names:
                        pass
                    return

    def read(self, html: str) -> None:
        low, last, end = html.lower(), {}, 0
        closes = lambda name, at: last.setdefault(name, low.rfind(f"</{name}")) > at
        while m := _TAG.search(html, end):
            if m.start() > end:
                self.add(html[end : m.start()])
            end = m.end()
            if not m[2]:
                if m[0] == "<!--":
                    end = close + 3 if (close := html.find("-->", end)) >= 0 else end
                continue
            name, closing = m[2].lower(), bool(m[1])
            if name in RAW and not closing:
                if closes(name, end):
                    close = low.find(f"</{name}", end)
                    end = len(html) if (stop := html.find(">", close)) < 0 else stop + 1
                else:  # never closed: what comes before the next tag is lost
                    end = tag_after(html, end)
                self.text.append(" ")
            elif self.hidden and name not in CONTROLS and self.innermost() not in SHALLOW:
                continue  # markup of a drawing, a formula or an embedded thing
            elif name in INLINE or "-" in name or ":" in name:
                if name == "a":
                    self.in_link = not closing
                elif name == "br":
                    self.text.append(" ")
            elif name in CONTROLS:
                self.text.append(" ")
                if closing:
                    self.pop_to((name,))
                elif closes(name, end) and not m[3].endswith("/"):
                    self.push(name)
                elif name in SHALLOW:
                    end = tag_after(html, end)
            else:
                self.split(name, closing)
                if not closing and name not in VOID:
                    self.start(name, m[3])
        if end < len(html):
            self.add(html[end:])

    def innermost(self) -> str:
        return next(n for n, _, _ in reversed(self.stack) if n in CONTROLS)

    def split(self, name: str, closing: bool) -> None:
        """Ends the line, and the elements that a tag closes."""
        self.flush()
        self.in_link = False
        if closing:
            self.pop_to((name,))
        else:
            if self.open["head"] and name not in HEAD:
                self.pop_to(("head",))
            while self.hidden and self.stack[-1][0] in SHALLOW:
                self.pop()
            self.pop_to(("p",), ("td", "th", "li", "object", "button"))
            if name in ENDS:
                self.pop_to(*ENDS[name])

    def start(self, name: str, attributes: str) -> None:
        """Opens an element; one with article text in it tells the zones around."""
        in_article = self.open["article"] > 0
        main = name == "main" or bool(attributes) and bool(_MAIN.search(attributes))
        why = ""
        if main:
            pass
        elif name == "head" or name in OUTSIDE:
            why = "element"
        elif name == "form":
            why = "form"
        elif name == "header" and not in_article:
            why = "header"
        elif name == "article":
            why = "beside" if attributes and named(attributes, in_article) == "named" else ""
        elif name not in NEVER and attributes:
            why = named(attributes, in_article)
            if why == "doubtful" and in_article and name == "section":
                why = ""  # a section of the article, by what it is about
        if attributes.endswith("/"):
            return
        if not why or why == "beside":
            for zone in self.zones:
                zone.article |= name == "article"
                zone.main |= main
                zone.heading |= name == "h1"
            if name == "article" and not in_article:
                self.articles += 1
        self.push(name, Zone(why) if why else None, main)


def lines(html: str) -> list[tuple[str, int, bool, bool, Zone | None]]:
    """(text, characters in links, outside, in the article, the doubtful element around it) of each block of a page, in order."""
    rows = Page(html).lines
    zones = list({id(z): z for r in rows for z in r.zones}.values())
    # An article named like a comment or a teaser is one if there is another article.
    if not any(r.article and not r.zones for r in rows):
        for zone in zones:
            zone.main |= zone.why == "beside"
    for lenient in (False, True):
        for zone in zones:
            if zone.why in ("form", "layout", "doubtful") and (zone.why == "form" or not any((r.article or r.main) and zone not in r.zones for r in rows)):
                held = [r for r in rows if zone in r.zones and all(z is zone or z.wraps(lenient) for z in r.zones)]
                zone.main |= sum(len(r.text) - r.linked for r in held) > (WRAPS if zone.why == "form" else LAYOUT_WRAPS) * sum(len(r.text) for r in rows)
        inside = [all(z.why == "doubtful" or z.wraps(lenient) for z in r.zones) for r in rows]
        if any(ok and r.article for r, ok in zip(rows, inside, strict=True)) or not any(r.article for r in rows):
            break
    doubts = [next((z for z in r.zones if z.why == "doubtful" and not z.wraps(lenient)), None) for r in rows]
    size = lambda test: sum(len(r.text) for r, ok in zip(rows, inside, strict=True) if ok and test(r))
    main, article = size(lambda r: r.main), size(lambda r: r.article)
    if main and size(lambda r: r.main and r.article) < WRAPS * main:
        chosen = [r.main for r in rows]
    elif article:
        chosen = [r.article > 0 for r in rows]
    else:
        return [(r.text, r.linked, not ok, False, z) for r, ok, z in zip(rows, inside, doubts, strict=True)]
    return [(r.text, r.linked, not (ok and c), c, z) for r, ok, c, z in zip(rows, inside, chosen, doubts, strict=True)]


def windows(weight: list[float]) -> list[float]:
    return [sum(weight[k : k + DEPTH]) for k in range(len(weight))]


def extract(html: str) -> str:
    """The weighty lines from the last dive before the first surge on, doubtful elements only where they surge themselves, joined by empty lines."""
    rows = lines(html)
    weight = []
    for text, linked, out, article, doubt in rows:
        own = 0 if out or linked > LINKS * len(text) and (doubt or not article) else len(text)
        weight.append(own if doubt is None else DOUBT * (own and own - linked))
    for zone in {id(z): z for *_, z in rows if z}.values():
        at = [k for k, r in enumerate(rows) if r[4] is zone]
        if max(windows([weight[k] for k in at])) < SURGE:
            for k in at:
                weight[k] = 0
    sums = windows(weight)
    first = next((k for k, (_, _, _, article, _) in enumerate(rows) if weight[k] > 0 and sums[k] >= (1 if article else SURGE)), 0)
    start = next((k + DEPTH for k in range(first - DEPTH, -1, -1) if sums[k] == 0), 0)
    return "\n\n".join(r[0] for k, r in enumerate(rows) if k >= start and weight[k])


def main_texts(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns keep of pages with text and n_chars."""
    schema = pages.select(*keep).schema
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(batches):
            texts = [extract(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, common.text_or_empty(html).alias(common.unused(pages.select(*keep), "__html")[0])).mapInArrow(run, out)


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return main_texts(common.table(spark, sf_dir, "pages"))
