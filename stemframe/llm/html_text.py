"""Main text of web pages by two-pass block rules.

A page becomes a sequence of blocks. The first pass judges each block by itself, adding up what speaks for and
against it: its share of stop words, its length, the share of its text inside links, and the marks of what
encloses it (an element or name for articles, a name that is often used for furniture). Clear sums decide; short
blocks, headings and even sums stay open. What a page says outright is no text (``nav``, ``footer``, hidden
elements, whole names such as ``advert`` or ``comments``) is bad; but an element that the article itself is in is a
wrapper, whatever it is called, and that is decided when the whole page is known.

The second pass gives open blocks the label of the nearest decided ones: a heading that of what follows, a block
of an article that of the article's own blocks, and a block between two different labels that of the nearer.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common function words of four languages, and element names of HTML.
STOP_WORDS = frozenset("""
the of and to a in is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your which their if will each about how up out them then she many some so these would other into has more her two him see could no than been its who now my made over did down only way use may he you i
le la les un une des du de et est en que qui dans pour pas au aux sur se ce il elle ne par avec plus son sa ses ou mais nous vous leur cette comme tout
der die das und ist in zu den von mit sich des dem nicht ein eine auf als auch es an er so dass im für sie aus bei nach wie werden wird oder einer sind noch einem hat
el los las y en un una que es por con para del al lo como su se no sus este pero esta entre cuando muy sin sobre ser son dos hay todo desde
""".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
SKIPPED = RAW | frozenset("object svg math canvas audio video select button".split())
CONTAINERS = frozenset("html body main article section div nav header footer aside form ul ol dl table thead tbody tfoot tr td th figure blockquote details dialog menu fieldset address head center".split())
LEAVES = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 pre caption figcaption summary".split())
BLOCKS = CONTAINERS | LEAVES | frozenset("hr legend option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset("nav footer menu dialog head".split())
BESIDE = frozenset("aside fieldset".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_WHERE = r"(?:(?:top|bottom|left|right|side|main|site|page|header|footer|inline|sticky|primary|secondary|google|reader|user)[_-])?"
_PART = r"(?:[_-](?:slot|unit|box|banner|bar|block|area|list|section|links?|thread|form|body|text|container|item|widget|popup|notice|consent|signup|toggle|\d+))?"
#: Whole names of furniture, with a word for where it is or for a part of it at most.
NAMED = re.compile(
    _WHERE + r"(?:ads?|adverts?|advertisements?|advertising|adsense|adslot|cookies?|gdpr|newsletter|popup|modal|sidebar|navbar|nav|navigation|breadcrumbs?|pagination|pager|disqus|sponsored|sponsor|promo|menu|comments?|commentlist|replies)" + _PART + r"|comments?[_-]content|skip[_-]link",
    re.I,
)
#: Whole names of the page's head and foot; within an article they may hold its title.
EDGE = re.compile(_WHERE + r"(?:header|footer|masthead|topbar)" + _PART, re.I)
#: Names that furniture often has, but that parts of a text may have as well.
OFTEN = re.compile(r"(?:^|[\s_-])(banner|consent|notices?|notifications?|overlay|subscribe|subscription|widget|share|sharing|social|related|recommended|login|signup|signin|search|copyright|disclaimer|toolbar|alert|promo\w*|sponsor\w*|teaser|tags?|byline|meta)(?=$|[\s_-])", re.I)
#: Names by which pages mark their text: the text itself, and a wider part around it.
ARTICLE_NAMES = frozenset("article article-body article-content articlebody article__body post-body post-content entry-content story-body".split())
WIDER_NAMES = frozenset("main main-content page-content content post entry story".split())

ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"""["'>]""")
WORD = re.compile(r"[^\W\d_]+")

#: Blocks below SHORT characters stay open, those from LONG on speak for themselves; above LINKS a block is a menu;
#: from STOPS on the share of stop words is that of prose, below FEW that of something else.
SHORT, LONG, LINKS, STOPS, FEW = 70, 200, 0.33, 0.15, 0.05


class Suspect:
    """An element that an element name, a role or a name calls furniture. ``prose`` is what it holds of the page's text outside links.

    Suspects are decided on when the page is known: one that the article is in is a wrapper, whatever its name.
    """

    __slots__ = ("outer", "prose", "marked", "furniture")

    def __init__(self, outer: Suspect | None):
        self.outer, self.prose, self.marked, self.furniture = outer, 0, 0, True


class Place:
    """What encloses a block: whether it is hidden, the innermost suspect, doubts by name (1 for a part of a name, 2 for all of it), and the nearest mark of an article."""

    __slots__ = ("hidden", "suspect", "doubts", "mark", "region", "form")

    def __init__(self, hidden: bool, suspect: Suspect | None, doubts: int, mark: int, region: int, form: list | None):
        self.hidden, self.suspect, self.doubts, self.mark, self.region, self.form = hidden, suspect, doubts, mark, region, form


class Block:
    __slots__ = ("text", "linked", "heading", "place", "words", "stops")

    def __init__(self, text: str, linked: int, heading: bool, place: Place):
        self.text, self.linked, self.heading, self.place = text, linked, heading, place
        words = WORD.findall(text.lower())
        self.words, self.stops = len(words), sum(w in STOP_WORDS for w in words)

    @property
    def shown(self) -> bool:
        """Not in a hidden element or a form."""
        return not self.place.hidden and (self.place.form is None or self.place.form[0])

    @property
    def outright(self) -> bool:
        return not self.shown or (self.place.suspect is not None and self.place.suspect.furniture)

    @property
    def menu(self) -> bool:
        return self.linked > LINKS * len(self.text)


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)} if source.strip(" /") else {}


def _inside(tag: str, attributes: dict[str, str], outer: Place, region: int) -> Place:
    """The place inside an element. An id of a paragraph or heading is an anchor and says nothing."""
    role, classes = attributes.get("role", "").lower(), attributes.get("class", "")
    names = classes if tag in LEAVES else f"{classes} {attributes.get('id', '')}".strip()
    tokens, page = set(names.lower().split()), tag in ("html", "body")
    mark = 2 if tag == "article" or role == "article" or tokens & ARTICLE_NAMES else 1 if tag == "main" or role == "main" or tokens & WIDER_NAMES else 0
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(HIDDEN.search(attributes.get("style", "")))
    suspect = tag in FURNITURE or role in FURNITURE_ROLES or (not page and any(map(NAMED.fullmatch, tokens)))
    beside = tag in BESIDE
    if not outer.mark and not mark and not page:
        suspect = suspect or beside or tag == "header" or any(map(EDGE.fullmatch, tokens))
    often = [] if mark or page else [m.lower() for m in OFTEN.findall(names)]
    doubts = 2 if beside or tokens & set(often) else 1 if often else 0
    if mark < outer.mark:
        mark, region = outer.mark, outer.region
    elif not mark:
        region = outer.region
    return Place(outer.hidden or hidden, Suspect(outer.suspect) if suspect else outer.suspect, max(outer.doubts, doubts), mark, region, outer.form)


def _decide(found: list[Block]) -> None:
    """Which suspects are furniture: all but a wrapper, if there is one, and what is a wrapper within it.

    A wrapper holds an article, and half of the page's text at least; or three quarters of it on a page without marks. It
    is looked for only where no marked text stands outside of suspects.
    """
    shown = [b for b in found if b.shown]
    mark = max((b.place.mark for b in shown), default=0)
    if mark and any(b.place.suspect is None and b.place.mark == mark and len(b.text) >= SHORT and not b.menu for b in shown):
        return
    total, suspects = 0, {}
    for b in shown:
        prose = max(0, len(b.text) - b.linked)
        total += prose
        if (s := b.place.suspect) is not None:
            s.prose += prose
            s.marked += prose * (b.place.mark == mark > 0)
            while s is not None and id(s) not in suspects:
                suspects[id(s)] = s
                s = s.outer
    # Inner suspects come before outer ones here, once sorted by depth; sums go outwards along chains seen once.
    depth: dict[int, int] = {}
    for s in suspects.values():
        chain = []
        while s is not None and id(s) not in depth:
            chain.append(s)
            s = s.outer
        base = depth[id(s)] if s is not None else 0
        for k, x in enumerate(reversed(chain)):
            depth[id(x)] = base + k + 1
    inwards = sorted(suspects.values(), key=lambda s: depth[id(s)])
    for s in reversed(inwards):
        if s.outer is not None:
            s.outer.prose += s.prose
            s.outer.marked += s.marked
    best = max((s for s in inwards if s.outer is None), key=lambda s: s.prose, default=None)
    if best is None or not best.prose or not (2 * best.prose >= total and best.marked if mark else 4 * best.prose >= 3 * total):
        return
    for s in inwards:
        inside = s is best or s.outer is not None and not s.outer.furniture
        s.furniture = not (inside and 2 * s.prose > best.prose)


class _Scanner:
    """Tags and text of a source in order; no character is looked at more than a few times."""

    def __init__(self, source: str):
        self.source, self.end = source, len(source)
        self.last = {c: source.rfind(c) for c in "\"'>"}
        self.quotes = True  # as long as no quote was left open
        self.unclosed: set[str] = set()

    def tag_end(self, at: int) -> int:
        """Place of the > that ends the tag open at ``at``, outside of quotes; at most one search per page fails."""
        i = at
        while self.quotes:
            m = STOP.search(self.source, i)
            if m is None:
                self.quotes = False
            elif m[0] == ">":
                return m.start()
            elif m.start() >= self.last[m[0]]:
                self.quotes = False
            else:
                i = self.source.find(m[0], m.end()) + 1
        return self.source.find(">", at)

    def over(self, tag: str, at: int) -> int:
        """Place after the end of an element without tags of interest; the page's end, or at once where it has no end."""
        m = None if tag in self.unclosed else re.compile(rf"</{re.escape(tag)}(?![\w-])", re.I).search(self.source, at)
        if m is None:
            self.unclosed.add(tag)
            return self.end if tag in RAW else at
        close = self.source.find(">", m.end())
        return self.end if close < 0 else close + 1

    def __iter__(self):
        """(text, tag, closing, attributes) with one of text and tag empty."""
        source, at = self.source, 0
        while at < self.end:
            lt = source.find("<", at)
            if lt < 0 or lt > self.last[">"]:
                open_comment = source.find("<!--", at)
                yield source[at : open_comment if open_comment >= 0 else self.end], "", False, ""
                return
            if lt > at:
                yield source[at:lt], "", False, ""
            if source.startswith("<!--", lt):
                over = source.find("-->", lt + 4)
                at = self.end if over < 0 else over + 3
                continue
            if source.startswith(("<!", "<?"), lt):
                at = source.find(">", lt) + 1
                continue
            closing = source.startswith("</", lt)
            name = NAME.match(source, lt + 1 + closing)
            if name is None:
                yield "<", "", False, ""
                at = lt + 1
                continue
            gt = self.tag_end(name.end())
            if gt < 0:
                yield source[lt:], "", False, ""
                return
            tag, at = name[0].lower(), gt + 1
            if tag in SKIPPED:
                if not closing and (tag in RAW or source[gt - 1] != "/"):
                    at = self.over(tag, at)
                continue
            yield "", tag, closing, source[name.end() : gt]


def blocks(source: str) -> list[Block]:
    """The blocks of a page in order, each with its place."""
    found: list[Block] = []
    outside = Place(False, None, 0, 0, 0, None)
    stack: list[tuple[str, Place]] = []
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = regions = 0
    in_link = broken = False
    leaf, at_leaf, form = "", None, None

    def here() -> Place:
        return at_leaf or (stack[-1][1] if stack else outside)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            found.append(Block(text, linked, leaf in HEADINGS, here()))
        parts.clear()
        linked = 0

    def pop() -> str:
        nonlocal form
        tag, _ = stack.pop()
        opened[tag] -= 1
        if tag == "form":
            form = None
        return tag

    for raw, tag, closing, attributes in _Scanner(source):
        if not tag:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if text.strip():
                broken = False
            if in_link:
                linked += len(" ".join(text.split()))
        elif tag == "a":
            in_link = not closing
        elif tag == "br":
            if broken:  # two line breaks in a row end a block
                flush()
            parts.append(" ")
            broken = True
        elif tag in BLOCKS:
            flush()
            leaf, at_leaf, broken = "", None, False
            if tag in CONTAINERS and closing:
                if opened.get(tag):
                    while pop() != tag:
                        pass
                in_link = False
            elif tag in CONTAINERS:
                if tag == "body" and opened.get("head"):
                    while pop() != "head":
                        pass
                if tag == "form" and form is not None:
                    continue
                regions += 1
                place = _inside(tag, _attributes(attributes), here(), regions)
                if tag == "form":
                    # A form is furniture, unless it is put around the page.
                    form = place.form = [False]
                elif form is not None and (place.mark and place.region == regions or tag in ("nav", "header", "footer")):
                    form[0] = True
                stack.append((tag, place))
                opened[tag] = opened.get(tag, 0) + 1
            elif not closing and tag in LEAVES:
                leaf = tag
                regions += 1
                at_leaf = _inside(tag, _attributes(attributes), here(), regions) if attributes.strip(" /") else None
    flush()
    _decide(found)
    return found


def _first_pass(b: Block, mark: int) -> str:
    """good, bad or open; ``mark`` is the strongest mark of an article on the page."""
    if b.outright:
        return "bad"
    speaks = (2 if b.place.mark == mark else 0 if b.place.mark else -2) if mark else 0
    speaks -= 2 * min(b.place.doubts, 1) + 2 * b.menu
    if b.heading or len(b.text) < SHORT:
        # Little text under such a name is furniture even within an article; a heading may head more.
        return "bad" if speaks <= -2 and (b.menu or b.place.doubts) or b.place.doubts > 1 and not b.heading else "open"
    share = b.stops / max(b.words, 1)
    speaks += 2 if share >= STOPS else -1 if share < FEW else 1
    speaks += len(b.text) >= LONG
    return "good" if speaks > 0 else "bad" if speaks < 0 else "open"


def _nearest(found: list[Block], labels: list[str], anchor) -> tuple[list, list]:
    """By block, the nearest decided blocks before and after that ``anchor(block)`` admits, within one group each."""
    before, after = [None] * len(found), [None] * len(found)
    for order, out in ((range(len(found)), before), (range(len(found) - 1, -1, -1), after)):
        last: dict = {}
        for i in order:
            group = anchor(found[i])
            out[i] = last.get(group)
            if labels[i] != "open" and group is not None:
                last[group] = i
    return before, after


def labelled(source: str | None) -> list[tuple[Block, bool]]:
    """The blocks of a page, each with whether it is main text."""
    found = blocks(source or "")
    mark = max((b.place.mark for b in found if not b.outright), default=0)
    labels = [_first_pass(b, mark) for b in found]
    if "good" not in labels:
        # Without a clear block, the open one with most stop words is the text.
        best = max((b.stops for b, x in zip(found, labels) if x == "open"), default=0)
        if best >= 2:
            labels[[x == "open" and b.stops == best for b, x in zip(found, labels)].index(True)] = "good"
    inside = lambda b: mark > 0 and b.place.mark == mark
    # Within an article only its own blocks count, without what is no text outright or stands beside the text.
    own = _nearest(found, labels, lambda b: b.place.region if inside(b) and not b.outright and b.place.doubts < 2 else None)
    any_ = _nearest(found, labels, lambda b: 0)
    out = []
    for i, (b, x) in enumerate(zip(found, labels)):
        if x == "open":
            before, after = own if inside(b) else any_
            a, z = before[i], after[i]
            if a is None and z is None:
                x = "good" if inside(b) or not mark and not b.menu else "bad"
            elif a is None or z is None:
                x = labels[z if a is None else a]
            elif b.heading or labels[a] == labels[z]:
                x = labels[z]  # a heading belongs to what follows
            else:
                x = "good" if i - a == z - i else labels[a if i - a < z - i else z]
        out.append((b, x == "good"))
    return out


def main_text(source: str | None) -> str:
    """The kept blocks of a page, one a line; empty for a null page or one without main text."""
    return "\n".join(b.text for b, kept in labelled(source) if kept)


def _extracted(batches):
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per input row: page_id, url, text, n_chars (code points). No shuffle.

    * A null or empty page gives an empty text; a page cut off anywhere gives what it holds up to there.
    * A page of any length takes time in proportion to it.
    * Null ids and urls and repeated rows are carried through; an empty table gives no rows; other columns are
      ignored and may have any name.
    * Of two different labels at equal distance, an open block takes the good one.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
