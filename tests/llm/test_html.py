"""HTML extraction against a slow version over a parsed tree, on given and made pages, and its time on hostile ones."""

import random
import re
import time
from html.parser import HTMLParser

import pytest

from stemframe.llm import html_text as H

SF = "/root/testdata/sf0.01"
# This version's own lists: what calls an element furniture, and what speaks for an article.
BLOCKS = set("html body main article section div nav header footer aside form ul ol dl table thead tbody tfoot tr td th figure blockquote details dialog menu fieldset address head center p li dt dd h1 h2 h3 h4 h5 h6 pre caption figcaption summary hr legend option".split())
LEAVES = set("p li dt dd h1 h2 h3 h4 h5 h6 pre caption figcaption summary".split())
CONTAINERS = BLOCKS - LEAVES - {"hr", "legend", "option"}
UNSEEN = set("script style textarea title noscript iframe template object svg math canvas audio video select button".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
WHERE = set("top bottom left right side main site page header footer inline sticky primary secondary google reader user".split())
PART = set("slot unit box banner bar block area list section link links thread form body text container item widget popup notice consent signup toggle".split())
CORE = set("ad ads advert adverts advertisement advertisements advertising adsense adslot cookie cookies gdpr newsletter popup modal sidebar navbar nav navigation breadcrumb breadcrumbs pagination pager disqus sponsored sponsor promo menu comment comments commentlist replies".split())
ENDS = set("header footer masthead topbar".split())
DOUBT = set("banner consent notice notices notification notifications overlay subscribe subscription widget share sharing social related recommended login signup signin search copyright disclaimer toolbar alert teaser tag tags byline meta".split())
ARTICLES = set("article article-body article-content articlebody article__body post-body post-content entry-content story-body".split())
WIDER = set("main main-content page-content content post entry story".split())


def called(token, cores):
    """Is the whole name one of the cores, with at most a place before it and a part after it."""
    parts = re.split("[-_]", token)
    for before in (0, 1):
        for after in (0, 1):
            rest = parts[before : len(parts) - after]
            if len(rest) == 1 and rest[0] in cores and (not before or parts[0] in WHERE) and (not after or parts[-1] in PART or parts[-1].isdigit()):
                return True
    return False


def furniture_name(token):
    return called(token, CORE) or token in ("skip-link", "skip_link", "comment-content", "comments-content", "comment_content", "comments_content")
VOID = {"br", "hr", "img", "meta", "link", "input"}


class Tree(HTMLParser):
    """Elements as [tag, attributes, parent]; leaves of text in order with their element."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.at = ["root", {}, None]
        self.texts = []  # (element, text) and (element, None) where a block ends
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            while self.at[0] in LEAVES:  # a block within p or h1 ends it
                self.at = self.at[2]
            self.texts.append((None, None))
        if tag in VOID:
            return
        self.at = [tag, {k: v or "" for k, v in attrs}, self.at]
        outer = max((own_mark(e) for e in chain(self.at[2])), default=0)
        if tag in CONTAINERS and (tag in ("nav", "header", "footer") or 0 < own_mark(self.at) >= outer):
            for e in chain(self.at[2]):
                e[1]["around"] = ""

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.texts.append((None, None))
        up = self.at
        while up and up[0] != tag:
            up = up[2]
        if up:
            self.at = up[2]

    def handle_data(self, data):
        self.texts.append((self.at, data))


def chain(element):
    while element is not None:
        yield element
        element = element[2]


def names_of(e):
    return (e[1].get("class", "") if e[0] in LEAVES else f"{e[1].get('class', '')} {e[1].get('id', '')}").lower().split()


def own_mark(e):
    if e[0] == "article" or e[1].get("role") == "article" or ARTICLES & set(names_of(e)):
        return 2
    return int(e[0] == "main" or e[1].get("role") == "main" or bool(WIDER & set(names_of(e))))


def doubts_of(e):
    found = 0
    for token in names_of(e):
        parts = re.split("[-_]", token)
        if token in DOUBT or len(parts) == 1 and token.startswith(("promo", "sponsor")):
            found = 2
        elif any(x in DOUBT or x.startswith(("promo", "sponsor")) for x in parts):
            found = max(found, 1)
    return found


def described(blocks):
    """(text, linked, heading, outright, doubtful, mark, region) of each block, by walks up the tree."""
    rows = []
    for parts in blocks:
        up = list(chain(parts[0][0]))
        if any(e[0] in UNSEEN for e in up):
            continue
        text = " ".join("".join(t for _, t in parts).split())
        if not text:
            continue
        up = [e for e in up if e[0] in BLOCKS]
        linked = sum(len(" ".join(t.split())) for e, t in parts if any(x[0] == "a" for x in chain(e)))
        mark = max((own_mark(e) for e in up), default=0)
        region = next((id(e) for e in up if own_mark(e) == mark), 0) if mark else 0
        unseen, doubtful, suspects = False, 0, []
        for k, e in enumerate(up):
            page = e[0] in ("html", "body")
            above = max((own_mark(x) for x in up[k:]), default=0)
            unseen |= "hidden" in e[1] or e[0] == "form" and "around" not in e[1]
            named = not page and any(map(furniture_name, names_of(e)))
            at_an_end = not above and not page and (e[0] in ("header", "aside", "fieldset") or any(called(t, ENDS) for t in names_of(e)))
            if e[0] in ("nav", "footer", "menu", "dialog", "head") or e[1].get("role") in ROLES or named or at_an_end:
                suspects.append(id(e))
            doubtful = max(doubtful, 2 if e[0] in ("aside", "fieldset") else 0, 0 if own_mark(e) or page else doubts_of(e))
        leaf = up[0][0] if up else ""
        rows.append((text, linked, leaf in ("h1", "h2", "h3", "h4", "h5", "h6"), unseen, doubtful, mark, region, suspects))
    return [(*r[:3], r[3] or bool(set(r[7]) - wrappers_of(rows)), *r[4:7]) for r in rows] if rows else []


def wrappers_of(rows):
    """Suspects that the article is in."""
    seen = [r for r in rows if not r[3]]
    top = max((r[5] for r in seen), default=0)
    if top and any(not r[7] and r[5] == top and len(r[0]) >= 70 and r[1] <= 0.33 * len(r[0]) for r in seen):
        return set()
    held, marked, outermost, total = {}, {}, [], 0
    for r in seen:
        prose = max(0, len(r[0]) - r[1])
        total += prose
        for s in r[7]:
            held[s] = held.get(s, 0) + prose
            marked[s] = marked.get(s, 0) + prose * (r[5] == top and top > 0)
        outermost += r[7][-1:]
    best = max(dict.fromkeys(outermost), key=lambda s: held[s], default=None)
    if best is None or not held[best] or (not marked[best] or 2 * held[best] < total if top else 4 * held[best] < 3 * total):
        return set()
    return {s for r in seen if r[7][-1:] == [best] for s in r[7] if 2 * held[s] > held[best]}


def slow_text(source):
    blocks, now = [], []
    for e, t in Tree(source).texts:
        if e is None:
            blocks, now = blocks + [now] * bool(now), []
        else:
            now.append((e, t))
    found = described(blocks + [now] * bool(now))
    top = max((b[5] for b in found if not b[3]), default=0)

    def counts(text):
        words = re.findall(r"[^\W\d_]+", text.lower())
        return len(words), sum(w in H.STOP_WORDS for w in words)

    labels = []
    for text, linked, heading, outright, doubtful, mark, _ in found:
        words, stops = counts(text)
        menu = linked > 0.33 * len(text)
        score = 0 if not top else 2 if mark == top else -2 if not mark else 0
        score -= 2 * (doubtful > 0) + 2 * menu
        if outright:
            labels.append("bad")
        elif heading or len(text) < 70:
            labels.append("bad" if score <= -2 and (menu or doubtful) or doubtful == 2 and not heading else "open")
        else:
            share = stops / max(words, 1)
            score += (2 if share >= 0.15 else -1 if share < 0.05 else 1) + (len(text) >= 200)
            labels.append("good" if score > 0 else "bad" if score < 0 else "open")
    if "good" not in labels and any(x == "open" for x in labels):
        best = max(counts(b[0])[1] for b, x in zip(found, labels) if x == "open")
        if best >= 2:
            labels[next(i for i, b in enumerate(found) if labels[i] == "open" and counts(b[0])[1] == best)] = "good"
    kept = []
    for i, b in enumerate(found):
        label = labels[i]
        if label == "open":
            inside = top > 0 and b[5] == top
            peers = [j for j in range(len(found)) if labels[j] != "open" and (not inside or found[j][6] == b[6] and not found[j][3] and found[j][4] < 2)]
            lower, upper = [j for j in peers if j < i], [j for j in peers if j > i]
            if not peers:
                label = "good" if inside or not top and b[1] <= 0.33 * len(b[0]) else "bad"
            elif not lower or not upper:
                label = labels[(lower or upper)[-1] if lower else upper[0]]
            elif b[2]:
                label = labels[upper[0]]
            else:
                near, far = i - lower[-1], upper[0] - i
                ends = {labels[lower[-1]], labels[upper[0]]}
                label = ends.pop() if len(ends) == 1 else "good" if near == far else labels[lower[-1] if near < far else upper[0]]
        if label == "good":
            kept.append(b[0])
    return "\n".join(kept)


def made_page(rng):
    prose = lambda: " ".join(rng.choice("the of and to a in is that tree house river walks slowly green it for was quiet evening".split()) for _ in range(rng.randrange(1, 60)))
    odd = lambda: " ".join(f"x{rng.randrange(99)}q zzz" for _ in range(rng.randrange(1, 40)))
    name = lambda: rng.choice(["", "", "", ' class="has-sidebar"', ' class="main-menu"', ' class="promo"', ' class="related-work"', ' class="post-share"', ' class="ad"', ' id="comments"', ' class="entry-content"', ' class="header"', ' id="content"', ' class="notice"', ' role="search"', " hidden"])

    def block():
        text = rng.choice([prose, prose, odd])()
        kind = rng.randrange(7)
        if kind == 0:
            return "<ul>" + "".join(f'<li><a href="/{i}">{rng.choice(["Home", "About the house", text])}</a></li>' for i in range(rng.randrange(1, 4))) + "</ul>"
        if kind == 1:
            return f"<h2>{text[:40]}</h2>"
        if kind == 2:
            return f'<p{name()}>{text} <a href="x">{text[:20]}</a> &amp; {text[:30]}</p>'
        return f"<p{name()}>{text}</p>" if kind < 6 else f"<div{name()}>{text}</div>"

    def part(depth):
        tag = rng.choice(["div", "div", "section", "article", "main", "nav", "aside", "footer", "header", "form", "table"])
        inner = "".join(part(depth + 1) if depth < 3 and rng.random() < 0.3 else block() for _ in range(rng.randrange(1, 5)))
        return f"<{tag}{name()}>{inner}</{tag}>" if tag != "form" else f"<form>{block()}</form>"

    return "<html><head><title>no</title></head><body>" + "".join(part(0) for _ in range(rng.randrange(1, 5))) + "<script>if (a<b) x()</script></body></html>"


def test_rules_equal_the_slow_version_on_made_pages():
    rng = random.Random(9)
    some = 0
    for _ in range(400):
        page = made_page(rng)
        assert H.main_text(page) == slow_text(page), page
        some += bool(H.main_text(page))
    assert some > 200


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html or "" for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]


def test_given_pages_give_their_article(pages):
    for page in pages:
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
        assert H.main_text(page).split("\n") == [b.text for b in H.blocks(inner[1])]


def test_rules_find_the_text_without_marks(pages):
    """With marks of articles, names and roles taken away, at least 95 % of the blocks are still found."""
    kept = blocks = extra = 0
    for page in pages:
        plain = re.sub(r"(?i)<(/?)(article|main|section)\b", r"<\1div", page)
        plain = re.sub(r"""(?i)\s(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", plain)
        want, got = H.main_text(page).split("\n"), H.main_text(plain).split("\n")
        kept, blocks, extra = kept + sum(x in got for x in want), blocks + len(want), extra + sum(x not in want for x in got)
    assert kept >= 0.95 * blocks and extra <= 0.05 * blocks


PROSE = "It is the text of the page and it goes on for as long as the reader of it wants it to be, and then it ends."


@pytest.mark.parametrize("names", ["related-work", "post-share", "search-results-explained", "notice", "banner-history", "promoted-by-merit", "social-question"])
def test_names_do_not_drop_text_of_an_article(names):
    assert H.main_text(f'<nav>x</nav><article><p>{PROSE}</p><section class="{names}"><h2>More</h2><p>{PROSE}</p></section></article>') == "\n".join([PROSE, "More", PROSE])
    assert H.main_text(f'<article class="{names}"><p>{PROSE}</p></article>') == PROSE


@pytest.mark.parametrize("names", ["content-sidebar-wrap", "has-sidebar", "layout no-sidebar", "row with-sidebar", "page-navigation-content", "modal-open", "recipe-cookies", "ad-free", "menu", "comment", "promo", "sidebar", "header", "site-header", "cookie-banner", "skip-link"])
def test_a_wrapper_is_no_furniture_whatever_its_name(names):
    article = f"{PROSE} {PROSE}"
    beside = '<div class="sidebar"><p>Some other text of it</p></div><div class="comments"><article class="comment-body"><p>It was good to read.</p></article></div>'
    for inner in (f"<main><article><p>{article}</p></article></main>", f'<div class="post-content"><p>{article}</p></div>'):
        page = f'<body><nav><a href="/">Home</a></nav><div class="{names}">{inner}{beside}</div></body>'
        assert H.main_text(page) == article == slow_text(page)
        page = f'<div class="{names}"><section class="{names}">{inner}</section></div>{beside}'
        assert H.main_text(page) == article == slow_text(page)
    assert H.main_text(f'<div class="{names}"><p>{article}</p></div>') == article


def test_teasers_in_a_sidebar_are_not_the_article():
    page = f'<div class="sidebar"><article><p>{PROSE}</p></article></div><div><p>{PROSE} {PROSE}</p><p>{PROSE} {PROSE}</p></div>'
    assert H.main_text(page) == slow_text(page) and H.main_text(page).count(PROSE) == 4


@pytest.mark.parametrize("part", ["<p id=cookies>{}</p>", "<p id=navigation>{}</p>", '<div class="note sidebar-note"><p>{}</p></div>', "<aside><blockquote>{}</blockquote></aside>", "<fieldset><p>{}</p></fieldset>"])
def test_long_text_beside_the_text_stays(part):
    page = f"<article><p>{PROSE}</p>{part.format(PROSE + ' Yes.')}</article>"
    assert H.main_text(page) == f"{PROSE}\n{PROSE} Yes." == slow_text(page)


@pytest.mark.parametrize("names", ["ad", "top-ad-slot", "comments", "comment-body", "sidebar", "cookie-banner", "newsletter", "breadcrumbs"])
def test_furniture_goes_wherever_it_stands(names):
    assert H.main_text(f'<article><p>{PROSE}</p><div class="{names}"><p>{PROSE} Really.</p></div></article>') == PROSE
    assert H.main_text(f'<div><p>{PROSE}</p></div><div id="{names}"><p>{PROSE} Really.</p></div>') == PROSE


def test_short_notices_go_and_long_ones_stay():
    page = '<article><p>{0}</p><div class="{1}">{2}</div><p>{0}</p></article>'
    assert H.main_text(page.format(PROSE, "notice", "Please log in to read on.")) == f"{PROSE}\n{PROSE}"
    assert H.main_text(page.format(PROSE, "public-notice-board", "It was nailed to the door.")) == f"{PROSE}\nIt was nailed to the door.\n{PROSE}"
    assert H.main_text(page.format(PROSE, "notice", PROSE)) == f"{PROSE}\n{PROSE}\n{PROSE}"


def test_an_article_does_not_decide_alone():
    menu = "<ul>" + "".join(f"<li><a href=/{i}>The place number {i} of the site and all of its houses and streets</a></li>" for i in range(4)) + "</ul>"
    odd = "<p>" + "0x7f 0x3a ::: " * 4 + "</p>"
    assert H.main_text(f"<article>{odd}{menu}</article><p>{PROSE}</p>") != H.main_text(f"<article><p>{PROSE}</p>{menu}</article><p>{PROSE}</p>")
    assert PROSE * 3 in H.main_text(f"<article><p>{PROSE}</p></article><div><p>{PROSE * 3}</p></div>")  # long prose counts outside as well


def test_a_form_around_the_page_is_not_a_form():
    assert H.main_text(f"<form><nav><a href=x>Home</a></nav><div><p>{PROSE}</p></div></form>") == PROSE
    assert H.main_text(f"<div><p>{PROSE}</p></div><form><p>{PROSE} Yours.</p></form>") == PROSE


@pytest.mark.parametrize("page", ["<a " * 200_000, "<div>" * 50_000 + "</section>" * 50_000, '<a "' * 100_000 + ">", "<a '>\"" * 100_000, "<button>" * 100_000, "</script " * 80_000, "<p>x" * 80_000, "<!--" * 100_000, "<" * 200_000 + ">", "<div>x" * 50_000, "<form><nav>" * 50_000, "&amp" * 100_000, "<i a=" * 100_000])
def test_time_grows_with_the_page(page):
    began = time.process_time()
    H.main_text(page)
    assert time.process_time() - began < 5
