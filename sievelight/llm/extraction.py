"""Main text of web pages by a maximum-scoring subsequence of words and tags.

Every word and tag of a page has a weight by the elements it stands in, learned as log-odds from labelled pages: by their
names, by what they hold (mostly links, a thread of like boxes, an offer), and by where they stand (beside the article). A box
inside an article whose name is unknown stays unless what it holds speaks against it: figures, code, notes, quotes and
lists of references are such boxes. A linear scan finds the contiguous run of the largest sum. Inside the run, words that stand in
elements of negative weight (an advert, a comment thread) are left out. All passes over a page are linear in its length.
"""

from __future__ import annotations

import html as html_
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Labelled pages that the weights are learned from, and their seed.
TRAINING_PAGES, SEED = 800, 7
#: Share of their boxes whose names the learner can't know; names need this many pages to be learned.
UNKNOWN, LEAST_PAGES = 0.25, 2
PLAIN = {"<html", "<body", "<div", "<p", "<ul", "<li", "<a", "<section", "<span", "<b", "<table", "<tr", "<td", "<h1", "<h2", "<blockquote",
         "<ol", "<dl", "<dt", "<dd", "<th", "<tbody", "<i", "<em", "<strong"}
#: A tag's weight, and a word's before its elements are known.
TAG_WEIGHT, WORD_WEIGHT = -0.6, 0.5
#: The least that a word counts in the scan. Noise inside content counts nothing, however long it is; it is left out in any case.
NOISE_WEIGHT = -1.0

# Fixed values of HTML.
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "select", "svg", "math", "object", "canvas", "title", "audio",
    "video", "xmp", "noembed", "noframes")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure",
         "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu",
         "nav", "ol", "optgroup", "option", "p", "pre",
         "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
#: An opening tag of the left closes an open one of the right.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"},
    "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}}
#: Elements of running text: what holds one is content even if nothing is known of its names.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote"}
#: Elements that hold others; mostly links in one is a menu, while a paragraph may be one link.
BOXES = {"div", "ul", "ol", "dl", "section", "nav", "aside", "table", "header", "footer", "menu"}
#: What only articles hold, wherever they have a box of their own for it.
RICH = {"pre", "code", "figure", "figcaption", "blockquote", "q", "dl", "cite", "math"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Share of a run's words by which an element is what they are the text of.
HOME = 0.8
#: Share of the words of a page's paragraphs by which a box is its text.
TEXT = 0.6
# Words of offers and of readers' talk, in the languages of the names below.
OFFERS = {"advertisement", "advert", "sponsored", "promoted", "sale", "discount", "buy", "shop", "subscribe", "offer", "anzeige", "werbung", "rabatt", "kaufen", "gesponsert",
          "publicité", "sponsorisé", "acheter", "soldes", "publicidad", "patrocinado", "comprar", "oferta", "descuento"}
TALK = {"reply", "replies", "comment", "comments", "commented", "says", "wrote", "ago", "upvote", "likes", "antworten", "kommentar", "kommentare", "schrieb", "sagt", "répondre",
        "commentaire", "commentaires", "responder", "comentario", "comentarios", "dijo"}
CLOSES |= {t: {"p"} for t in BLOCK if t not in CLOSES and t not in ("body", "html", "head")}

#: As browsers read it: a quote matters only behind "=", and a tag that never ends takes the rest of the page with it.
#: Nothing is matched twice, so a page is read once whatever it holds.
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+>?|"
                    r"<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?P<end>>?)", re.S)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_PART = re.compile(r"[^\W\d_]+")
_ZEROS, _HUGE = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])"), re.compile(r"&#[1-9][0-9]{7,};?")


def decoded(text: str) -> str:
    """Character references of one text node, those of absurdly large numbers too."""
    if "&#" in text:
        text = _HUGE.sub("\ufffd", _ZEROS.sub(r"&#\1", text))
    return html_.unescape(text) if "&" in text else text


def marks_of(tag: str, attrs: str) -> tuple[str, ...]:
    """What the weights are learned of: the tag and the words of class, id and role."""
    if not attrs:
        return (f"<{tag}",)
    names = {p for m in _ATTR.finditer(attrs) for p in _PART.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[2] or m[3] or m[4] or "").lower())}
    return (f"<{tag}", *sorted(f".{n}" for n in names))


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes) and ("close", tag, ""); comments and raw elements are left out."""
    at, end, open_ended = 0, len(page), set()
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at:m.start()], ""
        at = m.end()
        if not m["tag"]:
            continue
        if not m["end"]:
            return
        tag = m["tag"].lower()
        if m["close"]:
            yield "close", tag, ""
            continue
        yield "open", tag, m["attrs"]
        if tag in RAW and tag not in open_ended and not m["attrs"].rstrip().endswith("/"):
            stop = _RAW_END[tag].search(page, at)
            if stop is not None:
                at = stop.start()
            elif tag in ("script", "style", "textarea", "title"):
                at = end
            else:
                open_ended.add(tag)  # nothing ends it from here on


_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])", re.I | re.A) for t in RAW}


@dataclass
class Weights:
    of: dict[str, float] = field(default_factory=dict)

    def mark(self, m: str) -> float:
        return self.of.get(m, 0.0)


@dataclass
class Tree:
    """Elements in page order (0 is the page) and what happens in it: (kind, text or tag, element); kinds are text, block
    (a block begins or ends) and tag."""

    tags: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [0])
    marks: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    items: list[tuple[str, str, int]] = field(default_factory=list)


def parse(page: str) -> Tree:
    """Every element is opened and closed once. For each tag it is known where it is open, so no search goes up the stack."""
    t, stack = Tree(), [0]
    where: dict[str, list[int]] = defaultdict(list)  # places in the stack, by tag; "" for blocks

    def pop() -> None:
        tag = t.tags[stack.pop()]
        where[tag].pop()
        if tag in BLOCK:
            where[""].pop()

    for kind, what, attrs in events(page):
        if kind == "text":
            t.items.append(("text", what, stack[-1]))
        elif kind == "open":
            while len(stack) > 1 and t.tags[stack[-1]] in CLOSES.get(what, ()):
                pop()
            t.items.append(("block" if what in BLOCK else "tag", what, stack[-1]))
            if what not in VOID and not attrs.rstrip().endswith("/"):
                t.tags.append(what)
                t.parents.append(stack[-1])
                t.marks.append(marks_of(what, attrs))
                where[what].append(len(stack))
                if what in BLOCK:
                    where[""].append(len(stack))
                stack.append(len(t.tags) - 1)
        else:
            t.items.append(("block" if what in BLOCK else "tag", what, stack[-1]))
            depth = where[what][-1] if where[what] else 0
            if depth and (what in BLOCK or not where[""] or where[""][-1] <= depth):
                while len(stack) > depth:
                    pop()
    _add_structure(t)
    return t


def _add_structure(t: Tree) -> None:
    """Marks of what an element holds and where it stands, which no name tells."""
    n = len(t.tags)
    words, linked, prose, rich, headed, offers, talks = ([0] * n for _ in range(7))
    in_link, article = [False] * n, [False] * n
    alike: list[dict] = [{} for _ in range(n)]  # children of one name
    ends, paragraphs = [0] * n, [0] * n  # the last child that holds prose, and how many are paragraphs
    for i in range(1, n):
        parent = t.parents[i]
        in_link[i] = in_link[parent] or t.tags[i] == "a"
        article[i] = article[parent] or t.tags[i] in ("article", "main")
        rich[i], headed[i] = t.tags[i] in RICH, t.tags[i] in HEADINGS
        if t.tags[i] in PROSE:
            ends[parent] = i
            paragraphs[parent] += t.tags[i] == "p"
        if t.tags[i] in BOXES or t.tags[i] in ("li", "article"):
            alike[parent][t.marks[i]] = alike[parent].get(t.marks[i], 0) + (len(t.marks[i]) > 1)
    for kind, what, i in t.items:
        if kind == "text":
            said = what.split()
            words[i] += len(said)
            linked[i] += len(said) * in_link[i]
            if t.tags[i] in PROSE:
                prose[t.parents[i]] += len(said)
            low = [w.strip(".,:;!?()").lower() for w in said]
            offers[i] += sum(w in OFFERS for w in low)
            talks[i] += sum(w in TALK for w in low)
    own = prose[:]
    for i in range(n - 1, 0, -1):
        for sums in (words, linked, prose, rich, headed, offers, talks):
            sums[t.parents[i]] += sums[i]
    main = max((i for i in range(1, n) if t.tags[i] in ("article", "main")), key=lambda i: (words[i], -i), default=0)
    # without an element that says so, the innermost box with most of the words of paragraphs
    text = 0 if main else max((i for i in range(1, n) if t.tags[i] in BOXES and prose[i] > TEXT * prose[0]), default=0)
    above, up = {0}, main
    while up:
        above.add(up)
        up = t.parents[up]
    for i in range(1, n):
        tag, parent, more = t.tags[i], t.parents[i], []
        named = len(t.marks[i]) > 1
        if (article[parent] or own[parent] and t.tags[parent] in BOXES) and tag in ("header", "footer", "aside"):
            t.marks[i] = (f"<{tag} in article", *t.marks[i][1:])
        # a list of references has no name of its own, or stands in an article's last box
        if tag in BOXES and words[i] and 2 * linked[i] >= words[i] and (named or tag in ("nav", "menu") or not (article[parent] or own[parent])):
            more.append("?links")
        if named and tag in BOXES and not rich[i]:
            # what stands behind the last of its parent's paragraphs, and has none of its own: like boxes in a row, or readers' talk
            most = max(alike[i].values(), default=0)
            if 0 < ends[parent] < i and not paragraphs[i] and (most > 1 and not headed[i] or (most or headed[i]) and talks[i]):
                more.append("?thread")
            if offers[i] and words[i] <= 60 and not headed[i]:
                more.append("?offer")
        if main and parent in above and parent != main and i not in above and tag in BLOCK:
            more.append("?beside the article")
        if text and parent == t.parents[text] and i != text and named and tag in BOXES and not rich[i] and not headed[i] and t.marks[i] != t.marks[text] and 2 * words[i] <= words[text]:
            more.append("?beside the text")
        if more:
            t.marks[i] = (*t.marks[i], *more)


def _noise(weight: float) -> bool:
    return WORD_WEIGHT + weight <= 0


def weigh(t: Tree, weights: Weights) -> tuple[list[float], list[bool]]:
    """For each element the weight that it and those around it give to words, and whether it stands in content or holds
    paragraphs of its own; what noise stands in says whether it counts in the scan."""
    n = len(t.tags)
    weight, content = [0.0] * n, [False] * n
    for i in range(1, n):
        above, add = weight[t.parents[i]], sum(map(weights.mark, t.marks[i]))
        # noise inside content stays noise: what an element takes away, those inside it don't give back
        weight[i] = above + add if above >= 0 else min(above, above + add)
        if t.tags[i] in PROSE and not _noise(weight[i]) and t.tags[t.parents[i]] not in ("", "html", "body"):
            content[t.parents[i]] = True
    for i in range(1, n):
        content[i] = content[t.parents[i]] or content[i] or weight[i] > 0 and not _noise(weight[i])
    return weight, content


def extract(page: str | None, weights: Weights) -> str:
    """The main text: blocks in page order, joined by a line end. Null, empty and textless pages: ''."""
    t = parse(page or "")
    weight, content = weigh(t, weights)
    items: list[tuple[str, float, int]] = []  # text, or "\n" where a block begins or ends, its weight and element
    best, best_at, run, run_from = 0.0, (0, 0), 0.0, 0
    for kind, what, i in t.items:
        noise = _noise(weight[i])
        if kind == "text":
            # words of one stretch have one weight, so its sum is taken at once
            value = len(what.split()) * max(WORD_WEIGHT + weight[i], NOISE_WEIGHT)
            items.append((what, WORD_WEIGHT + weight[i], i))
        else:
            value = TAG_WEIGHT
            if kind == "block":
                items.append(("\n", 0.0, i))
            elif what == "br":
                items.append((" ", math.inf, i))
        run += 0.0 if noise and content[i] else value
        if run <= 0:
            run, run_from = 0.0, len(items)
        elif run > best:
            best, best_at = run, (run_from, len(items))
    begin, end = _whole(t, items, *best_at)
    blocks, now = [], []
    for text, value, _ in [*items[begin:end], ("\n", 0.0, 0)]:
        if text == "\n" and value == 0.0:
            # references are those of one text node each
            if block := " ".join("".join(map(decoded, now)).split()):
                blocks.append(block)
            now = []
        elif value > 0:
            now.append(text)
    return "\n".join(blocks)


def _whole(t: Tree, items: list[tuple[str, float, int]], begin: int, end: int) -> tuple[int, int]:
    """A headline, a caption or a last line may have fewer words than its tags weigh. The innermost element that holds at least HOME of
    the run's words is what they are the text of: the run is drawn out to its ends. Noise in it stays out."""
    held: dict[int, int] = defaultdict(int)
    total = 0
    for text, value, i in items[begin:end]:
        if value > 0 and value != math.inf:
            n = len(text.split())
            held[i] += n
            total += n
    if not total:
        return begin, end
    # children stand behind their parents
    n = len(t.tags)
    words = [0] * n
    for i, k in held.items():
        words[i] = k
    for i in range(n - 1, 0, -1):
        words[t.parents[i]] += words[i]
    home = max(i for i in range(n) if words[i] >= HOME * total)
    # a single paragraph is the text of what it stands in
    while home and t.tags[home] not in BOXES and t.tags[home] not in ("article", "main"):
        home = t.parents[home]
    if t.tags[home] in ("", "html", "body"):
        return begin, end
    inside = [False] * n
    for i in range(home, n):
        inside[i] = i == home or inside[t.parents[i]]
    at = [k for k, (_, _, i) in enumerate(items) if inside[i]]
    return (min(begin, at[0]), max(end, at[-1] + 1)) if at else (begin, end)


# Parts of the labelled pages. Names that sites give to what is, and is not, their article.
CONTENT = ["article", "main", "div.content", "div.article", "div.post", "div.entry", "section.story", "div.text", "div#body",
    "section.article", "main.content", "div.main", "div.page"]
NOISE = ["nav", "nav.menu", "nav.breadcrumbs", "header", "header.site", "header.masthead", "footer", "footer.site", "aside",
    "aside.sidebar", "div.sidebar", "div.side", "div.ad", "div.ads", "div.advert",
         "div.advertisement", "div.banner", "div.promo", "div.promotion", "div.sponsored", "div.sponsor", "div.cookie", "div.cookies",
         "div.consent", "div.notice", "div.alert", "div.gdpr", "div.popup",
         "div.modal", "div.overlay", "div.newsletter", "div.subscribe", "div.signup", "form", "form.search", "form.comment", "form.login",
         "div.search", "div.login", "div.share", "div.social",
         "div.comments", "div.comment", "section.comments", "div.replies", "div.reply", "div.responses", "div.disqus", "ol.commentlist",
         "ul.comments", "div.related", "div.recommended", "div.more", "div.popular", "div.trending",
         "div.menu", "ul.menu", "ul.nav", "div.navigation", "div.navbar", "div.topbar", "div.toolbar", "div.header", "div.footer",
         "div.copyright", "div.legal", "div.disclaimer", "div.pagination", "div.pager",
         "div.breadcrumb", "div.tags", "div.widget", "dialog", "menu", "button", "div.skip", "select", "fieldset", "label",
         "section.related", "section.newsletter", "aside.ad", "aside.related", "div.tracking", "div.paywall",
         "div.werbung", "div.anzeige", "div.kommentar", "div.kommentare", "div.warenkorb", "div.hinweis", "div.teilen", "div.seitenleiste",
         "div.fusszeile", "div.kopfzeile", "div.publicite", "div.pub", "div.commentaire",
         "div.commentaires", "div.partager", "div.avis", "div.panier", "div.publicidad", "div.anuncio", "div.comentario", "div.comentarios",
         "div.compartir", "div.aviso", "div.menú", "div.barra", "div.pie",
         "div.advertising", "div.adbox", "div.promoted", "div.notification", "div.toast", "div.rail", "div.secondary", "div.colophon",
         "div.links", "div.feedback", "div.discussion", "div.shoutbox"]
ROLES = ["navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"]


def _element(name: str, inside: str, role: str = "") -> str:
    tag, _, rest = re.match(r"(\w+)([.#]?)(.*)", name).groups()
    kind = f' {"id" if "#" in name else "class"}="{rest}"' if rest else ""
    return f"<{tag}{kind}{role}>{inside}</{tag}>"


def labelled_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> list[str]:
    """Pages whose words are their labels: a word of an article begins with a, one of the rest with z."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        words = lambda c, a, b: " ".join(f"{c}{rng.randrange(10**9)}" for _ in range(rng.randint(a, b)))
        fresh = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(6))
        unknown = lambda known, tag: f"{tag}.{fresh()}" if rng.random() < UNKNOWN else rng.choice(known)
        noise = lambda: _element(
            unknown(NOISE, "div"), rng.choice(["<ul>" + "".join(f'<li><a href="/x">{words("z", 1, 2)}</a></li>' for _ in range(rng.randint(2, 8))) + "</ul>", words("z", 3, 40), f'<p>{words("z", 5, 40)}</p>' * rng.randint(1, 3)]))
        box = lambda inside: f"<{(b := rng.choice(['div', 'section', 'aside' if rng.random() < 0.2 else 'div']))} class='{fresh()}'>{inside}</{b}>"
        links = lambda c: "<ul>" + "".join(f"<li><a href='/x'>{words(c, 1, 6)}</a></li>" for _ in range(rng.randint(2, 8))) + "</ul>"
        # boxes of an article, under names that say nothing, and what stands in them
        boxed = lambda: rng.choice([box(f"<pre>{words('a', 3, 30)}</pre>"), box(words("a", 5, 40)), box(f"<p>{words('a', 3, 90)}</p>"), links("a"),
                                    box(f"<h2>{words('a', 1, 5)}</h2><p>{words('a', 10, 40)}</p><p>{words('a', 10, 40)}</p>"),
                                    f"<figure>{words('a', 1, 3)}<figcaption>{words('a', 3, 20)}</figcaption></figure>", box(f"<blockquote>{words('a', 5, 30)}</blockquote>")])
        # inside an article, boxes that nobody knows are told by what they hold
        kin = fresh()
        told = lambda: box(rng.choice([links("z"), f"{words('z', 2, 20)} {rng.choice(sorted(OFFERS))} {words('z', 1, 10)}",
                                       "".join(f"<div class='{kin}'><p>{words('z', 4, 40)}</p></div>" for _ in range(rng.randint(2, 6)))]))
        parts = [boxed() if rng.random() < 0.25 else rng.choice([f"<p>{words('a', 8, 60)}</p>", f"<h2>{words('a', 2, 6)}</h2>",
            f"<ul><li>{words('a', 3, 12)}</li><li>{words('a', 3, 12)}</li></ul>",
                             f"<blockquote>{words('a', 5, 20)}</blockquote>",
                             f"<p><b>{words('a', 2, 5)}</b> {words('a', 5, 30)} <a href='y'>{words('a', 1, 3)}</a></p>",
                             f"<table><tr><td>{words('a', 2, 6)}</td></tr></table>",
                             f"<div>{words('a', 5, 30)}</div>"]) for _ in range(rng.randint(3, 9))]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(1, len(parts)), _element(rng.choice(NOISE), words("z", 3, 40)))
        if rng.random() < 0.4:
            parts.append(told())
        inner = f"<h1>{words('a', 3, 8)}</h1>" + "".join(parts)
        if rng.random() < 0.3:
            inner = f"<header>{inner[:inner.find('</h1>') + 5]}</header>{inner[inner.find('</h1>') + 5:]}"
        role = f' role="{rng.choice(ROLES)}"'
        main = _element(unknown(CONTENT, "div"), inner)
        around = rng.random()
        main = f"<div>{main}</div>" if around < 0.3 else f"<section>{main}</section>" if around < 0.4 else main
        page = "".join(noise() for _ in range(rng.randint(1, 4))) + _element("div", words("z", 3, 20),
            role) * (rng.random() < 0.3) + main + "".join(noise() for _ in range(rng.randint(1, 4)))
        out.append(f"<!DOCTYPE html><html><head><title>z</title></head><body>{page}</body></html>")
    return out


def learn(pages: list[str]) -> Weights:
    """Log-odds of each mark: words of articles over other words that stand inside it, smoothed by pages."""
    good: dict[str, float] = defaultdict(float)
    bad: dict[str, float] = defaultdict(float)
    for page in pages:
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        t = parse(page)
        for kind, text, i in t.items:
            if kind == "text":
                words = text.split()
                while i:
                    for m in t.marks[i]:
                        seen[m][0] += sum(w[0] == "a" for w in words)
                        seen[m][1] += sum(w[0] == "z" for w in words)
                    i = t.parents[i]
        for m, (a, z) in seen.items():
            if a + z:
                good[m] += a / (a + z)
                bad[m] += z / (a + z)
    weights = {}
    for m in good:
        # plain elements say nothing by themselves, nor do names that hardly occur
        if m not in PLAIN and good[m] + bad[m] >= LEAST_PAGES:
            w = math.log((good[m] + 0.5) / (bad[m] + 0.5))
            # a mark found around noise only outweighs all others
            weights[m] = -8.0 if good[m] < 0.05 * bad[m] else max(0.2, min(w, 2.0)) if w > 0 else max(w, -8.0)
    return Weights(weights)


def main_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """`pages` with text and n_chars (code points). Null html has text ''. Other columns pass through; ones named
    text or n_chars are replaced. Each row is judged alone, so ties and repeated rows need no care; the time that a page
    takes grows with its length only. An empty table gives an empty result."""
    small_batches(pages.sparkSession)
    w = weights or learn(labelled_pages())

    @F.pandas_udf("string")
    def extracted(htmls):
        return htmls.map(lambda h: extract(h, w), na_action=None).astype(object)

    return pages.withColumn("text", extracted(F.col("html").cast("string"))).withColumn("n_chars", F.length("text").cast("long"))


def op10_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
