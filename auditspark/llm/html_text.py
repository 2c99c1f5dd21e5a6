"""HTML extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is read into a stack of open elements (end tags may be missing); a block is what stands between two borders of
block-level elements. Its features are the tags of its ancestors, words and word groups of their class, id and role,
and its text (length, links, ends, signs). The field has two labels, main and other, with weights for features and
for neighbouring labels; it is trained by maximum likelihood (forward-backward, Adam) on labelled pages and decoded by
Viterbi. Pages to train on are a parameter; `training_pages` writes labelled pages of many layouts from a seed, so
nothing of the pages to be judged is used.

The text is that of main blocks: character references decoded, white space within a block made one space, blocks
joined by a line feed. Scripts, styles, comments and markup are never blocks; formulas, drawings and the fallback of
objects are text of the block they stand in. Nothing is cut or capped.

Cases: a null or empty page, and one without a main block, has the empty text; unclosed and truncated pages are read
as far as they go; repeated pages give repeated results; an empty table gives an empty table; input columns named
like output columns are replaced.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns

# HTML's block-level elements, void elements, and elements whose content is no text of the page.
BLOCK_TAGS = frozenset(
    "html head body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre "
    "figure figcaption header footer nav aside form fieldset legend address details summary hr hgroup dialog menu select option iframe".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style template title textarea iframe".split())
#: Start tags that end open elements of these kinds, within the nearest of the borders.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
ENDS_P = BLOCK_TAGS - {"html", "head", "body", "li", "td", "th", "tr", "option", "iframe"}

#: Word groups in class, id and role of ancestors.
GROUPS = {
    "ad": r"ad|ads|advert\w*|sponsor\w*|promo\w*|banner|dfp|commercial",
    "nav": r"nav\w*|menu\w*|breadcrumb\w*|toc|pagination|pager|tabs|skip",
    "foot": r"foot\w*|copyright|legal|colophon|contentinfo",
    "head": r"head|header|masthead|topbar|logo|brand|site",
    "side": r"side\w*|aside|related|recommend\w*|widget\w*|trending|popular|more|rail|complementary",
    "talk": r"comment\w*|repl\w+|discuss\w*|disqus|respond|feedback|review\w*",
    "notice": r"cookie\w*|consent|notice\w*|gdpr|alert\w*|modal|popup|overlay|toast|paywall|warning",
    "share": r"share\w*|social\w*|follow|tools|tags|meta",
    "form": r"form\w*|subscri\w*|newsletter\w*|login|signin|signup|search\w*|contact",
    "body": r"content\w*|article\w*|post\w*|entry\w*|main|body|text|story|prose|page",
}
_GROUP = {k: re.compile(f"(?:{v})$") for k, v in GROUPS.items()}
_TAG = re.compile(
    r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|$)""", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[A-Za-z]+")
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


class Place:
    """An open element: its tag, and what a block learns from it and its ancestors.

    All of that is sets over fixed names, shared with the parent where nothing is new, so depth costs nothing.
    """

    __slots__ = ("tag", "seen", "groups", "below", "hidden")

    def __init__(self, tag: str, words: str, up: Place | None):
        self.tag = tag
        own = frozenset(k for w in words.split() for k in _groups_of(w))
        hidden = "!hidden" in words.split()
        if up is None:
            self.seen, self.groups, self.below, self.hidden = frozenset(), own, (None, None), hidden
        else:
            self.seen, self.groups, self.below, self.hidden = up.seen, up.groups, up.below, up.hidden or hidden
            if not own <= self.groups:
                self.groups |= own
        # what lies below the outermost article and the outermost main
        if tag in _BELOW and any(x is not None and tag not in x for x in self.below):
            self.below = tuple(None if x is None else x | {tag} for x in self.below)
        for i, name in enumerate(("article", "main")):
            if tag == name and self.below[i] is None:
                self.below = (frozenset(), self.below[1]) if i == 0 else (self.below[0], frozenset())
        if tag not in ("html", "body") and tag not in self.seen:
            self.seen |= {tag}

    def key(self) -> tuple:
        return self.tag, self.seen, self.groups, self.below, self.hidden


_BELOW = frozenset(("header", "footer", "nav", "aside", "form", "section", "ul", "ol", "table"))
_NOWHERE = ("", frozenset(), frozenset(), (None, None), False)


@lru_cache(maxsize=20_000)
def _groups_of(word: str) -> tuple[str, ...]:
    return tuple(k for k, p in _GROUP.items() if p.match(word))


@dataclass
class Block:
    """A block's text, how much of it is linked, and where it stands."""

    place: tuple
    text: str
    linked: int


def blocks_of(page: str | None) -> list[Block]:
    """The page's blocks that have text, in page order. The work grows with the page's length, whatever its depth."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[Place] = []
    open_: Counter[str] = Counter()
    parts: list[str] = []
    linked = anchors = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(stack[-1].key() if stack else _NOWHERE, text, linked))
            parts.clear()
            linked = 0

    def shut(i: int) -> None:
        open_.subtract(x.tag for x in stack[i:])
        del stack[i:]

    at, size = 0, len(page)
    for m in iter(lambda: _TAG.search(page, at), None):
        if m.start() > at:
            piece = entities.unescape(page[at : m.start()])
            parts.append(piece)
            if anchors:
                linked += len(piece.strip())
        at = m.end() if m.end() > m.start() else m.start() + 1
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:  # an end tag closes the nearest element of its name
            if name == "a":
                anchors = max(0, anchors - 1)
            elif open_[name] > 0:
                close()
                shut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == name))
            continue
        if name in SILENT_TAGS:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)", re.I).search(page, at)
                tail = page.find(">", end.start()) if end else -1
                at = size if tail < 0 else tail + 1
            if name == "iframe":
                close()
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            anchors += 1
            continue
        if name not in BLOCK_TAGS:
            continue
        close()
        anchors = 0
        if name in ENDS_P and stack and stack[-1].tag == "p":
            shut(len(stack) - 1)
        if name in CLOSES and any(open_[x] > 0 for x in CLOSES[name][0]):
            ends, borders = CLOSES[name]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in borders:
                    break
                if stack[i].tag in ends:
                    shut(i)
                    break
        if name in VOID_TAGS:
            continue
        words = " ".join(w.lower() for a in _ATTRIBUTE.finditer(m[3]) for w in _NAME.findall(a[2] or a[3] or a[4] or ""))
        if m[3] and _HIDDEN.search(m[3]):
            words += " !hidden"
        stack.append(Place(name, words, stack[-1] if stack else None))
        open_[name] += 1
    if at < size:
        parts.append(entities.unescape(page[at:]))
    close()
    return out


def path_features(place: tuple) -> list[str]:
    tag, seen, groups, below, hidden = place
    out = ["bias", f"parent:{tag}", *(f"in:{t}" for t in sorted(seen))]
    inner, under = ("article", below[0]) if "article" in seen else ("main", below[1]) if "main" in seen else ("", None)
    out.append(f"inner:{inner}")
    out += [f"{inner}>{t}" for t in sorted(under or ())]
    if "head" in seen:
        out.append("in-head")
    if hidden:
        out.append("hidden")
    out += [f"group:{g}" for g in sorted(groups)]
    if not groups:
        out.append("group:none")
    if groups & {"ad", "nav", "foot", "side", "talk", "notice", "share", "form"}:
        out.append("group:outer")
    return out


def text_features(block: Block) -> list[str]:
    text, n = block.text, len(block.text)
    density = block.linked / n
    out = [
        f"len:{min(8, n.bit_length() // 2)}",
        f"links:{0 if not density else 1 if density < 0.5 else 2}",
        f"end:{'.' if text[-1] in '.!?:;…' else 'w' if text[-1].isalnum() else 'o'}",
    ]
    if "©" in text or "(c)" in text[:12].lower():
        out.append("copyright")
    return out


class ChainField:
    """Weights of features (two labels: 0 other, 1 main), of label pairs and of first labels."""

    def __init__(self, features: dict[str, int], weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.features, self.weights, self.moves, self.start = features, weights, moves, start
        self._paths: dict[tuple, np.ndarray] = {}
        self._texts: dict[str, np.ndarray] = {}

    def _sum(self, names: list[str]) -> np.ndarray:
        known = [self.features[x] for x in names if x in self.features]
        return self.weights[known].sum(axis=0) if known else np.zeros(2)

    def scores(self, blocks: list[Block]) -> np.ndarray:
        out = np.empty((len(blocks), 2))
        for i, b in enumerate(blocks):
            base = self._paths.get(b.place)
            if base is None:
                if len(self._paths) > 20_000:
                    self._paths.clear()
                base = self._paths[b.place] = self._sum(path_features(b.place))
            key = " ".join(names := text_features(b))
            own = self._texts.get(key)
            if own is None:
                own = self._texts[key] = self._sum(names)
            out[i] = base + own
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """The most likely labels, by Viterbi; ties go to main."""
        if not blocks:
            return []
        s, (m00, m01), (m10, m11) = self.scores(blocks).tolist(), *self.moves.tolist()
        a, b = s[0][0] + self.start[0], s[0][1] + self.start[1]
        back = []
        for x, y in s[1:]:
            from0, from1 = b + m10 >= a + m00, b + m11 >= a + m01
            a, b = (b + m10 if from0 else a + m00) + x, (b + m11 if from1 else a + m01) + y
            back.append((from0, from1))
        label = int(b >= a)
        out = [label]
        for f in reversed(back):
            label = int(f[label])
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[str, list[int]]], epochs: int = 25, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> ChainField:
    """Maximum likelihood over (page, label of each block); the list is what bounds the driver's work."""
    features: dict[str, int] = {}
    data = []
    for page, labels in pages:
        blocks = blocks_of(page)
        if len(blocks) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(blocks)} blocks")
        if blocks:
            rows = [[features.setdefault(f, len(features)) for f in dict.fromkeys(path_features(b.place) + text_features(b))] for b in blocks]
            flat = np.array([f for r in rows for f in r])
            data.append((flat, np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array(labels)))
    params = [np.zeros((len(features), 2)), np.zeros((2, 2)), np.zeros(2)]
    first, second, steps = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(data)
        for at in range(0, len(data), 8):
            grads = [np.zeros_like(p) for p in params]
            for flat, owner, labels in data[at : at + 8]:
                _add_gradient(params, grads, flat, owner, labels)
            steps += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                g -= decay * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p += rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    return ChainField(features, params[0], params[1], params[2])


def _add_gradient(params, grads, flat, owner, labels) -> None:
    """Adds observed minus expected counts of one page."""
    weights, moves, start = params
    n = len(labels)
    scores = np.zeros((n, 2))
    np.add.at(scores, owner, weights[flat])
    alpha, beta = np.empty((n, 2)), np.zeros((n, 2))
    alpha[0] = scores[0] + start
    for i in range(1, n):
        alpha[i] = np.logaddexp(alpha[i - 1, 0] + moves[0], alpha[i - 1, 1] + moves[1]) + scores[i]
    for i in range(n - 2, -1, -1):
        ahead = scores[i + 1] + beta[i + 1]
        beta[i] = np.logaddexp(moves[:, 0] + ahead[0], moves[:, 1] + ahead[1])
    total = np.logaddexp(alpha[-1, 0], alpha[-1, 1])
    gap = -np.exp(alpha + beta - total)
    gap[np.arange(n), labels] += 1
    np.add.at(grads[0], flat, gap[owner])
    grads[2][:] += gap[0]
    if n > 1:
        pair = np.exp(alpha[:-1, :, None] + moves[None] + (scores + beta)[1:, None, :] - total)
        grads[1] -= pair.sum(axis=0)
        np.add.at(grads[1], (labels[:-1], labels[1:]), 1)


# -- labelled pages -------------------------------------------------------------------------------------------------


class _Writer:
    """Writes one page, and the label of every block with text."""

    def __init__(self, rng: random.Random):
        self.rng, self.out, self.labels = rng, [], []
        self.syllables = ["".join(rng.choice(s) for s in ("bcdfglmnprstv", "aeiouéäó", "nrstl")) for _ in range(40)]

    def words(self, low: int, high: int) -> str:
        rng = self.rng
        return " ".join("".join(rng.choices(self.syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        noise = self.rng.choice(["", "", "", "", "***", "###", "&amp;&amp;", "!!"])
        return " ".join(self.words(2, 18).capitalize() + noise + self.rng.choice(".....?!") for _ in range(self.rng.randint(low, high)))

    def any_text(self) -> str:
        k = self.rng.random()
        return self.words(1, 4).capitalize() if k < 0.25 else self.sentences(1, 1) if k < 0.5 else self.sentences(1, 6)

    def block(self, tag: str, text: str, label: int, closed: bool = True) -> None:
        self.out.append(f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if closed else ""))
        self.labels.append(label)

    def open(self, tag: str) -> None:
        self.out.append(f"<{tag}>")

    def shut(self, tag: str) -> None:
        self.out.append(f"</{tag.split()[0]}>")

    def pick(self, *options: str) -> str:
        return self.rng.choice(options)

    def links(self, label: int = 0) -> None:
        tag = self.pick("ul", "ol", "div")
        self.open(tag)
        for _ in range(self.rng.randint(2, 7)):
            self.block("li" if tag != "div" else "p", f'<a href="/{self.rng.randint(1, 99)}">{self.words(1, 3)}</a>', label)
        self.shut(tag)

    def prose(self, label: int) -> None:
        rng, k = self.rng, self.rng.random()
        if k < 0.62:
            text = self.any_text()
            if rng.random() < 0.2:
                text = text.replace(" ", f' <a href="https://x.example/">{self.words(1, 2)}</a> ', 1)
            if rng.random() < 0.25:
                text = f"<{self.pick('b', 'i', 'em', 'strong', 'span')}>" + text + ("<br>" if rng.random() < 0.5 else "")
            self.block("p", text, label, rng.random() < 0.8)
        elif k < 0.72:
            self.block(self.pick("h2", "h3", "h4"), self.words(1, 7).capitalize(), label)
        elif k < 0.80:
            tag = self.pick("ul", "ol")
            self.open(tag)
            for _ in range(rng.randint(1, 4)):
                self.block("li", self.any_text(), label)
            self.shut(tag)
        elif k < 0.85:
            self.block("blockquote", self.any_text(), label)
        elif k < 0.89:
            self.block("pre", self.words(3, 20), label)
        elif k < 0.93:
            self.open("figure")
            self.out.append('<img src="a.png">')
            self.block("figcaption", self.sentences(1, 1), label)
            self.shut("figure")
        elif k < 0.96:
            self.open("table")
            for _ in range(rng.randint(1, 3)):
                self.open("tr")
                for _ in range(rng.randint(1, 3)):
                    self.block("td", self.words(1, 4), label)
                self.shut("tr")
            self.shut("table")
        else:
            self.block("div", self.any_text(), label)

    def several(self, label: int, low: int, high: int) -> None:
        for _ in range(self.rng.randint(low, high)):
            self.prose(label)

    def menu(self) -> None:
        tag = self.pick("nav", "nav", "nav class='menu'", 'div class="nav"', 'div id="main-menu"', 'ul class="breadcrumb"', 'div role="navigation"')
        self.open(tag)
        self.links()
        self.shut(tag)

    def advert(self) -> None:
        tag = self.pick('div class="ad"', 'div class="ads box"', 'aside class="advert"', 'div id="sponsored"', 'section class="promo"', 'div class="banner-ad"', 'p class="ad"')
        if tag[0] == "p" or self.rng.random() < 0.6:
            self.block(tag, self.any_text(), 0)
        else:
            self.open(tag)
            self.several(0, 1, 2)
            self.shut(tag)

    def boxed(self, tags: tuple[str, ...], low: int, high: int) -> None:
        tag = self.pick(*tags)
        self.open(tag)
        if self.rng.random() < 0.3:
            self.links()
        self.several(0, low, high)
        self.shut(tag)

    def sidebar(self) -> None:
        self.boxed(("aside", "aside", 'div class="sidebar"', 'div id="sidebar-right"', 'section class="related"', 'div class="widget"', 'div role="complementary"'), 1, 4)

    def notice(self) -> None:
        self.boxed(('div class="cookie-notice"', 'div id="cookies"', 'div class="consent"', 'section class="notice"', 'div class="alert"', 'div class="gdpr modal"', "dialog", 'div role="alert"', 'p class="notice"'), 1, 1)

    def form(self) -> None:
        tag = self.pick("form", 'form class="search"', 'div class="newsletter"', 'div class="subscribe"', 'section id="login"')
        self.open(tag)
        if tag.startswith("form") and self.rng.random() < 0.5:
            self.out.append(f"<label>{self.words(1, 3)}</label><input name='q'><button>{self.words(1, 1)}</button>")
            self.labels.append(0)
        self.several(0, 1, 2)
        if self.rng.random() < 0.3:
            self.open("select")
            self.block("option", self.words(1, 1), 0)
            self.block("option", self.words(1, 1), 0)
            self.shut("select")
        self.shut(tag)

    def talk(self) -> None:
        tag = self.pick('section class="comments"', 'div id="comments"', 'section id="discussion"', 'ol class="comment-list"', 'div class="replies"', 'div class="user-comments"', 'aside class="comments"')
        self.open(tag)
        if not tag.startswith("ol") and self.rng.random() < 0.6:
            self.block("h3", self.words(1, 3), 0)
        for _ in range(self.rng.randint(1, 4)):
            inner = "li" if tag.startswith("ol") else self.pick("div", 'div class="comment"', "article class='comment'", "p", 'div class="reply"')
            if inner == "p":
                self.block("p", self.any_text(), 0)
            else:
                self.open(inner)
                self.several(0, 1, 3)
                self.shut(inner)
        self.shut(tag)

    def share(self) -> None:
        self.boxed(('div class="share"', 'div class="social-links"', 'ul class="share-tools"'), 1, 1) if self.rng.random() < 0.5 else self.menu()

    def site_header(self) -> None:
        self.boxed(("header", "header", 'div id="header"', 'div class="masthead"', 'header class="site-header"', 'div role="banner"'), 1, 2)

    def site_footer(self) -> None:
        tag = self.pick("footer", "footer", "footer", 'div class="footer"', 'div id="site-footer"', 'div role="contentinfo"')
        self.open(tag)
        if self.rng.random() < 0.6:
            self.out.append(f"&copy; {self.words(1, 3)} &middot; {self.any_text()}")
            self.labels.append(0)
        self.several(0, 0 if self.labels and self.rng.random() < 0.5 else 1, 2)
        self.shut(tag)

    def page(self) -> tuple[str, list[int]]:
        rng = self.rng
        maybe = lambda p, f: f() if rng.random() < p else None
        self.out.append(self.pick("<!doctype html>", "") + "<html><head>" + self.pick('<meta name="viewport" content="width=device-width">', '<link rel="icon" href="/i.png">'))
        self.out.append(f"<title>{self.words(2, 8)}</title>" + self.pick("<style>nav li { float: left }</style>", "<script>if (a < b) { go('<div>') }</script>", "") + "</head><body>")
        maybe(0.3, self.notice)
        maybe(0.45, self.site_header)
        maybe(0.7, self.menu)
        maybe(0.3, self.form)
        maybe(0.5, self.advert)
        maybe(0.25, self.sidebar)
        wrap = [w for w, p in (("main", 0.3), ('div class="wrapper"', 0.2), ('div id="page"', 0.15)) if rng.random() < p]
        for w in wrap:
            self.open(w)
        if "main" in wrap:
            maybe(0.2, self.menu)
        body = self.pick("article", "article", "article", "article class='post'", "div class='content'", "div class='entry-content'", "div class='post-body'", "div id='article'", "section class='story'")
        if "main" in wrap and rng.random() < 0.2:
            body = "section"
        self.open(body)
        if rng.random() < 0.25:
            self.open("header")
            self.block("h1", self.words(2, 10).capitalize(), 1)
            self.shut("header")
        else:
            maybe(0.85, lambda: self.block("h1", self.words(1, 12).capitalize(), 1))
        inner = rng.random() < 0.15
        if inner:
            self.open(cover := self.pick("div", "section", "div class='text'"))
        self.several(1, 1, 8)
        for part in (self.advert, self.sidebar, self.share, self.form, self.notice):
            if rng.random() < 0.12:
                part()
                self.several(1, 1, 3)
        if inner:
            self.shut(cover)
        maybe(0.15, self.talk)
        maybe(0.12, lambda: self.boxed(("footer",), 1, 1))
        self.shut(body)
        maybe(0.35, self.talk)
        maybe(0.2, self.sidebar)
        for w in reversed(wrap):
            self.shut(w)
        maybe(0.3, self.sidebar)
        maybe(0.2, self.advert)
        maybe(0.2, self.talk)
        maybe(0.8, self.site_footer)
        maybe(0.2, self.notice)
        if rng.random() < 0.9:
            self.out.append("</body></html>")
        return "".join(self.out), self.labels


def training_pages(count: int = 400, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Labelled pages of many layouts; `count` bounds them."""
    rng = random.Random(seed)
    return [_Writer(rng).page() for _ in range(count)]


_TRAINED: dict[tuple[int, int], ChainField] = {}


def default_field(count: int = 400, seed: int = 11) -> ChainField:
    if (count, seed) not in _TRAINED:
        _TRAINED[count, seed] = train(training_pages(count, seed))
    return _TRAINED[count, seed]


def main_text(page: str | None, field: ChainField) -> str:
    blocks = blocks_of(page)
    return "\n".join(b.text for b, x in zip(blocks, field.decode(blocks), strict=True) if x)


def extract_text(pages: DataFrame, html_col: str = "html", out_col: str = "text", field: ChainField | None = None) -> DataFrame:
    """pages with the main text of each. Map-only; the weights travel with the tasks."""
    field = field or default_field()
    packed = (field.features, field.weights, field.moves, field.start)

    def make():
        own = ChainField(*packed)
        return lambda texts: [[main_text(t, own) for t in texts]]

    return append_columns(pages, html_col, make, [T.StructField(out_col, T.StringType())])
