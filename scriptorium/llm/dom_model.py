"""Main-text extraction by a tree-structured graphical model over the DOM.

A page is parsed into a tree: element nodes (block elements; inline elements
only mark the text they hold) and, as leaves, the blocks of text between block
boundaries. Every node has a binary variable: a block is content or not, an
element holds content or not.

* unary potentials are linear in the node's features: tag and words of its
  class, id and role for elements; length, links, punctuation, sentences and
  headings for blocks;
* parent-child potentials are a table over both labels, one for element and
  one for block children.

Two passes of sum-product messages, from the leaves up and from the root down,
give every block's exact marginal; blocks with a marginal of at least one half
are the main text. The passes run over all pages of a slice together, depth by
depth. Training maximises the likelihood of the labels; its gradient needs
just these marginals.

Everything is trained on labelled pages: pages of the table whose address
names a document (blocks that the document's text holds are content), and
variants of them that move the article into other containers and add labelled
menus, notices, adverts, forms, comments and so on (``variants``). Fitting
takes ``sample_pages`` pages; the bound is a parameter.

Defined cases: null or empty html gives an empty text. Markup that is never
text (scripts, styles, templates, form controls, hidden elements) is dropped by
the parser; an element is hidden by an attribute ``hidden`` or by its own
style. Tags that are not closed end with their parent; stray end tags are
ignored. Rows are extracted one by one, so repeated rows agree. Without a
labelled page the model is trained on ``SEED_PAGE`` and its variants.
"""

from __future__ import annotations

import html as html_lib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_runs


# ---------------------------------------------------------------- fixed values: public HTML vocabulary
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp
small span strike strong sub sup time tt u var wbr label""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose content is no markup, and elements whose content is markup that is not shown as text
RAW = frozenset("script style textarea title".split())
NO_TEXT = frozenset("noscript template svg math iframe object select button canvas audio video".split())
FOREIGN = frozenset("svg math".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
          "tfoot": {"tr", "td", "th", "tbody"}}
TAGS = tuple("""article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th nav header footer aside form
fieldset blockquote pre figure figcaption details summary address body html dialog menu hgroup search""".split())
#: words of class, id and role names, by what they usually mark
HINTS = tuple(x.split() for x in (
    "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager toc topbar tabs skip",
    "header masthead banner site-title logo branding hero-nav",
    "footer foot colophon copyright legal bottom-bar contentinfo",
    "sidebar side aside rail widget widgets complementary related recommend recommended trending popular more-stories also-read teaser",
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted dfp adslot adsense commercial outbrain taboola",
    "cookie cookies consent gdpr notice notices alert banner-notice popup modal overlay paywall dialog announcement warning toast disclaimer",
    "form login signin signup subscribe subscription newsletter search searchbox register contact-form input survey poll",
    "comment comments commentary respond reply replies disqus discussion thread responses feedback reviews reader-comments",
    "share sharing social follow like tweet facebook tools toolbar actions print-links",
    "meta byline author-box tags tag-list taglist categories date timestamp byline-meta",
    "hidden invisible sr-only screen-reader print-only offscreen visually-hidden",
    "article content main post entry story body text prose page-content article-body post-content maincontent richtext copy",
))
HINT_OF = {w: i for i, words in enumerate(HINTS) for w in words}
SEED_PAGE = """<html><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="ad">Buy now.</div><article><h1>A title of the page</h1><p>The first sentence is here, and it is long
enough. The second one follows.</p><p>Another paragraph says more about it, in a few words.</p></article>
<footer>&copy; somebody</footer></body></html>"""

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>
|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*>""", re.S | re.X)
NAME = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
MAY_HIDE = re.compile(r"hidden|style", re.I)
PARTS = re.compile(r"[a-z]+|[0-9]+")
SENTENCE = re.compile(r"[.!?…。！？](?=\s|$)")
WORDS = re.compile(r"\w+")

N_ELEMENT = len(TAGS) + 1 + len(HINTS)
N_BLOCK = 14
#: labelled variants of a training page, if there are many pages
VARIANTS = 5
_LABELS: dict[tuple[str, str], tuple[int, ...]] = {}


def _element_features(tag: str, attrs: str) -> tuple[int, ...]:
    """Positions of the element features that are 1."""
    key = (tag, attrs)
    got = _LABELS.get(key)
    if got is None:
        out = {TAGS.index(tag) if tag in TAGS else len(TAGS)}
        for m in NAME.finditer(attrs):
            value = (m[2] or m[3] or m[4] or "").lower()
            for word in value.split():
                parts = PARTS.findall(word)
                for w in (word, *parts, *map("-".join, zip(parts, parts[1:]))):
                    hint = HINT_OF.get(w, HINT_OF.get(w.rstrip("s")))
                    if hint is not None:
                        out.add(len(TAGS) + 1 + hint)
        got = tuple(sorted(out))
        if len(_LABELS) > 50_000:
            _LABELS.clear()
        _LABELS[key] = got
    return got


# ---------------------------------------------------------------- parsing
def _hidden(attrs: str) -> bool:
    """An attribute named hidden, or a style that does not display the element."""
    if not MAY_HIDE.search(attrs):
        return False
    named: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attrs):
        named.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    style = (x.partition(":") for x in html_lib.unescape(named.get("style", "")).lower().split(";"))
    rules = {name.strip(): value.replace("!important", "").strip() for name, _, value in style}
    return "hidden" in named or rules.get("display") == "none" or rules.get("visibility") == "hidden"


class Page:
    """Nodes in document order: ``parent`` (position, -1 for the root), and for
    elements the positions of their features, for blocks text and features."""

    __slots__ = ("parent", "element", "block", "texts", "depth")

    def __init__(self, source: str):
        self.parent, self.depth = [-1], [0]
        self.element: list[tuple[int, ...] | None] = [_element_features("html", "")]
        self.block: list[list[float] | None] = [None]
        self.texts: list[str] = []
        stack, node = ["#root"], [0]
        run: list[str] = []
        linked = anchor = 0
        bold = False
        gone = 0  # position of an open hidden element: what is inside it makes no node

        def flush():
            nonlocal run, linked, bold
            raw = "".join(run)
            run = []
            if raw and not raw.isspace():
                text = " ".join((html_lib.unescape(raw) if "&" in raw else raw).split())
                if text:
                    self.parent.append(node[-1])
                    self.depth.append(gone or len(node))
                    self.element.append(None)
                    self.block.append(_block_features(text, linked, bold, stack[:gone or None]))
                    self.texts.append(text)
            linked, bold = 0, False

        def close(to: int):
            nonlocal gone
            while len(stack) > to:
                stack.pop()
                node.pop()
            if to <= gone:
                gone = 0

        def leave(at: int):
            nonlocal anchor
            if at < gone:  # the text around a hidden inline element ends
                flush()
                anchor = 0
            close(at)

        def block() -> int:
            at = len(stack) - 1
            while stack[at] in INLINE:  # only hidden elements put inline ones on the stack
                at -= 1
            return at

        at, size = 0, len(source)
        while at < size:
            m = TOKEN.search(source, at)
            piece = source[at:m.start()] if m else source[at:]
            if piece and not gone:
                run.append(piece)
                if anchor:
                    linked += len(piece)
            if not m:
                break
            at = m.end()
            if m["cdata"] is not None:
                if not gone:
                    run.append(html_lib.escape(m["cdata"]))
                continue
            if not m["tag"]:
                continue
            tag, attrs = m["tag"].lower(), m["attrs"] or ""
            if m["end"]:
                if tag in INLINE:
                    if gone:
                        i = len(stack) - 1
                        while i > gone and stack[i] in INLINE and stack[i] != tag:
                            i -= 1
                        if stack[i] == tag:
                            close(i)
                    elif tag == "a":
                        anchor = 0
                elif tag in stack:
                    i = len(stack) - 1 - stack[::-1].index(tag)
                    if i <= gone or not gone:
                        flush()
                        anchor = 0
                    close(i)
                elif tag == "p" and not gone:
                    flush()
                continue
            if tag in RAW:
                if not attrs.endswith("/"):
                    if not gone:
                        flush()
                    at = _skip(source, at, tag)
                continue
            if tag == "head":  # its elements have no text; whatever else comes belongs to the body
                continue
            if tag in NO_TEXT:
                if not attrs.endswith("/"):
                    if not gone:
                        flush()
                    stack.append(tag)
                    node.append(node[-1])
                    gone = gone or len(stack) - 1
                continue
            if gone and stack[gone] in FOREIGN and tag in TAGS:  # ends a drawing that was left open
                close(gone)
            hidden = bool(attrs) and tag not in VOID and _hidden(attrs)
            if hidden and attrs.endswith("/"):
                continue
            if tag in INLINE:
                if (hidden or gone) and tag not in VOID:
                    stack.append(tag)
                    node.append(node[-1])
                    gone = gone or len(stack) - 1
                elif gone:
                    pass
                elif tag == "br":
                    run.append(" ")
                elif tag == "a":
                    anchor = 1
                elif tag in ("b", "strong"):
                    bold = True
                continue
            if not gone:
                flush()
                anchor = 0
            if tag in VOID:
                continue
            if stack[block()] == "p":
                leave(block())
            ends = CLOSES.get(tag)
            while ends and stack[block()] in ends:
                leave(block())
            if hidden or gone:
                stack.append(tag)
                node.append(node[-1])
                gone = gone or len(stack) - 1
                continue
            self.parent.append(node[-1])
            self.depth.append(len(node))
            self.element.append(_element_features(tag, attrs))
            self.block.append(None)
            stack.append(tag)
            node.append(len(self.parent) - 1)
        flush()


def _skip(source: str, at: int, tag: str) -> int:
    """The position after the end of an element whose content is no markup. A
    title without an end tag ends with the head, the others with the page."""
    end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
    if end:
        return end.end()
    if tag == "title":
        end = re.compile(r"(?=</head|<body)|(?=<[a-z!/])", re.I).search(source, at)
        return end.start() if end else len(source)
    return len(source)


def _block_features(text: str, linked: int, bold: bool, stack: list[str]) -> list[float]:
    n = len(text)
    words = text.count(" ") + 1
    sentences = len(SENTENCE.findall(text))
    tag = stack[-1]
    return [
        min(n, 400) / 400, float(n < 25), float(n < 80), min(linked / n, 1.0), float(linked > 0.6 * n), min(words, 60) / 60,
        min(sentences, 5) / 5, float(sentences == 0), min(text.count(",") / words, 1.0), float("©" in text), float(tag[0] == "h" and tag[1:].isdigit()),
        float(tag == "p"), float(tag == "li"), float(bold)]


# ---------------------------------------------------------------- the model
class Forest:
    """The trees of several pages as arrays."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.parent) for p in pages], dtype=np.int64)
        shift = np.repeat(np.cumsum(sizes) - sizes, sizes)
        parent = np.concatenate([np.asarray(p.parent, dtype=np.int64) for p in pages]) if pages else np.zeros(0, np.int64)
        self.parent = np.where(parent >= 0, parent + shift, -1)
        self.depth = np.concatenate([np.asarray(p.depth, dtype=np.int64) for p in pages]) if pages else np.zeros(0, np.int64)
        element = [e for p in pages for e in p.element]
        self.is_block = np.array([e is None for e in element], dtype=bool)
        hot = [e for e in element if e is not None]
        self.x_element = np.zeros((len(hot), N_ELEMENT))
        lengths = [len(e) for e in hot]
        self.x_element[np.repeat(np.arange(len(hot)), lengths), np.fromiter((i for e in hot for i in e), np.int64, sum(lengths))] = 1.0
        blocks = [b for p in pages for b in p.block if b is not None]
        self.x_block = np.array(blocks).reshape(-1, N_BLOCK)
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1) if len(order) else []

    def infer(self, model: dict) -> tuple[np.ndarray, np.ndarray]:
        """By one pass up and one pass down: P(content) of every node, and the
        joint probabilities ``[node, parent's label, own label]``."""
        n = len(self.parent)
        unary = np.zeros((n, 2))  # log potentials
        for rows, x, w in ((~self.is_block, self.x_element, model["element"]), (self.is_block, self.x_block, model["block"])):
            unary[rows, 1] = x @ w[:-1] + w[-1]
        pair = np.stack([model["pair_element"], model["pair_block"]])[self.is_block.astype(int)]
        belief = unary.copy()  # unary and the messages from below
        up = np.zeros((n, 2))
        for at in self.levels[:0:-1]:
            up[at] = np.logaddexp(pair[at, :, 0] + belief[at, None, 0], pair[at, :, 1] + belief[at, None, 1])
            first = np.flatnonzero(np.diff(self.parent[at], prepend=-1))  # siblings are neighbours
            belief[self.parent[at][first]] += np.add.reduceat(up[at], first)
        total = belief.copy()  # and the message from above
        joint = np.zeros((n, 2, 2))
        for at in self.levels[1:]:
            both = (total[self.parent[at]] - up[at])[:, :, None] + pair[at]
            total[at] += np.logaddexp(both[:, 0], both[:, 1])
            joint[at] = both + belief[at][:, None, :]
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500))), joint / joint.sum(axis=(1, 2), keepdims=True)


def variants(source: str, others: list[str], rng: np.random.Generator, n: int) -> list[str]:
    """A page whose content blocks carry the mark ``\\x01``, changed: the article
    in another container, other material in and around it."""
    body = re.search(r"(?is)<article[^>]*>(.*?)</article>", source)
    core = body[1] if body else source

    def prose(k=1):
        out = []
        for _ in range(k):
            t = others[rng.integers(len(others))] if others else "Some other text is here. It has two sentences."
            words = t.split()
            lo = int(rng.integers(0, max(len(words) - 30, 1)))
            out.append(html_lib.escape(" ".join(words[lo:lo + int(rng.integers(3, 45))])))
        return out

    def links(k):
        return "".join(f'<li><a href="/{i}">{t[:25]}</a></li>' for i, t in enumerate(prose(k)))

    def pick(*options):
        return options[int(rng.integers(len(options)))]

    def named(group):
        name = pick(*HINTS[group]) + pick("", "", "-area", "-box", "-wrapper", "-list", "_1", " block")
        return f'{pick("class", "id", "class")}="{name}"'

    def plain():  # names that say nothing
        return pick("", "", ' class="wrap"', ' class="container"', ' id="page"', ' class="row"', ' class="inner col"', ' class="box"',
                    ' class="item"', ' class="layout grid"', ' id="site"', ' class="section-2"')

    def junk():
        kind = int(rng.integers(11))
        tag = pick("div", "section", "div", "aside", "div")
        a, b, c = prose(3)
        inner = pick(f"<p>{a}</p><p>{b}</p>", f"{a}", f"<h3>{a[:30]}</h3><ul>{links(3)}</ul>", f"<h4>{a[:30]}</h4><p>{b}</p>",
                     f"<div{plain()}><p>{a}</p></div><div{plain()}><p>{b}</p><p>{c}</p></div>",
                     f'<h2>{b[:20]}</h2><div class="item"><p>{a}</p><span>{c[:15]}</span></div>', f"<ul><li>{a}</li><li>{b}</li></ul>",
                     f"<table><tr><td>{a[:20]}</td><td>{b[:20]}</td></tr></table>", f"<blockquote>{a}</blockquote><p>{b}</p>")
        if kind == 0:
            return pick(f"<nav>{pick('<ul>' + links(5) + '</ul>', a)}</nav>", f"<{tag} {named(0)}><ul>{links(4)}</ul></{tag}>",
                        f'<div role="navigation"><a href="/x">{a[:20]}</a> <a href="/y">{b[:20]}</a></div>')
        if kind == 1:
            return pick(f"<header><h1>{a[:30]}</h1><p>{b}</p></header>", f"<header{plain()}>{inner}</header>", f"<{tag} {named(1)}>{inner}</{tag}>")
        if kind == 2:
            return pick(f"<footer>{inner}</footer>", f"<footer>&copy; {a[:40]}</footer>", f"<{tag} {named(2)}>{inner}</{tag}>")
        if kind == 3:
            return pick(f"<aside{plain()}>{inner}</aside>", f"<{tag} {named(3)}>{inner}</{tag}>")
        if kind == 6:
            return pick(f'<form action="/s"><p>{a}</p><label>{b[:20]}</label><input name="q"></form>', f"<form{plain()}>{inner}</form>",
                        f"<form><fieldset><legend>{a[:20]}</legend>{b}</fieldset></form>", f"<{tag} {named(6)}>{inner}</{tag}>")
        if kind == 7:
            return pick(f'<section {named(7)}><h2>{a[:12]}</h2><div class="comment"><p>{b}</p></div><div class="comment"><p>{c}</p></div></section>',
                        f"<ol {named(7)}><li><p>{a}</p></li><li><p>{b}</p></li></ol>", f"<{tag} {named(7)}><article><p>{a}</p></article></{tag}>",
                        f"<{tag} {named(7)}>{inner}</{tag}>")
        return f"<{tag} {named(min(kind, 10))}>{inner}</{tag}>"

    def extra():  # other forms of content
        a, b = prose(2)
        return pick(f"<h2>\x01{a[:30]}</h2><p>\x01{b}</p>", f"<h3>\x01{a[:30]}</h3>", f"<ul><li>\x01{a}</li><li>\x01{b}</li></ul>",
                    f"<ol><li>\x01{a}</li></ol>", f"<blockquote>\x01{a}</blockquote>", f"<blockquote><p>\x01{a}</p></blockquote>",
                    f"<table><tr><th>\x01{a[:15]}</th><td>\x01{b}</td></tr></table>", f"<pre>\x01{a}</pre>", f"<p>\x01{a[:30]}</p>",
                    f"<figure><img src='x'><figcaption>\x01{a}</figcaption></figure>", f"<div{plain()}><p>\x01{a}</p><p>\x01{b}</p></div>",
                    f"<section><h4>\x01{a[:20]}</h4><p>\x01{b}</p></section>", f'<p>\x01{a} <a href="/l">{b[:40]}</a></p>',
                    f"<h1>\x01{a[:40]}</h1>", f"<dl><dt>\x01{a[:15]}</dt><dd>\x01{b}</dd></dl>", f"<div>\x01{a}</div>")

    out = []
    for _ in range(n):
        opened = pick("<article>", "<main>", f"<div {named(-1)}>", f"<div {named(-1)}>", f"<article><div{plain()}>", f"<section {named(-1)}>",
                      f"<main><article {named(-1)}>", f"<main><div{plain()}>", "<main><section>", f"<div{plain()}><article>", f"<div{plain()}>")
        closed = "".join(f"</{t}>" for t in re.findall(r"<(\w+)", opened)[::-1])
        parts = re.split(r"(?i)(?=<p>)", core)
        for _ in range(int(rng.integers(0, 4))):
            parts.insert(int(rng.integers(0, len(parts) + 1)), extra())
        if opened not in ("<div>", "<section>"):
            for _ in range(int(rng.integers(0, 3))):
                parts.insert(int(rng.integers(0, len(parts) + 1)), junk())
        before = "".join(junk() for _ in range(int(rng.integers(0, 4))))
        after = "".join(junk() for _ in range(int(rng.integers(0, 4))))
        page = f"{before}{opened}{''.join(parts)}{closed}{after}"
        for _ in range(int(rng.integers(0, 4))):
            page = f"<div{plain()}>{junk() if rng.random() < 0.3 else ''}{page}{junk() if rng.random() < 0.3 else ''}</div>"
        out.append(pick(f"<html><head><title>{prose()[0]}</title></head><body>{page}</body></html>", page))
    return out


def mark(source: str, document: str) -> str | None:
    """The page with ``\\x01`` before every block that the document holds; None
    if the document does not hold the page's text."""
    flat = " ".join(document.split())
    body = re.search(r"(?is)<article[^>]*>(.*?)</article>", source)
    if not body:
        return None
    found = 0

    def put(m):
        nonlocal found
        text = " ".join(html_lib.unescape(re.sub(r"<[^>]*>", " ", m[2])).split())
        if text and text in flat:
            found += 1
            return m[1] + "\x01" + m[2]
        return m[0]

    inner = re.sub(r"(?is)(<(?:h[1-6]|p|li|td|blockquote)[^>]*>(?:<b>)?)([^<]*(?:<(?!/?(?:h[1-6]|p|li|td|blockquote)\b)[^>]*>[^<]*)*)", put, body[1])
    return source[:body.start(1)] + inner + source[body.end(1):] if found else None


def train(pages: list[str], texts: list[str], seed: int = 11) -> dict:
    """The model from marked pages."""
    rng = np.random.default_rng(seed)
    if not pages:
        pages = [re.sub(r"(<h1>|<p>)", "\\1\x01", SEED_PAGE)]
    each = max(VARIANTS, -(-VARIANTS * 60 // len(pages)))  # few pages are varied more often
    sources = [v for p in pages for v in (p, *variants(p, texts, rng, each))]
    parsed = [Page(s) for s in sources]
    y = []
    for p in parsed:
        own = np.zeros(len(p.parent))
        own[[i for i, b in enumerate(p.block) if b is not None]] = ["\x01" in t for t in p.texts]
        for i in range(len(own) - 1, 0, -1):  # an element is content if it holds content
            own[p.parent[i]] = max(own[p.parent[i]], own[i])
        y.append(own)
    y = np.concatenate(y)
    forest = Forest(parsed)
    return maximise(forest, y)


def maximise(forest: Forest, y: np.ndarray, steps: int = 600, rate: float = 0.2, ridge: float = 1e-5) -> dict:
    """Weights of largest penalised likelihood (Adam)."""
    model = {"element": np.zeros(N_ELEMENT + 1), "block": np.zeros(N_BLOCK + 1),
             "pair_element": np.zeros((2, 2)), "pair_block": np.zeros((2, 2))}
    child = forest.parent >= 0
    kinds = {"element": ~forest.is_block, "block": forest.is_block}
    told = {}
    for kind, rows in kinds.items():
        at = np.flatnonzero(rows & child)
        told[kind] = np.zeros((2, 2))
        np.add.at(told[kind], (y[forest.parent[at]].astype(int), y[at].astype(int)), 1.0)
    m = {k: np.zeros_like(v) for k, v in model.items()}
    v = {k: np.zeros_like(x) for k, x in model.items()}
    for step in range(1, steps + 1):
        pace = rate * (1 - step / (steps + 1))
        p, joint = forest.infer(model)
        for kind, rows in kinds.items():
            x = forest.x_element if kind == "element" else forest.x_block
            miss = y[rows] - p[rows]
            grads = {kind: np.append(x.T @ miss, miss.sum()), f"pair_{kind}": told[kind] - joint[rows & child].sum(axis=0)}
            for key, g in grads.items():
                g = g / len(y) - ridge * model[key]
                m[key] = 0.9 * m[key] + 0.1 * g
                v[key] = 0.999 * v[key] + 0.001 * g * g
                model[key] = model[key] + pace * (m[key] / (1 - 0.9 ** step)) / (np.sqrt(v[key] / (1 - 0.999 ** step)) + 1e-8)
    return model


def extract(sources: list[str], model: dict) -> list[str]:
    pages = [Page(s) for s in sources]
    forest = Forest(pages)
    content = forest.infer(model)[0][forest.is_block] >= 0.5
    out, at = [], 0
    for p in pages:
        keep = content[at:at + len(p.texts)]
        at += len(p.texts)
        out.append("\n".join(t for t, k in zip(p.texts, keep) if k))
    return out


# ---------------------------------------------------------------- the operator
def fit(pages: DataFrame, docs: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "doc_id",
        text_col: str = "text", sample_pages: int = 60) -> dict:
    """The model from about ``sample_pages`` pages whose address ends in a
    document's id, those with the smallest hashes."""
    number = F.regexp_extract(F.col(url_col), r"/([0-9]{1,18})(?:\.html|/)?(?:[?#].*)?$", 1)
    known = pages.select(F.when(number != "", number).cast("bigint").alias("id"), F.col(html_col).cast("string").alias("html"))
    known = known.filter("id IS NOT NULL AND html <> ''")
    some = known.orderBy(F.xxhash64("html"), "id").limit(sample_pages)
    pairs = some.join(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
                      .filter("text <> ''"), "id").toPandas().sort_values(["id", "html"])
    marked = [mark(h.replace("\x01", " "), t) for h, t in zip(pairs["html"], pairs["text"])]
    return train([m for m in marked if m], pairs["text"].tolist())


def main_text(pages: DataFrame, docs: DataFrame, html_col: str = "html", **columns) -> Column:
    """The extracted text as a column of ``pages``."""
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages, docs, html_col=html_col, **columns))

    @F.pandas_udf("string")
    def run(source: pd.Series) -> pd.Series:
        sources = [s or "" for s in source]
        return pd.Series([t for lo, hi in text_runs(sources) for t in extract(sources[lo:hi], shared.value)], dtype=object)

    return run(F.col(html_col).cast("string"))


def extract_pages(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages``."""
    text = main_text(pages, docs, html_col, url_col=url_col)
    return pages.select(id_col, url_col, text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
