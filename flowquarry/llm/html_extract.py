"""Main text of web pages: boosted trees over DOM nodes, decoded along the hierarchy.

A page becomes a tree of block elements; inline markup joins the text of the block around
it, and loose text under the body is a block of its own, as far as two line breaks or the next
block. Every block gets features: share and density of text and links in its subtree, tokens of
its tag, class, id and role and of its ancestors', depth, place among and likeness to its
siblings. Gradient-boosted trees give the log-odds that the block belongs to the article.

Decoding first lets children inherit part of their parent's log-odds. It then keeps a block
only inside kept blocks: going up the tree, a block's gain is its own
log-odds plus the gains of its children, and a block whose gain is not positive is dropped
with everything below it. So no choice contradicts that of an ancestor or a descendant.

Training has no given labels. The teacher is the structure of pages that have an article
element: blocks inside it and outside any boilerplate element are article. So that the trees
don't rest on one tag or one template, they also see the same pages with boilerplate of every
kind put in or all boilerplate taken out, with names of tags and classes blanked (of boilerplate, only where it is lists of links), with
paragraphs turned into lists, quotes, tables, code and captions, with the article renamed to
other containers or its blocks loose under the body, and without the article. Bounds: about ``TRAIN_PAGES`` pages of at most
``TRAIN_CHARS`` characters by hash of the id; extraction covers every page whole.

Tags end as in browsers: a quote counts only after an equals sign. From a quote on that is
never closed tags end at the next ``>``; a tag without one is text. Reading a page takes time in proportion to its length. Formulas and
drawings (math, svg) give their text; what browsers show only in place of an object, canvas,
video or sound is dropped, as are form controls.

Defined cases: null or empty html gives the empty text; unclosed and stray tags are repaired as
browsers do for blocks; white space, no-break space included, becomes one space; a null id stays
a row; repeated rows are extracted each; extra columns are ignored; with no page to learn from
the teacher's rule decides alone; an empty table gives an empty one.
"""

from __future__ import annotations

import html as entities
import random
import re
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.llm.common import map_rows, table

TRAIN_PAGES = 300
TRAIN_CHARS = 100_000
TREES = 60
DEPTH = 4
RATE = 0.3
QUANTILES = 32
#: How much of a block's log-odds, cut off at CERTAIN, its children inherit.
PASSED_ON, CERTAIN = 0.5, 4.0

#: A comment or declaration, or the start of a tag; then a tag's attributes up to its end.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/(?=[^a-zA-Z]))[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
ATTRIBUTES = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>")
WITHOUT_QUOTES = re.compile(r"([^>]*+)>")
ATTRIBUTE = re.compile(r"(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")

#: Elements without content, elements whose content is never text, and inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe canvas object head title select textarea button audio video".split())
RAW = frozenset("script style template iframe noscript title textarea".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements that close an open element of the first name.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ITEMS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

#: Tokens of tags, classes, ids and roles, by what they speak for.
ARTICLE_TOKENS = frozenset("article main content post entry story body text articlebody mainentity".split())
BOILERPLATE = {
    "menu": frozenset("nav menu navbar navigation breadcrumb breadcrumbs pagination pager toc tabs toolbar skip".split()),
    "frame": frozenset("header footer masthead banner contentinfo copyright legal colophon topbar bottombar".split()),
    "side": frozenset("aside sidebar side widget related recommended recommendations complementary more popular trending teaser tags".split()),
    "notice": frozenset("cookie cookies consent notice gdpr alert popup modal overlay subscribe subscription newsletter paywall promo dialog alertdialog".split()),
    "advert": frozenset("ad ads advert advertisement sponsor sponsored promotion adsense banner1 dfp".split()),
    "form": frozenset("form search login signup fieldset input searchbox register".split()),
    "comment": frozenset("comment comments disqus reply replies respond discussion feedback reviews commentlist".split()),
    "share": frozenset("share sharing social follow byline-share print toolbar-share".split()),
}
ALL_BOILERPLATE = frozenset().union(*BOILERPLATE.values())
KINDS = list(BOILERPLATE)


STRUCTURE = frozenset(("#root", "html", "body"))
#: The tag of a run of text right under one of these.
LOOSE = "#text"
#: Stands for a line break in the runs of text.
BREAK = "\v"
#: Elements whose content has other tags than a page.
FOREIGN = frozenset(("math", "svg"))


class Node:
    __slots__ = ("tag", "parent", "children", "tokens", "depth", "text", "linked", "parts", "order", "size", "links", "blocks")

    def __init__(self, tag: str, parent: Node | None, tokens: frozenset[str]):
        self.tag, self.parent, self.tokens = tag, parent, tokens
        self.children: list[Node] = []
        self.depth = parent.depth + 1 if parent else 0
        self.text = self.linked = 0
        self.parts: list[tuple[int, str]] = []
        if parent:
            parent.children.append(self)


def tokens_of(tag: str, attributes: str) -> frozenset[str]:
    found = {tag}
    if attributes and ("=" in attributes):
        for m in ATTRIBUTE.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            found.update(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()))
    return frozenset(found)


def parse(source: str) -> tuple[Node, list[tuple[Node, str, int]]]:
    """The tree of block elements, and runs of text in page order, each with its block and how
    much of it is linked."""
    root = Node("#root", None, frozenset())
    at, runs, links, position, attributes = root, [], 0, 0, ATTRIBUTES
    opened: dict[str, int] = {}
    unending: set[str] = set()
    foreign = ""

    def add(raw: str) -> None:
        if not raw:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        n = len(text.strip())
        runs.append((at, text, n if links else 0))
        at.text += n
        at.linked += n if links else 0

    def leave(node: Node) -> None:
        """Close the open blocks up to and with this one."""
        nonlocal at
        while at is not node.parent:
            opened[at.tag] -= 1
            at = at.parent

    while True:
        m = MARKUP.search(source, position)
        if m is None:
            add(source[position:])
            break
        add(source[position : m.start()])
        position = m.end()
        if m[2] is None:
            continue
        rest = attributes.match(source, position)
        if rest is None:
            attributes = WITHOUT_QUOTES
            rest = attributes.match(source, position)
            if rest is None:
                add(source[m.start() :])
                break
        position = rest.end()
        tag, closing = m[2].lower(), m[1]
        if tag in HIDDEN:
            if not closing and not rest[1].rstrip().endswith("/") and tag not in unending:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, position)
                if end is not None:
                    position = end.end()
                elif tag in RAW:
                    position = len(source)
                else:
                    unending.add(tag)
            runs.append((at, " ", 0))
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in INLINE:
            continue
        if tag in FOREIGN:
            foreign = "" if closing or rest[1].endswith("/") else tag
        elif foreign and tag in CLOSES_P:
            foreign = ""
        if tag in FOREIGN or foreign:
            if foreign != "math":
                runs.append((at, " ", 0))
            continue
        if tag in VOID:
            runs.append((at, BREAK if tag == "br" else " ", 0))
            continue
        if closing:
            if opened.get(tag):
                node = at
                while node.tag != tag:
                    node = node.parent
                leave(node)
                links = 0
            runs.append((at, " ", 0))
            continue
        if tag in CLOSES_P and opened.get("p"):
            node = at
            while node is not root and node.tag not in ("div", "article", "section", "td", "li", "body", "main", "aside", "blockquote"):
                if node.tag == "p":
                    leave(node)
                    links = 0
                    break
                node = node.parent
        if tag in ITEMS:
            node = at
            while node is not root and node.tag not in ITEMS[tag]:
                if node.tag == tag or {node.tag, tag} == {"dt", "dd"} or {node.tag, tag} == {"td", "th"}:
                    leave(node)
                    break
                node = node.parent
        at = Node(tag, at, tokens_of(tag, rest[1]))
        opened[tag] = opened.get(tag, 0) + 1
        runs.append((at, " ", 0))
    return root, runs


def page_of(source: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """Blocks and runs of a page, loose text right under its body in blocks of its own."""
    root, runs = parse(source)
    out, seen, children = [], {root}, {root: []}
    loose, breaks = None, 0
    for node, text, linked in runs:
        if node not in seen:
            seen.add(node)
            if node.tag in STRUCTURE:
                children[node] = []
            if node.parent in children:
                children[node.parent].append(node)
        n = len(text.strip())
        if node.tag not in STRUCTURE:
            loose, breaks = None, 0
        elif text == BREAK:
            breaks += 1
        elif n:
            if loose is None or loose.parent is not node or breaks > 1:
                loose = Node(LOOSE, node, frozenset((LOOSE,)))
                children[node].append(loose)
            breaks = 0
            node.text, node.linked, loose.text, loose.linked = node.text - n, node.linked - linked, loose.text + n, loose.linked + linked
            node = loose
        out.append((node, text, linked))
    for node, inside in children.items():
        node.children = inside
    return walk(root), out


def walk(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.order = len(out)
        out.append(node)
        stack += reversed(node.children)
    return out


FEATURES = [
    "depth", "own_text", "subtree_text", "share_of_page", "blocks", "text_per_block", "link_density", "own_link_density", "before", "after",
    "sibling_text", "sibling_links", "sibling_share", "same_tag_siblings", "parent_link_density", "parent_share", "heading", "paragraph", "item",
    "article_here", "article_above", "boilerplate_here", "boilerplate_above", *[f"{k}_here" for k in KINDS], *[f"{k}_above" for k in KINDS],
]


#: Columns kept as logarithms.
LOGGED = [FEATURES.index(f) for f in ("own_text", "subtree_text", "blocks", "sibling_text")]
NOTHING = (0,) * len(KINDS)


def feature_rows(nodes: list[Node], blank: frozenset[str] | None = None) -> list[list[float]]:
    """One row per block, logarithms not yet taken. ``blank`` takes away what tokens say."""
    for node in reversed(nodes):
        size, links, blocks = node.text, node.linked, 1
        for c in node.children:
            size += c.size
            links += c.links
            blocks += c.blocks
        node.size, node.links, node.blocks = size, links, blocks
    page = max(nodes[0].size, 1)
    out, starts = [], 0
    above: list[tuple[int, tuple]] = []
    alike: dict[int, dict[str, int]] = {}
    for node in nodes:
        parent = node.parent or node
        seen_article, seen = above[parent.order] if node.parent else (0, NOTHING)
        tokens = node.tokens if blank is None else node.tokens - blank
        kinds = NOTHING if node.tag in STRUCTURE or tokens.isdisjoint(ALL_BOILERPLATE) else tuple([int(not tokens.isdisjoint(BOILERPLATE[k])) for k in KINDS])
        article = int(node.tag not in ("body", "html") and not tokens.isdisjoint(ARTICLE_TOKENS))
        above.append((max(seen_article, article), seen if kinds is NOTHING else tuple(map(max, seen, kinds))))
        tags = alike.get(parent.order)
        if tags is None:
            tags = alike[parent.order] = {}
            for s in parent.children:
                tags[s.tag] = tags.get(s.tag, 0) + 1
        size, others, other_links = node.size, max(parent.size - node.size, 0), parent.links - node.links
        heading = len(node.tag) == 2 and node.tag[0] == "h" and node.tag[1].isdigit()
        out.append([
            node.depth, node.text, size, size / page, node.blocks, size / node.blocks, node.links / max(size, 1), node.linked / max(node.text, 1),
            starts / page, 1 - (starts + size) / page, others / max(len(parent.children) - 1, 1), other_links / max(others, 1),
            size / max(parent.size, 1), tags.get(node.tag, 1), parent.links / max(parent.size, 1), parent.size / page,
            heading, node.tag in ("p", LOOSE), node.tag in ("li", "dt", "dd", "td"), article, seen_article, any(kinds), any(seen), *kinds, *seen,
        ])
        starts += node.text
    return out


def features(rows: list[list[float]]) -> np.ndarray:
    out = np.array(rows, float).reshape(len(rows), len(FEATURES))
    out[:, LOGGED] = np.log1p(out[:, LOGGED])
    return out


def taught(nodes: list[Node]) -> np.ndarray:
    """1 for blocks inside an article element and outside any boilerplate element."""
    label = np.zeros(len(nodes))
    inside: dict[int, tuple[bool, bool]] = {}
    for i, node in enumerate(nodes):
        art, bad = inside[id(node.parent)] if node.parent else (False, False)
        art = art or node.tag in ("article", "main") or bool(node.tokens & {"article", "articlebody"})
        bad = bad or (node.tag not in ("html", "body", "article", "main") and not node.tokens.isdisjoint(ALL_BOILERPLATE))
        inside[id(node)] = (art, bad)
        label[i] = art and not bad
    return label


class Boosted:
    """Gradient-boosted regression trees for a yes or no, on quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, QUANTILES + 1)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], axis=1)
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.start = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.start)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(bins, y - p, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            score = score + self._apply(tree, x)

    def _grow(self, bins: np.ndarray, gradient: np.ndarray, weight: np.ndarray):
        """A complete tree: feature and threshold of each inner node, value of each leaf."""
        feature, cut = np.full(2**DEPTH - 1, -1), np.full(2**DEPTH - 1, np.inf)
        where = np.zeros(len(bins), int)
        wide = QUANTILES + 1
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-6)
            local = where - first
            g_all, h_all = np.bincount(local, gradient, nodes), np.bincount(local, weight, nodes)
            for f in range(bins.shape[1]):
                key = local * wide + bins[:, f]
                g = np.cumsum(np.bincount(key, gradient, nodes * wide).reshape(nodes, wide), axis=1)[:, :-1]
                h = np.cumsum(np.bincount(key, weight, nodes * wide).reshape(nodes, wide), axis=1)[:, :-1]
                gain = g**2 / (h + 1) + (g_all[:, None] - g) ** 2 / (h_all[:, None] - h + 1) - (g_all**2 / (h_all + 1))[:, None]
                gain[(h < 0.1) | (h_all[:, None] - h < 0.1)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(nodes), at]
                for k in np.flatnonzero(top > best):
                    if at[k] < len(self.edges[f]):
                        best[k], feature[first + k], cut[first + k] = top[k], f, self.edges[f][at[k]]
            f, c = feature[where], cut[where]
            right = np.zeros(len(bins), bool)
            for u in np.unique(f[f >= 0]):
                rows = f == u
                right[rows] = bins[rows, u] > np.searchsorted(self.edges[u], c[rows], side="left")
            where = 2 * where + 1 + right
        leaf = where - (2**DEPTH - 1)
        g, h = np.bincount(leaf, gradient, 2**DEPTH), np.bincount(leaf, weight, 2**DEPTH)
        return feature, cut, RATE * g / (h + 1)

    @staticmethod
    def _apply(tree, x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        where, rows = np.zeros(len(x), int), np.arange(len(x))
        for _ in range(DEPTH):
            f = feature[where]
            where = 2 * where + 1 + ((f >= 0) & (x[rows, np.maximum(f, 0)] >= cut[where]))
        return value[where - (2**DEPTH - 1)]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(self._apply(t, x) for t in self.trees) if len(x) else np.zeros(0)


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which blocks are kept: the best choice in which every kept block's parent is kept."""
    gain = np.zeros(len(nodes))
    for i, node in enumerate(nodes):  # part of a parent's certainty goes to its children
        if node.tag not in STRUCTURE:
            gain[i] = odds[i] + PASSED_ON * min(max(gain[node.parent.order], -CERTAIN), CERTAIN)
    for i in range(len(nodes) - 1, 0, -1):
        if gain[i] > 0:
            gain[nodes[i].parent.order] += gain[i]
    kept = np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        kept[i] = gain[i] > 0 and (node.parent is None or kept[node.parent.order])
    return kept


def joined(runs: list[tuple[Node, str, int]], kept: np.ndarray) -> str:
    text = "".join([t if kept[n.order] else " " for n, t, _ in runs])
    return SPACE.sub(" ", text).strip()


def furnished(source: str, spare: str, rng: random.Random) -> str:
    """The page with boilerplate of several kinds put around and into its article."""
    words = SPACE.sub(" ", re.sub(r"<[^>]*>", " ", spare)).split()

    def some(n: int) -> str:
        start = rng.randrange(max(1, len(words) - n)) if words else 0
        return " ".join(words[start : start + n])

    pieces = [
        f'<header class="site-header"><a href="/">{some(3)}</a><p>{some(8)}</p></header>',
        f'<aside class="sidebar"><h3>{some(3)}</h3><ul>' + "".join(f'<li><a href="/x">{some(5)}</a></li>' for _ in range(4)) + "</ul></aside>",
        f'<div class="cookie-notice"><p>{some(20)}</p><button>{some(1)}</button></div>',
        f'<form class="search"><label>{some(2)}</label><input><p>{some(6)}</p></form>',
        f'<section id="comments"><h3>{some(2)}</h3>' + "".join(f'<div class="comment"><p>{some(rng.randrange(5, 60))}</p></div>' for _ in range(3)) + "</section>",
        f'<div class="advertisement"><p>{some(12)}</p></div>', f'<div class="related-posts"><p>{some(10)}</p></div>', f'<div class="share"><a href="#">{some(1)}</a></div>',
    ]
    rng.shuffle(pieces)
    k = rng.randrange(1, len(pieces))
    inner, outer = "".join(pieces[: k // 2]), "".join(pieces[k // 2 : k])
    if "</article>" in source:
        source = source.replace("</article>", inner + "</article>" + outer, 1) if rng.random() < 0.6 else source.replace("<article", outer + "<article", 1)
    return source


def shortened(source: str, paragraphs: int) -> str:
    """The page with only its article's first paragraphs left."""
    start, end = source.find("<p"), source.rfind("</article>")
    cut = start
    for _ in range(paragraphs):
        cut = source.find("<p", cut + 1) if cut >= 0 else cut
    return source[:cut] + source[end:] if 0 <= cut < end else source


def article_alone(source: str) -> str:
    """The article element with nothing around it."""
    start, end = source.find("<article"), source.rfind("</article>")
    return f"<html><body>{source[start:end]}</article></body></html>" if 0 <= start < end else source


def enriched(source: str, rng: random.Random) -> str:
    """The page with some of its article's paragraphs turned into other kinds of block."""
    start, end = source.find("<article"), source.rfind("</article>")
    if not 0 <= start < end:
        return source

    def other(m: re.Match) -> str:
        words = m[1].split()
        k = max(1, len(words) // rng.randrange(2, 6))
        parts = [" ".join(words[i : i + k]) for i in range(0, len(words), k)]
        tag = rng.choice(("ul", "ol"))
        kinds = [
            m[0], m[0], f"<{tag}>" + "".join(f"<li>{p}</li>" for p in parts) + f"</{tag}>", f"<blockquote><p>{m[1]}</p></blockquote>", f"<blockquote>{m[1]}</blockquote>",
            "<table><tbody>" + "".join(f"<tr><td>{p}</td><td>{p}</td></tr>" for p in parts) + "</tbody></table>", f"<pre>{m[1]}</pre>", f"<h2>{parts[0] if parts else ''}</h2>" + m[0],
            f"<figure><img><figcaption>{m[1]}</figcaption></figure>", "<dl>" + "".join(f"<dt>{p}</dt><dd>{p}</dd>" for p in parts) + "</dl>", f"<div>{m[1]}</div>",
            f"<section><h3>{parts[0] if parts else ''}</h3>{m[0]}</section>", f'<p><a href="/x">{m[1]}</a></p>' if len(words) < 12 else m[0], "<ul>" + "".join(f'<li><a href="/x">{p}</a> {m[1]}</li>' for p in parts) + "</ul>",
        ]
        return rng.choice(kinds)

    return source[:start] + re.sub(r"<p>([^<]*)</p>", other, source[start:end]) + source[end:]


#: Tags and tokens an article's container has on other pages.
CONTAINERS = (("div", ()), ("div", ("content",)), ("div", ("post", "body")), ("div", ("page",)), ("main", ()), ("section", ()), ("div", ("entry", "content")), ("td", ()))


def without_article(nodes: list[Node], label: np.ndarray, rng: random.Random) -> tuple[list[Node], np.ndarray]:
    """The same page after its article was taken out."""
    left = [n for n, y in zip(nodes, label) if not y]
    for n in left:
        n.children = [c for c in n.children if not label[c.order]]
    nodes = walk(nodes[0])
    return nodes, np.zeros(len(nodes))


def nameless_links(nodes: list[Node], label: np.ndarray, rng: random.Random) -> tuple[list[Node], np.ndarray]:
    """The same page with lists of links outside the article in plain blocks without a name."""
    feature_rows(nodes)  # sizes of subtrees
    for n, y in zip(nodes, label):
        if not y and n.tag not in STRUCTURE and n.links > 0.7 * n.size:
            n.tag = n.tag if n.tag in ("ul", "li", "p") else "div"
            n.tokens = frozenset((n.tag,))
    return nodes, label


def recast(nodes: list[Node], label: np.ndarray, rng: random.Random) -> tuple[list[Node], np.ndarray]:
    """The same page with its article in another container, or with none and its blocks, as
    paragraphs or loose text, right under the container's parent."""
    truth = {id(n): y for n, y in zip(nodes, label)}
    way = rng.randrange(3)
    for n in nodes:
        if n.tag != "article":
            continue
        if way == 0:
            n.tag, extra = rng.choice(CONTAINERS)
            n.tokens = frozenset((n.tag, *extra))
            continue
        here = n.parent.children
        at = here.index(n)
        here[at : at + 1] = n.children
        for c in n.children:
            c.parent = n.parent
            if way == 2 and c.tag == "p" and not c.children and c.parent.tag in STRUCTURE:
                c.tag, c.tokens = LOOSE, frozenset((LOOSE,))
        stack = list(n.children)
        while stack:
            c = stack.pop()
            c.depth -= 1
            stack += c.children
    nodes = walk(nodes[0])
    return nodes, np.array([truth[id(n)] for n in nodes], float)


def training_rows(pages: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = random.Random(seed)
    xs, ys = [], []
    for page in pages:
        spare = pages[rng.randrange(len(pages))]
        short = shortened(page, rng.randrange(3))
        rich = enriched(page, rng)
        full = furnished(rich, spare, rng)
        variants = (
            (page, None, None), (short, None, None), (furnished(short, spare, rng), None, None), (furnished(page, spare, rng), None, None), (furnished(page, spare, rng), ARTICLE_TOKENS, None),
            (rich, None, None), (full, ARTICLE_TOKENS, None), (full, None, recast), (rich, None, recast), (short, None, recast),
            (article_alone(short), None, None), (article_alone(short), None, recast), (article_alone(rich), None, None), (article_alone(rich), None, recast), (full, None, without_article), (page, None, nameless_links), (full, None, nameless_links),
        )
        for variant, blank, change in variants:
            nodes = page_of(variant)[0]
            y = taught(nodes)
            if not y.any():
                continue
            if change is not None:
                nodes, y = change(nodes, y, rng)
            taken = [n.tag not in STRUCTURE for n in nodes]
            xs += compress(feature_rows(nodes, blank), taken)
            ys.append(y[taken])
    return features(xs), np.concatenate(ys) if ys else np.zeros(0)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Boosted | None:
    """Boosted trees from a bounded sample of pages, on the driver."""
    n = pages.count()
    hashed = pages.filter(F.length(html_col) <= TRAIN_CHARS).select(F.xxhash64(id_col, html_col).alias("h"), html_col)
    if n > TRAIN_PAGES:  # hashes are even: a share of their range is a share of the pages
        hashed = hashed.filter(F.col("h") <= int(-(2.0**63) + 2.0**64 * TRAIN_PAGES / n))
    x, y = training_rows([r[1] for r in sorted(hashed.collect())])
    return Boosted(x, y) if len(y) and 0 < y.sum() < len(y) else None


def extract_page(source: str, model: Boosted | None) -> str:
    nodes, runs = page_of(source)
    odds = np.where(taught(nodes) > 0, 1.0, -1.0) if model is None else model.log_odds(features(feature_rows(nodes)))
    return joined(runs, decode(nodes, odds))


def extract(pages: DataFrame, model: Boosted | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""

    def make():
        def work(ids, urls, sources):
            parsed = [page_of(s or "") for s in sources]
            nodes = [n for n, _ in parsed]
            odds = [np.where(taught(n) > 0, 1.0, -1.0) for n in nodes]
            if model is not None:
                every = model.log_odds(features([r for n in nodes for r in feature_rows(n)]))
                odds = np.split(every, np.cumsum([len(n) for n in nodes])[:-1])
            out = []
            for i, u, (_, runs), n, o in zip(ids, urls, parsed, nodes, odds):
                text = joined(runs, decode(n, o))
                out.append((i, u, text, len(text)))
            return out

        return work

    types = dict(pages.dtypes)
    return map_rows(pages.select(id_col, url_col, html_col), make, f"{id_col} {types[id_col]}, {url_col} {types[url_col]}, text string, n_chars long")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by trees trained on a bounded sample of the same pages."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))


QUERY = op4_html_extract
