"""HTML extraction: a tree-structured graphical model over the DOM of each page."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.texts import sampled

SAMPLE_PAGES = 400  # labelled pages to fit on
SAMPLE_CHARS = 100_000  # pages to fit on are no longer than this
BLOCK_PAGES = 400  # pages whose trees are solved side by side
EPOCHS = 150

# Elements by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("head title script style noscript template svg math iframe object canvas audio video select textarea".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var img wbr".split()
)
ENDS_PARAGRAPH = set(
    "address article aside blockquote details dialog div dl fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul li dt dd tr td th tbody thead tfoot".split()
)
# An element that opens closes these, up to the given border.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# The same inside hidden parts, where no tree is kept: what an element that opens closes, up to the given border.
SCOPE = UNSEEN | {"table", "td", "th", "caption", "button"}
LISTS = SCOPE | ENDS_PARAGRAPH - {"address", "div", "p", "li", "dt", "dd"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
IN_TABLE = set("caption colgroup thead tbody tfoot tr td th".split())
IN_HEAD = set("head title base basefont bgsound link meta style script noscript noframes template".split())
RUBY = {"rb", "rt", "rtc", "rp"}
HIDDEN_CLOSES = {
    "a": ({"a"}, SCOPE),
    "button": ({"button"}, SCOPE - {"button"}),
    "li": ({"li"}, LISTS),
    **{t: ({"dt", "dd"}, LISTS) for t in ("dt", "dd")},
    **{t: (IN_TABLE, UNSEEN | {"table"}) for t in IN_TABLE - {"tr", "td", "th"}},
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, UNSEEN | {"table"}),
    **{t: ({"td", "th", "caption", "colgroup"}, UNSEEN | {"table", "tr"}) for t in ("td", "th")},
    **{t: (RUBY, SCOPE | {"ruby"}) for t in RUBY},
}
HIDDEN_ENDS_PARAGRAPH = ENDS_PARAGRAPH | {"center", "dir", "hgroup", "listing", "search", "summary"}
ARTICLE = {"article", "main"}
ASIDE = set("nav footer aside form menu button dialog".split())
ASIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert".split())
ASIDE_NAMES = set(
    "ad ads adv advert advertisement adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notification alert popup modal overlay comment comments disqus reply replies respond discussion sidebar side menu nav "
    "navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar share sharing social related "
    "recommended newsletter subscribe signup login search pagination pager widget legal copyright disclaimer hidden".split()
)
CLEAR_NAMES = set(
    "ad ads adv advert advertisement adverts sponsor sponsored cookie cookies consent gdpr popup modal comment comments "
    "disqus reply replies respond sidebar nav navbar navigation breadcrumb breadcrumbs topbar toolbar pagination pager "
    "newsletter".split()
)
# Words beside those that leave a name as plain as it is, and words that make it tell of the page's state.
NEUTRAL_NAMES = set(
    "area articles bar block bottom box button buttons container form inner item items left links list menu outer panel "
    "posts primary right secondary site slot stories top unit wrap wrapper zone".split()
)
STATE_NAMES = set("has no not with without".split())
ARTICLE_NAMES = set("article content post entry main story body text articlebody".split())
TAGS = (
    "#text #root html body div section article main p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre "
    "header footer nav aside form figure figcaption span a other".split()
)
TAG_NUMBER = {t: i for i, t in enumerate(TAGS)}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>|[^>]*(?:>|\Z))",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
ATTRIBUTES = {"class", "id", "role", "hidden", "style", "aria-hidden"}
MAY_HIDE = re.compile(r"hidden|style", re.IGNORECASE)
NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Bits of a node's flags; "within" ones also hold below the node. A class or id can have a word of an
# aside among others, be such a name as a whole, or one that is hardly given to anything else.
NAME_PART, NAME_ASIDE, NAME_CLEAR, NAME_ARTICLE, TAG_ASIDE, TAG_ARTICLE, PAGE_HEADER = 1, 2, 4, 8, 16, 32, 64
NAMES = NAME_PART | NAME_ASIDE | NAME_CLEAR | NAME_ARTICLE
TAG_FLAGS, TAG_SHIFT = 3, 4
UNNAMED = HEADINGS | {"html", "body"}  # their names tell of the page's layout or are anchors
# Shares of the page's text above which a node's aside names are not looked at, by how clear they are.
NAME_SHARES = ((NAME_PART, 0.5), (NAME_ASIDE, 0.5), (NAME_CLEAR, 0.8))
NAME_STOPS = np.array([4, 8, 16])  # stops and commas of a node by which its names are told apart
NAME_PRIOR = np.array([[0.0] * 4, [-0.3] * 4, [-4.0, -4.0, -0.6, -0.3], [-4.0] * 4])  # by clearness and stops


@dataclass
class Trees:
    """Nodes of many pages in page order, parents first; leaves hold the text blocks."""

    page: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[int] = field(default_factory=list)
    own: list[int] = field(default_factory=list)  # flags of the node itself
    within: list[int] = field(default_factory=list)  # flags of the nodes above
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters inside links

    def add(self, page, parent, tag, own, text="", linked=0) -> int:
        node = len(self.page)
        self.page.append(page)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(TAG_NUMBER.get(tag, TAG_NUMBER["other"]))
        self.own.append(own)
        self.within.append(self.within[parent] | self.own[parent] if parent >= 0 else 0)
        self.text.append(text)
        self.linked.append(linked)
        return node


def _named(given: str, inside_article: bool) -> int:
    """Flags of one class or id."""
    parts = {p.lower() for p in PART.findall(given) if len(p) > 1}
    if inside_article:  # there it holds the title, as the element does
        parts.discard("header")
    if parts & ASIDE_NAMES:
        if parts & STATE_NAMES:
            return 0
        if parts - ASIDE_NAMES - NEUTRAL_NAMES:
            return NAME_PART
        return NAME_CLEAR if parts & CLEAR_NAMES else NAME_ASIDE
    return NAME_ARTICLE if parts & ARTICLE_NAMES else 0


def _flags(tag: str, rest: str, inside_article: bool) -> tuple[int, bool]:
    """Flags of an element, and whether it is not shown."""
    flags = (TAG_ASIDE if tag in ASIDE else 0) | (TAG_ARTICLE if tag in ARTICLE else 0)
    if tag == "header" and not inside_article:
        flags |= PAGE_HEADER
    if len(rest) < 4:
        return flags, False
    hidden = False
    seen = set()
    for name, value in ATTRIBUTE.findall(rest):
        name = name.lower()
        if name not in ATTRIBUTES or name in seen:  # of an attribute given twice the first counts
            continue
        seen.add(name)
        value = html.unescape(value[1:-1] if value[:1] in ("'", '"') and value[-1] == value[0] else value)
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true"):
            hidden = True
        elif name == "style":
            hidden |= bool(NOT_SHOWN.search(value))
        elif name == "role":
            if value.lower() in ASIDE_ROLES:
                flags |= TAG_ASIDE
            elif value.lower() in ("main", "article"):
                flags |= TAG_ARTICLE
        elif name != "aria-hidden":
            for given in value.split():
                flags |= _named(given, inside_article)
    return flags, hidden


def _ended(tag: str) -> tuple[set[str], set[str]]:
    """What an end tag in a hidden part closes, and the border up to which it does."""
    if tag in UNSEEN:
        return {tag}, set()
    if tag in INLINE:
        return {tag}, UNSEEN
    if tag == "table" or tag in IN_TABLE:
        return {tag}, UNSEEN | {"table"}
    if tag == "li":
        return {tag}, SCOPE | {"ul", "ol"}
    return HEADINGS if tag in HEADINGS else {tag}, SCOPE if tag == "p" else SCOPE - {"button"}


def parse(trees: Trees, page: int, source: str, anonymous: bool = False) -> None:
    """Add the tree of one page. With `anonymous`, article elements become plain ones.

    Block elements are nodes. Inline elements only pass their text on; a run of inline content
    is one text block, a leaf. Scripts, styles, comments and hidden elements are left out.
    Unclosed and misnested elements are closed as a browser would do it for blocks.
    """
    stack = [("#root", trees.add(page, -1, "#root", 0))]
    opened: dict[str, int] = {"#root": 1}
    links = 0
    hidden_at: list[str] = []  # open elements from the outermost that is not shown
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                trees.add(page, stack[-1][1], "#text", 0, text, min(linked, len(text)))
            pieces.clear()
        linked = 0

    def pop_to(at: int) -> None:
        flush()
        while len(stack) > at:
            opened[stack.pop()[0]] -= 1

    def close(names: set[str], border: set[str]) -> None:
        if not any(opened.get(n) for n in names):
            return
        for at in range(len(stack) - 1, 0, -1):
            if stack[at][0] in border:
                return
            if stack[at][0] in names:
                pop_to(at)
                return

    def leave_hidden(names: set[str], border: set[str], innermost: bool = False) -> bool:
        """Close what is open of `names` within `border`; whether the hidden part ends with an element around it."""
        found = len(hidden_at)
        for at in range(len(hidden_at) - 1, -1, -1):
            if hidden_at[at] in names:
                found = at
                if innermost:
                    break
            if hidden_at[at] in border:
                break
        else:
            for name, _ in reversed(stack):
                if name in names:
                    hidden_at.clear()
                    return True
                if name in border:
                    break
        del hidden_at[found:]
        return False

    done = 0
    for match in TOKEN.finditer(source):
        if hidden_at == ["head"] and source[done : match.start()].strip():
            hidden_at.clear()
        if match.start() > done and not hidden_at:
            text = source[done : match.start()]
            pieces.append(text)
            if links:
                linked += len(text.strip())
        done = match.end()
        tag = match["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        end = bool(match["end"])
        if hidden_at:
            above = False
            if end:
                above = leave_hidden(*_ended(tag), innermost=True)
                if tag == "ruby" and hidden_at and hidden_at[0] in RUBY:
                    hidden_at.clear()
            elif hidden_at[0] == "head":
                # The body, or what cannot stand in a head, ends the head.
                if tag == "body" or (len(hidden_at) == 1 and tag not in IN_HEAD):
                    hidden_at.clear()
            else:
                if tag in HIDDEN_ENDS_PARAGRAPH:
                    leave_hidden({"p"}, SCOPE)
                if hidden_at and tag in HIDDEN_CLOSES:
                    leave_hidden(*HIDDEN_CLOSES[tag])
            if hidden_at:
                if not end and tag not in VOID:
                    hidden_at.append(tag)
                continue
            if end and not above:
                continue
        if tag in VOID or tag in INLINE:
            if tag == "br" or tag == "hr":
                pieces.append("\n")
                if tag == "hr":
                    flush()
            elif tag == "a":
                links = 0 if end else 1
            if not end and tag not in VOID and _hidden(match["rest"]):
                hidden_at.append(tag)
            continue
        if end:
            if opened.get(tag):
                at = len(stack) - 1
                while stack[at][0] != tag:
                    at -= 1
                pop_to(at)
                links = 0
            else:
                flush()
            continue
        if tag in UNSEEN and not match["rest"].endswith("/>"):
            hidden_at.append(tag)
            continue
        if tag in ENDS_PARAGRAPH:
            close({"p"}, {"table", "td", "th", "div", "section", "article", "main", "li", "blockquote", "body"})
            links = 0
        if tag in CLOSES:
            close(*CLOSES[tag])
        flush()
        above = trees.own[stack[-1][1]] | trees.within[stack[-1][1]]
        flags, hidden = _flags(tag, match["rest"], bool(above & TAG_ARTICLE))
        if hidden:
            hidden_at.append(tag)
            continue
        name = tag
        if tag in UNNAMED:
            flags &= ~NAMES
        if anonymous and tag in ARTICLE:
            name, flags = "div", flags & ~(TAG_ARTICLE | NAME_ARTICLE)
        stack.append((tag, trees.add(page, stack[-1][1], name, flags)))
        opened[tag] = opened.get(tag, 0) + 1
    if hidden_at in ([], ["head"]):
        pieces.append(source[done:])
    flush()


def _hidden(rest: str) -> bool:
    return len(rest) > 5 and bool(MAY_HIDE.search(rest)) and _flags("", rest, True)[1]


LEAF_LENGTHS = np.array([20, 60, 150, 400, 1000])
LINK_SHARES = np.array([0.1, 0.4, 0.8])
SENTENCES = np.array([1, 2, 4])
FAMILIES = (len(TAGS), len(TAGS), 2**TAG_FLAGS, 2**TAG_FLAGS, 16, 16, 2, 2, 2 * 6 * 4, 2 * 4 * 4, 2 * 5)


@dataclass
class Nodes:
    page: np.ndarray
    parent: np.ndarray
    leaf: np.ndarray
    levels: list[np.ndarray]  # node numbers by depth
    features: list[np.ndarray]
    asides: np.ndarray  # aside names of the node itself or above it


def nodes_of(trees: Trees) -> Nodes:
    parent, depth, tag = (np.array(x, np.int64) for x in (trees.parent, trees.depth, trees.tag))
    page = np.array(trees.page, np.int64)
    leaf = tag == TAG_NUMBER["#text"]
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []
    size = np.fromiter(map(len, trees.text), np.int64, len(tag))
    stops = np.fromiter((t.count(". ") + t.count(", ") + t.endswith(".") for t in trees.text), np.int64, len(tag))
    sums = np.stack([size, np.array(trees.linked, np.int64), stops], axis=1)
    for level in reversed(levels[1:]):
        np.add.at(sums, parent[level], sums[level])
    total = np.maximum(sums[:, 0], 1)
    above = np.maximum(parent, 0)
    roots = np.flatnonzero(parent < 0)
    whole = total[roots][np.searchsorted(roots, np.arange(len(tag)), "right") - 1]
    length = np.searchsorted(LEAF_LENGTHS, sums[:, 0], "right")
    links = np.searchsorted(LINK_SHARES, sums[:, 1] / total, "right")
    sentences = np.searchsorted(SENTENCES, sums[:, 2], "right")
    part = sums[:, 0] / whole
    share = np.searchsorted([0.05, 0.2, 0.5, 0.8], part, "right")
    own, within = np.array(trees.own, np.int64), np.array(trees.within, np.int64)
    clear = np.zeros(len(tag), np.int64)
    for number, (flag, most) in enumerate(NAME_SHARES, 1):
        clear[(own & flag > 0) & (part <= most)] = number
    named = np.where(clear, clear * 4 + np.searchsorted(NAME_STOPS, sums[:, 2], "right"), 0)
    over = np.zeros(len(tag), np.int64)  # the strongest above
    prior = NAME_PRIOR.ravel()
    for level in levels[1:]:
        a, b = over[parent[level]], named[parent[level]]
        over[level] = np.where(prior[a] <= prior[b], a, b)
    features = [
        tag,
        tag[above],
        own >> TAG_SHIFT,
        within >> TAG_SHIFT,
        named,
        over,
        (own & NAME_ARTICLE) // NAME_ARTICLE,
        (within & NAME_ARTICLE) // NAME_ARTICLE,
        (leaf * 6 + length) * 4 + links,
        (leaf * 4 + sentences) * 4 + links,
        leaf * 5 + share,
    ]
    return Nodes(page, parent, leaf, levels, features, named | over)


def prior_weights() -> list[np.ndarray]:
    """What is known of HTML before any page is seen; fitting moves away from it only on evidence."""
    weights = [np.zeros(n) for n in FAMILIES]
    for family, scale in ((0, 1.0), (1, 1.5)):
        for flags in range(2**TAG_FLAGS):
            value = 1.5 if flags << TAG_SHIFT & TAG_ARTICLE else 0.0
            if flags << TAG_SHIFT & (TAG_ASIDE | PAGE_HEADER):
                value = -5.0
            weights[2 + family][flags] = scale * value
        weights[4 + family][:] = scale * NAME_PRIOR.ravel()
        weights[6 + family][1] = scale
    weights[0][TAG_NUMBER["#text"]] = 1.0
    for length in range(len(LEAF_LENGTHS) + 1):
        weights[8][(6 + length) * 4 : (6 + length) * 4 + 2] = 0.4 * max(length - 2, 0)  # long, without many links
        weights[8][(6 + length) * 4 + 2 : (6 + length) * 4 + 4] = -1.5, -3.0  # mostly or only links
    for sentences in range(len(SENTENCES) + 1):
        weights[9][(4 + sentences) * 4 : (4 + sentences) * 4 + 2] = 0.4 * max(sentences - 1, 0)
    return weights


@dataclass
class Model:
    weights: list[np.ndarray]  # log-odds of content by feature
    edges: np.ndarray  # [is leaf, parent's state, child's state]

    def marginals(self, nodes: Nodes, truth: np.ndarray | None = None):
        """Log-beliefs of both states of each node, and of each node with its parent.

        Sum-product: messages go up from the deepest level to the roots and down again. Pages are
        separate trees, so one pass serves a block of them. With `truth`, states that are not
        negative there are given.
        """
        n = len(nodes.page)
        base = np.zeros((n, 2))
        for weights, ids in zip(self.weights, nodes.features):
            base[:, 1] += weights[ids]
        if truth is not None:
            for state in (0, 1):
                base[truth == 1 - state, state] -= 1e4
        kind = nodes.leaf.astype(np.int64)
        gathered, up, down = base.copy(), np.zeros((n, 2)), np.zeros((n, 2))
        for level in reversed(nodes.levels[1:]):
            both = self.edges[kind[level]] + gathered[level][:, None, :]
            up[level] = np.logaddexp(both[:, :, 0], both[:, :, 1])
            np.add.at(gathered, nodes.parent[level], up[level])
        pairs = np.zeros((n, 2, 2))
        for level in nodes.levels[1:]:
            above = nodes.parent[level]
            outside = gathered[above] + down[above] - up[level]
            both = self.edges[kind[level]] + outside[:, :, None]
            down[level] = np.logaddexp(both[:, 0, :], both[:, 1, :])
            down[level] -= down[level].max(axis=1, keepdims=True)
            pairs[level] = both + gathered[level][:, None, :]
        return gathered + down, pairs

    def content(self, nodes: Nodes) -> np.ndarray:
        """Probability that each node is content."""
        beliefs, _ = self.marginals(nodes)
        return 1 / (1 + np.exp(np.clip(beliefs[:, 0] - beliefs[:, 1], -50, 50)))


def _joint(nodes: Nodes, kind: np.ndarray, child: np.ndarray, beliefs: np.ndarray, pairs: np.ndarray):
    """Probability that each node is content, and expected states of a node and its parent by kind."""
    p = 1 / (1 + np.exp(np.clip(beliefs[:, 0] - beliefs[:, 1], -50, 50)))
    joint = pairs[child]
    joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    expected = np.zeros((2, 2, 2))
    np.add.at(expected, kind[child], joint)
    return p, expected


def _train(nodes: Nodes, truth: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Maximum likelihood with a Gaussian prior, by exact gradients of the trees' marginals.

    Nodes whose truth is negative are summed over: their states follow from the given ones.
    """
    model = Model(prior_weights(), np.array([[[0.5, -0.5], [-0.5, 0.5]], [[0.5, -0.5], [-0.5, 0.5]]]))
    anchor = [w.copy() for w in model.weights] + [model.edges.copy()]
    parts = [*model.weights, model.edges]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    kind = nodes.leaf.astype(np.int64)
    child = np.flatnonzero(nodes.parent >= 0)
    open_, given = bool((truth < 0).any()), truth
    seen = np.zeros((2, 2, 2))
    if not open_:
        np.add.at(seen, (kind[child], truth[nodes.parent[child]], truth[child]), 1)
    for epoch in range(1, epochs + 1):
        p, expected = _joint(nodes, kind, child, *model.marginals(nodes))
        if open_:
            given, seen = _joint(nodes, kind, child, *model.marginals(nodes, truth))
        grads = [np.bincount(ids, given - p, len(w)) for w, ids in zip(model.weights, nodes.features)]
        grads.append(seen - expected)
        for part, grad, mean, m, v in zip(parts, grads, anchor, first, second):
            grad = grad - 0.3 * (part - mean)
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            part += 0.1 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    return model


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model fitted on at most `sample_pages` pages that mark their article themselves.

    Pages with an article or main element are the labelled ones, taken in the order of a hash: what
    stands in that element, and not in a nav, footer or the like within it, is content. Parts of it that only a class
    or id calls an aside are left open. Each page is seen a second time with
    that element made anonymous, so that the model also learns what content looks like without it.
    Without such pages the prior weights are used as they are.
    """
    labelled = pages.select("page_id", "html").where(
        F.lower("html").rlike(r"<(article|main)[\s>]") & (F.length("html") <= sample_chars)
    )
    chosen = sampled(labelled, "page_id", sample_pages).orderBy("page_id")
    return fit_pages([row["html"] for row in chosen.select("html").collect()])


def fit_pages(sources: list[str]) -> Model:
    trees, truth = Trees(), []
    for i, source in enumerate(sources):
        begin = len(trees.page)
        parse(trees, 2 * i, source)
        flags = [a | b for a, b in zip(trees.own[begin:], trees.within[begin:])]
        label = [int(bool(f & TAG_ARTICLE) and not f & TAG_ASIDE) for f in flags]
        parse(trees, 2 * i + 1, source, anonymous=True)
        truth += label + label
    if not truth:
        return Model(prior_weights(), np.array([[[0.5, -0.5], [-0.5, 0.5]]] * 2))
    nodes, states = nodes_of(trees), np.array(truth)
    return _train(nodes, np.where((states == 1) & (nodes.asides > 0), -1, states))


def extract_block(sources: list, model: Model) -> list[str]:
    trees = Trees()
    for i, source in enumerate(sources):
        if source:
            parse(trees, i, source)
    texts: list[list[str]] = [[] for _ in sources]
    if trees.page:
        nodes = nodes_of(trees)
        for node in np.flatnonzero(nodes.leaf & (model.content(nodes) >= 0.5)).tolist():
            texts[trees.page[node]].append(trees.text[node])
    return ["\n\n".join(t) for t in texts]


def extract(pages: DataFrame, model: Model, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """One row a page: page_id, url, text, n_chars (code points).

    Each page becomes a tree of its block elements with text blocks as leaves; every node is
    content or not. Node potentials come from tag, names, lengths, links and place, edge potentials
    tie a node to its parent, and sum-product messages give the probability of content of each text block. The blocks at
    0.5 and above are joined in page order. Whole pages are read; nothing is shuffled.

    Null or empty html gives an empty text. Broken markup is closed as far as it goes. Null ids and
    urls, repeated rows and empty tables come out as they are; further columns are not looked at.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block_pages):
                part = batch.slice(at, block_pages)
                texts = extract_block(part.column("html").to_pylist(), shared.value)
                yield pa.record_batch(
                    {
                        "page_id": pc.cast(part.column("page_id"), pa.int64()),
                        "url": pc.cast(part.column("url"), pa.string()),
                        "text": pa.array(texts, pa.string()),
                        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                    }
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
