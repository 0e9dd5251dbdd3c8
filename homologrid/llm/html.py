"""HTML extraction by a tree-structured graphical model.

1. A page becomes a tree of elements and texts: tags, implied ends, raw texts and character
   references as browsers read them.  Scripts, styles and the like never enter it.
2. Every node that holds text has a hidden state: not content, content, or around content (what holds the
   article besides other parts).  Node potentials are sums of weights over features (tag, hints in class, id and
   role, lengths, links, punctuation, place); potentials between parent and child depend on the kind of the child.
3. Sum-product messages go up from the leaves and down from the root, level by level over all pages of
   a batch at once, and give the exact marginal of every node.  Texts with a marginal of one half or more stay.
4. Weights are fitted on labelled pages: the gradient of the likelihood is what the labels count less what the
   marginals expect.  The given tables label no page, so the default set is composed by a seeded rule:
   ``LABELLED_PAGES`` pages of many layouts, with and without telling names.  ``fit`` takes any other labelled pages.

Defined results: a null, empty or textless page gives an empty text; pages of any length and depth are read
whole; equal pages give equal texts; repeated rows stay; an empty table gives an empty table; further columns, whatever
their names, stay in ``with_main_text`` (its own two names must be free, or given otherwise) and are not read by the query.
A line break element is white space; white space is what Unicode calls so, the no-break space included.
"""

from __future__ import annotations

import html as references
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homologrid.llm.common import bounded_batches, extended, quoted, table, text_bytes

LABELLED_PAGES = 500
FIT_STEPS = 90
FIT_RATE = 0.3
PENALTY = 1e-5
SEED = 7
# Bytes of pages whose trees are held at once.
BATCH_BYTES = 4 << 20

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</?([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)

# Kinds of elements of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg math noembed noframes xmp textarea title object canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr img br nobr".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
# An implied end does not reach beyond these.
FENCES = frozenset("ul ol dl table select body html article section main div aside nav header footer form".split())

TAGS = (
    "html body div section article main aside nav header footer form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th "
    "blockquote pre figure figcaption button fieldset details address a b i em strong span small label text"
).split()
# Stems of names that pages give to their parts.
HINTS = (
    "nav menu crumb head masthead brand logo foot copyright side widget related recommend popular trend more tag cookie "
    "consent notice alert popup modal overlay newsletter subscri signup sign login search form ad ads advert sponsor promo "
    "banner comment repl discuss respond share social follow author byline meta skip tool pagin article content post "
    "entry main story body text page wrap container column lead summary caption"
).split()

# Kinds of children for the potentials between parent and child.
TEXT, INLINE_CHILD, BLOCK, CONTAINER = range(4)
CONTAINERS = frozenset("html body div section article main aside nav header footer form table tr td ul ol".split())


@dataclass
class Tree:
    """Nodes in page order; the parent stands before its children.  Node 0 is the root."""

    tag: list[str] = field(default_factory=lambda: ["html"])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    hints: list[str] = field(default_factory=lambda: [""])
    # Texts: node (or -1 for white space alone), block number, decoded text.
    texts: list[tuple[int, int, str]] = field(default_factory=list)

    def add(self, tag: str, parent: int, hints: str) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.hints.append(hints)
        return len(self.tag) - 1


def _hints(attributes: str) -> str:
    if "=" not in attributes and "hidden" not in attributes:
        return ""
    out = []
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "style":
            if "none" in value.replace(" ", "").partition("display:")[2][:4]:
                out.append("hidden")
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            out.append("hidden")
        elif name != "aria-hidden":
            out.append(re.sub(r"([a-z])([A-Z])", r"\1 \2", value))
    return " ".join(out)


def parsed(page: str) -> Tree:
    """The tree of a page."""
    tree, stack, opened = Tree(), [("html", 0)], {"html": 1}
    at, block, size = 0, 0, len(page)

    def text(upto: int) -> None:
        raw = page[at:upto]
        if not raw:
            return
        plain = references.unescape(raw) if "&" in raw else raw
        if plain.isspace():
            tree.texts.append((-1, block, " "))
        else:
            tree.texts.append((tree.add("text", stack[-1][1], ""), block, plain))

    def pop_to(place: int) -> None:
        nonlocal block
        for name, _ in stack[place:]:
            opened[name] -= 1
            if name not in INLINE:
                block += 1
        del stack[place:]

    def close_implied(names: set[str], fences: frozenset) -> None:
        """Close the outermost open element of ``names`` above the nearest fence."""
        found = None
        for place in range(len(stack) - 1, 0, -1):
            name = stack[place][0]
            if name in names:
                found = place
            elif name in fences:
                break
        if found is not None:
            pop_to(found)

    for_token = TOKEN.search
    while True:
        match = for_token(page, at)
        if match is None:
            text(size)
            return tree
        start, end = match.span()
        name = match.group(1)
        text(start)
        at = end
        if name is None:
            continue
        name = name.lower()
        if page[start + 1] == "/":
            if name == "p" or name == "br":
                if not opened.get("p"):
                    block += name == "p"
                    continue
            if opened.get(name):
                place = len(stack) - 1
                while stack[place][0] != name:
                    # The end of an inline element does not close blocks.
                    if name in INLINE and stack[place][0] not in INLINE:
                        place = 0
                        break
                    place -= 1
                if place:
                    pop_to(place)
            continue
        if name in RAW:
            close = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>", re.I).search(page, end)
            at = close.end() if close else size
            if name not in INLINE:
                tree.texts.append((-1, block, " "))
            continue
        if name == "br":
            tree.texts.append((-1, block, " "))
            continue
        if name in ("html", "body", "head"):
            if name == "body" and not opened.get("body"):
                stack.append((name, tree.add(name, stack[-1][1], _hints(match.group(2)))))
                opened[name] = 1
            continue
        if name not in INLINE:
            block += 1
            if opened.get("p"):
                close_implied({"p"}, FENCES)
        if name in CLOSES and any(opened.get(n) for n in CLOSES[name]):
            close_implied(CLOSES[name], FENCES - {"table"} if name == "option" else FENCES)
        if name in VOID:
            continue
        stack.append((name, tree.add(name, stack[-1][1], _hints(match.group(2)))))
        opened[name] = opened.get(name, 0) + 1


_TAG = {t: i for i, t in enumerate(TAGS)}
_OTHER_TAG = len(TAGS)
_HINT = {h: len(TAGS) + 1 + i for i, h in enumerate(HINTS)}
_HIDDEN = len(TAGS) + 1 + len(HINTS)
_SIZES = _HIDDEN + 1  # eight buckets of text length, for texts and for elements
_LINKS = _SIZES + 16  # four buckets of the share of linked text
_ENDS = _LINKS + 4  # texts: ends like a sentence; holds one
_PLACES = _ENDS + 2  # five parts of the page
_SHARE = _PLACES + 5  # four buckets of the share of the page's text
_PROSE = _SHARE + 4  # elements: half of the text in paragraphs; with sentences
FEATURES = _PROSE + 2

_MARKS: dict[str, tuple[int, ...]] = {}


def _hint_marks(hints: str) -> tuple[int, ...]:
    """Features of the names of an element."""
    if not hints:
        return ()
    marks = _MARKS.get(hints)
    if marks is None:
        found = set()
        for word in re.findall(r"[a-z]+", hints.lower()):
            if word == "hidden":
                found.add(_HIDDEN)
            for stem in HINTS:
                # Short stems are whole words; longer ones begin or end a word.
                if word == stem or (len(stem) > 3 and (word.startswith(stem) or word.endswith(stem))):
                    found.add(_HINT[stem])
        marks = tuple(sorted(found))
        if len(_MARKS) < 1 << 14:
            _MARKS[hints] = marks
    return marks


@dataclass
class Forest:
    """The nodes with text of several pages: parents, levels, kinds, features as index lists."""

    parent: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]
    marks: np.ndarray
    bounds: np.ndarray
    # Nodes of the texts, in page order; where each page's texts start.
    leaves: list[list[int]]


def forest(trees: list[Tree]) -> Forest:
    parent, depth, kind, marks, bounds, leaves = [], [], [], [], [0], []
    base = 0
    for tree in trees:
        count = len(tree.tag)
        total, linked, prose, sentences = ([0] * count for _ in range(4))
        in_link, in_prose = [False] * count, [False] * count
        for node in range(1, count):
            up = tree.parent[node]
            in_link[node] = in_link[up] or tree.tag[node] in ("a", "button", "option", "label")
            in_prose[node] = in_prose[up] or tree.tag[node] in ("p", "blockquote", "pre")
        length, ends, holds, before, sum_before = {}, {}, {}, {}, 0
        for node, _, plain in tree.texts:
            if node < 0:
                continue
            stripped = plain.strip()
            n = len(stripped)
            length[node], before[node] = n, sum_before
            sum_before += n
            ends[node] = stripped[-1] in ".!?:;\"'”»)"
            holds[node] = any(c in stripped for c in (". ", ", ", "! ", "? "))
            total[node] = n
            linked[node] = n * in_link[node]
            prose[node] = n * in_prose[node]
            sentences[node] = n * ends[node]
        for node in range(count - 1, 0, -1):
            up = tree.parent[node]
            total[up] += total[node]
            linked[up] += linked[node]
            prose[up] += prose[node]
            sentences[up] += sentences[node]
        number, first = [-1] * count, {}
        whole = max(1, sum_before)
        own_leaves = []
        for node in range(count):
            if not total[node] and node:
                continue
            number[node] = base
            tag, up = tree.tag[node], tree.parent[node]
            parent.append(number[up] if up >= 0 else -1)
            depth.append(tree.depth[node])
            is_text = tag == "text"
            kind.append(
                TEXT if is_text else CONTAINER if tag in CONTAINERS else INLINE_CHILD if tag in INLINE else BLOCK
            )
            own = [_TAG.get(tag, _OTHER_TAG), *_hint_marks(tree.hints[node])]
            size = min(7, int(math.log2(total[node] + 1) / 1.5))
            share_linked = linked[node] / max(1, total[node])
            own.append(_LINKS + (0 if not share_linked else 1 if share_linked < 0.3 else 2 if share_linked < 0.8 else 3))
            if is_text:
                own.append(_SIZES + size)
                if ends[node]:
                    own.append(_ENDS)
                if holds[node]:
                    own.append(_ENDS + 1)
                own.append(_PLACES + min(4, 5 * before[node] // whole))
                own_leaves.append(base)
            else:
                own.append(_SIZES + 8 + size)
                share = total[node] / whole
                own.append(_SHARE + (0 if share < 0.05 else 1 if share < 0.3 else 2 if share < 0.98 else 3))
                if 2 * prose[node] >= total[node]:
                    own.append(_PROSE)
                if 2 * sentences[node] >= total[node]:
                    own.append(_PROSE + 1)
            marks += own
            bounds.append(len(marks))
            base += 1
        leaves.append(own_leaves)
    depths = np.array(depth, np.int64)
    order = np.argsort(depths, kind="stable")
    cuts = np.flatnonzero(np.diff(depths[order])) + 1
    return Forest(
        np.array(parent, np.int64), np.array(kind, np.int64), np.split(order, cuts) if len(order) else [],
        np.array(marks, np.int64), np.array(bounds, np.int64), leaves,
    )


# States of a node.
OTHER, CONTENT, AROUND = range(3)


@dataclass
class Model:
    """``nodes[feature, state]`` (0 for OTHER) and ``edges[kind, parent, child]``."""

    nodes: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, 3)))
    edges: np.ndarray = field(default_factory=lambda: np.zeros((4, 3, 3)))


def _normed(logs: np.ndarray) -> np.ndarray:
    """The logarithms of weights as weights with largest value 1."""
    return np.exp(logs - logs.max(axis=-1, keepdims=True))


def marginals(woods: Forest, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the states of every node, and of every (parent, child) pair of states."""
    count = len(woods.parent)
    up, message, pair = np.zeros((count, 3)), np.zeros((count, 3)), np.zeros((count, 3, 3))
    if not count:
        return up, pair
    up += np.add.reduceat(model.nodes[woods.marks], woods.bounds[:-1])
    edge = np.exp(model.edges)[woods.kind]
    for level in reversed(woods.levels[1:]):
        told = np.einsum("nij,nj->ni", edge[level], _normed(up[level]))
        message[level] = np.log(told)
        np.add.at(up, woods.parent[level], message[level])
    belief = np.zeros((count, 3))
    top = _normed(up[woods.levels[0]])
    belief[woods.levels[0]] = top / top.sum(axis=1, keepdims=True)
    for level in woods.levels[1:]:
        # What the parent knows without this child, joined with the child's side.
        with np.errstate(divide="ignore"):
            rest = _normed(np.log(belief[woods.parent[level]]) - message[level])
        joint = rest[:, :, None] * edge[level] * _normed(up[level])[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        pair[level] = joint
        belief[level] = joint.sum(axis=1)
    return belief, pair


def _truth(tree: Tree, content: frozenset[str]) -> list[int]:
    """State of every node with text.

    The article is the smallest element that holds all content, and what wraps nothing else;
    elements around it are AROUND, nodes in it with content CONTENT, all the rest OTHER.
    """
    count = len(tree.tag)
    good, bad = [0] * count, [0] * count
    for node, _, plain in tree.texts:
        if node >= 0:
            (good if " ".join(plain.split()) in content else bad)[node] = 1
    for node in range(count - 1, 0, -1):
        good[tree.parent[node]] += good[node]
        bad[tree.parent[node]] += bad[node]
    state = [OTHER] * count
    around = [i for i in range(count) if good[i] == good[0] and good[0]]
    smallest = around[-1] if around else 0
    while tree.parent[smallest] >= 0 and bad[tree.parent[smallest]] == bad[smallest]:
        smallest = tree.parent[smallest]
    inside = [False] * count
    for node in range(count):
        up = tree.parent[node]
        inside[node] = node == smallest or (up >= 0 and inside[up])
        if good[node]:
            state[node] = CONTENT if inside[node] else AROUND
    return [s for i, s in enumerate(state) if good[i] or bad[i] or not i]


def fit(labelled: Iterable[tuple[str, Iterable[str]]], steps: int = FIT_STEPS) -> Model:
    """Weights of the greatest penalised likelihood; a labelled page is its HTML and its texts of content.

    The pages are a bounded set: they are held in memory.
    """
    trees, labels = [], []
    for page, content in labelled:
        tree = parsed(page)
        trees.append(tree)
        labels += _truth(tree, frozenset(" ".join(c.split()) for c in content))
    woods, truth = forest(trees), np.array(labels)
    inner = np.flatnonzero(woods.parent >= 0)
    kinds = woods.kind[inner]
    pairs = np.zeros((4, 3, 3))
    np.add.at(pairs, (kinds, truth[woods.parent[inner]], truth[inner]), 1)
    owner = np.repeat(np.arange(len(truth)), np.diff(woods.bounds))

    def by_feature(weights: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(woods.marks, w[owner], FEATURES) for w in weights.T], axis=1)

    seen = by_feature(np.eye(3)[truth])
    model, scale = Model(), 1 / max(1, len(trees))
    # Steps by running means of the gradient and of its square.
    means = [(np.zeros_like(w), np.zeros_like(w)) for w in (model.nodes, model.edges)]
    for step in range(1, steps + 1):
        belief, pair = marginals(woods, model)
        expected = np.stack([pair[inner[kinds == k]].sum(axis=0) for k in range(4)])
        slopes = ((seen - by_feature(belief)) * scale, (pairs - expected) * scale)
        for weights, slope, (mean, square) in zip((model.nodes, model.edges), slopes, means):
            slope = slope - PENALTY * weights
            mean *= 0.9
            mean += 0.1 * slope
            square *= 0.99
            square += 0.01 * slope**2
            weights += FIT_RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        model.nodes -= model.nodes[:, :1]
    return model


def composed_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page of a random layout and its texts of content."""
    # Content and other parts share no words, so a text tells which it is; no feature sees letters.
    own = ["ka", "lo", "mi", "tren", "so", "da", "eth"]
    others = ["ur", "ban", "ti", "qua", "ö", "ñe", "ri"]

    def words(n: int) -> str:
        syllables = own if content_open else others
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))

    # Some articles are prose, some are not: repeated words, lists without sentences, symbols.
    odd, brief = rng.random(), rng.random() < 0.2

    def sentences(n: int) -> str:
        if content_open and odd < 0.08:
            return " ".join([words(1)] * rng.randint(5, 60 * n))
        if content_open and odd < 0.14:
            return " | ".join(words(1) for _ in range(rng.randint(2, 20 * n)))
        if content_open and odd < 0.2:
            return " ".join(words(1) + rng.choice(["***", "%%%", "###", "&&&", "", "1234"]) for _ in range(rng.randint(3, 40 * n)))
        if content_open and odd < 0.26:
            return words(rng.randint(1, 60 * n))
        return " ".join(words(rng.randint(3, 18)).capitalize() + rng.choice("...!?") for _ in range(n))

    def named(tag: str, names: str, inner: str) -> str:
        """The element under its own tag, or a neutral one with a telling name, or with none."""
        way = rng.random()
        name = rng.choice(names.split())
        if way < 0.4 and tag != "div":
            return f"<{tag}>{inner}</{tag}>"
        if way < 0.96:
            where = rng.choice(["class", "id", "class"])
            plain = tag if rng.random() < 0.3 else rng.choice(["div", "section", "div"])
            more = rng.choice(["", "", " x1", " col-3"])
            return f'<{plain} {where}="{name}{more}">{inner}</{plain}>'
        return f"<div>{inner}</div>"

    def links(n: int) -> str:
        items = [f'<a href="/{i}">{words(rng.randint(1, 3))}</a>' for i in range(n)]
        if rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{a}</li>" for a in items) + "</ul>"
        return rng.choice([" | ", " ", "\n"]).join(items)

    content: list[str] = []
    content_open = False

    def kept(text: str) -> str:
        content.append(text)
        return text

    def paragraph() -> str:
        size = 1 if brief else rng.choice([1, 1, 2, 3, 5, 8])
        way = rng.random()
        if brief or way < 0.6:
            text = words(rng.randint(1, 7)).capitalize() + "." if brief else sentences(size * rng.choice([1, 1, 1, 6]))
            return f"<p><b>{kept(text)}<br>" if way < 0.15 else f"<p>{kept(text)}</p>"
        if way < 0.7:
            return f"<p><b>{kept(sentences(size))}<br>"
        if way < 0.85:
            return (
                f"<p>{kept(sentences(size))} <a href='/x'>{kept(words(2))}</a> {kept(words(4))} "
                f"<em>{kept(words(1))}</em> {kept(sentences(1))}</p>"
            )
        if way < 0.93:
            return f"<div>{kept(sentences(size))}</div>"
        return f"<p>{kept(words(rng.randint(1, 3)).capitalize() + '.')}</p>"

    def article() -> str:
        nonlocal content_open
        parts, content_open = [], True
        if rng.random() < 0.85:
            title = f"<h1>{kept(words(rng.randint(2, 8)).capitalize())}</h1>"
            parts.append(f"<header>{title}</header>" if rng.random() < 0.15 else title)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 12, 25]) * (1 + brief)):
            way = rng.random()
            if way < 0.1:
                level = rng.choice("234")
                parts.append(f"<h{level}>{kept(words(rng.randint(2, 6)).capitalize())}</h{level}>")
            elif way < 0.17:
                tag = rng.choice(["ul", "ol"])
                items = [f"<li>{kept(rng.choice([words(5), sentences(1)]))}</li>" for _ in range(rng.randint(2, 6))]
                parts.append(f"<{tag}>{''.join(items)}</{tag}>")
            elif way < 0.21:
                parts.append(f"<blockquote>{kept(sentences(2))}</blockquote>")
            elif way < 0.24:
                cells = "".join(f"<tr><td>{kept(words(2))}</td><td>{kept(words(3))}</td></tr>" for _ in range(3))
                parts.append(f"<table>{cells}</table>")
            elif way < 0.26:
                parts.append(f"<pre>{kept(words(9))}</pre>")
            elif way < 0.29:
                parts.append(f"<figure><img src='x'><figcaption>{kept(sentences(1))}</figcaption></figure>")
            else:
                parts.append(paragraph())
            # What stands inside an article without being part of it.
            content_open, inside = False, rng.random()
            if inside < 0.06:
                parts.append(advert())
            elif inside < 0.09:
                parts.append(named("div", "share social-links sharing share-buttons follow-us", links(3)))
            elif inside < 0.12:
                parts.append(named("aside", "related related-posts recommended more-stories read-more", words(2) + links(3)))
            content_open = True
        if not parts or not content:
            parts.append(paragraph())
        if rng.random() < 0.1:
            # A line that repeats, as in records of all kinds.
            line = kept(words(rng.randint(1, 4)).capitalize() + ".")
            times = rng.randint(8, 50)
            content.extend([line] * (times - 1))
            parts += [f"<p><b>{line}<br>" if i % 7 == 3 else f"<p>{line}</p>" for i in range(times)]
        body = "".join(parts)
        names = "content article post entry main-content article-body post-content story entry-content page-content main"
        content_open = False
        if rng.random() < 0.2:
            body = f"<div class='{rng.choice(names.split())}'>{body}</div>"
        return named("article", names, body) if rng.random() < 0.7 else f"<article>{body}</article>"

    def advert() -> str:
        inner = rng.choice([sentences(rng.randint(1, 4)), f"<p>{sentences(1)}</p>", f"<a href='/b'>{words(4)}</a>"])
        return named("div", "ad ads advert advertisement ad-slot sponsored promo banner-ad sponsor ad-container", inner)

    def comments() -> str:
        one = [
            f"<div class='{rng.choice(['comment', 'reply', 'comment-body', 'c'])}'><b>{words(1)}</b><p>{sentences(rng.randint(1, 4))}</p></div>"
            for _ in range(rng.randint(1, 5))
        ]
        head = rng.choice(["", f"<h3>{words(2)}</h3>"])
        inner = head + "".join(one)
        return f"<{(t := rng.choice(['div', 'section', 'ol', 'div']))} {rng.choice(['id', 'class'])}='{rng.choice(['comments', 'comment-list', 'discussion', 'responses', 'replies', 'reader-comments'])}'>{inner}</{t}>"

    def notice() -> str:
        inner = rng.choice([sentences(rng.randint(1, 3)), f"<p>{sentences(1)}</p><button>{words(1)}</button>"])
        return named("div", "cookie cookie-notice consent notice alert popup modal newsletter subscribe gdpr-consent", inner)

    def form() -> str:
        return f"<form><label>{words(2)}</label><input name='q'><button>{words(1)}</button>{rng.choice(['', '<p>' + sentences(1) + '</p>'])}</form>"

    def sidebar() -> str:
        inner = rng.choice([f"<h3>{words(2)}</h3>{links(4)}", f"<h4>{words(2)}</h4><p>{sentences(2)}</p>", links(6)])
        return named("aside", "sidebar side widget widgets sidebar-right related popular trending", inner)

    def head() -> str:
        inner = rng.choice([f"<h2>{words(2)}</h2>", f"<a href='/'>{words(2)}</a>", f"<div>{words(3)}</div>{links(4)}", f"<p>{sentences(1)}</p>"])
        return named("header", "header masthead site-header top-header branding page-header", inner)

    def menu() -> str:
        return named("nav", "nav menu navbar navigation main-menu breadcrumbs top-nav", links(rng.randint(3, 9)))

    def foot() -> str:
        inner = rng.choice([f"&copy; {words(2)} &middot; {sentences(1)}", f"<p>{sentences(2)}</p>", links(4), f"<p>{words(4)}</p>{links(3)}"])
        return f"<footer>{inner}</footer>" if rng.random() < 0.5 else named("footer", "footer site-footer page-footer copyright bottom-footer", inner)

    before = [x() for x in (head, menu, advert, notice, form, sidebar) if rng.random() < 0.4]
    after = [x() for x in (comments, sidebar, advert, notice, form) if rng.random() < 0.35]
    rng.shuffle(before)
    rng.shuffle(after)
    middle = article()
    # Reader comments may also stand at the end of the article's own element.
    if rng.random() < 0.1 and middle.endswith("</article>"):
        middle = middle[: -len("</article>")] + comments() + "</article>"
    if rng.random() < 0.9:
        after.append(foot())
    inner = rng.choice(["", "\n"]).join([*before, middle, *after])
    if rng.random() < 0.3:
        inner = f"<div {rng.choice(['class', 'id'])}='{rng.choice(['wrapper', 'container', 'page', 'main', 'site'])}'>{inner}</div>"
    end = "</body></html>" if rng.random() < 0.8 else ""
    return f"<!DOCTYPE html><html><head><title>{words(3)}</title><style>p{{}}</style></head><body>{inner}{end}", content


def composed_pages(count: int = LABELLED_PAGES, seed: int = SEED) -> list[tuple[str, list[str]]]:
    """The default labelled pages; the same for the same seed."""
    rng = random.Random(seed)
    return [composed_page(rng) for _ in range(count)]


@lru_cache(maxsize=1)
def default_model() -> Model:
    """The model of the composed pages, fitted once per driver."""
    return fit(composed_pages())


def main_texts(pages: list[str], model: Model) -> list[str]:
    """Texts of content of the pages: a line per block."""
    trees = [parsed(p) for p in pages]
    woods = forest(trees)
    content = marginals(woods, model)[0][:, CONTENT]
    out = []
    for tree, leaves in zip(trees, woods.leaves):
        chosen = iter(content[leaves] >= 0.5)
        lines: list[str] = []
        parts: list[str] = []
        now = -1
        for node, block, plain in tree.texts:
            if block != now:
                lines.append("".join(parts))
                parts, now = [], block
            if node < 0 or next(chosen):
                parts.append(plain)
        lines.append("".join(parts))
        flat = (" ".join(line.split()) for line in lines)
        out.append("\n".join(line for line in flat if line))
    return out


def with_main_text(
    pages: DataFrame, html: str = "html", model: Model | None = None, into: tuple[str, str] = ("text", "n_chars")
) -> DataFrame:
    """All columns of ``pages`` with the main text of each page and its length in code points."""
    model = model or default_model()
    columns = pages.columns
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [t.decode("utf-8", "replace") for t in text_bytes(batch.column(html))]
            start = size = 0
            for at in range(len(given)):
                size += len(given[at])
                if size >= BATCH_BYTES or at + 1 == len(given):
                    texts = main_texts(given[start : at + 1], model)
                    rows = batch.slice(start, at + 1 - start)
                    counts = pa.array(map(len, texts), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, pa.array(texts, pa.string()), counts], names=[*columns, *into]
                    )
                    start, size = at + 1, 0

    return pages.mapInArrow(run, extended(pages.schema, f"{quoted(into[0])} string, {quoted(into[1])} long"))


def op11_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", F.col("html").alias("html"))
    return with_main_text(pages).drop("html")


QUERIES = {"op11_html_text": op11_html_text}
# Marginals of a trained model have no SQL form; tests hold enumeration of all states and held-out pages against them.
ORACLES: dict[str, str] = {}
