"""Main-text extraction by a tree-structured graphical model over the DOM.

A page becomes a tree of block elements, with the text blocks as leaves. Every
node is content or not. Its own evidence (tag, class and id words, link
density, length, punctuation) gives a unary potential; parent-child potentials
say how labels go together along an edge of its kind. The graph is a tree, so
one upward and one downward pass of sum-product messages give exact marginals.
Text blocks whose marginal is at least a half make the main text.

Both kinds of potentials are learned together from labelled pages, as a
conditional random field: the same messages give the expected counts that its
gradient needs.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import row_slices, tidy
from .page_samples import labelled_pages

#: Labelled pages that the default model is fitted on.
TRAINING_PAGES = 400
#: Elements that begin and end a block; all others run in the line.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is no text of the page.
RAW = frozenset("script style noscript template svg title textarea select button iframe object canvas audio video head annotation annotation-xml".split())
#: Those of them that swallow what follows up to their end tag, markup or not. The others end with their parent, or where a block begins, if they aren't closed.
SOURCE = frozenset(("script", "style"))
#: What an opening tag closes: these elements, up to the nearest of the others.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "tr", "td", "th"), ("table",)),
}
TAGS = ("article", "main", "nav", "header", "footer", "aside", "form", "dialog", "ul", "ol", "li", "table", "td", "div", "section", "p", "h1", "h2", "h3", "blockquote", "pre", "figure", "body", "#text", "top header")
#: Words in class, id and role that tell what an element is for, in several languages; a word's language isn't a feature.
HINTS = {
    "article": "article content post entry story text body main prose".split(),
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs navigationsleiste navegacion navigazione menue".split(),
    "head": "header masthead banner logo topbar branding kopfzeile entete cabecera".split(),
    "foot": "footer copyright legal colophon contentinfo fusszeile impressum mentions pied".split(),
    "side": "sidebar aside widget widgets related popular recommended recommendations trending complementary seitenleiste randspalte".split(),
    "notice": "cookie cookies consent notice alert popup modal newsletter subscribe subscription gdpr signup overlay paywall hinweis einwilligung infolettre boletin aviso".split(),
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion adslot outbrain taboola werbung anzeige publicite publicidad reklame".split(),
    "comment": "comment comments discussion responses respond reply replies disqus kommentar kommentare commentaire commentaires comentario comentarios commenti leserbriefe guestbook".split(),
    "share": "share sharing social tags byline meta teilen partager compartir".split(),
    "form": "form search login contact suche suchfeld recherche buscar anmeldung kontakt".split(),
}
FRAMES = frozenset(("#root", "html", "body", "div", "section", "main", "table", "tbody", "tr"))
_HINT = {w: i for i, words in enumerate(HINTS.values()) for w in words}
_TAG = {t: i for i, t in enumerate(TAGS)}
_TAG["th"] = _TAG["td"]  # a table's heads are as its cells
N_FEATURES = 1 + len(TAGS) + len(HINTS) + 10

_markup = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|</?[a-zA-Z][^>]*(?:>|\Z)""", re.S)
_source_end = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in SOURCE}
_attribute = re.compile(r"""(class|id|role|data-y|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_name = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_mark = re.compile(r"[.,;:!?]")


@dataclass
class Node:
    tag: str
    parent: int
    hints: frozenset[int] = frozenset()
    y: int | None = None
    hidden: bool = False
    top: bool = False  # right below the body
    text: list[str] = field(default_factory=list)
    # of the subtree
    chars: int = 0
    linked: int = 0
    words: int = 0
    marks: int = 0
    leaves: int = 0


@dataclass(slots=True)
class Tag:
    """A tag of a page, from ``start`` to ``end``; of script and style, with all that they hold."""

    start: int
    end: int
    name: str
    closing: bool
    inside: str


def tags_of(page: str) -> list[Tag]:
    """All markup of a page in order; comments, declarations and broken tags have no name."""
    found, at, no_end = [], 0, False
    while (m := _markup.search(page, at)) is not None:
        at, name = m.end(), (m[2] or "").lower()
        if page.startswith("<![CDATA[", m.start()) and not no_end:
            close = page.find("]]>", m.start())
            no_end = close < 0  # then it ends at the first ">"
            at = at if no_end else close + 3
        elif name in SOURCE and not m[1] and not m[3].endswith("/"):
            close = _source_end[name].search(page, at)
            at = close.end() if close else len(page)
        found.append(Tag(m.start(), at, name, bool(m[1]), m[3] or ""))
    return found


def parse(page: str, labelled: bool = False) -> list[Node]:
    """The nodes of a page, parents first; text blocks have the tag ``#text`` and one piece of text.

    Labels (``data-y``) are read only from ``labelled`` pages, which are for training.
    """
    nodes, stack = [Node("#root", -1)], [0]
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of a name, in the stack
    run: list[str] = []
    linked = breaks = 0
    link_open = False
    tags = tags_of(page)
    pairs: dict[str, dict[int, int]] = {}

    def end_block() -> None:
        nonlocal linked, breaks
        if run:
            words = html.unescape("".join(run)).split()
            if words:
                text = " ".join(words)
                marks = len(_mark.findall(text))
                nodes.append(Node("#text", stack[-1], text=[text], chars=len(text), linked=min(linked, len(text)), words=len(words), marks=marks, leaves=1))
            run.clear()
        linked = breaks = 0

    def say(piece: str) -> None:
        nonlocal linked, breaks
        if piece:
            run.append(piece)
            if not piece.isspace():
                breaks = 0
                linked += len(piece) if link_open else 0

    def close_to(depth: int) -> None:
        """Elements from that place of the stack on end."""
        for i in stack[depth:]:
            places[nodes[i].tag].pop()
        del stack[depth:]

    def after(k: int) -> int:
        """Number of the first tag after the raw element that tag k opens, which may be its end tag.

        It goes on to its end tag, or to its parent's if that comes first. Without an end tag of its own it
        ends where its parent ends or the first block begins.
        """
        name = tags[k].name
        if name not in pairs:
            pairs[name], waiting = {}, []
            for i, t in enumerate(tags):
                if t.name == name and t.closing:
                    if waiting:
                        pairs[name][waiting.pop()] = i
                elif t.name == name and not t.inside.endswith("/"):
                    waiting.append(i)
        close = pairs[name].get(k)
        inner, block = Counter(), None
        for i in range(k + 1, len(tags) if close is None else close):
            t = tags[i]
            if t.name in BLOCKS and t.name not in VOID:
                if t.closing and inner[t.name]:
                    inner[t.name] -= 1
                elif t.closing and places[t.name] or t.name == "body":
                    return i if block is None else block
                elif not t.closing:
                    block = i if block is None else block
                    inner[t.name] += 1
            if block is not None and close is None:
                return block
        return len(tags) if close is None else close

    at, k = 0, 0
    while k < len(tags):
        tag = tags[k]
        k += 1
        say(page[at : tag.start])
        at = tag.end
        name = tag.name
        if not name:
            continue
        if tag.closing:
            if name == "a":
                link_open = False
            elif name in BLOCKS and places[name]:
                end_block()
                close_to(places[name][-1])
            continue
        if name in RAW:
            if not tag.inside.endswith("/"):
                if name not in SOURCE:
                    k = after(k - 1)
                    at = tags[k].start if k < len(tags) else len(page)
                run.append(" ")
            continue
        if name == "a":
            link_open = True
        elif name == "br":
            breaks += 1
            if breaks > 1:
                end_block()
            else:
                run.append(" ")
        elif name in BLOCKS:
            end_block()
            if name in CLOSES:
                closed, border = CLOSES[name]
                ends = max((places[t][-1] for t in closed if places[t]), default=0)
                if ends > max((places[t][-1] for t in border if places[t]), default=0):
                    close_to(ends)
            elif nodes[stack[-1]].tag == "p":
                close_to(len(stack) - 1)
            if name in VOID:
                continue
            found, y, hidden = set(), None, False
            for a in _attribute.finditer(tag.inside):
                key, value = a[1].lower(), (a[2] or "").strip("\"'")
                if key == "data-y":
                    y = int(value) if labelled else None
                elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                    hidden = True
                elif key != "style":
                    found.update(_HINT[w] for x in _name.findall(value) if (w := x.lower()) in _HINT)
            nodes.append(Node(name, stack[-1], frozenset(found), y, hidden, nodes[stack[-1]].tag in ("#root", "html", "body")))
            places[name].append(len(stack))
            stack.append(len(nodes) - 1)
    say(page[at:])
    end_block()
    for i in range(len(nodes) - 1, 0, -1):
        n, p = nodes[i], nodes[nodes[i].parent]
        p.chars, p.linked, p.words, p.marks, p.leaves = p.chars + n.chars, p.linked + n.linked, p.words + n.words, p.marks + n.marks, p.leaves + n.leaves
    return nodes


def features(n: Node, total: int) -> list[tuple[int, float]]:
    """(number, value) of what speaks for or against a node."""
    out = [(0, 1.0)]
    if (t := _TAG.get("top header" if n.top and n.tag == "header" else n.tag)) is not None:
        out.append((1 + t, 1.0))
    k = 1 + len(TAGS)
    out += [(k + h, 1.0) for h in n.hints]
    k += len(HINTS)
    size = max(1, n.chars)
    out += [
        (k, n.linked / size), (k + 1, math.log1p(n.chars) / 8), (k + 2, min(1.0, 5 * n.marks / max(1, n.words))), (k + 3, n.chars / max(1, total)),
        (k + 4, math.log1p(n.chars / max(1, n.leaves)) / 6), (k + 5, float(n.hidden)), (k + 6, float(bool(n.text) and "©" in n.text[0])),
        (k + 7, float(bool(n.text) and n.text[0][-1] in ".!?")), (k + 8, float(5 * n.linked >= 4 * size)), (k + 9, float(2 * n.linked >= size and n.words < 20)),
    ]
    return out


def relation(parent: Node, child: Node) -> int:
    return 2 * (parent.tag in FRAMES) + (child.tag == "#text")


@dataclass(frozen=True)
class PageModel:
    """Weights of the features, and for each kind of edge the potential of (parent's label, child's label)."""

    weights: tuple[float, ...]
    edges: tuple[tuple[tuple[float, float], tuple[float, float]], ...]


def marginals(nodes: list[Node], model: PageModel) -> list[float]:
    """Each node's probability of being content, by sum-product over the tree."""
    n, w, total = len(nodes), model.weights, nodes[0].chars
    own = [(1.0, math.exp(max(-30.0, min(30.0, sum(w[i] * v for i, v in features(x, total)))))) for x in nodes]
    up, kinds = list(own), [0] * n
    sent: list[tuple[float, float]] = [(1.0, 1.0)] * n
    for i in range(n - 1, 0, -1):  # children to parents
        p = nodes[i].parent
        kinds[i] = relation(nodes[p], nodes[i])
        (e00, e01), (e10, e11) = model.edges[kinds[i]]
        a, b = up[i]
        x, y = e00 * a + e01 * b, e10 * a + e11 * b
        s = x + y
        sent[i] = (x / s, y / s)
        x, y = up[p][0] * sent[i][0], up[p][1] * sent[i][1]
        s = x + y
        up[p] = (x / s, y / s) if s > 0 else (0.5, 0.5)
    full = list(up)
    for i in range(1, n):  # parents to children
        p = nodes[i].parent
        (e00, e01), (e10, e11) = model.edges[kinds[i]]
        a, b = full[p][0] / max(sent[i][0], 1e-300), full[p][1] / max(sent[i][1], 1e-300)
        s = a + b
        a, b = a / s, b / s
        x, y = up[i][0] * (e00 * a + e10 * b), up[i][1] * (e01 * a + e11 * b)
        s = x + y
        full[i] = (x / s, y / s) if s > 0 else (0.5, 0.5)
    return [b / (a + b) for a, b in full]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def fit_page_model(pages: list[str], steps: int = 200, ridge: float = 1.0) -> PageModel:
    """A model from pages whose regions carry ``data-y`` (1: content, 0: not).

    All potentials are fitted together: the gradient of the likelihood is what
    the labels show less what sum-product expects, over all pages at once.
    """
    rows, y, parent, kind, depth = [], [], [], [], []
    for page in pages:
        nodes, base = parse(page, labelled=True), len(y)
        label: list[int] = []
        for n in nodes:
            label.append(n.y if n.y is not None else label[n.parent] if n.parent >= 0 else 0)
        weight = [(2 * v - 1) * n.chars * (n.tag == "#text") for v, n in zip(label, nodes, strict=True)]
        for i in range(len(nodes) - 1, 0, -1):
            weight[nodes[i].parent] += weight[i]
        for i, n in enumerate(nodes):
            row = np.zeros(N_FEATURES)
            for j, v in features(n, nodes[0].chars):
                row[j] += v
            rows.append(row)
            y.append(int(weight[i] > 0))
            parent.append(base + n.parent if i else -1)
            kind.append(relation(nodes[n.parent], n) if i else 0)
            depth.append(depth[base + n.parent] + 1 if i else 0)
    x, y, parent, kind, depth = np.array(rows), np.array(y), np.array(parent), np.array(kind), np.array(depth)
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)]
    child = np.flatnonzero(parent >= 0)
    shown = np.zeros((4, 2, 2))
    np.add.at(shown, (kind[child], y[parent[child]], y[child]), 1)
    theta = np.zeros(N_FEATURES + 16)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, e = theta[:N_FEATURES], theta[N_FEATURES:].reshape(4, 2, 2)
        up = np.zeros((len(y), 2))
        up[:, 1] = x @ w
        sent, down = np.zeros((len(y), 2)), np.zeros((len(y), 2))
        for level in levels[:0:-1]:
            sent[level] = _log_sum(e[kind[level]] + up[level][:, None, :], 2)
            np.add.at(up, parent[level], sent[level])
        for level in levels[1:]:
            rest = up[parent[level]] + down[parent[level]] - sent[level]
            down[level] = _log_sum(e[kind[level]] + rest[:, :, None], 1)
        belief = up + down
        p = np.exp(belief[:, 1] - _log_sum(belief, 1))
        pair = e[kind[child]] + up[child][:, None, :] + (up[parent[child]] + down[parent[child]] - sent[child])[:, :, None]
        pair = np.exp(pair - _log_sum(pair.reshape(-1, 4), 1)[:, None, None])
        expected = np.zeros((4, 2, 2))
        np.add.at(expected, kind[child], pair)
        slope = np.concatenate((x.T @ (y - p), (shown - expected).ravel())) - ridge * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        theta = theta + 0.15 * (1 - step / (steps + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    edges = np.exp(theta[N_FEATURES:].reshape(4, 2, 2))
    return PageModel(tuple(theta[:N_FEATURES].round(6).tolist()), tuple(tuple(tuple(r) for r in e) for e in edges.round(9).tolist()))


@lru_cache(maxsize=1)
def default_model() -> PageModel:
    return fit_page_model(labelled_pages(TRAINING_PAGES))


def main_text(page: str, model: PageModel) -> str:
    """The content blocks of a page in page order, joined by line ends."""
    nodes = parse(page)
    return "\n".join(n.text[0] for n, p in zip(nodes, marginals(nodes, model), strict=True) if n.text and p >= 0.5)


def extract_pages(pages: DataFrame, model: PageModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: id, url, text, n_chars.

    ``text`` is the article: blocks in page order, one a line, character
    references decoded, white space inside a block turned into one space. Null
    and empty pages, and pages without content, give the empty text and 0.
    Broken markup loses no text: what isn't closed ends with its parent, but for
    scripts, styles and comments, which run on as in browsers. Formulas keep
    their text. Time is linear in a page's length. Ids and urls are passed on as they are, nulls and repeats too; an
    empty table gives an empty result. Only the three named columns are read.
    """
    model = model or default_model()
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("_html"))
    kinds = [base.schema[c].dataType.simpleString() for c in ("_id", "_url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low, high in row_slices(whole.column(2)):
                b = whole.slice(low, high - low)
                texts = [main_text(x, model) for x in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["_id", "_url", "text", "n_chars"])

    out = base.mapInArrow(tidy(run), f"_id {kinds[0]}, _url {kinds[1]}, text string, n_chars long")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")
