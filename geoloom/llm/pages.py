"""Main text of web pages by a tree-structured graphical model.

Each block of a page is a node that is content or not. A node's potential is learned from its tag, its names and its
text; a potential between parent and child, by the kind of child, connects the nodes. Sum-product messages go up and
then down the tree, which gives every node's marginal probability exactly; blocks over one half are the main text. The
potentials are trained from labelled pages by the gradient of their likelihood, whose expectations are such marginals.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
#: Pages whose trees are put through the messages together.
PAGES_AT_A_TIME = 64
STEPS, RATE, PENALTY = 150, 0.2, 0.004
#: The mark of a labelled page: from here down the text is content (1) or isn't (0).
LABEL = "data-content"

# HTML's elements by how they are parsed and shown.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body caption html legend optgroup option tbody tfoot thead tr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
SILENT = frozenset("audio button canvas datalist map noscript object select svg template video".split())
CELLS = frozenset("td th".split())
#: Elements that end others which are still open, up to what bounds the search.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())), "dt": (frozenset("dt dd".split()), frozenset(["dl"])), "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset("table tbody thead tfoot".split())), "td": (CELLS, frozenset("tr table".split())), "th": (CELLS, frozenset("tr table".split())),
    "tbody": (frozenset("tbody thead tfoot".split()), frozenset(["table"])), "tfoot": (frozenset("tbody thead tfoot".split()), frozenset(["table"])), "option": (frozenset(["option"]), frozenset("select datalist".split())),
}
BOUNDS = frozenset("button caption html object table td template th".split())
TABLE_PARTS = frozenset("caption table tbody td tfoot th thead tr".split())
#: Inline elements that are nodes of their own where they have a name.
NAMED_INLINE = frozenset("ins label small span".split())
NAMES = frozenset("aria-label class id itemprop role".split())

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|</[a-zA-Z][^>]*+(?:>|\Z)"
    r"|<[a-zA-Z](?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+(?:>|\Z)"
    r"|<(?:[!?]|/(?=[^a-zA-Z]))[^>]*+(?:>|\Z)",
    re.S,
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Tree:
    """A page's nodes, parents before children, and its pieces of text in page order."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[list[str]] = field(default_factory=list)
    silent: list[bool] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    controls: list[int] = field(default_factory=list)
    before: list[int] = field(default_factory=list)
    ends: list[bool] = field(default_factory=list)
    pieces: list[tuple[int, int, str]] = field(default_factory=list)

    def node(self, parent: int, tag: str, names: list[str], silent: bool, label: int, before: int) -> int:
        for column, value in ((self.parent, parent), (self.tag, tag), (self.names, names), (self.silent, silent), (self.label, label), (self.words, 0), (self.linked, 0), (self.controls, 0), (self.before, before), (self.ends, False)):
            column.append(value)
        return len(self.parent) - 1


def parsed(page: str | None) -> Tree:
    """The tree of a page; whatever is open at the end is closed there, and a tag that is cut off is no text."""
    page, tree = page or "", Tree()
    stack = [("#page", tree.node(-1, "#page", [], False, 0, 0))]
    opened: Counter[str] = Counter()
    line = total = links = at = 0

    def pop(size: int) -> None:
        nonlocal line, links
        while len(stack) > size:
            tag, _ = stack.pop()
            opened[tag] -= 1
            links -= tag == "a"
            line += tag in BLOCKS

    def close(wanted: frozenset[str], bounds: frozenset[str]) -> None:
        if any(opened[t] > 0 for t in wanted):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in wanted:
                    return pop(i)
                if stack[i][0] in bounds:
                    return None
        return None

    def text(raw: str) -> None:
        nonlocal total
        node = stack[-1][1]
        if not tree.silent[node]:
            piece = html.unescape(raw) if "&" in raw else raw
            tree.pieces.append((node, line, piece))
            if n := len(piece.split()):
                tree.words[node] += n
                tree.linked[node] += n if links else 0
                tree.ends[node] = piece.rstrip()[-1] in ".!?…。:;\"'”»)"
                total += n

    while at < len(page):
        found = _TOKEN.search(page, at)
        if not found:
            text(page[at:])
            break
        if found.start() > at:
            text(page[at : found.start()])
        at, token = found.end(), found[0]
        if not (name := _NAME.match(token)) or not token.endswith(">"):
            continue
        tag = name[1].lower()
        if token[1] == "/":
            if not opened[tag]:
                continue
            block, bounds = tag in BLOCKS or tag in CELLS or tag in SILENT, BOUNDS - {tag} if tag not in TABLE_PARTS else frozenset(["html"])
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
                if stack[i][0] in bounds or not block and stack[i][0] in BLOCKS:
                    break
            continue
        if tag in CLOSES_P:
            close(frozenset(["p"]), BOUNDS)
        if tag in ENDS:
            close(*ENDS[tag])
        node = stack[-1][1]
        if tag in VOID:
            line += tag == "hr"
            tree.controls[node] += tag == "input"
            if tag == "br" and not tree.silent[node]:
                tree.pieces.append((node, line, " "))
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            tree.controls[node] += tag == "textarea"
            continue
        if tag in ("html", "body") and opened[tag]:
            continue
        attributes = {k.lower(): (v[1:-1] if v[:1] in "\"'" else v) for k, v in _ATTRIBUTE.findall(token, name.end())} if " " in token or "\n" in token or "\t" in token else {}
        names = [part.lower() for k in sorted(NAMES & attributes.keys()) for part in _PART.findall(html.unescape(attributes[k]))]
        if "hidden" in attributes or re.search(r"display\s*:\s*none", attributes.get("style", "")):
            names.append("#hidden")
        line += tag in BLOCKS
        if tag in CELLS and not tree.silent[node]:
            tree.pieces.append((node, line, " "))
        tree.controls[node] += tag in ("button", "select")
        if tag in BLOCKS or tag in CELLS or tag in SILENT or names and tag in NAMED_INLINE:
            label = int(attributes[LABEL]) if LABEL in attributes else tree.label[node]
            node = tree.node(node, tag, names, tree.silent[node] or tag in SILENT, label, total)
        stack.append((tag, node))
        opened[tag] += 1
        links += tag == "a"
    return tree


# What a child is to its parent: the kinds of the potentials between them.
_KIND = {t: k for k, tags in enumerate(("article main", "div section center td th table tbody tr body html", "nav aside footer header form menu", "p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption", "ul ol dl li dt dd", "span ins small label")) for t in tags.split()}
KINDS = max(_KIND.values()) + 2


def _step(x: float, *steps: float) -> int:
    return sum(x >= s for s in steps)


def features(tree: Tree) -> list[list[str]]:
    """What is seen of each node: no word of the text itself, only its amount, place, links and names."""
    n = len(tree.parent)
    words, linked, controls = list(tree.words), list(tree.linked), list(tree.controls)
    for i in range(n - 1, 0, -1):
        for column in (words, linked, controls):
            column[tree.parent[i]] += column[i]
    total, out = max(1, words[0]), []
    for i in range(n):
        links = _step(linked[i] / words[i], 1e-9, 0.25, 0.6) if words[i] else 4
        own = _step(tree.words[i], 1, 4, 10, 25, 60)
        place = _step(tree.before[i] / total, 0.02, 0.2, 0.8, 0.98)
        tag = tree.tag[i]
        seen = ["one", f"tag {tag}", f"own {own}", f"links {links}", f"tag {tag} share {_step(words[i] / total, 1e-9, 0.02, 0.1, 0.3, 0.6)}", f"place {place}", f"controls {_step(controls[i], 1, 3)}", f"ends {tree.ends[i]} {own > 1}", f"tag {tag} links {links}", f"tag {tag} own {own}", f"tag {tag} in {tree.tag[tree.parent[i]] if i else ''}"]
        named = tree.names[i]
        seen += [f"name {p}" for p in named] + [f"start {p[:4]}" for p in named if len(p) > 4]
        out.append(list(dict.fromkeys(seen)))
    return out


@dataclass
class Forest:
    """Nodes of several pages: parents, the levels of the trees, kinds, and the features seen as (node, feature)."""

    parent: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]
    node: np.ndarray
    feature: np.ndarray


def forest(trees: list[Tree], places: dict[str, int], learn: bool = False) -> Forest:
    parents, kinds, nodes, seen, first = [], [], [], [], 0
    for tree in trees:
        parents += [p + first if p >= 0 else -1 for p in tree.parent]
        kinds += [_KIND.get(t, KINDS - 1) for t in tree.tag]
        for i, own in enumerate(features(tree)):
            at = [places.setdefault(f, len(places)) for f in own] if learn else [places[f] for f in own if f in places]
            nodes += [first + i] * len(at)
            seen += at
        first += len(tree.parent)
    parent = np.array(parents, np.int64)
    depth = np.zeros(first, np.int64)
    for i, p in enumerate(parents):
        depth[i] = depth[p] + 1 if p >= 0 else 0
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if first else []
    return Forest(parent, np.array(kinds, np.int64), levels, np.array(nodes, np.int64), np.array(seen, np.int64))


@dataclass(frozen=True)
class Model:
    """The potentials: of a feature for being content, and of a parent's and a child's state by the child's kind."""

    places: dict[str, int]
    weights: np.ndarray
    edges: np.ndarray


def messages(f: Forest, own: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product over the trees: each node's marginals, and those of each node's parent and itself together.

    ``own`` is a node's log-potential for content, ``edges`` those between the states of parent and child by kind.
    """
    n = len(f.parent)
    up, sent, down = np.zeros((n, 2)), np.zeros((n, 2)), np.zeros((n, 2))
    up[:, 1] = own
    between = edges[f.kind]
    for at in reversed(f.levels[1:]):  # upward: what a child says of its parent's states
        sent[at] = np.logaddexp.reduce(up[at][:, None, :] + between[at], axis=2)
        for s in (0, 1):
            up[:, s] += np.bincount(f.parent[at], sent[at, s], n)
    both = np.zeros((n, 2, 2))
    for at in f.levels[1:]:  # downward: what the parent says, without what came from the child
        p = f.parent[at]
        rest = up[p] + down[p] - sent[at]
        joint = rest[:, :, None] + between[at] + up[at][:, None, :]
        both[at] = np.exp(joint - np.logaddexp.reduce(joint.reshape(-1, 4), axis=1)[:, None, None])
        down[at] = np.logaddexp.reduce(rest[:, :, None] + between[at], axis=1)
        down[at] -= down[at].max(axis=1, keepdims=True)
    belief = up + down
    return np.exp(belief - np.logaddexp(belief[:, 0], belief[:, 1])[:, None]), both


def train(labelled: Iterable[str], steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> Model:
    """Potentials from labelled pages: HTML whose attribute ``data-content`` marks where content begins (1) and ends (0).

    The gradient of the log-likelihood is what is seen in the labels less what the marginals expect, less the penalty on
    large weights; steps are scaled by each weight's running moments. The pages are fitted on the driver: a bounded list.
    """
    trees, places = [parsed(p) for p in labelled], {}
    f = forest(trees, places, learn=True)
    y = np.array([v for t in trees for v in t.label], np.int64)
    child = np.flatnonzero(f.parent >= 0)
    truth = np.zeros((len(y), 2, 2))
    truth[child, y[f.parent[child]], y[child]] = 1
    parts = [len(places), KINDS * 4]
    x, first, second = np.zeros(sum(parts)), 0.0, 0.0
    roots = np.flatnonzero(f.parent < 0)
    for step in range(1, steps + 1):
        w, e = x[: parts[0]], x[parts[0] :].reshape(KINDS, 2, 2)
        marginal, both = messages(f, np.bincount(f.node, w[f.feature], len(y)), e)
        off = (y - marginal[:, 1])[f.node]
        gradient = np.bincount(f.feature, off, parts[0])
        between = np.stack([np.bincount(f.kind, (truth - both)[:, i, j], KINDS) for i in (0, 1) for j in (0, 1)], axis=1)
        g = np.concatenate([gradient, between.ravel()]) / max(1, len(roots)) - penalty * x / max(1, len(roots)) ** 0.5
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        x = x + rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    return Model(places, x[: parts[0]], x[parts[0] :].reshape(KINDS, 2, 2))


def marginals(trees: list[Tree], model: Model) -> list[np.ndarray]:
    """For each page, its nodes' probabilities of being content."""
    f = forest(trees, model.places)
    own = np.bincount(f.node, model.weights[f.feature], len(f.parent))
    p = messages(f, own, model.edges)[0][:, 1]
    return np.split(p, np.cumsum([len(t.parent) for t in trees])[:-1])


def main_text(tree: Tree, content: np.ndarray, threshold: float = THRESHOLD) -> str:
    """The text of the nodes that are content: white space in a block is one space, blocks are lines."""
    lines: dict[int, list[str]] = {}
    for node, line, piece in tree.pieces:
        if content[node] >= threshold and not tree.silent[node]:
            lines.setdefault(line, []).append(piece)
    blocks = (" ".join("".join(pieces).split()) for pieces in lines.values())
    return "\n".join(b for b in blocks if b)


def texts(pages: list[str | None], model: Model, threshold: float = THRESHOLD) -> list[str]:
    out: list[str] = []
    for i in range(0, len(pages), PAGES_AT_A_TIME):
        trees = [parsed(p) for p in pages[i : i + PAGES_AT_A_TIME]]
        out += [main_text(t, c, threshold) for t, c in zip(trees, marginals(trees, model), strict=True)]
    return out


def extracted(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """``id, url, text, n_chars`` of each page: its main text and how many code points that has.

    A null or empty page, and one without content, has the empty text. Ids and urls are passed on as they are, nulls and
    repeats too; an empty table stays empty; other columns are not read. Each page is taken whole, in a task's memory.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, PAGES_AT_A_TIME):
                b = whole.slice(i, PAGES_AT_A_TIME)
                got = texts(b.column(2).to_pylist(), model, threshold)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], [id_col, url_col, "text", "n_chars"])

    own = pages.select(F.col(id_col), F.col(url_col), F.col(html_col))
    return own.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
