"""Main text of web pages by a tree-structured graphical model.

Every node of a page's tree, element or block of text, holds main text or not.  A node's potential is a weighted sum of its
features, a potential of each parent with its child says how they go together.  Sum-product messages, upward from the
leaves and downward from the root, give the exact marginals of a tree; blocks of text that are main text with a
probability of a half or more make the result.  The weights maximise the likelihood of labelled pages; its gradient is what the labels
count less what the marginals expect.

Messages of all pages of a batch go together, a level of depth at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled_pages import labelled_pages
from .page_tree import HEADINGS, Page, parse
from .shared import batches_of

#: Elements that stand for what they hold, rather than for the layout; edges from them have potentials of their own.
_SPEAKING = frozenset("article main nav aside footer header form section".split())
_HOLDING = frozenset("p li td th dd dt blockquote pre figure figcaption ul ol dl table tr tbody thead".split()) | HEADINGS
_AREAS = frozenset("article main".split())
EDGE_KINDS = 6


@dataclass
class Forest:
    """The trees of several pages: parents stand before their children; features as (node, feature, value)."""

    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    at: np.ndarray
    feature: np.ndarray
    is_text: np.ndarray
    begins: np.ndarray

    @cached_property
    def levels(self) -> list[np.ndarray]:
        """The nodes of each depth below the roots."""
        order = np.argsort(self.depth, kind="stable")
        return np.split(order, np.searchsorted(self.depth[order], np.arange(1, self.depth.max(initial=0) + 1)))[1:]


def _sized(prefix: str, value: float, steps: tuple[float, ...]) -> str:
    return f"{prefix}{sum(value > s for s in steps)}"


def _features(page: Page) -> Iterator[tuple[int, str]]:
    """What a node shows, as (node, name of a feature)."""
    n = len(page.parent)
    letters, linked, blocks = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if page.text[i] is not None:
            letters[i], linked[i], blocks[i] = len(page.text[i]), page.linked[i], 1
        if i:
            up = page.parent[i]
            letters[up] += letters[i]
            linked[up] += linked[i]
            blocks[up] += blocks[i]
    # Where the page names a main area: what lies in it, holds it, or stands beside it.
    area = ["beside"] * n
    for i in range(n):
        if page.tag[i] in _AREAS or i and area[page.parent[i]] == "in":
            area[i] = "in"
    for i in range(n - 1, 0, -1):
        if area[i] != "beside" and area[page.parent[i]] == "beside":
            area[page.parent[i]] = "holds"
    named = "in" in area
    for i in range(n):
        share = linked[i] / letters[i] if letters[i] else 0
        text = page.text[i]
        if named:
            yield i, ("text " if text is not None else "element ") + area[i] + " the main area"
        if text is None:
            yield i, "element"
            yield i, "tag " + page.tag[i]
            if i:
                yield i, f"tag {page.tag[i]} under {page.tag[page.parent[i]]}"
            for name in page.names[i]:
                yield i, "name " + name
            yield i, _sized("element links ", share, (0.05, 0.3, 0.7))
            yield i, _sized("element letters ", letters[i], (0, 40, 200, 800))
            yield i, _sized("element blocks ", blocks[i], (0, 1, 4, 12))
            continue
        yield i, "text"
        yield i, _sized("text links ", share, (0, 0.3, 0.7))
        yield i, _sized("text letters ", letters[i], (15, 40, 100, 300))
        yield i, "text ends" if text[-1] in ".!?…:;\"'»”)" else "text breaks off"
        yield i, _sized("text commas ", sum(map(text.count, ",;:")), (0, 2))
        if "©" in text or "(c)" in text:
            yield i, "text copyright"
        yield i, "text in " + page.tag[page.parent[i]]


def _edge_kind(page: Page, i: int) -> int:
    up = page.tag[page.parent[i]]
    holder = 0 if up in _SPEAKING else 1 if up in _HOLDING else 2
    return 2 * holder + (page.text[i] is not None)


def forest(pages: list[Page], known: dict[str, int], learn: bool = False) -> Forest:
    """Pages as one forest; with ``learn`` names of features that are new are put in ``known``, else left out."""
    parent, depth, kind, at, feature, is_text, begins, base = [], [], [], [], [], [], [], 0
    for page in pages:
        begins.append(base)
        depths = [0] * len(page.parent)
        for i, up in enumerate(page.parent):
            depths[i] = depths[up] + 1 if i else 0
            parent.append(base + up if i else -1)
            kind.append(_edge_kind(page, i) if i else 0)
            is_text.append(page.text[i] is not None)
        depth += depths
        for i, name in _features(page):
            number = known.setdefault(name, len(known)) if learn else known.get(name)
            if number is not None:
                at.append(base + i)
                feature.append(number)
        base += len(page.parent)
    whole = lambda x: np.array(x, np.int64)
    return Forest(whole(parent), whole(depth), whole(kind), whole(at), whole(feature), np.array(is_text, bool), whole(begins))


def sum_product(trees: Forest, node: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of every node (n, 2) and of every edge to a parent (n, parent's state, own state), and the log partition sum.

    ``node`` (n, 2) and ``edge`` (n, parent's state, own state) are log potentials; the rows of roots in ``edge`` count for nothing.
    """
    levels = trees.levels
    below = node.copy()  # with the messages of the children
    message = np.zeros_like(node)  # to the parent, by the parent's state
    for at in reversed(levels):
        message[at] = np.logaddexp(edge[at, :, 0] + below[at, 0, None], edge[at, :, 1] + below[at, 1, None])
        for state in (0, 1):
            below[:, state] += np.bincount(trees.parent[at], message[at, state], len(below))
    roots = np.flatnonzero(trees.parent < 0)
    log_sum = float(np.logaddexp(below[roots, 0], below[roots, 1]).sum())
    whole = below.copy()  # with the message of the parent as well
    pairs = np.zeros((len(node), 2, 2))
    for at in levels:
        up = trees.parent[at]
        rest = whole[up] - message[at]  # the parent without what this child told it
        joint = rest[:, :, None] + edge[at] + below[at][:, None, :]
        whole[at] = np.logaddexp(joint[:, 0], joint[:, 1])
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        pairs[at] = joint / joint.sum(axis=(1, 2), keepdims=True)
    odds = whole[:, 1] - whole[:, 0]
    held = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    return np.stack([1 - held, held], axis=1), pairs, log_sum


def labels(page: Page) -> np.ndarray:
    """Whether a node of a labelled page holds main text, by the nearest mark above each block of text."""
    n = len(page.parent)
    marks, held = [None] * n, np.zeros(n, bool)
    for i in range(n):
        marks[i] = page.mark[i] if page.mark[i] is not None else marks[page.parent[i]] if i else None
    for i in range(n - 1, -1, -1):
        if page.text[i] is not None:
            held[i] = marks[i] == "1"
        if i and held[i]:
            held[page.parent[i]] = True
    return held


@dataclass
class ContentModel:
    known: dict[str, int]
    weights: np.ndarray
    edges: np.ndarray

    def marginals(self, trees: Forest) -> np.ndarray:
        """Probability that a node holds main text."""
        score = np.bincount(trees.at, self.weights[trees.feature], len(trees.parent)).astype(float)
        return sum_product(trees, np.stack([np.zeros_like(score), score], axis=1), self.edges[trees.kind])[0][:, 1]


def train(pages: list[str], *, rounds: int = 250, step: float = 0.3, prior: float = 0.02) -> ContentModel:
    """Weights of largest likelihood of labelled pages, with a Gaussian prior, by gradient steps of their own size."""
    parsed = [parse(p) for p in pages]
    known: dict[str, int] = {}
    trees = forest(parsed, known, learn=True)
    held = np.concatenate([labels(p) for p in parsed]).astype(np.int64)
    n, inner = len(held), np.flatnonzero(trees.parent >= 0)
    told = np.bincount(trees.feature, held[trees.at], len(known))
    told_edges = np.zeros((EDGE_KINDS, 2, 2))
    np.add.at(told_edges, (trees.kind[inner], held[trees.parent[inner]], held[inner]), 1)
    values = np.zeros(len(known) + told_edges.size)
    first, second = np.zeros_like(values), np.zeros_like(values)
    for k in range(1, rounds + 1):
        model = ContentModel(known, values[:len(known)], values[len(known):].reshape(told_edges.shape))
        score = np.bincount(trees.at, model.weights[trees.feature], n)
        nodes, pairs, _ = sum_product(trees, np.stack([np.zeros(n), score], axis=1), model.edges[trees.kind])
        expected = np.bincount(trees.feature, nodes[trees.at, 1], len(known))
        expected_edges = np.zeros_like(told_edges)
        np.add.at(expected_edges, trees.kind[inner], pairs[inner])
        slope = np.concatenate([told - expected, (told_edges - expected_edges).ravel()]) / len(pages) - prior * values / 10
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        values = values + step * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-6) * (1 - k / (rounds + 1))
    return ContentModel(known, values[:len(known)], values[len(known):].reshape(told_edges.shape))


def main_texts(model: ContentModel, sources: list[str]) -> list[str]:
    """The blocks of main text of each page, in page order, joined by a space."""
    pages = [parse(s) for s in sources]
    trees = forest(pages, model.known)
    held = model.marginals(trees) >= 0.5
    return [" ".join(t for t, h in zip(page.text, held[begin:begin + len(page.text)]) if t is not None and h)
            for page, begin in zip(pages, trees.begins)]


def extract_main_text(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", labelled: list[str] | None = None,
                      training_pages: int = 400, seed: int = 7, batch_bytes: int = 2 << 20) -> DataFrame:
    """One row per row of ``pages``: ``page_id``, ``url``, ``text``, ``n_chars``.

    ``text`` is the main text of the whole html: character references decoded, white space inside a block as one space, blocks
    joined by a space.  A null or empty html, or a page without main text, gives an empty text; ``n_chars`` counts its
    code points.  A page of any length or depth is read whole, by itself if it is longer than ``batch_bytes``.  Blocks with a
    probability of exactly a half are kept.  Rows that repeat, or have a null key or url, are each extracted; an empty table gives
    no rows; other columns are not read.

    The model is trained from ``labelled`` pages (see ``labelled_pages``), by default ``training_pages`` of them, which is the
    bound of its sample.
    """
    model = train(labelled if labelled is not None else labelled_pages(training_pages, seed))
    schema = T.StructType([T.StructField(key, pages.schema[key].dataType), T.StructField(url, T.StringType()),
                           T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batches_of([batch.column(0).to_pylist(), batch.column(1).to_pylist(), [h or "" for h in batch.column(2).to_pylist()]],
                                   batch_bytes, 2):
                texts = main_texts(model, rows[2])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], batch.column(0).type), pa.array(rows[1], pa.string()), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], [key, url, "text", "n_chars"])

    return pages.select(key, F.col(url).cast("string").alias(url), html).mapInArrow(run, schema)
