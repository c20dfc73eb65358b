"""Main text of web pages, by a tree-structured graphical model.

The block elements of a page and the runs of text in them are nodes of a tree, each with a
hidden label: content or not. A node's potential is a sum of learned weights of its features (tag,
words of its class and id, length, link share, punctuation); an edge's potential says how likely a child
takes after its parent, by kind of child. Sum-product messages pass up from the leaves to the
root and down again, which gives every node's exact marginal; runs more likely content than not
make up the text. Weights maximise the likelihood of labelled pages; the gradient is the
difference between observed and expected counts, and the same messages give the expected ones.

All pages of a batch form one forest, and a message step takes one level of all trees at once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepflow.llm.arrow import slices
from prepflow.llm.dom import Page
from prepflow.llm.labelled_pages import labelled_pages

STEPS = 300
DEEP = 1_000  # levels of nested elements
RATE = 0.15
RIDGE = 2e-3
SLICE = 1 << 19
OUT = "page_id bigint, url string, text string, n_chars bigint"
KINDS = ("run", "inner")  # kinds of child on an edge


class Forest:
    """The nodes of many pages: parents and levels as arrays, features as (node, feature) pairs."""

    def __init__(self, pages: list[Page], vocabulary: dict[str, int], grow: bool = False):
        starts = np.cumsum([0, *[len(p.tag) for p in pages]])
        self.starts = starts
        self.n = int(starts[-1])
        parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + s) for p, s in zip(pages, starts)]) if pages else np.zeros(0, np.int64)
        self.parent = parent.astype(np.int64)
        level = np.zeros(self.n, np.int64)
        self.is_run = np.zeros(self.n, np.int64)
        nodes, features = [], []
        at = 0
        for page in pages:
            base = at
            words = [len(t.split()) for t in page.text]
            below, linked = words[:], [w * s for w, s in zip(words, page.linked)]
            for i in range(len(page.tag) - 1, 0, -1):
                below[page.parent[i]] += below[i]
                linked[page.parent[i]] += linked[i]
            for i, tag in enumerate(page.tag):
                if i:
                    level[base + i] = level[base + page.parent[i]] + 1
                self.is_run[base + i] = tag == "#"
                for name in self._names(page, i, below[i], linked[i]):
                    feature = vocabulary.setdefault(name, len(vocabulary)) if grow else vocabulary.get(name)
                    if feature is not None:
                        nodes.append(base + i)
                        features.append(feature)
            at += len(page.tag)
        self.node, self.feature = np.array(nodes, np.int64), np.array(features, np.int64)
        order = np.argsort(level, kind="stable")
        cuts = np.searchsorted(level[order], np.arange(level.max(initial=-1) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        self.kind = 1 - self.is_run

    @staticmethod
    def _names(page: Page, i: int, words: int, linked: float):
        tag = page.tag[i]
        share = linked / words if words else 0.0
        size = int(np.log2(words + 1)) if words else -1
        kind = "run" if tag == "#" else "inner"
        yield f"tag {tag}"
        yield f"{kind} size {min(size, 8)}"
        yield f"{kind} links {0 if not share else 1 + int(share * 3.999)}"
        for name in page.names[i]:
            yield f"name {name}"
        if tag == "#":
            text = page.text[i]
            yield f"end {'stop' if text[-1] in '.!?' else 'none'}"
            yield f"start {'mark' if text[0] in '©|»·' else 'upper' if text[0].isupper() else 'other'}"
            yield f"in {page.tag[page.parent[i]]}"

    def unary(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.node, weights=weights[self.feature], minlength=self.n)

    def messages(self, unary: np.ndarray, edge: np.ndarray):
        """Sum-product, up and down: node marginals of content, pair marginals of edges, log partition."""
        if len(self.levels) > DEEP:
            return self._messages_by_node(unary, edge)
        up = np.stack([np.zeros(self.n), unary], axis=1)  # own potential and all that comes from below
        sent = np.zeros((self.n, 2))  # message to the parent, for each label of the parent
        for nodes in self.levels[:0:-1]:
            pair = edge[self.kind[nodes]] + up[nodes][:, None, :]
            sent[nodes] = np.logaddexp(pair[:, :, 0], pair[:, :, 1])
            np.add.at(up, self.parent[nodes], sent[nodes])
        down = np.zeros((self.n, 2))
        joint = np.zeros((self.n, 2, 2))
        for nodes in self.levels[1:]:
            above = up[self.parent[nodes]] + down[self.parent[nodes]] - sent[nodes]
            pair = edge[self.kind[nodes]] + above[:, :, None]
            down[nodes] = np.logaddexp(pair[:, 0, :], pair[:, 1, :])
            joint[nodes] = pair + up[nodes][:, None, :]
        belief = up + down
        total = np.logaddexp(belief[:, 0], belief[:, 1])
        marginal = np.exp(belief[:, 1] - total)
        children = self.parent >= 0
        joint[children] = np.exp(joint[children] - total[children][:, None, None])
        joint[~children] = 0
        return marginal, joint, float(total[~children].sum())


    def _messages_by_node(self, unary: np.ndarray, edge: np.ndarray):
        """The same, node by node: a page of many levels has few nodes on each, and arrays do not pay."""
        order = np.concatenate(self.levels).tolist()
        parent, kind, own = self.parent.tolist(), self.kind.tolist(), unary.tolist()
        e = edge.tolist()
        up0, up1 = [0.0] * self.n, own[:]
        sent0, sent1 = [0.0] * self.n, [0.0] * self.n
        for i in reversed(order):
            p = parent[i]
            if p >= 0:
                (a, b), (c, d) = e[kind[i]]
                x, y = up0[i], up1[i]
                sent0[i], sent1[i] = _log_sum(a + x, b + y), _log_sum(c + x, d + y)
                up0[p] += sent0[i]
                up1[p] += sent1[i]
        down0, down1 = [0.0] * self.n, [0.0] * self.n
        joint = np.zeros((self.n, 2, 2))
        for i in order:
            p = parent[i]
            if p >= 0:
                (a, b), (c, d) = e[kind[i]]
                x, y = up0[p] + down0[p] - sent0[i], up1[p] + down1[p] - sent1[i]
                a, b, c, d = a + x, b + x, c + y, d + y
                down0[i], down1[i] = _log_sum(a, c), _log_sum(b, d)
                joint[i] = (a + up0[i], b + up1[i]), (c + up0[i], d + up1[i])
        belief = np.array([up0, up1]).T + np.array([down0, down1]).T
        total = np.logaddexp(belief[:, 0], belief[:, 1])
        children = self.parent >= 0
        joint[children] = np.exp(joint[children] - total[children][:, None, None])
        return np.exp(belief[:, 1] - total), joint, float(total[~children].sum())


def _log_sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


@dataclass
class Extractor:
    vocabulary: dict[str, int]
    weights: np.ndarray
    edge: np.ndarray  # kind of child, label of parent, label of child

    def texts(self, sources: list[str]) -> list[str]:
        pages = [Page(s) for s in sources]
        forest = Forest(pages, self.vocabulary)
        marginal, _, _ = forest.messages(forest.unary(self.weights), self.edge)
        out = []
        for page, start in zip(pages, forest.starts):
            runs = [t for i, t in enumerate(page.text) if t and marginal[start + i] > 0.5]
            out.append("\n\n".join(runs))
        return out


def _labels(page: Page) -> list[int]:
    """A node has the label of the nearest marked element at or above it; outside of all it is 0."""
    labels = []
    for i, main in enumerate(page.main):
        labels.append(int(main) if main in ("0", "1") else labels[page.parent[i]] if i else 0)
    return labels


def train(sources: list[str], steps: int = STEPS) -> Extractor:
    """Maximum likelihood on labelled pages (``data-main`` marks content), by momentum ascent."""
    pages = [Page(s) for s in sources]
    vocabulary: dict[str, int] = {}
    forest = Forest(pages, vocabulary, grow=True)
    truth = np.array([x for p in pages for x in _labels(p)], np.int64)
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.kind[child], truth[forest.parent[child]], truth[child]), 1)
    counted = np.bincount(forest.feature, minlength=len(vocabulary)).astype(float)
    observed = np.bincount(forest.feature, weights=truth[forest.node], minlength=len(vocabulary))
    weights, edge = np.zeros(len(vocabulary)), np.zeros((2, 2, 2))
    size, edge_size = np.zeros_like(weights), np.zeros_like(edge)
    for _ in range(steps):
        marginal, joint, _ = forest.messages(forest.unary(weights), edge)
        expected = np.bincount(forest.feature, weights=marginal[forest.node], minlength=len(vocabulary))
        gradient = (observed - expected) / np.sqrt(counted + 1) - RIDGE * counted.clip(1, 50) * weights
        pairs = np.stack([joint[forest.kind == k].sum(axis=0) for k in (0, 1)])
        edge_gradient = (seen - pairs) / np.sqrt(seen.sum()) - RIDGE * edge
        size += gradient**2
        edge_size += edge_gradient**2
        weights = weights + RATE * 4 * gradient / np.sqrt(size + 1e-8)
        edge = edge + RATE * 4 * edge_gradient / np.sqrt(edge_size + 1e-8)
    return Extractor(vocabulary, weights, edge)


@lru_cache(maxsize=1)
def default_extractor() -> Extractor:
    """The model of this package's labelled pages, trained once in a session."""
    return train(labelled_pages())


def extract(
    df: DataFrame,
    model: Extractor | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Blocks of main text in page order, joined by two line feeds; character references are
    decoded and white space within a block becomes one space. A null or empty page, one without text and
    one without content have an empty text. Pages that repeat each get a row, null ids and urls
    stay null, other columns are ignored, and an empty table gives an empty result. Without a
    ``model`` one is trained on the labelled pages of this package, which takes seconds on the driver, once in a session.
    """
    model = model or default_extractor()

    def run(batches):
        for part in slices(batches, "html", SLICE):
            found = model.texts(part["html"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part["page_id"], part["url"], pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"),
    ).mapInArrow(run, OUT)
