"""Main text of pages: a linear-chain conditional random field over the leaf blocks of the page.

Each block has features of the elements around it (tags, words of class, id and role) and of its text; the chain has
weights for going from one label to the next, other ones between blocks of one element than across elements. Training
is by maximum likelihood with forward-backward in numpy, over all labelled pages at once; a page is decoded by Viterbi.
"""
from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import sample_pages
from .leaves import Leaf, labelled, read


@dataclass(frozen=True)
class Setup:
    """``pages`` bounds the labelled pages (built by rule); a feature counts when ``seen`` blocks have it."""
    pages: int = 800
    seen: int = 3
    steps: int = 200
    rate: float = 0.15
    ridge: float = 2e-5


class Field:
    """``weight``: by feature, for main text against the rest. ``start``: by first label. ``turn``: by (sibling or not,
    label before, label)."""

    def __init__(self, weight: dict[str, float], start: np.ndarray, turn: np.ndarray):
        self.weight, self.start, self.turn = weight, start, turn

    def score(self, block: Leaf) -> float:
        get = self.weight.get
        return sum(get(f, 0.0) for f in block.names)

    def decode(self, blocks: list[Leaf]) -> list[int]:
        """The most likely labels of one page (Viterbi); of equal paths the one without main text."""
        if not blocks:
            return []
        turn, back = self.turn.tolist(), []
        e = self.score(blocks[0])
        a0, a1 = float(self.start[0]), float(self.start[1]) + e
        for b in blocks[1:]:
            (t00, t01), (t10, t11) = turn[int(b.sibling)]
            e = self.score(b)
            back.append((a1 + t10 > a0 + t00, a1 + t11 > a0 + t01))
            a0, a1 = max(a0 + t00, a1 + t10), max(a0 + t01, a1 + t11) + e
        label = int(a1 > a0)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def likelihood(e: np.ndarray, sibling: np.ndarray, y: np.ndarray, size: np.ndarray, start: np.ndarray, turn: np.ndarray):
    """Log likelihood of labels ``y`` (pages x blocks, ``size`` of them real) and its gradients by e, start and turn."""
    n, width = e.shape
    live = np.arange(width) < size[:, None]
    rows = np.arange(n)
    state = np.zeros((n, width, 2))
    state[:, :, 1] = e
    step = turn[sibling]                                  # pages x blocks x before x now
    a = np.zeros((n, width, 2))
    b = np.zeros((n, width, 2))
    a[:, 0] = start + state[:, 0]
    for t in range(1, width):
        new = np.logaddexp(a[:, t - 1, 0, None] + step[:, t, 0], a[:, t - 1, 1, None] + step[:, t, 1]) + state[:, t]
        a[:, t] = np.where(live[:, t, None], new, a[:, t - 1])
    for t in range(width - 2, -1, -1):
        ahead = step[:, t + 1] + (state[:, t + 1] + b[:, t + 1])[:, None, :]
        b[:, t] = np.where(live[:, t + 1, None], np.logaddexp(ahead[:, :, 0], ahead[:, :, 1]), 0.0)
    z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
    p = np.exp(np.where(live[:, :, None], a + b - z[:, None, None], -np.inf))
    pair = a[:, :-1, :, None] + step[:, 1:] + (state[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]
    pair = np.exp(np.where(live[:, 1:, None, None], pair, -np.inf))
    truth = np.zeros_like(p)
    truth[rows[:, None], np.arange(width), y] = live
    true_pair = truth[:, :-1, :, None] * truth[:, 1:, None, :]
    gold = (truth * state).sum() + (start * truth[:, 0]).sum() + (true_pair * step[:, 1:]).sum()
    d_turn = np.stack([((true_pair - pair) * (sibling[:, 1:] == s)[:, :, None, None]).sum(axis=(0, 1)) for s in (0, 1)])
    return gold - z.sum(), (truth - p)[:, :, 1], (truth - p)[:, 0].sum(axis=0), d_turn


def learn(pages: list[tuple[list[Leaf], list[int]]], how: Setup = Setup()) -> Field:
    """Trained on blocks and labels of pages; pages without a block are left out."""
    pages = [p for p in pages if p[0]]
    count = Counter(f for blocks, _ in pages for b in blocks for f in set(b.names))
    names = sorted(f for f, c in count.items() if c >= how.seen)
    number = {f: i for i, f in enumerate(names)}
    size = np.array([len(b) for b, _ in pages], dtype=np.int64)
    width = int(size.max(initial=1))
    y, sibling = np.zeros((len(pages), width), int), np.zeros((len(pages), width), int)
    at, feature = [], []
    for i, (blocks, labels) in enumerate(pages):
        y[i, :len(labels)] = labels
        for j, b in enumerate(blocks):
            sibling[i, j] = b.sibling
            known = [number[f] for f in b.names if f in number]
            feature += known
            at += [i * width + j] * len(known)
    at, feature = np.array(at, dtype=np.int64), np.array(feature, dtype=np.int64)
    params = [np.zeros(len(names)), np.zeros(2), np.zeros((2, 2, 2))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    total = max(int(size.sum()), 1)
    for step in range(1, how.steps + 1 if pages else 1):
        e = np.bincount(at, weights=params[0][feature], minlength=len(pages) * width).reshape(len(pages), width)
        _, d_e, d_start, d_turn = likelihood(e, sibling, y, size, params[1], params[2])
        grads = [np.bincount(feature, weights=d_e.ravel()[at], minlength=len(names)), d_start, d_turn]
        for p, g, m, v in zip(params, grads, first, second):
            g = g / total - how.ridge * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += how.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Field(dict(zip(names, params[0].tolist())), params[1], params[2])


def main_text(page: str | None, field: Field) -> str:
    blocks = read(page)
    return "\n".join(b.text for b, y in zip(blocks, field.decode(blocks)) if y)


def extractor(field: Field):
    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array((main_text(p.as_py(), field) for p in pages), pa.string())
    return extract


def with_main_text(pages: DataFrame, html_col: str = "html", training: list[str] | None = None, how: Setup = Setup()) -> DataFrame:
    """Columns ``row`` (all columns of pages) and ``text``: the main text, blocks joined by newlines.

    ``training``: pages whose elements carry data-main="1" or "0"; without, ``how.pages`` pages built by rule. Null and
    empty pages, and those without main text, give an empty text. Repeated rows are read one by one; other columns,
    whatever their names, come along inside ``row``. The model is a few hundred weights, trained on the driver. No
    shuffle; a task holds the blocks of one page at a time, about ten times its bytes.
    """
    field = learn(labelled(training if training is not None else sample_pages.pages(0, how.pages)), how)
    return pages.select(F.struct("*").alias("row"), extractor(field)(F.col(html_col)).alias("text"))


def report(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **kw) -> DataFrame:
    """One row per page: id, url, text and its length in code points."""
    d = with_main_text(pages.select(id_col, url_col, html_col), html_col, **kw)
    return d.select(F.col("row")[id_col].alias(id_col), F.col("row")[url_col].alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
