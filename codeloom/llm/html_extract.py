"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

Each block has hashed features of its ancestors' tags, their class, id and role words,
and its text. The model scores blocks and neighbouring labels; training maximises the
conditional likelihood of labelled pages (forward-backward, AdaGrad), decoding is
Viterbi. Training takes TRAIN_PAGES labelled pages, a parameter, on the driver; the
model (132 kB) goes to the tasks, which parse and decode page by page.

Defined results: a null or empty page, or one without a main block, has an empty text
and 0 characters; ties in decoding prefer leaving a block out; repeated rows get equal
texts; pages of any length are read whole; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.html_blocks import SLOTS, sequence
from codeloom.llm.html_training import training_pages

TRAIN_PAGES = 1200
ROUNDS = 150
PENALTY = 1e-5
HELD_CHARACTERS = 4 << 20  # of texts before they are sent on


class Crf:
    """Labels 0 (leave out) and 1 (main). A block's score counts for label 1; moves[a, b] and start[b] for labels in a row."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.weights, self.moves, self.start = weights, moves, start

    def decode(self, features: list[tuple[int, ...]]) -> list[int]:
        """The likeliest labels of a page's blocks (Viterbi)."""
        if not features:
            return []
        score = np.add.reduceat(self.weights[np.concatenate(features)], np.cumsum([0, *map(len, features[:-1])])).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        v0, v1 = float(self.start[0]), float(self.start[1]) + score[0]
        back = []
        for s in score[1:]:
            back.append((v0 + m00 < v1 + m10, v0 + m01 < v1 + m11))
            v0, v1 = max(v0 + m00, v1 + m10), max(v0 + m01, v1 + m11) + s
        label = int(v1 > v0)
        out = [label]
        for b in reversed(back):
            label = int(b[label])
            out.append(label)
        return out[::-1]


def likelihood(crf: Crf, emission: np.ndarray, label: np.ndarray, mask: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean log-likelihood of padded pages and its gradient by emission, moves and start (forward-backward)."""
    n, t = emission.shape
    e = np.stack([np.zeros_like(emission), emission], axis=2)
    alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
    alpha[:, 0] = crf.start + e[:, 0]
    for i in range(1, t):
        step = np.logaddexp.reduce(alpha[:, i - 1, :, None] + crf.moves, axis=1) + e[:, i]
        alpha[:, i] = np.where(mask[:, i, None], step, alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        step = np.logaddexp.reduce(crf.moves + (e[:, i + 1] + beta[:, i + 1])[:, None, :], axis=2)
        beta[:, i] = np.where(mask[:, i + 1, None], step, beta[:, i + 1])
    z = np.logaddexp.reduce(alpha[:, -1], axis=1)
    p = np.exp(alpha + beta - z[:, None, None])[:, :, 1]
    pair = np.exp(alpha[:, :-1, :, None] + crf.moves + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
    seen = np.zeros((2, 2))
    both = mask[:, 1:]
    np.add.at(seen, (label[:, :-1][both], label[:, 1:][both]), 1)
    first = np.bincount(label[:, 0], minlength=2)
    own = (label * emission * mask).sum() + (seen * crf.moves).sum() + (first * crf.start).sum()
    return float(own - z.sum()) / n, (label - p) * mask / n, (seen - pair.sum(axis=(0, 1))) / n, (first - np.stack([1 - p[:, 0], p[:, 0]]).sum(axis=1)) / n


def fit(pages: list[tuple[list[tuple[int, ...]], list[int]]], rounds: int = ROUNDS, rate: float = 0.4) -> Crf:
    """A model from labelled pages: features and labels of their blocks."""
    n, t = len(pages), max(len(p[1]) for p in pages)
    label, mask = np.zeros((n, t), np.int64), np.zeros((n, t), bool)
    for i, (_, y) in enumerate(pages):
        label[i, : len(y)], mask[i, : len(y)] = y, True
    slot = np.concatenate([f for x, _ in pages for f in x])
    row = np.repeat(np.flatnonzero(mask.ravel()), [len(f) for x, _ in pages for f in x])
    crf = Crf(np.zeros(SLOTS), np.zeros((2, 2)), np.zeros(2))
    seen = [np.full(SLOTS, 1e-8), np.full((2, 2), 1e-8), np.full(2, 1e-8)]
    for _ in range(rounds):
        emission = np.bincount(row, crf.weights[slot], n * t).reshape(n, t)
        _, ge, gm, gs = likelihood(crf, emission, label, mask)
        grads = (np.bincount(slot, ge.ravel()[row], SLOTS) - PENALTY * crf.weights, gm, gs)
        for x, g, s in zip((crf.weights, crf.moves, crf.start), grads, seen, strict=True):
            s += g * g
            x += rate * g / np.sqrt(s)
    return crf


def main_text(crf: Crf, page: str | None) -> str:
    texts, features = sequence(page)
    return "\n\n".join(t for t, y in zip(texts, crf.decode(features), strict=True) if y)


def extracted(pages: DataFrame, crf: Crf | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep` with text and n_chars (code points) of each page."""
    crf = crf or fit(training_pages(TRAIN_PAGES))
    shared = pages.sparkSession.sparkContext.broadcast((crf.weights, crf.moves, crf.start))
    frame = pages.select(*keep, F.col(html_col).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Crf(*shared.value)
        for batch in batches:
            begin, held, texts = 0, 0, []
            for i, page in enumerate(batch.column(len(keep))):
                texts.append(main_text(own, page.as_py()))
                held += len(texts[-1])
                if held >= HELD_CHARACTERS or i + 1 == batch.num_rows:
                    part = batch.slice(begin, len(texts))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])
                    begin, held, texts = i + 1, 0, []

    schema = frame.select(*keep, F.lit("").alias("text")).schema
    return frame.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
