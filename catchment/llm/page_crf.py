"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

Every block is main text or not.  The field weighs features of the block and its ancestors
(tags, words of classes and ids, length, link share, punctuation, place) and the
change from one block to the next.  It is trained in numpy on labelled pages: a seeded
generator writes pages in many layouts and marks what is main text.  All pages are
padded to one array, so that forward-backward and Viterbi take one array step per
block position and not per page.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from catchment.llm.common import chosen
from catchment.llm.page_blocks import FEATURES, parser
from catchment.llm.page_samples import labelled_pages

TRAINING_PAGES = 500
STEPS, RATE, RIDGE = 120, 0.08, 2e-3
PADDED = 200_000  # blocks, padding included, decoded at once


@dataclass
class Field:
    weight: np.ndarray  # feature by label
    change: np.ndarray  # label by next label
    start: np.ndarray


@dataclass
class Chains:
    """Blocks of several pages: flat features and a padded place for each block."""

    block: np.ndarray
    feature: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, pages: list[list[tuple[int, ...]]]) -> Chains:
        flat = [f for page in pages for f in page]
        return cls(
            np.repeat(np.arange(len(flat)), [len(f) for f in flat]),
            np.fromiter((x for f in flat for x in f), np.int64), np.array([len(p) for p in pages]),
        )

    @property
    def n(self) -> int:
        return int(self.size.sum())

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        page = np.repeat(np.arange(len(self.size)), self.size)
        return page, np.arange(self.n) - (np.cumsum(self.size) - self.size)[page]

    def scores(self, weight: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.block, weight[self.feature, k], self.n) for k in (0, 1)], 1)


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def train(pages: list[list[tuple[tuple[int, ...], int]]]) -> Field:
    """Maximum likelihood with a ridge, by Adam over all pages at once."""
    chains = Chains.of([[f for f, _ in page] for page in pages])
    label = np.array([y for page in pages for _, y in page])
    page, place = chains.places()
    n, longest = len(pages), int(chains.size.max())
    inside = np.arange(longest)[None, :] < chains.size[:, None]
    truth = np.zeros((chains.n, 2))
    truth[np.arange(chains.n), label] = 1
    next_in = np.flatnonzero(page[1:] == page[:-1])
    seen_change = np.zeros((2, 2))
    np.add.at(seen_change, (label[next_in], label[next_in + 1]), 1)
    seen_start = truth[place == 0].sum(0)

    x = np.zeros(FEATURES * 2 + 6)
    mean, power = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        weight, change, start = x[:-6].reshape(FEATURES, 2), x[-6:-2].reshape(2, 2), x[-2:]
        score = np.zeros((n, longest, 2))
        score[page, place] = chains.scores(weight)
        forth, back = np.zeros_like(score), np.zeros_like(score)
        forth[:, 0] = score[:, 0] + start
        for t in range(1, longest):
            moved = _sum(forth[:, t - 1, :, None] + change, 1) + score[:, t]
            forth[:, t] = np.where(inside[:, t, None], moved, forth[:, t - 1])
        total = _sum(forth[:, -1], 1)
        expected_change = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            ahead = score[:, t + 1] + back[:, t + 1]
            both = forth[:, t, :, None] + change + ahead[:, None, :] - total[:, None, None]
            expected_change += np.exp(both[inside[:, t + 1]]).sum(0)
            back[:, t] = np.where(inside[:, t + 1, None], _sum(change + ahead[:, None, :], 2), 0)
        chance = np.exp(forth + back - total[:, None, None])[page, place]
        rest = truth - chance
        slope = np.concatenate([
            np.stack([np.bincount(chains.feature, rest[chains.block, k], FEATURES) for k in (0, 1)], 1).ravel(),
            (seen_change - expected_change).ravel(), seen_start - chance[place == 0].sum(0),
        ]) / n - RIDGE * x
        mean = 0.9 * mean + 0.1 * slope
        power = 0.999 * power + 0.001 * slope * slope
        x = x + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(power / (1 - 0.999**step)) + 1e-8)
    return Field(x[:-6].reshape(FEATURES, 2), x[-6:-2].reshape(2, 2), x[-2:])


def viterbi(field: Field, chains: Chains) -> np.ndarray:
    """Best label of every block; main text wins a tie."""
    label = np.zeros(chains.n, np.int8)
    score = chains.scores(field.weight)
    first = np.cumsum(chains.size) - chains.size
    order = np.argsort(chains.size, kind="stable")
    order = order[chains.size[order] > 0]
    while len(order):
        # Pages of like length share an array, so that little of it is padding.
        many = max(1, min(len(order), PADDED // int(chains.size[order[-1]])))
        now, order = order[-many:], order[:-many]
        size = chains.size[now]
        longest = int(size[-1])
        inside = np.arange(longest)[None, :] < size[:, None]
        at = np.where(inside, first[now][:, None] + np.arange(longest), 0)
        best = score[at[:, 0]] + field.start
        came = np.zeros((many, longest, 2), np.int8)
        for t in range(1, longest):
            ways = best[:, :, None] + field.change
            came[:, t] = ways[:, 1] >= ways[:, 0]
            moved = ways.max(1) + score[at[:, t]]
            best = np.where(inside[:, t, None], moved, best)
        state = (best[:, 1] >= best[:, 0]).astype(np.int8)
        rows = np.arange(many)
        for t in range(longest - 1, -1, -1):
            live = inside[:, t]
            label[at[live, t]] = state[live]
            state = np.where(live, came[rows, t, state], state) if t else state
    return label


def fit(pages: int = TRAINING_PAGES, seed: int = 11) -> Field:
    """Trains on this many labelled pages, written anew from the seed."""
    read = parser()
    return train([
        [(block.features, int(label == "main")) for block, label in read.blocks(page)] for page in labelled_pages(pages, seed)
    ])


OUT = "page_id bigint, url string, text string, n_chars bigint, n_blocks int, n_main int"


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", training_pages: int = TRAINING_PAGES) -> DataFrame:
    """``page_id``, ``url``, ``text``, its length and the number of blocks seen and kept, per row.

    Character references are decoded, white space inside a block becomes one space, blocks are joined
    by line feeds in page order.  Null or empty pages, and pages without main text, have
    an empty text.  Broken markup is read as far as it goes.  Repeated rows come back as
    often as they came.  Other columns are not looked at.
    """
    pages = chosen(pages, page_id=(id_col, "bigint"), url=(url_col, "string"), html=(html_col, "string"))
    field = pages.sparkSession.sparkContext.broadcast(fit(training_pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = parser()
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                found = [[b for b, _ in read.blocks(page or "")] for page in part.column("html").to_pylist()]
                label = viterbi(field.value, Chains.of([[b.features for b in page] for page in found])).tolist()
                texts, mains, at = [], [], 0
                for page in found:
                    main = [b.text for b, y in zip(page, label[at:at + len(page)]) if y]
                    at += len(page)
                    texts.append("\n".join(main))
                    mains.append(len(main))
                yield pa.RecordBatch.from_arrays([
                    part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()),
                    pa.array(map(len, found), pa.int32()), pa.array(mains, pa.int32()),
                ], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    return pages.mapInArrow(run, OUT)
