"""Quality rules: base rules and gradient-boosted trees over document statistics.

Statistics of a text are array passes over its bytes, a block of texts at a time.  The trees
are trained on the driver in numpy on a bounded sample of labelled rows, with logistic
loss on histograms.  Chosen features are monotonic: a split that would raise the
score along them is not taken, and the leaves below a split stay on their side of its
midpoint.  All trees are flattened into arrays of nodes (feature, threshold, value), and a
block of rows walks all trees at once, one array step per level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchment.llm.common import Block, Spans, blocks, chosen, mix, runs, span_hashes, window_hashes, words

LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words
MOST_LABELLED = 20000
REJECT_SHARE = 0.002  # of the good rows put aside, at most
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_ROWS = 60, 4, 32, 0.15, 1.0, 20

#: Feature and the direction in which it may move the score; 0 is free.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "digit_share": 0, "upper_share": 0, "punct_share": 0, "other_share": 0, "mean_line": 0,
    "distinct_share": 0, "letter_free_share": 0, "long_word_share": 0,
}

# --- statistics --------------------------------------------------------------------------


def _kind(chars: bytes) -> np.ndarray:
    marked = np.zeros(256, np.int8)
    marked[list(chars)] = 1
    return marked


_SYMBOL = _kind(b"#*$%&|<>")
_DIGIT = _kind(b"0123456789")
_UPPER = _kind(bytes(range(65, 91)))
_LETTER = _kind(bytes([*range(65, 91), *range(97, 123), *range(0xC2, 0xF5)]))
_PUNCT = _kind(b".,;:!?")
_FIRST = np.ones(256, np.int8)  # bytes that begin a code point
_FIRST[0x80:0xC0] = 0
_LEAD = np.zeros(256, np.int8)
_LEAD[0xC2:0xF5] = 1


class _Sums:
    """Counts of marked bytes between two places."""

    def __init__(self, marked: np.ndarray):
        self.total = np.zeros(len(marked) + 1, np.int32)
        np.cumsum(marked, out=self.total[1:], dtype=np.int32)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]).astype(np.int64)


def _repeats(key: np.ndarray) -> np.ndarray:
    """Marks the values that occur twice or more."""
    order = np.argsort(key, kind="stable")
    line = key[order]
    same = np.zeros(len(line) + 1, bool)
    same[1:-1] = line[1:] == line[:-1]
    marked = np.zeros(len(key), bool)
    marked[order] = same[1:] | same[:-1]
    return marked


def _distinct(key: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys per row; keys already differ between rows."""
    if not len(key):
        return np.zeros(n, np.int64)
    first = np.unique(key, return_index=True)[1]
    return np.bincount(row[first], minlength=n)


def statistics(block: Block) -> dict[str, np.ndarray]:
    """Counts of every row; those of the base rules are ``n_*`` and ``word_chars``."""
    n, low, high = block.n, block.at[:-1], block.at[1:]
    spans = words(block)
    count = spans.counts(n)
    first = _Sums(_FIRST[block.data])
    chars = first.of(low, high)
    length = first.of(spans.start, spans.end)
    word_chars = np.bincount(spans.row, length, n).astype(np.int64)

    salt = mix(spans.row.astype(np.uint64))
    hashes = span_hashes(block, spans)
    window = window_hashes(hashes, 3)
    place = np.arange(len(hashes)) - (np.cumsum(count) - count)[spans.row]
    whole = np.flatnonzero((place + 3 <= count[spans.row])[:len(window)])
    twice = whole[_repeats(mix(window[whole] ^ salt[whole]))]
    repeated = np.zeros(len(hashes) + 3, bool)
    for k in range(3):
        repeated[twice + k] = True
    n_repeat = np.bincount(spans.row, repeated[:len(hashes)], n).astype(np.int64)

    lines = runs(block.data != 10, block.at)
    starts = _Sums(np.bincount(spans.start, minlength=len(block.data)).astype(np.int8))
    worded = starts.of(lines.start, lines.end) > 0
    lines = Spans(lines.start[worded], lines.end[worded], lines.row[worded])
    line_key = mix(span_hashes(block, lines) ^ mix(lines.row.astype(np.uint64)))
    n_lines = lines.counts(n)

    of = lambda marked: _Sums(marked[block.data]).of(low, high)
    letters = _Sums(_LETTER[block.data])
    bare = letters.of(spans.start, spans.end) == 0
    return {
        "n_words": count, "word_chars": word_chars, "n_symbols": of(_SYMBOL),
        "n_dup_lines": n_lines - _distinct(line_key, lines.row, n), "n_repeat_words": n_repeat,
        "chars": chars, "lines": n_lines, "digits": of(_DIGIT), "uppers": of(_UPPER), "puncts": of(_PUNCT),
        "others": of(_LEAD), "distinct": _distinct(mix(hashes ^ salt), spans.row, n),
        "bare": np.bincount(spans.row, bare, n).astype(np.int64),
        "long": np.bincount(spans.row, length > 15, n).astype(np.int64),
    }


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    word, char, line = (np.maximum(s[k], 1) for k in ("n_words", "chars", "lines"))
    return np.stack([
        np.log1p(s["n_words"]), s["word_chars"] / word, s["n_symbols"] / char, s["n_dup_lines"] / line,
        s["n_repeat_words"] / word, s["digits"] / char, s["uppers"] / char, s["puncts"] / char, s["others"] / char,
        s["n_words"] / line, s["distinct"] / word, s["bare"] / word, s["long"] / word,
    ], 1)


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


# --- trees -------------------------------------------------------------------------------


@dataclass
class Trees:
    """Complete binary trees as arrays, tree by node; the children of node i are 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    least: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good for every row of features."""
        tree = np.arange(len(self.feature))[None, :]
        row = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return 1 / (1 + np.exp(-(self.base + self.value[tree, node].sum(1))))


def boost(x: np.ndarray, y: np.ndarray, directions: list[int]) -> Trees:
    """Gradient boosting with logistic loss; ``directions`` as in FEATURES."""
    n, width = x.shape
    inner = 2**DEPTH - 1
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)], 1)
    sign = np.array(directions)[:, None]
    feature = np.zeros((TREES, 2 * inner + 1), np.int64)
    threshold = np.full((TREES, 2 * inner + 1), np.inf)
    value = np.zeros((TREES, 2 * inner + 1))
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            at = node - first
            shape = (many, width, BINS)
            key = (at[:, None] * width + np.arange(width)) * BINS + binned
            gs = np.bincount(key.ravel(), np.repeat(g, width), many * width * BINS).reshape(shape).cumsum(2)
            hs = np.bincount(key.ravel(), np.repeat(h, width), many * width * BINS).reshape(shape).cumsum(2)
            ns = np.bincount(key.ravel(), minlength=many * width * BINS).reshape(shape).cumsum(2)
            g_all, h_all, n_all = gs[:, :, -1:], hs[:, :, -1:], ns[:, :, -1:]
            own_low, own_high = (b[first:first + many, None, None] for b in (low, high))
            left = np.clip(gs / (hs + RIDGE), own_low, own_high)
            right = np.clip((g_all - gs) / (h_all - hs + RIDGE), own_low, own_high)
            gain = _gain(gs, hs, left) + _gain(g_all - gs, h_all - hs, right)
            whole = np.clip(g_all / (h_all + RIDGE), own_low, own_high)
            gain = gain - _gain(g_all, h_all, whole)
            gain[(ns < LEAST_ROWS) | (n_all - ns < LEAST_ROWS) | (sign[None] * (right - left) < 0)] = 0
            for f in range(width):
                gain[:, f, len(cuts[f]):] = 0
            best = gain.reshape(many, -1).argmax(1)
            for k in range(many):
                f, b = divmod(int(best[k]), BINS)
                i = first + k
                a, c = 2 * i + 1, 2 * i + 2
                low[[a, c]], high[[a, c]] = low[i], high[i]
                if gain[k, f, b] <= 1e-9:
                    # No split: everything goes left, which inherits the node's value.
                    value[t, a] = value[t, c] = float(whole[k, 0, 0])
                    continue
                feature[t, i], threshold[t, i] = f, cuts[f][b]
                value[t, a], value[t, c] = left[k, f, b], right[k, f, b]
                middle = (left[k, f, b] + right[k, f, b]) / 2
                if directions[f] > 0:
                    high[a], low[c] = middle, middle
                elif directions[f] < 0:
                    low[a], high[c] = middle, middle
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        value[t] *= RATE
        score += value[t, node]
    return Trees(feature, threshold, value, base)


def _gain(g: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return g * w - 0.5 * (h + RIDGE) * w * w


def train(x: np.ndarray, y: np.ndarray, reject_share: float = REJECT_SHARE, seed: int = 5) -> Trees | None:
    """None unless both good and bad rows are there.

    A fifth of the rows is put aside.  The limit is the score that all but ``reject_share`` of the
    good ones there reach, a half at most.
    """
    if len(np.unique(y)) < 2:
        return None
    order = np.random.default_rng(seed).permutation(len(y))
    aside, used = order[:len(y) // 5], order[len(y) // 5:]
    trees = boost(x[used], y[used].astype(float), list(FEATURES.values()))
    good = aside[y[aside] == 1]
    if len(good):
        trees.least = min(0.5, float(np.quantile(trees.score(x[good]), reject_share)))
    return trees


# --- operator ----------------------------------------------------------------------------

_FEATURE_ROW = "doc_id bigint, x array<double>"
OUT = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, score double, kept boolean"
)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.columns
        for block in blocks(texts):
            x = features(statistics(block))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([ids[block.rows], lists], names=["doc_id", "x"])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Trees | None:
    """Trains on at most ``most`` labelled documents, taken in the order of a hash of their id.

    Of several labels of a document the worse counts, of several rows the one whose statistics
    sort first.
    """
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    turn = F.xxhash64(F.lit("quality sample"), "doc_id")
    picked = labels.orderBy(turn, "doc_id").limit(most)
    # At most ``most`` pairs of numbers, so the broadcast is bounded by the parameter.
    named = docs.join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
    rows = named.mapInArrow(_features, _FEATURE_ROW).groupBy("doc_id").agg(F.min("x").alias("x"))
    known = rows.join(F.broadcast(picked), "doc_id").orderBy("doc_id").limit(most).toPandas()
    if known.empty:
        return None
    return train(np.stack(known["x"].to_list()), (known["quality"].to_numpy() > 0).astype(np.int64))


def judge_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_id: str = "doc_id", label_col: str = "quality", most: int = MOST_LABELLED,
) -> DataFrame:
    """Base statistics, ``base_failed``, the trees' ``score`` and ``kept`` of every row.

    A null or empty text has no words and fails the base rules.  Without labels of both kinds
    there is no score (null), and what passes the base rules is kept.  Labels of unknown
    documents do nothing.  Repeated rows come back as often as they came.  Other columns are
    not looked at.
    """
    docs = chosen(docs, doc_id=(id_col, "bigint"), text=(text_col, "string"))
    labels = chosen(labels, doc_id=(label_id, "bigint"), quality=(label_col, "int"))
    trees = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trees.value
        for batch in batches:
            ids, texts = batch.columns
            for block in blocks(texts):
                s = statistics(block)
                failed = base_failed(s["n_words"], s["n_repeat_words"])
                score = model.score(features(s)) if model else None
                kept = ~failed & (score >= model.least) if model else ~failed
                yield pa.RecordBatch.from_arrays([
                    ids[block.rows],
                    *[pa.array(s[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                    pa.array(failed), pa.array(score, pa.float64()) if model else pa.nulls(block.n, pa.float64()), pa.array(kept),
                ], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"])

    return docs.mapInArrow(run, OUT)
