"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its subwords: all runs of 2, 3 and 4
bytes after lower-casing, with everything that is no letter as a space.  Subwords are
hashed to ``BUCKETS`` rows.  Embeddings and the softmax are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled rows; every
sampled text also gives a short slice of itself, so that short texts are known.
Since both layers are linear, scoring needs one number per bucket and
language only.

Scores are calibrated on a fifth of the sample that training never saw: a
temperature makes them probabilities, and a text is rejected if its score is below
what all but ``REJECT_SHARE`` of the rightly named texts there reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catchment.llm.common import Block, blocks, chosen, settled

BUCKETS = 1 << 16
WIDTHS = (2, 3, 4)
DIMENSIONS = 16
EPOCHS = 6
RATE = 0.4
PER_LANGUAGE = 800  # sampled texts of each language
MOST_SAMPLED = 8000  # and of all languages
MOST_CHARS = 16_384  # characters learned from a text: a longer one gives a piece of that length, drawn by its id
LEAST_ROWS = 5  # but so many of each language, however many there are
REJECT_SHARE = 0.001
MOST_LEAST = 0.4  # below an even choice of two: a text of two known languages is known
SLICE_BYTES = 48
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 0x20
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # language by bucket
    bias: np.ndarray
    temperature: float
    least_score: float


def subwords(data: np.ndarray) -> list[np.ndarray]:
    """Bucket of the subword of each width that begins at each byte; spaces alone are bucket 0."""
    fold = _FOLD[data].astype(np.uint64)
    found, code = [], fold
    for width in range(2, max(WIDTHS) + 1):
        if len(fold) < width:
            found.append(np.zeros(0, np.int64))
            continue
        code = code[:len(fold) - width + 1] | (fold[width - 1:] << np.uint64(8 * (width - 1)))
        if width in WIDTHS:
            bucket = ((code * _SPREAD) >> np.uint64(48)).astype(np.int64) % (BUCKETS - 1) + 1
            bucket[code == np.uint64(int.from_bytes(b" " * width, "little"))] = 0
            found.append(bucket)
    return found


def block_logits(block: Block, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Scores before the softmax, row by language; column 0 of ``table`` must be 0."""
    total = np.zeros((block.n, len(bias)))
    count = np.zeros(block.n)
    for width, bucket in zip(WIDTHS, subwords(block.data)):
        size = np.maximum(np.diff(block.at) - width + 1, 0)
        has = np.flatnonzero(size)
        if not len(has):
            continue
        edge = np.stack([block.at[has], block.at[has] + size[has]], 1).ravel()
        edge = edge[:-1] if edge[-1] >= len(bucket) else edge
        count[has] += np.add.reduceat((bucket > 0).astype(np.int64), edge)[::2]
        for k, line in enumerate(table):
            total[has, k] += np.add.reduceat(line[bucket], edge, dtype=np.float64)[::2]
    return total / np.maximum(count, 1)[:, None] + bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _bag(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bucket = np.concatenate(subwords(data))
    ids, count = np.unique(bucket[bucket > 0], return_counts=True)
    return ids, count / max(count.sum(), 1)


def train(texts: list[str], languages: list[str], seed: int = 7) -> LanguageModel | None:
    """None without a labelled text."""
    names = sorted(set(languages))
    if not names:
        return None
    random = np.random.default_rng(seed)
    label = np.searchsorted(names, languages)
    order = random.permutation(len(texts))
    aside, learned = order[: len(texts) // 5], order[len(texts) // 5:]
    # The rows of a language that would all stand aside are learned from.
    only = ~np.isin(label[aside], label[learned])
    aside, learned = aside[~only], np.concatenate([learned, aside[only]])
    bags: list[tuple[np.ndarray, np.ndarray, int]] = []
    for i in learned:
        data = np.frombuffer(texts[i].encode(), np.uint8)
        low = int(random.integers(0, max(1, len(data) - SLICE_BYTES + 1)))
        bags += [(*_bag(data), label[i]), (*_bag(data[low:low + SLICE_BYTES]), label[i])]
    embedding = random.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    linear = np.zeros((DIMENSIONS, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)
    steps, step = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(bags)):
            ids, share, y = bags[i]
            rate = RATE * (1 - step / steps)
            step += 1
            share = share.astype(np.float32)
            mean = share @ embedding[ids]
            score = mean @ linear + bias
            error = np.exp(score - score.max())
            error /= error.sum()
            error[y] -= 1
            back = linear @ error
            linear -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            embedding[ids] -= (rate * len(ids) ** 0.5) * np.outer(share, back)
    embedding[0] = 0
    table = np.ascontiguousarray((embedding @ linear).T)
    temperature, least = _calibrate(texts, label, aside, table, bias)
    return LanguageModel(names, table, bias, temperature, least)


def _calibrate(texts: list[str], label: np.ndarray, aside: np.ndarray, table: np.ndarray, bias: np.ndarray) -> tuple[float, float]:
    if not len(aside):
        return 1.0, 0.0
    logits = np.concatenate([block_logits(b, table, bias) for b in blocks(pa.array([texts[i] for i in aside]))])
    truth = label[aside]
    losses = {t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.geomspace(0.05, 20, 60)}
    temperature = float(min(losses, key=losses.get))
    scores = softmax(logits / temperature)
    right = scores.argmax(1) == truth
    least = min(float(np.quantile(scores.max(1)[right], REJECT_SHARE)), MOST_LEAST) if right.any() else 0.0
    return temperature, least


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def lettered_rows(block: Block) -> np.ndarray:
    """Which rows have a letter; texts without an ASCII one are looked at letter by letter."""
    total = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum(_ASCII_LETTER[block.data], out=total[1:])
    lettered = total[block.at[1:]] > total[block.at[:-1]]
    for i in np.flatnonzero(~lettered):
        lettered[i] = any(c.isalpha() for c in block.text(i))
    return lettered


def predict(block: Block, model: LanguageModel | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each row."""
    lettered = lettered_rows(block)
    if model is None:
        return [UNKNOWN] * block.n, np.zeros(block.n), np.ones(block.n, bool)
    scores = softmax(block_logits(block, model.table, model.bias) / model.temperature)
    best, score = scores.argmax(1), scores.max(1)
    score[~lettered] = 0
    names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), lettered.tolist())]
    return names, score, ~lettered | (score < model.least_score)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST_SAMPLED) -> DataFrame:
    """Labelled rows with a text outside the held-out part, those of each language with the least hash of their id.

    All languages are there; with many the share of each is smaller, but not below LEAST_ROWS.
    """
    labelled = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").where(~held_out())
    counts = settled(labelled.groupBy("lang").agg(F.count("*").alias("_rows")))
    share = min(per_language, max(LEAST_ROWS, most // max(1, counts.count())))
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # So many more are drawn that fewer than the share are out of the question; then they are counted off.
    enough = (share + 10 * share ** 0.5 + 20) / F.col("_rows")
    drawn = labelled.join(F.broadcast(counts), "lang").withColumn("_draw", draw).where(F.col("_draw") < enough)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_draw", "doc_id", "text"))
    return drawn.withColumn("_place", place).where(F.col("_place") <= share).select(docs.columns)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST_SAMPLED) -> LanguageModel | None:
    """Trains on at most ``most`` texts, ``per_language`` of each language or an even share, but LEAST_ROWS of each.

    What reaches the driver is bounded in bytes too, by MOST_CHARS of each text.
    """
    low = F.expr(f"cast(pmod(xxhash64('piece', doc_id), length(text) - {MOST_CHARS} + 1) AS int) + 1")
    piece = F.when(F.length("text") > MOST_CHARS, F.substring("text", low, F.lit(MOST_CHARS))).otherwise(F.col("text"))
    rows = sample_rows(docs, per_language, most).select("doc_id", "lang", piece.alias("text")).toPandas()
    rows = rows.sort_values(["doc_id", "lang", "text"])
    return train(rows["text"].tolist(), rows["lang"].tolist())


OUT = "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean"


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = PER_LANGUAGE, most: int = MOST_SAMPLED,
) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` and ``rejected`` of every row.

    Learns from rows with a language whose crc32(id) mod 4 is not 2, and predicts from the
    text alone.  A null text, or one without a letter, is ``und`` with score 0 and rejected; so is
    every text if nothing can be learned.  A null id is not held out and not learned
    from.  Equal texts get equal results.  Other columns of ``docs`` are not looked at.
    """
    docs = chosen(docs, doc_id=(id_col, "bigint"), text=(text_col, "string"), lang=(lang_col, "string"))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, per_language, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, texts = batch.columns
            for block in blocks(texts):
                names, score, rejected = predict(block, model.value)
                yield pa.RecordBatch.from_arrays(
                    [ids[block.rows], held[block.rows], pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
                    names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
                )

    return docs.select("doc_id", held_out().alias("held"), "text").mapInArrow(run, OUT)


def keep_known(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = PER_LANGUAGE, most: int = MOST_SAMPLED,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not rejected.

    If nothing can be learned, texts with a letter stay.
    """
    known = chosen(docs, doc_id=(id_col, "bigint"), text=(text_col, "string"), lang=(lang_col, "string"))
    model = docs.sparkSession.sparkContext.broadcast(fit(known, per_language, most))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(at)):
                names, _, rejected = predict(block, model.value)
                kept = ~rejected if model.value else lettered_rows(block)
                yield batch.slice(block.rows.start, block.n).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
