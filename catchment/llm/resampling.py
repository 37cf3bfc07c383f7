"""Importance resampling towards a target distribution of hashed n-grams.

Every run of one to three words is a feature and falls into one of ``BUCKETS`` buckets.  A bucket
that is more frequent in the target than in the documents has a positive gain; a document weighs
as much as the gains of its features together.  Seeded Gumbel noise on top of the weights and the
highest scores give a draw without replacement whose chances follow the weights.

Features are interned batch by batch in an open-addressed table of numpy arrays: xxhash64 of the
bytes is the key, bytes are compared before two features share a slot, and a slot holds the bucket
and the count of its feature.  So the bucket of a feature is found once per batch, counts are
summed over slots instead of occurrences, and the slot of every occurrence gathers its gain.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchment.llm.common import LOWER, Block, blocks, chosen, runs, settled

BUCKETS = 10_000
LONGEST = 3  # words of a feature
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Words whose features are interned together.
SLICE_WORDS = 1 << 14
#: Bytes from which a feature is hashed and compared on its own.
ALONE = 4096
STEPS = 128  # the same for crc32, which goes byte by byte

#: Bytes of words once A-Z are lowered: digits, a-z and all of U+0080 and above.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True

# Primes of xxhash64 (fixed values).
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
# Table of crc32 (reversed polynomial 0xEDB88320, a fixed value), one step per bit.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_STATES = [np.uint64(v % (1 << 64)) for v in (int(P1) + int(P2), int(P2), 0, -int(P1))]


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(state: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turned(state + lane * P2, 31) * P1


@dataclass
class Grams:
    """Features of neighbouring words: ``text`` with 8 bytes to spare, byte ranges, and the row of each."""

    text: np.ndarray
    start: np.ndarray
    size: np.ndarray
    row: np.ndarray

    def __post_init__(self) -> None:
        # The eight bytes from every place on, as one little-endian number.
        self.lanes = np.ndarray(len(self.text) - 7, "<u8", self.text, strides=(1,)).astype(np.uint64)

    def raw(self, i: int) -> bytes:
        return self.text[self.start[i]:self.start[i] + self.size[i]].tobytes()

    def xxhash64(self) -> np.ndarray:
        """xxhash64 with seed 0 of every feature, all features of a step at once."""
        start, size = self.start, self.size
        h = np.full(len(start), P5)
        stripes = size // 32
        wide = np.flatnonzero((stripes > 0) & (size < ALONE))
        if len(wide):
            states = [np.full(len(wide), v) for v in _STATES]
            for s in range(int(stripes[wide].max())):
                on = np.flatnonzero(stripes[wide] > s)
                at = start[wide[on]] + 32 * s
                for k, state in enumerate(states):
                    state[on] = _round(state[on], self.lanes[at + 8 * k])
            v = _turned(states[0], 1) + _turned(states[1], 7) + _turned(states[2], 12) + _turned(states[3], 18)
            for state in states:
                v = (v ^ _round(np.zeros_like(state), state)) * P1 + P4
            h[wide] = v
        h += size.astype(np.uint64)
        at, rest = start + 32 * stripes, size - 32 * stripes
        for k in range(3):
            on = np.flatnonzero(rest >= 8 * (k + 1))
            h[on] = _turned(h[on] ^ _round(np.uint64(0), self.lanes[at[on] + 8 * k]), 27) * P1 + P4
        at, rest = at + (rest & ~7), rest & 7
        on = np.flatnonzero(rest >= 4)
        h[on] = _turned(h[on] ^ (self.lanes[at[on]] & _LANE[4]) * P1, 23) * P2 + P3
        at, rest = at + (rest & 4), rest & 3
        for k in range(3):
            on = np.flatnonzero(rest > k)
            h[on] = _turned(h[on] ^ (self.text[at[on] + k].astype(np.uint64) * P5), 11) * P1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        h ^= h >> np.uint64(32)
        for i in np.flatnonzero(size >= ALONE):
            h[i] = xxhash.xxh64_intdigest(self.raw(i))
        return h

    def crc32(self, which: np.ndarray) -> np.ndarray:
        """crc32 of the features numbered ``which``, byte by byte through all of them, longest first."""
        size = self.size[which]
        order = np.argsort(-size)
        at, size = self.start[which[order]], size[order]
        crc = np.full(len(which), 0xFFFFFFFF, np.uint32)
        alone = int(np.searchsorted(-size, -STEPS, "right"))
        ends = np.searchsorted(-size, -np.arange(STEPS), "left")  # how many are longer than so many bytes
        for step in range(int(size[alone]) if alone < len(size) else 0):
            on = slice(alone, ends[step])
            crc[on] = _CRC[(crc[on] ^ self.text[at[on] + step]) & 255] ^ (crc[on] >> 8)
        crc ^= 0xFFFFFFFF
        crc[:alone] = [zlib.crc32(self.raw(i)) for i in which[order[:alone]]]
        found = np.empty_like(crc)
        found[order] = crc
        return found

    def same_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the features numbered ``a`` and ``b`` are equal, pair by pair."""
        same = self.size[a] == self.size[b]
        size = np.where(same, self.size[a], 0)
        short = np.minimum(size, ALONE)
        on = np.flatnonzero(size > 0)
        at = 0
        while len(on):
            differ = self.lanes[self.start[a[on]] + at] ^ self.lanes[self.start[b[on]] + at]
            same[on] &= (differ & _LANE[np.minimum(short[on] - at, 8)]) == 0
            at += 8
            on = on[(short[on] > at) & same[on]]
        for i in np.flatnonzero(same & (size > ALONE)):
            same[i] = self.raw(a[i]) == self.raw(b[i])
        return same


class GramTable:
    """Open-addressed table of the distinct features of one batch.

    Slots are probed one after the other from the hash on.  ``slot`` is the slot of every
    occurrence; ``owner`` (an occurrence, or -1 where a slot is free), ``bucket`` and ``count`` are
    arrays over slots, and ``used`` lists the slots that hold a feature.
    """

    def __init__(self, grams: Grams, n_buckets: int = BUCKETS, hashes: np.ndarray | None = None) -> None:
        n = len(grams.start)
        mask = (1 << max(4, (2 * n).bit_length())) - 1
        hashes = grams.xxhash64() if hashes is None else hashes
        self.owner = np.full(mask + 1, -1, np.int32)
        self.slot = (hashes & np.uint64(mask)).astype(np.int32)
        todo = np.arange(n, dtype=np.int32)
        while len(todo):
            at = self.slot[todo]
            free = np.flatnonzero(self.owner[at] < 0)
            self.owner[at[free]] = todo[free]  # of several that meet in a free slot one stays
            there = self.owner[at]
            other = np.flatnonzero(there != todo)
            alike = other[hashes[there[other]] == hashes[todo[other]]]
            alike = alike[grams.same_bytes(there[alike], todo[alike])]
            on = np.zeros(len(todo), bool)
            on[other] = True
            on[alike] = False
            todo = todo[on]
            self.slot[todo] = (at[on] + 1) & mask
        self.used = np.flatnonzero(self.owner >= 0)
        self.bucket = np.zeros(mask + 1, np.int32)
        self.bucket[self.used] = grams.crc32(self.owner[self.used]) % n_buckets
        self.count = np.bincount(self.slot, minlength=mask + 1)

    def by_bucket(self, n_buckets: int = BUCKETS) -> np.ndarray:
        """Occurrences per bucket."""
        return np.bincount(self.bucket[self.used], self.count[self.used], n_buckets).astype(np.int64)


def features(block: Block, most_words: int = SLICE_WORDS) -> tuple[np.ndarray, Iterator[Grams]]:
    """Words per row of a block, and its features slice by slice.

    Features that begin in one slice of words may end two words beyond it, so none is lost at a border.
    """
    data = LOWER[block.data]
    spans = runs(WORD_BYTE[data], block.at)

    def slices() -> Iterator[Grams]:
        n = len(spans.start)
        for low in range(0, n, most_words):
            high = min(n, low + most_words)
            end = min(n, high + LONGEST - 1)
            size = (spans.end - spans.start)[low:end]
            place = np.concatenate([[0], np.cumsum(size + 1)])
            text = np.full(place[-1] + 8, 0x20, np.uint8)
            text[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = data[
                np.arange(size.sum()) + np.repeat(spans.start[low:end] - (np.cumsum(size) - size), size)]
            row = spans.row[low:end]
            parts = []
            for k in range(LONGEST):
                first = np.arange(min(high - low, len(size) - k))
                first = first[row[first] == row[first + k]]
                parts.append((place[first], place[first + k] + size[first + k] - place[first], row[first]))
            yield Grams(text, *map(np.concatenate, zip(*parts)))

    return spans.counts(block.n), slices()


def bucket_counts(texts: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``n``, the features in it, of the buckets that have any.

    Every task hands on one row per bucket, however many texts it has read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                for grams in features(block)[1]:
                    total += GramTable(grams, n_buckets).by_bucket(n_buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket, in thousandths; all that reaches the driver is two counts per bucket."""
    def counted(texts: DataFrame) -> list[int]:
        counts = [0] * n_buckets
        for r in bucket_counts(texts, n_buckets).collect():
            counts[r.bucket] = r.n
        return counts

    s, t = counted(docs), counted(target)
    of_docs, of_target = float(sum(s) + n_buckets), float(sum(t) + n_buckets)
    ratios = ((float(b + 1) * of_docs) / (float(a + 1) * of_target) for a, b in zip(s, t))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def _noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from a hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def first_ranks(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3 ... by ``order``, null beyond ``most``.

    Rows are sorted in ranges, which are written once, and the sizes of earlier ranges are added; so no
    task numbers more than one range, and the driver sees one number per range.
    """
    in_order = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = in_order.withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    offsets, total = [], 0
    for r in sorted(placed.groupBy("_range").agg((F.max("_at") + 1).alias("n")).collect(), key=lambda r: r["_range"]):
        offsets.append((r["_range"], total))
        total += r.n
    before = rows.sparkSession.createDataFrame(offsets, "_range bigint, _before bigint")
    rank = F.col("_before") + F.col("_at") + 1
    return placed.join(F.broadcast(before), "_range").withColumn("rank", F.when(rank <= most, rank)).select(*rows.columns, "rank")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, n_buckets: int = BUCKETS,
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` of every document.

    ``percent`` of the documents with at least ``least_words`` words are drawn, rounded down, and have a
    ``rank`` by falling score; ties go to the smaller id.  A null or empty text has no words and weight 0;
    it is scored but never drawn.  Repeated rows count each; a null id comes after the others of its
    score and has the noise of an empty id.  With an empty target the gains show what is rare among
    the documents.  Empty documents give an empty result.  Other columns are not looked at.
    """
    docs = chosen(docs, doc_id=(id_col, "bigint"), text=(text_col, "string"))
    gains = bucket_gains(docs, chosen(target, text=(target_col, "string")), n_buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for block in blocks(texts):
                words, slices = features(block)
                weight = np.zeros(block.n)
                for grams in slices:
                    table = GramTable(grams, n_buckets)
                    weight += np.bincount(grams.row, gains[table.bucket][table.slot], block.n)
                n = sum(np.maximum(words - k, 0) for k in range(LONGEST))
                yield pa.RecordBatch.from_arrays(
                    [ids[block.rows], pa.array(words), pa.array(n), pa.array(weight.astype(np.int64))],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    weighed = docs.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    scored = settled(weighed.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed)))
    fit = scored.where(F.col("n_words") >= least_words)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_words"), F.asc("weight")]
    ranked = first_ranks(fit, order, fit.count() * percent // 100)
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest)


def resampling_sql(
    least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, n_buckets: int = BUCKETS,
) -> str:
    """The same as one query over ``documents`` and ``benchmark``."""
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"coalesce(regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
    grams = "flatten(list_transform(range(1, 4), lambda k: list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i:i + k - 1], ' '))))"
    return f"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS steps
), docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, {words} AS w FROM documents
), of_docs AS (
  SELECT row_id, unnest({grams}) AS gram FROM docs
), of_target AS (
  SELECT unnest({grams}) AS gram FROM (SELECT {words} AS w FROM benchmark)
), doc_grams AS (
  SELECT gram, count(*) AS n FROM of_docs GROUP BY gram
), target_grams AS (
  SELECT gram, count(*) AS n FROM of_target GROUP BY gram
), spelled AS (
  SELECT gram, hex(encode(gram)) AS h FROM (SELECT gram FROM doc_grams UNION SELECT gram FROM target_grams)
), hashed AS (
  SELECT gram, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
                           lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % {n_buckets} AS bucket
  FROM spelled, crc_table
), s AS (
  SELECT bucket, sum(n) AS n FROM doc_grams JOIN hashed USING (gram) GROUP BY bucket
), t AS (
  SELECT bucket, sum(n) AS n FROM target_grams JOIN hashed USING (gram) GROUP BY bucket
), totals AS (
  SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + {n_buckets} AS of_docs, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + {n_buckets} AS of_target
), gains AS (
  SELECT s.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * of_docs) / ((s.n + 1)::DOUBLE * of_target)))::BIGINT AS gain
  FROM s LEFT JOIN t ON s.bucket = t.bucket, totals
), weights AS (
  SELECT row_id, sum(gain)::BIGINT AS weight
  FROM of_docs JOIN hashed USING (gram) JOIN gains USING (bucket) GROUP BY row_id
), scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, (greatest(len(w), 0) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0))::BIGINT AS n_features,
         coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (row_id)
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= {least_words} ORDER BY score DESC, doc_id NULLS LAST, n_words, weight) AS turn,
         count(*) FILTER (n_words >= {least_words}) OVER () AS fit
  FROM scored
)
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN n_words >= {least_words} AND turn <= {percent} * fit // 100 THEN turn END AS rank
FROM turns"""
