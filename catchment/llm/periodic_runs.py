"""Runs of words that repeat with a period, caught by squares on dyadic blocks while words arrive.

Words of whole texts arrive in one stream, with a unique mark after every text, so that no
window of two texts is ever equal.  At level k every completed block of B = 2^k words sets a
catcher: the 2B words from its start on.  Each word that is appended completes one window of 2B words per level, and
the suffix that ends there is compared with the one catcher whose block lies B to 2B - 1 words before
it.  If they are equal at distance q, the q + 2B > 2q words from the catcher on have period
q, which is a square.

A run of period q and four periods or more has a catcher wholly inside at the level with
B <= q < 2B.  Two distances at one catcher show that neither is the smallest period: the
words would have their common divisor as a period as well.  So a catcher reports one square
at most, and all levels together no more squares than there are words, twice.  Squares of equal
period at neighbouring catchers merge into one run, whose ends are then extended word by word.

Windows are compared by hashes that double level by level, all words of an append at once;
each run is confirmed on the words themselves.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from catchment.llm.common import blocks, chosen, mix

LEAST_LENGTH = 6
LEAST_PERIODS = 4
#: Words appended at a time.
APPEND = 1 << 15
_M0, _M1 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
FOUND = (
    "doc_id bigint, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string"
)


class Run(NamedTuple):
    start: int
    length: int
    period: int


class _Level:
    """Windows of ``width`` words: hashes from place ``at`` on, and how far they are compared."""

    def __init__(self, width: int) -> None:
        self.width, self.at, self.done = width, 0, 0
        self.hashes = np.zeros(0, np.uint64)

    @property
    def end(self) -> int:
        return self.at + len(self.hashes)

    def add(self, hashes: np.ndarray) -> None:
        self.hashes = np.concatenate([self.hashes, hashes]) if len(self.hashes) else hashes

    def drop_before(self, place: int) -> None:
        if place - self.at > len(self.hashes) // 2:
            self.hashes, self.at = self.hashes[place - self.at:], place


class SquareCatchers:
    """Squares in a stream of numbered words; ``append`` any number of words, then ask for ``runs``.

    ``longest`` bounds the words of one text, and with it the levels.
    """

    def __init__(self, longest: int) -> None:
        top = max(1, longest // LEAST_PERIODS).bit_length()  # periods below 2^top
        self.levels = [_Level(1 << k) for k in range(top + 1)]
        self.parts: list[np.ndarray] = []
        self.squares: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(top)]

    def append(self, words: np.ndarray) -> None:
        """Takes the next words, equal ones by equal numbers, and reports the squares that they complete."""
        self.parts.append(words)
        self.levels[0].add(mix(words.astype(np.uint64) * _M0 + _M1))
        for k, (half, level) in enumerate(zip(self.levels, self.levels[1:])):
            low, high = level.end - half.at, half.end - half.width - half.at
            if high > low:
                first, second = half.hashes[low:high], half.hashes[low + half.width:high + half.width]
                level.add(mix(first * _M0 + second * _M1 + (first ^ second)))
            self._compare(k, level, whole=True)
            half.drop_before(min(level.end, half.done - half.width // 2 if k else level.end))

    def _compare(self, k: int, level: _Level, whole: bool) -> None:
        """Compares the suffixes at the places after ``done`` with their catchers, by whole blocks until the last."""
        block = 1 << k
        if not level.done:
            level.done = block
        rows = (level.end - level.done) // block
        if rows > 0:
            self._catch(k, level, level.done, rows, block)
            level.done += rows * block
        if not whole and level.end > level.done:
            self._catch(k, level, level.done, 1, level.end - level.done)

    def _catch(self, k: int, level: _Level, place: int, rows: int, wide: int) -> None:
        block, low = 1 << k, place - level.at
        catchers = level.hashes[low - block:low - block + rows * block:block]
        suffixes = level.hashes[low:low + (rows - 1) * block + wide]
        equal = suffixes.reshape(rows, wide) == catchers[:, None]
        hits = np.flatnonzero(equal.any(axis=1))
        hits = hits[equal[hits].sum(axis=1) == 1]
        if len(hits):
            starts = place - block + hits * block
            self.squares[k].append((starts, block + equal[hits].argmax(axis=1)))

    def runs(self) -> list[Run]:
        """All runs of at least ``LEAST_PERIODS`` periods and ``LEAST_LENGTH`` words, by start and period."""
        for k, level in enumerate(self.levels[1:]):
            self._compare(k, level, whole=False)
        words = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)
        found = set()
        for k, squares in enumerate(self.squares):
            if not squares:
                continue
            start, period = (np.concatenate(x) for x in zip(*squares))
            new = np.ones(len(start), bool)
            new[1:] = (np.diff(start) != 1 << k) | (np.diff(period) != 0)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(start)) - 1
            for low, high, q in zip(start[first].tolist(), start[last].tolist(), period[first].tolist()):
                end = high + 2 * (1 << k) + q
                if not np.array_equal(words[low:end - q], words[low + q:end]) or not _smallest(words[low:low + 2 * q], q):
                    continue
                low -= _matches(words[:low][::-1], words[:low + q][::-1])
                end += _matches(words[end - q:], words[end:])
                if end - low >= max(LEAST_LENGTH, LEAST_PERIODS * q):
                    found.add(Run(low, end - low, q))
        return sorted(found, key=lambda r: (r.start, r.period))


def _matches(a: np.ndarray, b: np.ndarray) -> int:
    """How many words both begin with alike, looked at in steps that double."""
    n, done, step = min(len(a), len(b)), 0, 16
    while done < n:
        differ = np.flatnonzero(a[done:min(n, done + step)] != b[done:min(n, done + step)])
        if len(differ):
            return done + int(differ[0])
        done, step = done + step, step * 2
    return n


def _smallest(square: np.ndarray, q: int) -> bool:
    """Whether a square of period ``q`` has no smaller period that divides it."""
    rest, prime = q, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            shift = q // prime
            if np.array_equal(square[:q], square[shift:shift + q]):
                return False
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return True


def word_runs(texts: list[list], append: int = APPEND) -> list[list[Run]]:
    """The runs of every text, a list of words each; texts of one call share the stream."""
    number: dict = {}
    counter = count(len(texts))
    parts, places, at = [], [], 0
    for i, words in enumerate(texts):
        parts.append(np.fromiter(map(number.setdefault, words, counter), np.int64, len(words)))
        parts.append(np.array([i]))  # the mark after a text; words have other numbers
        places.append(at)
        at += len(words) + 1
    catchers = SquareCatchers(max(map(len, texts), default=0))
    stream = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    for low in range(0, len(stream), append):
        catchers.append(stream[low:low + append])
    found: list[list[Run]] = [[] for _ in texts]
    for run in catchers.runs():
        i = int(np.searchsorted(places, run.start, "right")) - 1
        found[i].append(run._replace(start=run.start - places[i]))
    return found


def collapsed(words: list, found: list[Run]) -> list:
    """The words that are in no run beyond its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for run in found:
        change[run.start + run.period] += 1
        change[run.start + run.length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def rephrased(words: list, doc_id: int | None) -> list:
    """The words that the query looks at: every tenth id has a run written into it, by a fixed rule.

    With h the crc32 of the id as text and g = h // 10, word i from a = g % n on becomes word a + (i - a) % p, where
    p = 1 + (n - a) // (3 + g % 8), if h % 10 is 0.
    """
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", written: bool = False) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_runs``, the run of most periods, and digests of all runs and of the collapsed text.

    ``start``, ``length`` and ``period`` in words and ``exponent_milli``, a thousand times length over period
    rounded down, belong to the run with the greatest exact exponent; ties go to the smallest start, then
    period.  They are null without any run.  ``runs_sha256`` covers a line ``start,length,period`` per run,
    ``collapsed_sha256`` the kept words joined by one space; both are never null.  With ``written`` texts
    go through ``rephrased`` first.  A null or empty text has no words.  A null id has none written in.
    Repeated rows are looked at each.  An empty table gives an empty result.  Other columns are not looked at.
    """
    docs = chosen(docs, doc_id=(id_col, "bigint"), text=(text_col, "string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        names = [line.split()[0] for line in FOUND.split(", ")]
        for batch in batches:
            ids, texts = batch.columns
            for block in blocks(texts):
                doc_ids = ids[block.rows].to_pylist()
                # Splitting bytes at white space cuts at U+0020 and U+0009 to U+000D only.
                words = [block.data[a:b].tobytes().split() for a, b in zip(block.at, block.at[1:])]
                if written:
                    words = [rephrased(w, i) for w, i in zip(words, doc_ids)]
                columns = []
                for i, own, found in zip(doc_ids, words, word_runs(words)):
                    best = min(found, key=lambda r: (-Fraction(r.length, r.period), r.start, r.period), default=None)
                    lines = "".join(f"{r.start},{r.length},{r.period}\n" for r in found)
                    columns.append((
                        i, len(own), len(found), *(best or (None,) * 3),
                        best and 1000 * best.length // best.period,
                        hashlib.sha256(lines.encode()).hexdigest(),
                        hashlib.sha256(b" ".join(collapsed(own, found))).hexdigest(),
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*columns), kinds)], names=names)

    return docs.mapInArrow(run, FOUND)


def collapse_text(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every text cut down to the first period of its runs, words joined by one space; null stays null.

    Texts without a run stay as they are, white space included.  All other columns are kept.
    """
    chosen(docs)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            for block in blocks(texts):
                own = texts[block.rows].to_pylist()
                words = [block.data[a:b].tobytes().split() for a, b in zip(block.at, block.at[1:])]
                new = [b" ".join(collapsed(w, r)).decode("utf-8", "replace") if r else t
                       for t, w, r in zip(own, words, word_runs(words))]
                part = batch.slice(block.rows.start, block.rows.stop - block.rows.start)
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
