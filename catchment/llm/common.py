"""What several operators share: settled frames and texts as byte arrays.

Texts reach Python as Arrow batches.  They are worked on as one array of UTF-8
bytes per block of rows, so that a block costs a few array passes and no object
per word.  A block holds whole texts of about ``BLOCK_BYTES`` together.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchment.session import ensure_checkpoint_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BLOCK_BYTES = 1 << 20
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: The separators of words: space and U+0009 to U+000D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: ASCII capitals to small letters, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ROLL = 0x9E3779B97F4A7C15 | 1


def chosen(df: DataFrame, **columns: tuple[str, str]) -> DataFrame:
    """Only the named columns, cast: ``doc_id=("id", "bigint")`` takes column id.

    Also lets Python workers of the same machine or image import this package (elsewhere it is
    shipped with ``--py-files``), and sets Arrow batches of the session to ``BATCH_ROWS`` rows at
    most, as a row is a whole text.
    """
    settings = df.sparkSession.conf
    if not 0 < int(settings.get(_BATCH)) <= BATCH_ROWS:
        settings.set(_BATCH, BATCH_ROWS)
    environment = df.sparkSession.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return df.select(*[F.col(f"`{old}`").cast(kind).alias(new) for new, (old, kind) in columns.items()])


def settled(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, with the lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


MOST_IDS = 1_000_000


def with_ids(df: DataFrame, ids: DataFrame, how: str = "left_semi", column: str = "doc_id", most: int = MOST_IDS) -> DataFrame:
    """Rows of ``df`` whose id is among the settled ``ids`` (or with ``left_anti`` is not).

    Up to ``most`` ids, counted first, are broadcast, so that whole texts need no shuffle; more are
    joined by shuffle.
    """
    few = ids.limit(most + 1).count() <= most
    return df.join(F.broadcast(ids) if few else ids, column, how)


HOT_SHARE = 1000


def with_key(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """Rows joined with a table of one line per ``key``, of which ``n`` rows have it; how is inner or left.

    A key with more than a thousandth of all these rows (``total``, summed if not given) is hot.  There can't be a thousand
    of them, so they are broadcast; no other key fills a task.  A key is a number or a text.
    """
    if total is None:
        total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    hot = F.col("n") * HOT_SHARE > total
    values = [c for c in table.columns if c not in (key, "n")]
    few = table.where(hot).select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in values])
    many = table.where(~hot).select(F.col(key).alias("_cold"), F.lit(False).alias("_found"), *[F.col(c).alias(f"_cold_{c}") for c in values])
    # Rows of hot keys have nothing more to look for; they are spread by a hash of the row, and the mark keeps them apart.
    joined = rows.join(F.broadcast(few), F.col(key) == F.col("_hot"), "left").withColumns({
        "_found_hot": F.col("_hot").isNotNull(),
        "_seek": F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns).cast(rows.schema[key].dataType)),
    })
    both = joined.join(many, (F.col("_seek") == F.col("_cold")) & (F.col("_found_hot") == F.col("_found")), "left")
    if how == "inner":
        both = both.where("_found_hot OR _cold IS NOT NULL")
    return both.select(*rows.columns, *[F.when(F.col("_found_hot"), F.col(f"_hot_{c}")).otherwise(F.col(f"_cold_{c}")).alias(c) for c in values])


def in_order(rows: DataFrame, order: list[Column], *amounts: str) -> tuple[DataFrame, dict[str, int]]:
    """``rows`` with their ``place`` (1, 2, 3 ...) in a total order, and per amount the sum ``before_`` them; also all sums.

    Rows are sorted in ranges, which are written once; the figures of earlier ranges come from one line per range
    on the driver.  No task holds more than a range.
    """
    sorted_rows = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_at", F.monotonically_increasing_id())
    placed = sorted_rows.withColumn("_range", F.shiftright("_at", 33))
    sums = [F.count("*").alias("place"), *[F.coalesce(F.sum(a), F.lit(0)).cast("bigint").alias(a) for a in amounts]]
    names, totals, lines = ["place", *amounts], dict.fromkeys(["place", *amounts], 0), []
    for r in sorted(placed.groupBy("_range").agg(*sums).collect(), key=lambda r: r["_range"]):
        lines.append((r["_range"], *totals.values()))
        totals = {name: totals[name] + r[name] for name in names}
    before = rows.sparkSession.createDataFrame(lines, "_range bigint, " + ", ".join(f"_{n} bigint" for n in names))
    earlier = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(F.broadcast(before), "_range").select(
        *rows.columns, (F.col("_place") + F.row_number().over(Window.partitionBy("_range").orderBy("_at"))).alias("place"),
        *[(F.col(f"_{a}") + F.coalesce(F.sum(a).over(earlier), F.lit(0))).cast("bigint").alias(f"before_{a}") for a in amounts],
    ), totals


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = np.random.default_rng(20250101).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER_CODES = _BYTE_CODES[LOWER]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling base and of its inverse modulo 2^64, at least ``n``."""
    if len(_powers[0]) < n:
        inverse = pow(ROLL, -1, 1 << 64)
        for k, base in enumerate((ROLL, inverse)):
            steps = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


@dataclass
class Block:
    """Whole texts of neighbouring rows: bytes, and where each row begins and ends."""

    rows: slice
    data: np.ndarray
    at: np.ndarray

    @property
    def n(self) -> int:
        return len(self.at) - 1

    def text(self, i: int) -> str:
        return self.data[self.at[i]:self.at[i + 1]].tobytes().decode("utf-8", "replace")


def release() -> None:
    """Gives freed memory back to the system, as a worker lives on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim is not None:
        trim(0)


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a string column into blocks; a null text counts as empty."""
    release()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        yield Block(slice(low, high), data[at[low]:at[high]], at[low:high + 1] - at[low])
        low = high


@dataclass
class Spans:
    """Byte ranges inside a block, with the row each belongs to."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    def counts(self, n: int) -> np.ndarray:
        return np.bincount(self.row, minlength=n)


def runs(inside: np.ndarray, at: np.ndarray) -> Spans:
    """Maximal runs of marked bytes that do not cross a row."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return Spans(none, none, none)
    edge = np.zeros(len(inside) + 1, bool)
    edge[at] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return Spans(starts, np.flatnonzero(end) + 1, np.searchsorted(at, starts, "right") - 1)


def words(block: Block) -> Spans:
    return runs(~WHITE[block.data], block.at)


def span_hashes(block: Block, spans: Spans, lower: bool = False) -> np.ndarray:
    """64-bit hash of the bytes of each span, whatever its place."""
    forth, back = powers(len(block.data) + 1)
    total = np.zeros(len(block.data) + 1, np.uint64)
    codes = (_LOWER_CODES if lower else _BYTE_CODES)[block.data]
    np.cumsum(codes * forth[:len(codes)], out=total[1:])
    body = (total[spans.end] - total[spans.start]) * back[spans.start]
    return mix(body + (spans.end - spans.start).astype(np.uint64))


_PLACES = np.random.default_rng(20250102).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` neighbouring hashes; the caller drops those across rows."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += mix(hashes[k:k + n] + _PLACES[k]) * _PLACES[k]
    return mix(total)


def shingles(block: Block, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of lower-cased words: hash, row and place of the first word.

    A text with fewer words has its whole sequence as its one shingle; a text
    without words has none.
    """
    spans = words(block)
    hashes = span_hashes(block, spans, lower=True)
    count = spans.counts(block.n)
    first = np.zeros(block.n + 1, np.int64)
    np.cumsum(count, out=first[1:])
    place = np.arange(len(hashes)) - first[spans.row]
    whole = window_hashes(hashes, width)
    fits = np.flatnonzero((place + width <= count[spans.row])[:len(whole)])
    short = np.flatnonzero((count > 0) & (count < width))
    few = np.zeros(len(short), np.uint64)
    for k in range(width - 1):
        has = count[short] > k
        few[has] += mix(hashes[first[short[has]] + k] + _PLACES[8 + k]) * _PLACES[8 + k]
    few = mix(few + count[short].astype(np.uint64))
    row = np.concatenate([spans.row[fits], short])
    order = np.argsort(row, kind="stable")
    value = np.concatenate([whole[fits], few])[order]
    return value, row[order], np.concatenate([place[fits], np.zeros(len(short), np.int64)])[order]


def distinct_in_rows(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, in order of row and value."""
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], row[new]
