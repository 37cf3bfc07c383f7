"""Token ids packed into rows of one width by best-fit decreasing.

Documents are tokenized and get an end token.  One longer than a row is split without loss into
pieces of a row's width and a rest.  Pieces are then placed in order of falling length, each into
the row whose free space is the smallest that suffices.  That row is found in a segment tree
over free space: a leaf holds the rows with just that much left, an inner node whether
there is any below.

Every task packs what it reads, ``GROUP_TOKENS`` at a time, so nothing is shuffled and memory does not
grow with the input.  A row comes with its documents, cumulative segment lengths, and the
places where positions start again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchment.llm.common import blocks, chosen

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer cuts texts into words (fixed value, published with the vocabulary).
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
WIDTH = 2048
GROUP_TOKENS = 1 << 22
PADDING = 0

PACKED = (
    "pack_id bigint, n_tokens int, ids binary, doc_ids array<bigint>, piece_starts array<int>, "
    "cu_seqlens array<int>, resets array<int>"
)


class Capacities:
    """Segment tree over free space 0 to ``width``: finds the least that suffices."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def put(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        at = self.leaves + space
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least free space of at least ``need``, and that space."""
        at = self.leaves + need
        while not self.any[at]:
            while at & 1:  # a right child: the greater spaces are beside an ancestor
                at >>= 1
                if at <= 1:
                    return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        space = at - self.leaves
        row = self.rows[space].pop()
        if not self.rows[space]:
            self.any[at] = 0
            at >>= 1
            while at and not (self.any[2 * at] or self.any[2 * at + 1]):
                self.any[at] = 0
                at >>= 1
        return row, space


def best_fit(sizes: np.ndarray, width: int) -> list[list[int]]:
    """Rows of item numbers; items are placed longest first, equals in order."""
    tree, rows = Capacities(width), []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        found = tree.take(size)
        if found is None:
            found = len(rows), width
            rows.append([])
        row, space = found
        rows[row].append(item)
        if space > size:
            tree.put(space - size, row)
    return rows


@dataclass
class _Group:
    """Pieces waiting to be packed: tokens, document, and place in the document."""

    tokens: list[np.ndarray] = field(default_factory=list)
    doc: list[int | None] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    total: int = 0

    def add(self, doc: int | None, tokens: np.ndarray, width: int) -> None:
        for low in range(0, len(tokens), width):
            self.tokens.append(tokens[low:low + width])
            self.doc.append(doc)
            self.start.append(low)
        self.total += len(tokens)

    def packed(self, width: int, kind: np.dtype, first_id: int, most: int = 512) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(t) for t in self.tokens], np.int64)
        rows = best_fit(sizes, width)
        for low in range(0, len(rows), most):
            part = rows[low:low + most]
            ids = np.full((len(part), width), PADDING, kind)
            ends = [np.cumsum(sizes[row]) for row in part]
            for line, row, end in zip(ids, part, ends):
                line[:end[-1]] = np.concatenate([self.tokens[i] for i in row])
            cumulative = [np.concatenate([[0], end]) for end in ends]
            yield pa.RecordBatch.from_arrays([
                pa.array(range(first_id + low, first_id + low + len(part)), pa.int64()),
                pa.array([int(end[-1]) for end in ends], pa.int32()),
                pa.array([line.tobytes() for line in ids], pa.binary()),
                pa.array([[self.doc[i] for i in row] for row in part], pa.list_(pa.int64())),
                pa.array([[self.start[i] for i in row] for row in part], pa.list_(pa.int32())),
                pa.array([c.tolist() for c in cumulative], pa.list_(pa.int32())),
                pa.array([c[:-1].tolist() for c in cumulative], pa.list_(pa.int32())),
            ], names=["pack_id", "n_tokens", "ids", "doc_ids", "piece_starts", "cu_seqlens", "resets"])


def load_ranks(path: str = TOKENIZER) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _encoding(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("packing", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def pack_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end: int = END, width: int = WIDTH,
) -> DataFrame:
    """Rows of ``width`` token ids, little-endian (two bytes if ``end`` allows, else four), zero-padded.

    ``doc_ids`` and ``piece_starts`` (token offset in the document) name the segments in order, the
    first ``n_tokens`` ids are real, ``cu_seqlens`` has their cumulative lengths from 0, and
    ``resets`` the places where positions start at 0 again.  All pieces of a document, by
    offset, are its tokens and the end token.  A null or empty text has no tokens and no
    segment.  A null id stays null.  Repeated rows are packed each.  ``pack_id`` follows the
    partitions of the input.  Other columns are not looked at.
    """
    docs = chosen(docs, doc_id=(id_col, "bigint"), text=(text_col, "string"))
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(tokenizer))
    kind = np.dtype("<u2") if end < 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks.value)
        next_id = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        group = _Group()
        for batch in batches:
            ids, texts = batch.columns
            for block in blocks(texts):
                for doc, text in zip(ids[block.rows].to_pylist(), texts[block.rows].to_pylist()):
                    if not text:
                        continue
                    tokens = np.array(encoding.encode_ordinary(text) + [end], kind)
                    group.add(doc, tokens, width)
                    if group.total >= GROUP_TOKENS:
                        for out in group.packed(width, kind, next_id):
                            next_id += out.num_rows
                            yield out
                        group = _Group()
        yield from group.packed(width, kind, next_id)

    return docs.mapInArrow(run, PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet; a lost task is written again under Spark's commit protocol."""
    packed.write.parquet(path)


def position_ids(cu_seqlens: list[int], width: int) -> np.ndarray:
    """Position of every id in its segment; 0 in the padding."""
    positions = np.zeros(width, np.int64)
    for low, high in zip(cu_seqlens, cu_seqlens[1:]):
        positions[low:high] = np.arange(high - low)
    return positions


def unpack(packed: DataFrame, two_bytes: bool = True) -> DataFrame:
    """``doc_id``, ``piece_start`` and ``ids`` of every segment."""
    kind = np.dtype("<u2") if two_bytes else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, ids = [], [], []
            for row in batch.to_pylist():
                line = np.frombuffer(row["ids"], kind)
                for d, s, low, high in zip(row["doc_ids"], row["piece_starts"], row["cu_seqlens"], row["cu_seqlens"][1:]):
                    doc.append(d)
                    start.append(s)
                    ids.append(line[low:high].tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(ids, pa.list_(pa.int32()))],
                names=["doc_id", "piece_start", "ids"],
            )

    return packed.select(F.col("ids"), "doc_ids", "piece_starts", "cu_seqlens").mapInArrow(
        run, "doc_id bigint, piece_start int, ids array<int>"
    )
