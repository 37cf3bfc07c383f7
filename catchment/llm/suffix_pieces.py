"""SentencePiece encoding and decoding by matching pieces in a suffix array.

The different words of a batch are concatenated and indexed: a suffix array sorted as
far as the longest piece.  Every piece is binary-searched for the range of its occurrences,
all pieces at once.  Each occurrence is an edge from one text position to
another.  Edges are sorted by the position where they end and relaxed in that order, for
all words in step.

The models here are byte-pair models, whose encoding is not the path of best score but the
one that merging in order of score ends at.  A prefix that ends at a token boundary
has the same merges as the whole, so every position has at most one last token.  An
edge holds if its token and the last token before it would not have
merged across their border.  That is read off the spines of their merge trees:
going back in time, no two pieces that ever met at the border form a piece whose
merge came earlier than the merges that ended them (the left one first among equals).

Bytes of letters that the model doesn't know become its byte pieces.  The blank is U+2581 in
the model and byte 0x20 here.  Runs of blanks that no word takes up are merged last; their
encoding depends on their length only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from catchment.llm.common import Block, Spans, blocks, chosen, release, runs, span_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
INDEX_BYTES = 1 << 18  # of different words in one suffix array
GROUP = 4  # blocks whose new words are indexed together
MOST_WORDS = 150_000  # remembered by a task
CHUNK = 7  # letters of 9 bits in one sort key
NONE, START = -2, -1


@dataclass
class PieceModel:
    """A byte-pair model: pieces as bytes, scores, and the ids of single bytes."""

    pieces: list[bytes]
    normal: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray

    @classmethod
    def load(cls, path: str = MODEL) -> PieceModel:
        import sentencepiece

        read = sentencepiece.SentencePieceProcessor(model_file=path)
        n = read.get_piece_size()
        names = [read.id_to_piece(i) for i in range(n)]
        single = np.full(256, -1, np.int32)
        pieces, normal = [], np.ones(n, bool)
        for i, name in enumerate(names):
            if read.is_byte(i):
                single[int(name[1:-1], 16)] = i
                pieces.append(bytes([int(name[1:-1], 16)]))
                normal[i] = False
            elif read.is_control(i) or read.is_unknown(i) or read.is_unused(i):
                pieces.append(b"")
                normal[i] = False
            else:
                pieces.append(name.replace(BLANK, " ").encode())
        if (single < 0).any():
            raise ValueError("the model has no byte pieces, so it cannot encode every text")
        return cls(pieces, normal, np.array([read.get_score(i) for i in range(n)]), single)


def merged(symbols: list[bytes], rank: dict[bytes, float]) -> list[tuple[bytes, bytes | None, bytes | None]]:
    """Merges neighbours in order of rank, the leftmost first; each result with its last two halves."""
    line: list[tuple[bytes, bytes | None, bytes | None]] = [(s, None, None) for s in symbols]
    while True:
        ranked = [(rank[a[0] + b[0]], k) for k, (a, b) in enumerate(zip(line, line[1:])) if a[0] + b[0] in rank]
        if not ranked:
            return line
        k = min(ranked)[1]
        a, b = line[k][0], line[k + 1][0]
        line[k:k + 2] = [(a + b, a, b)]


class PieceTrees:
    """How each piece is merged from two halves, and which halves merge."""

    def __init__(self, model: PieceModel):
        self.model = model
        n = len(model.pieces)
        ids = {model.pieces[i]: i for i in np.flatnonzero(model.normal).tolist()}
        self.blanks = {p: i for p, i in ids.items() if not p.strip(b" ")}
        self.blank = ids[b" "]
        self.blank_rank = {p: -float(model.scores[i]) for p, i in self.blanks.items()}
        words = {p: i for p, i in ids.items() if p.strip(b" ") or p == b" "}
        if any(b" " in p[1:] for p in words) or any(b"\n" in p for p in ids):
            raise ValueError("pieces with a blank inside or with a line feed are not supported")
        by_score = {p: -float(model.scores[i]) for p, i in words.items() if len(p.decode()) > 1}
        place = {s: k for k, s in enumerate(sorted(set(by_score.values())))}
        if len(place) != len(by_score):
            raise ValueError("pieces of equal score are not supported")
        rank = {p: place[s] for p, s in by_score.items()}
        self.rank = np.full(n, -1, np.int64)
        self.left = np.full(n, -1, np.int64)
        self.right = np.full(n, -1, np.int64)
        for p, r in rank.items():
            tree = merged([c.encode() for c in p.decode()], rank)
            if len(tree) != 1:
                continue  # never the outcome of merging
            _, a, b = tree[0]
            i = words[p]
            self.rank[i], self.left[i], self.right[i] = r, words[a], words[b]
            if max(rank.get(a, -1), rank.get(b, -1)) >= r:
                raise ValueError("a piece scored before its halves is not supported")
        whole = np.array([i for p, i in words.items() if self.left[i] >= 0 or len(p.decode()) == 1], np.int64)
        code = self.left[whole] * n + self.right[whole]
        code[self.left[whole] < 0] = -1
        order = np.argsort(code)
        self.pair, self.pair_rank = code[order], self.rank[whole][order]
        self.ids = whole
        self.length = np.array([len(p) for p in model.pieces], np.int64)
        self.keys = chunk_keys([model.pieces[i] for i in whole.tolist()])

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether neighbours a and b keep their border while texts merge."""
        n = len(self.rank)
        codes, back = np.unique(a.astype(np.int64) * n + b, return_inverse=True)
        x, y = codes // n, codes % n
        end_x, end_y = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), np.iinfo(np.int64).max)
        fine = np.ones(len(codes), bool)
        live = np.arange(len(codes))
        while len(live):
            code = x * n + y
            at = np.minimum(np.searchsorted(self.pair, code), len(self.pair) - 1)
            rank = np.where(self.pair[at] == code, self.pair_rank[at], -1)
            broken = (rank >= 0) & (rank < end_x) & (rank <= end_y)
            fine[live[broken]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            go = ~broken & ((rank_x >= 0) | (rank_y >= 0))
            undo_x = rank_x > rank_y
            end_x, end_y = np.where(undo_x, rank_x, end_x)[go], np.where(undo_x, end_y, rank_y)[go]
            x, y = np.where(undo_x, self.right[x], x)[go], np.where(undo_x, y, self.left[y])[go]
            live = live[go]
        return fine[back]

    def blank_run(self, n: int) -> list[int]:
        """Ids of a run of blanks; long runs repeat the longest piece."""
        most = max(map(len, self.blanks))
        many = max(0, n // most - 1)
        tail = [self.blanks[p] for p, _, _ in merged([b" "] * (n - many * most), self.blank_rank)]
        return [self.blanks[b" " * most]] * many + tail


def chunk_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest sort keys of all strings that begin with each text."""
    levels = max(-(-len(t) // CHUNK) for t in texts)
    low = np.zeros((len(texts), levels * CHUNK), np.int64)
    high = np.full_like(low, 511)
    for k, t in enumerate(texts):
        low[k, :len(t)] = high[k, :len(t)] = np.frombuffer(t, np.uint8).astype(np.int64) + 1
    pack = lambda x: sum(x.reshape(len(x), levels, CHUNK)[:, :, j] << (9 * (CHUNK - 1 - j)) for j in range(CHUNK))
    return pack(low), pack(high)


class SuffixArray:
    """Suffixes of words, each up to its end, sorted by their first letters."""

    def __init__(self, words: list[bytes], levels: int):
        data = np.frombuffer(b"\0".join(words) + b"\0" * (CHUNK + 1), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(size + 1) - size - 1
        self.end = self.start + size
        word = np.repeat(np.arange(len(words)), size)
        self.text = data
        at = np.arange(size.sum()) + word  # one separator after each word
        rest = self.end[word] - at
        key = np.zeros(len(at), np.int64)
        for j in range(CHUNK):
            letter = np.where(rest > j, data[at + j].astype(np.int64) + 1, 0)
            key |= letter << (9 * (CHUNK - 1 - j))
        self.of = np.zeros(len(data) + levels * CHUNK, np.int64)
        self.of[at] = key
        self.at, self.word, self.rest, self.levels = at, word, rest, levels
        order = np.argsort(key)
        group = np.cumsum(np.diff(key[order], prepend=-1) != 0)
        for level in range(1, levels):
            # Only suffixes that are equal so far and go on are sorted further, by their next letters.
            alike = np.bincount(group)[group] > 1
            part = np.flatnonzero(alike & (rest[order] >= level * CHUNK))
            if not len(part):
                break
            further = self._key(order[part], level)
            inner = np.lexsort((further, group[part]))
            order[part] = order[part][inner]
            new = np.zeros(len(order), bool)
            new[1:] = group[1:] != group[:-1]
            # Parts of a group are neighbours, since a group's members agree on how they go on so far.
            new[part[1:]] |= further[inner][1:] != further[inner][:-1]
            group = np.cumsum(new)
        self.order = order

    def _key(self, suffix: np.ndarray, level: int) -> np.ndarray:
        return np.where(self.rest[suffix] > level * CHUNK, self.of[self.at[suffix] + level * CHUNK], 0)

    def bound(self, wanted: np.ndarray, after: bool) -> np.ndarray:
        """For each key the first suffix not before it (or, with ``after``, beyond it)."""
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(self.order), np.int64)
        for _ in range(len(self.order).bit_length()):
            open_ = low < high
            middle = np.minimum((low + high) // 2, len(self.order) - 1)
            suffix = self.order[middle]
            less, equal = np.zeros(len(wanted), bool), np.arange(len(wanted))
            for level in range(self.levels):
                have, want = self._key(suffix[equal], level), wanted[equal, level]
                less[equal[have < want]] = True
                equal = equal[have == want]
                if not len(equal):
                    break
            if after:
                less[equal] = True
            low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
        return low

    def ranges(self, keys: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return self.bound(keys[0], False), self.bound(keys[1], True)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges [start, start + size), one after the other."""
    end = np.cumsum(size, dtype=size.dtype)
    place = np.repeat(start - (end - size), size)
    place += np.arange(end[-1] if len(end) else 0, dtype=place.dtype)
    return place


def encode_words(trees: PieceTrees, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and their number for each word; a word may begin with a blank and holds no other."""
    index = SuffixArray(words, trees.keys[0].shape[1])
    low, high = index.ranges(trees.keys)
    count = high - low
    # There are several edges per letter, so they are kept in four bytes.
    piece = np.repeat(trees.ids.astype(np.int32), count)
    begin = index.order[spread(low.astype(np.int32), count.astype(np.int32))].astype(np.int32)
    word, begin = index.word[begin].astype(np.int32), index.at[begin].astype(np.int32)
    size = trees.length[piece].astype(np.int32)

    # A letter that is no piece is an edge of its own, to be written as bytes.
    first = (index.text & 0xC0) != 0x80
    letter = index.at[first[index.at]]
    width = np.select([index.text[letter] < 0x80, index.text[letter] < 0xE0, index.text[letter] < 0xF0], [1, 2, 3], 4)
    is_piece = np.zeros(len(index.text), np.int64)
    # Pieces that nothing merges into are single letters, so at most one begins at a place.
    single = np.flatnonzero(trees.rank[piece] < 0)
    is_piece[begin[single]] = size[single]
    strange = is_piece[letter] < width
    unknown = len(trees.rank)
    word_of = np.zeros(len(index.text), np.int64)
    word_of[index.at] = index.word
    begin = np.concatenate([begin, letter[strange].astype(np.int32)])
    piece = np.concatenate([piece, np.full(int(strange.sum()), unknown, np.int32)])
    word = np.concatenate([word, word_of[letter[strange]].astype(np.int32)])
    end = begin + np.concatenate([size, width[strange].astype(np.int32)])

    offset = (end - index.start[word]).astype(np.int32)
    del word, size, low, high, count
    # Small numbers sort by radix.
    order = np.argsort(offset.astype(np.uint16) if offset.max() < 1 << 16 else offset, kind="stable")
    begin, piece, end, offset = begin[order], piece[order], end[order], offset[order]
    last, came = np.full(len(index.text) + 1, NONE, np.int64), np.zeros(len(index.text) + 1, np.int64)
    last[index.start] = START
    cut = np.concatenate([np.flatnonzero(np.diff(offset, prepend=-1)), [len(offset)]])
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
        before = last[begin[i:j]]
        keep = np.flatnonzero(before != NONE)
        now = piece[i:j][keep]
        before = before[keep]
        check = (before >= 0) & (before < unknown) & (now < unknown)
        good = np.ones(len(keep), bool)
        good[check] = trees.apart(before[check], now[check])
        keep = i + keep[good]
        last[end[keep]], came[end[keep]] = piece[keep], begin[keep]

    found_word, found_id, found_at = [], [], []
    at, live = index.end.copy(), np.arange(len(words))
    while len(live):
        live = live[at[live] > index.start[live]]
        here = at[live]
        found_word.append(live)
        found_id.append(last[here])
        found_at.append(came[here])
        at[live] = came[here]
    word, ids, start = (np.concatenate(x) for x in (found_word, found_id, found_at))
    width = np.where(ids == unknown, 0, 1)
    odd = np.flatnonzero(ids == unknown)
    first_byte = index.text[start[odd]]
    width[odd] = np.select([first_byte < 0x80, first_byte < 0xE0, first_byte < 0xF0], [1, 2, 3], 4)
    flat = np.repeat(ids, width)
    byte_at = np.repeat(start, width) + spread(np.zeros(len(width), np.int64), width)
    flat = np.where(flat == unknown, trees.model.byte_ids[index.text[byte_at]], flat)
    order = np.argsort(byte_at, kind="stable")
    return flat[order].astype(np.int32), np.bincount(word, width, len(words)).astype(np.int64)


class Encoder:
    """Encodes blocks of texts; remembers the words it has met."""

    def __init__(self, trees: PieceTrees):
        self.trees = trees
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def units(self, block: Block) -> tuple[Block, Spans, np.ndarray, np.ndarray]:
        """The block with a blank before each text; its units and which of them are runs of blanks.

        Units are line feeds, words with the blank before them, and the other blanks of a run.
        """
        filled = np.flatnonzero(np.diff(block.at) > 0)
        data = np.insert(block.data, block.at[filled], 0x20)
        shift = np.zeros(block.n + 1, np.int64)
        shift[filled + 1] = 1
        block = Block(block.rows, data, block.at + np.cumsum(shift))
        blank, feed = data == 0x20, data == 0x0A
        word = runs(~(blank | feed), block.at)
        after_blank = blank[word.start - 1]
        word = Spans(word.start - after_blank, word.end, word.row)
        free = runs(blank, block.at)
        taken = np.zeros(len(data) + 1, bool)
        taken[word.start[after_blank]] = True
        free = Spans(free.start, free.end - taken[free.end - 1], free.row)
        has = free.end > free.start
        feeds = np.flatnonzero(feed)
        start = np.concatenate([word.start, free.start[has], feeds])
        end = np.concatenate([word.end, free.end[has], feeds + 1])
        order = np.argsort(start, kind="stable")
        is_run = np.concatenate([np.zeros(len(word.start), bool), np.ones(int(has.sum()), bool), np.zeros(len(feeds), bool)])[order]
        start, end = start[order], end[order]
        return block, Spans(start, end, np.searchsorted(block.at, start, "right") - 1), is_run, after_blank

    def encode(self, group: list[Block]) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
        """Each block with all its ids and the number of ids of each row."""
        if len(self.known) > MOST_WORDS:
            self._forget()
        work, new = [], {}
        for block in group:
            padded, spans, is_run, _ = self.units(block)
            _, first, back = np.unique(span_hashes(padded, spans), return_index=True, return_inverse=True)
            names = [padded.data[a:b].tobytes() for a, b in zip(spans.start[first].tolist(), spans.end[first].tolist())]
            for name in names:
                if name not in self.known:
                    new[name] = None
            work.append((block, spans, is_run, back, names))
        self._learn(list(new))
        for block, spans, is_run, back, names in work:
            yield block, *self._emit(block.n, spans, is_run, back, names)

    def _learn(self, names: list[bytes]) -> None:
        words, odd = [], []
        for name in names:
            (odd if name == b"\n" or name.isspace() and not name.strip(b" ") else words).append(name)
        for name in odd:
            ids = self.trees.model.byte_ids[[10]] if name == b"\n" else np.array(self.trees.blank_run(len(name)), np.int32)
            self._keep([name], ids, np.array([len(ids)]))
        words.sort(key=len)  # words of like length relax in step
        low, total = 0, 0
        for high, word in enumerate(words, 1):
            total += len(word) + 1
            if total > INDEX_BYTES or high == len(words):
                self._keep(words[low:high], *encode_words(self.trees, words[low:high]))
                low, total = high, 0

    def _keep(self, names: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        self.known.update(zip(names, range(len(self.size), len(self.size) + len(names))))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, ids])

    def _emit(self, n: int, spans: Spans, is_run: np.ndarray, back: np.ndarray, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not len(spans.start):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        known = np.fromiter((self.known[name] for name in names), np.int64, len(names))
        slot = known[back]
        first, size = self.first[slot], self.size[slot]
        # A word whose blank stays alone gives it back to the run before it.
        bare = (self.flat[first] == self.trees.blank) & (size > 1) & ~is_run
        gives = np.flatnonzero(bare[1:] & is_run[:-1] & (spans.row[:-1] == spans.row[1:])) + 1
        flat = self.flat
        if len(gives):
            first[gives] += 1
            size[gives] -= 1
            lengths, which = np.unique(spans.end[gives - 1] - spans.start[gives - 1] + 1, return_inverse=True)
            longer = [np.array(self.trees.blank_run(int(k)), np.int32) for k in lengths]
            width = np.array([len(x) for x in longer])
            first[gives - 1] = (len(flat) + np.cumsum(width) - width)[which]
            size[gives - 1] = width[which]
            flat = np.concatenate([flat, *longer])
        return flat[spread(first, size)], np.bincount(spans.row, size, n).astype(np.int64)


def decode_ids(pieces: list[bytes], ids: list[int] | np.ndarray) -> str:
    """The text of a sequence of ids; the blank put before it when encoding is dropped."""
    data = b"".join([pieces[i] for i in ids])
    return data[1:].decode("utf-8", "replace") if data[:1] == b" " else data.decode("utf-8", "replace")


def _grouped(items: Iterable[Block], many: int) -> Iterator[list[Block]]:
    items = iter(items)
    while part := list(islice(items, many)):
        yield part


ENCODED = "doc_id bigint, ids array<int>, n_ids bigint, round_trip boolean"


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``doc_id``, ``ids``, ``n_ids`` and whether decoding gives the text back, for every row.

    Ids equal those of the SentencePiece library for the same model file, which only the driver
    reads.  A null or empty text has no ids (and null and empty both come back as the empty text).
    U+2581 in a text is a blank to the model, so such a text comes back with blanks and
    ``round_trip`` false.  Repeated rows come back as often as they came.  Other columns are not
    looked at.
    """
    docs = chosen(docs, doc_id=(id_col, "bigint"), text=(text_col, "string"))
    loaded = docs.sparkSession.sparkContext.broadcast(PieceTrees(PieceModel.load(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(loaded.value)
        pieces = loaded.value.model.pieces
        width = np.array([len(p) for p in pieces], np.int64)
        table, first = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(width) - width
        for batch in batches:
            doc_ids, texts = batch.columns
            blanked = pc.replace_substring(texts, BLANK, " ")
            for group in _grouped(blocks(blanked), GROUP):
                for block, ids, count in encoder.encode(group):
                    size = width[ids]
                    again = table[spread(first[ids], size)]
                    same = _same_texts(texts[block.rows], again, np.bincount(np.repeat(np.arange(block.n), count), size, block.n).astype(np.int64))
                    edge = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([
                        doc_ids[block.rows], pa.ListArray.from_arrays(pa.array(edge), pa.array(ids)), pa.array(count), pa.array(same),
                    ], names=["doc_id", "ids", "n_ids", "round_trip"])
        del encoder
        release()

    return docs.mapInArrow(run, ENCODED)


def _same_texts(texts: pa.Array, data: np.ndarray, size: np.ndarray) -> list[bool]:
    end = np.cumsum(size)
    return [
        bytes(data[e - s + 1:e]) == (t.as_py() or "").encode() if s else not t.as_py()
        for t, s, e in zip(texts, size.tolist(), end.tolist())
    ]


def decode_texts(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``doc_id`` and ``text`` of rows with ids; null ids give a null text."""
    rows = chosen(rows, doc_id=(id_col, "bigint"), ids=(ids_col, "array<int>"))
    pieces = rows.sparkSession.sparkContext.broadcast(PieceModel.load(model).pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else decode_ids(pieces.value, ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, "doc_id bigint, text string")
