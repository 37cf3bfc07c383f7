"""Secret scans with a trigram index.

Every rule is a regular expression.  A Boolean query over trigrams is derived from its parse
tree: a text can match only if it holds the trigrams that the query asks for.  Each
block of texts gets an inverted index of the trigrams that any rule asks for;
postings are united and intersected as the query says, and only the candidates are
searched with the expression itself.  A rule without mandatory trigrams has the query
"all", so all its texts are searched.

The index folds ASCII case, so it serves rules in either case; it may then name more
candidates, never fewer.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as rc
import re._parser as rp
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from catchment.llm.common import LOWER, Block, blocks, chosen

MOST_EXACT = 64  # alternatives followed letter by letter

# --- rules (fixed values: published token formats) ---------------------------------------


@dataclass(frozen=True)
class Rule:
    """``least`` is the length that ``group`` must have for a match to count."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


BASE_RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)

MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,14}://[^\s/:@]+:[^\s/:@]+@[^\s/:@]+"),
)

RULES = BASE_RULES + MORE_RULES

# --- Boolean trigram queries -------------------------------------------------------------

ALL = ("all",)
Query = tuple


def _and(*parts: Query) -> Query:
    parts = tuple(dict.fromkeys(p for p in parts if p != ALL))
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(*parts: Query) -> Query:
    parts = tuple(dict.fromkeys(parts))
    return ALL if not parts or ALL in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_string(text: str) -> Query:
    data = bytes(LOWER[np.frombuffer(text.encode(), np.uint8)])
    return _and(*[("has", data[i:i + 3]) for i in range(len(data) - 2)])


def _of_strings(texts: set[str]) -> Query:
    return _or(*[_of_string(t) for t in sorted(texts)])


@dataclass
class Known:
    """What is known of the strings a part matches: all of them (``exact``), or a query."""

    exact: set[str] | None = None
    needs: Query = ALL

    def query(self) -> Query:
        return self.needs if self.exact is None else _of_strings(self.exact)


def _sequence(items) -> Known:
    """Neighbouring parts: strings are joined while all alternatives are known, then asked for."""
    run, needs = {""}, []
    closed = False
    for part in items:
        if part.exact is not None and len(part.exact) * len(run) <= MOST_EXACT:
            run = {a + b for a, b in product(run, part.exact)}
            continue
        needs += [_of_strings(run), part.query()]
        run, closed = {""}, True
    return Known(None, _and(*needs, _of_strings(run))) if closed else Known(run)


def _part(op, value) -> Known:
    if op is rc.LITERAL:
        return Known({chr(value)})
    if op is rc.IN:
        letters: set[str] = set()
        for kind, arg in value:
            if kind is rc.LITERAL:
                letters.add(chr(arg))
            elif kind is rc.RANGE and arg[1] - arg[0] < 16:
                letters |= {chr(c) for c in range(arg[0], arg[1] + 1)}
            else:
                return Known(None)
        return Known(letters) if len(letters) <= 16 else Known(None)
    if op is rc.SUBPATTERN:
        return _sequence([_part(*x) for x in value[-1]])
    if op is rc.BRANCH:
        sides = [_sequence([_part(*x) for x in side]) for side in value[1]]
        if all(s.exact is not None for s in sides) and sum(len(s.exact) for s in sides) <= MOST_EXACT:
            return Known(set().union(*[s.exact for s in sides]))
        return Known(None, _or(*[s.query() for s in sides]))
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
        low, high, body = value
        inner = _sequence([_part(*x) for x in body])
        if inner.exact is not None and (low, high) == (0, 1):
            return Known(inner.exact | {""})
        if not low:
            return Known(None)
        once = [inner] * min(int(low), 8)
        known = _sequence(once)
        return known if low == high and low <= 8 else Known(None, known.query())
    if op is rc.AT:
        return Known({""})
    return Known(None)  # any character, look-arounds, references: nothing is required


def trigram_query(pattern: str) -> Query:
    """What a text must hold to match; ``ALL`` if nothing is mandatory.

    ASCII letters of either case meet in the index, so a pattern may ignore case.  A letter that
    only Unicode folds to ASCII counts as such if the pattern ignores case without the
    ASCII flag; rules here always set it.
    """
    return _sequence([_part(*x) for x in rp.parse(pattern)]).query()


def trigrams_of(query: Query) -> set[bytes]:
    return {query[1]} if query[0] == "has" else set().union(*[trigrams_of(q) for q in query[1:]])


# --- index -------------------------------------------------------------------------------


class TrigramIndex:
    """Postings of chosen trigrams over the rows of one block."""

    def __init__(self, block: Block, wanted: np.ndarray):
        """``wanted`` holds sorted trigram codes."""
        self.n = block.n
        self.wanted = wanted
        data = LOWER[block.data].astype(np.uint32)
        self.postings: dict[int, np.ndarray] = {}
        if len(data) < 3 or not len(wanted):
            return
        code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        low = np.zeros(1 << 16, bool)  # by the last two bytes: sorts out almost everything cheaply
        low[wanted & 0xFFFF] = True
        at = np.flatnonzero(low[code & 0xFFFF])
        at = at[np.isin(code[at], wanted)]
        row = np.searchsorted(block.at, at, "right") - 1
        inside = at + 3 <= block.at[row + 1]
        both = np.unique(code[at[inside]].astype(np.int64) * self.n + row[inside])
        for gram, rows in zip(*_grouped(both // self.n, both % self.n)):
            self.postings[gram] = rows

    def rows(self, query: Query) -> np.ndarray:
        """Rows that may match, sorted."""
        kind = query[0]
        if kind == "all":
            return np.arange(self.n)
        if kind == "has":
            return self.postings.get(int.from_bytes(query[1], "big"), np.zeros(0, np.int64))
        found = [self.rows(q) for q in query[1:]]
        if kind == "or":
            return np.unique(np.concatenate(found))
        least = min(found, key=len)
        for other in found:
            least = np.intersect1d(least, other, assume_unique=True) if other is not least else least
        return least


def _grouped(key: np.ndarray, value: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    edge = np.flatnonzero(np.diff(key)) + 1
    return key[np.concatenate([[0], edge])].tolist() if len(key) else [], np.split(value, edge) if len(key) else []


@dataclass
class Scanner:
    """Rules with their queries, ready to scan blocks."""

    rules: tuple[Rule, ...] = RULES
    queries: list[Query] = field(default_factory=list)

    def __post_init__(self):
        self.queries = [trigram_query(r.pattern) for r in self.rules]
        grams = set().union(*[trigrams_of(q) for q in self.queries if q != ALL], set())
        self.wanted = np.array(sorted(int.from_bytes(g, "big") for g in grams), np.uint32)
        # Of a rule that is one repeated class, only runs of the least length can count.
        self.search: list[Callable] = [re.compile(self._long_enough(r)).finditer for r in self.rules]

    @staticmethod
    def _long_enough(rule: Rule) -> str:
        one_class = re.fullmatch(r"(\[[^\]\\]+\])\+", rule.pattern)
        return f"{one_class[1]}{{{rule.least},}}" if one_class and rule.least else rule.pattern

    def scan(self, block: Block) -> list[list[tuple[int, int, int]]]:
        """Per row: start, number of the rule, end; in code points."""
        index = TrigramIndex(block, self.wanted)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(block.n)]
        texts: dict[int, str] = {}
        for k, (rule, query, search) in enumerate(zip(self.rules, self.queries, self.search)):
            for i in index.rows(query).tolist():
                text = texts.get(i)
                if text is None:
                    text = texts[i] = block.text(i)
                for m in search(text):
                    low, high = m.span(rule.group)
                    if high - low >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        for spans in found:
            spans.sort()
        return found


OUT = (
    "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, "
    "found array<struct<kind:string,start:int,end:int>>"
)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more_rules: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """Secrets of every row: counts of the base kinds, digest of their spans, all spans.

    ``spans`` joins kind:start:end by commas, by start and then kind as listed; ``found`` holds the
    same as an array.  Offsets are code points, ends exclusive.  Spans of different kinds may
    overlap.  A null or empty text has none: counts 0, the digest of the empty string, empty
    spans.  Repeated rows come back as often as they came.  Other columns are not looked at.
    """
    docs = chosen(docs, doc_id=(id_col, "bigint"), text=(text_col, "string"))
    rules = BASE_RULES + tuple(more_rules)
    kinds, n_base = [r.kind for r in rules], len(BASE_RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            ids, texts = batch.columns
            for block in blocks(texts):
                found = scanner.scan(block)
                joined = [",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans) for spans in found]
                base = [",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans if k < n_base) for spans in found]
                counts = [[sum(s[1] == k for s in spans) for spans in found] for k in range(n_base)]
                yield pa.RecordBatch.from_arrays([
                    ids[block.rows], *[pa.array(c, pa.int64()) for c in counts],
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base]), pa.array(joined, pa.string()),
                    pa.array([[{"kind": kinds[k], "start": a, "end": b} for a, k, b in spans] for spans in found], _FOUND),
                ], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    return docs.mapInArrow(run, OUT)


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def mask_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping ones become one."""
    parts, done = [], 0
    for start, end, kind in sorted(spans):
        if start >= done:
            parts += [text[done:start], f"<{kind}>"]
        done = max(done, end)
    return "".join(parts) + text[done:]


def mask_secrets(docs: DataFrame, text_col: str = "text", more_rules: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """All columns and rows of ``docs``; secrets in the text are replaced, null stays null."""
    chosen(docs)
    rules = BASE_RULES + tuple(more_rules)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            column = batch.column(at)
            texts: list[pa.Array] = []
            for block in blocks(column):
                part = column[block.rows].to_pylist()
                for i, spans in enumerate(scanner.scan(block)):
                    if spans:
                        part[i] = mask_text(part[i], [(a, b, rules[k].kind) for a, k, b in spans])
                texts.append(pa.array(part, column.type))
            if texts:
                yield batch.set_column(at, batch.schema.field(at), pa.concat_arrays(texts))

    return docs.mapInArrow(run, docs.schema)
