"""Near duplicates by SuperMinHash signatures, banding, verification and union-find.

**Signature.** Every element draws one random permutation of the slots, one slot
per round, and offers slot p(j) the value j + r with r in [0, 1).  A slot keeps
its least value.  Values of round j lie below j + 1, so a document stops at
the first round after which none of its slots is empty; most stop after one or two
rounds.  Because an element's ranks are one permutation, the slots are negatively
correlated and the estimate varies less than with independent hashes.

**Banding.** ``BANDS`` groups of ``ROWS`` slots are hashed.  At a similarity of 0.85 a pair
misses all bands with a probability of (1 - 0.85^4)^20 = 4e-7.

**Groups of copies.** Documents with equal shingle sets meet in one aggregate and are one
node, named by the hash of the set and read from the document with the smallest id.  Nodes that share buckets, however indirectly,
form a cluster.  A small cluster is compared in one task, with many others; a large one is
compared bucket by bucket, and a large bucket in pairs of parts, so that no task holds more
than two parts (``PART_ROWS`` documents or ``PART_SHINGLES`` shingles each).  No pair of documents
ever becomes a row: a task compares signatures and sets in arrays, skips pairs that its
links connect already, and returns a forest.  Every pair that shares a band is thus
either verified or known to be in one component, so no link between different
texts is lost.

**Verification** intersects the full sets of 64-bit shingle hashes, of pairs whose sizes allow the
similarity and of whose slots ``LEAST_EQUAL`` agree (a pair at the threshold fails
that with a probability below 1e-8).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchment.llm.common import blocks, chosen, distinct_in_rows, mix, settled, shingles, with_ids, with_key
from catchment.llm.components import components

BANDS, ROWS = 20, 4
SLOTS = BANDS * ROWS
LEAST_EQUAL = 44  # of 80; 68 are expected at 0.85
PART_ROWS, PART_SHINGLES = 1500, 1_500_000
PERCENT = 85

_ROUND = np.random.default_rng(20250103).integers(1, 1 << 63, SLOTS, dtype=np.uint64) | np.uint64(1)
SIGNED = "doc_id bigint, n_shingles bigint, set_hash bigint, bands array<bigint>, slots binary"
SETS = "doc_id bigint, node bigint, shingle_set array<bigint>"


def superminhash(value: np.ndarray, row: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures, one line per row; rows without elements stay infinite.

    ``value`` holds distinct element hashes, sorted by ``row``.
    """
    least = np.full(n * slots, np.inf)
    open_rows = np.zeros(n, bool)
    open_rows[row] = True
    order = None
    for j in range(slots):
        live = open_rows[row]
        if not live.all():
            value, row = value[live], row[live]
            order = order[live] if order is not None else None
        if not len(value):
            break
        draw = mix(value ^ _ROUND[j])
        pick = j + (draw >> np.uint64(40)).astype(np.int64) % (slots - j)
        rank = j + (draw & np.uint64((1 << 40) - 1)).astype(np.float64) / (1 << 40)
        if j == 0:
            slot = pick
        else:
            if order is None:
                order = np.tile(np.arange(slots, dtype=np.uint8), (len(value), 1))
                _swap(order, 0, (mix(value ^ _ROUND[0]) >> np.uint64(40)).astype(np.int64) % slots)
            slot = _swap(order, j, pick)
        np.minimum.at(least, row * slots + slot, rank)
        filled = np.isfinite(least.reshape(n, slots)).all(1)
        open_rows &= ~filled
    return least.reshape(n, slots)


def _swap(order: np.ndarray, j: int, pick: np.ndarray) -> np.ndarray:
    """Step j of every element's shuffle; returns the slot drawn."""
    at = np.arange(len(order))
    slot = order[at, pick]
    order[at, pick] = order[at, j]
    order[at, j] = slot
    return slot.astype(np.int64)


def _set_hashes(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of the set of each row, given distinct values sorted by row."""
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mix(value), out=total[1:])
    end = np.cumsum(size)
    return mix(total[end] - total[end - size] + size.astype(np.uint64)).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.columns
        for block in blocks(texts):
            value, row, _ = shingles(block)
            value, row = distinct_in_rows(value, row)
            size = np.bincount(row, minlength=block.n)
            words = superminhash(value, row, block.n).view(np.uint64)
            bands = np.zeros((block.n, BANDS), np.uint64)
            for k in range(ROWS):
                bands = mix(bands + words[:, k::ROWS]) + np.uint64(k)
            bands += np.arange(BANDS, dtype=np.uint64)
            short = (mix(words.ravel()) >> np.uint64(48)).astype(np.uint16).reshape(words.shape)
            yield pa.RecordBatch.from_arrays([
                ids[block.rows], pa.array(size), pa.array(_set_hashes(value, size)),
                pa.FixedSizeListArray.from_arrays(pa.array(mix(bands.ravel()).view(np.int64)), BANDS).cast(pa.list_(pa.int64())),
                pa.array([line.tobytes() for line in short], pa.binary()),
            ], names=["doc_id", "n_shingles", "set_hash", "bands", "slots"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.columns
        for block in blocks(texts):
            value, row, _ = shingles(block)
            value, row = distinct_in_rows(value, row)
            edge = np.searchsorted(row, np.arange(block.n + 1)).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(edge), pa.array(value.view(np.int64)))
            node = pa.array(_set_hashes(value, np.diff(edge).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([ids[block.rows], node, sets], names=["doc_id", "node", "shingle_set"])


class _Members:
    """Documents of one comparison: ids, sizes, signatures and flat sets of element numbers."""

    def __init__(self, table: pa.Table):
        self.ids = table["node"].to_numpy()
        self.part = table["part"].to_numpy()
        self.slots = np.frombuffer(b"".join(table["slots"].to_pylist()), np.uint16).reshape(-1, SLOTS)
        sets = table["shingle_set"].combine_chunks()
        self.size = np.diff(sets.offsets.to_numpy())
        self.first = np.cumsum(self.size) - self.size
        values, self.number = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        self.marked = np.zeros(len(values), bool)
        self.parent = np.arange(len(self.ids))

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def shared_with(self, i: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set i with other sets."""
        own = self.number[self.first[i]:self.first[i] + self.size[i]]
        self.marked[own] = True
        end = np.cumsum(self.size[others])
        at = np.arange(end[-1]) + np.repeat(self.first[others] - (end - self.size[others]), self.size[others])
        found = np.add.reduceat(self.marked[self.number[at]].astype(np.int64), end - self.size[others])
        self.marked[own] = False
        return found

    def link(self, rows: np.ndarray, across: bool, percent: int) -> None:
        """Finds links among the rows; with ``across`` only between different parts."""
        for k in range(1, len(rows)):
            i, others = rows[k], rows[:k]
            small, large = np.minimum(self.size[i], self.size[others]), np.maximum(self.size[i], self.size[others])
            keep = small * 100 >= large * percent
            if across:
                keep &= self.part[others] != self.part[i]
            others = others[keep]
            if not len(others):
                continue
            others = others[(self.slots[others] == self.slots[i]).sum(1) >= LEAST_EQUAL]
            if not len(others):
                continue
            root = self.roots()
            others = others[root[others] != root[i]]
            if not len(others):
                continue
            both = self.shared_with(i, others)
            good = others[both * 100 >= (self.size[i] + self.size[others] - both) * percent]
            if len(good):
                tied = np.unique(np.append(root[good], root[i]))
                self.parent = root
                self.parent[tied] = tied[0]


def _compare(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("node", "ascending")])
        members = _Members(table)
        cluster = table["cluster"].to_numpy()
        across = table["i"][0].as_py() != table["j"][0].as_py()
        edge = [0, *(np.flatnonzero(np.diff(cluster)) + 1).tolist(), len(cluster)]
        for low, high in zip(edge, edge[1:]):
            members.link(np.arange(low, high), across, percent)
        root = members.roots()
        tied = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"u": members.ids[tied], "v": members.ids[root[tied]]})

    return run


def links(stands: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """A set of links (u, v) that connects what the links of all nodes connect."""
    bucket = stands.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    shared = settled(bucket.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1"))
    shared = settled(with_key(bucket, shared, "bucket"))
    cluster = components(shared.select(F.col("node").alias("u"), F.col("first").alias("v")))
    cluster = settled(cluster.withColumnsRenamed({"id": "node", "component": "cluster"}))
    member = stands.join(cluster, "node").select("node", "n_shingles", "cluster")
    size = member.groupBy("cluster").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("shingles"))
    small = F.expr(f"rows <= {PART_ROWS} AND shingles <= {PART_SHINGLES}")
    size = settled(size.withColumn("small", small))
    totals = size.where("small").agg(F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles")).first()
    bins = max(1, (totals["rows"] or 0) // PART_ROWS, (totals["shingles"] or 0) // PART_SHINGLES)

    zero = F.lit(0)
    by_cluster = member.join(size.where("small"), "cluster").select(
        "node", F.pmod(F.xxhash64("cluster"), F.lit(bins)).alias("bin"), "cluster",
        zero.alias("part"), zero.alias("i"), zero.alias("j"),
    )
    in_large = with_key(cluster, size.where("NOT small").select("cluster", F.col("rows").alias("n"), "small"), "cluster")
    hot = settled(shared.join(in_large.select("node"), "node", "left_semi").select("node", "n_shingles", "bucket"))
    parts = F.greatest(F.ceil(F.count("*") / PART_ROWS), F.ceil(F.sum("n_shingles") / PART_SHINGLES)).cast("int")
    spread = with_key(hot, hot.groupBy("bucket").agg(F.count("*").alias("n"), parts.alias("parts")), "bucket")
    part = F.pmod(F.hash("node", F.lit("part")), F.col("parts"))
    other = F.explode(F.sequence(zero, F.col("parts") - 1))
    by_bucket = spread.withColumn("part", part).withColumn("other", other).select(
        "node", F.col("bucket").alias("bin"), F.col("bucket").alias("cluster"), "part",
        F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
    )
    route = by_cluster.unionByName(by_bucket)
    wanted = settled(stands.join(cluster.select("node"), "node", "left_semi").select("node", "first_id"))
    named = with_ids(docs, wanted.where("first_id IS NOT NULL").select(F.col("first_id").alias("doc_id")).distinct())
    if wanted.where("first_id IS NULL").count():
        named = named.unionByName(docs.where("doc_id IS NULL"))
    sets = settled(named.mapInArrow(_sets, SETS).join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    known = sets.select("node", "shingle_set").join(stands.select("node", "slots"), "node")
    return route.join(known, "node").groupBy("bin", "i", "j").applyInArrow(_compare(percent), "u bigint, v bigint")


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``node``, ``group`` (a node, null without words) and ``component`` (an id) of every row."""
    signed = settled(docs.mapInArrow(_sign, SIGNED).withColumnRenamed("set_hash", "node"))
    real = signed.where("n_shingles > 0")
    sets = settled(real.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    # By set and id, so that the copies of one text do not meet in one task.
    of_first = sets.where("first_id IS NOT NULL").select("node", F.col("first_id").alias("doc_id"))
    stands = real.join(of_first, ["node", "doc_id"], "left_semi").unionByName(
        real.where("doc_id IS NULL").join(sets.where("first_id IS NULL"), "node", "left_semi")
    )
    stands = stands.dropDuplicates(["node"]).select(F.col("doc_id").alias("first_id"), "node", "n_shingles", "bands", "slots")
    labels = settled(components(links(settled(stands), docs, percent)).withColumnsRenamed({"id": "node", "component": "group"}))
    linked = labels.join(sets, "node")
    least = linked.groupBy("group").agg(F.min("first_id").alias("component"), F.count("*").alias("n"))
    of_linked = with_key(linked.select("node", "group"), least, "group")
    of_set = sets.join(of_linked, "node", "left").select(
        "node", "n", F.coalesce("group", "node").alias("group"), F.when(F.col("group").isNull(), F.col("first_id")).otherwise(F.col("component")).alias("component")
    )
    found = with_key(real.select("doc_id", "n_shingles", "node"), settled(of_set), "node")
    none = F.lit(None).cast("bigint")
    alone = signed.where("n_shingles = 0").select("doc_id", "n_shingles", "node", none.alias("group"), F.col("doc_id").alias("component"))
    return found.unionAll(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    Two texts are linked if 100 * |A and B| >= percent * |A or B| for their sets of
    five-word shingles (``percent`` of 85 or more suits the fixed bands).  Texts that are
    null, empty or without words have an empty set and are linked with nothing.  Equal
    texts are linked whatever their ids.  Rows that repeat an id are judged each by its own text: a shared
    id links nothing.  A row without an id is linked by its text and has the smallest id reachable as
    its component, null if there is none; it is kept in that case only.  Repeated rows come back as often as they came.
    Other columns of ``docs`` are not looked at.
    """
    docs = chosen(docs, doc_id=(id_col, "bigint"), text=(text_col, "string"))
    return _grouped(docs, percent).select(
        "doc_id", "n_shingles", F.col("component").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component"), F.col("component").isNull()).alias("kept"),
    )


def near_duplicates_sql(percent: int = PERCENT) -> str:
    """The same, for unique ids, as one query over ``documents``: whole sets compared, links followed to their end."""
    return f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), placed AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM texts
), runs AS (
  SELECT doc_id, string_agg(word, ' ') OVER up_to_five AS x, n, place FROM placed
  WINDOW up_to_five AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
), one_each AS (SELECT doc_id, x FROM runs WHERE place = 1 OR place <= n - 4 GROUP BY ALL
), sized AS (
  SELECT t.doc_id, coalesce(s.n, 0) AS n, s.s FROM texts t
  LEFT JOIN (SELECT doc_id, count(*) AS n, list(x ORDER BY x) AS s FROM one_each GROUP BY doc_id) s USING (doc_id)
), classes AS (SELECT s AS k, min(doc_id) AS rep, any_value(n) AS n FROM sized WHERE n > 0 GROUP BY 1),
member AS (SELECT z.doc_id, z.n, c.rep FROM sized z LEFT JOIN classes c ON z.n > 0 AND z.s = c.k
), one AS (SELECT rep, n, unnest(k) AS x FROM classes
), common AS (
  SELECT a.rep AS u, b.rep AS v, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
  FROM one a JOIN one b ON a.x = b.x AND a.rep < b.rep GROUP BY 1, 2
), links AS (SELECT u, v FROM common WHERE 100 * c >= {percent} * (n + m - c)
), edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (SELECT rep AS u, rep AS v FROM classes UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u
), least AS (SELECT u, min(v) AS component FROM reach GROUP BY u)
SELECT m.doc_id, CAST(m.n AS BIGINT) AS n_shingles, coalesce(l.component, m.doc_id) AS component_id,
       m.doc_id = coalesce(l.component, m.doc_id) AS kept
FROM member m LEFT JOIN least l ON m.rep = l.u
"""


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their group of near duplicates.

    Of all rows linked by their texts one stays: of those with the smallest id the one with the smallest hash
    of its set, of rows equal in both the one that sorts first.  Rows without an id come after all
    others.  Rows without words are in no group and stay.  Ids with a single row, usually all, are decided by a list of
    ids; only rows that share an id, or have none, are hashed again.
    """
    named = chosen(docs, doc_id=(id_col, "bigint"), text=(text_col, "string"))
    rows = settled(_grouped(named, percent))
    turn = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node")
    first = rows.where("group IS NOT NULL").groupBy("group").agg(F.min(turn).alias("first")).select("first.doc_id", "first.node")
    first = settled(first)
    many = settled(rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    losers = rows.where("group IS NOT NULL").join(first.where("doc_id IS NOT NULL").select("doc_id"), "doc_id", "left_anti")
    gone = settled(losers.where("doc_id IS NOT NULL").select("doc_id").unionAll(many).distinct())
    kept = with_ids(docs.where(F.col(id_col).isNotNull()), gone.withColumnRenamed("doc_id", id_col), "left_anti", id_col)
    if not many.isEmpty() or not rows.where("doc_id IS NULL").isEmpty():
        shared = with_ids(docs, many.withColumnRenamed("doc_id", id_col), "left_semi", id_col).select(*docs.columns)
        shared = shared.unionAll(docs.where(F.col(id_col).isNull()))
        kept = kept.select(*docs.columns).unionAll(_first_rows(shared, first, id_col, text_col))
    return kept.select(*docs.columns)


def _first_rows(docs: DataFrame, first: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows that stay, of rows that may share an id and a text."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(at)):
                value, of_row, _ = shingles(block)
                value, of_row = distinct_in_rows(value, of_row)
                size = np.bincount(of_row, minlength=block.n)
                part = batch.slice(block.rows.start, block.n)
                columns = [*part.columns, pa.array(_set_hashes(value, size)), pa.array(size)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "_node", "_size"])

    names = [f"c{i}" for i in range(len(docs.columns))]
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema))
    hashed = docs.toDF(*names).mapInArrow(run, f"{kinds}, _node bigint, _size bigint")
    doc_id = F.col(names[docs.columns.index(id_col)]).cast("bigint")
    stay = hashed.where("_size > 0").join(first.select(F.col("doc_id").alias("_id"), F.col("node").alias("_of")),
                                          doc_id.eqNullSafe(F.col("_id")) & (F.col("_node") == F.col("_of")), "left_semi")
    one = stay.groupBy(doc_id.alias("_id"), "_node").agg(F.min(F.struct(*names)).alias("row")).select("row.*")
    return one.unionAll(hashed.where("_size = 0").select(*names)).toDF(*docs.columns)
