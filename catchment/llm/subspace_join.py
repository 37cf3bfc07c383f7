"""Embedding near-duplicates by a subspace pigeonhole join.

A cosine of at least t between unit vectors is a squared distance of at most 2 - 2t.  A seeded
rotation spreads every direction evenly over the coordinates, which are then cut into
blocks of ``BLOCK`` dimensions.  If two vectors are that close, then in at least one block
their squared distance is within the block's share of the budget, in proportion to its
dimensions.  So every block is joined by range on its own:

- The first ``GRID`` coordinates of the block form a grid with cells two radii wide.  A vector
  lives in one cell and visits the later cells that its ball reaches, so that any
  two vectors within the radius meet once.
- A cell of more than ``PART`` vectors is cut into parts, and every pair of parts is a task of its own.
- In a task block distances are matrix products, and what is within the budget is a candidate.

A candidate found in several blocks counts in the first block whose budget it meets, so the
union needs no distinct step, and is verified there by its cosine in double precision.  Tasks
return one row per linked vector (links counted, smallest member of its group), never
a row per pair.  Equal vectors are compared once and count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from catchment.llm.common import chosen, settled
from catchment.llm.components import components, union_find

LEAST_COSINE = 0.95
BLOCK, GRID = 8, 2
PART = 16384
STRIP = 256  # rows of a part compared at once
CHECKED = 20_000  # candidates verified at once
SEED = 23
SLACK = 1e-6  # of squared distances, far above rounding

CELLS = "vec_id bigint, dimension int, block int, cell bigint, home boolean"
FOUND = "vec_id bigint, n bigint, root bigint"


class Space:
    """Rotation and blocks for vectors of one dimension."""

    def __init__(self, dimension: int, least: float):
        random = np.random.default_rng(SEED + dimension)
        turn, corner = np.linalg.qr(random.normal(size=(dimension, dimension)))
        self.turn = turn * np.sign(np.diag(corner))
        count = max(1, dimension // BLOCK)
        edge = np.linspace(0, dimension, count + 1).astype(int)
        self.blocks = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
        self.budget = np.array([(2 - 2 * least) * (b - a) / dimension for a, b in self.blocks]) + SLACK

    def rotated(self, vectors: np.ndarray) -> np.ndarray:
        vectors = vectors.astype(np.float64)
        return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ self.turn

    def parts(self, difference: np.ndarray) -> np.ndarray:
        """Squared distance in each block."""
        square = difference * difference
        return np.stack([square[:, a:b].sum(1) for a, b in self.blocks], 1)


def _cells(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces: dict[int, Space] = {}
        for batch in batches:
            ids, lists = batch.column("vec_id").to_numpy(), batch.column("embedding")
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            first = np.cumsum(size) - size
            for d in np.unique(size).tolist():
                space = spaces.setdefault(d, Space(d, least))
                rows = np.flatnonzero(size == d)
                turned = space.rotated(flat[first[rows][:, None] + np.arange(d)])
                for b, (low, high) in enumerate(space.blocks):
                    radius = float(np.sqrt(space.budget[b]))
                    at, cell, home = _reach(turned[:, low:min(high, low + GRID)], radius)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[rows[at]]), pa.array(np.full(len(at), d, np.int32)), pa.array(np.full(len(at), b, np.int32)),
                        pa.array(cell), pa.array(home),
                    ], names=["vec_id", "dimension", "block", "cell", "home"])

    return run


def _reach(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell of every point and the later cells within the radius."""
    width = 2 * radius
    home = np.floor(x / width).astype(np.int64)
    axes = x.shape[1]
    weight = 1 << (20 * np.arange(axes)[::-1])  # cells of unit vectors are few; order is that of the tuple
    own = ((home + (1 << 18)) * weight).sum(1)
    rows, cells, homes = [np.arange(len(x))], [own], [np.ones(len(x), bool)]
    for step in np.stack(np.meshgrid(*[[-1, 0, 1]] * axes, indexing="ij"), -1).reshape(-1, axes):
        if tuple(step) <= (0,) * axes:
            continue
        low = (home + step) * width
        gap = np.maximum(np.maximum(low - x, x - (low + width)), 0)
        near = np.flatnonzero((gap * gap).sum(1) <= radius * radius + SLACK)
        rows.append(near)
        cells.append(own[near] + (step * weight).sum())
        homes.append(np.zeros(len(near), bool))
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(homes)


class _Task:
    """Vectors of one cell, or of two parts of it, compared in one block."""

    def __init__(self, table: pa.Table, least: float):
        self.least = least
        self.ids, self.copies = table["vec_id"].to_numpy(), table["copies"].to_numpy()
        self.home, self.part = table["home"].to_numpy(), table["part"].to_numpy()
        d = table["dimension"][0].as_py()
        self.block = table["block"][0].as_py()
        self.space = Space(d, least)
        lists = table["embedding"].combine_chunks()
        self.vectors = lists.flatten().to_numpy().reshape(-1, d).astype(np.float64)
        self.length = np.linalg.norm(self.vectors, axis=1)
        self.turned = self.space.rotated(self.vectors)
        self.count = np.zeros(len(self.ids), np.int64)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def compare(self, left: np.ndarray, right: np.ndarray | None) -> None:
        """Rows of the one side with those of the other, or with the later ones of the same."""
        a, b = self.space.blocks[self.block]
        budget = self.space.budget[self.block]
        other = left if right is None else right
        y = self.turned[other, a:b].astype(np.float32)
        y_square = (y * y).sum(1)
        for low in range(0, len(left), STRIP):
            rows = left[low:low + STRIP]
            x = self.turned[rows, a:b].astype(np.float32)
            first = low if right is None else 0
            distance = (x * x).sum(1)[:, None] + y_square[None, first:] - 2 * (x @ y[first:].T)
            i, j = np.nonzero(distance <= budget + 1e-5)
            if right is None:
                later = j > i
                i, j = i[later], j[later]
            self.verify(rows[i], other[first + j])

    def verify(self, i: np.ndarray, j: np.ndarray) -> None:
        for low in range(0, len(i), CHECKED):
            u, v = i[low:low + CHECKED], j[low:low + CHECKED]
            within = self.space.parts(self.turned[u] - self.turned[v]) <= self.space.budget
            own = within[:, self.block] & ~within[:, :self.block].any(1)
            u, v = u[own], v[own]
            cosine = np.einsum("ij,ij->i", self.vectors[u], self.vectors[v]) / (self.length[u] * self.length[v])
            u, v = u[cosine >= self.least], v[cosine >= self.least]
            if len(u):
                np.add.at(self.count, u, self.copies[v])
                np.add.at(self.count, v, self.copies[u])
                node, root = union_find(u, v)
                self.pairs.append((node[node != root], root[node != root]))

    def result(self) -> pa.Table:
        root = np.arange(len(self.ids))
        if self.pairs:
            by_id = np.argsort(self.ids, kind="stable")
            place = np.empty_like(by_id)
            place[by_id] = np.arange(len(by_id))
            u, v = (np.concatenate(x) for x in zip(*self.pairs))
            node, top = union_find(place[u], place[v])
            root[by_id[node]] = by_id[top]
        linked = np.flatnonzero(self.count)
        return pa.table({"vec_id": self.ids[linked], "n": self.count[linked], "root": self.ids[root[linked]]})


def _compare(least: float):
    def run(table: pa.Table) -> pa.Table:
        task = _Task(table, least)
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        homes, visits = np.flatnonzero(task.home), np.flatnonzero(~task.home)
        if i == j:
            task.compare(homes, None)
            task.compare(homes, visits)
        else:
            first = task.part == i
            split = lambda rows: (rows[first[rows]], rows[~first[rows]])
            (h1, h2), (v1, v2) = split(homes), split(visits)
            task.compare(h1, h2)
            task.compare(h1, v2)
            task.compare(h2, v1)
        return task.result()

    return run


def link_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST_COSINE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row.

    Rows are linked if the cosine of their vectors, in double precision, is at least ``least``;
    only vectors of equal dimension compare.  A vector that is null, empty, zero or has a null
    or non-finite component is linked with nothing and is its own component; so is a row
    without an id, whose component is null.  Repeated rows are linked with each other and count
    each.  Other columns are not looked at.
    """
    kind = "array<float>" if vectors.schema[vector_col].dataType == ArrayType(FloatType()) else "array<double>"
    rows = chosen(vectors, vec_id=(id_col, "bigint"), embedding=(vector_col, kind))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & ~bad & some, F.lit(False))
    rows = settled(rows.withColumn("usable", usable))
    good = rows.where("usable")
    groups = good.groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    stands = settled(groups.select(F.col("first_id").alias("vec_id"), "embedding", "copies"))

    cells = settled(stands.select("vec_id", "embedding").mapInArrow(_cells(least), CELLS))
    place = ["dimension", "block", "cell"]
    crowd = cells.groupBy(*place).agg(F.count("*").alias("members"), F.max("home").alias("lived_in")).where("members > 1 AND lived_in")
    parts = F.ceil(F.col("members") / PART).cast("int")
    part = F.pmod(F.hash("vec_id", F.lit("part")), F.col("parts"))
    route = (
        cells.join(crowd.select(*place, parts.alias("parts")), place)
        .withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("vec_id", *place, "home", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    )
    found = settled(
        route.join(stands, "vec_id").groupBy(*place, "i", "j").applyInArrow(_compare(least), FOUND)
    )
    counted = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    label = components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")))
    of_group = (
        stands.join(counted, "vec_id", "left").join(label.withColumnRenamed("id", "vec_id"), "vec_id", "left")
        .select("embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    )
    linked = good.join(of_group, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
