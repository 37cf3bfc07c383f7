"""Greedy maximum coverage without a table of pairs.

Areas at the same coordinates act as one point with their summed population, and
of the sites at the same coordinates only the first can ever be chosen, so both
sides are first reduced to distinct locations.  The population in reach of every
site is computed once.  When sites open, only the points they newly cover and
the sites near enough to reach those points can change, so each round corrects
the scores of that neighbourhood instead of rescoring everything.

A round usually settles several picks.  The best few hundred sites form a
frontier; points are grouped by the exact set of frontier sites that reach them,
which gives a small table whatever the number of points.  From it the next picks
follow on the driver, as long as they beat the best site outside the frontier.

Gains only fall while sites open, so an old score is an upper bound.  Scores are
brought up to date only when no pick of the frontier beats the bounds of the sites
outside it; until then one job per round rescores the leaders alone.

Where locations are dense, points are summarised in nested cells by bounding box.
Only cells with many points are divided, so one crowded square mile is cut finely
while the country around it stays in whole blocks.  A cell wholly inside a disc
counts as a whole and one wholly outside is dropped; only cells cut by the rim are
opened, so the work follows the rim of the disc and not its area.  All decisions
are exact: near the rim the haversine test decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catchment.functions.geodesy import (
    chord_limits,
    side,
    sql_number,
    squared_chord_sql,
    unit_vector,
    unit_vector_sql,
    usable_point,
    within_sql,
)
from catchment.operators.areas import DEFAULT_SITE_TYPES, keep_keys, keep_types
from catchment.operators.grid import LEVEL_BITS, MAX_LEVEL, Grid, cell_key
from catchment.operators.radius_join import placed
from catchment.operators.skew import MOST_PAIRS, MOST_REPEATS, key_parts, split_join
from catchment.session import ensure_checkpoint_dir
from catchment.sources.cache import FrameCache

# Points a block or cell may hold before it is divided further.
LEAF_POINTS = 2048
# Cells that a cell is divided into.
CHILDREN = 1 << 2 * LEVEL_BITS
# Divided cells up to this number are broadcast, after a count.
MOST_CELLS = 200_000
# Sites per frontier: eight words of 63 bits.  Discs cut the sphere into at most
# n * n - n + 2 regions, so a frontier yields at most 253 514 distinct sets.
WORD_BITS, WORDS = 63, 8
FRONTIER_SITES = WORD_BITS * WORDS
# Block ranges kept apart when skipping cached batches.
MOST_RANGES = 16
# Rounds after which the corrections are folded into a checkpointed score table.
CONSOLIDATE_ROUNDS = 8
# Tables of chosen sites up to this number are broadcast, longer ones are joined by shuffle.
MOST_SITES = 10_000
# Leaders fetched at once, in frontiers: what the next rounds may draw on before scores are brought up to date.
PAGES = 4
# Pairs of centers compared at once on the driver.
PAIRS_AT_ONCE = 1 << 22
# Sets subtracted from the gains at once, which bounds the memory of a pick.
SETS_AT_ONCE = 8192
_CELL = ["block", "cell_row", "cell_col"]
_LEAF = ["block", "leaf", "leaf_row", "leaf_col"]
_SITE = ["s_lat", "s_lon", "first_here"]
_SPOT = [*_SITE, "s_x", "s_y", "s_z"]


@dataclass(frozen=True)
class Selection:
    """Chosen sites in order of choice; ``centers`` has one (lat, lon) per site.

    ``rounds``, ``updates`` and ``checkpoints`` tell how the search went: how often leaders competed on the
    driver, how often all scores were brought up to date, and how often they were written.
    """

    sites: DataFrame
    centers: list[tuple[float, float]]
    radius_miles: float
    rounds: int = 0
    updates: int = 0
    checkpoints: int = 0


class _Pick(NamedTuple):
    s_lat: float
    s_lon: float
    first_here: object
    people: object


@dataclass(frozen=True)
class CoverageRun:
    summary: DataFrame
    sites: DataFrame
    selection: Selection
    demand: DataFrame


def _exact_amount(df: DataFrame, column: str) -> Column:
    """Population as a type whose sums do not depend on the order of addition."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.coalesce(F.col(column).cast("decimal(28,6)"), F.lit(0))
    return F.coalesce(F.col(column), F.lit(0))


def demand_points(
    areas: DataFrame, grid: Grid, population: str = "population", lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """One located point per distinct coordinate pair, with the summed population."""
    merged = (
        areas.where(usable_point(lat, lon))
        .select(F.expr(f"cast({lat} AS double)").alias("lat"), F.expr(f"cast({lon} AS double)").alias("lon"),
                _exact_amount(areas, population).alias("people"))
        .groupBy("lat", "lon")
        .agg(F.sum("people").alias("people"))
    )
    return grid.locate(placed(merged, "d_", "lat", "lon", ["people"]), "d_lat", "d_lon")


def site_reach_blocks(
    sites: DataFrame, grid: Grid, order_by: str = "site_id", lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """Distinct site locations, repeated per block in reach.

    Each carries the first site there by ``order_by``, the only one of that
    location that can be chosen.
    """
    merged = (
        sites.where(usable_point(lat, lon))
        .groupBy(F.expr(f"cast({lat} AS double)").alias("lat"), F.expr(f"cast({lon} AS double)").alias("lon"))
        .agg(F.min(order_by).alias("first_here"))
    )
    return grid.reach(placed(merged, "s_", "lat", "lon", ["first_here"]), "s_lat", "s_lon")


class _Shape(NamedTuple):
    """Levels of cells below the blocks, the pair bound if anything exceeds it, and whether populations can be negative."""

    depth: int
    split: int | None
    signed: bool


def _divided(
    cache: FrameCache, located: DataFrame, reach: DataFrame, leaf_points: int, most_pairs: int
) -> tuple[DataFrame, _Shape]:
    """Points with the cell of the tree each lies in, ``leaf, leaf_row, leaf_col``, and the shape of the tree.

    A block, or a cell of level ``leaf``, is divided if it holds more than ``leaf_points``.  Level by
    level only the points of divided cells are counted again, so one aggregation over blocks is all where
    nothing is crowded.  Parts by the pair bound are needed only where very many sites meet a block, or a
    cell is still full at the last level.
    """
    blocks = points_per(located, ["block"], F.min("people").alias("least"))
    sites = reach.groupBy("block").agg(F.count("*").alias("sites"))
    figures = blocks.join(sites, "block", "left").agg(
        F.count_if(F.col("n") > leaf_points).alias("full"),
        F.coalesce(F.max("sites"), F.lit(0)).alias("sites"),
        F.coalesce(F.max(F.least("n", F.lit(max(leaf_points, CHILDREN))) * F.col("sites").cast("double")), F.lit(0.0)).alias("pairs"),
        F.coalesce(F.min("least"), F.lit(0)).alias("least"),
    ).first()
    many, signed = figures.pairs > most_pairs, figures.least < 0
    if not figures.full:
        return located, _Shape(0, most_pairs if many else None, signed)
    points = located.selectExpr("*", "0 AS leaf")
    full, n_full, depth = blocks.where(F.col("n") > leaf_points), figures.full, 0
    while n_full:
        key = [name.split(" AS ")[-1] for name in cell_key(depth)]
        mark = full.select(*key, F.lit(1).alias("_full"))
        mark = F.broadcast(mark) if n_full <= MOST_CELLS else mark
        here = points.selectExpr("*", *cell_key(depth)[1:]).join(mark, key, "left")
        points = here.withColumn("leaf", F.col("leaf") + F.coalesce("_full", F.lit(0))).drop("_full", *key[1:])
        depth += 1
        counted = points_per(points.where(F.col("leaf") == depth).selectExpr(*cell_key(depth)), _CELL)
        if depth == MAX_LEVEL:
            many = many or counted.agg(F.max("n")).first()[0] * float(figures.sites) > most_pairs
            break
        full = cache.get(f"full {depth}", lambda: counted.where(F.col("n") > leaf_points))
        n_full = full.count()
    shift = f"{LEVEL_BITS} * ({MAX_LEVEL} - leaf)"
    leaves = [f"if(leaf = 0, 0, shiftright(sub_{name}, {shift})) AS leaf_{name}" for name in ("row", "col")]
    return points.selectExpr("*", *leaves), _Shape(depth, most_pairs if many else None, signed)


def points_per(points: DataFrame, keys: list[str], *figures: Column) -> DataFrame:
    return points.groupBy(*keys).agg(F.count("*").alias("n"), *figures)


def _cells(points: DataFrame, depth: int) -> dict[int, DataFrame]:
    """Summaries of the occupied cells of each level: corners of the bounding box and people.

    Points are grouped once, by the leaf that holds them; a level consists of its leaves and of what the
    cells below it add up to.
    """
    def boxes(df: DataFrame, keys: list[str], of: dict[str, str]) -> DataFrame:
        corners = [f(of[f.__name__] + a).alias(f"{f.__name__}_{a}") for f in (F.min, F.max) for a in "xyz"]
        return df.groupBy(*keys).agg(*corners, F.sum("people").alias("people"))

    leaves = boxes(points.where("leaf > 0"), _LEAF, {"min": "d_", "max": "d_"}).checkpoint()
    levels: dict[int, DataFrame] = {}
    for level in range(depth, 0, -1):
        own = leaves.where(F.col("leaf") == level).drop("leaf").withColumnsRenamed({"leaf_row": "cell_row", "leaf_col": "cell_col"})
        if level < depth:
            above = levels[level + 1].withColumns({c: F.shiftright(c, LEVEL_BITS) for c in _CELL[1:]})
            own = own.unionByName(boxes(above, _CELL, {"min": "min_", "max": "max_"}))
        levels[level] = own
    return levels


def _balls(cells: DataFrame) -> DataFrame:
    """Cells as centre and half diagonal of their boxes, with the cell around each."""
    return cells.selectExpr(
        *_CELL,
        f"shiftright(cell_row, {LEVEL_BITS}) AS parent_row",
        f"shiftright(cell_col, {LEVEL_BITS}) AS parent_col",
        *[f"(min_{a} + max_{a}) / 2 AS c_{a}" for a in "xyz"],
        f"sqrt({squared_chord_sql(['max_x', 'max_y', 'max_z'], ['min_x', 'min_y', 'min_z'])}) / 2 AS spread",
        "people",
    )


def _bounded_join(
    sites: DataFrame, targets: DataFrame, keys: list[str], targets_by: list[str], split: int | None
) -> DataFrame:
    """Sites with points or cells of the same key, cut into parts where that is more than ``split`` pairs."""
    parts = None if split is None else key_parts(sites, targets, keys, split, MOST_REPEATS)
    return split_join(sites, targets, keys, ["s_lat", "s_lon"], targets_by, parts)


def served(points: DataFrame, reach: DataFrame, radius_miles: float, shape: _Shape) -> DataFrame:
    """Rows ``s_lat, s_lon, first_here, people`` whose sum per site is the population in reach.

    A row stands for one point or for a whole cell.  Blocks and cells that are not divided meet
    the sites that reach them at once, whatever their level; divided ones are opened where the rim
    cuts them.  What sites meet on the way is checkpointed, as both the rows and the next level come
    from it and plans would grow with every level.  With a pair bound keys beyond it are cut into parts, as many as
    bounded repeats allow.
    """
    sure, maybe = (math.sqrt(max(v, 0.0)) for v in chord_limits(radius_miles))
    if sure == 0.0:
        sure = -1.0
    within = within_sql(side("s_"), side("d_"), radius_miles)
    exact = ["d_lat", "d_lon", "d_x", "d_y", "d_z", "people"]
    if shape.depth == 0:
        met = _bounded_join(reach, points.select("block", *exact), ["block"], ["d_lat", "d_lon"], shape.split)
        return met.where(within).select(*_SITE, "people")
    ensure_checkpoint_dir(points.sparkSession)
    parts, rims = [], [reach.selectExpr(*_SPOT, "block", "0 AS leaf", "0 AS leaf_row", "0 AS leaf_col")]
    rim = reach
    levels = _cells(points, shape.depth)
    for level in range(1, shape.depth + 1):
        cells, in_block = _balls(levels[level]), ["cell_row", "cell_col"]
        if level == 1:
            met = _bounded_join(rim, cells.drop("parent_row", "parent_col"), ["block"], in_block, shape.split)
        else:
            parents = rim.withColumnsRenamed({"cell_row": "parent_row", "cell_col": "parent_col"})
            met = _bounded_join(parents, cells, ["block", "parent_row", "parent_col"], in_block, shape.split)
        gap = squared_chord_sql(["s_x", "s_y", "s_z"], ["c_x", "c_y", "c_z"])
        met = met.selectExpr(*_SPOT, *_CELL, "people", "spread", f"sqrt({gap}) AS gap")
        met = met.where(f"gap - spread <= {sql_number(maybe)}").selectExpr(
            *_SPOT, *_CELL, "people", f"gap + spread <= {sql_number(sure)} AS whole")
        met = met.checkpoint()
        parts.append(met.where("whole").select(*_SITE, "people"))
        rim = met.where("NOT whole").select(*_SPOT, *_CELL)
        rims.append(rim.selectExpr(*_SPOT, "block", f"{level} AS leaf", "cell_row AS leaf_row", "cell_col AS leaf_col"))
    opened = _bounded_join(reduce(DataFrame.unionAll, rims), points.select(*_LEAF, *exact), _LEAF, ["d_lat", "d_lon"], shape.split)
    return reduce(DataFrame.unionAll, [*parts, opened.where(within).select(*_SITE, "people")])


def _center_blocks(spark: SparkSession, grid: Grid, centers: Sequence[tuple[float, float]], **extra: list) -> DataFrame:
    """The given centers as ``c_`` columns, repeated per ``block`` in reach; broadcast if they are few."""
    values = [(*c, *unit_vector(*c)) for c in centers]
    columns = dict(zip([*side("c_")[1:], *side("c_")[0]], map(list, zip(*values))))
    blocks = grid.reach(spark.createDataFrame(pa.table(columns | extra)), "c_lat", "c_lon")
    return F.broadcast(blocks) if len(centers) <= MOST_SITES else blocks


def _by_coverage(points: DataFrame, grid: Grid, centers: list, covered: bool) -> DataFrame:
    """Points within the radius of one of the centers, or within that of none."""
    if not centers:
        return points.where(F.lit(not covered))
    near = _center_blocks(points.sparkSession, grid, centers).withColumnRenamed("block", "c_block")
    match = (F.col("block") == F.col("c_block")) & F.expr(within_sql(side("c_"), side("d_"), grid.radius_miles))
    return points.join(near, match, "left_semi" if covered else "left_anti")


def _touch_limit(radius_miles: float) -> float:
    """Squared chord beyond which two discs of this radius surely share no point."""
    return chord_limits(2 * radius_miles)[1]


def _touching(centers: list, others: list, radius_miles: float) -> list:
    """Those of the centers whose disc may share a point with a disc of the others."""
    if not centers or not others:
        return []
    a, b = (np.array([unit_vector(*c) for c in part]) for part in (centers, others))
    found, step = [], max(1, PAIRS_AT_ONCE // len(others))
    for low in range(0, len(centers), step):
        gaps = ((a[low:low + step, None, :] - b[None, :, :]) ** 2).sum(axis=2)
        found += [centers[low + i] for i in np.flatnonzero((gaps <= _touch_limit(radius_miles)).any(axis=1))]
    return found


def _band_filter(grid: Grid, centers: list) -> str:
    """Ranges of blocks outside of which cached, block-sorted batches can be skipped."""
    ranges = sorted({grid.block_range(lat) for lat, _ in centers})
    if len(ranges) > MOST_RANGES:
        ranges = [(ranges[0][0], max(r[1] for r in ranges))]
    return " OR ".join(f"block BETWEEN {first}L AND {last}L" for first, last in ranges)


def _newly_covered(points: DataFrame, grid: Grid, new: list, earlier: list) -> DataFrame:
    """Points that the new centers cover and no earlier one does."""
    fresh = _by_coverage(points.where(_band_filter(grid, new)), grid, new, True)
    return _by_coverage(fresh, grid, _touching(earlier, new, grid.radius_miles), False)


def _sites_near(reach: DataFrame, grid: Grid, centers: list) -> DataFrame:
    """Site blocks that hold points the centers may cover."""
    return reach.join(_center_blocks(reach.sparkSession, grid, centers).select("block"), "block", "left_semi")


def _frontier_sets(points: DataFrame, grid: Grid, frontier: list, chosen: list) -> pa.Table:
    """``m0 .. m7, people`` for each distinct set of frontier sites that share uncovered points.

    The frontier, at most FRONTIER_SITES rows, is broadcast.  All matches of a
    point arise in the task that holds it, so they are merged before the shuffle.
    """
    words = [f"m{w}" for w in range(WORDS)]
    centers = _centers(frontier)
    bits = {
        word: [1 << (i % WORD_BITS) if i // WORD_BITS == w else 0 for i in range(len(centers))]
        for w, word in enumerate(words)
    }
    near = points.where(_band_filter(grid, centers))
    uncovered = _by_coverage(near, grid, _touching(chosen, centers, grid.radius_miles), False)
    return (
        uncovered.join(_center_blocks(points.sparkSession, grid, centers, **bits), "block")
        .where(within_sql(side("c_"), side("d_"), grid.radius_miles))
        .groupBy("d_lat", "d_lon")
        .agg(*[F.bit_or(w).alias(w) for w in words], F.max("people").alias("people"))
        .groupBy(*words)
        .agg(F.sum("people").alias("people"))
        .toArrow()
    )


def _amounts(column: pa.ChunkedArray) -> tuple[np.ndarray, int]:
    """Populations as whole numbers and what they are multiples of: 1, or a power of ten below it.

    Sums that do not fit 64 bits are kept as Python numbers.
    """
    scale = 1
    if pa.types.is_decimal(column.type):
        scale = 10 ** column.type.scale
        pairs = [np.frombuffer(c.buffers()[1], "<i8").reshape(-1, 2)[c.offset:c.offset + len(c)] for c in column.chunks]
        words = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
        # The upper half only repeats the sign of numbers that fit the lower one.
        if (words[:, 1] != words[:, 0] >> 63).any():
            return np.array([int(v * scale) for v in column.to_pylist()], dtype=object), scale
        people = words[:, 0].copy()
    else:
        people = np.array(column.to_pylist(), dtype=object)
        people = people.astype("int64") if all(abs(v) < 2**62 for v in people) else people
    if people.dtype != object and np.abs(people.astype(float)).sum() >= 2**62:
        people = people.astype(object)
    return people, scale


@dataclass(frozen=True)
class SearchOptions:
    """Sizes that decide how the work is cut, never what comes out.

    ``leaf_points``: points of a cell before it is divided.  ``most_pairs``: pairs of one key
    that a task may test.  ``frontier_sites``: sites that compete on the driver, at most
    FRONTIER_SITES.
    """

    leaf_points: int = LEAF_POINTS
    most_pairs: int = MOST_PAIRS
    frontier_sites: int = FRONTIER_SITES

    def __post_init__(self) -> None:
        if not 1 <= self.frontier_sites <= FRONTIER_SITES:
            raise ValueError(f"frontier_sites must be 1 to {FRONTIER_SITES}, got {self.frontier_sites}")


def _turn(r) -> tuple:
    """Order in which sites are chosen: most people first, then as the caller orders them."""
    return (-r.people, r.first_here, r.s_lat, r.s_lon)


def _next_picks(frontier: list, sets: pa.Table, beyond, room: int, sure: bool) -> tuple[list, list]:
    """Greedy picks inside the frontier while they come before ``beyond``, the best bound outside it.

    Sites outside only lose, so a tie with ``beyond`` is won by the one that is first in order.
    The first pick needs no comparison if it is ``sure``, as the frontier leads an exact ranking of all
    sites.  Also returns the frontier with what each site would still add.
    """
    people, scale = _amounts(sets["people"])
    words = np.column_stack([sets[f"m{w}"].to_numpy() for w in range(WORDS)])
    reached = np.stack([(words[:, i // WORD_BITS] >> (i % WORD_BITS)) & 1 == 1 for i in range(len(frontier))], axis=1)
    gains = np.array([people[reached[:, i]].sum() for i in range(len(frontier))], dtype=people.dtype)
    order = [(r.first_here, r.s_lat, r.s_lon) for r in frontier]
    cut = 0 if beyond is None else int(beyond.people * scale)

    def amount(gain):
        return int(gain) if scale == 1 else Decimal(int(gain)) / scale

    picks: list = []
    while len(picks) < room:
        best = gains.max()
        if best <= 0:
            break
        at = min(np.flatnonzero(gains == best), key=lambda i: order[i])
        compared = beyond is not None and not (sure and not picks)
        if compared and (best < cut or best == cut and order[at] > (beyond.first_here, beyond.s_lat, beyond.s_lon)):
            break
        picks.append(_Pick(*_centers([frontier[at]])[0], frontier[at].first_here, amount(best)))
        taken = np.flatnonzero(reached[:, at] & (people != 0))
        for low in range(0, len(taken), SETS_AT_ONCE):
            part = taken[low:low + SETS_AT_ONCE]
            gains = gains - people[part] @ reached[part].astype(people.dtype)
        people[taken] = 0
    return picks, [_Pick(r.s_lat, r.s_lon, r.first_here, amount(g)) for r, g in zip(frontier, gains)]


class _Search:
    """Upper bounds of what every site adds, and the exact figures wherever they decide.

    ``base`` less ``losses`` are the scores after the first ``scored`` choices.  ``leaders`` are the best of
    them, corrected since by what the frontiers have shown; ``beyond`` is the best of all others.
    """

    def __init__(
        self, cache: FrameCache, areas: DataFrame, sites: DataFrame, radius_miles: float, order_by: str, population: str,
        lat: str, lon: str, options: SearchOptions,
    ) -> None:
        self.cache, self.grid, self.radius_miles, self.options = cache, Grid(radius_miles), radius_miles, options
        grid = self.grid
        located = cache.get("located", lambda: demand_points(areas, grid, population, lat, lon).sortWithinPartitions("block"))
        self.reach = cache.get("reach", lambda: site_reach_blocks(sites, grid, order_by, lat, lon))
        points, self.shape = _divided(cache, located, self.reach, options.leaf_points, options.most_pairs)
        self.keep = ["points" if self.shape.depth else "located", "reach"]
        self.points = cache.get("points", lambda: points) if self.shape.depth else located
        self.base = cache.get("base", lambda: _per_site(served(self.points, self.reach, radius_miles, self.shape)))
        self.losses: list[DataFrame] = []
        self.chosen: list = []
        self.leaders: list = []
        self.beyond = None
        self.scored = -1
        self.rounds = self.updates = self.checkpoints = 0

    def scores(self) -> DataFrame:
        """People each site would add now: the base less what sites near the chosen ones have lost.

        Losses touch few sites, so they are summed on their own and the base stays where it is.
        """
        if self.scored < len(self.chosen) and self.chosen:
            earlier, new = (_centers(part) for part in (self.chosen[:max(0, self.scored)], self.chosen[max(0, self.scored):]))
            name = f"loss {len(self.chosen)}"
            fresh = _newly_covered(self.points, self.grid, new, earlier)
            near = _sites_near(self.reach, self.grid, new)
            lost = _per_site(served(fresh, near, self.radius_miles, self.shape))
            self.losses.append(self.cache.get(name, lambda: lost))
        self.scored = len(self.chosen)
        if not self.losses:
            return self.base
        lost = _per_site(reduce(DataFrame.unionAll, self.losses)).select(
            "s_lat", "s_lon", F.col("people").alias("lost")
        )
        return self.base.join(lost, ["s_lat", "s_lon"], "left").select(
            *_SITE, (F.col("people") - F.coalesce("lost", F.lit(0))).alias("people")
        )

    def update(self) -> None:
        """Brings all scores up to date and fetches the leaders."""
        scores, most = self.scores(), PAGES * self.options.frontier_sites
        if len(self.losses) == CONSOLIDATE_ROUNDS:
            ensure_checkpoint_dir(self.reach.sparkSession)
            scores = self.base = scores.checkpoint()
            self.losses = []
            self.checkpoints += 1
            self.cache.drop_all_but(*self.keep)
        leading = (
            scores.where("people > 0").orderBy(F.desc("people"), "first_here", "s_lat", "s_lon").limit(most + 1).collect()
        )
        self.leaders, self.beyond = leading[:most], leading[most] if len(leading) > most else None
        self.updates += 1
        self.cache.drop_all_but(*self.keep, "base", *[n for n in self.cache.names() if n.startswith("loss")])

    def next_batch(self, room: int) -> list:
        """The next picks, at least one if any site adds people."""
        while True:
            exact = self.scored == len(self.chosen)
            behind = self.beyond is not None and (not self.leaders or _turn(self.beyond) < _turn(self.leaders[0]))
            if not exact and (behind or self.shape.signed or self.scored < 0):
                self.update()
                continue
            if not self.leaders:
                return []
            self.rounds += 1
            frontier, rest = self.leaders[:self.options.frontier_sites], self.leaders[self.options.frontier_sites:]
            beyond = min([*rest[:1], *filter(None, [self.beyond])], key=_turn, default=None)
            if exact and (self.shape.signed or room == 1 or beyond is None and len(frontier) == 1):
                return [_Pick(r.s_lat, r.s_lon, r.first_here, r.people) for r in frontier[:1]]
            sets = _frontier_sets(self.points, self.grid, frontier, _centers(self.chosen))
            picks, left = _next_picks(frontier, sets, beyond, room, exact)
            self.leaders = sorted([r for r in left if r.people > 0] + rest, key=_turn)
            if picks:
                return picks
            if self.leaders:
                self.update()


def greedy_cover(
    areas: DataFrame,
    sites: DataFrame,
    radius_miles: float = 2.0,
    k: int = 5,
    order_by: str = "site_id",
    population: str = "population",
    lat: str = "lat",
    lon: str = "lon",
    options: SearchOptions = SearchOptions(),
) -> Selection:
    """Chooses up to ``k`` sites, each time the one that covers most people not yet covered.

    Ties go to the site that comes first by ``order_by``; sites that add nobody
    are never chosen.  The driver sees only the frontier and its sets, whose
    number does not depend on the data, and one line per chosen site.
    """
    if k < 0:
        raise ValueError(f"k must be zero or more, got {k}")
    Grid(radius_miles)
    chosen: list = []
    rounds = updates = checkpoints = 0
    with FrameCache() as cache:
        if k:
            search = _Search(cache, areas, sites, radius_miles, order_by, population, lat, lon, options)
            while len(search.chosen) < k and (batch := search.next_batch(k - len(search.chosen))):
                search.chosen += batch
            chosen, rounds, updates, checkpoints = search.chosen, search.rounds, search.updates, search.checkpoints
    picked = _chosen_sites(sites, chosen, order_by, lat, lon)
    return Selection(picked, _centers(chosen), radius_miles, rounds, updates, checkpoints)


def remaining_gains(
    areas: DataFrame,
    sites: DataFrame,
    radius_miles: float,
    k: int,
    order_by: str = "site_id",
    population: str = "population",
    lat: str = "lat",
    lon: str = "lon",
    options: SearchOptions = SearchOptions(),
) -> DataFrame:
    """Each site with the people it would still add after ``k`` greedy picks, as ``gain``; 0 included."""
    if k < 0:
        raise ValueError(f"k must be zero or more, got {k}")
    ensure_checkpoint_dir(areas.sparkSession)
    sites = sites.checkpoint()
    with FrameCache() as cache:
        search = _Search(cache, areas, sites, radius_miles, order_by, population, lat, lon, options)
        while len(search.chosen) < k and (batch := search.next_batch(k - len(search.chosen))):
            search.chosen += batch
        scores = search.scores().checkpoint()
    return _with_gain(sites, scores, "gain", lat, lon)


def _with_gain(sites: DataFrame, scores: DataFrame, out: str, lat: str, lon: str) -> DataFrame:
    """All sites with the score of their location, 0 where there is none."""
    gains = scores.select("s_lat", "s_lon", F.col("people").alias("_gain"))
    here = (F.col(lat).cast("double") == F.col("s_lat")) & (F.col(lon).cast("double") == F.col("s_lon"))
    return (
        sites.join(gains, here, "left").withColumn(out, F.coalesce("_gain", F.lit(0))).drop("s_lat", "s_lon", "_gain")
    )


def _per_site(rows: DataFrame) -> DataFrame:
    by_place = rows.groupBy("s_lat", "s_lon").agg(F.min("first_here").alias("first_here"), F.sum("people").alias("people"))
    return by_place.select(*_SITE, "people")


def _centers(rows: list) -> list[tuple[float, float]]:
    return [(r.s_lat, r.s_lon) for r in rows]


def _chosen_sites(sites: DataFrame, chosen: list, order_by: str, lat: str, lon: str) -> DataFrame:
    """The chosen rows of ``sites`` with ``rank``, ``gain`` and ``cumulative_population``."""
    amount = T.LongType()
    if chosen and not isinstance(chosen[0].people, int):
        amount = T.DecimalType(38, 6)
    schema = (
        T.StructType()
        .add("rank", T.IntegerType())
        .add("_order", sites.schema[order_by].dataType)
        .add("_lat", T.DoubleType())
        .add("_lon", T.DoubleType())
        .add("gain", amount)
        .add("cumulative_population", amount)
    )
    total, rows = 0, []
    for rank, r in enumerate(chosen, 1):
        total += r.people
        rows.append((rank, r.first_here, r.s_lat, r.s_lon, r.people, total))
    picks = sites.sparkSession.createDataFrame(rows, schema)
    same = (
        (F.col(order_by) == F.col("_order"))
        & (F.col(lat).cast("double") == F.col("_lat"))
        & (F.col(lon).cast("double") == F.col("_lon"))
    )
    # Of several rows with the same order and place the one that sorts first counts.
    found = sites.join(F.broadcast(picks) if len(rows) <= MOST_SITES else picks, same).groupBy("rank", "gain", "cumulative_population")
    first = found.agg(F.min(F.struct(*sites.columns)).alias("_site"))
    return first.select("rank", "_site.*", "gain", "cumulative_population")


def flag_covered(
    areas: DataFrame, selection: Selection, out: str = "covered", lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """Adds a boolean per row: is this area within the radius of a chosen site."""
    if not selection.centers:
        return areas.withColumn(out, F.lit(False))
    grid = Grid(selection.radius_miles)
    usable = f"{lat} IS NOT NULL AND {lon} IS NOT NULL AND NOT isnan({lat}) AND NOT isnan({lon})"
    at = [f"CASE WHEN {usable} THEN cast({c} AS double) END AS {name}" for c, name in ((lat, "d_lat"), (lon, "d_lon"))]
    vector = [f"{v} AS d_{axis}" for v, axis in zip(unit_vector_sql("d_lat", "d_lon"), "xyz")]
    located = grid.locate(areas.selectExpr("*", *at).selectExpr("*", *vector), "d_lat", "d_lon", ("_block", "_row", "_col"))
    # One row per block with the centers that reach it, at most as many as were chosen.
    per_block = (
        _center_blocks(areas.sparkSession, grid, selection.centers)
        .groupBy(F.col("block").alias("_block"))
        .agg(F.collect_list(F.struct("c_lat", "c_lon", "c_x", "c_y", "c_z")).alias("_centers"))
    )
    hit = f"exists(_centers, c -> {within_sql(side('c.c_'), side('d_'), selection.radius_miles)})"
    per_block = F.broadcast(per_block) if len(selection.centers) <= MOST_SITES else per_block
    return located.join(per_block, "_block", "left").select(
        *areas.columns, F.coalesce(F.expr(hit), F.lit(False)).alias(out)
    )


def covered_keys(areas: DataFrame, selection: Selection, key: str = "geoid", **columns: str) -> DataFrame:
    """Distinct keys of the covered rows."""
    return flag_covered(areas, selection, **columns).where("covered").select(key).distinct()


def covered_areas(areas: DataFrame, selection: Selection, key: str = "geoid", **columns: str) -> DataFrame:
    """All rows of every covered key, including rows that are out of reach themselves."""
    return areas.join(covered_keys(areas, selection, key, **columns), key, "left_semi")


def coverage_summary(
    areas: DataFrame, selection: Selection, key: str = "geoid", population: str = "population", **columns: str
) -> DataFrame:
    """One row: total and covered population, percent covered and the number of sites.

    A key counts as covered with all its rows.  Rows are summed per key before
    the shuffle, so one key with very many rows is no burden.
    """
    per_key = (
        flag_covered(areas, selection, **columns)
        .groupBy(key)
        .agg(F.max("covered").alias("covered"), F.sum(_exact_amount(areas, population)).alias("people"))
    )
    total = F.coalesce(F.sum("people"), F.lit(0))
    covered = F.coalesce(F.sum(F.when(F.col("covered"), F.col("people"))), F.lit(0))
    return per_key.agg(total.alias("total_population"), covered.alias("covered_population")).select(
        "total_population",
        "covered_population",
        coverage_percent(F.col("covered_population"), F.col("total_population")).alias("coverage_percent"),
        F.lit(len(selection.centers)).alias("selected_count"),
    )


def coverage_percent(covered: Column, total: Column) -> Column:
    """Share in percent, 0 when there is nobody to cover."""
    share = F.try_divide(covered.cast("double"), total.cast("double")) * 100
    return F.when(total > 0, share).otherwise(0.0)


def run_coverage(
    areas: DataFrame,
    sites: DataFrame,
    affected: DataFrame | Iterable[str],
    radius_miles: float = 2.0,
    k: int = 5,
    site_types: Sequence[str] = DEFAULT_SITE_TYPES,
    **options,
) -> CoverageRun:
    """Filters areas and sites, chooses sites and measures the coverage they reach."""
    demand = keep_keys(areas, affected)
    selection = greedy_cover(demand, keep_types(sites, site_types), radius_miles, k, **options)
    return CoverageRun(coverage_summary(demand, selection), selection.sites, selection, demand)


def site_reach(
    areas: DataFrame,
    sites: DataFrame,
    radius_miles: float,
    order_by: str = "site_id",
    population: str = "population",
    lat: str = "lat",
    lon: str = "lon",
    options: SearchOptions = SearchOptions(),
) -> DataFrame:
    """Each site with the population it could serve alone, as ``reach_population``."""
    gains = remaining_gains(areas, sites, radius_miles, 0, order_by, population, lat, lon, options)
    return gains.withColumnRenamed("gain", "reach_population")
