"""Equi-joins whose tasks stay small however many rows of either side share a key."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pairs of rows that one task may test for a single key.
MOST_PAIRS = 100_000_000
# Equal rows that one row of a class stands for at most.
MOST_COPIES = 1000
# Rows that the parts of one side of a key add to the other one, per row of the key.
MOST_REPEATS = 4
# Pairs that one task of a join tests on average, and how many tasks there are at most.
TASK_PAIRS = 4_000_000
MOST_TASKS = 4000
# Crowded keys that are broadcast to both sides of a join at most.
FEW_KEYS = 100_000


def key_counts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of each key on both sides, as ``_left`` and ``_right``, from one aggregation."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return (
        left.select(*keys, one.alias("_left"), none.alias("_right"))
        .unionAll(right.select(*keys, none.alias("_left"), one.alias("_right")))
        .groupBy(*keys).agg(F.sum("_left").alias("_left"), F.sum("_right").alias("_right"))
    )


def key_parts(
    left: DataFrame, right: DataFrame, keys: Sequence[str], most_pairs: int = MOST_PAIRS, most_repeats: int | None = None
) -> DataFrame:
    """Keys with more than ``most_pairs`` pairs, and into how many parts each side of them is cut."""
    return cut_keys(key_counts(left, right, keys), keys, most_pairs, most_repeats)


def cut_keys(counted: DataFrame, keys: Sequence[str], most_pairs: int, most_repeats: int | None = None) -> DataFrame:
    """The same from the counts of ``key_counts``.

    Parts are square where both sides are long, which repeats the fewest rows; a short side stays
    whole.  Without ``most_repeats`` no pair of parts has more than ``most_pairs`` pairs, and the
    repeated rows grow with the pairs.  With it, the parts of either side add at most that many rows per row
    of the key, so repeated rows grow with the rows; the pairs of very long keys then meet in larger parts.
    """

    def parts(own: str, other: str):
        longest = F.greatest(F.lit(math.sqrt(most_pairs)), F.lit(float(most_pairs)) / F.col(other))
        number = F.ceil(F.col(own) / longest)
        if most_repeats is not None:
            bound = F.floor(F.lit(float(most_repeats)) * (F.col(own) + F.col(other)) / F.col(other))
            number = F.least(number, F.greatest(bound, F.lit(1).cast("bigint")))
        return number.cast("int")

    return counted.where(F.col("_left") * F.col("_right").cast("double") > most_pairs).select(
        *keys, parts("_left", "_right").alias("_left_parts"), parts("_right", "_left").alias("_right_parts")
    )


def class_counts(left: DataFrame, right: DataFrame, keys: Sequence[str], most: int = MOST_COPIES) -> DataFrame:
    """Rows of each key on both sides, as ``_left_rows`` and ``_right_rows``, and about how many ``classes`` they are, as ``_left`` and ``_right``.

    The number of different rows comes from sketches, so no row is moved for it.
    """
    def row(df: DataFrame):
        return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])

    def number(rows: str):
        return F.least(F.count(rows), F.approx_count_distinct(rows) + F.expr(f"count({rows}) DIV {most}"))

    none = F.lit(None).cast("bigint")
    rows = left.select(*keys, row(left).alias("_l"), none.alias("_r")).unionAll(right.select(*keys, none.alias("_l"), row(right).alias("_r")))
    return rows.groupBy(*keys).agg(
        F.count("_l").alias("_left_rows"), F.count("_r").alias("_right_rows"), number("_l").alias("_left"), number("_r").alias("_right")
    )


def with_cells(parts: DataFrame, counted: DataFrame, keys: Sequence[str], most_pairs: int, most_repeats: int | None = None) -> DataFrame:
    """Parts with ``_left_cells`` and ``_right_cells``, into which their rows are dealt; the parts of a cell meet in one task.

    There are as many as keys of ``most_pairs`` would be cut into, so small parts repeat no rows that are moved.
    """
    cells = cut_keys(counted, keys, most_pairs, most_repeats).selectExpr(*keys, "_left_parts AS _l", "_right_parts AS _r")
    return parts.join(cells, list(keys), "left").selectExpr(
        *parts.columns, "least(coalesce(_l, 1), _left_parts) AS _left_cells", "least(coalesce(_r, 1), _right_parts) AS _right_cells"
    )


def few(table: DataFrame) -> DataFrame:
    """A settled table of keys, broadcast if a count finds up to ``FEW_KEYS``; so rows are not moved to be told apart by it."""
    return F.broadcast(table) if table.limit(FEW_KEYS + 1).count() <= FEW_KEYS else table


def task_number(counted: DataFrame) -> int:
    """Into how many tasks a join is dealt, by its pairs; the size of its rows tells little of its work."""
    pairs = counted.agg(F.sum(F.col("_left") * F.col("_right").cast("double"))).first()[0] or 0.0
    return max(1, min(MOST_TASKS, math.ceil(pairs / TASK_PAIRS)))


def classes(df: DataFrame, parts: DataFrame, keys: Sequence[str], side: str, most: int = MOST_COPIES) -> DataFrame:
    """Rows of the keys in ``parts`` as classes: one row for up to ``most`` equal ones, with their number.

    Adds ``_<side>_copies`` and ``_<side>_class``, which tells classes of equal rows apart.  All other rows are
    classes of their own and are not moved.
    """
    names = [f"`{c}`" for c in df.columns]
    hot = merged_copies(df.join(parts.select(*keys), list(keys), "left_semi").select(*names), side, most)
    rest = df.join(parts.select(*keys), list(keys), "left_anti")
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return rest.select(*names, one.alias(f"_{side}_copies"), none.alias(f"_{side}_class")).unionAll(hot)


def merged_copies(df: DataFrame, side: str, most: int = MOST_COPIES) -> DataFrame:
    """All rows as such classes."""
    names = [f"`{c}`" for c in df.columns]
    numbered = df.groupBy(*names).agg(F.count("*").alias("_n")).withColumn("_class", F.expr(f"explode(sequence(0L, (_n - 1) DIV {most}))"))
    return numbered.select(*names, F.expr(f"least({most}L, _n - _class * {most}L)").alias(f"_{side}_copies"), F.col("_class").alias(f"_{side}_class"))


def _as_it_is(df: DataFrame) -> DataFrame:
    return df


Step = Callable[[DataFrame], DataFrame]


def split_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_by: Sequence[str],
    right_by: Sequence[str],
    parts: DataFrame | None = None,
    tasks: int = 1,
    keep_parts: bool = False,
    then: tuple[Step, Step] = (_as_it_is, _as_it_is),
) -> DataFrame:
    """Inner equi-join in which the keys named by ``key_parts`` are cut into parts on both sides.

    The part comes from a hash of the ``by`` columns, so a retried task places each row
    where the first attempt did.  Every part of a key meets every part of the other
    side once.  Copies of one row share a part, so where there may be many, join ``classes``.
    With more than one of ``tasks`` the rows are dealt to that many, whatever their size in bytes.
    Where the parts come ``with_cells``, rows are moved once for each cell of the other side and repeated for its parts
    afterwards; ``_task`` is kept with the parts then.  ``then`` is done with the rows of either side once they are moved.
    """
    if parts is None:
        return dealt_join(left, right, keys, tasks, then=then)
    celled = "_left_cells" in parts.columns
    names = [c for c in parts.columns if c not in keys]

    def cut(df: DataFrame, by: Sequence[str], own: str, other: str) -> DataFrame:
        number = F.expr(f"cast(pmod(xxhash64({', '.join(by)}), coalesce(_{own}_parts, 1)) AS int)")
        every = F.expr(f"explode(sequence(0, coalesce(_{other}_{'cells' if celled else 'parts'}, 1) - 1))")
        rows = df.join(parts, list(keys), "left").withColumn(f"_{own}_part", number)
        if not celled:
            return rows.withColumn(f"_{other}_part", every).drop(*names)
        rows = rows.withColumn(f"_{own}_cell", F.expr(f"_{own}_part % coalesce(_{own}_cells, 1)")).withColumn(f"_{other}_cell", every)
        task = F.expr(f"pmod(hash({', '.join(keys)}, _left_cell, _right_cell), {max(1, tasks)})")
        last, step = F.expr(f"coalesce(_{other}_parts, 1) - 1"), F.expr(f"coalesce(_{other}_cells, 1)")
        return rows.withColumns({"_task": task, "_last": last, "_step": step}).drop(*names, f"_{own}_cell")

    def repeated(step: Step, other: str) -> Step:
        every = F.expr(f"explode(sequence(_{other}_cell, _last, _step))")
        return lambda rows: step(rows).withColumn(f"_{other}_part", every).drop(f"_{other}_cell", "_last", "_step")

    a, b = cut(left, left_by, "left", "right"), cut(right, right_by, "right", "left")
    pieces = ["_left_part", "_right_part"]
    if not celled:
        met = dealt_join(a, b, [*keys, *pieces], tasks, then=then)
        return met if keep_parts else met.drop(*pieces)
    met = dealt_join(a, b, ["_task", *keys, *pieces], tasks, "_task", (repeated(then[0], "right"), repeated(then[1], "left")))
    return met if keep_parts else met.drop("_task", *pieces)


def dealt_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], tasks: int, to: str | None = None, then: tuple[Step, Step] = (_as_it_is, _as_it_is)
) -> DataFrame:
    """Inner equi-join whose rows are dealt to ``tasks``, by all columns or to the one numbered by a column; one task leaves it to Spark."""
    if tasks <= 1:
        return then[0](left).join(then[1](right), list(on))
    a, b = (df.repartitionById(tasks, F.col(to)) if to else df.repartition(tasks, *on) for df in (left, right))
    return then[0](a).join(then[1](b).hint("merge"), list(on))
