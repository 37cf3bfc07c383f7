"""Mixing sources to target weights by capped water-filling.

A level rises over all sources at once, each gaining words in proportion to its weight,
until it holds as many repetitions as allowed; what it can't take goes to the
others by weight.  Sources sorted by size over weight saturate in that order, so
running sums over the table of sources give the level that repeated clamping and
resharing ends at, exactly in integers.  Sources are sorted in ranges, so their number may be large.

The target of a source is met with whole repetitions of all its documents and one
more of some: documents in a seeded order take one repetition each until the
rest is used up, and the document at the edge takes the remaining words only.  The order
is cut into ``SLICES`` slices by hash, slices are summed before any shuffle, and
only the slice at the edge is put in order, so a source with a third of all rows
is never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchment.llm.common import chosen, in_order, settled

WORD = r"[^\x20\x09-\x0D]+"
MOST_REPEATS = 3
WEIGHTS = (5, 2, 1)
SEED = 17
SLICES = 4096  # 16^3
MOST_BROADCAST = 100_000  # sources
SALTS = 16


def targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``source``, ``source_size``, ``target``, whole ``repeats`` and words ``extra`` per source.

    ``totals`` has one row per source, with its size.  Weights go round the sources by code
    point, null last.
    """
    by_name, _ = in_order(totals, [F.asc_nulls_last("source")])
    turn = (F.col("place") - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("bigint") for w in weights]), (turn + 1).cast("int"))
    named = by_name.withColumn("weight", weight).drop("place")
    full, sums = in_order(named, [F.col("source_size") / F.col("weight"), F.asc_nulls_last("source")], "source_size", "weight")
    level = full.withColumns({
        "cap": F.col("source_size") * most,
        "rest": F.lit(sums["source_size"]) - F.col("before_source_size") * most,
        "open_weight": F.lit(sums["weight"]) - F.col("before_weight"),
    })
    # As decimals, since sizes times the weights of very many sources pass 64 bits.
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("weight", "rest", "cap", "open_weight")}
    level = level.withColumn("clamped", wide["weight"] * wide["rest"] > wide["cap"] * wide["open_weight"])
    first_open = level.where(~F.col("clamped")).agg(F.min(F.struct("place", "rest", "open_weight")).alias("at")).first().at
    rest, open_weight = (first_open.rest, first_open.open_weight) if first_open else (0, 1)
    share = F.col("weight") * F.lit(rest) / F.lit(open_weight)
    target = F.when(F.col("clamped"), F.col("cap")).otherwise(share).cast("double")
    return (
        level.withColumn("target", F.coalesce(target, F.lit(0.0)))
        .withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("extra", F.floor(F.col("target") - F.col("repeats") * F.col("source_size") + 0.5).cast("bigint"))
        .select("source", "source_size", "weight", "target", "repeats", "extra")
    )


def seeded_order(seed: int, *ids: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(i.cast("string"), F.lit("")) for i in ids]))


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _slice(turn: str) -> Column:
    return F.conv(F.substring(turn, 1, 3), 16, 10).cast("int")


def _placed(docs: DataFrame, weights: Sequence[int], most: int, seed: int) -> DataFrame:
    """Rows with size, turn, the plan of their source, and ``more``: words of the last repetition."""
    sized = settled(docs.select("doc_id", "source", word_count("text").alias("size"), seeded_order(seed, F.col("doc_id")).alias("turn")))
    sized = sized.withColumn("slice", _slice("turn"))
    slices = settled(sized.groupBy("source", "slice").agg(F.sum("size").alias("words")))
    plan = settled(targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most))

    renamed = plan.withColumnRenamed("source", "of_source")
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        slices.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(renamed, F.col("source").eqNullSafe(F.col("of_source")))
        .where("before < extra AND extra <= before + words")
        .select(F.col("of_source").alias("edge_source"), F.col("slice").alias("edge"), (F.col("extra") - F.col("before")).alias("left_over"))
    )
    full_plan = renamed.join(edge, F.col("of_source").eqNullSafe(F.col("edge_source")), "left").drop("edge_source")
    placed = _with_plan(sized, settled(full_plan))

    in_turn = Window.partitionBy("source", "slice").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("size").over(in_turn), F.lit(0))
    at_edge = placed.where("slice = edge").withColumn("more", F.greatest(F.lit(0), F.least("size", F.col("left_over") - used)))
    beside = placed.where("edge IS NULL OR slice != edge").withColumn("more", F.when(F.col("slice") < F.col("edge"), F.col("size")).otherwise(0))
    return at_edge.unionByName(beside)


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED,
) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``taken`` of every row.

    Size is the number of words; a null or empty text has none and takes none.  A null source
    is a source of its own.  Repeated rows count each.  Rows with equal ids are ordered by
    size.  An empty table gives an empty result.  Other columns of ``docs`` are not looked at.
    """
    docs = chosen(docs, doc_id=(id_col, "bigint"), text=(text_col, "string"), source=(source_col, "string"))
    return _placed(docs, weights, most, seed).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("repeats") * F.col("size") + F.col("more")).cast("bigint").alias("taken")
    )


def repeat_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes them.

    Rows come whole: the document at the edge of a source's target is taken if at least half of
    it is.  Rows that the mix takes no word of go, but rows without words stay once.
    """
    named = chosen(docs, doc_id=(id_col, "bigint"), text=(text_col, "string"), source=(source_col, "string"))
    placed = _placed(named, weights, most, seed)
    last = F.max(F.when((F.col("size") > 0) & (2 * F.col("more") >= F.col("size")), F.struct("turn", "doc_id", "size")))
    plan = settled(placed.groupBy(F.col("source").alias("of_source")).agg(F.first("repeats").alias("repeats"), last.alias("last")))

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    doc_id, text, source = (F.col(f"`{c}`").cast(kind) for c, kind in ((id_col, "bigint"), (text_col, "string"), (source_col, "string")))
    rows = docs.select(row, doc_id.alias("doc_id"), source.alias("source"), word_count(text).alias("size"), seeded_order(seed, doc_id).alias("turn"))
    rows = _with_plan(rows.withColumn("slice", _slice("turn")), plan)
    once_more = F.coalesce((F.struct("turn", "doc_id", "size") <= F.col("last")).cast("int"), F.lit(0))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("repeats") + once_more).cast("int")
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), copies))).select("row.*")


def _with_plan(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with the plan of their source; many sources are joined by source and salt, as one may be hot."""
    same = F.col("source").eqNullSafe(F.col("of_source"))
    if plan.count() <= MOST_BROADCAST:
        return sized.join(F.broadcast(plan), same).drop("of_source")
    salts = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = sized.withColumn("of_salt", F.col("slice") % SALTS)
    return salted.join(salts, same & (F.col("salt") == F.col("of_salt"))).drop("of_source", "salt", "of_salt")


def mixing_sql(seed: int = SEED) -> str:
    """The same as one query over ``documents``."""
    return f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS turn
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM totals
), level AS (
  SELECT *, sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
         row_number() OVER o AS place
  FROM weighed WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)
), judged AS (
  SELECT *, weight * rest > 3 * source_size * open_weight AS clamped FROM level
), first_open AS (
  SELECT rest, open_weight FROM judged WHERE NOT clamped ORDER BY place LIMIT 1
), plan AS (
  SELECT j.source, j.source_size,
         CASE WHEN clamped THEN (3 * source_size)::DOUBLE ELSE (j.weight * f.rest)::DOUBLE / f.open_weight::DOUBLE END AS target
  FROM judged j, first_open f
), split AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats FROM plan
), placed AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, s.repeats, d.source,
         floor(s.target - s.repeats * s.source_size + 0.5)::BIGINT AS extra,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM sized d JOIN split s ON d.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, source, size, source_size, target,
       (repeats * size + greatest(0, least(size, extra - used)))::BIGINT AS taken
FROM placed"""
