"""Connected components of a link table by union-find in tasks and star contraction.

Every task first shrinks its links to a forest with a union-find of one Arrow batch
at a time.  Then two contractions alternate until nothing changes: every node
hooks its larger neighbours to the smallest one it knows, and every node hooks
itself and its smaller neighbours to the smallest.  The smallest id of a
component ends up as its label.  Only a counter reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from catchment.llm.common import settled, with_key

LINKS = "u bigint, v bigint"


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links and the smallest node linked with each."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in zip(flat[:len(u)].tolist(), flat[len(u):].tolist()):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    top = np.fromiter((root(i) for i in range(len(nodes))), np.int64, len(nodes))
    return nodes, nodes[top]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            node, top = union_find(batch["u"].to_numpy(), batch["v"].to_numpy())
            tied = node != top
            yield pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(top[tied])], names=["u", "v"])


def _least(links: DataFrame) -> DataFrame:
    """The smallest neighbour ``m`` of every u, and with how many links it hangs together."""
    return links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _larger(links: DataFrame, n_links: int) -> DataFrame:
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        with_key(both, _least(both), "u", total=2 * n_links).where("v > u")
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
    )


def _smaller(links: DataFrame, n_links: int) -> DataFrame:
    least = _least(links)
    hooked = with_key(links, least, "u", total=n_links).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every linked node.

    ``links`` has the columns u and v in any order; loops and repeats do no harm.
    An empty table of links gives an empty result.  Nodes with more than a thousandth of all links meet
    them by broadcast, so no task holds a hub.  Rounds grow with the logarithm of the longest chain, which
    the union-find within tasks has shortened before.
    """
    current = settled(
        links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .mapInArrow(_forest, LINKS).distinct()
    )
    while (state := _state(current)).unsettled:
        # Hooking at most doubles the links, so a thousandth of those before is a bound as good.
        current = settled(_smaller(_larger(current, state.links), state.links))
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)


def _state(links: DataFrame) -> Row:
    """The number of links, and of nodes that hang on several others or on one that hangs itself: none in a set of stars."""
    child, parent = F.lit(1).alias("child"), F.lit(0).alias("parent")
    ends = links.select("u", child, parent).unionAll(
        links.select(F.col("v").alias("u"), F.lit(0).alias("child"), F.lit(1).alias("parent"))
    )
    seen = ends.groupBy("u").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return seen.agg(
        F.coalesce(F.sum("child"), F.lit(0)).alias("links"),
        F.count_if((F.col("child") > 1) | (F.col("child") == 1) & (F.col("parent") == 1)).alias("unsettled"),
    ).first()
