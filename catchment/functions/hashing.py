"""Random numbers that depend on a seed, a stream name and a row id only.

The same row gets the same number whatever the partitioning, and a task that runs
again produces what it produced before.
"""

from __future__ import annotations

import math


def uniform_sql(seed: int, stream: str, row_id: str) -> str:
    """Uniform in [0, 1) from the first 32 bits of an MD5 digest."""
    digest = f"md5(concat('{seed}|{stream}|', cast({row_id} AS string)))"
    return f"cast(conv(substring({digest}, 1, 8), 16, 10) AS bigint) / {float(2**32)!r}D"


def between_sql(seed: int, stream: str, row_id: str, low: str, high: str) -> str:
    return f"({low} + ({high} - {low}) * ({uniform_sql(seed, stream, row_id)}))"


def normal_sql(seed: int, stream: str, row_id: str, mean: float, deviation: float) -> str:
    """Box-Muller transform of two uniform streams."""
    radius = f"sqrt(-2D * ln(1D - {uniform_sql(seed, stream + '-radius', row_id)}))"
    turn = f"cos({2 * math.pi!r}D * {uniform_sql(seed, stream + '-turn', row_id)})"
    return f"({mean!r}D + {deviation!r}D * {radius} * {turn})"
