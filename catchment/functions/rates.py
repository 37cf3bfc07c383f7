"""Rates and rounding with the semantics the demographic tables rely on."""

from __future__ import annotations


def rate_sql(numerator: str, denominator: str, on_zero: str = "zero", unit: str = "percent") -> str:
    """Share of the denominator; 0 where it cannot be computed.

    ``on_zero="inf"`` keeps a positive count over zero as infinity, and only 0/0
    and nulls become 0.
    """
    scale = {"percent": "100D", "fraction": "1D"}[unit]
    share = f"try_divide(cast({numerator} AS double), cast({denominator} AS double)) * {scale}"
    if on_zero == "zero":
        return f"coalesce({share}, 0D)"
    if on_zero == "inf":
        return (
            f"CASE WHEN {denominator} = 0 AND {numerator} > 0 THEN double('Infinity') "
            f"WHEN {denominator} = 0 AND {numerator} < 0 THEN double('-Infinity') ELSE coalesce({share}, 0D) END"
        )
    raise ValueError(f"on_zero must be 'zero' or 'inf', got {on_zero!r}")


def round_half_even_sql(value: str, digits: int = 2) -> str:
    """Scales, rounds half to even and scales back, which ``round`` does not."""
    factor = f"{10.0**digits!r}D"
    return f"rint({value} * {factor}) / {factor}"


def truncated_share_sql(value: str, share: float) -> str:
    """``value * share`` cut toward zero; the share must be a double, not a decimal."""
    return f"cast({value} * {share!r}D AS bigint)"


def number_or_null_sql(value: str, kind: str = "double") -> str:
    return f"try_cast({value} AS {kind})"


def number_or_zero_sql(value: str, kind: str = "bigint") -> str:
    return f"coalesce(try_cast({value} AS {kind}), cast(0 AS {kind}))"
