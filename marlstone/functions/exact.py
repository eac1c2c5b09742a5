"""Exact sums of doubles: whole numbers for each power of two, put together."""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import pyarrow as pa

#: A double is scaled to a whole number of at most two bits more than its own 53.
WHOLE_BITS = 52


def rounded(parts: list[tuple[int, int]]) -> float:
    """The double next to the sum of n * 2**p."""
    total = sum((Fraction(n) * Fraction(2) ** p for p, n in parts), Fraction(0))
    try:
        return total.numerator / total.denominator  # of whole numbers, Python rounds the quotient correctly
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")


def together(keys: list[str], out: str):
    def run(table: pa.Table) -> pa.Table:
        parts, odd = [], [x for x in table.column("_odd").to_pylist() if x is not None]
        for p, s in zip(table.column("_p").to_pylist(), table.column("_s").to_pylist(), strict=True):
            if p is not None and s is not None:
                parts.append((p, int(Decimal(s))))
        made = sum(odd) if odd else rounded(parts) if parts else None
        return pa.table([*(table.column(k).slice(0, 1) for k in keys), pa.array([made], pa.float64())], names=[*keys, out])

    return run
