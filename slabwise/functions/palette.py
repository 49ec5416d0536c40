"""Colours for labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The eight colours of the cycle, in order.
PALETTE = ("#E69F00", "#56B4E9", "#009E73", "#F0E442", "#0072B2", "#D55E00", "#CC79A7", "#332288")


def palette(n: int) -> list[str]:
    """n colours, the cycle repeated; none for n <= 0."""
    return [PALETTE[i % len(PALETTE)] for i in range(max(0, n))]


def colour(code: str | Column) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    return F.element_at(F.array(*(F.lit(c) for c in PALETTE)), (F.pmod(code, F.lit(len(PALETTE))) + 1).cast("int"))
