"""Reproducible randomness.

Every random choice is read off an md5 digest of ``stage|seed|key``.  The digest
depends on the row's key only, so a lost task redraws the same values, the
partitioning has no influence, and plain SQL can repeat the draw.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Digits read from the digest for one uniform draw, and their value range.
DRAW_DIGITS = 8
DRAW_RANGE = float(16**DRAW_DIGITS)


def order_hash(stage: str, seed: int | str, key: Sequence[str]) -> Column:
    """Hex digest that puts rows in a random but repeatable order."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in key]
    return F.md5(F.concat_ws("|", F.lit(stage), F.lit(str(seed)), *parts))


def unit_draw(stage: str, seed: int | str, *parts: Column) -> Column:
    """Uniform double in [0, 1)."""
    text = F.concat_ws("|", F.lit(stage), F.lit(str(seed)), *[p.cast("string") for p in parts])
    digits = F.substring(F.md5(text), 1, DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(DRAW_RANGE)
