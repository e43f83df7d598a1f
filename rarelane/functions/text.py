"""Pieces of SQL text.

Expressions over many columns are handed to Spark as one text instead of
hundreds of Column objects, each of which costs a round trip to the JVM.
"""

from __future__ import annotations

import math


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def number(value: float) -> str:
    """A double literal that reads back to exactly ``value``."""
    value = float(value)
    if not math.isfinite(value):
        raise ValueError(f"{value} cannot be written as a number")
    return f"({value!r}D)"


def double(name: str) -> str:
    return f"cast({quoted(name)} as double)"
