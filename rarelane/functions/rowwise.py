"""Eight aggregates over the V columns of one row.

All are plain column arithmetic, so they stay inside one generated function.  A
NULL in any input makes every aggregate NULL except the two sign counts, which
count it as neither.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rarelane.functions.text import double, number

# Names and order of the engineered features.
ROW_AGGREGATES = [
    "Comp_Sum", "Comp_Min", "Comp_Max", "Comp_Avg",
    "Comp_Std", "Comp_Pos", "Comp_Neg", "Comp_Var",
]


def add_row_aggregates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Append the ``Comp_*`` columns computed over ``columns``."""
    if "Comp_Sum" in df.columns:
        return df
    if not columns:
        raise ValueError("row aggregates need at least one V column")
    v = [double(c) for c in columns]
    m = len(v)
    listed, total = ", ".join(v), " + ".join(v)
    whole = " AND ".join(f"{c} IS NOT NULL" for c in v)
    least, greatest = (f"{f}({listed})" if m > 1 else v[0] for f in ("least", "greatest"))
    first = df.selectExpr(
        "*",
        f"{total} AS Comp_Sum",
        f"CASE WHEN {whole} THEN {least} END AS Comp_Min",
        f"CASE WHEN {whole} THEN {greatest} END AS Comp_Max",
        f"({total}) / {number(m)} AS Comp_Avg",
        *[
            " + ".join(f"coalesce(cast({c} {sign} 0 as int), 0)" for c in v) + f" AS {name}"
            for name, sign in (("Comp_Pos", ">"), ("Comp_Neg", "<"))
        ],
    )
    spread = " + ".join(f"({c} - Comp_Avg) * ({c} - Comp_Avg)" for c in v)
    return (
        first.withColumn("Comp_Var", F.expr(f"({spread}) / {number(m)}"))
        .withColumn("Comp_Std", F.sqrt("Comp_Var"))
        .select(*df.columns, *ROW_AGGREGATES)
    )
