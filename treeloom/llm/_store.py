"""Names and joins of text operators, and the tables of treeloom.store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.store import discard, materialise, release, shared_folder  # noqa: F401  for operators and callers


def own_name(name: str, columns: list[str]) -> str:
    """name with as many signs more as it takes to be none of columns (which Spark compares without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes up to which a side of a join is sent to every executor.
BROADCAST = 8 << 20


def sized(df: DataFrame, row_bytes: Column) -> DataFrame:
    """df, a written table, with the hint to broadcast it if its measured size allows; else it is joined by a shuffle."""
    total = df.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST else df
