"""One row for each key: the first or the last that arrived.

Both are aggregations, not windows: repeats are reduced before the shuffle, so a
key that holds a large share of all rows costs no more than others.  A null key
is a key of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    rank = F.struct(*order)
    best = df.groupBy(*keys).agg(pick(F.struct(*others), rank).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is least by ``order``."""
    return _pick(df, keys, order, F.min_by)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by ``order``."""
    return _pick(df, keys, order, F.max_by)
