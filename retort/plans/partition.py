"""Dividing numbered batches or items among ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strided(number: Column, ranks: int) -> Column:
    """Rank of a running number from 0: one after another."""
    return F.pmod(number, F.lit(ranks))


def contiguous(number: Column, total: Column, ranks: int) -> Column:
    """Rank of a running number from 0 out of ``total``: equal stretches, what is left goes to the last rank.

    Fewer items than ranks: everything goes to the last rank.
    """
    length = (total - total % ranks) / F.lit(ranks)
    part = F.when(length > 0, F.floor(number / length)).otherwise(F.lit(ranks - 1))
    return F.least(part.cast("bigint"), F.lit(ranks - 1).cast("bigint"))


def line_range(number: Column, total: Column, parts: int) -> Column:
    """Part of a running number when ``total`` is cut at ``floor(total * i / parts)``."""
    return F.least(F.floor(((number + 1) * parts - 1) / total), F.lit(parts - 1)).cast("bigint")
