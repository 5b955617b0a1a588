"""Cleaning and measuring nested areas; built-in expressions, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_index(area: Column) -> Column:
    """Whether an area exists and its idx is more than blanks."""
    return F.coalesce(area.isNotNull() & (F.trim(area["idx"]) != ""), F.lit(False))


def indexed_areas(topics: Column) -> Column:
    """Topics without unindexed lines, then without columns and topics that are unindexed or have nothing left.

    A null array stays null.
    """
    lines = lambda column: F.filter(column["sub_areas"], has_index)
    columns = lambda topic: F.filter(F.transform(topic["sub_areas"], lambda c: c.withField("sub_areas", lines(c))), lambda c: has_index(c) & (F.size(c["sub_areas"]) > 0))
    cleaned = F.transform(topics, lambda t: t.withField("sub_areas", columns(t)))
    return F.filter(cleaned, lambda t: has_index(t) & (F.size(t["sub_areas"]) > 0))


def line_height(lines: Column) -> Column:
    """Mean height of lines, weighted by their characters; null without characters."""
    total = lambda f: F.aggregate(lines, F.lit(0.0), lambda s, x: s + F.coalesce(f(x), F.lit(0)).cast("double"))
    n = total(lambda x: x["char_len"])
    return F.when(n > 0, total(lambda x: x["h"] * x["char_len"]) / n)


def scaled_size(w: Column, h: Column, char_height: Column, norm: float, max_w: int, max_h: int) -> Column:
    """Struct of w, h and scale: sizes brought to characters of height ``norm``, then into the limits.

    Where both sizes exceed their limits, the larger one decides.  Roundings are
    half to even.
    """
    ratio = F.lit(float(norm)) / char_height
    sw, sh = F.bround(w * ratio).cast("bigint"), F.bround(h * ratio).cast("bigint")
    tall, wide = F.lit(float(max_h)) / sh, F.lit(float(max_w)) / sw
    clip = (
        F.when((sh > max_h) & (sw > max_w), F.when(sh > sw, tall).otherwise(wide)).when(sh > max_h, tall).when(sw > max_w, wide).otherwise(F.lit(1.0))
    )
    return F.struct(F.bround(sw * clip).cast("bigint").alias("w"), F.bround(sh * clip).cast("bigint").alias("h"), (ratio * clip).alias("scale"))


def places(items: Column, wanted) -> Column:
    """Positions from 0 of the entries for which ``wanted`` holds."""
    numbered = F.transform(items, lambda t, i: F.when(wanted(t), i))
    return F.filter(numbered, lambda i: i.isNotNull())


def is_memory(token: Column) -> Column:
    """Super-atoms and contracted bonds, which a sequence refers back to."""
    return token.contains("\\Superatom") | token.contains("@")


def is_bond(token: Column) -> Column:
    """Bonds with an angle, and ends of hooks."""
    return (token.contains("[:") & token.endswith("]")) | (token.startswith("?[") & token.endswith("]") & token.contains(","))
