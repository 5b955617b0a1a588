"""Running numbers without a single task that holds all rows or a hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def number_rows(df: DataFrame, part: Column, order: list[str], group: list[str] | None = None, name: str = "number", block: Column | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, … within each ``group`` in the order of ``part``, then ``order``.

    ``part`` cuts every group into pieces that are numbered side by side; the
    pieces' sizes, few rows, give what to add.  It must not contradict the
    order wanted: rows of a lower part come first.  ``block``, made of ``_part`` and
    in its order, adds a level: the parts of a block are added up by themselves,
    so that no task sees the sizes of all parts.
    """
    group = group or []
    parted = df.withColumn("_part", part)
    sizes = parted.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = lambda part, *within: F.coalesce(F.sum("_n").over(W.partitionBy(*group, *within).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    if block is None:
        starts = sizes.withColumn("_before", before("_part")).drop("_n")
    else:
        sizes = sizes.withColumn("_block", block)
        blocks = sizes.groupBy(*group, "_block").agg(F.sum("_n").alias("_n")).withColumn("_first", before("_block")).drop("_n")
        inner = sizes.withColumn("_before", before("_part", "_block")).drop("_n")
        found = inner.join(blocks, [inner[k].eqNullSafe(blocks[k]) for k in [*group, "_block"]])
        starts = found.select(*(inner[k] for k in [*group, "_part"]), (inner["_before"] + blocks["_first"]).alias("_before"))
    within = F.row_number().over(W.partitionBy(*group, "_part").orderBy(*order)) - 1
    numbered = parted.withColumn("_within", within)
    keys = [*group, "_part"]
    match = [numbered[k].eqNullSafe(starts[k]) for k in keys]
    joined = numbered.join(starts, match, "left")
    return joined.select(*(numbered[c] for c in df.columns), (F.col("_before") + F.col("_within")).cast("bigint").alias(name))
