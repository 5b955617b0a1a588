"""Size buckets, batches and padding for items of three sizes.

The grid of cells, the counts of its cells and the buckets are small whatever the
data; items meet them by the cell's number, which arithmetic gives, never by a
range join over items.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.operators.numbering import number_rows


@dataclass(frozen=True)
class Grid:
    """Limits and steps of the three sizes; a size's last cell ends at its limit."""

    limits: tuple[int, int, int]
    steps: tuple[int, int, int] = (64, 128, 1024)

    def edges(self, axis: int) -> list[int]:
        limit, step = self.limits[axis], self.steps[axis]
        return [*range(step, limit, step), limit] if limit > 0 else []

    def cell(self, *sizes: Column) -> Column:
        """Number of the first cell that holds the sizes; null beyond the limits or for a null size."""
        index, fits = F.lit(0).cast("bigint"), F.lit(True)
        for axis, size in enumerate(sizes):
            fits &= size <= self.limits[axis]
            at = F.greatest(F.ceil(size / F.lit(float(self.steps[axis]))).cast("bigint") - 1, F.lit(0).cast("bigint"))
            index = index * len(self.edges(axis)) + at
        return F.when(fits, index)


def size_limits(items: DataFrame, sizes: list[str], most: tuple[int, int, int]) -> tuple[int, int, int]:
    """The greatest sizes of the items, within ``most``: one row, read by the driver."""
    row = items.agg(*(F.max(c).alias(c) for c in sizes)).first()
    return tuple(min(m, int(row[c] or 0)) for c, m in zip(sizes, most))


def grid_cells(items: DataFrame, grid: Grid) -> DataFrame:
    """(cell, d1, d2, d3): the cells of the grid in order."""
    edges = [grid.edges(a) or [0] for a in range(3)]
    n = [len(e) for e in edges]
    cells = items.sparkSession.range(0, n[0] * n[1] * n[2], numPartitions=1).withColumnRenamed("id", "cell")
    at = [F.expr(f"cell div {n[1] * n[2]}"), F.expr(f"(cell div {n[2]}) % {n[1]}"), F.expr(f"cell % {n[2]}")]
    sizes = [F.get(F.lit(e), i.cast("int")).cast("bigint").alias(f"d{k}") for k, (e, i) in enumerate(zip(edges, at), 1)]
    return cells.select("cell", *sizes)


def cell_counts(items: DataFrame, grid: Grid, sizes: list[str]) -> DataFrame:
    """(cell, d1, d2, d3, n): how many items fall into each cell; empty cells count 0."""
    counts = items.select(grid.cell(*map(F.col, sizes)).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    cells = grid_cells(items, grid)
    return cells.join(counts, "cell", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def kept_buckets(counts: DataFrame, threshold: Column) -> DataFrame:
    """(bucket, cell, d1, d2, d3, held): cells at which the items counted since the last kept cell reach the threshold.

    The running count starts afresh after each kept cell, which no window can
    express: the cells, few and in order, are folded in one array.
    """
    ordered = F.array_sort(F.collect_list(F.struct("cell", "d1", "d2", "d3", "n")))
    row = counts.agg(ordered.alias("cells"), F.sum("n").alias("total")).withColumn("threshold", threshold)
    start = F.struct(F.lit(0).cast("bigint").alias("m"), F.filter(F.transform("cells", lambda c: c["cell"]), lambda c: F.lit(False)).alias("at"), F.filter(F.transform("cells", lambda c: c["n"]), lambda c: F.lit(False)).alias("held"))

    def step(s: Column, c: Column) -> Column:
        m = s["m"] + c["n"]
        keep = m >= F.col("threshold")
        return F.struct(
            F.when(keep, F.lit(0).cast("bigint")).otherwise(m).alias("m"),
            F.when(keep, F.concat(s["at"], F.array(c["cell"]))).otherwise(s["at"]).alias("at"),
            F.when(keep, F.concat(s["held"], F.array(m))).otherwise(s["held"]).alias("held"),
        )

    folded = row.withColumn("fold", F.aggregate("cells", start, step))
    kept = folded.select(F.posexplode(F.arrays_zip(F.col("fold.at").alias("cell"), F.col("fold.held").alias("held"))).alias("bucket", "k"))
    cells = counts.select("cell", "d1", "d2", "d3")
    return kept.select(F.col("bucket").cast("bigint").alias("bucket"), "k.cell", "k.held").join(cells, "cell").select("bucket", "cell", "d1", "d2", "d3", "held")


def batch_sizes(buckets: DataFrame, max_area: int, max_batch: int) -> DataFrame:
    """``buckets`` with ``batch``: as many items as the area allows, at most ``max_batch``; buckets of none are left out."""
    size = F.least(F.expr(f"{max_area} div (d1 * d2)"), F.lit(max_batch).cast("bigint"))
    return buckets.withColumn("batch", size).filter(F.col("batch") > 0)


def first_fit(items: DataFrame, buckets: DataFrame, grid: Grid, sizes: list[str]) -> DataFrame:
    """``items`` with ``bucket``: the first bucket that is large enough in all sizes, null if none is.

    Which bucket a cell's items take is worked out once for each cell.
    """
    placed = items.withColumn("_cell", grid.cell(*map(F.col, sizes)))
    cells = grid_cells(items, grid)
    b = buckets.select("bucket", *(F.col(f"d{i}").alias(f"b{i}") for i in (1, 2, 3)))
    # Cells by buckets: both bounded by the grid.
    fits = (F.col("d1") <= F.col("b1")) & (F.col("d2") <= F.col("b2")) & (F.col("d3") <= F.col("b3"))
    first = cells.join(F.broadcast(b), fits).groupBy(F.col("cell").alias("_cell")).agg(F.min("bucket").alias("bucket"))
    return placed.join(first, "_cell", "left").drop("_cell")


def batches(placed: DataFrame, buckets: DataFrame, id_col: str, parts: int = 32) -> DataFrame:
    """(id_col, bucket, batch_no, slot): items of each bucket in batches, in the order of (id mod parts, id)."""
    held = placed.filter(F.col("bucket").isNotNull()).select(id_col, "bucket")
    # Stretches of ids below the remainder, so that a large bucket is numbered in as many parts as it needs.
    part = F.struct(F.pmod(F.col(id_col), F.lit(parts)).alias("remainder"), F.floor(F.col(id_col) / F.lit(1 << 20)).alias("stretch"))
    numbered = number_rows(held, part, [id_col], group=["bucket"])
    sized = numbered.join(buckets.select("bucket", "batch"), "bucket")
    return sized.select(id_col, "bucket", F.expr("number div batch").alias("batch_no"), F.expr("number % batch").alias("slot"))


def padding(placed: DataFrame, buckets: DataFrame, world: int) -> DataFrame:
    """(bucket, n, batch, pad, n_padded): copies that make each bucket a multiple of world times batch.

    A bucket that already is one gets a full further multiple.
    """
    counts = placed.filter(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count("*").alias("n"))
    all_of = counts.join(buckets.select("bucket", "batch"), "bucket")
    pad = F.col("batch") * world - F.col("n") % (F.col("batch") * world)
    return all_of.select("bucket", "n", "batch", pad.alias("pad"), (F.col("n") + pad).alias("n_padded"))


def fill_short(plan: DataFrame, buckets: DataFrame, id_col: str) -> DataFrame:
    """``plan`` with ``filled``: false for its rows, true for rows added to fill each short last batch.

    The added items are those of the first bucket in use, in their order, from
    its start again and again.
    """
    last = plan.groupBy("bucket", "batch_no").agg(F.count("*").alias("n")).join(buckets.select("bucket", "batch"), "bucket")
    short = last.filter("n < batch").select("bucket", "batch_no", F.explode(F.expr("sequence(n, batch - 1)")).alias("slot"), "n")
    first = plan.join(plan.agg(F.min("bucket").alias("bucket")), "bucket", "left_semi").join(buckets.select("bucket", "batch"), "bucket")
    donors = first.select(F.col(id_col), (F.col("batch_no") * F.col("batch") + F.col("slot")).alias("donor"))
    total = donors.agg(F.count("*").alias("n_donors"))
    need = short.join(F.broadcast(total)).withColumn("donor", (F.col("slot") - F.col("n")) % F.col("n_donors"))  # total is one row
    added = need.join(donors, "donor").select(id_col, "bucket", "batch_no", "slot", F.lit(True).alias("filled"))
    return plan.withColumn("filled", F.lit(False)).select(added.columns).unionByName(added)


def batch_shapes(plan: DataFrame, items: DataFrame, id_col: str, sizes: list[str], multiple: int = 32) -> DataFrame:
    """(bucket, batch_no, n_items, one column a size): each batch's greatest sizes, rounded up to a multiple."""
    up = lambda c: (F.ceil(F.max(c) / F.lit(float(multiple))) * multiple).cast("bigint").alias(c)
    return plan.join(items, id_col).groupBy("bucket", "batch_no").agg(F.count("*").alias("n_items"), *map(up, sizes))
