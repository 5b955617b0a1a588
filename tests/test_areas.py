from pyspark.sql import functions as F

from retort.operators import areas
from retort.plans import buckets, partition

SCHEMA = "x array<struct<idx:string,sub_areas:array<struct<idx:string,sub_areas:array<struct<idx:string,text:string>>>>>>"


def test_unindexed_areas_go_and_take_their_parents_along(spark):
    tree = [
        ("1", [("1", [("1", "a"), ("", "b"), None, (None, "c")]), (" ", [("1", "d")]), ("2", [("", "e")]), None]),
        ("2", [("1", [])]), (None, [("1", [("1", "f")])]), None, ("3", None),
    ]
    df = spark.createDataFrame([(tree,), (None,), ([],)], SCHEMA)
    got = [r.x for r in df.select(areas.indexed_areas(F.col("x")).alias("x")).collect()]
    assert [[t.idx for t in x] if x is not None else None for x in got] == [["1"], None, []]
    assert [(c.idx, [n.text for n in c.sub_areas]) for c in got[0][0].sub_areas] == [("1", ["a"])]


def test_scaling_rounds_half_to_even_and_stays_within_limits(spark):
    df = spark.createDataFrame([(5, 7, 20.0), (3000, 100, 40.0), (3000, 4000, 40.0), (4000, 3000, 40.0)], "w int, h int, ch double")
    got = [tuple(r) for r in df.select(areas.scaled_size(F.col("w"), F.col("h"), F.col("ch"), 10, 500, 400).alias("s")).select("s.w", "s.h").collect()]
    assert got == [(2, 4), (500, 17), (300, 400), (500, 375)]


def test_grid_edges_and_cells(spark):
    grid = buckets.Grid((130, 128, 3000))
    assert [grid.edges(a) for a in range(3)] == [[64, 128, 130], [128], [1024, 2048, 3000]]
    df = spark.createDataFrame([(1, 64, 128, 1024), (2, 65, 1, 1025), (3, 130, 128, 3000), (4, 131, 1, 1), (5, None, 1, 1), (6, 0, 0, 0)], "id bigint, d1 bigint, d2 bigint, d3 bigint")
    cell = {r.id: r.c for r in df.select("id", grid.cell(F.col("d1"), F.col("d2"), F.col("d3")).alias("c")).collect()}
    assert cell == {1: 0, 2: 4, 3: 8, 4: None, 5: None, 6: 0}


def test_bucket_counts_restart_after_each_kept_cell(spark):
    rows = [(i, 1, 1, 1, n) for i, n in enumerate([3, 0, 0, 5, 1, 0, 9])]
    df = spark.createDataFrame(rows, "cell bigint, d1 bigint, d2 bigint, d3 bigint, n bigint")
    kept = sorted(tuple(r) for r in buckets.kept_buckets(df, F.lit(4)).select("bucket", "cell", "held").collect())
    assert kept == [(0, 3, 8), (1, 6, 10)]


def test_padding_and_ranks(spark):
    placed = spark.createDataFrame([(i, 0 if i < 8 else 1) for i in range(13)], "doc_id bigint, bucket bigint")
    sized = spark.createDataFrame([(0, 2), (1, 2)], "bucket bigint, batch bigint")
    assert sorted((r.bucket, r.pad, r.n_padded) for r in buckets.padding(placed, sized, 2).collect()) == [(0, 4, 12), (1, 3, 8)]
    plan = buckets.batches(placed, sized, "doc_id")
    filled = buckets.fill_short(plan, sized, "doc_id").collect()
    assert len(filled) == 14 and [(r.doc_id, r.bucket, r.slot) for r in filled if r.filled] == [(0, 1, 1)]
    n = spark.range(10).select(partition.contiguous(F.col("id"), F.lit(10), 4).alias("a"), partition.contiguous(F.col("id"), F.lit(3), 4).alias("b"), partition.strided(F.col("id"), 4).alias("c")).collect()
    assert [r.a for r in n] == [0, 0, 1, 1, 2, 2, 3, 3, 3, 3] and {r.b for r in n} == {3} and [r.c for r in n] == [i % 4 for i in range(10)]
