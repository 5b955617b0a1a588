from retort.operators.nested import area_nodes, area_table, record_table

LINE = "struct<idx:string,text:string,raw_info:struct<text:string>>"
COLUMN = f"struct<idx:string,text:string,raw_info:struct<text:string>,sub_areas:array<{LINE}>>"
SCHEMA = f"record_id bigint, src_image_path string, image_path string, sub_areas array<struct<idx:string,text:string,raw_info:struct<text:string>,sub_areas:array<{COLUMN}>>>, loaded_at timestamp, level string"


def test_paths_nulls_repeats_and_empty(spark):
    import datetime as dt

    early, late = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    line = lambda t: ("9", t, (t + "raw",))
    tree = [None, ("0", "t", None, [("0", None, (None,), [line("a"), None, line("b")]), ("1", "c", None, None), None]), ("0", None, None, [])]
    rows = [
        (1, "s", "i", tree, early, "clash"), (1, "s", "i", tree, late, "clash"), (2, None, None, None, early, None),
        (3, None, None, [], early, None), (4, None, None, [None], early, None), (None, None, None, tree[1:2], early, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.record_id or 0, r.level, r.area_path, r.parent_path, r.text, r.raw_text) for r in area_nodes(df).collect())
    one = [(1, "1", "", "t", None), (1, "2", "", None, None), (2, "1-0", "1", None, None), (2, "1-1", "1", "c", None), (3, "1-0-0", "1-0", "a", "araw"), (3, "1-0-2", "1-0", "b", "braw")]
    nul = [(1, "0", "", "t", None), (2, "0-0", "0", None, None), (2, "0-1", "0", "c", None), (3, "0-0-0", "0-0", "a", "araw"), (3, "0-0-2", "0-0", "b", "braw")]
    assert got == sorted([(1, *x) for x in one] + [(0, *x) for x in nul], key=lambda x: x)
    assert area_table(df, 3).count() == 4
    assert sorted((r.record_id or 0, r.n_topics) for r in record_table(df).collect()) == [(0, 1), (1, 2), (2, 0), (3, 0), (4, 0)]
    assert area_nodes(df.limit(0)).count() == 0


def test_areas_of_older_deliveries_are_gone(spark):
    import datetime as dt

    old, new = [("0", "x", None, None), ("1", "y", None, None)], [("0", "z", None, [])]
    rows = [(1, None, None, old, dt.datetime(2024, 1, 1), None), (1, None, None, new, dt.datetime(2024, 2, 1), None), (2, None, None, old, dt.datetime(2024, 1, 1), None), (2, None, None, None, dt.datetime(2024, 2, 1), None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r.record_id, r.area_path, r.text) for r in area_nodes(df).collect()] == [(1, "0", "z")]
    assert sorted((r.record_id, r.n_topics) for r in record_table(df).collect()) == [(1, 1), (2, 0)]
