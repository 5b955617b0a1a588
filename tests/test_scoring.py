import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from retort import queries_graph, queries_markup  # noqa: E402
from retort.operators import evaluate  # noqa: E402


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


LABELS = [
    (1, "f1", "中é-O"), (2, "f1", "C-O"), (3, "f2", "😀=N"), (4, "f3", "CH_3 -O"), (5, "f3", "CH-é"), (6, "f3", None), (7, "f4", None), (8, None, "C"), (9, "f5", "é"),
]
HYPS = [(1, "f1", "中 é - N"), (2, "f2", "é = N C l"), (3, "f3", "C H O"), (4, "f4", "C"), (5, "f5", None), (6, "f6", "C"), (7, None, "C")]


def tables(spark, folder):
    labels = [(i, path, text, "2024-01-01") for i, path, text in LABELS]
    hyps = [(i, path, text, "2024-01-01") for i, path, text in HYPS]
    spark.createDataFrame(labels, "label_id bigint, file_path string, input_chemfig string, loaded_at string").write.parquet(f"{folder}/labels_tsv.parquet")
    spark.createDataFrame(hyps, "cs_id bigint, file_path string, cs_string string, loaded_at string").write.parquet(f"{folder}/cs_log.parquet")
    return str(folder)


def nearest():
    """{cs_id: (label_id, distance, characters of the label)} by comparing all pairs."""
    want = {}
    for k, path, hyp in HYPS:
        near = [(edits(t.replace(" ", ""), hyp.replace(" ", "")), j, len(t.replace(" ", ""))) for j, p, t in LABELS if path and p == path and t is not None and hyp is not None]
        if near:
            dist, best, n = min(near)
            want[k] = (best, dist, n)
    return want


def test_best_hypothesis_keeps_characters_beyond_ascii(spark, tmp_path):
    got = {r.cs_id: (r.best, r.dist, r.n) for r in queries_markup.best_hypothesis(spark, tables(spark, tmp_path)).collect()}
    assert got == nearest() and set(got) == {1, 2, 3}


def test_line_pairs_keep_characters_beyond_ascii(spark, tmp_path, monkeypatch):
    lines = [(1, "0-0-0", "中é-O", "中-O"), (2, "0-0-0", "C-O", "C=O"), (3, "0-0-0", "😀", None), (4, "0-0-0", None, "C"), (5, "0-0-0", "", "é")]
    rows = spark.createDataFrame(lines, "record_id bigint, area_path string, raw_text string, text string")
    monkeypatch.setattr(queries_markup.nested, "area_table", lambda *_: rows)
    monkeypatch.setattr(queries_markup, "table", lambda *_: rows)
    whole = [x for x in lines if x[2] is not None and x[3] is not None]
    assert {r.record_id: r.dist for r in queries_markup.edit_distance(spark, "").collect()} == {k: edits(a, b) for k, _, a, b in whole}
    ops = {r.record_id: r.n_del + r.n_sub + r.n_ins for r in queries_markup.edit_ops_dsi(spark, "").collect()}
    assert ops == {1: 1, 2: 1, 5: 1}


def test_all_molecules_of_a_label_get_seeds(spark, tmp_path):
    rows = [
        (1, "x/f1.png", "\\chemfig{C-[:0]O} and \\chemfig{N}", "2024-01-01"), (2, "x/f1.png", "\\chemfig{C-[:0]O} \\chemfig{N-[:90]O}", "2024-01-02"),
        (3, "x/f2.png", "\\chemfig{C)} \\chemfig{C-[:0]C}", "2024-01-01"), (4, "x/f2.png", "\\chemfig{C} \\chemfig{C-[:0]C}", "2024-01-02"),
    ]
    spark.createDataFrame(rows, "label_id bigint, file_path string, input_chemfig string, loaded_at string").write.parquet(f"{tmp_path}/labels_tsv.parquet")
    got = {(r.base_name, r.frag, r.rank): (r.distance, r.a, r.b) for r in queries_graph.atom_seed_pairs(spark, str(tmp_path)).collect()}
    assert {k[:2] for k in got} == {("f1", 0), ("f1", 1), ("f2", 1)}
    assert got["f1", 1, 0] == (0.0, 0, 0) and got["f1", 1, 1][1:] == (0, 1) and ("f1", 1, 2) not in got


def test_metric_base_counts_characters(spark, tmp_path):
    want = nearest()
    got = queries_markup.metric_base(spark, tables(spark, tmp_path)).first()
    assert (got.sent_n, got.sent_correct, got.n) == (3, 0, sum(n for _, _, n in want.values()))
    assert got.edits == sum(dist for _, dist, _ in want.values())


def test_edit_counts_are_shortest(spark):
    import random

    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        d, s, i = evaluate.count_edits(a, b)
        assert d + s + i == edits(a, b) and len(a) - d + i == len(b)


def test_seven_metrics(spark, tmp_path):
    mol = lambda x: "\\chemfig{" + x + "}"
    ring = "C?[a]-[:0]C-[:60]C(-[:120]O?[a,{-}])"
    rows = [
        (1, "x/f1.png", mol("C-[:30]O") + " a", "2024-01-01"), (2, "x/f1.png", mol("C-[:30]O") + " b", "2024-01-02"),  # text differs
        (3, "x/f2.png", mol(ring) + mol("N-[:90]C"), "2024-01-01"), (4, "x/f2.png", mol(ring) + mol("N=[:90]C"), "2024-01-02"),  # one molecule of two
        (5, "x/f3.png", mol("C-[:30]O"), "2024-01-01"), (6, "x/f3.png", mol("O-[:210]C"), "2024-01-02"),  # one graph, written from its other end
        (7, "x/f4.png", "plain", "2024-01-01"), (8, "x/f5.png", None, "2024-01-01"), (9, None, mol("C"), "2024-01-01"),
    ]
    spark.createDataFrame(rows, "label_id bigint, file_path string, input_chemfig string, loaded_at string").write.parquet(f"{tmp_path}/labels_tsv.parquet")
    spark.createDataFrame([(1, "y/f2.png"), (2, "y/f2.png"), (3, "y/f3.jpg"), (4, None)], "cs_id bigint, file_path string").write.parquet(f"{tmp_path}/cs_log.parquet")
    got = {r.metric: (r.sent_n, r.sent_correct) for r in queries_graph.metric_table(spark, str(tmp_path)).collect()}
    assert got == {"base": (4, 1), "struct": (4, 3), "struct.single": (4, 3), "struct.line": (4, 2), "struct.ref": (2, 1), "struct.ref.single": (3, 2), "struct.ref.line": (2, 1)}
