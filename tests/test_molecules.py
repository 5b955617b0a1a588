import itertools
import random

import pytest

from retort.operators import isomorphism, molecules, numbering
from retort.sources import tables


def graph(markup):
    return molecules.parse_fragment(markup)


def link(a, b):
    return [{"id": i, "type": "-", "src": x, "dst": y} for i, (x, y) in enumerate(zip(a, b))]


def plain(n, pairs):
    return [{"id": i, "text": ""} for i in range(n)], [{"id": i, "type": "-", "src": a, "dst": b} for i, (a, b) in enumerate(pairs)]


def test_rings_lengths_and_groups():
    atoms, bonds = graph("*6(-=-=-=)")
    assert len(atoms) == 6 and [b["type"] for b in bonds] == list("-=-=-=") and (bonds[-1]["src"], bonds[-1]["dst"]) == (5, 0)
    assert [b["angle"] for b in bonds] == [330, 30, 90, 150, 210, 270]
    atoms, bonds = graph("**6(------)")
    assert len(atoms) == 7 and atoms[6]["text"] == molecules.CIRCLE and bonds[6]["dst"] == 6
    centre = [sum(a[c] for a in atoms[:6]) / 6 for c in "xy"]
    assert atoms[6]["x"] == pytest.approx(centre[0], abs=1e-5) and atoms[6]["y"] == pytest.approx(centre[1], abs=1e-5)
    assert graph("A-[:0,2]B")[0][1]["x"] == 2 and graph("A-[:0,2]B")[1][0]["length"] == 2
    atoms, bonds = graph(r"\charge{90=\:}{O}-H")
    assert [a["text"] for a in atoms] == [r"\charge{90=\:}{O}", "H"] and len(bonds) == 1
    atoms, bonds = graph("C{(CH_{3})}_{3}-N")
    assert [a["text"] for a in atoms] == ["C{(CH_{3})}_{3}", "N"]


def test_angles_are_inherited():
    assert [b["angle"] for b in graph("[:30]A-B(-C)-[:90]D")[1]] == [30, 30, 90]
    assert [b["angle"] for b in graph("A-[:-45]B([:45]-[::90]C-D)-E")[1]] == [315, 45, 45, 0]
    # A branch at a ring's corner points away from the ring; a ring there lies on the next edge.
    atoms, bonds = graph("*6(--(-O)----)")
    assert [b["angle"] for b in bonds][2] == 330
    atoms, bonds = graph("*6(--*6(------)----)")
    places = {(a["x"], a["y"]) for a in atoms}
    assert len(atoms) == 11 and len(places) == 10  # naphthalene: two atoms shared, one of them written twice


def test_hooks_lead_from_the_first_place_to_each_later_one():
    bonds = graph("A?[a]-B(-[1]W?[a,2]-X?[b])(<|[7]Y-Z?[b,1])-C?[b,{>}]")[1]
    assert [(b["type"], b["src"], b["dst"]) for b in bonds if b["hook"]] == [("=", 0, 2), ("-", 3, 5), (">", 3, 6)]


@pytest.mark.parametrize("markup", ["A]B", "*x(-)", "A-[:x]B", "*6(-------)", "*2(--)", "A(-B", "A)-B", "A?[a]", "A?[a,2]-B?[a]", "A{B", "A}B", "A*B"])
def test_what_is_not_understood_is_an_error(markup):
    with pytest.raises(ValueError):
        graph(markup)


DECALIN = plain(10, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 0), (4, 6), (6, 7), (7, 8), (8, 9), (9, 5)])
BICYCLOPENTYL = plain(10, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (5, 6), (6, 7), (7, 8), (8, 9), (9, 5), (0, 5)])
PRISM = plain(6, [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (0, 3), (1, 4), (2, 5)])
K33 = plain(6, list(itertools.product((0, 1, 2), (3, 4, 5))))


def test_regular_graphs_differ():
    codes = [isomorphism.canonical_code(*g) for g in (DECALIN, BICYCLOPENTYL, PRISM, K33)]
    assert len(set(codes)) == 4


def test_codes_do_not_depend_on_the_order_of_atoms():
    rng = random.Random(4)
    shapes = [DECALIN, BICYCLOPENTYL, PRISM, K33, plain(9, [(0, i) for i in range(1, 9)]), graph("C?[a](-[:0]O)-[:60]N>[:120]C(=[:30]O)-[:200]C?[a,{=}]"), graph("**6(-(-Br)--(-OH)--)")]
    for atoms, bonds in shapes:
        want = isomorphism.canonical_code(atoms, bonds)
        for _ in range(10):
            to = list(range(len(atoms)))
            rng.shuffle(to)
            moved = sorted(({**a, "id": to[a["id"]]} for a in atoms), key=lambda a: a["id"])
            turned = [{**b, "src": to[b["dst"]], "dst": to[b["src"]], "type": isomorphism.TURNED.get(b["type"], b["type"])} if rng.random() < 0.5 else {**b, "src": to[b["src"]], "dst": to[b["dst"]]} for b in bonds]
            rng.shuffle(turned)
            assert isomorphism.canonical_code(moved, turned) == want


def test_codes_equal_brute_force_on_small_graphs():
    """All graphs of five atoms: as many codes as there are graphs up to the order of atoms (34)."""
    pairs = list(itertools.combinations(range(5), 2))
    codes = {isomorphism.canonical_code(*plain(5, [p for i, p in enumerate(pairs) if bits >> i & 1])) for bits in range(1 << len(pairs))}
    assert len(codes) == 34


def test_codes_in_frames(spark):
    rows = [(1, "C-[:30]O"), (2, "O-[:210]C"), (3, "C)"), (4, "C=[:30]O")]
    df = spark.createDataFrame([(k, "\\chemfig{" + m + "}", "clash") for k, m in rows], "k bigint, s string, code string")
    made = isomorphism.with_codes(molecules.fragments(df, ["k"], "s"), {"code": ("atoms", "bonds")})
    code = {r.k: r.code for r in made.collect()}
    assert code[1] == code[2] and code[3] is None and code[4] != code[1]
    assert isomorphism.with_codes(molecules.fragments(df.limit(0), ["k"], "s"), {"code": ("atoms", "bonds")}).count() == 0


def test_prepared_molecules_have_no_doubles(spark):
    rows = [(1, "*6(--*6(------)----)"), (2, "C-[:0]=[:180]"), (3, "N"), (4, "A?[a]-B?[a,{=}]")]
    df = spark.createDataFrame([(k, "\\chemfig{" + m + "}") for k, m in rows], "k bigint, s string")
    got = {r.k: r for r in molecules.prepared(molecules.fragments(df, ["k"], "s").select("k", "atoms", "bonds")).collect()}
    assert (len(got[1].atoms), len(got[1].bonds)) == (10, 11)
    assert (len(got[2].atoms), [b.type for b in got[2].bonds]) == (2, ["="]) and len(got[3].atoms) == 1
    assert [b.type for b in got[4].bonds] == ["="]


def test_numbers_with_blocks(spark):
    F = numbering.F
    df = spark.createDataFrame([(i * 7 % 1000, i) for i in range(1000)] + [(5, 5), (None, 1)], "k bigint, number bigint")
    plain_, blocks = (numbering.number_rows(df.filter("k IS NOT NULL"), F.expr("k div 10"), ["k", "number"], name="n", block=b).select("k", "n") for b in (None, F.expr("_part div 8")))
    assert sorted(blocks.collect()) == sorted(plain_.collect()) and sorted(r.n for r in blocks.collect()) == list(range(1001))


def test_label_files_tables_of_words_and_sinks(spark, tmp_path):
    (tmp_path / "labels.txt").write_text("a.png\t\\chemfig{A}\tmore\nb.png\n\n c.png\t\n", encoding="utf-8")
    rows = tables.label_lines(spark, str(tmp_path / "labels.txt"))
    assert sorted((r.file_path, r.input_chemfig, r.error) for r in rows.collect()) == [(" c.png", "", None), ("a.png", "\\chemfig{A}\tmore", None), ("b.png", None, "too few columns")]
    tables.write_parts(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/result")).count() == 2 and spark.read.parquet(str(tmp_path / "out/error")).count() == 1
    (tmp_path / "words.txt").write_text("\\le\t<\n\\rm\n\\dots\t. . .\n", encoding="utf-8")
    assert tables.word_table(spark, str(tmp_path / "words.txt")) == {"\\le": ["<"], "\\rm": [], "\\dots": [".", ".", "."]}
    with pytest.raises(ValueError):
        tables.word_table(spark, str(tmp_path / "words.txt"), most=2)
