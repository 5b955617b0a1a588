import random

from pyspark.sql import functions as F

from retort.functions import text as fn
from retort.operators import evaluate, molecules
from retort.operators.dedupe import first_wins, last_wins
from retort.operators.numbering import number_rows


def one(spark, column, text="", items=None):
    df = spark.createDataFrame([(text, items)], "s string, a array<string>")
    return df.select(column.alias("x")).first().x


def test_token_functions(spark):
    s, a = F.col("s"), F.col("a")
    assert one(spark, fn.unwrap_subscripts(a), items=["C", "_", "{", "2", "}", "O", "}"]) == ["C", "2", "O", "}"]
    assert one(spark, fn.merge_single_chars(a), items=["{", "C", "l", "-[:0]", "O", "H", "}"]) == ["{", "Cl", "-[:0]", "OH", "}"]
    assert one(spark, fn.cut_at(a, fn.ENDS), items=["a", "</s>", "b", "<s>"]) == ["a"]
    assert one(spark, fn.cut_at(a, fn.ENDS), items=["a"]) == ["a"]
    assert one(spark, fn.cut_at(a, fn.ENDS)) is None
    assert one(spark, fn.drop_tokens(a, fn.SPECIAL), items=["x", "\\smear", "x"]) == ["x", "x"]
    assert one(spark, fn.char_tokens(s), "aé中😀") == ["a", "\\UC_00E9", "\\UC_4E2D", "\\LUC_0001F600"]
    assert one(spark, fn.chars_back(fn.char_tokens(s)), "aé中😀\\") == "aé中😀\\"
    assert tuple(one(spark, fn.balance_braces(s), "}a{b{")) == ("a{b{}}", True)
    assert tuple(one(spark, fn.balance_braces(s), "a{b}")) == ("a{b}", False)
    assert tuple(one(spark, fn.depth_range(s), "a}{{")) == (-1, 1)
    assert one(spark, fn.bond_tokens(s), "-[:30]Cl<:[:0]branch(=O?[a,{-}]branch)") == ["-[:30]", "Cl", "<:[:0]", "branch(", "=", "O", "?[a,{-}]", "branch)"]
    assert one(spark, fn.markup_tokens(s), "\\UC_4E2DA \\frac{1}\\%") == ["\\UC_4E2D", "A", "\\frac", "{", "1", "}", "\\%"]


def test_fragments_and_graphs(spark):
    rows = [
        (1, "x \\chemfig{-[:0]O(-[:90]N)?[a]-[:180]-[:270]?[a,{=}]} y \\chemfig{C}"), (2, "\\chemfig{-[:0]O)}"), (3, "\\chemfig{a"),
        (4, None), (5, ""), (6, "\\chemfig{?[a]-O}"), (7, "\\chemfig{C=[:60]O}"), (8, "\\chemfig{O=[:240]C}"), (9, "\\chemfig{C-[:60]O}"),
    ]
    df = spark.createDataFrame(rows, "k bigint, s string")
    made = molecules.fragments(df, ["k"], "s")
    got = {(r.k, r.frag): r for r in made.select("k", "frag", "rest", "error", F.size("atoms").alias("n"), F.size("bonds").alias("m"), molecules.n_rings().alias("rings"), molecules.reach().alias("reach"), molecules.signature().alias("sig")).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0), (3, 0), (6, 0), (7, 0), (8, 0), (9, 0)}
    assert got[1, 0].rest.split() == ["x", "\\chema", "y", "\\chemb"]
    assert (got[1, 0].n, got[1, 0].m, got[1, 0].rings, got[1, 0].reach) == (5, 5, 1, [0, 1, 2, 3, 4])
    assert (got[1, 1].n, got[1, 1].m, got[1, 1].rings) == (1, 0, 0)
    assert "branch" in got[2, 0].error and "close" in got[3, 0].error and "hook" in got[6, 0].error
    assert got[7, 0].sig == got[8, 0].sig != got[9, 0].sig
    coords = made.filter("k = 1 and frag = 0").select(F.transform("atoms", lambda a: F.struct(a["x"], a["y"]))).first()[0]
    assert [tuple(c) for c in coords] == [(0, 0), (1, 0), (1, 1), (0, 0), (0, -1)]


def test_edit_counts_add_up_to_the_distance():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        d, s, n = evaluate.count_edits(a, b)
        assert d + s + n == row[-1] and len(a) - d == len(b) - n


def test_repeated_tail():
    drop = evaluate.drop_repeated_tail
    base = [f"t{i}" for i in range(20)]
    assert drop(base + ["x"] * 5) == base
    assert drop(base + ["x"] * 4) == base + ["x"] * 4
    assert drop(base + ["x", "y"] * 5) == base
    assert drop(base + ["x"] * 6 + ["z"]) == base + ["z"]
    assert drop([]) == []


def test_first_and_last_win(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), (None, 1, 1), ("a", 2, 4)], "k string, o int, v int")
    assert sorted(map(tuple, first_wins(df, ["k"], ["o", "v"]).collect()), key=str) == [("a", 1, 5), (None, 1, 1)]
    assert sorted(map(tuple, last_wins(df, ["k"], ["o", "v"]).collect()), key=str) == [("a", 2, 4), (None, 1, 1)]
    assert first_wins(df.limit(0), ["k"], ["o"]).count() == 0


def test_numbering(spark):
    df = spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(100)], "g int, i int")
    got = number_rows(df, F.expr("i div 10"), ["i"], group=["g"]).collect()
    for g in (0, 1, 2, None):
        mine = sorted((r.i, r.number) for r in got if r.g == g)
        assert [n for _, n in mine] == list(range(len(mine)))


def test_rings_and_what_they_share(spark):
    rows = [
        (1, "\\chemfig{C?[a]-[:0]C?[b]-[:90]C-[:180]C?[a,{-}]-[:90]C-[:0]C?[b,{=}]}"), (2, "\\chemfig{C?[a]?[a,{-}]-O}"), (3, "\\chemfig{C-C}"),
        (4, "\\chemfig{C(-O?[x])(-N?[x,{-}])}"),
    ]
    made = molecules.fragments(spark.createDataFrame(rows, "k bigint, s string"), ["k"], "s").select("k", molecules.rings().alias("r"))
    got = {r.k: [x.atoms for x in r.r] for r in made.collect()}
    assert got == {1: [[0, 1, 2, 3], [1, 2, 3, 4, 5]], 2: [], 3: [], 4: [[0, 1, 2]]}
    shared = made.filter("k = 1").select(molecules.ring_pairs(F.col("r")).alias("p")).first().p
    assert [(p.ri, p.rj, p.atoms) for p in shared] == [(0, 1, [1, 2, 3])]


def test_canonical_tokens(spark):
    from retort.functions import latex

    a = F.col("a")
    made, dropped = latex.LETTERS | latex.SPACES | latex.SYNONYMS, latex.FONTS
    assert one(spark, latex.canonical_tokens(a, made, dropped), items=["\\sin", "\\rm", "x", "\\leq", "\\;"]) == ["s", "i", "n", "x", "\\le", "\\space"]
    assert one(spark, latex.canonical_tokens(a, made, dropped)) is None
    assert one(spark, latex.canonical_tokens(a, {}, []), items=["\\rm"]) == ["\\rm"]
    assert one(spark, latex.without_angle_tokens(a), items=["[:30]", "-[:0]", "\\:", "?[a,{=}]"]) == ["-", ":", "?[a,{=}]"]
