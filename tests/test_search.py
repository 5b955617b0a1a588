import itertools
import random

import pytest
from pyspark.sql import functions as F

from retort.functions import latex
from retort.operators import search


def one(spark, column, text=None, items=None, numbers=None, scores=None):
    df = spark.createDataFrame([(text, items, numbers, scores)], "s string, a array<string>, n array<int>, v array<double>")
    return df.select(column.alias("x")).first().x


@pytest.fixture(autouse=True)
def columns(spark):
    """The columns S, A, N, V; they need a session."""
    globals().update({c.upper(): F.col(c) for c in "sanv"})


def test_places_in_sequences(spark):
    b = "\\connbranch"
    assert one(spark, search.run_ranks(A, b), items=["x", b, b, "y", b]) == [0, 1, 2, 0, 1]
    assert one(spark, search.run_ranks(A, b), items=[]) == [] and one(spark, search.run_ranks(A, b)) is None
    assert one(spark, search.offsets(F.transform(A, lambda t: t == "m")), items=["m", "x", "m"]) == [1, 0, 2]
    assert one(spark, search.used_before(N), numbers=[3, -1, 3, 1, 1]) == [[], [3], [3], [3], [1, 3]]
    assert one(spark, search.used_before(N), numbers=[]) == [] and one(spark, search.used_before(N)) is None
    ends = {"\\chemfig { a { b } } c }": 6, "\\chemfig { a": None, "a }": None, "\\chemfig { a } \\chemfig { b": None, "\\chemfig { } \\chemfig { }": 5, "": None}
    for text, place in ends.items():
        assert one(spark, search.molecule_end(A), items=text.split()) == place, text
    wanted = lambda t: t.contains("@")
    assert one(spark, search.candidates(A, N, wanted), items=["-@", "x", "=@", "-@"], numbers=[2, -1]) == [0, 3]
    assert one(spark, search.candidates(A, N, wanted), items=["-@", "x"]) == [0]
    assert one(spark, search.kth_best(V, 2), scores=[0.1, 0.9, 0.9]) == 2 and one(spark, search.kth_best(V, 2), scores=[0.1]) is None
    some = one(spark, search.some_of(N, 3, F.lit(1)), numbers=list(range(9)))
    assert len(some) == 3 and some == one(spark, search.some_of(N, 3, F.lit(1)), numbers=list(range(9)))
    assert one(spark, search.some_of(N, 3, F.lit(1)), numbers=[4]) == [4]


def test_beams_equal_all_sequences(spark):
    rng = random.Random(3)
    rows = [(s, t, [-rng.randint(0, 6) / 4 for _ in range(5)]) for s in range(6) for t in range(3)]
    got = search.decode_beams(spark.createDataFrame(rows, "sample int, step int, lp array<double>"), "sample", "step", "lp", 4).collect()
    for s in range(6):
        steps = [lp for k, _, lp in sorted(rows, key=lambda r: r[:2]) if k == s]
        every = sorted((-sum(lp[i] for lp, i in zip(steps, pick)), list(pick)) for pick in itertools.product(range(5), repeat=3))
        mine = sorted((r for r in got if r.sample == s), key=lambda r: r["rank"])
        assert [(-r.score, r.tokens) for r in mine] == every[:4]
    empty = spark.createDataFrame([], "sample int, step int, lp array<double>")
    assert search.decode_beams(empty, "sample", "step", "lp", 4).count() == 0


def test_sums_and_averages(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [9.0]), (None, [50.0]), (3, None)], "k int, v array<double>")
    assert {(r.slot, r.pos): r.total for r in search.scatter_add(df, "k", "v").collect()} == {(1, 0): 4, (1, 1): 6, (2, 0): 9, (None, 0): 50}
    assert {r.pos: r["mean"] for r in search.model_average(df, "k", "v").collect()} == {0: 5.5, 1: 3}
    assert one(spark, search.momentum_update(F.lit(1.0), F.lit(3.0), F.lit(4.0), 0.5, 0.25)) == 3
    assert one(spark, F.isnan(search.ratio_or_nan(F.lit(0.0), F.lit(0))))
    assert search.fan_out(spark.createDataFrame([(0,), (3,)], "n int"), F.col("n"), "i").count() == 4


@pytest.mark.parametrize(
    ("make", "before", "after"),
    [
        (latex.sub_before_sup, "x ^ { 2 { a } } _ { i } y", "x _ { i } ^ { 2 { a } } y"),
        (latex.sub_before_sup, "x _ i ^ 2", "x _ i ^ 2"),
        (latex.without_first_group, " {a{b}c} d {e}", "d {e}"),
        (latex.without_first_group, "d {e}", "d {e}"),
        (lambda c: latex.unwrap(c, ["underline", "textbf"]), r"a \underline{b\textbf{c{d}}} \frac{e}{f}", r"a bc{d} \frac{e}{f}"),
        (latex.wrap_runs, "a水素b", r"a\text{水素}b"),
        (lambda c: latex.correct_text(c, [("  ", " ")]), "a        b", "a b"),
        (latex.arrow_command, r"A\underset{b}{\overset{a_{1}}{\rightarrow}}B", r"A\xrightarrow[b]{a_{1}}B"),
        (latex.arrow_command, r"\overset{a}{\leftarrow}\underset{b}{\rightarrow}", r"\xleftarrow{a}\xrightarrow[b]{}"),
        (latex.skip_rows, "a\\\\b\\begin{array}c\\\\d\\end{array}\\\\", "a\\\\b\\begin{array}c\\skip d\\end{array}\\\\"),
    ],
)
def test_text_functions(spark, make, before, after):
    assert one(spark, make(S), before) == after
    assert one(spark, make(S)) is None and one(spark, make(S), "") == ""


def test_words_are_corrected(spark):
    assert one(spark, latex.correct_words(A, {"a": "b", "x": ""}), items=["a", "x", "c"]) == ["b", "c"]
    assert one(spark, latex.correct_words(A, {"a": "b"})) is None and one(spark, latex.correct_words(A, {}), items=["a"]) == ["a"]


def test_beam_loop_equals_a_plain_one(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for sample in range(12):
        n_steps, k, eos = sample % 4 + 1, 3, 1
        lp = {(t, b): [round(-rng.random() * 3, 1) for _ in range(4)] for t in range(n_steps) for b in range(k)}
        rows += [(sample, t, b, v, "clash") for (t, b), v in lp.items()]
        beams = [(0.0, [], False)]
        for t in range(n_steps):
            longer = []
            for j, (neg, tokens, done) in enumerate(beams):
                longer += [(neg, tokens, True)] if done else [(neg - v, [*tokens, i], i == eos) for i, v in enumerate(lp[t, j])]
            beams = sorted(longer, key=lambda x: (x[0], x[1]))[:k]
        want[sample] = [tokens for _, tokens, _ in sorted(beams, key=lambda x: (x[0] / len(x[1]), x[1]))]
    df = spark.createDataFrame(rows, "sample int, step int, beam int, lp array<double>, tokens string")
    got = {}
    for r in sorted(search.beam_loop(df, "sample", "step", "beam", "lp", 3, 1).collect(), key=lambda r: (r.sample, r.rank)):
        got.setdefault(r.sample, []).append(r.tokens)
    assert got == want
    assert search.beam_loop(df.limit(0), "sample", "step", "beam", "lp", 3, 1).count() == 0
