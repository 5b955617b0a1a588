import random

from pyspark.sql import functions as F

from retort.operators import isomorphism, molecules, rings, sequences

SINGLE = "?[a]-[:0]C(-[:270]O)-[:60]N>[:120]-[:180]=[:240]?[a,{=}](-[:180]Br)"
FUSED = "?[a]-[:0]?[b](-[:300]Cl)-[:60]S-[:120]?[c]-[:180]-[:240]?[a,{-}](-[:200]N)-[:120]"
TWO = "-[:0]?[a]-[:60]-[:0]?[b]-[:300]?[a,{-}]N?[c]<[:0]-[:60]?[b,{=}]O?[c,{-}]"
SPIRO = "C?[a]-[:60]C-[:300]?[a,{-}](-[:0]?[b]-[:60]O-[:300]?[b,{=}]-[:0]F)"
CHAIN = "CH_{3}-[:0]O(=[:90]\\Chemabove{N}{H})<:[:0]"
BRIDGED = "?[a]-[:0]-[:60]-[:120]?[c]-[:180]-[:240]?[a,{-}]-[:300]?[c,{-}]"


def graphs(spark, texts):
    df = spark.createDataFrame([(i, f"\\chemfig{{{t}}}") for i, t in enumerate(texts)], "k bigint, s string")
    return molecules.fragments(df, ["k"], "s").filter("error is null")


def test_rings_are_contracted_and_expanded(spark):
    texts = [SINGLE, TWO, SPIRO, CHAIN, "C", ""]
    coded = rings.contract(graphs(spark, texts), ["k"])
    back = rings.expand(coded.select("k", "seq", "n_super", "before"), ["k", "seq", "n_super", "before"])
    got = {r.k: r for r in isomorphism.with_codes(back, {"after": ("atoms", "bonds")}).collect()}
    assert {k: r.n_super for k, r in got.items()} == {0: 1, 1: 3, 2: 2, 3: 0, 4: 0, 5: 0}
    assert all(r.error is None for r in got.values())
    assert all(r.before == r.after for k, r in got.items() if k < 5)
    for r in got.values():
        tokens = [s.token for s in r.seq]
        assert tokens.count("<ea>") == r.n_super and not any(t.startswith("?[") for t in tokens)
        for s in r.seq:
            assert s.cond == -1 or tokens[s.cond] == rings.SUPER or "@" in tokens[s.cond]
            assert (s.ring_branch is not None) == (s.token == rings.BRANCH)


def test_entangled_rings_are_cut_and_linked(spark):
    coded = rings.contract(graphs(spark, [BRIDGED]), ["k"])
    assert any(s.token.startswith("?[") for s in coded.first().seq)
    back = isomorphism.with_codes(rings.expand(coded.select("k", "before", "seq"), ["k", "before"]), {"after": ("atoms", "bonds")})
    assert [r.before == r.after for r in back.collect()] == [True]
    rng, pairs = random.Random(6), []
    for n in range(4, 12):  # dense graphs, whose rings share many bonds
        atoms = [{"id": i, "text": rng.choice(["", "C", "N"]), "x": rng.random() * 9, "y": rng.random() * 9} for i in range(n)]
        ends = {(i, rng.randrange(i)) for i in range(1, n)} | {tuple(sorted(rng.sample(range(n), 2), reverse=True)) for _ in range(n)}
        pairs.append((atoms, [{"id": i, "type": rng.choice("-=>"), "angle": 0.0, "src": a, "dst": b, "hook": None} for i, (a, b) in enumerate(sorted(ends))]))
    for atoms, bonds in pairs:
        assert isomorphism.canonical_code(*rings.decode(rings.encode(atoms, bonds)[0])) == isomorphism.canonical_code(atoms, bonds)


def test_whole_labels_as_sequences(spark):
    mol = lambda x: "\\chemfig{" + x + "}"
    texts = ["A " + mol(SINGLE) + " + B_{2} " + mol(CHAIN), "plain text", None, "", mol(SPIRO) + mol(BRIDGED) + "水", "x " + mol("C)"), "\\chemfig{C"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "k bigint, s string, rest string")
    text = {r.k: r.text for r in sequences.restored_text(df, ["k"], "s").collect()}
    assert text == {i: None if t is None or i == 6 else t.replace(" ", "") for i, t in enumerate(texts)}
    made = sequences.label_sequences(df, ["k"], "s")
    got = {r.k: r for r in made.collect()}
    assert [x.token for x in got[1].seq] == list("plaintext") and got[2].seq is None and got[3].seq == [] and got[5].error and got[6].error
    for r in got.values():
        for x in r.seq or []:
            assert (x.ring_branch is None) == (x.token != rings.BRANCH)
            assert x.ring_branch is None or "[:" in r.seq[x.ring_branch].token
    back = isomorphism.with_codes(rings.expand(sequences.sequence_molecules(made, ["k"]), ["k", "frag"]), {"after": ("atoms", "bonds")})
    made = isomorphism.with_codes(molecules.fragments(df, ["k"], "s"), {"before": ("atoms", "bonds")})
    want = {(r.k, r.frag): r.before for r in made.collect() if r.k in (0, 4)}
    assert {(r.k, r.frag): r.after for r in back.collect()} == want and len(want) == 4
    assert sequences.label_sequences(df.limit(0), ["k"], "s").count() == 0


def test_smallest_rings_of_a_fused_system():
    bonds = [{"id": i, "src": a, "dst": b} for i, (a, b) in enumerate([(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 0), (2, 5)])]
    assert sorted(map(len, rings.smallest_rings(bonds))) == [4, 4]


def test_written_markup_reads_back(spark):
    texts = [SINGLE, FUSED.replace("?[b]", "").replace("?[c]", ""), TWO, SPIRO, CHAIN, "C", ""]
    made = graphs(spark, texts).withColumn("before", molecules.signature())
    wrote = rings.written(made, ["k", "before"])
    again = molecules.fragments(wrote.withColumn("s", F.concat(F.lit("\\chemfig{"), "canonical", F.lit("}"))), ["k", "before"], "s")
    rows = again.select("k", "error", (molecules.signature() == F.col("before")).alias("same")).collect()
    assert len(rows) == len(texts) and all(r.error is None and (r.same or r.k == 6) for r in rows)


def test_random_trees_with_rings(spark):
    rng, texts = random.Random(5), []
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 8)):
            parts.append(rng.choice(["-", "=", "<", ">:"]) + f"[:{15 * rng.randrange(24)}]" + rng.choice(["", "C", "OH", "N(-[:45]F)"]))
        if len(parts) > 3:
            parts[0] += "?[a]"
            parts[-1] += "?[a,{-}]"
        texts.append("".join(parts))
    coded = rings.contract(graphs(spark, texts), ["k"])
    back = rings.expand(coded.select("k", "seq", "before", F.col("error").alias("why")), ["k", "seq", "before", "why"])
    back = isomorphism.with_codes(back, {"after": ("atoms", "bonds")})
    rows = back.select("why", "error", (F.col("after") == F.col("before")).alias("same")).collect()
    assert len(rows) == 40 and all(r.why is None and r.error is None and r.same for r in rows)


def test_graph_expressions(spark):
    made = graphs(spark, ["C-[:0]-[:180]O-[:90]N", "-[:0]C=[:10]O", "-[:0]C-[:90]O", SINGLE]).withColumn("r", molecules.rings())
    got = {r.k: r for r in made.select("k", molecules.flat_text().alias("flat"), molecules.molecule_map(molecules.merged_into()).alias("to"),
        molecules.outer_bonds(F.col("r")).alias("outer"), molecules.seed_pairs("atoms", "atoms", 2).alias("seeds")).collect()}
    assert got[0].to == [0, 1, 0, 3]
    assert (got[0].flat, got[1].flat, got[2].flat) == (None, "-C=O", None)
    assert [(s.distance, s.a, s.b) for s in got[1].seeds] == [(0.0, 0, 0), (0.0, 1, 1)]
    assert len(got[3].outer) == 1 and len(got[3].outer[0].bonds) == 2
    one = {r.k: r for r in molecules.merge_atoms(made.select("k", "atoms", "bonds")).collect()}
    # Two atoms in one place with a text each stay apart; one without a text is merged.
    assert [a.text for a in one[0].atoms] == ["C", "", "O", "N"] and [(b.src, b.dst) for b in one[0].bonds] == [(0, 1), (1, 2), (2, 3)]
    bare = molecules.merge_atoms(graphs(spark, ["C-[:0]-[:180]-[:90]N"]).select("k", "atoms", "bonds")).first()
    assert [a.text for a in bare.atoms] == ["C", "", "N"] and [(b.src, b.dst) for b in bare.bonds] == [(1, 0), (0, 3)]
