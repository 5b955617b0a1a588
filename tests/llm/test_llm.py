import base64
import random

import numpy as np
import pytest

from retort.llm import bpe, language, overlap, packing, seeds, terms

WORDS = {
    "en": "the committee received several bags of flour before the evening train left the station and nobody knew why it happened",
    "de": "der hafenmeister reparierte gestern die hölzerne brücke und niemand wusste warum das geschehen war in der nacht",
    "fr": "le gardien de nuit attendait encore le train du soir parce que la pluie tombait sur les toits de la ville",
}


def reference_encoder():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.read_ranks("byte_bpe_50k").splitlines())}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_tokenizer(spark):
    rng = random.Random(1)
    texts = ["", " ", "a" * 1000, "ab" * 300 + "é" * 99, "<|endoftext|> \n\n  x", "😀" * 70, "the" * 5000, "naïve café — 12,5 %", None]
    texts += ["".join(chr(rng.choice([32, 10, 65, 97, 233, 0x4E2D, 0x1F600, 49, 39, 46])) for _ in range(rng.randint(1, 80))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 AS ids")
    ref = reference_encoder()
    want = {i: ref.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids for r in bpe.token_ids(df, "doc_id", "text", "byte_bpe_50k").collect()} == want
    assert {r.doc_id: r.n_tokens for r in bpe.token_counts(df, "doc_id", "text", "byte_bpe_50k").collect()} == {i: len(v) for i, v in want.items()}
    assert bpe.token_ids(df.limit(0), "doc_id", "text", "byte_bpe_50k").count() == 0


def test_packing_holds_everything_in_little_room(spark):
    rng = random.Random(4)
    sizes = [rng.choice([0, 7, 30, 33, 50, 70, 99, 100, 101, 250]) for _ in range(900)] + [40] * 600
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)] + [(5000, None, None), (7, 7, "again")], "id bigint, n bigint, size string")
    rows = packing.pack(df, "id", "n", 100).collect()
    held = {}
    for r in rows:
        assert (r.container_no is None) == (r.size == 0)
        if r.size:
            held[r.container_no] = held.get(r.container_no, 0) + r.size
    assert max(held.values()) <= 100 and sorted(held) == list(range(len(held)))
    assert sum(held.values()) == sum(sizes) + 7
    assert len(held) <= sum(k for _, k in packing.first_fit(*_demand(rows), 100))
    assert {r.id for r in rows if r.n_pieces > 1} == {i for i, n in enumerate(sizes) if n > 100}
    assert packing.pack(df.limit(0), "id", "n", 100).count() == 0


def test_program_lays_nearly_all_and_meets_the_bound():
    rng = np.random.default_rng(5)
    for room, draw in ((2048, rng.gamma(1.5, 300, 9000)), (300, rng.integers(20, 290, 5000)), (100, rng.choice([60, 30], 4000))):
        size, demand = np.unique(np.clip(draw.astype(int), 1, room - 1), return_counts=True)
        laid, left = packing.configurations(size, demand, room)
        assert all((p * size).sum() <= room for p, _ in laid)
        assert (sum(p * n for p, n in laid) + left == demand).all()
        program, rest = sum(n for _, n in laid), sum(n for _, n in packing.first_fit(size, left, room))
        heuristic = sum(n for _, n in packing.first_fit(size, demand, room))
        assert program + rest <= heuristic
        if room == 2048:
            assert program >= 0.99 * (program + rest) and program + rest <= 1 + (size * demand).sum() / room


def test_cut_documents_come_from_the_placed_pieces(spark):
    rows = [("a", 1, 0, 2, 100, 4), ("a", 1, 1, 2, 7, 9), ("a", 2, 0, 1, 50, 9), ("b", 1, 0, 1, 107, 0)]
    placed = spark.createDataFrame(rows, "container string, doc_id bigint, piece_no int, n_pieces int, size bigint, container_no bigint")
    assert [tuple(r) for r in packing.cut_documents(placed).collect()] == [("a", 1)]


def _demand(rows):
    size, n = np.unique([r.size for r in rows if r.size], return_counts=True)
    return size, n


def test_term_counts(spark):
    rows = [(1, "a b\ta\n", "x"), (1, "a b\ta\n", "y"), (2, None, None), (3, "  ", "z"), (4, "a A", "z"), (None, "a", "q"), (5, "b a a", "q")]
    df = spark.createDataFrame(rows, "cs_id bigint, cs_string string, term string")
    got = {r.term: (r.occurrences, r.records, r.n_records, r.mark) for r in terms.term_frequencies(df, "cs_id", "cs_string").collect()}
    assert got == {"a": (5, 3, 5, "common"), "b": (2, 2, 5, "rare"), "A": (1, 1, 5, "rare")}
    assert terms.term_frequencies(df.limit(0), "cs_id", "cs_string").count() == 0


def test_term_runs_over_batches():
    import pyarrow as pa

    rng = random.Random(3)
    rows = sorted((rng.choice("abcd"), rng.randint(0, 9), rng.randint(0, 2)) for _ in range(400))
    want = {}
    for t in "abcd":
        per = {r: max(sum(x == (t, r, d) for x in rows) for d in range(3)) for r in {r for x, r, _ in rows if x == t}}
        want[t] = (sum(per.values()), len(per))
    for step in (1, 2, 7, 50, 400):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + step])], ["term", "record", "delivery"]) for i in range(0, len(rows), step)]
        got = {}
        for b in terms._scan(iter(batches)):
            for t, n, r in zip(*(c.to_pylist() for c in b.columns)):
                got[t] = (got.get(t, (0, 0))[0] + n, got.get(t, (0, 0))[1] + r)
        assert got == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_overlap_equals_brute_force(spark):
    rng = random.Random(7)
    atoms = ["-[:%d]" % (15 * i) for i in range(24)] + ["=[:%d]" % (15 * i) for i in range(24)] + ["O", "N", "Cl", "CH_{3}"]
    texts = []
    for size in [3, 6, 9, 20, 20, 30, 40, 60] * 5:
        base = "".join(rng.choice(atoms) for _ in range(size))
        texts += [base, base]
        for _ in range(2):
            s = list(base)
            for _ in range(rng.randint(0, max(1, len(s) // 14))):
                p = rng.randrange(len(s))
                s[p : p + rng.randint(0, 1)] = rng.choice(["", "z", "y"])
            texts.append("".join(s))
    texts += ["", "  ", None]
    split = [rng.choice(["train", " Train", "TEST", "valid", None]) for _ in texts]
    rows = [(i, f"s\\test\\b\\{i}.png", x, s, None, "c") for i, (x, s) in enumerate(zip(texts, split))]
    df = spark.createDataFrame(rows + rows[:9], "label_id bigint, file_path string, input_chemfig string, split string, source string, side string")
    train = [s is not None and s.strip().lower() == "train" for s in split]
    want = set()
    for i, a in enumerate(texts):
        for j in range(i):
            b = texts[j]
            if train[i] != train[j] and a and b and a.strip() and abs(len(a) - len(b)) * 10 <= max(len(a), len(b)) and edits(a, b) * 10 <= max(len(a), len(b)):
                want.add((j, i))
    got = [tuple(r) for r in overlap.overlap_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(want - set(got)) <= 0.01 * len(want)
    report = overlap.overlap_report(df).collect()
    assert sum(r.n_pairs for r in report) == len(got) and {r.source for r in report} == {"s"}
    assert overlap.overlap_pairs(df.limit(0)).count() == 0


def _seeds(spark, seeds, size_e, size_t, clean):
    df = spark.createDataFrame([(seeds, size_e, size_t)], "seeds array<struct<a:int,b:int>>, e int, t int")
    return df.select(overlap.chain(df.seeds, df.e, df.t, overlap.F.lit(clean)).alias("c")).first().c


def test_chain_is_collinear_and_bounds_the_edits(spark):
    straight = _seeds(spark, [(10, 11), (50, 51), (90, 91), (130, 131), (170, 172), (210, 212), (250, 252)], 280, 282, 43)
    assert (straight.cost, -straight.n, tuple(straight.first), tuple(straight.last)) == (2, 7, (10, 11), (250, 252))
    # Seeds that cross, and lie off the diagonal that the lengths imply: any chain of them costs more than the 28 edits allowed.
    assert _seeds(spark, [(40, 65), (100, 80), (150, 178)], 280, 280, 43).cost > 28
    # Two seeds on one diagonal and one across: the chain leaves the crossing one out.
    assert -_seeds(spark, [(10, 10), (50, 20), (60, 60)], 100, 100, 43).n == 2


def test_extension_stops_at_the_band(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("-=[:]0123456789CHNO") for _ in range(200))
    near = base[:100] + "zzzzz" + base[100:]
    far = base[:50] + "".join(reversed(base[50:]))
    rows = [(base, near, (0, 0), (150, 155)), (base, far, (0, 0), (20, 20)), (base, "z" * 20 + base[20:], (30, 30), (90, 90))]
    df = spark.createDataFrame(rows, "text_e string, text_t string, first struct<a:int,b:int>, last struct<a:int,b:int>")
    assert [r.distance for r in overlap.align(df).collect()] == [5, -1, 20]


def test_counts_never_rule_out_a_near_pair(spark):
    rng = random.Random(8)
    for _ in range(40):
        base = "".join(rng.choice("-=[:]0123456789CHNO") for _ in range(rng.randint(100, 400)))
        near = list(base)
        for _ in range(len(base) // 10):
            p = rng.randrange(len(near))
            near[p : p + rng.randint(0, 1)] = rng.choice(["", "C", "4", "é"])
        near, d = "".join(near), edits(base, "".join(near))
        assert overlap.grams_apart(([base], [near]))[0] <= 2 * overlap.COUNTED_GRAM * d
        words = []
        for x in (base, near):
            codes = np.frombuffer(x.encode("utf-32-le"), np.uint32)
            words.append(np.concatenate(overlap.group_counts(codes, np.array([0]), np.array([len(x)]))).view(np.uint64))
        apart = 0
        for a, b in zip(*words):
            for i in range(16):
                v = (int(a) >> 4 * i) - (int(b) >> 4 * i) & 15
                apart += min(v, 16 - v)
        assert apart <= 2 * d
        cols = {f"{n}_{s}": int(np.int64(w[i % 2].view(np.int64) if hasattr(w[i % 2], "view") else w[i % 2])) for s, w in zip("et", words) for i, n in enumerate(("b1", "b2", "a1", "a2"))}
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} bigint" for c in cols))
    compared, total = overlap.counts_apart(df, [])
    assert compared.select(total.alias("n")).first().n == 2 * apart


@pytest.mark.parametrize("every", [10, 14, 18])
def test_evenly_spread_edits(spark, every):
    """By hand-set grams of 5 and windows of 5, every pair of a tenth of edits is found; by default three in four of one edit in 18."""
    rng = random.Random(every)
    rows = []
    for i in range(40):
        base = [rng.choice("-=[:]0123456789CHNO") for _ in range(280)]
        near = ["z" if p % every == every - 1 else c for p, c in enumerate(base)]
        rows += [(2 * i, "".join(base), "train"), (2 * i + 1, "".join(near), "test")]
    df = spark.createDataFrame(rows, "label_id bigint, input_chemfig string, split string").selectExpr("*", "'' AS file_path", "'' AS source")
    want = {(2 * i, 2 * i + 1) for i in range(40)}
    assert {tuple(r) for r in overlap.overlap_pairs(df, 5, 5).collect()} == want
    found = {tuple(r) for r in overlap.overlap_pairs(df).collect()}
    assert found <= want and (every < 18 or len(found) >= 30)


def test_cuts_of_long_pages_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    count = np.array([0, 3, 700, 90, 256, 257, 2000])
    n = int(count.sum())
    scores = rng.random((n, 8)).astype(np.float32)
    scores[np.arange(n), np.repeat(rng.integers(0, 8, n // 7 + 1), 7)[:n]] += 0.3
    letters = rng.integers(1, 9, n)
    paths = []
    for chain in (10**9, 256, 16):
        monkeypatch.setattr(language, "CHAIN", chain)
        paths.append(language.decode(scores, letters, count))
    assert (paths[0] == paths[1]).all() and (paths[0] == paths[2]).all()


def test_languages(spark):
    rng = random.Random(9)
    say = lambda c, n: " ".join(rng.choice(WORDS[c].split()) for _ in range(n))
    rows = [(i, say(c := "en de fr".split()[i % 3], 60), c if i % 5 else "xx", "k") for i in range(240)]
    rows += [(900, say("en", 50) + "\n" + say("de", 50), "en", "k"), (901, say("fr", 60), "DE_CH", "k"), (902, say("de", 60), " Deutsch", "k"), (903, None, "en", "k"), (904, "", None, "k"), (905, "12 34 …", "en", "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, letters string")
    names = [("en", "eng", "English", "English"), ("de", "deu", "German", "Deutsch"), ("fr", "fra", "French", "Français")]
    langs = spark.createDataFrame(names, "code string, alpha3 string, english_name string, own_name string")
    held = {(r.doc_id, r.lang) for r in language.page_languages(docs, langs).collect()}
    assert held == {(i, "en de fr".split()[i % 3]) for i in range(240)} | {(900, "en"), (900, "de"), (901, "fr"), (902, "de")}
    wrong = {tuple(r) for r in language.wrong_labels(docs, langs).collect()}
    assert wrong == {(i, "en de fr".split()[i % 3]) for i in range(0, 240, 5)} | {(900, "en"), (900, "de"), (901, "fr")}
    parts = [r for r in language.segments(docs, langs).collect() if r.doc_id == 900]
    assert [p.lang for p in sorted(parts, key=lambda p: p.segment_no)] == ["en", "de"]
    assert language.page_languages(docs.limit(0), langs).count() == 0


def test_one_clean_stretch_of_43_characters_is_enough(spark):
    rng = random.Random(11)
    rows = []
    for i in range(60):
        base = [rng.choice("-=[:]0123456789CHNO") for _ in range(280)]
        near, clean = list(base), rng.randrange(280 - 43)
        for p in [*range(clean - 1, -1, -15), *range(clean + 43, 280, 15)]:
            near[p] = "z"
        assert 0 < edits("".join(base), "".join(near)) <= 28
        rows += [(2 * i, "".join(base), "train"), (2 * i + 1, "".join(near), "test")]
    df = spark.createDataFrame(rows, "label_id bigint, input_chemfig string, split string").selectExpr("*", "'' AS file_path", "'' AS source")
    assert {tuple(r) for r in overlap.overlap_pairs(df).collect()} == {(2 * i, 2 * i + 1) for i in range(60)}


def _markup(rng, size):
    return "".join(rng.choice(["-[:%d]" % (15 * rng.randrange(24)), "=[:%d]" % (15 * rng.randrange(24)), "C", "O", "N", "CH_{3}", "NH_{2}", "(", ")"]) for _ in range(size))


def _selected(texts, side):
    parts = list(overlap._fingerprints(np.arange(len(texts)) + (side << 38), texts, side, None, None))
    return [np.concatenate(c) for c in zip(*parts)]


def test_blocks_give_the_seeds_back_and_are_small():
    """A seed with its counts took 53 bytes as a row."""
    rng = random.Random(21)
    texts = [_markup(rng, rng.randint(1, 90)) for _ in range(4000)] + ["é\uffff\U0001f600[:7" * 60, "x", "C" * 70_000]
    key, cls, size, place, counts = _selected(texts, overlap.TRAIN)
    made = list(seeds.blocks([(key, cls, size, place, counts)], overlap.TRAIN, 3))
    assert [b[:2] for b in made] == [(i, overlap.TRAIN) for i in range(3)]
    assert sum(len(b[2]) for b in made) < 26 * len(key)
    back = [np.concatenate(c) for c in zip(*(seeds.unpack(b[2]) for b in made))]
    short = seeds.short_keys(key)
    held = np.bincount((np.unique(short) * np.uint64(3) >> np.uint64(seeds.KEY_BITS)).astype(int))
    assert held.max() < 1.3 * held.min()
    a, b = np.lexsort((cls, place, short)), np.lexsort((back[1], back[3], back[0]))
    for x, y in zip((short, cls, size, place), back):
        assert (x[a] == y[b]).all()
    counted = size[a] < seeds.COUNTED
    assert (counts[a][counted] == back[4][b][counted]).all()
    i = int(np.flatnonzero(size < 2000)[-1])
    text = texts[cls[i] - (overlap.TRAIN << 38)]
    assert counts[i, :4].tolist() == [sum(text[: place[i]].count(c) for c in x) % 256 for x in seeds.LETTERS[:4]]


@pytest.mark.parametrize("crowd", [0, 3, 10**9])
def test_seeds_are_joined_like_every_pair_compared(monkeypatch, crowd):
    monkeypatch.setattr(seeds, "CROWD", crowd)
    monkeypatch.setattr(seeds, "COMPARED", 777)
    rng = random.Random(22)
    texts = [_markup(rng, rng.randint(10, 60)) for _ in range(151)]
    texts += ["".join(c for c in x if rng.random() > 0.04) for x in texts] + [x[:-3] + "CH_{3}" for x in texts]
    e, t = ([x[0].view(np.uint64) >> np.uint64(54), *x[1:]] for x in (_selected(texts[side::2], bit) for side, bit in enumerate((overlap.EVAL, overlap.TRAIN))))
    e, t = seeds.sorted_seeds(e), seeds.sorted_seeds(t)
    got = [r for part in seeds.fitting(e, t, overlap.PER_EDIT) for r in zip(*(c.tolist() for c in part))]
    i, j = np.nonzero(e[0][:, None] == t[0][None, :])
    most = np.maximum(e[2][i], t[2][j]) // overlap.PER_EDIT
    off = np.abs(e[3][i] - t[3][j]) + np.abs((e[2][i] - e[3][i]) - (t[2][j] - t[3][j]))
    d = np.abs(e[4][i].astype(int) - t[4][j])
    keep = (off <= most) & (np.minimum(d, 256 - d).sum(1) <= 2 * most - off)
    i, j = i[keep], j[keep]
    want = list(zip(*(c.tolist() for c in (e[1][i], t[1][j], e[2][i], t[2][j], e[3][i], t[3][j]))))
    assert len(want) > 500 and sorted(got) == sorted(want)
    # The same with the frequent keys taken apart, whose pieces any task may join.
    monkeypatch.setattr(seeds, "HEAVY", 60)
    blocks = [row for x, side in ((e, 2), (t, 1)) for row in [(0, side, seeds.pack(*x))]]
    made = list(seeds.join_blocks([seeds.as_batch(blocks)], (2, 1), overlap.PER_EDIT, 5))
    pieces = [r for b in made for r in b.to_pylist() if r["block_e"]]
    assert len(pieces) > 5 and len({r["spot"] for r in pieces}) == 5
    apart = [tuple(r.values()) for b in seeds.join_pieces(iter(made), overlap.PER_EDIT) for r in b.to_pylist()]
    assert sorted(apart) == sorted(want)


def test_grams_with_few_digits_come_last():
    """A name that many texts share (it filled most of the chance pairs) isn't selected where a gram with two digits is near."""
    text = "mabove{N}{H}-[" * 2 + "CH_{3}-CH_{2}-" + "mabove{N}{H}-[" * 2
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    place, _ = overlap.winnow(codes, np.array([len(text)]), 14, 43, 4)
    assert all(sum(c.isdigit() for c in text[p : p + 14]) == 2 for p in place)


def test_letter_counts_never_rule_out_a_near_pair():
    rng = random.Random(23)
    for _ in range(40):
        base = _markup(rng, 60)
        near = list(base)
        for _ in range(len(base) // 10):
            p = rng.randrange(len(near))
            near[p : p + rng.randint(0, 1)] = rng.choice(["", "C", "4", "é"])
        counts = [seeds.kind_counts(np.frombuffer(x.encode("utf-32-le"), np.uint32), *(np.array([i]) for i in (0, 0, len(x)))) for x in (base, "".join(near))]
        d = counts[0] - counts[1]
        assert np.minimum(d, -d).sum() <= 2 * edits(base, "".join(near))
