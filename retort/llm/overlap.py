"""Same or nearly same markup across splits, by winnowing fingerprints.

Copies of a text (white space removed) form one class, so that a text that holds
a large share of all rows is handled once; equal texts overlap as members of one
class.  Every class text is cut into grams of ``gram(size)`` characters, and in
each window of grams the one of least hash is selected (winnowing), so that two
texts with a clean stretch of ``stretch(size)`` characters share a selected gram.
Selected grams are joined across splits in packed blocks (``seeds``); each carries
how often the characters of 20 groups occur before and after it, which rules out
most chance seeds inside the join: an edit changes these counts by two at most.
The seeds of a pair are chained collinearly, pairs whose cheapest chain, or whose
counts of short grams, imply more edits than allowed are dropped, and the others
are aligned outwards from the ends of their chain.

Lengths: the same steps serve every text.  Gram and window grow with the length
(``LEVELS``), because a tenth of edits leaves a short text only short clean
stretches; a text of train also gives the grams of the levels its partners may
have.  ``gram`` and ``window`` set by hand hold for every length: with 5 and 5
every pair with a clean stretch of 9 characters is found, which includes all
pairs of at least 100 characters, at a far higher price.

Defined results: null and blank markup, rows without a known split and rows
without label_id pair with nothing; a row delivered again counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.llm import seeds
from retort.session import map_batches

#: Least length, characters of a gram, grams of a window, digits a gram needs to be preferred. The last level's window grows by one every ten characters.
LEVELS = ((0, 4, 2, 0), (70, 7, 7, 1), (100, 10, 4, 2), (140, 14, 6, 4))
#: What the growing window gains at most.
GROWTH = 24
#: One edit for this many characters of the longer text.
PER_EDIT = 10
#: Groups of characters of ``group_counts``.
GROUPS = 32
#: Length of the grams that are counted in the texts of a pair, and the slots of their counts.
COUNTED_GRAM, SLOTS = 4, 1024
#: Pairs with more seeds than this (repetitive texts) are aligned without a chain's bound.
CHAINED = 64
TRAIN, EVAL = 1, 2
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def split_of(split: Column, path: Column) -> Column:
    """train, valid or test from the label, else from the folder in the path; null if neither tells."""
    known = ["train", "valid", "test"]
    own = F.lower(F.trim(split))
    folder = F.lower(F.trim(F.get(F.reverse(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")), F.lit(2))))
    return F.when(own.isin(known), own).when(folder.isin(known), folder)


def source_of(source: Column, path: Column) -> Column:
    """The source in lower case without blanks around it, else the folder in the path."""
    own = F.lower(F.trim(source))
    folder = F.lower(F.trim(F.get(F.reverse(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")), F.lit(3))))
    return F.when(own != "", own).otherwise(F.when(folder != "", folder))


def members(labels: DataFrame) -> DataFrame:
    """(label_id, side, text): rows that can pair, as delivered."""
    # Blanks go first, as that is quicker than the pattern that finds the rest.
    text = F.regexp_replace(F.replace("input_chemfig", F.lit(" "), F.lit("")), r"(?U)\s+", "")
    split = split_of(F.col("split"), F.col("file_path"))
    side = F.when(split == "train", TRAIN).when(split.isNotNull(), EVAL)
    rows = labels.select("label_id", side.alias("side"), text.alias("text"))
    return rows.filter(F.col("label_id").isNotNull() & F.col("side").isNotNull() & (F.col("text") != ""))


def _cls(text: str, name: str = "cls") -> Column:
    """A hash of the text of as many bits as a seed keeps of it."""
    return F.shiftrightunsigned(F.xxhash64(text), 64 - seeds.BITS).alias(name)


def classes(rows: DataFrame) -> DataFrame:
    """(cls, sides, text): each distinct text once; ``cls`` is a hash, ``sides`` the union of the sides' bits."""
    hashed = rows.select(_cls("text"), "side", "text")
    grouped = hashed.groupBy("cls").agg(F.bit_or("side").alias("sides"), F.collect_set("text").alias("texts"))
    return grouped.select("cls", "sides", F.explode("texts").alias("text"))


def _sliding(values: np.ndarray, width: int, join) -> np.ndarray:
    """``join`` over every window of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = join(out[:-step], out[step:])
        have += step
    return out


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` code points, built from runs of powers of two."""
    with np.errstate(over="ignore"):
        have, run = 1, (codes.astype(np.uint64) + np.uint64(1)) * _M1
        out, got, base, bit = None, 0, _M2, k
        while True:
            if bit & 1:
                if out is None:
                    out, got = run, have
                else:
                    n = len(codes) - got - have + 1
                    out = out[:n] * base + run[got : got + n]
                    got += have
            bit >>= 1
            if not bit:
                break
            run = run[:-have] * base + run[have:]
            base, have = base * base, have * 2
        out = (out ^ (out >> np.uint64(31))) * _M1
        return out ^ (out >> np.uint64(29))


def winnow(codes: np.ndarray, size: np.ndarray, k: int, width: int, telling: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the selected grams of texts laid end to end; texts under k + width - 1 characters give none."""
    end = np.cumsum(size)
    row = np.repeat(np.arange(len(size)), size)
    if len(codes) < k + width - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = gram_hashes(codes, k)
    digits = np.r_[0, np.cumsum((codes >= 48) & (codes <= 57))]
    held = digits[k:] - digits[:-k]
    # Grams with half the digits still come before those that are nearly all letters, which most texts share.
    few = (held < telling).astype(np.uint64) + (2 * held < telling)
    at = np.arange(len(hashes), dtype=np.uint64)
    low = np.uint64(0xFFFF)
    order = ((hashes >> np.uint64(2)) | (few << np.uint64(62))) & ~low | (at & low)
    least = _sliding(order, width, np.minimum)
    at = np.arange(len(least))
    whole = at + k + width - 1 <= end[row[: len(least)]]
    least, at = least[whole], at[whole]
    selected = np.zeros(len(hashes), bool)
    selected[at + ((least.astype(np.int64) - at) & 0xFFFF)] = True
    place = np.flatnonzero(selected)
    return place, hashes[place].view(np.int64)


def level_of(size: np.ndarray) -> np.ndarray:
    """The level of texts of these sizes."""
    return np.searchsorted([x[0] for x in LEVELS], size, "right") - 1


def window_of(level: int, size: np.ndarray) -> np.ndarray:
    return LEVELS[level][2] + (np.minimum(size // PER_EDIT, GROWTH) if level == len(LEVELS) - 1 else np.zeros_like(size))


def stretch(size: Column) -> Column:
    """Clean characters in a row that are enough to be found, for pairs whose longer text has this size."""
    out = F.lit(LEVELS[-1][1] + LEVELS[-1][2] - 1) + F.least(F.floor(size / F.lit(PER_EDIT)), F.lit(GROWTH))
    for (_, k, w, _), above in reversed(list(zip(LEVELS, LEVELS[1:]))):
        out = F.when(size < above[0], F.lit(k + w - 1)).otherwise(out)
    return out.cast("int")


def group_counts(codes: np.ndarray, from_: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each span, how often the characters of each group occur in it, modulo 16: two words of sixteen counts of four bits."""
    group = codes % np.uint32(GROUPS)
    words = []
    for word in range(2):
        packed = np.zeros(len(from_), np.uint64)
        for part in range(4):
            # Four groups a sum, 16 bits each; a difference of two sums is exact for spans under 1 << 16.
            one = np.zeros(GROUPS, np.uint64)
            for lane in range(4):
                one[word * 16 + part * 4 + lane] = np.uint64(1) << np.uint64(16 * lane)
            with np.errstate(over="ignore"):
                total = np.r_[np.uint64(0), np.cumsum(one[group])]
                n = (total[to] - total[from_]) & np.uint64(0x000F000F000F000F)
            four = (n | (n >> np.uint64(12)) | (n >> np.uint64(24)) | (n >> np.uint64(36))) & np.uint64(0xFFFF)
            packed |= four << np.uint64(16 * part)
        words.append(packed.view(np.int64))
    return words[0], words[1]


def _levels(size: np.ndarray, side: int) -> Iterator[tuple[int, np.ndarray]]:
    """(level, text numbers): an evaluation text gives its own level, a train text all those of possible partners."""
    own = level_of(size)
    least, most = (own, own) if side == EVAL else (level_of(-(-size * (PER_EDIT - 1) // PER_EDIT)), level_of(size * PER_EDIT // (PER_EDIT - 1)))
    for level in range(len(LEVELS)):
        rows = np.flatnonzero((least <= level) & (level <= most))
        if len(rows):
            yield level, rows


def _fingerprints(cls: np.ndarray, texts: list[str], side: int, gram: int | None, window: int | None) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, cls, size, place, counts) of the grams selected in texts of one side."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    for level, chosen in [(None, np.arange(len(texts)))] if gram else _levels(size, side):
        k, telling = (gram, 0) if gram else (LEVELS[level][1], LEVELS[level][3])
        width = np.full(len(chosen), window) if gram else window_of(level, size[chosen])
        for w in np.unique(width):
            rows = chosen[width == w]
            total = np.cumsum(size[rows])
            for part in np.split(rows, np.searchsorted(total, np.arange(2_000_000, total[-1], 2_000_000))):
                if not len(part):
                    continue
                codes = np.frombuffer("".join(texts[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32)
                place, key = winnow(codes, size[part], k, int(w), telling)
                end = np.cumsum(size[part])
                owner = np.searchsorted(end, place, "right")
                own, start = part[owner], (end - size[part])[owner]
                yield key, cls[own], size[own].astype(np.int32), (place - start).astype(np.int32), seeds.kind_counts(codes, start, place, end[owner])


def _seed_blocks(batches: Iterator[pa.RecordBatch], buckets: int, gram: int | None, window: int | None) -> Iterator[pa.RecordBatch]:
    """The selected grams of both sides of the texts of a task, a block for each bucket of keys and side."""
    parts: dict[int, list] = {EVAL: [], TRAIN: []}

    def written() -> Iterator[pa.RecordBatch]:
        rows = [row for side, some in parts.items() if some for row in seeds.blocks(some, side, buckets)]
        if rows:
            yield seeds.as_batch(rows)
        for some in parts.values():
            some.clear()

    for b in batches:
        cls, sides, texts = b.column("cls").to_numpy(), b.column("sides").to_numpy(), b.column("text").to_pylist()
        for side, some in parts.items():
            rows = np.flatnonzero(sides & side)
            if len(rows):
                some.extend(_fingerprints(cls[rows], [texts[i] for i in rows], side, gram, window))
        if sum(len(x[0]) for some in parts.values() for x in some) >= seeds.PACKED:
            yield from written()
    yield from written()


def allowed(a: Column, b: Column) -> Column:
    """Edits allowed between texts of these lengths."""
    return F.floor(F.greatest(a, b) / F.lit(PER_EDIT)).cast("int")


def counts_apart(pairs: DataFrame, keep: list[str]) -> tuple[DataFrame, Column]:
    """``pairs`` with their packed counts compared, and the sum of the differences (each modulo 16, the shorter way round): at most two for an edit."""
    nibbles, ones = F.lit(0x0F0F0F0F0F0F0F0F), F.lit(0x0101010101010101)
    parts = []
    for name in ("b1", "b2", "a1", "a2"):
        for half in (0, 4):
            x, y = ((F.shiftrightunsigned(c, half) if half else c).bitwiseAND(nibbles) for c in (F.col(f"{name}_e"), F.col(f"{name}_t")))
            parts.append((x.bitwiseOR(F.lit(0x1010101010101010)) - y).bitwiseAND(nibbles).alias(f"d{len(parts)}"))
    # A generator keeps all this out of the join's inner loop, which the JVM would else not compile.
    compared = pairs.select(*keep, F.inline(F.array(F.struct(*parts))))
    total = F.lit(0)
    for i in range(len(parts)):
        d = F.col(f"d{i}")
        over = F.shiftrightunsigned(d, 3).bitwiseAND(ones)
        total = total + d.bitwiseXOR(over * 15) + over  # 16 - d where d is 8 or more
    bytes_ = F.lit(0x00FF00FF00FF00FF)
    return compared, (total.bitwiseAND(bytes_) + F.shiftrightunsigned(total, 8).bitwiseAND(bytes_)) % 65535


def chain(seeds: Column, size_e: Column, size_t: Column, window: Column) -> Column:
    """The cheapest collinear chain: struct(cost, first, last, n), where cost is a number of edits that the chain implies at least.

    Between neighbours of a chain lie at least as many edits as the diagonal
    moves, and one in each whole window without a shared gram.  ``seeds`` are
    sorted structs (a, b) of places in the two texts.
    """
    shift = lambda a, b: F.abs((b["b"] - b["a"]) - (a["b"] - a["a"]))
    gap = lambda a, b: F.greatest(shift(a, b), F.floor((b["a"] - a["a"]) / window).cast("int"))
    state = lambda cost, first, last, n: F.struct(cost.alias("cost"), first.alias("first"), last.alias("last"), n.alias("n"))
    before = F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"))
    after = F.struct(size_e.alias("a"), size_t.alias("b"))

    def step(states: Column, s: Column) -> Column:
        fits = F.filter(states, lambda c: (c["last"]["a"] < s["a"]) & (c["last"]["b"] < s["b"]))
        longer = F.transform(fits, lambda c: state(c["cost"] + gap(c["last"], s), c["first"], s, c["n"] - 1))
        alone = state(gap(before, s), s, s, F.lit(-1))
        return F.concat(states, F.array(F.array_min(F.concat(longer, F.array(alone)))))

    kind = "array<struct<cost:int,first:struct<a:int,b:int>,last:struct<a:int,b:int>,n:int>>"
    states = F.aggregate(seeds, F.array().cast(kind), step)
    closed = F.transform(states, lambda c: state(c["cost"] + gap(c["last"], after), c["first"], c["last"], c["n"]))
    return F.array_min(F.transform(closed, lambda c: F.struct(c["cost"], c["n"], c["first"], c["last"])))


def class_pairs(distinct: DataFrame, gram: int | None = None, window: int | None = None) -> DataFrame:
    """(cls_e, text_e, cls_t, text_t, distance, seeds): different texts, one of an evaluation split and one of train, within the allowed edits."""

    c = F.col
    most = allowed(c("size_e"), c("size_t"))
    buckets = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = map_batches(distinct.select("cls", "sides", "text"), lambda batches: _seed_blocks(batches, buckets, gram, window), seeds.BLOCKS)
    joined = map_batches(made.repartitionById(buckets, "bucket"), lambda batches: seeds.join_blocks(batches, (EVAL, TRAIN), PER_EDIT, buckets), seeds.PARTED)
    shared = map_batches(joined.repartitionById(buckets, "spot"), lambda batches: seeds.join_pieces(batches, PER_EDIT), seeds.PAIRS)
    grouped = shared.groupBy("cls_e", "cls_t", "size_e", "size_t").agg(F.array_sort(F.collect_set(F.struct(c("place_e").alias("a"), c("place_t").alias("b")))).alias("seeds"))
    longest = F.greatest("size_e", "size_t")
    clean = F.lit(gram + window - 1) if gram else stretch(longest)
    n = F.size("seeds")
    loose = F.struct(F.lit(0).alias("cost"), (-n).alias("n"), F.get("seeds", F.lit(0)).alias("first"), F.get("seeds", F.lit(0)).alias("last"))
    best = F.when(n <= CHAINED, chain(c("seeds"), c("size_e"), c("size_t"), clean)).otherwise(loose)
    # A generator works the chain out once; a plain column would be repeated in the filter and in each field.
    chained = grouped.select("cls_e", "cls_t", most.alias("most"), F.inline(F.array(best)))
    pairs = chained.filter(c("cost") <= c("most")).select("cls_e", "cls_t", (-c("n")).alias("seeds"), "first", "last")
    texts = lambda bit, x: distinct.filter(F.col("sides").bitwiseAND(bit) > 0).select(
        F.col("cls").alias(f"cls_{x}"), F.col("text").alias(f"text_{x}")
    )
    both = pairs.join(texts(EVAL, "e"), "cls_e").join(texts(TRAIN, "t"), "cls_t")
    names = ["cls_e", "cls_t", "seeds", "first", "last", "text_e", "text_t"]
    kinds = "cls_e bigint, cls_t bigint, seeds int, first struct<a:int,b:int>, last struct<a:int,b:int>, text_e string, text_t string"
    both = map_batches(both.select(*names), _near_counts, kinds)
    return align(both).filter(F.col("distance") >= 0)


def grams_apart(texts: tuple[list[str], list[str]]) -> np.ndarray:
    """For pairs of texts, the sum of differences of their counts of hashed runs of COUNTED_GRAM characters: at most twice that length for an edit."""
    n, tallies = len(texts[0]), []
    for side in texts:
        size = np.fromiter(map(len, side), np.int64, n)
        codes = np.frombuffer("".join(side).encode("utf-32-le", "surrogatepass"), np.uint32)
        tally = np.zeros(n * SLOTS, np.int64)
        if len(codes) >= COUNTED_GRAM:
            slot = (gram_hashes(codes, COUNTED_GRAM) >> np.uint64(20)).astype(np.int64) % SLOTS
            row = np.repeat(np.arange(n), size)
            inside = np.arange(len(slot)) + COUNTED_GRAM <= np.cumsum(size)[row[: len(slot)]]
            tally = np.bincount(row[: len(slot)][inside] * SLOTS + slot[inside], minlength=n * SLOTS)
        tallies.append(tally.reshape(n, SLOTS))
    return np.abs(tallies[0] - tallies[1]).sum(1)


def _near_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose counts of short grams don't rule them out."""
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            e, t = b.column("text_e").to_pylist(), b.column("text_t").to_pylist()
            most = np.array([max(len(x), len(y)) // PER_EDIT for x, y in zip(e, t)], np.int64)
            yield b.filter(pa.array(grams_apart((e, t)) <= 2 * COUNTED_GRAM * most))


def align(pairs: DataFrame) -> DataFrame:
    """``pairs`` (text_e, text_t, first, last) with ``distance``: the edits, -1 beyond the allowed number.

    Extension from the chain: before its first seed, between its ends, and after
    its last.  If these stay within the limit, their sum is the band in which the
    distance is then worked out; if not, the limit is.
    """

    def then(df: DataFrame, **made: Column | str) -> DataFrame:
        # A generator, so that a filter on the distance isn't pushed down, which would work all of this out again.
        return df.select("*", F.inline(F.array(F.struct(*[(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in made.items()]))))

    most = allowed(F.length("text_e"), F.length("text_t"))
    both = then(pairs.withColumn("_most", most), _left="levenshtein(left(text_e, first.a), left(text_t, first.b), _most)")
    inside = "levenshtein(substring(text_e, first.a + 1, last.a - first.a), substring(text_t, first.b + 1, last.b - first.b), _most - _left)"
    both = then(both, _inside=f"CASE WHEN _left >= 0 THEN {inside} ELSE -1 END")
    after = "levenshtein(substring(text_e, last.a + 1), substring(text_t, last.b + 1), _most - _left - _inside)"
    both = then(both, _right=f"CASE WHEN _inside >= 0 THEN {after} ELSE -1 END")
    both = then(both, distance="levenshtein(text_e, text_t, CASE WHEN _right >= 0 THEN _left + _inside + _right ELSE _most END)")
    return both.drop("_most", "_left", "_inside", "_right")


def _tag(text: Column) -> Column:
    """A second hash, that tells texts of one first hash apart."""
    return F.xxhash64(F.lit(1), text)


def _class_links(rows: DataFrame, gram: int | None, window: int | None) -> DataFrame:
    """(cls_e, tag_e, cls_t, tag_t, share): the near pairs of different texts, and each text of both sides with itself; share of unchanged characters."""
    distinct = classes(rows)
    share = 1 - F.col("distance") / F.greatest(F.length("text_e"), F.length("text_t"))
    near = class_pairs(distinct, gram, window).select(
        "cls_e", _tag(F.col("text_e")).alias("tag_e"), "cls_t", _tag(F.col("text_t")).alias("tag_t"), share.alias("share")
    )
    both = distinct.filter(F.col("sides") == EVAL + TRAIN).select("cls", _tag(F.col("text")).alias("tag"))
    return near.unionByName(both.select(F.col("cls").alias("cls_e"), F.col("tag").alias("tag_e"), F.col("cls").alias("cls_t"), F.col("tag").alias("tag_t"), F.lit(1.0).alias("share")))


def _own(rows: DataFrame, bit: int, x: str) -> DataFrame:
    """(label_id_x, cls_x, tag_x) of one side, as delivered."""
    return rows.filter(F.col("side") == bit).select(
        F.col("label_id").alias(f"label_id_{x}"), _cls("text", f"cls_{x}"), _tag(F.col("text")).alias(f"tag_{x}")
    )


def overlap_pairs(labels: DataFrame, gram: int | None = None, window: int | None = None) -> DataFrame:
    """(label_id_a, label_id_b): the overlapping pairs, smaller id first, once each."""
    rows = members(labels)
    pairs = _class_links(rows, gram, window).join(_own(rows, EVAL, "e"), ["cls_e", "tag_e"]).join(_own(rows, TRAIN, "t"), ["cls_t", "tag_t"])
    a, b = F.col("label_id_e"), F.col("label_id_t")
    return pairs.filter(a != b).select(F.least(a, b).alias("label_id_a"), F.greatest(a, b).alias("label_id_b")).distinct()


def overlap_coverage(labels: DataFrame, gram: int | None = None, window: int | None = None) -> DataFrame:
    """A row an evaluation record: label_id, split, source, n_train (train rows it overlaps), coverage (best share of unchanged characters, 0 to 1).

    Train rows are counted once a class and added up over the classes that a
    text links to; the pairs of rows are never laid out.
    """
    split = split_of(F.col("split"), F.col("file_path"))
    source = source_of(F.col("source"), F.col("file_path"))
    known = labels.select("label_id", split.alias("split"), source.alias("source")).filter(F.col("label_id").isNotNull())
    known = known.filter(F.col("split").isin("valid", "test")).groupBy("label_id").agg(F.min("split").alias("split"), F.min("source").alias("source"))
    rows = members(labels)
    e, t = _own(rows, EVAL, "e").distinct(), _own(rows, TRAIN, "t").distinct()
    held = t.groupBy("cls_t", "tag_t").agg(F.count("*").alias("n"))
    links = _class_links(rows, gram, window).join(held, ["cls_t", "tag_t"])
    per = links.groupBy("cls_e", "tag_e").agg(F.sum("n").alias("n"), F.max("share").alias("share"))
    # Ids delivered on both sides (a fault of the data) don't overlap themselves.
    twice = e.join(t, F.col("label_id_e") == F.col("label_id_t")).drop("label_id_t")
    selfs = twice.join(links.select("cls_e", "tag_e", "cls_t", "tag_t"), ["cls_e", "tag_e", "cls_t", "tag_t"]).groupBy("label_id_e").agg(F.count("*").alias("own"))
    counted = e.join(per, ["cls_e", "tag_e"]).groupBy("label_id_e").agg(F.sum("n").alias("n"), F.max("share").alias("share"))
    counted = counted.join(selfs, "label_id_e", "left").withColumn("n_train", F.col("n") - F.coalesce("own", F.lit(0)))
    counted = counted.filter("n_train > 0").select(F.col("label_id_e").alias("label_id"), "n_train", "share")
    filled = known.join(counted, "label_id", "left")
    return filled.select("label_id", "split", "source", F.coalesce("n_train", F.lit(0)).alias("n_train"), F.coalesce("share", F.lit(0.0)).alias("coverage"))


def overlap_report(labels: DataFrame) -> DataFrame:
    """Per evaluation split and source: n_records, n_overlapping, n_pairs, mean_coverage of all records."""
    return overlap_coverage(labels).groupBy("split", "source").agg(
        F.count("*").alias("n_records"), F.sum((F.col("n_train") > 0).cast("bigint")).alias("n_overlapping"),
        F.sum("n_train").alias("n_pairs"), F.round(F.avg("coverage"), 6).alias("mean_coverage"),
    )
