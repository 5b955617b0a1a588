"""Languages of documents and of their stretches, by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds one bit a language in every slot: looking up an
n-gram and taking the bitwise and of its slots gives, at once, all languages that
contain it.  The share of a word's n-grams that a language contains, corrected
for the filter's false positives, scores the word; a switch penalty between
languages smooths the scores over the running words, and the letters of the words
that fall to a language decide whether the page holds it.

The filter is fitted on a bounded sample of labelled pages (``PER_LANGUAGE`` of
each language, of ``LONGEST`` characters at most), first by the labels as they
are, then again by what the first filter says of each stretch, since labels are
unreliable.  Everything else runs over all pages and whole texts.

Defined results: null, empty and wordless texts hold no language; without any
usable label no language is found; repeated rows give repeated results.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.session import map_batches

#: Bounds of the sample of labelled pages.
PER_LANGUAGE, SHORTEST, LONGEST = 500, 200, 6000
#: A page holds a language from this many letters on.
MIN_LETTERS = 150
#: Price, in letters, of changing the language between two words.
SWITCH = 5.0
#: Words of a long page that are scored side by side with its other words; the result doesn't depend on it.
CHAIN = 256
#: Slots of the filter (a power of two) and slots of an n-gram.
SLOTS, PROBES = 1 << 20, 3
#: An n-gram belongs to a language from this share of its relative frequencies, and this many sightings, on.
SHARE, SIGHTINGS = 0.2, 3
#: Score from which a word supports its stretch's language.
SUPPORT = 0.25
#: Words a Python worker remembers before it starts afresh.
REMEMBERED = 400_000

WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ][^\W\d_]*)*")


def plain_word(word: str) -> str:
    """Lower case, composed accents, modern letter forms."""
    return unicodedata.normalize("NFC", word).replace("ſ", "s").lower()


def gram_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, key) of the n-grams, 2 to 4 letters with word ends, and the whole word."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    end = np.cumsum(size)
    row = np.repeat(np.arange(len(words)), size)
    m1, m2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    owners, keys, run = [], [], codes.copy()
    with np.errstate(over="ignore"):
        mixed = (codes + np.uint64(1)) * m1
        whole = np.add.reduceat(mixed * (np.arange(len(codes)) - (end - size)[row] + 1).astype(np.uint64) ** np.uint64(3), end - size)
        run = mixed
        for n in (2, 3, 4):
            run = run[:-1] * m2 + mixed[n - 1 :]
            inside = np.arange(len(run)) + n <= end[row[: len(run)]]
            owners.append(row[: len(run)][inside])
            keys.append(run[inside])
        owners.append(np.arange(len(words)))
        keys.append(whole ^ m2)
        key = np.concatenate(keys)
        key = (key ^ (key >> np.uint64(29))) * m1
        key ^= key >> np.uint64(32)
    return np.concatenate(owners), key


class LanguageFilter:
    """Slots of one bit a language, and the share of false positives of each language."""

    def __init__(self, n_languages: int, slots: int = SLOTS):
        self.slots, self.n = np.zeros(slots, np.uint8 if n_languages <= 8 else np.uint64), n_languages
        self.false = np.zeros(n_languages)

    def places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        low, high = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
        for i in range(PROBES):
            yield ((low + np.uint64(i) * high) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def add(self, keys: np.ndarray, language: int) -> None:
        for at in self.places(keys):
            self.slots[at] |= self.slots.dtype.type(1 << language)

    def close(self) -> LanguageFilter:
        bits = [((self.slots >> self.slots.dtype.type(i)) & self.slots.dtype.type(1)).mean() for i in range(self.n)]
        self.false = np.array(bits) ** PROBES
        return self

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """Bits of all languages that contain each key."""
        mask = None
        for at in self.places(keys):
            mask = self.slots[at] if mask is None else mask & self.slots[at]
        return mask

    def scores(self, words: list[str]) -> np.ndarray:
        """Share of each word's n-grams in each language, corrected for false positives."""
        if not words:
            return np.zeros((0, self.n), np.float32)
        owner, keys = gram_keys(words)
        mask = self.masks(keys)
        grams = np.bincount(owner, minlength=len(words))
        out = np.empty((len(words), self.n), np.float32)
        for i in range(self.n):
            hits = np.bincount(owner, weights=(mask >> mask.dtype.type(i)) & mask.dtype.type(1), minlength=len(words))
            share = (hits / grams - self.false[i]) / max(1e-9, 1 - self.false[i])
            out[:, i] = np.clip(share, 0, 1)
        return out


def decode(scores: np.ndarray, letters: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The language of every word: the best path over each text's words with a switch penalty.

    ``count`` words belong to each text.  Long texts are cut into chains of
    ``CHAIN`` words that run side by side.  A chain begins with the scores the one
    before it ends with: chains that began with other scores run again, until none
    changes (a path forgets its start within some words, so that this takes few
    rounds).  The way back is found likewise, so that the cuts change nothing.
    """
    n_words, n = scores.shape
    if not n_words:
        return np.zeros(0, np.int8)
    start = np.cumsum(count) - count
    chains = -(-count // CHAIN)
    text = np.repeat(np.arange(len(count)), chains)
    part = np.arange(len(text)) - np.repeat(np.cumsum(chains) - chains, chains)
    first = start[text] + part * CHAIN
    size = np.minimum(CHAIN, start[text] + count[text] - first)
    gain = (scores * letters[:, None]).astype(np.float64)
    opening, ending = np.zeros((len(first), n)), np.zeros((len(first), n))
    stays = np.zeros((n_words, n), bool)
    tops = np.zeros(n_words, np.int8)
    follows = part > 0

    def in_step(which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Place in the chain, and how many of ``which``, sorted by falling size, reach it."""
        sizes = size[which]
        yield from enumerate(len(sizes) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0])), "right"))

    todo = np.arange(len(first))
    while len(todo):
        todo = todo[np.argsort(-size[todo], kind="stable")]
        best = opening[todo]
        for t, k in in_step(todo):
            word, now = first[todo[:k]] + t, best[:k]
            top = now.argmax(1)
            jump = now[np.arange(k), top][:, None] - SWITCH
            stays[word], tops[word] = now >= jump, top
            best[:k] = np.maximum(now, jump) + gain[word]
        ending[todo] = best - best.max(1, keepdims=True)
        after = todo[(todo + 1 < len(first)) & follows[np.minimum(todo + 1, len(first) - 1)]] + 1
        todo = after[np.abs(opening[after] - ending[after - 1]).max(1) > 1e-6] if len(after) else after
        opening[todo] = ending[todo - 1]
    path = np.zeros(n_words, np.int8)
    last = ending.argmax(1)
    todo = np.arange(len(first))
    while len(todo):
        todo = todo[np.argsort(-size[todo], kind="stable")]
        at = last[todo]
        for t, k in reversed(list(in_step(todo))):
            word = first[todo[:k]] + t
            path[word] = at[:k]
            at[:k] = np.where(stays[word, at[:k]], at[:k], tops[word])
        inner = follows[todo]
        before, at = todo[inner] - 1, at[inner]
        changed = last[before] != at
        last[before] = at
        todo = before[changed]
    return path


def fit(texts: list[str], labels: np.ndarray, n: int) -> LanguageFilter:
    """Two rounds: n-grams by label, then by the first filter's word for each stretch."""
    words, doc = [], []
    for i, text in enumerate(texts):
        found = WORD.findall(text)
        words += found
        doc.append(len(found))
    doc_of = np.repeat(np.arange(len(texts)), doc)
    index: dict[str, int] = {}
    place = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    plain = [plain_word(w) for w in index]
    if not plain:
        return LanguageFilter(n).close()
    owner, keys = gram_keys(plain)
    distinct, gram = np.unique(keys, return_inverse=True)
    label = labels[doc_of]
    letters = np.fromiter(map(len, plain), np.int64, len(plain))[place]
    model = None
    for _ in range(2):
        tally = np.zeros((len(distinct), n))
        for i in range(n):
            uses = np.bincount(place[label == i], minlength=len(plain))
            tally[:, i] = np.bincount(gram, weights=uses[owner], minlength=len(distinct))
        rate = tally / np.maximum(1, tally.sum(0))
        share = rate / np.maximum(1e-30, rate.sum(1, keepdims=True))
        model = LanguageFilter(n)
        for i in range(n):
            model.add(distinct[(share[:, i] >= SHARE) & (tally[:, i] >= SIGHTINGS)], i)
        model.close()
        label = decode(model.scores(plain)[place], letters, np.array(doc, np.int64))
    return model


class Tagger:
    """Words of texts with their scores; remembers the words it has met."""

    def __init__(self, model: LanguageFilter):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, self.model.n), np.float32)
        self.letters = np.zeros(0, np.int64)
        self.name = np.zeros(0, bool)

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Place of every word, and the number of words of each text."""
        words, count = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                found = WORD.findall(text)
                count[i] = len(found)
                words += found
        if len(self.place) > REMEMBERED:
            self.forget()
        new = list(set(words).difference(self.place))
        if new:
            self.place.update(zip(new, range(len(self.letters), len(self.letters) + len(new))))
            self.scores = np.concatenate([self.scores, self.model.scores([plain_word(w) for w in new])])
            self.letters = np.r_[self.letters, np.fromiter(map(len, new), np.int64, len(new))]
            self.name = np.r_[self.name, np.fromiter((w[0].isupper() and not w.isupper() for w in new), bool, len(new))]
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words)), count

    def tag(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language, score in it, letters that count, words a text): letters of names without support don't count."""
        place, count = self.words(texts)
        scores, letters = self.scores[place], self.letters[place]
        path = decode(scores, letters, count)
        own = scores[np.arange(len(path)), path] if len(path) else np.zeros(0, np.float32)
        return path, own, np.where((own >= SUPPORT) | ~self.name[place] & (own > 0.05), letters, 0), count


_TAGGERS: dict[bytes, Tagger] = {}


def _worker_tagger(model) -> Tagger:
    value = model.value
    if id(value) not in _TAGGERS:
        _TAGGERS.clear()
        _TAGGERS[id(value)] = Tagger(value)
    return _TAGGERS[id(value)]


def language_codes(languages: DataFrame) -> tuple[list[str], dict[str, str]]:
    """The codes in order, and code of each way to name a language (a fixed list of a few rows, read by the driver)."""
    rows = languages.orderBy("code").collect()
    names = {}
    for r in rows:
        for name in (r["own_name"], r["english_name"], r["alpha3"], r["code"]):
            if name:
                names[name.strip().lower()] = r["code"]
    return [r["code"] for r in rows], names


def named_code(column, names: dict[str, str]):
    """The code a label names, in any case, with blanks around it or a region after - or _; else null."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.lit(None).cast("map<string,string>")
    whole = F.lower(F.trim(column))
    return F.coalesce(F.element_at(table, whole), F.element_at(table, F.trim(F.regexp_replace(whole, r"[-_].*$", ""))))


def fitted(documents: DataFrame, codes: list[str], names: dict[str, str]) -> LanguageFilter:
    """The filter, fitted on up to about PER_LANGUAGE labelled pages of each language."""
    labelled = documents.select("doc_id", "text", named_code(F.col("lang"), names).alias("code"))
    labelled = labelled.filter(F.col("code").isNotNull() & F.length("text").between(SHORTEST, LONGEST))
    counts = {r["code"]: r["count"] for r in labelled.groupBy("code").count().collect()}
    chance = F.lit(0.0)
    for code, count in counts.items():
        chance = F.when(F.col("code") == code, F.lit(min(1.0, PER_LANGUAGE / count))).otherwise(chance)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    rows = labelled.filter(draw < chance).orderBy("doc_id", "text").collect()
    place = {c: i for i, c in enumerate(codes)}
    return fit([r["text"] for r in rows], np.array([place[r["code"]] for r in rows], np.int64), len(codes))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    from retort.llm.bpe import _small

    return _small(batch, "text")


def page_languages(documents: DataFrame, languages: DataFrame, min_letters: int = MIN_LETTERS, model: LanguageFilter | None = None) -> DataFrame:
    """(doc_id, lang_label, lang, letters, confidence): a row for each language that a page holds.

    ``lang_label`` is the page's own label; confidence is the mean score of the
    language's words, weighted by letters, from 0 to 1.  ``model`` is what
    ``fitted`` gave for these languages, to fit once for several calls.
    """
    codes, names = language_codes(languages)
    held = documents.sparkSession.sparkContext.broadcast(model or fitted(documents, codes, names))  # SLOTS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger, n = _worker_tagger(held), len(codes)
        for whole in batches:
            for b in _parts(whole):
                path, own, letters, count = tagger.tag(b.column("text").to_pylist())
                cell = np.repeat(np.arange(len(count)), count) * n + path
                total = np.bincount(cell, weights=letters, minlength=len(count) * n)
                score = np.bincount(cell, weights=letters * own, minlength=len(count) * n)
                cells = np.flatnonzero(total >= min_letters)
                row = pa.array(cells // n)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").take(row), b.column("lang").take(row), pa.array([codes[i] for i in cells % n], pa.string()),
                        pa.array(total[cells].astype(np.int64)), pa.array(score[cells] / total[cells]),
                    ],
                    ["doc_id", "lang_label", "lang", "letters", "confidence"],
                )

    rows = documents.select("doc_id", "lang", "text")
    return map_batches(rows, run, "doc_id bigint, lang_label string, lang string, letters bigint, confidence double")


def wrong_labels(documents: DataFrame, languages: DataFrame, model: LanguageFilter | None = None) -> DataFrame:
    """(doc_id, lang): all languages of pages that hold several, or one that their label doesn't name."""
    _, names = language_codes(languages)
    held = page_languages(documents, languages, model=model)
    label = named_code(F.col("lang_label"), names)
    per = held.groupBy("doc_id").agg(F.collect_set("lang").alias("langs"), F.collect_set(F.coalesce(label, F.lit(""))).alias("labels"))
    case = (F.size("langs") > 1) | (F.get("labels", F.lit(0)) != F.get("langs", F.lit(0)))
    return per.filter(case).select("doc_id", F.explode("langs").alias("lang"))


def segments(documents: DataFrame, languages: DataFrame, model: LanguageFilter | None = None) -> DataFrame:
    """(doc_id, segment_no, char_start, char_end, lang, letters, confidence): the stretches of one language, in order."""
    codes, names = language_codes(languages)
    held = documents.sparkSession.sparkContext.broadcast(model or fitted(documents, codes, names))  # SLOTS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _worker_tagger(held)
        for whole in batches:
            for b in _parts(whole):
                texts = b.column("text").to_pylist()
                path, own, letters, count = tagger.tag(texts)
                if not len(path):
                    continue
                spans = np.array([m.span() for t in texts if t for m in WORD.finditer(t)], np.int64).reshape(-1, 2)
                doc = np.repeat(np.arange(len(count)), count)
                first = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])])
                last = np.r_[first[1:], len(path)] - 1
                total = np.add.reduceat(letters, first)
                score = np.add.reduceat(letters * own, first) / np.maximum(1, total)
                edge = np.r_[True, doc[first][1:] != doc[first][:-1]]
                number = np.arange(len(first)) - np.maximum.accumulate(np.where(edge, np.arange(len(first)), 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").take(pa.array(doc[first])), pa.array(number.astype(np.int32)), pa.array(spans[first, 0]),
                        pa.array(spans[last, 1]), pa.array([codes[i] for i in path[first]]), pa.array(total.astype(np.int64)), pa.array(score.astype(np.float64)),
                    ],
                    ["doc_id", "segment_no", "char_start", "char_end", "lang", "letters", "confidence"],
                )

    schema = "doc_id bigint, segment_no int, char_start bigint, char_end bigint, lang string, letters bigint, confidence double"
    return map_batches(documents.select("doc_id", "text"), run, schema)
