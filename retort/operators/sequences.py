"""Whole labels as one sequence of tokens: the text, with the ring-free tokens of each molecule in its place, and back.

A molecule stands between ``\\chemfig``, ``{`` and ``}``.  Its tokens keep what they
point at: ``ring_branch`` and ``cond`` are places of tokens in the whole sequence.

Defined results: a label without molecules is its text; a label of which one
molecule can't be written without rings, or isn't understood, gives a null
sequence and says why in ``error``; a null label gives a null sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.functions.text import let, markup_tokens, tokens
from retort.operators import molecules, rings

OPENING, CLOSING = [molecules.MARK, "{"], ["}"]


def spliced(items: Column, names: Column, parts: Column) -> Column:
    """``items`` with each token that ``names`` holds replaced by the array at its place in ``parts``; the others as arrays of one."""
    return F.flatten(F.transform(items, lambda t: let(F.array_position(names, t), lambda i: F.when(i > 0, F.get(parts, (i - 1).cast("int"))).otherwise(F.array(t)))))


def with_molecules(labels: DataFrame, made: DataFrame, keys: list[str], part: str, text_col: str) -> DataFrame:
    """``labels`` (keys, text) with rest (text and place holders), names and parts (arrays, in order) of ``made``, the molecules of each label, and the first error."""
    inside = made.groupBy(*keys).agg(
        F.max("rest").alias("rest"), F.array_sort(F.collect_list(F.struct("frag", "name", F.col(part).alias("part")))).alias("m"), F.min("error").alias("error")
    )
    both = labels.join(inside, [labels[k].eqNullSafe(inside[k]) for k in keys], "left")
    names, parts = F.transform("m", lambda x: x["name"]), F.transform("m", lambda x: x["part"])
    return both.select(
        *(labels[k] for k in keys), F.coalesce("rest", labels[text_col]).alias("rest"), F.coalesce(names, F.array().cast("array<string>")).alias("names"), parts.alias("parts"), "error"
    )


def restored_text(labels: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, text, error): labels taken apart and put together again, without white space; null where brackets don't close."""
    made = molecules.fragments(labels, keys, text_col)
    whole = made.withColumn("error", F.when(F.col("name").isNull(), F.col("error")))
    whole = whole.withColumn("tokens", F.array(F.concat(F.lit(molecules.MARK + "{"), "markup", F.lit("}"))))
    rows = with_molecules(labels.select(*keys, text_col), whole, keys, "tokens", text_col)
    text = F.array_join(spliced(tokens(F.col("rest")), F.col("names"), F.col("parts")), "")
    return rows.select(*keys, F.when(F.col("error").isNull(), F.regexp_replace(text, r"\s+", "")).alias("text"), "error")


def label_sequences(labels: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, seq, n_molecules, error): seq is an array of (token, ring_branch, cond), null where error says why."""
    made = molecules.fragments(labels, keys, text_col)
    made = made.withColumnRenamed("error", "why")
    coded = rings.contract(made, [*keys, "frag", "name", "rest", "why"], before=False).drop("n_super")
    coded = coded.withColumn("error", F.coalesce("why", "error")).drop("why")
    rows = with_molecules(labels.select(*keys, text_col), coded, keys, "seq", text_col)
    plain = lambda words: F.transform(words, lambda t: F.struct(t.alias("token"), F.lit(None).cast("int").alias("ring_branch"), F.lit(-1).alias("cond")))
    frame = lambda words: plain(F.array(*map(F.lit, words)))

    def piece(t: Column) -> Column:
        at = lambda i: F.when(i > 0, F.concat(frame(OPENING), F.get("parts", (i - 1).cast("int")), frame(CLOSING))).otherwise(plain(F.array(t)))
        return let(F.array_position("names", t), at)

    text = F.flatten(F.transform(tokens(F.col("rest")), lambda w: F.when(F.array_contains("names", w), F.array(w)).otherwise(markup_tokens(w))))
    rows = rows.select(*keys, F.size("names").alias("n_molecules"), "error", F.when(F.col("error").isNull(), F.transform(text, piece)).alias("pieces"))
    # What a piece's tokens point at moves by the length of the pieces before it, and by the two tokens that open it.
    grown = lambda out, p: F.concat(out, F.array(F.element_at(out, -1) + F.size(p)))
    starts = F.aggregate("pieces", F.array(F.lit(0)), grown)
    moved = lambda p, o: F.transform(p, lambda x: F.struct(x["token"].alias("token"), (x["ring_branch"] + o + len(OPENING)).alias("ring_branch"), F.when(x["cond"] >= 0, x["cond"] + o + len(OPENING)).otherwise(-1).alias("cond")))
    seq = let(starts, lambda s: F.flatten(F.transform("pieces", lambda p, i: moved(p, F.get(s, i)))))
    return rows.select(*keys, F.when(F.col("pieces").isNotNull(), seq).alias("seq"), "n_molecules", "error")


def sequence_molecules(sequences: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frag, seq): the molecules of whole sequences, cut out with what they point at counted from their own start."""
    opens = F.filter(F.transform("seq", lambda x, i: F.when(x["token"] == molecules.MARK, i + len(OPENING))), lambda i: i.isNotNull())
    # A molecule's tokens hold no bracket of their own, so that the first one closes it.
    closes = F.filter(F.transform("seq", lambda x, i: F.when(x["token"] == CLOSING[0], i)), lambda i: i.isNotNull())
    spans = sequences.filter("seq IS NOT NULL").select(*keys, "seq", F.posexplode(opens).alias("frag", "begin"), closes.alias("closes"))
    spans = spans.withColumn("end", F.array_min(F.filter("closes", lambda i: i >= F.col("begin"))))
    own = F.slice("seq", F.col("begin") + 1, F.col("end") - F.col("begin"))
    back = F.transform(own, lambda x: F.struct(x["token"].alias("token"), (x["ring_branch"] - F.col("begin")).alias("ring_branch"), F.when(x["cond"] >= 0, x["cond"] - F.col("begin")).otherwise(-1).alias("cond")))
    return spans.select(*keys, "frag", back.alias("seq"))
