"""Scoring hypotheses against labels: edit distance, best hypothesis, metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.session import map_batches


def best_hypothesis(pairs: DataFrame, keys: list[str], label: str, hyp: str, order: str, texts: bool = False) -> DataFrame:
    """The hypothesis of each key with the least edit distance; the first by ``order`` among equals.

    Columns: the keys, ``best`` (its order), ``dist``, ``n`` (length of the label), and with ``texts`` the two texts, ``label`` and ``hyp``.
    """
    scored = pairs.withColumn("_d", F.levenshtein(label, hyp))
    best = F.min(F.struct(F.col("_d"), F.col(order), F.length(label).alias("_n"), *([label, hyp] if texts else [])))
    return scored.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col(f"_b.{order}").alias("best"), F.col("_b._d").alias("dist"), F.col("_b._n").alias("n"),
        *([F.col(f"_b.{label}").alias("label"), F.col(f"_b.{hyp}").alias("hyp")] if texts else []))


def count_edits(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """(deleted from a, replaced, inserted from b) of one shortest edit script; a common start and end stay, replacing goes before the others."""
    begin = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[begin:], b[begin:]
    end = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a or not b:
        return len(a), 0, len(b)
    code = {t: i for i, t in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([code[t] for t in a], np.int32), np.array([code[t] for t in b], np.int32)
    table = np.empty((len(x) + 1, len(y) + 1), np.int32)
    table[0] = np.arange(len(y) + 1)
    step = np.arange(len(y) + 1)
    for i in range(1, len(x) + 1):
        row = np.minimum(table[i - 1, :-1] + (y != x[i - 1]), table[i - 1, 1:] + 1)
        row = np.r_[i, row]
        table[i] = np.minimum.accumulate(row - step) + step
    i, j, d, s, n = len(x), len(y), 0, 0, 0
    while i or j:
        here = table[i, j]
        if i and j and here == table[i - 1, j - 1] + (x[i - 1] != y[j - 1]):
            s += int(x[i - 1] != y[j - 1])
            i, j = i - 1, j - 1
        elif i and here == table[i - 1, j] + 1:
            d, i = d + 1, i - 1
        else:
            n, j = n + 1, j - 1
    return d, s, n


def edit_counts(df: DataFrame, label: str, hyp: str) -> DataFrame:
    """``df`` with n_del, n_sub, n_ins of the token arrays ``label`` and ``hyp`` (null counts as empty)."""
    fields = df.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_del int, n_sub int, n_ins int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column(label).to_pylist(), b.column(hyp).to_pylist())
            counts = np.array([count_edits(x or [], y or []) for x, y in pairs], np.int32).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, counts.T)], [*b.schema.names, "n_del", "n_sub", "n_ins"])

    return map_batches(df, run, schema)


def _guarded(n: Column) -> Column:
    return F.when(n == 0, F.lit(1e-10)).otherwise(n.cast("double"))


COUNTS = ("sent_n", "sent_correct", "d", "s", "i", "n")


def metric_table(scores: DataFrame, metrics: dict[str, dict[str, Column]]) -> DataFrame:
    """One row a metric of ``metrics``: sums of its counts (``COUNTS``, 0 where not given) over all rows, and the ratios.

    Columns: metric, the counts, wacc, wcor, sacc; zero denominators count as
    1e-10.  A row whose ``sent_n`` is null has no part in that metric.  All metrics
    come from one pass over the rows.
    """
    rows = [F.struct(F.lit(name).alias("metric"), *(given.get(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS)) for name, given in metrics.items()]
    long = scores.select(F.explode(F.array(*rows)).alias("m")).select("m.*").filter("sent_n IS NOT NULL")
    return metric_ratios(long.groupBy("metric").agg(*(F.sum(c).alias(c) for c in COUNTS)))


def metric_ratios(totals: DataFrame) -> DataFrame:
    """Sums of counts (metric, ``COUNTS``), of one pass or of several parts added up, with their ratios."""
    d, s, i, n = (F.col(c) for c in "dsin")
    return totals.select(
        "metric", *COUNTS, F.round((n - d - s - i) / _guarded(n), 6).alias("wacc"), F.round((n - d - s) / _guarded(n), 6).alias("wcor"),
        F.round(F.col("sent_correct") / _guarded(F.col("sent_n")), 6).alias("sacc"),
    )


def drop_repeated_tail(items: list[str], copies: int = 4, tail: int = 200, rounds: int = 5) -> list[str]:
    """Tokens without periods that repeat at the end.

    A period of ``n`` tokens (less than a quarter of the sequence) that repeats
    ``copies`` times or more beyond itself goes with all its repeats; then the
    same is done before each of the last tokens, up to ``tail`` of them, and all
    of that ``rounds`` times.
    """

    def repeats(seq: list[str], n: int) -> int:
        last, k = seq[len(seq) - n :], 0
        while len(seq) - (k + 2) * n >= 0 and seq[len(seq) - (k + 2) * n : len(seq) - (k + 1) * n] == last:
            k += 1
        return k

    def shorten(seq: list[str]) -> list[str]:
        again = True
        while again:
            again = False
            for n in range(1, len(seq) // copies):
                k = repeats(seq, n)
                if k >= copies:
                    seq, again = seq[: len(seq) - (k + 1) * n], True
                    break
        return seq

    for _ in range(rounds):
        before = items
        items = shorten(items)
        for cut in range(1, min(tail, len(items))):
            items = shorten(items[: len(items) - cut]) + items[len(items) - cut :] if cut < len(items) else items
        if items == before:
            break
    return items


def shorten_tails(df: DataFrame, keys: list[str], items: str) -> DataFrame:
    """The keys and ``items`` after :func:`drop_repeated_tail`; null stays null."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [None if x is None else drop_repeated_tail(x) for x in b.column(items).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(done, pa.list_(pa.string()))], [*keys, items])

    return map_batches(df.select(*keys, items), run, f"{kinds}, `{items}` array<string>")
