"""Frequency of every distinct term, by a range-partitioned sort and run-length scan.

A row for each occurrence of a term in a delivery of a record is range-partitioned
and sorted on (term, record); a frequent term then spreads over many partitions,
while all rows of one pair of term and record stay in one.  Every partition is
scanned once in order: runs of equal pairs are the distinct records, and their
lengths the occurrences.  The partial counts of a term that spans partitions are
added up in the end.

Defined results: a record delivered again counts once (of a term its deliveries
hold unequally often, the greatest count); rows with a null record id are left
out; null and blank texts hold no terms but count as records; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.session import map_batches

#: A term in fewer records than this is rare, in more than this share of all records common.
RARE, COMMON = 3, 0.5


def term_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, record, delivery) for each occurrence; ``delivery`` tells the rows of ``df`` apart."""
    words = F.filter(F.split(F.col(text_col), "[ \t\r\n]+"), lambda t: t != "")
    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("record"), words.alias("words"), F.monotonically_increasing_id().alias("delivery"))
    return rows.select(F.explode("words").alias("term"), "record", "delivery")


class _Open:
    """The runs that a batch leaves open: of a term, a record of it, and a delivery of that."""

    term, record, delivery = None, None, None
    #: Occurrences in, and number of, the term's closed records; most in a closed delivery of the record; those in the delivery.
    occurrences = records = most = n = 0


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of sorted (term, record, delivery); the open runs are carried from batch to batch."""
    state = _Open()

    def counted(terms: list, occurrences, records) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(occurrences, pa.int64()), pa.array(records, pa.int64())], ["term", "occurrences", "records"])

    for b in batches:
        if not b.num_rows:
            continue
        coded = b.column("term").dictionary_encode()
        code, record, delivery = coded.indices.to_numpy(), b.column("record").to_numpy(zero_copy_only=False), b.column("delivery").to_numpy()
        weight = np.ones(len(code), np.int64)
        first = coded.dictionary[int(code[0])].as_py()
        if state.term is not None:
            # What is open goes before the batch as a row that stands for its occurrences.
            code = np.r_[code[0] if state.term == first else -1, code]
            record, delivery = np.concatenate([np.array([state.record], record.dtype), record]), np.r_[state.delivery, delivery]
            weight = np.r_[state.n, weight]
        new_term = np.r_[True, code[1:] != code[:-1]]
        new_record = new_term | np.r_[True, record[1:] != record[:-1]]
        start = np.flatnonzero(new_record | np.r_[True, delivery[1:] != delivery[:-1]])
        in_delivery = np.add.reduceat(weight, start)
        records_at = np.flatnonzero(new_record[start])
        in_record = np.maximum.reduceat(in_delivery, records_at)
        in_record[0] = max(in_record[0], state.most)
        terms_at = np.flatnonzero(new_term[start[records_at]])
        occurrences = np.add.reduceat(in_record, terms_at)
        records = np.diff(np.r_[terms_at, len(records_at)])
        occurrences[0] += state.occurrences
        records[0] += state.records
        codes = code[start[records_at[terms_at]]]
        names = [state.term if c < 0 else coded.dictionary[int(c)].as_py() for c in codes]
        yield counted(names[:-1], occurrences[:-1], records[:-1])
        closed = in_delivery[records_at[-1] : -1].max(initial=0)
        state.most = max(closed, state.most) if len(records_at) == 1 else closed
        state.term, state.record, state.delivery, state.n = names[-1], record[-1], delivery[-1], in_delivery[-1]
        state.occurrences, state.records = occurrences[-1] - in_record[-1], records[-1] - 1
    if state.term is not None:
        yield counted([state.term], [state.occurrences + max(state.most, state.n)], [state.records + 1])


def term_frequencies(df: DataFrame, id_col: str, text_col: str, rare: int = RARE, common: float = COMMON) -> DataFrame:
    """(term, occurrences, records, n_records, mark): mark is rare, common or null; rare goes before common."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = term_pairs(df, id_col, text_col)
    ordered = pairs.repartitionByRange(parts, "term", "record").sortWithinPartitions("term", "record", "delivery")
    partial = map_batches(ordered, _scan, "term string, occurrences bigint, records bigint")
    counted = partial.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    total = df.filter(F.col(id_col).isNotNull()).select(id_col).distinct().agg(F.count("*").alias("n_records"))
    mark = F.when(F.col("records") < rare, "rare").when(F.col("records") > F.col("n_records") * F.lit(common), "common")
    return counted.join(F.broadcast(total)).withColumn("mark", mark)  # total is one row
