"""Vocabularies: building, encoding and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.functions.text import tokens
from retort.operators.numbering import number_rows

#: Reserved tokens in the order of their ids, and a token every vocabulary has.
RESERVED = ["\\unk", "<s>", "</s>", "\\enter", "\\jump", "\\space"]
SEED = ">@"


def build_vocab(df: DataFrame, text_col: str) -> DataFrame:
    """(token, id): reserved tokens first, then all others in order of their code points.

    A text counts up to its first ``—``.  Null and blank texts add nothing.
    """
    found = df.select(F.explode(tokens(F.substring_index(text_col, "—", 1))).alias("token"))
    spark = df.sparkSession
    seed = spark.createDataFrame([(SEED,)], "token string")
    distinct = found.unionByName(seed).filter(~F.col("token").isin(RESERVED)).distinct()
    numbered = number_rows(distinct, F.substring("token", 1, 2), ["token"], name="id")
    reserved = spark.createDataFrame(list(zip(RESERVED, range(len(RESERVED)))), "token string, id bigint")
    return reserved.unionByName(numbered.select("token", (F.col("id") + len(RESERVED)).alias("id")))


def sequence_tokens(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Long form of token sequences: the keys, pos from 0, token."""
    return df.select(*keys, F.posexplode(tokens(F.col(text_col))).alias("pos", "token"))


def encode(long: DataFrame, vocab: DataFrame, unknown: int = 0) -> DataFrame:
    """``long`` with the id of each token, ``unknown`` where the vocabulary lacks it. The optimizer picks the join by size."""
    ids = vocab.groupBy("token").agg(F.min("id").alias("id"))
    return long.join(ids, "token", "left").withColumn("id", F.coalesce("id", F.lit(unknown))).select(*long.columns, "id")


def decode(long: DataFrame, vocab: DataFrame, unknown: str = "\\unk") -> DataFrame:
    """``long``, which has ``id``, with ``word``: the id's token, ``unknown`` where there is none."""
    words = vocab.groupBy("id").agg(F.min("token").alias("word"))
    return long.join(words, "id", "left").withColumn("word", F.coalesce("word", F.lit(unknown)))
