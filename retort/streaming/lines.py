"""The line reader over a stream: it keeps no state, so that a stream gives what a batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retort.sources.lines import read_lines


def stream_lines(spark: SparkSession, folder: str, feed: str) -> DataFrame:
    """Lines of the text files that arrive in ``folder``, classified: value, feed, fields, corrupt_text, reason."""
    arriving = spark.readStream.text(folder)
    return read_lines(arriving.selectExpr("value AS line_text", f"'{feed}' AS feed"))
