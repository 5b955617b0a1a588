"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder`` (one file or a directory)."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a scan over all cores, for work that takes longer than a shuffle; a scan of enough parts is left as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


#: Entries that a table of words may have; it becomes part of the plan.
MOST_WORDS = 20_000


def word_table(spark: SparkSession, path: str, most: int = MOST_WORDS) -> dict[str, list[str]]:
    """A table of replacements, read from lines ``word<TAB>tokens`` (tokens parted by blanks, none to drop the word); the last line of a word wins.

    Lines are taken in the file's order of bytes read, so a word should stand once; blank lines count as none.
    """
    lines = spark.read.text(path).filter("trim(value) <> ''").limit(most + 1).collect()
    if len(lines) > most:
        raise ValueError(f"{path} has more than {most} words")
    parts = [r["value"].split("\t", 1) for r in lines]
    return {p[0].strip(): p[1].split() if len(p) > 1 else [] for p in parts}


def label_lines(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """(file_path, input_chemfig, error) of text files with a path and a label a line; the label keeps further separators.

    A line without a separator has a null label and says so in ``error``; blank lines are left out.
    """
    at = F.instr("value", separator)
    rows = spark.read.text(path).filter("trim(value) <> ''").select("value", at.alias("at"))
    return rows.select(
        F.when(F.col("at") > 0, F.substring("value", F.lit(1), F.col("at") - 1)).otherwise(F.col("value")).alias("file_path"),
        F.when(F.col("at") > 0, F.substring("value", F.col("at") + len(separator), F.length("value"))).alias("input_chemfig"),
        F.when(F.col("at") == 0, "too few columns").alias("error"),
    )


def write_parts(rows: DataFrame, folder: str, error_col: str = "error") -> None:
    """Rows without error as ``folder/result``, those with one as ``folder/error`` (Parquet, overwritten)."""
    rows.filter(F.col(error_col).isNull()).drop(error_col).write.mode("overwrite").parquet(f"{folder}/result")
    rows.filter(F.col(error_col).isNotNull()).write.mode("overwrite").parquet(f"{folder}/error")
