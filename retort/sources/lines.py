"""Tab-separated lines: a permissive read, and the reasons for which lines fail.

A line is read under an explicit schema in permissive mode; the raw text of a
line that doesn't fit is retained.  Lines that the reader reports, and all that
hold a quote or a control character (where readers differ), are then classified
again by exact checks of quoting, number of columns and values.  Reasons, first
that applies: ``quoting``, ``columns``, ``value``.  A line of more columns than
the reader takes goes to the checks without it.  A null line, and a line of an
unknown or null feed, is ``columns``; an empty line is ``columns``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of each feed.
FEEDS = {"reverse": ["img_key", "in_text"], "label": ["img_key", "in_text", "input_chemfig"]}
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"(?=\t|\z)'
_SUSPECT = r'["\p{Cc}&&[^\t]]'


def _braces_pair(field: Column) -> Column:
    """Curly brackets, other than those after a backslash, pair up in order."""
    bare = F.regexp_replace(F.regexp_replace(field, r"\\[{}]", ""), r"[^{}]+", "")
    for _ in range(4):  # most brackets are gone after their innermost pairs; what is left is folded
        bare = F.replace(bare, F.lit("{}"), F.lit(""))
    depth = F.aggregate(
        F.split(bare, ""),
        F.lit(0),
        lambda at, c: F.when(at < 0, at).when(c == "{", at + 1).when(c == "}", at - 1).otherwise(at),
    )
    return depth == 0


def _blank(field: Column) -> Column:
    return ~field.rlike(r"(?U)\S")


def _bad_value(fields: Column, n: Column) -> Column:
    key, text, markup = F.get(fields, F.lit(0)), F.get(fields, F.lit(1)), F.get(fields, F.lit(2))
    foul = F.exists(fields, lambda f: f.rlike(r"[\x{FFFD}\p{Cc}&&[^\t]]"))
    bad = ~key.rlike(r"(?sU)^.*\S.*-[0-9]+-[0-9]+-[0-9]+\z") | _blank(text) | ~_braces_pair(text) | foul
    return bad | F.when(n == 3, ~markup.contains("\\chemfig") | ~_braces_pair(markup)).otherwise(F.lit(False))


def read_lines(df: DataFrame, text_col: str = "line_text", feed_col: str = "feed") -> DataFrame:
    """``df`` with ``fields`` (unquoted, null where quoting fails), ``corrupt_text`` and ``reason`` (null for valid lines)."""
    kept = df.columns
    line = F.regexp_replace(F.col(text_col), r"\r\z", "")
    widest = max(FEEDS.values(), key=len)
    schema = ", ".join(f"{c} STRING" for c in widest) + ", _corrupt STRING"
    options = {
        "sep": "\t", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt",
        "nullValue": "\x00", "emptyValue": "", "maxCharsPerColumn": "-1", "maxColumns": "20480",
    }
    expected = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in FEEDS.items() for x in (k, len(v))]), F.col(feed_col)), F.lit(-1))
    # The reader takes short rows of up to 20 000 columns; a line with more tabs is classified below without it.
    short = F.length(line) - F.length(F.replace(line, F.lit("\t"))) < 20000
    read = df.withColumn("_line", line).withColumn("_expected", expected)
    read = read.withColumn("_read", F.from_csv(F.when(short & (F.col("_line") != ""), F.col("_line")), schema, options))
    suspect = F.col("_read").isNull() | F.col("_line").rlike(_SUSPECT) | F.col("_read._corrupt").isNotNull()
    # The reader gives null for an empty field as for a missing one.
    for c in widest:
        suspect |= F.col(f"_read.{c}").isNull()
    easy = F.array(*[F.col(f"_read.{c}") for c in widest])
    read = read.withColumn("_suspect", F.coalesce(suspect, F.lit(True)))
    # Exact cut of suspect lines: well-formed quoted fields are replaced to see whether a stray opening quote is left.
    bare = F.regexp_replace("_line", r"(?<=\A|\t)" + _QUOTED, "q")
    read = read.withColumn("_quoting", F.coalesce(F.col("_suspect") & bare.rlike(r'(?:\A|\t)"'), F.lit(False)))
    cut = F.regexp_extract_all(F.concat(F.lit("\t"), F.col("_line")), F.lit(r"\t(" + _QUOTED + r"|[^\t]*+)"), F.lit(1))
    bare_cut = F.transform(cut, lambda f: F.when(f.startswith('"'), F.replace(F.substr(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))
    fields = F.when(F.col("_quoting") | F.col("_line").isNull(), F.lit(None)).when(F.col("_suspect"), bare_cut).otherwise(easy)
    read = read.withColumn("fields", fields).withColumn("_n", F.coalesce(F.size("fields"), F.lit(-1)))
    reason = (
        F.when(F.col("_line").isNull(), "columns")
        .when(F.col("_quoting"), "quoting")
        .when((F.col("_n") != F.col("_expected")) | (F.col("_line") == ""), "columns")
        .when(_bad_value(F.col("fields"), F.col("_n")), "value")
    )
    # Through a generator, so that a filter on the reason isn't pushed down and worked out a second time.
    result = F.struct("fields", F.when(reason.isNotNull(), F.col(text_col)).alias("corrupt_text"), reason.alias("reason"))
    return read.select(*kept, F.inline(F.array(result)))


def rejected_lines(df: DataFrame) -> DataFrame:
    """(line_id, feed, reason, corrupt_text) of the lines that fail."""
    return read_lines(df).filter(F.col("reason").isNotNull()).select("line_id", "feed", "reason", "corrupt_text")


def valid_lines(df: DataFrame) -> DataFrame:
    """Typed rows of the valid lines: the key in its parts, the texts, and the markup of feed ``label``.

    A number of the key beyond BIGINT is valid by the rules, but has no typed
    value: it is null, ``numbers_fit`` is false, and ``img_key`` keeps it.
    """
    good = read_lines(df).filter(F.col("reason").isNull())
    key = F.get("fields", F.lit(0))
    part = lambda i: F.regexp_extract(key, r"(?s)^(.*)-([0-9]+)-([0-9]+)-([0-9]+)\z", i)
    numbers = ["topic_no", "column_no", "line_no_in_column"]
    rows = good.select(
        "line_id", "feed", key.alias("img_key"), part(1).alias("image_name"), *(part(i).try_cast("bigint").alias(n) for i, n in enumerate(numbers, 2)),
        F.get("fields", F.lit(1)).alias("in_text"), F.get("fields", F.lit(2)).alias("input_chemfig"),
    )
    fit = F.col(numbers[0]).isNotNull() & F.col(numbers[1]).isNotNull() & F.col(numbers[2]).isNotNull()
    return rows.withColumn("numbers_fit", fit)
