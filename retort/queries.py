"""Registered queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from retort import queries_areas, queries_graph, queries_markup, queries_more, queries_plans, queries_search
from retort.operators import nested
from retort.sources import lines
from retort.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.area_nodes(table(spark, d, "records")).select("record_id", "area_path", "parent_path")


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return nested.record_table(table(spark, d, "records"))


def p2_topics(spark: SparkSession, d: str) -> DataFrame:
    return nested.area_table(table(spark, d, "records"), 1)


def p2_columns(spark: SparkSession, d: str) -> DataFrame:
    return nested.area_table(table(spark, d, "records"), 2)


def p2_lines(spark: SparkSession, d: str) -> DataFrame:
    return nested.area_table(table(spark, d, "records"), 3)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.rejected_lines(table(spark, d, "raw_lines")).select("line_id", "reason")


def p4_rejected(spark: SparkSession, d: str) -> DataFrame:
    return lines.rejected_lines(table(spark, d, "raw_lines"))


def p4_valid(spark: SparkSession, d: str) -> DataFrame:
    return lines.valid_lines(table(spark, d, "raw_lines"))


_LEVELS = """
WITH once AS (SELECT record_id, arg_max(sub_areas, loaded_at) AS a FROM records GROUP BY record_id),
topics AS (SELECT record_id, CAST(i AS VARCHAR) AS area_path, '' AS parent_path, a[i + 1] AS x
  FROM (SELECT record_id, a, unnest(range(len(a))) AS i FROM once) WHERE a[i + 1] IS NOT NULL),
cols AS (SELECT record_id, area_path || '-' || i AS area_path, area_path AS parent_path, a[i + 1] AS x
  FROM (SELECT record_id, area_path, x.sub_areas AS a, unnest(range(len(x.sub_areas))) AS i FROM topics) WHERE a[i + 1] IS NOT NULL),
lns AS (SELECT record_id, area_path || '-' || i AS area_path, area_path AS parent_path, a[i + 1] AS x
  FROM (SELECT record_id, area_path, x.sub_areas AS a, unnest(range(len(x.sub_areas))) AS i FROM cols) WHERE a[i + 1] IS NOT NULL)
"""
_AREA = "SELECT record_id, area_path, parent_path, x.idx AS idx, x.text AS text, x.raw_info.text AS raw_text FROM "
_PATH = "SELECT record_id, area_path, parent_path FROM "


_Q, _SEEN = r'"(?:[^"]|"")*"', r"[^\s\x{0B}\x{85}\p{Z}]"
_BRACES = (
    "(list_reduce(list_prepend(0, list_transform(list_filter(string_split(regexp_replace(regexp_replace({0}, '\\\\[{{}}]', '', 'g'), '[^{{}}]+', '', 'g'), ''), lambda c: c <> ''), "
    "lambda c: CASE c WHEN '{{' THEN 1 ELSE -1 END)), lambda a, x: CASE WHEN a < 0 THEN a ELSE a + x END) = 0)"
)
_LINES = (
    r"""WITH l AS (SELECT *, regexp_replace(line_text, '\r\z', '') AS t, CASE feed WHEN 'reverse' THEN 2 WHEN 'label' THEN 3 ELSE -1 END AS want FROM raw_lines),
  q AS (SELECT *, regexp_full_match(t, '(?s)(?:"""
    + _Q + r"""|(?:[^"\t][^\t]*)?)(?:\t(?:""" + _Q + r"""|(?:[^"\t][^\t]*)?))*') AS sound FROM l),
  f AS (SELECT *, CASE WHEN sound THEN list_transform(regexp_extract_all(chr(9) || t, '(?s)\t(""" + _Q + r"""|[^"\t][^\t]*|)', 1),
    lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:length(x) - 1], '""', '"') ELSE x END) END AS fields FROM q),
  r AS (SELECT *, CASE WHEN t IS NULL THEN 'columns' WHEN NOT sound THEN 'quoting' WHEN len(fields) <> want OR t = '' THEN 'columns'
    WHEN NOT regexp_full_match(fields[1], '(?s).*""" + _SEEN + r""".*-[0-9]+-[0-9]+-[0-9]+') OR NOT regexp_matches(fields[2], '""" + _SEEN + r"""')
      OR NOT """ + _BRACES.format("fields[2]") + r""" OR len(list_filter(fields, lambda x: regexp_matches(x, '[\x{FFFD}\x00-\x08\x0a-\x1f\x7f-\x{9f}]'))) > 0
      OR (want = 3 AND (NOT contains(fields[3], '\chemfig') OR NOT """ + _BRACES.format("fields[3]") + r""")) THEN 'value' END AS reason FROM f) """
)
_KEY = r"regexp_extract(fields[1], '(?s)^(.*)-([0-9]+)-([0-9]+)-([0-9]+)\z', {0})"


def oracle_sql() -> dict[str, str]:
    return queries_areas.SQL | queries_graph.SQL | queries_markup.SQL | queries_more.SQL | queries_plans.SQL | queries_search.SQL | {
        "p2_found": _LEVELS + " UNION ALL ".join(_PATH + t for t in ("topics", "cols", "lns")),
        "p2_topics": _LEVELS + _AREA + "topics",
        "p2_columns": _LEVELS + _AREA + "cols",
        "p2_lines": _LEVELS + _AREA + "lns",
        "p4_found": _LINES + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
        "p4_rejected": _LINES + "SELECT line_id, feed, reason, line_text AS corrupt_text FROM r WHERE reason IS NOT NULL",
        "p4_valid": _LINES + f"""SELECT line_id, feed, fields[1] AS img_key, {_KEY.format(1)} AS image_name, TRY_CAST({_KEY.format(2)} AS BIGINT) AS topic_no,
            TRY_CAST({_KEY.format(3)} AS BIGINT) AS column_no, TRY_CAST({_KEY.format(4)} AS BIGINT) AS line_no_in_column,
            TRY_CAST({_KEY.format(2)} AS BIGINT) IS NOT NULL AND TRY_CAST({_KEY.format(3)} AS BIGINT) IS NOT NULL AND TRY_CAST({_KEY.format(4)} AS BIGINT) IS NOT NULL AS numbers_fit,
            fields[2] AS in_text, fields[3] AS input_chemfig FROM r WHERE reason IS NULL""",
        "p2_records": """
            SELECT record_id, x.s AS src_image_path, x.i AS image_path, CAST(x.n AS INTEGER) AS n_topics FROM (
              SELECT record_id, max({'l': loaded_at, 's': src_image_path, 'i': image_path,
                'n': coalesce(len(list_filter(sub_areas, lambda a: a IS NOT NULL)), 0)}) AS x FROM records GROUP BY record_id)""",
    }


def queries() -> dict[str, Query]:
    own = (p2_found, p2_records, p2_topics, p2_columns, p2_lines, p4_found, p4_rejected, p4_valid)
    return {q.__name__: q for q in own} | queries_areas.FOUND | queries_graph.FOUND | queries_markup.FOUND | queries_more.FOUND | queries_plans.FOUND | queries_search.FOUND
