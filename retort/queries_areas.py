"""Registered queries over nested areas, scan lines and targets, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.functions import text as fn
from retort.operators import areas, molecules
from retort.queries_graph import MOLECULES
from retort.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def note(f: Query) -> Query:
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


@query("""WITH c AS (SELECT record_id, loaded_at, list_filter(list_transform(sub_areas, lambda t: {'idx': t.idx, 'c': list_filter(list_transform(t.sub_areas,
    lambda c: {'idx': c.idx, 'n': len(list_filter(c.sub_areas, lambda l: l IS NOT NULL AND trim(l.idx) <> ''))}), lambda c: trim(c.idx) <> '' AND c.n > 0)}),
    lambda t: trim(t.idx) <> '' AND len(t.c) > 0) AS x FROM records WHERE sub_areas IS NOT NULL)
  SELECT record_id, loaded_at, CAST(len(x) AS INTEGER) AS n_topics, CAST(coalesce(list_sum(list_transform(x, lambda t: len(t.c))), 0) AS INTEGER) AS n_columns,
    CAST(coalesce(list_sum(list_transform(x, lambda t: list_sum(list_transform(t.c, lambda c: c.n)))), 0) AS INTEGER) AS n_lines FROM c""")
def indexed_areas(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "records").filter("sub_areas IS NOT NULL").select("record_id", "loaded_at", areas.indexed_areas(F.col("sub_areas")).alias("x"))
    total = lambda a, f: F.aggregate(a, F.lit(0), lambda s, v: s + f(v))
    n_columns = total(F.col("x"), lambda t: F.size(t["sub_areas"]))
    n_lines = total(F.col("x"), lambda t: total(t["sub_areas"], lambda c: F.size(c["sub_areas"])))
    return rows.select("record_id", "loaded_at", F.size("x").alias("n_topics"), n_columns.alias("n_columns"), n_lines.alias("n_lines"))


@query("""WITH l AS (SELECT doc_id, page_w, page_h, list_sum(list_transform(ocr_lines, lambda x: CAST(coalesce(x.char_len, 0) AS DOUBLE))) AS n,
    list_sum(list_transform(ocr_lines, lambda x: CAST(coalesce(x.h * x.char_len, 0) AS DOUBLE))) AS hn FROM documents WHERE page_w IS NOT NULL AND page_h IS NOT NULL),
  r AS (SELECT doc_id, hn / n AS ch, CAST(round_even(page_w * (40.0::DOUBLE / (hn / n)), 0) AS BIGINT) AS sw, CAST(round_even(page_h * (40.0::DOUBLE / (hn / n)), 0) AS BIGINT) AS sh FROM l WHERE n > 0),
  c AS (SELECT *, CASE WHEN sh > 900 AND sw > 1000 THEN CASE WHEN sh > sw THEN 900.0::DOUBLE / sh ELSE 1000.0::DOUBLE / sw END WHEN sh > 900 THEN 900.0::DOUBLE / sh WHEN sw > 1000 THEN 1000.0::DOUBLE / sw ELSE 1.0::DOUBLE END AS clip FROM r)
  SELECT doc_id, round(ch, 4) AS char_height, CAST(round_even(sw * clip, 0) AS BIGINT) AS w, CAST(round_even(sh * clip, 0) AS BIGINT) AS h, round(40.0::DOUBLE / ch * clip, 6) AS scale FROM c""")
def item_scale(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "documents").filter("page_w IS NOT NULL AND page_h IS NOT NULL")
    rows = pages.select("doc_id", "page_w", "page_h", areas.line_height(F.col("ocr_lines")).alias("ch")).filter("ch IS NOT NULL")
    size = areas.scaled_size(F.col("page_w"), F.col("page_h"), F.col("ch"), 40, 1000, 900)
    return rows.select("doc_id", F.round("ch", 4).alias("char_height"), size.alias("s")).select("doc_id", "char_height", "s.w", "s.h", F.round("s.scale", 6).alias("scale"))


@query(r"""WITH w AS (SELECT cs_id, loaded_at, list_filter(string_split_regex(cs_string, '[ \t\r\n]+'), lambda t: t <> '') AS w FROM cs_log WHERE cs_string IS NOT NULL)
  SELECT cs_id, loaded_at, list_filter(range(len(w)), lambda i: contains(w[i + 1], '\Superatom') OR contains(w[i + 1], '@')) AS memory,
    list_filter(range(len(w)), lambda i: (contains(w[i + 1], '[:') AND suffix(w[i + 1], ']')) OR (prefix(w[i + 1], '?[') AND suffix(w[i + 1], ']') AND contains(w[i + 1], ','))) AS bonds FROM w""")
def target_indices(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "cs_log").filter("cs_string IS NOT NULL").select("cs_id", "loaded_at", fn.tokens(F.col("cs_string")).alias("w"))
    at = lambda wanted: F.transform(areas.places(F.col("w"), wanted), lambda i: i.cast("bigint"))
    return rows.select("cs_id", "loaded_at", at(areas.is_memory).alias("memory"), at(areas.is_bond).alias("bonds"))


@query(r"""SELECT v.id, CASE WHEN contains(v.token, '\Superatom') OR contains(v.token, '@') THEN 'memory'
    WHEN (contains(v.token, '[:') AND suffix(v.token, ']')) OR (prefix(v.token, '?[') AND suffix(v.token, ']') AND contains(v.token, ',')) THEN 'bond' ELSE 'other' END AS kind, count(l.token) AS n
  FROM vocab v LEFT JOIN (SELECT unnest(list_filter(string_split_regex(cs_string, '[ \t\r\n]+'), lambda t: t <> '')) AS token FROM cs_log) l ON v.token = l.token GROUP BY 1, 2""")
def vocab_token_sets(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "cs_log").select(F.explode(fn.tokens(F.col("cs_string"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    kind = F.when(areas.is_memory(F.col("token")), "memory").when(areas.is_bond(F.col("token")), "bond").otherwise("other")
    return table(spark, d, "vocab").join(used, "token", "left").select("id", kind.alias("kind"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2""")
def json_map_scan(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.from_json("props", "map<string,string>")
    rows = table(spark, d, "events").select("event_type", F.element_at(parsed, "k").try_cast("bigint").alias("k"))
    return rows.groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT doc_id, unnest(ocr_lines) AS l FROM documents WHERE ocr_lines IS NOT NULL)
  SELECT doc_id, count(*) AS n_lines, CAST(min(l.x) AS INTEGER) AS x0, CAST(min(l.y) AS INTEGER) AS y0, CAST(max(l.x + l.w) - min(l.x) + 1 AS INTEGER) AS w, CAST(max(l.y + l.h) - min(l.y) + 1 AS INTEGER) AS h FROM x GROUP BY doc_id""")
def foreground_box(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter(F.size("ocr_lines") > 0)
    least = lambda f: F.array_min(F.transform("ocr_lines", f))
    most = lambda f: F.array_max(F.transform("ocr_lines", f))
    x0, y0 = least(lambda l: l["x"]), least(lambda l: l["y"])
    w, h = most(lambda l: l["x"] + l["w"]) - x0 + 1, most(lambda l: l["y"] + l["h"]) - y0 + 1
    return rows.select("doc_id", F.size("ocr_lines").cast("bigint").alias("n_lines"), x0.alias("x0"), y0.alias("y0"), w.alias("w"), h.alias("h"))


@query(MOLECULES + """, e AS (SELECT m, src AS atom FROM link UNION SELECT m, dst FROM link), n AS (SELECT atom.m, count(*) AS n, count(*) FILTER (e.atom IS NULL) AS lone
    FROM atom LEFT JOIN e ON e.m = atom.m AND e.atom = atom.atom GROUP BY atom.m)
  SELECT label_id, loaded_at, frag, CAST(CASE WHEN n.n > 1 THEN n.lone ELSE 0 END AS INTEGER) AS n_isolated, trim(markup) = '' AND m NOT IN (SELECT m FROM link) AS is_empty FROM mol LEFT JOIN n USING (m)""")
def mol_isolated_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Molecules of several atoms in which some atom has no bond, and drawn-away bonds and empty molecules."""
    made = molecules.fragments(table(spark, d, "labels_tsv"), ["label_id", "loaded_at"], "input_chemfig").filter("error IS NULL")
    lone = F.size(F.filter(molecules.degrees(), lambda x: x["degree"] == 0))
    empty = F.size("bonds").eqNullSafe(F.lit(0)) & (F.trim("markup") == "")
    return made.select("label_id", "loaded_at", "frag", F.when(F.size("atoms") > 1, lone).otherwise(0).alias("n_isolated"), empty.alias("is_empty"))
