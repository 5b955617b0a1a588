"""Registered queries over markup, token sequences and molecules, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.functions import latex
from retort.functions import text as fn
from retort.operators import dedupe, evaluate, isomorphism, molecules, nested, vocab
from retort.sources.tables import spread, table

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


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels_tsv")


@query(r"""SELECT label_id, loaded_at,
  regexp_replace(regexp_replace(list_last(string_split(replace(file_path, '\', '/'), '/')), '-0-0-0$', ''), '\.[A-Za-z]+$', '') AS base_name,
  coalesce(lower(trim(split)), lower(string_split(replace(file_path, '\', '/'), '/')[-3])) AS split,
  CAST(length(regexp_replace(input_chemfig, '\s+', '', 'g')) AS INTEGER) AS n_chars FROM labels_tsv""")
def path_keys(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select(
        "label_id", "loaded_at", fn.base_name(F.col("file_path")).alias("base_name"),
        fn.folder_split(F.col("split"), F.col("file_path")).alias("split"), F.length(fn.squeeze(F.col("input_chemfig"))).alias("n_chars"),
    )


@query("""SELECT file_path, arg_min(label_id, {'l': loaded_at, 'i': label_id}) AS label_id FROM labels_tsv GROUP BY file_path""")
def first_wins_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = _labels(spark, d).select("file_path", "label_id", "loaded_at")
    return dedupe.first_wins(rows, ["file_path"], ["loaded_at", "label_id"]).select("file_path", "label_id")


@query("""SELECT file_path, arg_max(label_id, {'l': loaded_at, 'i': label_id}) AS label_id FROM labels_tsv GROUP BY file_path""")
def last_wins_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = _labels(spark, d).select("file_path", "label_id", "loaded_at")
    return dedupe.last_wins(rows, ["file_path"], ["loaded_at", "label_id"]).select("file_path", "label_id")


_WORDS = r"list_filter(string_split_regex({0}, '[ \t\r\n]+'), lambda t: t <> '')"


@query(
    "WITH w AS (SELECT unnest(" + _WORDS.format("string_split(cs_string, '—')[1]") + r""") AS token FROM cs_log),
  r(token, id) AS (VALUES ('\unk', 0), ('<s>', 1), ('</s>', 2), ('\enter', 3), ('\jump', 4), ('\space', 5)),
  n AS (SELECT DISTINCT token FROM (SELECT token FROM w UNION ALL SELECT '>@') WHERE token NOT IN (SELECT token FROM r))
  SELECT token, CAST(id AS BIGINT) AS id FROM r UNION ALL SELECT token, 5 + row_number() OVER (ORDER BY token) AS id FROM n""")
def vocab_build(spark: SparkSession, d: str) -> DataFrame:
    return vocab.build_vocab(table(spark, d, "cs_log"), "cs_string")


_LONG = "l AS (SELECT cs_id, loaded_at, unnest(range(len(w))) AS pos, unnest(w) AS token FROM (SELECT cs_id, loaded_at, " + _WORDS.format("cs_string") + " AS w FROM cs_log))"


def _long(spark: SparkSession, d: str) -> DataFrame:
    return vocab.sequence_tokens(table(spark, d, "cs_log"), ["cs_id", "loaded_at"], "cs_string")


@query("WITH " + _LONG + " SELECT cs_id, loaded_at, CAST(pos AS INTEGER) AS pos, l.token, coalesce(v.id, 0) AS id FROM l LEFT JOIN vocab v ON l.token = v.token")
def vocab_encode(spark: SparkSession, d: str) -> DataFrame:
    return vocab.encode(_long(spark, d), table(spark, d, "vocab"))


@query("WITH " + _LONG + r""" SELECT l.token, count(*) AS n FROM l LEFT JOIN vocab v ON l.token = v.token
  WHERE coalesce(v.token, '\unk') <> l.token GROUP BY l.token""")
def vocab_decode_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vocab")
    back = vocab.decode(vocab.encode(_long(spark, d), v), v)
    return back.filter(F.col("word") != F.col("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("WITH " + _LONG + """ SELECT month(loaded_at) AS load_month, count(*) AS n_tokens,
  CAST(sum(CASE WHEN v.token IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unknown FROM l LEFT JOIN vocab v ON l.token = v.token GROUP BY 1""")
def vocab_oov_rate(spark: SparkSession, d: str) -> DataFrame:
    coded = vocab.encode(_long(spark, d), table(spark, d, "vocab"), -1)
    unknown = F.sum((F.col("id") == -1).cast("bigint"))
    return coded.groupBy(F.month("loaded_at").cast("bigint").alias("load_month")).agg(F.count("*").alias("n_tokens"), unknown.alias("n_unknown"))


@query("WITH w AS (SELECT cs_id, loaded_at, " + _WORDS.format("cs_string") + r""" AS w FROM cs_log)
  SELECT cs_id, loaded_at, array_to_string(list_filter(w, lambda t: t NOT IN ('\smear', '\space', '\connbranch')), ' ') AS kept FROM w""")
def special_token_drop(spark: SparkSession, d: str) -> DataFrame:
    items = fn.drop_tokens(fn.tokens(F.col("cs_string")), [*fn.SPECIAL, "\\connbranch"])
    return table(spark, d, "cs_log").select("cs_id", "loaded_at", F.array_join(items, " ").alias("kept"))


@query("WITH w AS (SELECT cs_id, loaded_at, " + _WORDS.format("cs_string") + r""" AS w FROM cs_log)
  SELECT cs_id, loaded_at, array_to_string(CASE WHEN list_contains(w, '<ea>') THEN w[1 : list_position(w, '<ea>') - 1] ELSE w END, ' ') AS kept FROM w""")
def truncate_at_marker(spark: SparkSession, d: str) -> DataFrame:
    items = fn.cut_at(fn.tokens(F.col("cs_string")), [*fn.ENDS, "<ea>"])
    return table(spark, d, "cs_log").select("cs_id", "loaded_at", F.array_join(items, " ").alias("kept"))


@query(r"""WITH c AS (SELECT doc_id, unnest(list_filter(string_split(text, ''), lambda c: c <> '')) AS c FROM documents)
  SELECT CASE WHEN unicode(c) > 65535 THEN '\LUC_' || printf('%08X', unicode(c)) WHEN unicode(c) > 127 THEN '\UC_' || printf('%04X', unicode(c)) ELSE c END AS token,
    count(*) AS n FROM c GROUP BY 1""")
def unicode_tokens(spark: SparkSession, d: str) -> DataFrame:
    chars = table(spark, d, "documents").select(F.explode(fn.char_tokens(F.col("text"))).alias("token"))
    return chars.groupBy("token").agg(F.count("*").alias("n"))


@query("SELECT doc_id, true AS same, CAST(length(text) AS INTEGER) AS n_chars FROM documents WHERE text IS NOT NULL")
def unicode_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    back = fn.chars_back(fn.char_tokens(F.col("text")))
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", (back == F.col("text")).alias("same"), F.length(back).alias("n_chars"))


@query(r"""SELECT label_id, loaded_at, replace(regexp_replace(regexp_replace(input_chemfig, '\\color\s*\{[^{}]*\}', '', 'g'), ' *([{}]) *', '\1', 'g'), '--', '-:') AS cleaned FROM labels_tsv""")
def strip_regex_chain(spark: SparkSession, d: str) -> DataFrame:
    cleaned = fn.plain_bonds(fn.tight_braces(fn.without_color(F.col("input_chemfig"))))
    return _labels(spark, d).select("label_id", "loaded_at", cleaned.alias("cleaned"))


@query(r"SELECT label_id, loaded_at, regexp_replace(input_chemfig, '\[:[0-9]*\]', '', 'g') AS bare FROM labels_tsv")
def angle_strip(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("label_id", "loaded_at", fn.without_angles(F.col("input_chemfig")).alias("bare"))


@query(r"SELECT label_id, loaded_at, regexp_replace(regexp_replace(input_chemfig, '\s+', '', 'g'), '_\{([^}]*)\}', '\1', 'g') AS unwrapped FROM labels_tsv")
def subscript_unwrap(spark: SparkSession, d: str) -> DataFrame:
    items = fn.unwrap_subscripts(fn.markup_tokens(F.col("input_chemfig")))
    return _labels(spark, d).select("label_id", "loaded_at", F.array_join(items, "").alias("unwrapped"))


@query(r"""WITH c AS (SELECT label_id, loaded_at, unnest(range(len(s))) AS i, unnest(s) AS c
    FROM (SELECT label_id, loaded_at, string_split(regexp_replace(input_chemfig, '[^{}]+', '', 'g'), '') AS s FROM labels_tsv WHERE input_chemfig IS NOT NULL)),
  r AS (SELECT *, sum(CASE c WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER (PARTITION BY label_id, loaded_at ORDER BY i) AS depth FROM c)
  SELECT label_id, loaded_at, CAST(least(0, min(depth)) AS INTEGER) AS lowest, CAST(arg_max(depth, i) AS INTEGER) AS last FROM r GROUP BY ALL""")
def brace_balance(spark: SparkSession, d: str) -> DataFrame:
    rows = _labels(spark, d).filter("input_chemfig IS NOT NULL")
    return rows.select("label_id", "loaded_at", fn.depth_range(F.col("input_chemfig")).alias("r")).select("label_id", "loaded_at", "r.*")


@query()
def brace_repair(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_lines").select("line_id", fn.balance_braces(F.col("line_text")).alias("r"))
    return rows.select("line_id", "r.text", "r.bad")


@query(r"""SELECT line_id, CAST(unnest(range(len(f))) AS INTEGER) AS frag, unnest(f) AS fragment FROM (SELECT line_id,
  regexp_extract_all(line_text, '\\chemfig\s*\{((?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*)\}', 1) AS f FROM raw_lines) WHERE len(f) > 0
  AND line_id NOT IN (SELECT line_id FROM raw_lines WHERE len(regexp_extract_all(line_text, '\\chemfig\s*\{')) <> len(regexp_extract_all(line_text, '\\chemfig\s*\{((?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*)\}')))""")
def brace_spans(spark: SparkSession, d: str) -> DataFrame:
    made = molecules.fragments(table(spark, d, "raw_lines"), ["line_id"], "line_text")
    whole = made.filter("error IS NULL OR error NOT LIKE 'brackets%'")
    return whole.select("line_id", "frag", F.col("markup").alias("fragment"))


@query("WITH " + _LONG + """, m AS (SELECT *, length(token) = 1 AND pos > 0 AND pos < max(pos) OVER (PARTITION BY cs_id, loaded_at) AS one FROM l),
  g AS (SELECT *, sum(CASE WHEN one AND prev THEN 0 ELSE 1 END) OVER (PARTITION BY cs_id, loaded_at ORDER BY pos) AS island
    FROM (SELECT *, coalesce(lag(one) OVER (PARTITION BY cs_id, loaded_at ORDER BY pos), false) AS prev FROM m)),
  j AS (SELECT cs_id, loaded_at, island, string_agg(token, '' ORDER BY pos) AS token FROM g GROUP BY cs_id, loaded_at, island)
  SELECT cs_id, loaded_at, string_agg(token, ' ' ORDER BY island) AS merged FROM j GROUP BY cs_id, loaded_at""")
def run_merge(spark: SparkSession, d: str) -> DataFrame:
    items = fn.tokens(F.col("cs_string"))
    rows = table(spark, d, "cs_log").filter(F.size(items) > 0)
    return rows.select("cs_id", "loaded_at", F.array_join(fn.merge_single_chars(items), " ").alias("merged"))


@query()
def tail_period_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "cs_log").select("cs_id", "loaded_at", fn.tokens(F.col("cs_string")).alias("items"))
    short = evaluate.shorten_tails(rows, ["cs_id", "loaded_at"], "items")
    return short.select("cs_id", "loaded_at", F.array_join("items", " ").alias("kept"))


@query("WITH w AS (SELECT cs_id, loaded_at, " + _WORDS.format("cs_string") + r""" AS w FROM cs_log)
  SELECT cs_id, loaded_at, array_to_string(list_transform(w, lambda t: replace(CASE WHEN t IN ('(', ')', '-') THEN '{' || t || '}' ELSE t END, 'branch', '')), ' ') AS wrapped FROM w""")
def hyp_bracket_wrap(spark: SparkSession, d: str) -> DataFrame:
    items = fn.wrap_brackets(fn.tokens(F.col("cs_string")))
    return table(spark, d, "cs_log").select("cs_id", "loaded_at", F.array_join(items, " ").alias("wrapped"))


@query("WITH " + _LONG + r""" SELECT CASE WHEN regexp_matches(token, '^\?\[[^,\]]*,') THEN 'hook_end' WHEN regexp_matches(token, '^\?\[') THEN 'hook_start'
    WHEN regexp_matches(token, '^(<:|>:|<\||>\||-:|=_|=\^|~/|[-=~<>])[@#]?(\[|$)') THEN 'bond' WHEN token IN ('(', 'branch(') THEN 'branch_start'
    WHEN token IN (')', 'branch)') THEN 'branch_end' WHEN token IN ('{', '}') THEN 'bracket' WHEN regexp_matches(token, '^\[:') THEN 'angle' ELSE 'atom' END AS kind,
  count(*) AS n FROM l GROUP BY 1""")
def token_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _long(spark, d).groupBy(fn.token_kind(F.col("token")).alias("kind")).agg(F.count("*").alias("n"))


_AREAS = """WITH once AS (SELECT record_id, max({'l': loaded_at, 'i': image_path}).i AS image_path, arg_max(sub_areas, loaded_at) AS a FROM records GROUP BY record_id),
  t AS (SELECT record_id, image_path, i, a[i + 1].sub_areas AS b FROM (SELECT *, unnest(range(len(a))) AS i FROM once)),
  c AS (SELECT record_id, image_path, i, j, b[j + 1].sub_areas AS c FROM (SELECT *, unnest(range(len(b))) AS j FROM t)),
  n AS (SELECT record_id, image_path, i, j, k, c[k + 1] AS x FROM (SELECT *, unnest(range(len(c))) AS k FROM c) WHERE c[k + 1] IS NOT NULL) """


@query(_AREAS + "SELECT list_last(string_split(image_path, '/')) || '-' || i || '-' || j || '-' || k AS image_key, x.text AS text FROM n")
def log_name_join(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "records")
    names = nested.record_table(records).select("record_id", F.substring_index("image_path", "/", -1).alias("name"))
    lines = nested.area_table(records, 3)
    key = F.when(F.col("name").isNotNull(), F.concat_ws("-", "name", "area_path"))
    return lines.join(names, "record_id").select(key.alias("image_key"), "text")


@query("""WITH o AS (SELECT file_path, arg_max(input_chemfig, {'l': loaded_at, 'i': label_id}) AS label FROM labels_tsv WHERE input_chemfig IS NOT NULL GROUP BY file_path)
  SELECT c.cs_id, c.loaded_at, o.label FROM cs_log c JOIN o ON c.file_path = o.file_path""")
def origin_label_join(spark: SparkSession, d: str) -> DataFrame:
    known = _labels(spark, d).filter("input_chemfig IS NOT NULL").select("file_path", "input_chemfig", "loaded_at", "label_id")
    last = dedupe.last_wins(known, ["file_path"], ["loaded_at", "label_id"]).select("file_path", F.col("input_chemfig").alias("label"))
    return table(spark, d, "cs_log").join(last, "file_path").select("cs_id", "loaded_at", "label")


@query("SELECT label_id, loaded_at FROM labels_tsv l WHERE EXISTS (SELECT 1 FROM cs_log c WHERE c.file_path = l.file_path)")
def ref_semi(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).join(table(spark, d, "cs_log"), "file_path", "left_semi").select("label_id", "loaded_at")


@query("SELECT label_id, loaded_at FROM labels_tsv l WHERE NOT EXISTS (SELECT 1 FROM cs_log c WHERE c.file_path = l.file_path)")
def ref_anti(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).join(table(spark, d, "cs_log"), "file_path", "left_anti").select("label_id", "loaded_at")


@query("""WITH a AS (SELECT file_path, count(*) AS n FROM labels_tsv WHERE file_path IS NOT NULL GROUP BY 1),
  b AS (SELECT replace(file_path, '.png', '.jpg') AS file_path, count(*) AS n FROM cs_log WHERE file_path IS NOT NULL GROUP BY 1)
  SELECT coalesce(a.file_path, b.file_path) AS file_path, coalesce(a.n, 0) AS n_labels, coalesce(b.n, 0) AS n_logs FROM a FULL JOIN b ON a.file_path = b.file_path""")
def pair_full_outer(spark: SparkSession, d: str) -> DataFrame:
    count = lambda df, path, n: df.filter("file_path IS NOT NULL").groupBy(path.alias("file_path")).agg(F.count("*").alias(n))
    a = count(_labels(spark, d), F.col("file_path"), "n_labels")
    b = count(table(spark, d, "cs_log"), F.replace("file_path", F.lit(".png"), F.lit(".jpg")), "n_logs")
    return a.join(b, "file_path", "full_outer").na.fill(0)


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN input_chemfig IS NULL OR trim(input_chemfig) = '' THEN 'empty' ELSE 'label' END AS status FROM labels_tsv
  UNION ALL SELECT CASE WHEN cs_string IS NULL OR trim(cs_string) = '' THEN 'empty' ELSE 'sequence' END FROM cs_log) GROUP BY status""")
def parts_union(spark: SparkSession, d: str) -> DataFrame:
    part = lambda name, text, kind: table(spark, d, name).select(F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").otherwise(kind).alias("status"))
    both = part("labels_tsv", "input_chemfig", "label").unionByName(part("cs_log", "cs_string", "sequence"))
    return both.groupBy("status").agg(F.count("*").alias("n"))


#: Characters beyond ASCII of a pair (``u``) take the place of unused control characters, so that DuckDB, which counts bytes, counts characters.
_CONTROLS = " || ".join(f"chr({i})" for i in [*range(1, 9), *range(14, 28)])
_OTHERS = "array_to_string(list_distinct(list_filter(string_split(label || hyp, ''), lambda c: unicode(c) > 127)), '') AS u"
_DISTANCE = f"levenshtein(translate(label, u, {_CONTROLS}), translate(hyp, u, {_CONTROLS}))"
_RAW = _AREAS + f""", e AS (SELECT *, {_OTHERS} FROM (SELECT record_id, i || '-' || j || '-' || k AS area_path, x.raw_info.text AS label, x.text AS hyp FROM n
  WHERE x.text IS NOT NULL AND x.raw_info.text IS NOT NULL)) """


def _line_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Lines with both a text and a raw text."""
    lines = nested.area_table(table(spark, d, "records"), 3).filter("text IS NOT NULL AND raw_text IS NOT NULL")
    return lines.select("record_id", "area_path", F.col("raw_text").alias("label"), F.col("text").alias("hyp"))


@query(_RAW + f"SELECT record_id, area_path, CAST({_DISTANCE} AS INTEGER) AS dist FROM e")
def edit_distance(spark: SparkSession, d: str) -> DataFrame:
    return _line_pairs(spark, d).select("record_id", "area_path", F.levenshtein("label", "hyp").alias("dist"))


@query()
def edit_ops_dsi(spark: SparkSession, d: str) -> DataFrame:
    pairs = _line_pairs(spark, d).withColumns({"a": fn.markup_tokens(F.col("label")), "b": fn.markup_tokens(F.col("hyp"))})
    return evaluate.edit_counts(pairs.select("record_id", "area_path", "a", "b"), "a", "b").drop("a", "b")


_HYPS = r"""WITH c AS (SELECT cs_id, x.f AS file_path, x.s AS cs_string FROM (SELECT cs_id, max({'l': loaded_at, 'f': file_path, 's': cs_string}) AS x FROM cs_log GROUP BY cs_id)),
h AS (SELECT *, """ + _OTHERS + r""" FROM (SELECT c.cs_id AS k, l.label_id AS j, regexp_replace(l.input_chemfig, '\s+', '', 'g') AS label, regexp_replace(c.cs_string, '\s+', '', 'g') AS hyp
  FROM c JOIN (SELECT DISTINCT file_path, label_id, input_chemfig FROM labels_tsv) l ON c.file_path = l.file_path WHERE l.input_chemfig IS NOT NULL AND c.cs_string IS NOT NULL)),
b AS (SELECT k AS cs_id, min({'d': """ + _DISTANCE + """, 'j': j, 'n': length(label)}) AS x FROM h GROUP BY k),
best AS (SELECT cs_id, x.j AS best, CAST(x.d AS INTEGER) AS dist, CAST(x.n AS INTEGER) AS n FROM b) """


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """(cs_id, hyp, label, label_id): a sequence's last delivery with the labels of its file; equal labels of a file once."""
    last = dedupe.last_wins(table(spark, d, "cs_log").select("cs_id", "loaded_at", "file_path", "cs_string"), ["cs_id"], ["loaded_at", "file_path", "cs_string"])
    hyps = last.filter("cs_string IS NOT NULL").select("cs_id", "file_path", fn.squeeze(F.col("cs_string")).alias("hyp"))
    labels = _labels(spark, d).filter("input_chemfig IS NOT NULL").groupBy("file_path", fn.squeeze(F.col("input_chemfig")).alias("label")).agg(F.min("label_id").alias("label_id"))
    return hyps.join(labels, "file_path").drop("file_path")


def _best(spark: SparkSession, d: str, texts: bool = False) -> DataFrame:
    """Of all labels of a sequence's file, the one nearest to the sequence."""
    return evaluate.best_hypothesis(_pairs(spark, d), ["cs_id"], "label", "hyp", "label_id", texts)


@query(_HYPS + "SELECT cs_id, best, dist, n FROM best")
def best_hypothesis(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d)


@query(_HYPS + """SELECT count(*) AS sent_n, CAST(sum(CAST(dist = 0 AS BIGINT)) AS BIGINT) AS sent_correct, CAST(sum(dist) AS BIGINT) AS edits, CAST(sum(n) AS BIGINT) AS n,
  round((sum(n) - sum(dist)) / CASE WHEN sum(n) = 0 THEN 1e-10 ELSE CAST(sum(n) AS DOUBLE) END, 6) AS wacc, round(sum(CAST(dist = 0 AS BIGINT)) / CAST(count(*) AS DOUBLE), 6) AS sacc FROM best""")
def metric_base(spark: SparkSession, d: str) -> DataFrame:
    """Sequences against their nearest label, by characters."""
    counted = evaluate.metric_table(_best(spark, d), {"base": {"sent_n": F.lit(1), "sent_correct": F.col("dist") == 0, "s": F.col("dist"), "n": F.col("n")}})
    return counted.select("sent_n", "sent_correct", F.col("s").alias("edits"), "n", "wacc", "sacc")


def _molecules(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(_labels(spark, d).select("label_id", "loaded_at", "input_chemfig"))
    return molecules.fragments(rows, ["label_id", "loaded_at"], "input_chemfig")


@query()
def mol_graph(spark: SparkSession, d: str) -> DataFrame:
    made = _molecules(spark, d).filter("error IS NULL").select("label_id", "loaded_at", "frag", molecules.n_rings().alias("n_rings"), molecules.extent().alias("e"),
        F.array_max(F.transform(molecules.degrees(), lambda x: x["degree"])).alias("max_degree"), F.size(molecules.reach()).alias("n_reached"),
        F.size(molecules.strongest_bonds()).alias("n_distinct_bonds"), molecules.signature().alias("signature"))
    return made.select("*", "e.*").drop("e")


@query()
def mol_errors(spark: SparkSession, d: str) -> DataFrame:
    made = molecules.fragments(table(spark, d, "raw_lines"), ["line_id"], "line_text")
    return made.filter("error IS NOT NULL").select("line_id", "frag", "error")


@query()
def mol_isomorphism(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the classes of molecules that are one graph, with how many ways of writing each has.

    Ways of writing are counted first; only those whose signature others share are compared atom by atom.
    """
    written = _molecules(spark, d).filter("error IS NULL").groupBy(fn.squeeze(F.col("markup")).alias("markup")).agg(
        F.count("*").alias("n"), F.any_value("atoms").alias("atoms"), F.any_value("bonds").alias("bonds")
    )
    marked = written.withColumn("signature", molecules.signature())
    shared = marked.groupBy("signature").agg(F.count("*").alias("ways"))
    both = marked.join(shared, "signature")
    only = {f"_{c}": F.when(F.col("ways") > 1, F.col(c)) for c in ("atoms", "bonds")}
    coded = isomorphism.with_codes(both.select("signature", "n", *(c.alias(k) for k, c in only.items())), {"code": ("_atoms", "_bonds")})
    return coded.groupBy("signature", "code").agg(F.sum("n").alias("n"), F.count("*").alias("n_written"))


def _quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


_DROPPED, _MADE = latex.FONTS + latex.SIZES, latex.SPACES | latex.LETTERS | latex.SYNONYMS
_IGNORED = ", ".join(map(_quoted, _DROPPED))
_EXPANDED = ", ".join(f"({_quoted(w)}, [{', '.join(map(_quoted, out))}])" for w, out in _MADE.items())


@query(
    f"WITH e(w, x) AS (VALUES {_EXPANDED}), "
    + r"""l AS (SELECT label_id, loaded_at, unnest(range(len(s))) AS pos, unnest(s) AS t FROM (SELECT label_id, loaded_at, regexp_extract_all(input_chemfig,
  '(\\UC_[0-9A-F]{4}|\\LUC_[0-9A-F]{8}|\\[A-Za-z]+|\\[^\sA-Za-z]|\S)') AS s FROM labels_tsv)) """
    + f"""SELECT label_id, loaded_at, string_agg(coalesce(array_to_string(x, ' '), t), ' ' ORDER BY pos) AS canonical FROM l LEFT JOIN e ON t = w
  WHERE t NOT IN ({_IGNORED}) GROUP BY label_id, loaded_at""")
def latex_tokens(spark: SparkSession, d: str) -> DataFrame:
    items = fn.markup_tokens(F.col("input_chemfig"))
    rows = _labels(spark, d).select("label_id", "loaded_at", F.array_join(latex.canonical_tokens(items, _MADE, _DROPPED), " ").alias("canonical"))
    return rows.filter("canonical <> ''")


@query("WITH w AS (SELECT cs_id, loaded_at, " + _WORDS.format("cs_string") + r""" AS w FROM cs_log)
  SELECT cs_id, loaded_at, array_to_string(list_transform(list_filter(w, lambda t: NOT (prefix(t, '[:') AND suffix(t, ']'))),
    lambda t: CASE WHEN contains(t, '[:') AND suffix(t, ']') THEN string_split(t, '[:')[1] WHEN t = '\:' THEN ':' ELSE t END), ' ') AS plain FROM w""")
def text_without_angles(spark: SparkSession, d: str) -> DataFrame:
    items = latex.without_angle_tokens(fn.tokens(F.col("cs_string")))
    return table(spark, d, "cs_log").select("cs_id", "loaded_at", F.array_join(items, " ").alias("plain"))
