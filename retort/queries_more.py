"""Registered queries over whole labels, logs and lists, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retort import queries_graph
from retort.functions import latex
from retort.functions import text as fn
from retort.operators import evaluate, isomorphism, molecules, rings, sequences
from retort.queries_markup import _AREAS, _HYPS, _WORDS
from retort.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEYS = ["label_id", "loaded_at"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def note(f: Query) -> Query:
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "labels_tsv").select(*KEYS, "input_chemfig"))


@query(r"""SELECT label_id, loaded_at, regexp_replace(input_chemfig, '\s+', '', 'g') AS text FROM labels_tsv
  WHERE input_chemfig IS NOT NULL AND len(regexp_extract_all(input_chemfig, '\\chemfig\s*\{')) = len(regexp_extract_all(input_chemfig, '"""
  + queries_graph._NESTED + "'))")
def splice_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Labels taken apart into text and molecules, and put together again."""
    return sequences.restored_text(_labels(spark, d), KEYS, "input_chemfig").filter("text IS NOT NULL").drop("error")


@query()
def label_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Each label as one sequence of tokens without rings, with what they point at."""
    made = sequences.label_sequences(_labels(spark, d), KEYS, "input_chemfig").filter("seq IS NOT NULL")
    return made.select(*KEYS, F.posexplode("seq").alias("pos", "s")).select(*KEYS, "pos", "s.token", "s.ring_branch", "s.cond")


@query(queries_graph.MOLECULES + """, odd AS (SELECT DISTINCT label_id, loaded_at FROM f WHERE m IN (SELECT m FROM bad))
  SELECT label_id, loaded_at, frag, true AS same, CAST(NULL AS VARCHAR) AS error FROM mol WHERE (label_id, loaded_at) NOT IN (SELECT (label_id, loaded_at) FROM odd)""")
def label_sequence_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The molecules read back from whole sequences against those of the labels: same or not, compared exactly."""
    labels = _labels(spark, d)
    back = rings.expand(sequences.sequence_molecules(sequences.label_sequences(labels, KEYS, "input_chemfig"), KEYS), [*KEYS, "frag", "seq"])
    back = isomorphism.with_codes(back.drop("seq"), {"after": ("atoms", "bonds")}).select(*KEYS, "frag", "after", "error")
    made = molecules.fragments(labels, KEYS, "input_chemfig").withColumn("bonds", molecules.without_self_bonds()).select(*KEYS, "frag", "atoms", "bonds")
    made = isomorphism.with_codes(made, {"before": ("atoms", "bonds")}).select(*KEYS, "frag", "before")
    return back.join(made, [*KEYS, "frag"]).select(*KEYS, "frag", (F.col("before") == F.col("after")).alias("same"), "error")


@query()
def ring_branch_bonds_of_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The bond token that each branch token of a whole sequence names."""
    made = sequences.label_sequences(_labels(spark, d), KEYS, "input_chemfig").filter("seq IS NOT NULL")
    named = F.transform("seq", lambda x, i: F.struct(i.alias("pos"), x["ring_branch"].alias("at"), F.get("seq", x["ring_branch"])["token"].alias("bond")))
    return made.select(*KEYS, F.inline(F.filter(named, lambda x: x["at"].isNotNull())))


@query(queries_graph.MOLECULES + """, e AS (SELECT m, src AS atom FROM link UNION SELECT m, dst FROM link), c AS (SELECT m, count(*) AS n FROM atom GROUP BY m)
  SELECT label_id, loaded_at, frag, CAST(count(*) FILTER (c.n = 1 OR e.atom IS NOT NULL) AS INTEGER) AS n_kept, CAST(max(c.n) AS INTEGER) AS n_atoms
  FROM mol JOIN atom USING (m) JOIN c USING (m) LEFT JOIN e ON e.m = atom.m AND e.atom = atom.atom GROUP BY ALL""")
def mol_without_isolated(spark: SparkSession, d: str) -> DataFrame:
    """Atoms left when those without a bond are dropped from molecules of several; molecules without atoms are dropped."""
    made = molecules.fragments(_labels(spark, d), KEYS, "input_chemfig").filter("error IS NULL").filter(F.size("atoms") > 0)
    return made.select(*KEYS, "frag", F.size(molecules.joined_atoms()).alias("n_kept"), F.size("atoms").alias("n_atoms"))


@query(queries_graph.MOLECULES + queries_graph._RINGS + """, two AS (SELECT i.m, i.ring AS ri, j.ring AS rj, list_sort(list_intersect(i.atoms, j.atoms)) AS x FROM ring i JOIN ring j ON i.m = j.m AND i.ring < j.ring
    WHERE len(list_intersect(i.atoms, j.atoms)) = 2)
  SELECT label_id, loaded_at, frag, ri, rj, CAST(count(link.m) AS INTEGER) AS n_bonds FROM two JOIN mol USING (m)
  LEFT JOIN link ON link.m = two.m AND ((src = x[1] AND dst = x[2]) OR (src = x[2] AND dst = x[1])) GROUP BY ALL""")
def shared_bond(spark: SparkSession, d: str) -> DataFrame:
    """The bonds between the two atoms that a pair of rings shares."""
    made = molecules.fragments(_labels(spark, d), KEYS, "input_chemfig").filter("error IS NULL")
    pairs = F.filter(molecules.ring_pairs(F.col("r")), lambda p: F.size(p["atoms"]) == 2)
    two = made.withColumn("r", molecules.rings()).withColumn("p", pairs).filter(F.size("p") > 0)
    found = two.withColumn("b", molecules.bonds_between(F.transform("p", lambda p: p["atoms"])))
    return found.select(*KEYS, "frag", F.inline(F.transform("p", lambda p, i: F.struct(p["ri"].alias("ri"), p["rj"].alias("rj"), F.size(F.get("b", i)["bonds"]).alias("n_bonds")))))


@query(queries_graph.MOLECULES + queries_graph._RINGS + """SELECT label_id, loaded_at, frag, i.ring AS ri, j.ring AS rj, list_has_all(j.atoms, i.atoms) AS inside
  FROM ring i JOIN ring j ON i.m = j.m AND i.ring <> j.ring AND list_has_any(i.atoms, j.atoms) JOIN mol ON mol.m = i.m""")
def ring_subsets(spark: SparkSession, d: str) -> DataFrame:
    """For each two rings that share atoms, whether all atoms of the first are atoms of the second."""
    made = molecules.fragments(_labels(spark, d), KEYS, "input_chemfig").filter("error IS NULL").select(*KEYS, "frag", molecules.rings().alias("r"))
    one = made.select(*KEYS, "frag", "r", F.explode("r").alias("i"))
    two = one.select(*KEYS, "frag", "i", F.explode("r").alias("j")).filter((F.col("i.ring") != F.col("j.ring")) & F.arrays_overlap("i.atoms", "j.atoms"))
    return two.select(*KEYS, "frag", F.col("i.ring").alias("ri"), F.col("j.ring").alias("rj"), (F.size(F.array_except("i.atoms", "j.atoms")) == 0).alias("inside"))


@query(queries_graph.MOLECULES + queries_graph._RINGS + "SELECT label_id, loaded_at, frag, CAST(count(*) AS INTEGER) AS n_rings, CAST(count(DISTINCT atoms) AS INTEGER) AS n_distinct FROM ring JOIN mol USING (m) GROUP BY ALL")
def distinct_rings(spark: SparkSession, d: str) -> DataFrame:
    """Rings of each molecule, and those that differ in their atoms."""
    made = molecules.fragments(_labels(spark, d), KEYS, "input_chemfig").filter("error IS NULL").withColumn("r", molecules.rings()).filter(F.size("r") > 0)
    return made.select(*KEYS, "frag", F.size("r").alias("n_rings"), F.size(F.array_distinct(F.transform("r", lambda x: x["atoms"]))).alias("n_distinct"))


@query(r"""WITH p AS (SELECT *, string_split(line_text, chr(9)) AS f FROM raw_lines), k AS (SELECT f[1] AS key, max({'l': loaded_at, 'i': line_id, 'a': coalesce(f[2], ''), 'b': coalesce(f[3], '')}) AS x FROM p WHERE line_text IS NOT NULL GROUP BY f[1])
  SELECT key, x.a AS label, x.b AS hyp FROM k""")
def log_two_maps(spark: SparkSession, d: str) -> DataFrame:
    """Key, label and hypothesis of tab-separated lines; fields that lack are empty, the last line of a key wins."""
    f = F.split("line_text", "\t")
    field = lambda i: F.coalesce(F.get("f", F.lit(i)), F.lit(""))
    rows = table(spark, d, "raw_lines").filter("line_text IS NOT NULL").withColumn("f", f)
    last = rows.groupBy(F.get("f", F.lit(0)).alias("key")).agg(F.max(F.struct("loaded_at", "line_id", field(1).alias("label"), field(2).alias("hyp"))).alias("x"))
    return last.select("key", "x.label", "x.hyp")


@query(r"""WITH p AS (SELECT DISTINCT replace(file_path, '\', '/') AS path FROM labels_tsv WHERE file_path IS NOT NULL)
  SELECT path, list_last(string_split(path, '/')) AS name, lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) AS kind FROM p""")
def image_list(spark: SparkSession, d: str) -> DataFrame:
    """The distinct files of the labels: path, name, kind."""
    paths = table(spark, d, "labels_tsv").filter("file_path IS NOT NULL").select(F.replace("file_path", F.lit("\\"), F.lit("/")).alias("path")).distinct()
    return paths.select("path", F.substring_index("path", "/", -1).alias("name"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("kind"))


@query("""SELECT source, count(*) AS n, CAST(min(page_w) AS INTEGER) AS least_w, CAST(max(page_w) AS INTEGER) AS most_w, CAST(min(page_h) AS INTEGER) AS least_h, CAST(max(page_h) AS INTEGER) AS most_h,
  CAST(sum(len(ocr_lines)) AS BIGINT) AS n_lines FROM documents GROUP BY source""")
def image_statistics(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    ends = [f("page_" + c).alias(f"{n}_{c}") for c in "wh" for n, f in (("least", F.min), ("most", F.max))]
    return docs.groupBy("source").agg(F.count("*").alias("n"), *ends, F.sum(F.size("ocr_lines").cast("bigint")).alias("n_lines"))


_BASE = r"regexp_replace(regexp_replace(list_last(string_split(replace({0}, '\', '/'), '/')), '-0-0-0$', ''), '\.[A-Za-z]+$', '')"


@query("SELECT label_id, loaded_at FROM labels_tsv WHERE file_path IS NOT NULL AND " + _BASE.format("file_path")
  + " NOT IN (SELECT " + _BASE.format("file_path") + " FROM cs_log WHERE file_path IS NOT NULL AND cond_data IS NULL)")
def ignore_anti(spark: SparkSession, d: str) -> DataFrame:
    """Labels whose file name isn't on the list to ignore (sequences without conditions)."""
    name = fn.base_name(F.col("file_path")).alias("name")
    ignored = table(spark, d, "cs_log").filter("file_path IS NOT NULL AND cond_data IS NULL").select(name)
    return table(spark, d, "labels_tsv").filter("file_path IS NOT NULL").select(*KEYS, name).join(ignored, "name", "left_anti").drop("name")


@query("""SELECT doc_id, page_h, h FROM (SELECT doc_id, page_h, list_max(list_transform(ocr_lines, lambda o: o.y + o.h)) AS h FROM documents) WHERE abs(page_h - h - 64) <= 32""")
def size_drift(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose height differs by no more than 32 from what their lines and a margin of 64 take; without lines or height a page is left out."""
    low = F.array_max(F.transform("ocr_lines", lambda o: o["y"] + o["h"])).alias("h")
    return table(spark, d, "documents").select("doc_id", "page_h", low).filter(F.abs(F.col("page_h") - F.col("h") - 64) <= 32)


@query("""WITH v AS (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS v FROM events)
  SELECT event_type, count(*) FILTER (NOT isnan(v)) AS n, round(avg(v) FILTER (NOT isnan(v)), 6) AS mean FROM v GROUP BY event_type""")
def nan_skip(spark: SparkSession, d: str) -> DataFrame:
    """Means without the values that are no numbers (every seventh is made one)."""
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    some = table(spark, d, "events").select("event_type", v.alias("v")).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return some.groupBy("event_type").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query(_HYPS + """SELECT month(l) AS load_month, count(*) AS num, CAST(sum(dist = 0) AS BIGINT) AS correct, CAST(sum(dist) AS BIGINT) AS err, CAST(sum(n) AS BIGINT) AS label,
  round(1 - sum(dist) / CAST(greatest(1, sum(n)) AS DOUBLE), 6) AS acc, round(sum(dist = 0) / CAST(count(*) AS DOUBLE), 6) AS sacc
  FROM best JOIN (SELECT cs_id, max(loaded_at) AS l FROM cs_log GROUP BY cs_id) USING (cs_id) GROUP BY 1""")
def error_rate(spark: SparkSession, d: str) -> DataFrame:
    """Edits and labels of each month, and the ratios; no labels count as one."""
    from retort.queries_markup import _best

    month = table(spark, d, "cs_log").groupBy("cs_id").agg(F.month(F.max("loaded_at")).cast("bigint").alias("load_month"))
    rows = _best(spark, d).join(month, "cs_id").groupBy("load_month")
    sums = rows.agg(F.count("*").alias("num"), F.sum((F.col("dist") == 0).cast("bigint")).alias("correct"), F.sum("dist").alias("err"), F.sum("n").alias("label"))
    acc, sacc = 1 - F.col("err") / F.greatest(F.lit(1), F.col("label")), F.col("correct") / F.col("num")
    return sums.withColumns({"acc": F.round(acc, 6), "sacc": F.round(sacc, 6)})


@query("""WITH c AS (SELECT month(loaded_at) AS load_month, unnest(cond_data) AS c, unnest(range(len(cond_data))) AS i FROM cs_log WHERE cond_data IS NOT NULL)
  SELECT load_month, count(*) FILTER (c <> -1) AS n, round(avg(CAST(c = i AS INTEGER)) FILTER (c <> -1), 6) AS accuracy, round(avg(abs(c - i)) FILTER (c <> -1), 6) AS loss FROM c GROUP BY 1""")
def masked_branch_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Conditions against their own place, those of -1 masked: share that agrees, and mean distance."""
    long = table(spark, d, "cs_log").select(F.month("loaded_at").cast("bigint").alias("load_month"), F.posexplode("cond_data").alias("i", "c"))
    kept = lambda x: F.when(F.col("c") != -1, x)
    hit, off = kept((F.col("c") == F.col("i")).cast("double")), kept(F.abs(F.col("c") - F.col("i")))
    return long.groupBy("load_month").agg(F.count(kept(F.lit(1))).alias("n"), F.round(F.avg(hit), 6).alias("accuracy"), F.round(F.avg(off), 6).alias("loss"))


@query(_HYPS.split("b AS (SELECT k AS cs_id")[0] + """r AS (SELECT k AS cs_id, label, min(j) AS label_id, min(DIST) AS dist FROM h GROUP BY k, label)
  SELECT cs_id, label_id, CAST(dist AS INTEGER) AS dist, CAST(row_number() OVER (PARTITION BY cs_id ORDER BY dist, label_id) AS INTEGER) AS rank FROM r""".replace("DIST", _HYPS.split("min({'d': ")[1].split(", 'j'")[0]))
def hypothesis_ranks(spark: SparkSession, d: str) -> DataFrame:
    """All labels of a sequence's file in the order of their distance from it; equal labels once."""
    from retort.queries_markup import _pairs

    scored = _pairs(spark, d).select("cs_id", "label_id", F.levenshtein("label", "hyp").alias("dist"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("cs_id").orderBy("dist", "label_id")))


def _sources(spark: SparkSession, d: str, text: Column, name: str) -> DataFrame:
    return table(spark, d, "labels_tsv").filter("source IS NOT NULL AND input_chemfig IS NOT NULL").select(*KEYS, text.alias(name))


@query(r"SELECT label_id, loaded_at, 'A\xrightarrow[' || source || ']{' || label_id || '}B' AS text FROM labels_tsv WHERE source IS NOT NULL AND input_chemfig IS NOT NULL")
def arrow_commands(spark: SparkSession, d: str) -> DataFrame:
    """Arrows with the source under and the id over them, made one command."""
    made = F.concat(F.lit(r"A\underset{"), "source", F.lit(r"}{\overset{"), F.col("label_id").cast("string"), F.lit(r"}{\rightarrow}}B"))
    return _sources(spark, d, latex.arrow_command(made), "text")


@query(r"SELECT label_id, loaded_at, '\begin{array}' || source || '\skip ' || label_id || '\end{array}\\' AS text FROM labels_tsv WHERE source IS NOT NULL AND input_chemfig IS NOT NULL")
def matrix_rows(spark: SparkSession, d: str) -> DataFrame:
    """Row breaks inside a table marked, the one behind it left."""
    made = F.concat(F.lit(r"\begin{array}"), "source", F.lit("\\\\"), F.col("label_id").cast("string"), F.lit("\\end{array}\\\\"))
    return _sources(spark, d, latex.skip_rows(made), "text")


@query(r"SELECT label_id, loaded_at, ltrim(input_chemfig, chr(9) || chr(10) || chr(13) || ' ') AS text FROM labels_tsv WHERE source IS NOT NULL AND input_chemfig IS NOT NULL")
def start_block(spark: SparkSession, d: str) -> DataFrame:
    """Labels behind a group of nested brackets, which goes."""
    made = F.concat(F.lit(" {a{b{"), "source", F.lit("}}} "), "input_chemfig")
    return _sources(spark, d, latex.without_first_group(made), "text")


@query(r"SELECT label_id, loaded_at, replace(replace(replace(input_chemfig, '-:', '-'), '=@', '='), ' ', '') AS text FROM labels_tsv WHERE source IS NOT NULL AND input_chemfig IS NOT NULL")
def corrected_text(spark: SparkSession, d: str) -> DataFrame:
    """Literal corrections, in order."""
    return _sources(spark, d, latex.correct_text(F.col("input_chemfig"), [("-:", "-"), ("=@", "="), (" ", "")], 1), "text")


@query(r"""SELECT label_id, loaded_at, array_to_string(regexp_extract_all(input_chemfig, '\?\[[^\]]*\]|(?:<:|>:|<\||>\||-:|=_|=\^|~/|[-=~<>])[@#]?(?:\[[^\]]*\])?|branch[()]|\\[A-Za-z]+|[A-Z][a-z]?|[^\s]'), ' ') AS tokens
  FROM labels_tsv WHERE source IS NOT NULL AND input_chemfig IS NOT NULL""")
def glued_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _sources(spark, d, F.array_join(fn.bond_tokens(F.col("input_chemfig")), " "), "tokens")


@query("WITH w AS (SELECT cs_id, loaded_at, " + _WORDS.format("cs_string") + r""" AS w FROM cs_log WHERE cs_string IS NOT NULL)
  SELECT cs_id, loaded_at, len(list_filter(w, lambda t: regexp_matches(t, '^(<:|>:|<\||>\||-:|=_|=\^|~/|[-=~<>])[@#]?(\[|$)'))) > 0 AS has_bond FROM w""")
def bond_in_item(spark: SparkSession, d: str) -> DataFrame:
    """Whether a sequence holds a bond token."""
    rows = table(spark, d, "cs_log").filter("cs_string IS NOT NULL")
    return rows.select("cs_id", "loaded_at", F.exists(fn.tokens(F.col("cs_string")), lambda t: fn.token_kind(t) == "bond").alias("has_bond"))


@query("SELECT cs_id, loaded_at, array_to_string(cond_data, '.') AS written, CAST(list_sum(cond_data) AS BIGINT) AS total FROM cs_log WHERE cond_data IS NOT NULL")
def condition_text(spark: SparkSession, d: str) -> DataFrame:
    """Conditions written with points between them, read back, and added up."""
    rows = table(spark, d, "cs_log").filter("cond_data IS NOT NULL")
    written = rows.select("cs_id", "loaded_at", F.array_join(F.transform("cond_data", lambda c: c.cast("string")), ".").alias("written"))
    back = F.transform(F.split("written", r"\."), lambda t: t.cast("bigint"))
    return written.withColumn("total", F.when(F.col("written") != "", F.aggregate(back, F.lit(0).cast("bigint"), lambda a, x: a + x)))


@query("SELECT cs_id, CAST(b AS INTEGER) AS beam FROM (SELECT DISTINCT cs_id FROM cs_log WHERE cs_id IS NOT NULL), range(5) r(b)")
def replicated_states(spark: SparkSession, d: str) -> DataFrame:
    """A state for each sequence and beam."""
    return table(spark, d, "cs_log").filter("cs_id IS NOT NULL").select("cs_id").distinct().select("cs_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("beam"))


@query("""WITH c AS (SELECT cs_id, max({'l': loaded_at, 'c': cond_data}).c AS c FROM cs_log WHERE cond_data IS NOT NULL AND cs_id IS NOT NULL GROUP BY cs_id),
  m AS (SELECT *, max(len(c)) OVER (PARTITION BY cs_id // 16) AS most FROM c)
  SELECT cs_id, array_to_string(list_concat(c, list_transform(range(CAST(ceil(most / 32.0) * 32 AS BIGINT) - len(c)), lambda i: -1)), ' ') AS padded FROM m""")
def collated(spark: SparkSession, d: str) -> DataFrame:
    """Conditions of batches of sixteen sequences, filled with -1 to the longest, rounded up to a multiple of 32."""
    rows = table(spark, d, "cs_log").filter("cond_data IS NOT NULL AND cs_id IS NOT NULL")
    last = rows.groupBy("cs_id").agg(F.max(F.struct("loaded_at", "cond_data")).alias("x")).select("cs_id", F.col("x.cond_data").alias("c"), F.expr("cs_id div 16").alias("batch"))
    width = (F.ceil(F.max(F.size("c")).over(W.partitionBy("batch")) / F.lit(32.0)) * 32).cast("int")
    padded = F.concat("c", F.array_repeat(F.lit(-1), F.col("width") - F.size("c")))
    return last.withColumn("width", width).select("cs_id", F.array_join(F.transform(padded, lambda x: x.cast("string")), " ").alias("padded"))


@query(_AREAS + """SELECT record_id, CAST(count(*) AS BIGINT) AS n_lines, string_agg(x.text, ' ' ORDER BY i, j, k) AS text FROM n WHERE x.text IS NOT NULL GROUP BY record_id""")
def record_text(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a record in reading order as one text."""
    from retort.operators import nested

    lines = nested.area_table(table(spark, d, "records"), 3).filter("text IS NOT NULL")
    order = F.transform(F.split("area_path", "-"), lambda t: t.cast("int"))
    held = lines.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("at"), "text"))).alias("x"))
    return held.select("record_id", F.size("x").cast("bigint").alias("n_lines"), F.array_join(F.transform("x", lambda t: t["text"]), " ").alias("text"))
