"""Registered queries over token sequences in search, and arithmetic over arrays, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.functions import latex
from retort.functions import text as fn
from retort.operators import areas, search
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


_W = r"WITH w AS (SELECT cs_id, loaded_at, cond_data AS c, list_filter(string_split_regex(cs_string, '[ \t\r\n]+'), lambda t: t <> '') AS w FROM cs_log WHERE cs_string IS NOT NULL) "
_LONG = _W + ", l AS (SELECT cs_id, loaded_at, unnest(range(len(w))) AS pos, unnest(w) AS token FROM w) "
_MEMORY = r"(contains(w[i + 1], '\Superatom') OR contains(w[i + 1], '@'))"


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "cs_log").filter("cs_string IS NOT NULL")
    return rows.select("cs_id", "loaded_at", fn.tokens(F.col("cs_string")).alias("w"), F.col("cond_data").alias("c"))


@query(_LONG + "SELECT cs_id, loaded_at, CAST(pos AS INTEGER) AS pos, token FROM l")
def tok_split_explode(spark: SparkSession, d: str) -> DataFrame:
    return _sequences(spark, d).select("cs_id", "loaded_at", F.posexplode("w").alias("pos", "token"))


@query(r"""SELECT line_id, CAST(len(string_split(line_text, chr(9))) AS INTEGER) AS n_fields FROM raw_lines
  WHERE len(string_split(line_text, chr(9))) <> CASE feed WHEN 'label' THEN 3 ELSE 2 END""")
def row_width_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_lines").select("line_id", "feed", F.size(F.split("line_text", "\t")).alias("n_fields"))
    return rows.filter(F.col("n_fields") != F.when(F.col("feed") == "label", 3).otherwise(2)).select("line_id", "n_fields")


@query(_W + ", z AS (SELECT *, list_max(list_filter(range(1, len(w) + 1), lambda i: w[i] <> w[-1])) AS last FROM w) "
  "SELECT cs_id, loaded_at, array_to_string(CASE WHEN len(w) - coalesce(last, 0) >= 5 THEN w[1 : coalesce(last, 0)] ELSE w END, ' ') AS kept FROM z")
def tail_period1(spark: SparkSession, d: str) -> DataFrame:
    """A last token that is repeated five times and more goes with all its copies."""
    other = F.transform("w", lambda t, i: F.when(t != F.element_at("w", -1), i + 1).otherwise(0))
    rows = _sequences(spark, d).withColumn("last", F.when(F.size("w") > 0, F.array_max(other)).otherwise(0))
    kept = F.when(F.size("w") - F.col("last") >= 5, F.slice("w", F.lit(1), F.col("last"))).otherwise(F.col("w"))
    return rows.select("cs_id", "loaded_at", F.array_join(kept, " ").alias("kept"))


@query(_LONG + r""", r AS (SELECT *, pos - row_number() OVER (PARTITION BY cs_id, loaded_at ORDER BY pos) AS island FROM l WHERE token = '\connbranch'),
  n AS (SELECT cs_id, loaded_at, pos, row_number() OVER (PARTITION BY cs_id, loaded_at, island ORDER BY pos) AS rank FROM r)
  SELECT cs_id, loaded_at, CAST(pos AS INTEGER) AS pos, CAST(rank AS INTEGER) AS rank FROM n""")
def branch_run_rank(spark: SparkSession, d: str) -> DataFrame:
    ranks = search.run_ranks(F.col("w"), "\\connbranch")
    return _sequences(spark, d).select("cs_id", "loaded_at", F.posexplode(ranks).alias("pos", "rank")).filter("rank > 0")


@query(_LONG + r""", r AS (SELECT *, pos - row_number() OVER (PARTITION BY cs_id, loaded_at ORDER BY pos) AS island FROM l WHERE token = '\connbranch'),
  n AS (SELECT cs_id, loaded_at, count(*) AS n FROM r GROUP BY cs_id, loaded_at, island)
  SELECT cs_id, loaded_at, CAST(max(n) AS INTEGER) AS fan_out FROM n GROUP BY cs_id, loaded_at""")
def max_fan_out(spark: SparkSession, d: str) -> DataFrame:
    most = F.array_max(search.run_ranks(F.col("w"), "\\connbranch"))
    return _sequences(spark, d).select("cs_id", "loaded_at", most.alias("fan_out")).filter("fan_out > 0")


@query(_W + f", f AS (SELECT cs_id, loaded_at, list_transform(range(len(w)), lambda i: {_MEMORY}) AS f FROM w) "
  "SELECT cs_id, loaded_at, array_to_string(list_transform(range(1, len(f) + 1), lambda i: CASE WHEN f[i] THEN len(list_filter(f[1 : i], lambda x: x)) ELSE 0 END), ' ') AS offsets FROM f")
def segment_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _sequences(spark, d).select("cs_id", "loaded_at", F.array_join(search.offsets(F.transform("w", areas.is_memory)), " ").alias("offsets"))


@query(_W + "SELECT cs_id, loaded_at, array_to_string(list_transform(range(1, len(c) + 1), lambda i: len(list_distinct(list_filter(c[1 : i - 1], lambda v: v >= 0)))), ' ') AS n_used FROM w WHERE c IS NOT NULL")
def prefix_list(spark: SparkSession, d: str) -> DataFrame:
    rows = _sequences(spark, d).filter("c IS NOT NULL")
    return rows.select("cs_id", "loaded_at", F.array_join(F.transform(search.used_before(F.col("c")), F.size), " ").alias("n_used"))


@query(_LONG + r""", s AS (SELECT cs_id, loaded_at, max(pos) AS start FROM l WHERE token = '\chemfig' GROUP BY ALL),
  d AS (SELECT cs_id, loaded_at, pos, token, sum(CASE token WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER (PARTITION BY cs_id, loaded_at ORDER BY pos) AS depth
    FROM l JOIN s USING (cs_id, loaded_at) WHERE pos > start)
  SELECT w.cs_id, w.loaded_at, CAST(min(d.pos) AS INTEGER) AS molecule_end FROM w LEFT JOIN d ON w.cs_id = d.cs_id AND w.loaded_at = d.loaded_at AND d.token = '}' AND d.depth = 0 GROUP BY ALL""")
def molecule_end(spark: SparkSession, d: str) -> DataFrame:
    return _sequences(spark, d).select("cs_id", "loaded_at", search.molecule_end(F.col("w")).alias("molecule_end"))


@query(_W + f"""SELECT cs_id, loaded_at, CAST(len(list_filter(range(len(w)), lambda i: {_MEMORY} AND NOT coalesce(list_contains(c, CAST(i AS INTEGER)), false))) AS INTEGER) AS n_left,
  CAST(list_min(list_filter(range(len(w)), lambda i: {_MEMORY} AND NOT coalesce(list_contains(c, CAST(i AS INTEGER)), false))) AS INTEGER) AS first_left FROM w""")
def super_candidates(spark: SparkSession, d: str) -> DataFrame:
    left = _sequences(spark, d).select("cs_id", "loaded_at", search.candidates(F.col("w"), F.col("c"), areas.is_memory).alias("left"))
    return left.select("cs_id", "loaded_at", F.size("left").alias("n_left"), F.get("left", F.lit(0)).alias("first_left"))


@query(_W + f""", n AS (SELECT cs_id, loaded_at, greatest(1, len(list_filter(range(len(w)), lambda i: {_MEMORY}))) AS n FROM w)
  SELECT cs_id, loaded_at, CAST(unnest(range(n)) AS INTEGER) AS branch FROM n""")
def beam_fan_out(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.filter("w", areas.is_memory))
    return search.fan_out(_sequences(spark, d), n, "branch").select("cs_id", "loaded_at", "branch")


@query()
def candidate_sample(spark: SparkSession, d: str) -> DataFrame:
    """Up to five candidates of each sequence, the same in every run."""
    left = search.candidates(F.col("w"), F.col("c"), areas.is_memory)
    return _sequences(spark, d).select("cs_id", "loaded_at", search.some_of(left, 5, F.lit(7), F.col("cs_id")).alias("chosen"))


_E = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings) "
_T = _E + ", t AS (SELECT vec_id, label, unnest(range(len(e))) AS pos, unnest(e) AS v FROM e) "


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("e"))


@query(_T + ", r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, pos) AS k FROM t) SELECT vec_id, CAST(pos AS INTEGER) AS third FROM r WHERE k = 3")
def kth_best(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("vec_id", search.kth_best(F.col("e"), 3).alias("third"))


@query(_T + "SELECT label AS slot, CAST(pos AS INTEGER) AS pos, round(sum(v), 6) AS total FROM t GROUP BY label, pos")
def scatter_add(spark: SparkSession, d: str) -> DataFrame:
    return search.scatter_add(_vectors(spark, d), "label", "e").withColumn("total", F.round("total", 6))


@query(_T + "SELECT vec_id, label, round(v, 6) AS gathered FROM t WHERE pos = label % 8")
def gather(spark: SparkSession, d: str) -> DataFrame:
    at = F.get("e", F.col("label") % 8)
    return _vectors(spark, d).select("vec_id", "label", F.round(at, 6).alias("gathered")).filter("gathered IS NOT NULL")


@query(_T + """, p AS (SELECT label, pos, avg(v) AS v FROM t WHERE label IS NOT NULL GROUP BY label, pos), m AS (SELECT pos, avg(v) AS mean FROM p GROUP BY pos),
  z AS (SELECT pos, arg_min(v, vec_id) AS old FROM t GROUP BY pos)
  SELECT CAST(pos AS INTEGER) AS pos, round(mean, 6) AS mean, round(old + 0.9 * (mean - old) + 0.5 * (mean - old), 6) AS moved FROM m JOIN z USING (pos)""")
def model_average(spark: SparkSession, d: str) -> DataFrame:
    """Means over the labels' means, and the first vector moved towards them with momentum."""
    rows = _vectors(spark, d)
    mean = search.model_average(rows, "label", "e")
    old = rows.select("vec_id", F.posexplode("e").alias("pos", "v")).groupBy("pos").agg(F.min_by("v", "vec_id").alias("old"))
    step = F.col("mean") - F.col("old")
    moved = search.momentum_update(F.col("old"), F.col("mean"), step, 0.9, 0.5)
    return mean.join(old, "pos").select("pos", F.round("mean", 6).alias("mean"), F.round(moved, 6).alias("moved"))


def _steps(n: int, k: int) -> str:
    """SQL of ``n`` steps of a search with ``k`` beams."""
    out = _T + ", s AS (SELECT vec_id // 3 AS sample, vec_id % 3 AS step, pos, v FROM t), b0 AS (SELECT DISTINCT sample, CAST([] AS BIGINT[]) AS tokens, 0.0::DOUBLE AS neg FROM s)"
    for i in range(n):
        out += f""", b{i + 1} AS (SELECT sample, tokens, neg FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY neg, tokens) AS r FROM (
          SELECT b.sample, list_append(b.tokens, s.pos) AS tokens, b.neg - s.v AS neg FROM b{i} b JOIN s ON b.sample = s.sample AND s.step = {i}
          UNION ALL SELECT * FROM b{i} b WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.sample = b.sample AND s.step = {i}))) WHERE r <= {k})"""
    return out + f" SELECT sample, CAST(row_number() OVER (PARTITION BY sample ORDER BY neg, tokens) - 1 AS INTEGER) AS rank, array_to_string(tokens, ' ') AS tokens, round(-neg, 6) AS score FROM b{n}"


@query(_steps(3, 5))
def beam_decode(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d).select(F.expr("vec_id div 3").alias("sample"), (F.col("vec_id") % 3).alias("step"), "e")
    return search.decode_beams(rows, "sample", "step", "e", 5).withColumns({"tokens": F.array_join("tokens", " "), "score": F.round("score", 6)})


def _loop(steps: int, beams: int, tokens: int, k: int, eos: int) -> str:
    """SQL of a search whose step ``t`` scores beam ``b`` by the ``tokens`` entries from (t * beams + b) * tokens on."""
    out = _T + f""", l AS (SELECT vec_id AS sample, pos // {beams * tokens} AS step, pos // {tokens} % {beams} AS beam, pos % {tokens} AS token, v FROM t WHERE pos < {steps * beams * tokens}),
      b0 AS (SELECT DISTINCT sample, 0 AS j, 0.0::DOUBLE AS neg, CAST([] AS BIGINT[]) AS tokens, 0 AS n, false AS done FROM l)"""
    for i in range(steps):
        out += f""", c{i} AS (SELECT b.sample, b.neg - l.v AS neg, list_append(b.tokens, l.token) AS tokens, b.n + 1 AS n, l.token = {eos} AS done FROM b{i} b JOIN l ON b.sample = l.sample AND l.step = {i} AND l.beam = b.j WHERE NOT b.done
            UNION ALL SELECT sample, neg, tokens, n, done FROM b{i} WHERE done),
          b{i + 1} AS (SELECT sample, r - 1 AS j, neg, tokens, n, done FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY neg, tokens) AS r FROM c{i}) WHERE r <= {k})"""
    return out + f" SELECT sample, CAST(row_number() OVER (PARTITION BY sample ORDER BY neg / n, tokens) - 1 AS INTEGER) AS rank, array_to_string(tokens, ' ') AS tokens, round(neg / n, 6) AS cost FROM b{steps}"


@query(_loop(4, 3, 5, 3, 2))
def beam_loop(spark: SparkSession, d: str) -> DataFrame:
    """Four steps of three beams over five tokens, of which 2 ends a beam; scores are stretches of a vector."""
    cells = F.explode(F.expr("flatten(transform(sequence(0, 3), s -> transform(sequence(0, 2), b -> named_struct('step', s, 'beam', b, 'lp', slice(e, (s * 3 + b) * 5 + 1, 5)))))"))
    rows = _vectors(spark, d).select(F.col("vec_id").alias("sample"), cells.alias("c")).select("sample", "c.*")
    return search.beam_loop(rows, "sample", "step", "beam", "lp", 3, 2).withColumns({"tokens": F.array_join("tokens", " "), "cost": F.round("cost", 6)})


@query(_E + """, p AS (SELECT a.vec_id AS branch, b.vec_id AS bond, list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) AS score
    FROM e a JOIN e b ON a.vec_id // 5 = b.vec_id // 5 AND a.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY score DESC, bond) AS k FROM p) SELECT branch, bond, round(score, 5) AS score FROM r WHERE k = 1""")
def branch_bond_argmax(spark: SparkSession, d: str) -> DataFrame:
    """Each branch's best bond within its sample of five."""
    rows = _vectors(spark, d).select(F.expr("vec_id div 5").alias("sample"), "vec_id", "e")
    other = rows.select("sample", F.col("vec_id").alias("bond"), F.col("e").alias("o"))
    dot = F.aggregate(F.zip_with("e", "o", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    pairs = rows.join(other, "sample").filter("vec_id <> bond").select(F.col("vec_id").alias("branch"), "bond", dot.alias("score"))
    best = pairs.groupBy("branch").agg(F.max_by(F.struct("bond", "score"), F.struct("score", -F.col("bond"))).alias("b"))
    return best.select("branch", "b.bond", F.round("b.score", 5).alias("score"))


@query("""SELECT event_type, count(*) FILTER (value > 400) AS n, round(CASE WHEN count(*) FILTER (value > 400) > 0 THEN sum(value) FILTER (value > 400) / count(*) FILTER (value > 400) ELSE 'nan'::DOUBLE END, 4) AS mean
  FROM events GROUP BY event_type""")
def metric_or_nan(spark: SparkSession, d: str) -> DataFrame:
    high = F.when(F.col("value") > 400, F.col("value"))
    rows = table(spark, d, "events").groupBy("event_type").agg(F.count(high).alias("n"), F.coalesce(F.sum(high), F.lit(0.0)).alias("total"))
    return rows.select("event_type", "n", F.round(search.ratio_or_nan(F.col("total"), F.col("n")), 4).alias("mean"))


@query("""SELECT source, count(*) AS n, round(avg(epoch_us(loaded_at) - epoch_us(annotated_at)) / 1000000.0, 3) AS mean_seconds FROM labels_tsv GROUP BY source""")
def load_delay(spark: SparkSession, d: str) -> DataFrame:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = table(spark, d, "labels_tsv").groupBy("source").agg(F.count("*").alias("n"), F.avg(micros("loaded_at") - micros("annotated_at")).alias("m"))
    return rows.select("source", "n", F.round(F.col("m") / 1000000.0, 3).alias("mean_seconds"))


_GROUP = r"\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"
_PART = rf"({_GROUP}|[^\s{{}}^_]+)"


@query(_W + rf"SELECT cs_id, loaded_at, regexp_replace(array_to_string(w, ' '), '\^ {_PART} _ {_PART}', '_ \2 ^ \1', 'g') AS ordered FROM w")
def script_order(spark: SparkSession, d: str) -> DataFrame:
    return _sequences(spark, d).select("cs_id", "loaded_at", latex.sub_before_sup(F.array_join("w", " ")).alias("ordered"))


@query(_W + r"""SELECT cs_id, loaded_at, array_to_string(list_filter(list_transform(w, lambda t: CASE t WHEN 'branch(' THEN '(' WHEN 'branch)' THEN ')' WHEN '<ea>' THEN '' WHEN '\rightarrow' THEN '\to' ELSE t END),
  lambda t: t <> ''), ' ') AS mended FROM w""")
def word_corrections(spark: SparkSession, d: str) -> DataFrame:
    mended = latex.correct_words(F.col("w"), {"branch(": "(", "branch)": ")", "<ea>": "", "\\rightarrow": "\\to"})
    return _sequences(spark, d).select("cs_id", "loaded_at", F.array_join(mended, " ").alias("mended"))


@query(r"SELECT doc_id, length(regexp_replace(text, '([^\x00-\x7F]+)', '\\text{\1}', 'g')) - length(text) AS added FROM documents WHERE text IS NOT NULL")
def wrapped_runs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    wrapped = latex.wrap_runs(F.col("text"), r"^\x00-\x7F")
    return docs.select("doc_id", (F.length(wrapped) - F.length("text")).cast("bigint").alias("added"))


@query(rf"SELECT label_id, loaded_at, regexp_replace(regexp_replace(regexp_replace(input_chemfig, '\\(?:chemfig)\s*\{{((?:[^{{}}]|{_GROUP})*)\}}', '\1', 'g'), '\\(?:chemfig)\s*\{{((?:[^{{}}]|{_GROUP})*)\}}', '\1', 'g'), '\\(?:chemfig)\s*\{{((?:[^{{}}]|{_GROUP})*)\}}', '\1', 'g') AS bare FROM labels_tsv WHERE input_chemfig IS NOT NULL")
def unwrapped_markup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels_tsv").filter("input_chemfig IS NOT NULL")
    return rows.select("label_id", "loaded_at", latex.unwrap(F.col("input_chemfig"), ["chemfig"]).alias("bare"))
