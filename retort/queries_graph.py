"""Registered queries over the graphs of molecules, and their SQL, which works them out from token positions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.functions import text as fn
from retort.operators import dedupe, evaluate, isomorphism, molecules, rings
from retort.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEYS = ["label_id", "loaded_at", "frag"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def note(f: Query) -> Query:
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


_NESTED = r"\\chemfig\s*\{((?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*)\}"
_BOND = r"(?:<:|>:|<\||>\||-:|=_|=\^|~/|[-=~<>])[@#]?"
_TOKENS = rf"\?\[[^,\]]*(?:,[^\]]*)?\]|{_BOND}(?:\[[^\]]*\])?|branch\(|\(|branch\)|\)|\{{(?:[^{{}}]|\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})*\}}|\\?."
#: Tokens of the molecules with their depth; bonds with the place where their branch closes; hooks in pairs; molecules without error.
MOLECULES = rf"""WITH whole AS (SELECT label_id, loaded_at, input_chemfig AS t FROM labels_tsv
    WHERE len(regexp_extract_all(input_chemfig, '\\chemfig\s*\{{')) = len(regexp_extract_all(input_chemfig, '{_NESTED}'))),
  f AS (SELECT *, row_number() OVER () AS m FROM (SELECT label_id, loaded_at, CAST(unnest(range(len(x))) AS INTEGER) AS frag, unnest(x) AS markup
    FROM (SELECT label_id, loaded_at, regexp_extract_all(t, '{_NESTED}', 1) AS x FROM whole))),
  k AS (SELECT m, unnest(range(len(x))) AS p, unnest(x) AS t FROM (SELECT m, regexp_extract_all(regexp_replace(markup, '\s+', '', 'g'), '{_TOKENS}') AS x FROM f)),
  kk AS (SELECT *, t IN ('(', 'branch(') AS opens, t IN (')', 'branch)') AS closes, regexp_matches(t, '^{_BOND}') AS bond, regexp_full_match(t, '\?\[[^,\]]*(?:,[^\]]*)?\]') AS hook FROM k),
  tok AS (SELECT *, sum(CASE WHEN opens THEN 1 WHEN closes THEN -1 ELSE 0 END) OVER (PARTITION BY m ORDER BY p) AS depth FROM kk),
  b0 AS (SELECT m, p, t, depth, row_number() OVER (PARTITION BY m ORDER BY p) AS atom, regexp_extract(t, '\[([^\],]*)', 1) AS attr,
    coalesce(TRY_CAST(nullif(regexp_extract(t, '\[[^\],]*,([^\],]*)', 1), '') AS DOUBLE), 1) AS len FROM tok WHERE bond),
  b1 AS (SELECT b0.*, (SELECT min(c.p) FROM tok c WHERE c.m = b0.m AND c.closes AND c.p > b0.p AND c.depth < b0.depth) AS until FROM b0),
  b AS (SELECT m, p, t, atom, coalesce(until, 1000000000) AS until, attr, len,
    CASE WHEN prefix(attr, ':') THEN TRY_CAST(attr[2:] AS DOUBLE) WHEN attr = '' THEN 0 ELSE TRY_CAST(attr AS DOUBLE) * 45 END AS angle FROM b1),
  h AS (SELECT *, row_number() OVER (PARTITION BY m, name ORDER BY p) AS nth, count(*) OVER (PARTITION BY m, name) AS times, min(p) OVER (PARTITION BY m, name) AS other
    FROM (SELECT m, p, regexp_extract(t, '\?\[([^,\]]*)', 1) AS name, regexp_extract(t, ',([^\]]*)\]', 1) AS kind FROM tok WHERE hook)),
  bad AS (SELECT m FROM tok GROUP BY m HAVING min(depth) < 0 OR arg_max(depth, p) <> 0 UNION SELECT m FROM h WHERE times = 1 OR (nth = 1 AND kind <> '')
    UNION SELECT m FROM b WHERE angle IS NULL),
  mol AS (SELECT * FROM f WHERE m NOT IN (SELECT m FROM bad)),
  atom AS (SELECT m, CAST(0 AS BIGINT) AS atom, CAST(-1 AS BIGINT) AS p FROM mol WHERE m IN (SELECT m FROM tok) UNION ALL SELECT m, atom, p FROM b WHERE m IN (SELECT m FROM mol)),
  up AS (SELECT a.m, a.atom, b.atom AS above, b.angle, b.len FROM atom a JOIN b ON a.m = b.m AND b.p <= a.p AND a.p < b.until),
  coords AS (SELECT atom.m, atom.atom, coalesce(sum(len * cos(radians(angle))), 0) AS x, coalesce(sum(len * sin(radians(angle))), 0) AS y FROM atom LEFT JOIN up ON atom.m = up.m AND atom.atom = up.atom GROUP BY ALL),
  ends AS (SELECT h.m, h.p, h.kind, (SELECT coalesce(max(b.atom), 0) FROM b WHERE b.m = h.m AND b.p < h.p AND h.p < b.until) AS a,
    (SELECT coalesce(max(b.atom), 0) FROM b WHERE b.m = h.m AND b.p < h.other AND h.other < b.until) AS o FROM h WHERE nth > 1 AND m IN (SELECT m FROM mol)),
  link AS (SELECT b.m, b.p, coalesce((SELECT max(q.atom) FROM b q WHERE q.m = b.m AND q.p < b.p AND b.p < q.until), 0) AS src, b.atom AS dst FROM b WHERE b.m IN (SELECT m FROM mol)
    UNION ALL SELECT m, p, o, a FROM ends) """
_RINGS = """, way AS (SELECT m, atom, above FROM up UNION ALL SELECT m, atom, 0 FROM atom),
  side AS (SELECT e.m, e.p, w.above, count(*) AS n FROM (SELECT m, p, a AS x FROM ends WHERE a <> o UNION ALL SELECT m, p, o FROM ends WHERE a <> o) e JOIN way w ON w.m = e.m AND w.atom = e.x GROUP BY ALL),
  around AS (SELECT m, p, above AS x FROM side WHERE n = 1 UNION ALL SELECT m, p, max(above) FROM side WHERE n = 2 GROUP BY m, p),
  ring AS (SELECT m, CAST(row_number() OVER (PARTITION BY m ORDER BY p) - 1 AS INTEGER) AS ring, list_sort(list(x)) AS atoms FROM around GROUP BY m, p HAVING count(*) > 2) """


def _molecules(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "labels_tsv").select("label_id", "loaded_at", "input_chemfig"))
    return molecules.fragments(rows, ["label_id", "loaded_at"], "input_chemfig")


def _sound(spark: SparkSession, d: str) -> DataFrame:
    return _molecules(spark, d).filter("error IS NULL")


@query(MOLECULES + """SELECT label_id, loaded_at, frag, CAST(CASE WHEN m IN (SELECT m FROM bad) THEN NULL ELSE (SELECT count(*) FROM atom WHERE atom.m = f.m) END AS INTEGER) AS n_atoms,
    CAST(CASE WHEN m IN (SELECT m FROM bad) THEN NULL ELSE (SELECT count(*) FROM link WHERE link.m = f.m) END AS INTEGER) AS n_bonds FROM f
  UNION ALL SELECT label_id, loaded_at, 0, NULL, NULL FROM labels_tsv WHERE input_chemfig IS NOT NULL AND (label_id, loaded_at) NOT IN (SELECT (label_id, loaded_at) FROM whole)""")
def mol_counts(spark: SparkSession, d: str) -> DataFrame:
    return _molecules(spark, d).select(*KEYS, F.size("atoms").alias("n_atoms"), F.size("bonds").alias("n_bonds"))


@query(MOLECULES + "SELECT label_id, loaded_at, frag, CAST(atom AS INTEGER) AS atom, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM coords JOIN mol USING (m)")
def mol_coords(spark: SparkSession, d: str) -> DataFrame:
    atoms = _sound(spark, d).select(*KEYS, F.inline("atoms"))
    return atoms.select(*KEYS, F.col("id").alias("atom"), "x", "y")


@query(MOLECULES + """, e AS (SELECT m, src AS atom FROM link UNION ALL SELECT m, dst FROM link WHERE src <> dst),
  n AS (SELECT m, atom, count(*) AS n FROM e GROUP BY m, atom)
  SELECT label_id, loaded_at, frag, CAST(coalesce(max(n), 0) AS INTEGER) AS max_degree, CAST(count(*) FILTER (n = 1) AS INTEGER) AS n_ends FROM mol JOIN atom USING (m) LEFT JOIN n USING (m, atom) GROUP BY ALL""")
def mol_degree(spark: SparkSession, d: str) -> DataFrame:
    each = _sound(spark, d).filter(F.size("atoms") > 0).select(*KEYS, F.transform(molecules.degrees(), lambda x: x["degree"]).alias("n"))
    return each.select(*KEYS, F.array_max("n").alias("max_degree"), F.size(F.filter("n", lambda x: x == 1)).alias("n_ends"))


@query(MOLECULES + """SELECT label_id, loaded_at, frag, CAST(count(DISTINCT (least(src, dst), greatest(src, dst))) AS INTEGER) AS n_pairs, CAST(count(*) FILTER (src = dst) AS INTEGER) AS n_loops
  FROM mol JOIN link USING (m) GROUP BY ALL""")
def bond_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = _sound(spark, d).filter(F.size("bonds") > 0)
    loops = F.size("bonds") - F.size(molecules.without_self_bonds())
    return rows.select(*KEYS, F.size(molecules.strongest_bonds()).alias("n_pairs"), loops.alias("n_loops"))


@query(MOLECULES + _RINGS + "SELECT label_id, loaded_at, frag, ring, CAST(len(atoms) AS INTEGER) AS n_atoms, array_to_string(atoms, '-') AS atoms FROM ring JOIN mol USING (m)")
def mol_rings(spark: SparkSession, d: str) -> DataFrame:
    made = _sound(spark, d).select(*KEYS, F.inline(molecules.rings()))
    return made.select(*KEYS, "ring", F.size("atoms").alias("n_atoms"), F.array_join("atoms", "-").alias("atoms"))


@query(MOLECULES + _RINGS + """SELECT label_id, loaded_at, frag, i.ring AS ri, j.ring AS rj, CAST(len(list_intersect(i.atoms, j.atoms)) AS INTEGER) AS n_shared
  FROM ring i JOIN ring j ON i.m = j.m AND i.ring < j.ring AND list_has_any(i.atoms, j.atoms) JOIN mol ON mol.m = i.m""")
def ring_adjacency(spark: SparkSession, d: str) -> DataFrame:
    pairs = _sound(spark, d).select(*KEYS, molecules.rings().alias("r")).select(*KEYS, F.inline(molecules.ring_pairs(F.col("r"))))
    return pairs.select(*KEYS, "ri", "rj", F.size("atoms").alias("n_shared"))


@query(MOLECULES + _RINGS + """SELECT label_id, loaded_at, frag, ring, CAST(count(*) FILTER (list_contains(atoms, src) <> list_contains(atoms, dst)) AS INTEGER) AS n_outer
  FROM ring JOIN mol USING (m) JOIN link USING (m) GROUP BY ALL""")
def ring_branch_bonds(spark: SparkSession, d: str) -> DataFrame:
    made = _sound(spark, d).withColumn("r", molecules.rings()).filter(F.size("r") > 0)
    return made.select(*KEYS, F.inline(molecules.outer_bonds(F.col("r")))).select(*KEYS, "ring", F.size("bonds").alias("n_outer"))


@query(MOLECULES + """SELECT label_id, loaded_at, frag, CAST(a.atom AS INTEGER) AS atom, CAST(min(o.atom) AS INTEGER) AS merged_into FROM coords a
  JOIN coords o ON a.m = o.m AND o.atom < a.atom AND (a.x - o.x) * (a.x - o.x) + (a.y - o.y) * (a.y - o.y) < 0.0001 JOIN mol ON mol.m = a.m GROUP BY ALL""")
def atom_merge(spark: SparkSession, d: str) -> DataFrame:
    moved = _sound(spark, d).select(*KEYS, F.inline(molecules.merged_into()))
    return moved.filter(F.col("to") < F.col("id")).select(*KEYS, F.col("id").alias("atom"), F.col("to").alias("merged_into"))


@query()
def merged_molecules(spark: SparkSession, d: str) -> DataFrame:
    one = molecules.merge_atoms(_sound(spark, d).select(*KEYS, "atoms", "bonds"))
    return one.select(*KEYS, F.size("atoms").alias("n_atoms"), F.size("bonds").alias("n_bonds"), F.sort_array(F.transform("atoms", lambda a: a["text"])).alias("texts"))


@query(MOLECULES + """SELECT label_id, loaded_at, frag, CAST(count(*) AS INTEGER) AS n_bonds FROM mol JOIN b USING (m) WHERE m NOT IN (SELECT m FROM tok WHERE opens OR hook)
  GROUP BY ALL HAVING bool_and(angle <= 15 OR angle >= 345)""")
def flat_molecules(spark: SparkSession, d: str) -> DataFrame:
    rows = _sound(spark, d).filter(F.size("bonds") > 0).withColumn("flat", molecules.flat_text())
    return rows.filter("flat IS NOT NULL").select(*KEYS, F.size("bonds").alias("n_bonds"))


@query(MOLECULES + """, s AS (SELECT mol.m, CAST(floor(sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y)) / 0.2 + 0.5) AS INTEGER) AS bin FROM link
    JOIN coords a ON a.m = link.m AND a.atom = src JOIN coords c ON c.m = link.m AND c.atom = dst JOIN mol ON mol.m = link.m),
  n AS (SELECT m, bin, count(*) AS n FROM s GROUP BY m, bin)
  SELECT label_id, loaded_at, frag, arg_min(bin, {'n': -n, 'b': bin}) AS bin FROM n JOIN mol USING (m) GROUP BY ALL""")
def dominant_length(spark: SparkSession, d: str) -> DataFrame:
    """The commonest length of a molecule's bonds, in bins of 0.2; the shorter among equals."""
    end = lambda b, e, f: F.get("atoms", b[e])[f]
    square = lambda b, f: (end(b, "src", f) - end(b, "dst", f)) * (end(b, "src", f) - end(b, "dst", f))
    bins = F.transform("bonds", lambda b: F.floor(F.sqrt(square(b, "x") + square(b, "y")) / 0.2 + 0.5).cast("int"))
    rows = _sound(spark, d).filter(F.size("bonds") > 0).select(*KEYS, bins.alias("bins"))
    times = F.transform(F.array_distinct("bins"), lambda v: F.struct((-F.size(F.filter("bins", lambda o: o == v))).alias("n"), v.alias("bin")))
    return rows.select(*KEYS, F.array_min(times)["bin"].alias("bin"))


@query()
def ring_contract_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every molecule encoded without rings and decoded again; ``same`` says that both graphs are equal, null where ``error`` says why there is none."""
    coded = rings.contract(_sound(spark, d), KEYS)
    back = rings.expand(coded.select(*KEYS, "seq", "n_super", "before", F.col("error").alias("why")), [*KEYS, "seq", "n_super", "before", "why"])
    back = isomorphism.with_codes(back, {"after": ("atoms", "bonds")})
    same = F.when(F.coalesce("why", "error").isNull(), F.col("after") == F.col("before"))
    return back.select(*KEYS, F.size("seq").alias("n_tokens"), "n_super", same.alias("same"), F.coalesce("why", "error").alias("error"))


@query()
def ring_free_tokens(spark: SparkSession, d: str) -> DataFrame:
    coded = rings.contract(_sound(spark, d), KEYS).filter("error IS NULL")
    long = coded.select(*KEYS, F.posexplode("seq").alias("pos", "s"))
    return long.select(*KEYS, "pos", "s.token", "s.ring_branch", "s.cond")


@query()
def canonical_markup(spark: SparkSession, d: str) -> DataFrame:
    return rings.written(_sound(spark, d), KEYS)


def _by_name(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels_tsv").filter("file_path IS NOT NULL")
    return spread(rows.select(fn.base_name(F.col("file_path")).alias("base_name"), "input_chemfig", "loaded_at", "label_id"))


def same_graphs(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``equal``: whether molecules a and b (markup_x, atoms_x, bonds_x) are one graph; false where either is missing or unparsed.

    Equal markup is equal; only pairs written differently are compared atom by atom.
    """
    sound = F.col("atoms_a").isNotNull() & F.col("atoms_b").isNotNull()
    written = sound & (F.col("markup_a") == F.col("markup_b"))
    open_ = sound & ~written
    only = {f"_{c}_{x}": F.when(open_, F.col(f"{c}_{x}")) for c in ("atoms", "bonds") for x in "ab"}
    kept = pairs.withColumn("_written", written).withColumns(only).drop("atoms_a", "bonds_a", "atoms_b", "bonds_b")
    coded = isomorphism.with_codes(kept, {"_code_a": ("_atoms_a", "_bonds_a"), "_code_b": ("_atoms_b", "_bonds_b")})
    equal = F.coalesce(F.col("_written") | (F.col("_code_a") == F.col("_code_b")), F.col("_written"), F.lit(False))
    return coded.withColumn("equal", equal).drop("_written", "_code_a", "_code_b", *only)


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each file name's first label, which serves as the label, and its last, which serves as the hypothesis."""
    labels = _by_name(spark, d)
    return dedupe.first_wins(labels, ["base_name"], ["loaded_at", "label_id"]), dedupe.last_wins(labels, ["base_name"], ["loaded_at", "label_id"])


def _structures(spark: SparkSession, d: str) -> DataFrame:
    """base_name, n_label, n_correct, n_extra of the names with molecules."""

    def side(labels: DataFrame, x: str) -> DataFrame:
        made = molecules.fragments(labels, ["base_name"], "input_chemfig").filter(F.col("error").isNotNull() | molecules.flat_text().isNull())
        return made.select(
            "base_name", "frag", fn.squeeze(F.col("markup")).alias(f"markup_{x}"),
            F.col("atoms").alias(f"atoms_{x}"), F.col("bonds").alias(f"bonds_{x}"), F.lit(True).alias(f"has_{x}"),
        )

    first, last = _sides(spark, d)
    both = same_graphs(side(first, "a").join(side(last, "b"), ["base_name", "frag"], "full_outer"))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    return both.groupBy("base_name").agg(
        n(F.col("has_a")).alias("n_label"), n(F.col("equal")).alias("n_correct"), n(F.col("has_b") & F.col("has_a").isNull()).alias("n_extra")
    )


@query()
def struct_eval(spark: SparkSession, d: str) -> DataFrame:
    """The molecules of each file name's last label against those of its first: n_label, n_correct, n_extra, and whether all agree.

    Molecules pair by their place in the text and are compared exactly; straight chains count as text, not as molecules.
    """
    return _structures(spark, d).withColumn("same", (F.col("n_correct") == F.col("n_label")) & (F.col("n_extra") == 0))


@query()
def metric_table(spark: SparkSession, d: str) -> DataFrame:
    """The seven metrics of each file name's last label (the hypothesis) against its first (the label).

    ``base`` counts edits of tokens; ``struct`` names whose molecules all agree,
    ``struct.single`` molecules, ``struct.line`` names whose text around them agrees
    too; the ``ref`` ones do so for the names that occur in ``cs_log``.  Labels
    without molecules agree in structure.
    """

    def side(labels: DataFrame, x: str) -> DataFrame:
        around = molecules.fragments(labels, ["base_name"], "input_chemfig").groupBy("base_name").agg(
            F.max("rest").alias("rest"), F.array_sort(F.collect_list(F.struct("frag", molecules.flat_text().alias("flat")))).alias("flats")
        )
        text = fn.squeeze(F.col("input_chemfig"))
        whole = labels.join(around, "base_name", "left").select("base_name", text.alias(f"text_{x}"), fn.markup_tokens(F.col("input_chemfig")).alias(f"tokens_{x}"),
            F.to_json(F.struct(F.coalesce(fn.squeeze(F.col("rest")), text), "flats")).alias(f"around_{x}"))
        return whole

    first, last = _sides(spark, d)
    known = first.filter("input_chemfig IS NOT NULL")
    ref = table(spark, d, "cs_log").filter("file_path IS NOT NULL").select(fn.base_name(F.col("file_path")).alias("base_name"), F.lit(1).alias("ref")).distinct()
    rows = side(known, "a").join(side(last, "b"), "base_name").join(_structures(spark, d), "base_name", "left").join(ref, "base_name", "left")
    # Equal texts have no edits: their tokens aren't sent to Python.
    differ = ~F.col("text_a").eqNullSafe(F.col("text_b"))
    rows = rows.withColumn("n_tokens", F.size("tokens_a")).withColumns({c: F.when(differ, F.col(c)) for c in ("tokens_a", "tokens_b")})
    scored = evaluate.edit_counts(rows.na.fill(0, ["n_label", "n_correct", "n_extra"]), "tokens_a", "tokens_b")
    same = (F.col("n_correct") == F.col("n_label")) & (F.col("n_extra") == 0)
    line = same & F.coalesce(F.col("around_a") == F.col("around_b"), F.lit(False))
    exact = (F.col("n_del") + F.col("n_sub") + F.col("n_ins")) == 0
    one, ref = F.lit(1), F.col("ref")
    single = lambda on: {"sent_n": F.when(on == 1, F.col("n_label")), "sent_correct": F.col("n_correct"), "n": one}
    return evaluate.metric_table(scored, {
        "base": {"sent_n": one, "sent_correct": exact, "d": F.col("n_del"), "s": F.col("n_sub"), "i": F.col("n_ins"), "n": F.col("n_tokens")},
        "struct": {"sent_n": one, "sent_correct": same, "n": one}, "struct.single": single(one), "struct.line": {"sent_n": one, "sent_correct": line, "n": one},
        "struct.ref": {"sent_n": ref, "sent_correct": same, "n": one}, "struct.ref.single": single(ref), "struct.ref.line": {"sent_n": ref, "sent_correct": line, "n": one},
    })


@query()
def atom_seed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """For the first and the last label of a file name, the four pairs of atoms that lie nearest, for each two molecules at one place in the text."""
    labels = _by_name(spark, d)
    side = lambda pick, x: molecules.fragments(pick(labels, ["base_name"], ["loaded_at", "label_id"]), ["base_name"], "input_chemfig").filter(
        "error IS NULL"
    ).select("base_name", "frag", F.col("atoms").alias(x))
    both = side(dedupe.first_wins, "a").join(side(dedupe.last_wins, "b"), ["base_name", "frag"])
    return both.select("base_name", "frag", F.posexplode(molecules.seed_pairs("a", "b")).alias("rank", "p")).select("base_name", "frag", "rank", "p.distance", "p.a", "p.b")
