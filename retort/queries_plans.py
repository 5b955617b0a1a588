"""Registered queries of dataset planning and sequence search, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.operators import search
from retort.operators.numbering import number_rows
from retort.plans import buckets, partition
from retort.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}
SIZES = ["d1", "d2", "d3"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def note(f: Query) -> Query:
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Pages as items: their width, height and number of characters."""
    docs = table(spark, d, "documents").filter("page_w IS NOT NULL AND page_h IS NOT NULL")
    return docs.select("doc_id", F.col("page_w").cast("bigint").alias("d1"), F.col("page_h").cast("bigint").alias("d2"), F.coalesce("n_chars", F.lit(0)).alias("d3"))


def _grid(items: DataFrame) -> buckets.Grid:
    return buckets.Grid(buckets.size_limits(items, SIZES, (3800, 3800, 16384)))


def _kept(items: DataFrame, grid: buckets.Grid) -> DataFrame:
    counts = buckets.cell_counts(items, grid, SIZES)
    return buckets.batch_sizes(buckets.kept_buckets(counts, F.col("total") * F.lit(0.001)), 6_000_000, 8)


def _plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    items = _items(spark, d)
    grid = _grid(items)
    kept = _kept(items, grid)
    return items, kept, buckets.first_fit(items, kept, grid, SIZES)


_GRID = """WITH RECURSIVE items AS (SELECT doc_id, CAST(page_w AS BIGINT) AS d1, CAST(page_h AS BIGINT) AS d2, coalesce(n_chars, 0) AS d3 FROM documents WHERE page_w IS NOT NULL AND page_h IS NOT NULL),
lim AS (SELECT least(3800, max(d1)) AS m1, least(3800, max(d2)) AS m2, least(16384, max(d3)) AS m3 FROM items),
e1 AS (SELECT row_number() OVER (ORDER BY d1) - 1 AS i, d1 FROM (SELECT unnest(range(64, m1, 64)) AS d1 FROM lim UNION SELECT m1 FROM lim)),
e2 AS (SELECT row_number() OVER (ORDER BY d2) - 1 AS i, d2 FROM (SELECT unnest(range(128, m2, 128)) AS d2 FROM lim UNION SELECT m2 FROM lim)),
e3 AS (SELECT row_number() OVER (ORDER BY d3) - 1 AS i, d3 FROM (SELECT unnest(range(1024, m3, 1024)) AS d3 FROM lim UNION SELECT m3 FROM lim)),
cells AS (SELECT (e1.i * (SELECT count(*) FROM e2) + e2.i) * (SELECT count(*) FROM e3) + e3.i AS cell, d1, d2, d3 FROM e1, e2, e3),
places AS (SELECT doc_id, (SELECT min(i) FROM e1 WHERE e1.d1 >= items.d1) AS a, (SELECT min(i) FROM e2 WHERE e2.d2 >= items.d2) AS b, (SELECT min(i) FROM e3 WHERE e3.d3 >= items.d3) AS c FROM items),
cnt AS (SELECT (a * (SELECT count(*) FROM e2) + b) * (SELECT count(*) FROM e3) + c AS cell, count(*) AS n FROM places GROUP BY 1),
counts AS (SELECT cells.*, coalesce(cnt.n, 0) AS n FROM cells LEFT JOIN cnt ON cells.cell = cnt.cell),
fold(cell, m, held) AS (SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(-1 AS BIGINT) UNION ALL
  SELECT c.cell, CASE WHEN f.m + c.n >= 0.001 * (SELECT count(*) FROM items) THEN 0 ELSE f.m + c.n END,
    CASE WHEN f.m + c.n >= 0.001 * (SELECT count(*) FROM items) THEN f.m + c.n ELSE -1 END FROM fold f JOIN counts c ON c.cell = f.cell + 1),
kept AS (SELECT row_number() OVER (ORDER BY f.cell) - 1 AS bucket, f.cell, c.d1, c.d2, c.d3, f.held FROM fold f JOIN counts c ON f.cell = c.cell WHERE f.held >= 0),
sized AS (SELECT *, least(6000000 // (d1 * d2), 8) AS batch FROM kept WHERE 6000000 // (d1 * d2) > 0) """
_PLACED = _GRID + """, placed AS (SELECT i.doc_id, i.d1, i.d2, i.d3, (SELECT min(bucket) FROM sized s WHERE i.d1 <= s.d1 AND i.d2 <= s.d2 AND i.d3 <= s.d3) AS bucket FROM items i),
numbered AS (SELECT doc_id, p.d1, p.d2, p.d3, p.bucket, s.batch, row_number() OVER (PARTITION BY p.bucket ORDER BY doc_id % 32, doc_id) - 1 AS r FROM placed p JOIN sized s ON p.bucket = s.bucket),
plan AS (SELECT doc_id, d1, d2, d3, bucket, batch, r // batch AS batch_no, r % batch AS slot, r FROM numbered) """


@query(_GRID + "SELECT cell, d1, d2, d3, n FROM counts")
def bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    return buckets.cell_counts(items, _grid(items), SIZES)


@query(_GRID + "SELECT bucket, cell, d1, d2, d3, held, batch FROM sized")
def bucket_coalesce(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    return _kept(items, _grid(items))


@query(_PLACED + "SELECT doc_id, bucket FROM placed")
def bucket_first_fit(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)[2].select("doc_id", "bucket")


@query(_PLACED + "SELECT doc_id, bucket, batch_no, slot FROM plan")
def batch_plan(spark: SparkSession, d: str) -> DataFrame:
    _, kept, placed = _plan(spark, d)
    return buckets.batches(placed, kept, "doc_id")


@query(_PLACED + """, short AS (SELECT bucket, batch_no, batch, count(*) AS n FROM plan GROUP BY ALL HAVING count(*) < batch),
  slots AS (SELECT bucket, batch_no, n, unnest(range(n, batch)) AS slot FROM short), donors AS (SELECT doc_id, r FROM plan WHERE bucket = (SELECT min(bucket) FROM plan))
  SELECT doc_id, bucket, batch_no, slot, false AS filled FROM plan UNION ALL
  SELECT d.doc_id, s.bucket, s.batch_no, s.slot, true FROM slots s JOIN donors d ON d.r = (s.slot - s.n) % (SELECT count(*) FROM donors)""")
def batch_fill(spark: SparkSession, d: str) -> DataFrame:
    _, kept, placed = _plan(spark, d)
    return buckets.fill_short(buckets.batches(placed, kept, "doc_id"), kept, "doc_id")


@query(_PLACED + """SELECT bucket, count(*) AS n, batch, batch * 4 - count(*) % (batch * 4) AS pad, count(*) + batch * 4 - count(*) % (batch * 4) AS n_padded FROM plan GROUP BY bucket, batch""")
def pad_to_world(spark: SparkSession, d: str) -> DataFrame:
    _, kept, placed = _plan(spark, d)
    return buckets.padding(placed, kept, 4)


@query(_PLACED + """SELECT bucket, batch_no, count(*) AS n_items, CAST(ceil(max(d1) / 32.0) * 32 AS BIGINT) AS d1, CAST(ceil(max(d2) / 32.0) * 32 AS BIGINT) AS d2 FROM plan GROUP BY bucket, batch_no""")
def batch_pad_shape(spark: SparkSession, d: str) -> DataFrame:
    items, kept, placed = _plan(spark, d)
    return buckets.batch_shapes(buckets.batches(placed, kept, "doc_id"), items, "doc_id", ["d1", "d2"])


_NUMBERED = "WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS number, count(*) OVER () AS total FROM orders) "


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey")
    numbered = number_rows(orders, F.expr("o_orderkey div 4096"), ["o_orderkey"], block=F.expr("_part div 4096"))
    total = orders.agg(F.count("*").alias("total"))
    return numbered.join(F.broadcast(total))  # one row


@query(_NUMBERED + "SELECT o_orderkey, number % 7 AS rank FROM n")
def rank_strided(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(spark, d).select("o_orderkey", partition.strided(F.col("number"), 7).alias("rank"))


@query(_NUMBERED + "SELECT o_orderkey, least(number // (total // 7), 6) AS rank FROM n")
def rank_contiguous(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(spark, d).select("o_orderkey", partition.contiguous(F.col("number"), F.col("total"), 7).alias("rank"))


@query(_NUMBERED + "SELECT o_orderkey, least(((number + 1) * 7 - 1) // total, 6) AS part FROM n")
def line_ranges(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(spark, d).select("o_orderkey", partition.line_range(F.col("number"), F.col("total"), 7).alias("part"))


_SOFT = """WITH s AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT vec_id, label, e, list_transform(e, lambda v: v - list_max(e) - ln(list_sum(list_transform(e, lambda w: exp(w - list_max(e)))))) AS lp FROM s) """


def _log_probs(spark: SparkSession, d: str) -> DataFrame:
    scores = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", "label", scores.alias("e"), search.log_softmax(scores).alias("lp"))


@query(_SOFT + "SELECT label, count(*) AS n, round(-avg(lp[label % len(lp) + 1]), 6) AS cross_entropy, round(avg(CASE WHEN list_position(lp, list_max(lp)) = label % len(lp) + 1 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p WHERE label IS NOT NULL GROUP BY label")
def masked_ce_acc(spark: SparkSession, d: str) -> DataFrame:
    target = F.col("label") % F.size("lp")
    hit = F.array_position("lp", F.array_max("lp")) == target + 1
    rows = _log_probs(spark, d).filter("label IS NOT NULL")
    return rows.groupBy("label").agg(
        F.count("*").alias("n"), F.round(-F.avg(F.get("lp", target)), 6).alias("cross_entropy"), F.round(F.avg(hit.cast("double")), 6).alias("accuracy")
    )


@query(_SOFT + "SELECT vec_id, round(list_sum(list_transform(range(1, len(lp) + 1), lambda i: exp(lp[i]) * e[i])), 6) AS read FROM p")
def attention_read(spark: SparkSession, d: str) -> DataFrame:
    return _log_probs(spark, d).select("vec_id", F.round(search.attention_read(F.col("e"), F.col("e")), 6).alias("read"))


@query("WITH s AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings) SELECT vec_id, round(list_avg(list_filter(e, lambda v: v > 0)), 6) AS pooled FROM s")
def masked_pooling(spark: SparkSession, d: str) -> DataFrame:
    mask = F.transform("e", lambda v: (v > 0).cast("double"))
    return _log_probs(spark, d).select("vec_id", F.round(search.masked_mean(F.col("e"), mask), 6).alias("pooled"))


@query("""WITH t AS (SELECT vec_id // 5 AS sample, vec_id % 5 AS beam, unnest(range(len(embedding))) AS token, CAST(unnest(embedding) AS DOUBLE) AS score FROM embeddings),
  r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY score DESC, beam, token) - 1 AS rank FROM t)
  SELECT sample, CAST(rank AS INTEGER) AS rank, beam, token, round(score, 6) AS score FROM r WHERE rank < 5""")
def beam_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = _log_probs(spark, d).select(F.expr("vec_id div 5").alias("sample"), (F.col("vec_id") % 5).alias("beam"), "e")
    return search.beam_topk(rows, "sample", "beam", "e", 5).withColumn("score", F.round("score", 6))


@query("""WITH s AS (SELECT vec_id // 5 AS sample, vec_id AS beam, -list_sum(list_filter(list_transform(embedding, lambda v: CAST(v AS DOUBLE)), lambda v: v < 0)) / len(list_filter(embedding, lambda v: v < 0)) AS cost FROM embeddings)
  SELECT sample, arg_min(beam, {'c': cost, 'b': beam}) AS beam, round(min(cost), 6) AS cost FROM s GROUP BY sample""")
def beam_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = _log_probs(spark, d).withColumn("mask", F.transform("e", lambda v: (v < 0).cast("double")))
    costs = rows.select(F.expr("vec_id div 5").alias("sample"), "vec_id", search.rank_finished(rows, "sample", "e", "mask").alias("cost"))
    best = costs.groupBy("sample").agg(F.min(F.struct("cost", "vec_id")).alias("b"))
    return best.select("sample", F.col("b.vec_id").alias("beam"), F.round("b.cost", 6).alias("cost"))


@query("""WITH s AS (SELECT cs_id, loaded_at, cond_data AS c FROM cs_log WHERE cond_data IS NOT NULL AND len(cond_data) > 0)
  SELECT cs_id, loaded_at, list_concat([-1], c[1 : len(c) - 1]) AS shifted, list_concat(c[2 : len(c)], [0]) AS following,
    list_transform(range(1, len(c) + 1), lambda i: c[i] - CASE WHEN i > 1 THEN c[i - 1] ELSE 0 END) AS step FROM s""")
def step_shift_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "cs_log").filter(F.size("cond_data") > 0)
    c = F.col("cond_data")
    return rows.select("cs_id", "loaded_at", search.shift_right(c, F.lit(-1)).alias("shifted"), search.next_item(c, F.lit(0)).alias("following"), search.differences(c).alias("step"))


@query("""SELECT event_type, date_trunc('day', ts) AS day, round(sum(sum(value)) OVER (PARTITION BY event_type ORDER BY date_trunc('day', ts)), 2) AS covered FROM events GROUP BY event_type, date_trunc('day', ts)""")
def coverage_cumsum(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    days = table(spark, d, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.sum("value").alias("v"))
    running = F.sum("v").over(W.partitionBy("event_type").orderBy("day"))
    return days.select("event_type", F.col("day").cast("timestamp_ntz").alias("day"), F.round(running, 2).alias("covered"))
