"""Operators of sequence search over tables of log-probabilities and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.functions.text import let


def log_softmax(values: Column) -> Column:
    """Log-probabilities of an array of scores; stable for large scores."""
    less = let(values, lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: x - top)))
    return let(less, lambda v: let(F.log(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x))), lambda total: F.transform(v, lambda x: x - total)))


def beam_topk(df: DataFrame, sample: str, beam: str, log_probs: str, k: int, cost: str | None = None) -> DataFrame:
    """(sample, rank, beam, token, score): the k best extensions of each sample over all its beams.

    Each beam first keeps its own k best, so that k tokens a beam are shuffled.
    Ties go to the lower beam, then the lower token.
    """
    base = F.col(cost) if cost else F.lit(0.0)
    scored = F.transform(log_probs, lambda v, i: F.struct((-(v + base)).alias("neg"), F.col(beam).cast("bigint").alias("beam"), i.cast("bigint").alias("token")))
    own = df.select(F.col(sample).alias("sample"), F.slice(F.array_sort(scored), 1, k).alias("own"))
    best = own.groupBy("sample").agg(F.slice(F.array_sort(F.flatten(F.collect_list("own"))), 1, k).alias("best"))
    out = best.select("sample", F.posexplode("best").alias("rank", "b"))
    return out.select("sample", "rank", "b.beam", "b.token", (-F.col("b.neg")).alias("score"))


def rank_finished(df: DataFrame, sample: str, costs: str, mask: str) -> Column:
    """Length-normalised cost of a beam: minus the masked mean of its step scores."""
    both = F.zip_with(costs, mask, lambda c, m: c * m)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    n = total(F.col(mask))
    return F.when(n > 0, -total(both) / n)


def masked_mean(values: Column, mask: Column) -> Column:
    """Mean of the array's values where the mask is 1; null where it is 1 nowhere."""
    pairs = F.zip_with(values, mask, lambda v, m: v * m)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    n = total(mask)
    return F.when(n > 0, total(pairs) / n)


def attention_read(energy: Column, values: Column) -> Column:
    """Sum of the values, weighted by the softmax of the energies."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    weights = let(energy, lambda e: let(F.array_max(e), lambda top: F.transform(e, lambda x: F.exp(x - top))))
    return let(weights, lambda w: total(F.zip_with(w, values, lambda a, b: a * b)) / total(w))


def shift_right(items: Column, first: Column) -> Column:
    """The array moved by one place: ``first`` in front, the last entry dropped."""
    return F.when(F.size(items) > 0, F.concat(F.array(first), F.slice(items, 1, F.size(items) - 1))).otherwise(items)


def next_item(items: Column, last: Column) -> Column:
    """Each place's next entry; ``last`` at the end."""
    return F.when(F.size(items) > 0, F.concat(F.slice(items, 2, F.size(items) - 1), F.array(last))).otherwise(items)


def differences(items: Column) -> Column:
    """Each entry less the one before; the first entry as it is."""
    return F.transform(items, lambda v, i: v - F.when(i > 0, F.get(items, i - 1)).otherwise(F.lit(0)))


def kth_best(scores: Column, k: int) -> Column:
    """Index, from 0, of the k-th greatest score (k from 1); the lower index among equals; null where there are fewer."""
    order = F.array_sort(F.transform(scores, lambda v, i: F.struct((-v).alias("neg"), i.alias("i"))))
    return F.get(order, F.lit(k - 1))["i"]


def run_ranks(items: Column, token: str) -> Column:
    """At each place of ``token`` its rank, from 1, in the run of equal tokens there; 0 elsewhere."""

    def ranked(a: Column) -> Column:
        others = F.filter(F.transform(a, lambda t, i: F.when(t == token, F.lit(None)).otherwise(i)), lambda i: i.isNotNull())
        # From each other token to the next: a 0 for itself, and 1, 2, … for the run behind it.
        return let(F.concat(F.array(F.lit(-1)), others, F.array(F.size(a))), lambda p: F.flatten(F.transform(
            F.slice(p, 1, F.size(p) - 1), lambda at, j: F.concat(
                F.when(at >= 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")),
                F.when(F.get(p, j + 1) - at > 1, F.sequence(F.lit(1), F.get(p, j + 1) - at - 1)).otherwise(F.array().cast("array<int>")),
            ))))

    return F.when(items.isNotNull(), let(items, ranked))


def offsets(flags: Column) -> Column:
    """At each true flag the number of true flags up to it; 0 elsewhere."""

    def counted(a: Column) -> Column:
        places = F.filter(F.transform(a, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
        before = lambda p, j: F.when(j > 0, F.get(p, j - 1)).otherwise(-1)
        up_to = lambda p: F.flatten(F.transform(p, lambda at, j: F.concat(F.array_repeat(F.lit(0), at - before(p, j) - 1), F.array(j + 1))))
        rest = lambda p: F.array_repeat(F.lit(0), F.size(a) - F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(-1)) - 1)
        return let(places, lambda p: F.concat(up_to(p), rest(p)))

    return F.when(flags.isNotNull(), let(flags, counted))


def used_before(items: Column) -> Column:
    """At each place the distinct entries other than -1 before it, sorted."""
    return let(items, lambda a: F.transform(a, lambda _, i: F.array_sort(F.array_distinct(F.filter(F.slice(a, 1, i), lambda v: v >= 0)))))


def molecule_end(items: Column) -> Column:
    """Place of the bracket that closes the last molecule, from 0; null where none starts or it is still open."""
    numbered = F.transform(items, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("int").alias("end"), F.lit(False).alias("on"))

    def step(s: Column, m: Column) -> Column:
        begins = m["t"] == "\\chemfig"
        depth = F.when(begins, 0).otherwise(s["depth"] + F.when(m["t"] == "{", 1).when(m["t"] == "}", -1).otherwise(0))
        closes = s["on"] & ~begins & (m["t"] == "}") & (depth == 0)
        end = F.when(begins, None).when(closes, m["i"]).otherwise(s["end"])
        return F.struct(depth.alias("depth"), end.cast("int").alias("end"), ((s["on"] | begins) & ~closes).alias("on"))

    return F.aggregate(numbered, start, step)["end"]


def candidates(items: Column, used: Column, wanted) -> Column:
    """Places of the wanted tokens that ``used`` doesn't name, in order."""
    places = F.transform(F.filter(F.transform(items, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda m: wanted(m["t"])), lambda m: m["i"])
    return F.array_except(places, F.coalesce(used, F.array().cast("array<int>")))


def some_of(items: Column, most: int, *seed: Column) -> Column:
    """Up to ``most`` of the items, chosen by a hash of seed and item, so that every run chooses alike; sorted."""
    drawn = F.slice(F.array_sort(F.transform(items, lambda v: F.struct(F.xxhash64(*seed, v).alias("h"), v.alias("v")))), 1, most)
    return F.array_sort(F.transform(drawn, lambda d: d["v"]))


def fan_out(df: DataFrame, n: Column, name: str) -> DataFrame:
    """Each row once for each candidate, at least once, numbered from 0 in column ``name``."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)))


def decode_beams(df: DataFrame, sample: str, step: str, log_probs: str, k: int) -> DataFrame:
    """(sample, rank, tokens, score): the k best token sequences of each sample over its steps, by beams of width k.

    Each step first keeps its own k best tokens; a sample's steps (its length, not
    its beams times tokens) are gathered.  Ties go to the lower tokens.
    """
    scored = F.transform(log_probs, lambda v, i: F.struct((-v).alias("neg"), i.alias("token")))
    own = df.select(F.col(sample).alias("sample"), F.struct(F.col(step).alias("step"), F.slice(F.array_sort(scored), 1, k).alias("best")).alias("s"))
    steps = own.groupBy("sample").agg(F.array_sort(F.collect_list("s")).alias("steps"))
    start = F.expr("array(named_struct('neg', 0D, 'tokens', cast(array() as array<int>)))")
    longer = lambda beams, s: F.slice(
        F.array_sort(
            F.flatten(F.transform(beams, lambda b: F.transform(s["best"], lambda t: F.struct((b["neg"] + t["neg"]).alias("neg"), F.concat(b["tokens"], F.array(t["token"])).alias("tokens")))))
        ), 1, k,
    )
    best = steps.select("sample", F.posexplode(F.aggregate("steps", start, longer)).alias("rank", "b"))
    return best.select("sample", "rank", "b.tokens", (-F.col("b.neg")).alias("score"))


def beam_loop(df: DataFrame, sample: str, step: str, beam: str, log_probs: str, k: int, eos: int) -> DataFrame:
    """(sample, rank, tokens, cost): beams of width k over steps whose scores depend on the beam that is extended.

    ``df`` has a row for each sample, step (from 0) and beam (from 0, the place of
    a beam among those of the step before; the first step uses beam 0), with the
    scores of all tokens.  A beam that took ``eos`` is finished and stays as it is; one
    without scores at a step is lost.  Ties go to the lower tokens.  ``cost`` is minus the
    mean score of a beam's steps, by which the beams are ranked in the end.  Each
    row first keeps its own k best tokens, so that k by k tokens a step are gathered.
    """
    scored = F.transform(log_probs, lambda v, i: F.struct((-v).cast("double").alias("neg"), i.cast("int").alias("token")))
    own = df.select(F.col(sample).alias("sample"), F.col(step).alias("step"), F.struct(F.col(beam).alias("beam"), F.slice(F.array_sort(scored), 1, k).alias("best")).alias("own"))
    by_step = own.groupBy("sample", "step").agg(F.collect_list("own").alias("own"))
    steps = by_step.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("step", "own"))).alias("steps"))
    state = lambda neg, tokens, n, done: F.struct(neg.alias("neg"), tokens.alias("tokens"), n.alias("n"), done.alias("done"))
    start = F.array(state(F.lit(0.0).cast("double"), F.array().cast("array<int>"), F.lit(0), F.lit(False)))

    def grow(b: Column, j: Column, s: Column) -> Column:
        best = F.get(F.filter(s["own"], lambda o: o["beam"] == j), F.lit(0))["best"]
        longer = F.transform(best, lambda t: state(b["neg"] + t["neg"], F.concat(b["tokens"], F.array(t["token"])), b["n"] + 1, t["token"] == eos))
        return F.when(b["done"], F.array(b)).otherwise(F.coalesce(longer, F.slice(F.array(b), 1, 0)))

    def one(beams: Column, s: Column) -> Column:
        return F.slice(F.array_sort(F.flatten(F.transform(beams, lambda b, j: grow(b, j, s)))), 1, k)

    ended = F.transform(F.aggregate("steps", start, one), lambda b: F.struct((b["neg"] / b["n"]).alias("cost"), b["tokens"].alias("tokens")))
    ranked = steps.select("sample", F.posexplode(F.array_sort(ended)).alias("rank", "b"))
    return ranked.select("sample", "rank", "b.tokens", "b.cost")


def scatter_add(df: DataFrame, slot: str, values: str) -> DataFrame:
    """(slot, pos, total): the arrays of each slot added up place by place; partial sums before the shuffle."""
    long = df.select(F.col(slot).alias("slot"), F.posexplode(values).alias("pos", "v"))
    return long.groupBy("slot", "pos").agg(F.sum("v").alias("total"))


def model_average(df: DataFrame, part: str, values: str) -> DataFrame:
    """(pos, mean): the mean over the parts (workers) of each parameter's mean within the part; rows without a part or values don't count."""
    long = df.filter(F.col(part).isNotNull()).select(F.col(part).alias("part"), F.posexplode(values).alias("pos", "v"))
    return long.groupBy("part", "pos").agg(F.avg("v").alias("v")).groupBy("pos").agg(F.avg("v").alias("mean"))


def momentum_update(old: Column, mean: Column, delta: Column, rate: float, momentum: float) -> Column:
    """The parameter after a step towards the mean with momentum: old + momentum * delta + rate * (mean - old)."""
    return old + F.lit(momentum) * delta + F.lit(rate) * (mean - old)


def ratio_or_nan(total: Column, n: Column) -> Column:
    """total / n; NaN where nothing was counted."""
    return F.when(n > 0, total / n).otherwise(F.lit(float("nan")))
