"""Filling containers of fixed capacity with items of varying length.

The demand is the histogram of lengths, whose size is bounded by the capacity
and not by the data.  A configuration linear program (which patterns of lengths
are laid into how many containers) is solved by multiplicative weights: a length
is priced by itself times a weight that falls exponentially with the share of
its demand that is covered, a knapsack dynamic program finds the pattern of the
best price (first among those that fill a container best, then among all, if
that stays above the lower bound), and it is laid for a fixed fraction of what its scarcest length still needs, rounded down to whole
containers.  All lengths so run out together, and patterns stay full until
little is left; what the groups of the histogram leave goes through the program once
more together, and first-fit-decreasing lays the rest.  The lengths themselves are
prices under which no pattern is worth more than a container, so that total size
by capacity is a lower bound (the dual), and the gap to it is known.

The histogram is dealt into groups, each of them a program of its own and a Spark
task.  Spark then numbers the items of each length, in parts whose number follows
the counts, and looks the numbers up among the slots of that length.

Defined results: an item of size 0 or null takes no container (null container_no);
an item larger than the capacity is cut into pieces of the capacity and a rest;
repeated ids are repeated items; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.operators.numbering import number_rows
from retort.session import checkpoint, map_batches, ship

#: Lengths that a knapsack chooses from: those of the highest weight.
CHOICE = 96
#: Share of its scarcest length's open demand that a pattern is laid for (and the share tried last), and how fast weights fall.
STEP, FINE, RATE = 0.25, 0.03, 4.0
#: Where the price alone decides, weights grow with this power of the length: large lengths have fewer partners.
TILT = 0.1
#: Patterns are laid until less than REST of the demand is open and they leave more than 1 / FULL of a container unused.
REST, FULL = 0.05, 256
#: Containers of a group, about, and the most groups of a program.
PER_GROUP, GROUPS = 1024, 32
#: Items of one length that are numbered in one part, about.
PER_PART = 100_000


def best_pattern(size: np.ndarray, weight: np.ndarray, most: np.ndarray, room: int, slack: int = 0) -> tuple[np.ndarray, int]:
    """Bounded knapsack: of the patterns that fill ``room`` best, up to ``slack``, the one of the highest price (size times weight), and what it fills.

    Multiplicities are split into powers of two, so that each part is taken or left.
    """
    part_item, part_n = [], []
    for i in range(len(size)):
        left, n = int(min(most[i], room // size[i])), 1
        while left > 0:
            n = min(n, left)
            part_item.append(i)
            part_n.append(n)
            left -= n
            n *= 2
    value = np.full(room + 1, -np.inf)
    value[0] = 0.0
    took = np.zeros((len(part_item), room + 1), bool)
    for k, (i, n) in enumerate(zip(part_item, part_n)):
        s = int(size[i]) * n
        if s <= room:
            new = value[: room + 1 - s] + s * weight[i]
            np.greater(new, value[s:], out=took[k, s:])
            np.copyto(value[s:], new, where=took[k, s:])
    most_filled = int(np.flatnonzero(value > -np.inf)[-1])
    least = max(0, most_filled - slack)
    filled = at = most_filled - int(value[least : most_filled + 1][::-1].argmax())
    pattern = np.zeros(len(size), np.int64)
    for k in range(len(part_item) - 1, -1, -1):
        if took[k, at]:
            pattern[part_item[k]] += part_n[k]
            at -= int(size[part_item[k]]) * part_n[k]
    return pattern, filled


def configurations(size: np.ndarray, demand: np.ndarray, room: int) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """Patterns with the number of containers that follow each, and the demand that they leave open.

    Patterns that fill best are laid first; where that doesn't reach the lower
    bound (few lengths, that don't add up), the price alone decides how much
    room may be left, and the better solution stays; all is left open where
    first-fit-decreasing needs fewer containers still.
    """
    size, demand = np.asarray(size, np.int64), np.asarray(demand, np.int64)
    bound = -(-int((size * demand).sum()) // room)
    best, least = ([], demand), None
    for slack, step, tilt in ((0, STEP, 0.0), (room, FINE, TILT)):
        laid, left = _weighted(size, demand, room, slack, step, tilt)
        n = sum(times for _, times in laid) + (sum(times for _, times in first_fit(size, left, room)) if left.any() else 0)
        if least is None or n < least:
            best, least = (laid, left), n
        if n <= bound + bound // 1000:
            return best
    # A few lengths that don't add up: first-fit-decreasing alone may be better by some containers in a thousand.
    return ([], demand) if sum(times for _, times in first_fit(size, demand, room)) < least else best


def _weighted(size: np.ndarray, demand: np.ndarray, room: int, slack: int, step: float, tilt: float) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """One run of multiplicative weights."""
    left, out = demand.copy(), []
    total = int((size * demand).sum())
    # Equal weights are told apart by a fixed mixture, not by size: a choice of large lengths only would fill badly.
    mixed = (np.arange(len(size), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
    while left.any():
        live = np.flatnonzero(left)
        share = left[live] / demand[live]
        weight = np.exp(RATE * (share - share.max())) * (size[live] / room) ** tilt
        order = np.lexsort((mixed[live], -weight))[:CHOICE]
        pattern, filled = best_pattern(size[live[order]], weight[order], left[live[order]], room, slack)
        if filled * FULL < room * (FULL - 1) and len(order) < len(live):
            order = np.arange(len(live))
            pattern, filled = best_pattern(size[live], weight, left[live], room, slack)
        if filled * FULL < room * (FULL - 1) and (left * size).sum() < REST * total:
            break
        used, per = live[order[pattern > 0]], pattern[pattern > 0]
        times = max(1, int(step * (left[used] // per).min()))
        whole = np.zeros(len(size), np.int64)
        whole[used] = per
        left[used] -= per * times
        out.append((whole, times))
    return out, left


def first_fit(size: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns for ``demand``, longest first; alike containers are counted together."""
    left, out = demand.copy(), []
    order = np.argsort(-size, kind="stable")
    while left.any():
        order = order[left[order] > 0]
        pattern, free = np.zeros(len(size), np.int64), room
        for i in order:
            n = min(int(left[i]), int(free // size[i]))
            pattern[i] = n
            free -= n * size[i]
            if free < size[order[-1]]:
                break
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        left = left - pattern * times
        out.append((pattern, times))
    return out


def cut_items(sizes: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(id, piece_no, n_pieces, size): items beyond the capacity in pieces of the capacity and a rest."""
    size = F.coalesce(F.col(size_col).cast("bigint"), F.lit(0))
    n = F.greatest(F.lit(1), F.ceil(size / F.lit(float(capacity))).cast("int"))
    cut = sizes.select(F.col(id_col).alias("id"), size.alias("whole"), n.alias("n_pieces"))
    cut = cut.withColumn("piece_no", F.explode(F.expr("sequence(0, n_pieces - 1)")))
    rest = F.col("whole") - F.col("piece_no").cast("bigint") * capacity
    return cut.select("id", "piece_no", "n_pieces", F.least(rest, F.lit(capacity)).alias("size"))


_LAID = "kind int, way string, pattern bigint, size bigint, per bigint, times bigint"


def _solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The patterns of one group of lengths, and what they leave open as way ``rest``."""
    kind, group = int(key[0]), int(key[1])
    size, demand, room = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), int(rows["room"].iloc[0])
    laid, left = configurations(size, demand, room)
    out = [(kind, "program", group * 2**40 + j, int(size[i]), int(p[i]), t) for j, (p, t) in enumerate(laid) for i in np.flatnonzero(p)]
    out += [(kind, "rest", -1, int(size[i]), int(left[i]), 0) for i in np.flatnonzero(left)]
    return pd.DataFrame(out, columns=["kind", "way", "pattern", "size", "per", "times"])


def plan_containers(histograms: DataFrame, rooms: list[int]) -> pd.DataFrame:
    """(kind, way, size, first, past, per, base, times): the slots of each length, in the order of its items' numbers.

    ``histograms`` (kind, size, n) has a row a length at most, so that its size,
    the number of patterns and this plan are bounded by the capacities.  ``way``
    is ``full`` for items that fill a container alone, ``program`` or ``first fit``.
    """
    spark = histograms.sparkSession
    ship(spark)
    room = F.get(F.array(*[F.lit(int(r)) for r in rooms]), F.col("kind"))
    counted = histograms.filter("size > 0").select("kind", "size", "n", room.alias("room"))
    per_kind = {r["kind"]: r["groups"] for r in counted.filter("size < room").groupBy("kind", "room").agg(
        F.least(F.lit(GROUPS), F.greatest(F.lit(1), F.floor(F.sum(F.col("size") * F.col("n")) / F.col("room") / PER_GROUP))).cast("int").alias("groups")
    ).collect()}
    n_groups = F.coalesce(F.element_at(F.create_map(*[F.lit(int(x)) for k, g in per_kind.items() for x in (k, g)]), F.col("kind")), F.lit(1)) if per_kind else F.lit(1)
    dealt = counted.filter("size < room").withColumn("group", F.pmod(F.xxhash64("size"), n_groups).cast("int"))
    parts = max(1, sum(per_kind.values()))
    laid = dealt.repartition(parts, "kind", "group").groupBy("kind", "group").applyInPandas(_solve, _LAID).toPandas()
    open_ = laid[laid["way"] == "rest"]
    if len(open_) and max(per_kind.values()) > 1:
        again = spark.createDataFrame(open_[["kind", "size", "per"]]).groupBy("kind", "size").agg(F.sum("per").alias("n"))
        again = again.select("kind", "size", "n", room.alias("room"), F.lit(GROUPS).alias("group"))
        again = again.repartition(len(per_kind), "kind").groupBy("kind", "group").applyInPandas(_solve, _LAID).toPandas()
        laid = pd.concat([laid[laid["way"] == "program"], again], ignore_index=True)
    full = counted.filter("size = room").toPandas()
    slots, base, taken = [], [0] * len(rooms), {}

    def put(kind: int, way: str, pattern: list[tuple[int, int]], times: int) -> None:
        for size, per in pattern:
            first = taken.get((kind, size), 0)
            taken[kind, size] = first + per * times
            slots.append((kind, way, size, first, first + per * times, per, base[kind], times))
        base[kind] += times

    for kind, size, n, _ in full.itertuples(index=False):
        put(int(kind), "full", [(int(size), 1)], int(n))
    made = laid[laid["way"] == "program"].sort_values(["kind", "pattern", "size"])
    for (kind, _), g in made.groupby(["kind", "pattern"], sort=True):
        put(int(kind), "program", [(int(s), int(p)) for s, p in zip(g["size"], g["per"])], int(g["times"].iloc[0]))
    rest = laid[laid["way"] == "rest"]
    for kind, g in rest.groupby("kind", sort=True):
        size, demand = g["size"].to_numpy(np.int64), g["per"].to_numpy(np.int64)
        for pattern, times in first_fit(size, demand, rooms[int(kind)]):
            put(int(kind), "first fit", [(int(size[i]), int(pattern[i])) for i in np.flatnonzero(pattern)], times)
    return pd.DataFrame(slots, columns=["kind", "way", "size", "first", "past", "per", "base", "times"])


def _place(batches: Iterator[pa.RecordBatch], slots) -> Iterator[pa.RecordBatch]:
    size, first, per, base = slots.value
    key = size << np.int64(40) | first
    for b in batches:
        own, number = b.column("size").to_numpy(), b.column("number").to_numpy()
        at = np.searchsorted(key, own << np.int64(40) | number, "right") - 1
        container = base[at] + (number - first[at]) // per[at] if len(key) else np.zeros(len(own), np.int64)
        placed = pa.array(container, pa.int64(), mask=own == 0)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "piece_no", "n_pieces", "size")), placed], ["id", "piece_no", "n_pieces", "size", "container_no"])


def place_items(items: DataFrame, histogram: DataFrame, slots: pd.DataFrame, id_col: str) -> DataFrame:
    """(id_col, piece_no, n_pieces, size, container_no): every item or piece in its slot."""
    # A row a slot; the plan is bounded by the capacity.
    ordered = slots.sort_values(["size", "first"])
    held = items.sparkSession.sparkContext.broadcast(tuple(ordered[c].to_numpy(np.int64) for c in ("size", "first", "per", "base")))
    parts = histogram.select("size", F.greatest(F.lit(1), F.ceil(F.col("n") / PER_PART)).alias("_parts"))
    spread = items.join(parts, "size")
    part = F.pmod(F.xxhash64("id", "piece_no"), F.col("_parts"))
    numbered = number_rows(spread.withColumn("_of", part), F.col("_of"), ["id", "piece_no"], ["size"]).select("id", "piece_no", "n_pieces", "size", "number")
    id_type = items.schema["id"].dataType.simpleString()
    placed = map_batches(numbered, lambda batches: _place(batches, held), f"id {id_type}, piece_no int, n_pieces int, size bigint, container_no bigint")
    return placed.withColumnRenamed("id", id_col)


def _histogram(items: DataFrame) -> DataFrame:
    return items.groupBy("size").agg(F.count("*").alias("n"))


def pack(sizes: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(id_col, piece_no, n_pieces, size, container_no): every item or piece in a container of ``capacity``."""
    items = cut_items(sizes, id_col, size_col, capacity)
    counted = checkpoint(_histogram(items))
    return place_items(items, counted, plan_containers(counted.withColumn("kind", F.lit(0)), [capacity]), id_col)


def _kinds(containers: DataFrame) -> list:
    """The container kinds, a short list (two rows), read by the driver."""
    return containers.orderBy("container").collect()


def _cut_documents(documents: DataFrame, kinds: list, folder: str | None) -> list[DataFrame]:
    """The items of each kind; texts are encoded once for each tokenizer."""
    from retort.llm import bpe

    sizes = {}
    for kind in kinds:
        if kind["tokenizer"] not in sizes:
            sizes[kind["tokenizer"]] = checkpoint(bpe.token_counts(documents, "doc_id", "text", kind["tokenizer"], folder or bpe.TOKENIZER_DIR))
    return [cut_items(sizes[k["tokenizer"]], "doc_id", "n_tokens", int(k["capacity"])) for k in kinds]


def _planned(items: list[DataFrame], kinds: list) -> tuple[DataFrame, pd.DataFrame]:
    """The histograms of all kinds, and the plan for them."""
    counted = None
    for i, one in enumerate(items):
        own = _histogram(one).withColumn("kind", F.lit(i))
        counted = own if counted is None else counted.unionByName(own)
    counted = checkpoint(counted)
    return counted, plan_containers(counted, [int(k["capacity"]) for k in kinds])


def pack_documents(documents: DataFrame, containers: DataFrame, folder: str | None = None) -> DataFrame:
    """(container, doc_id, piece_no, n_pieces, size, container_no) for every row of ``containers``."""
    kinds = _kinds(containers)
    if not kinds:
        return documents.sparkSession.createDataFrame([], "container string, doc_id bigint, piece_no int, n_pieces int, size bigint, container_no bigint")
    items = _cut_documents(documents, kinds, folder)
    counted, slots = _planned(items, kinds)
    out = None
    for i, kind in enumerate(kinds):
        laid = place_items(items[i], counted.filter(F.col("kind") == i), slots[slots["kind"] == i], "doc_id")
        laid = laid.select(F.lit(kind["container"]).alias("container"), "*")
        out = laid if out is None else out.unionByName(laid)
    return out


def cut_documents(placed: DataFrame) -> DataFrame:
    """(container, doc_id): the documents whose pieces lie in several containers."""
    pieces = placed.filter("n_pieces > 1").groupBy("container", "doc_id")
    spread = pieces.agg(F.min("container_no").alias("least"), F.max("container_no").alias("most"))
    return spread.filter("least < most").select("container", "doc_id")


def packing_report(documents: DataFrame, containers: DataFrame, folder: str | None = None) -> DataFrame:
    """A row a kind: container, capacity, n_items, n_containers, from_full, from_program, from_first_fit (containers laid by each), lower_bound, gap.

    The bound is total size by capacity, the dual value of prices equal to the lengths.
    """
    kinds = _kinds(containers)
    schema = "container string, capacity int, n_items bigint, n_containers bigint, from_full bigint, from_program bigint, from_first_fit bigint, lower_bound double, gap double"
    spark = documents.sparkSession
    if not kinds:
        return spark.createDataFrame([], schema)
    counted, slots = _planned(_cut_documents(documents, kinds, folder), kinds)
    totals = {r["kind"]: r for r in counted.filter("size > 0").groupBy("kind").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("tokens")).collect()}
    rows = []
    for i, kind in enumerate(kinds):
        each = slots[slots["kind"] == i].drop_duplicates("base")
        n = {w: int(each.loc[each["way"] == w, "times"].sum()) for w in ("full", "program", "first fit")}
        bound = totals[i]["tokens"] / kind["capacity"] if i in totals else 0.0
        rows.append((kind["container"], kind["capacity"], totals[i]["n"] if i in totals else 0, sum(n.values()), *n.values(), bound, sum(n.values()) / bound - 1 if bound else 0.0))
    return spark.createDataFrame(rows, schema)
