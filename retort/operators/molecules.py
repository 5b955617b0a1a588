"""Molecules in markup: fragments, atoms and bonds, and operators on their graphs.

Only the parser of one fragment runs in Python, batch by batch; what follows are
built-in expressions over a molecule's arrays of atoms and bonds, which stay in
the molecule's row, so that no operator here shuffles.

Defined results: null and blank texts have no fragments; a fragment that can't
be parsed has null atoms and bonds and says why in ``error``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.functions.text import let
from retort.session import map_batches

MARK = "\\chemfig"
#: Bond types, longest first.
BONDS = ["<:", ">:", "<|", ">|", "-:", "=_", "=^", "~/", "-", "=", "~", "<", ">"]
#: Bond types by the number that a hook may name them with.
NUMBERED = {"1": "-", "2": "=", "3": "~", "4": ">", "5": "<", "6": ">:", "7": "<:", "8": ">|", "9": "<|"}
CIRCLE = "\\circle"
_BOND = "|".join(map(re.escape, BONDS))
_TOKEN = re.compile(
    rf"(?P<double>\*?)\*(?:\[[^\]]*\])?(?P<edges>\d+)\((?:\[(?P<rbase>[^\]]*)\])?|(?P<q>\?)(?:\[(?P<hook>[^,\]]*)(?:,(?P<kind>[^,\]]*))?(?:,[^\]]*)?\])?"
    rf"|(?P<bond>(?:{_BOND})[@#]?)(?:\[(?P<attr>[^\]]*)\])?|(?P<open>branch\(|\()(?:\[(?P<base>[^\]]*)\])?|(?P<close>branch\)|\))|\\mcfcringle\{{(?P<radius>[^{{}}]*)\}}"
    r"|(?P<command>\\[A-Za-z]+)|(?P<group>\{)|(?P<foul>[\[\]*}])|(?P<text>\\?.)",
    re.DOTALL,
)
ATOM = "struct<id:int,text:string,x:double,y:double>"
BOND = "struct<id:int,type:string,angle:double,src:int,dst:int,hook:string,length:double>"


def place_holder(n: int) -> str:
    """``\\chema``, ``\\chemb``, …, ``\\chemz``, ``\\chemaa``, … for molecules counted from 0."""
    name = ""
    while n >= 0:
        name, n = chr(97 + n % 26) + name, n // 26 - 1
    return "\\chem" + name


def split_fragments(text: str) -> tuple[str, list[str]]:
    """The text with each molecule replaced by a place holder (``place_holder``) between blanks, and the molecules' inner markup.

    Raises ValueError where a molecule's brackets don't close.
    """
    out, found, at = [], [], 0
    for m in re.finditer(re.escape(MARK) + r"\s*\{", text):
        if m.start() < at:
            continue
        depth, i = 1, m.end()
        while depth and i < len(text):
            depth += (text[i] == "{") - (text[i] == "}")
            i += 1
        if depth:
            raise ValueError("brackets of a molecule don't close")
        out += [text[at : m.start()], " ", place_holder(len(found)), " "]
        found.append(text[m.end() : i - 1])
        at = i
    return "".join([*out, text[at:]]), found


def bond_angle(attr: str | None, last: float, default: float = 0.0) -> float:
    """Angle in degrees of a bond's first attribute: ``:a`` absolute, ``::a`` on top of the last bond's, a bare number times 45."""
    first = (attr or "").split(",")[0].strip()
    if first.startswith("::"):
        return (last + float(first[2:])) % 360
    if first.startswith(":"):
        return float(first[1:]) % 360
    return float(first) * 45 % 360 if first else default % 360


def bond_length(attr: str | None, default: float = 1.0) -> float:
    """Length factor: a bond's second attribute."""
    second = [*(attr or "").split(","), ""][1].strip()
    return float(second) if second else default


def _closed(text: str, at: int) -> int:
    """The place after the curly bracket that closes the one at ``at``."""
    depth = 0
    while at < len(text):
        step = 2 if text[at] == "\\" else 1
        depth += (text[at] == "{") - (text[at] == "}")
        at += step
        if not depth:
            return at
    raise ValueError("a group doesn't close")


class _Level:
    """A branch or ring that is being read: where it began, what bonds in it take by default, and the ring's edges."""

    def __init__(self, at: int, last: float | None, base: str | None, above: _Level | None):
        self.at, self.last, self.base, self.above, self.fresh = at, last, base, above, True
        self.angle, self.length = (above.angle, above.length) if above else (0.0, 1.0)
        self.edges: list[float] = []
        self.done = 0
        self.circle = False
        if base is not None:
            self.angle, self.length = bond_angle(base, last or 0.0, self.angle), bond_length(base, self.length)
        elif above and above.edges:  # a branch at a ring's corner points away from the ring
            n = len(above.edges)
            self.angle = above.edges[above.done % n] + 90 * (n - 2) / n + 180

    def ring(self, n: int, last: float | None) -> list[float]:
        """Angles of the edges of a ring of ``n`` that begins at this level's atom, counterclockwise."""
        if n < 3:
            raise ValueError("a ring of fewer than three edges")
        inner, corner = 180 * (n - 2) / n, self if self.edges else self.above if self.fresh and self.above and self.above.edges else None
        if corner:  # the new ring's last edge lies on the old ring's next one
            m = len(corner.edges)
            level, last_edge = 360 - 180 * (m - 2) / m, corner.edges[corner.done % m] + 180
        elif last is not None:
            level, last_edge = inner / 2 + 180, last - 180 + inner / 2
        else:
            level, last_edge = 270.0, 270.0
        if self.fresh and self.base:
            turn = self.base.split(",")[0].strip()
            if turn.startswith("::"):
                last_edge += float(turn[2:])
            elif turn:
                last_edge = level + bond_angle(self.base, 0.0)
        return [(last_edge - 360 / n * (n - 1 - i)) % 360 for i in range(n)]


def parse_fragment(markup: str) -> tuple[list[dict], list[dict]]:
    """Atoms and bonds of one molecule; raises ValueError for what isn't understood, and for brackets or hooks that don't match.

    Bonds have attributes (angle, length factor); branches and the molecule may
    begin with attributes for all their bonds; ``*n(..)`` is a ring of n edges,
    whose angles are worked out, ``**n(..)`` one with an atom ``\\circle`` in its
    middle; commands and groups in curly brackets belong to an atom's text; a
    hook's first place is linked with each later one.
    """
    text = re.sub(r"\s+", "", markup)
    atoms: list[dict] = []
    bonds: list[dict] = []
    hooks: dict[str, list] = {}
    exact: list[tuple[float, float]] = []
    start = re.match(r"\[([^\]]*)\]", text)
    level = _Level(-1, None, start[1] if start else None, None)
    at, last, where = -1, None, start.end() if start else 0

    def new_atom(x: float, y: float, text: str = "") -> int:
        exact.append((x, y))
        atoms.append({"id": len(atoms), "text": text, "x": round(x, 6) + 0.0, "y": round(y, 6) + 0.0})
        return len(atoms) - 1

    def put_bond(kind: str, angle: float, src: int, dst: int, length: float, hook: str | None = None) -> None:
        bonds.append({"id": len(bonds), "type": kind, "angle": angle, "src": src, "dst": dst, "hook": hook, "length": length})

    def beyond(src: int, angle: float, length: float) -> tuple[float, float]:
        (x, y), turn = exact[src], math.radians(angle)
        return x + length * math.cos(turn), y + length * math.sin(turn)

    while where < len(text):
        m = _TOKEN.match(text, where)
        where = m.end()
        if m["foul"]:
            raise ValueError(f"{m['foul']} out of place")
        if at < 0 and not m["close"]:
            at = level.at = new_atom(0.0, 0.0)
        if m["edges"]:
            inside = _Level(at, last, m["rbase"], level)
            edges = (inside if m["rbase"] else level).ring(int(m["edges"]), last)
            level.fresh, inside.edges, inside.circle = False, edges, bool(m["double"])
            level = inside
        elif m["bond"]:
            length = bond_length(m["attr"], level.length)
            if level.edges:
                if level.done == len(level.edges):
                    raise ValueError("a ring has more bonds than edges")
                last = level.edges[level.done]
                level.done += 1
                to = level.at if level.done == len(level.edges) else new_atom(*beyond(at, last, length))
            else:
                last = bond_angle(m["attr"], last or 0.0, level.angle)
                to = new_atom(*beyond(at, last, length))
            put_bond(m["bond"], last, at, to, length)
            at, level.fresh = to, False
        elif m["open"]:
            level = _Level(at, last, m["base"], level)
        elif m["close"]:
            if not level.above:
                raise ValueError("a branch closes that didn't open")
            if level.circle:
                n = len(level.edges)
                angle, radius = (level.edges[0] + 90 * (n - 2) / n) % 360, 0.5 / math.sin(math.pi / n) * level.length
                put_bond("-:", angle, level.at, new_atom(*beyond(level.at, angle, radius), CIRCLE), radius)
            at, last, level = level.at, level.last, level.above
        elif m["q"]:
            name, kind = m["hook"] or "", (m["kind"] or "").strip("{}")
            if name in hooks:
                src = hooks[name][0]
                hooks[name][1] += 1
                angle = math.degrees(math.atan2(exact[at][1] - exact[src][1], exact[at][0] - exact[src][0])) % 360
                put_bond(NUMBERED.get(kind, kind) or "-", round(angle, 6), src, at, round(math.dist(exact[at], exact[src]), 6), name)
            elif m["kind"]:
                raise ValueError(f"hook {name} ends before it starts")
            else:
                hooks[name] = [at, 0]
        elif m["radius"] is not None:
            atoms[at]["text"] += CIRCLE
        else:
            begin = m.start()
            if m["group"]:
                where = _closed(text, begin)
            while m["command"] and text[where : where + 1] == "{":
                where = _closed(text, where)
            atoms[at]["text"] += text[begin:where]
    if level.above:
        raise ValueError("a branch doesn't close")
    lone = [name for name, (_, ends) in hooks.items() if not ends]
    if lone:
        raise ValueError(f"hook {min(lone)} doesn't end")
    return atoms, bonds


def fragments(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """The keys, frag from 0, name (its place holder), rest (the text with place holders), markup, atoms, bonds, error: a row for each molecule."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, frag int, name string, rest string, markup string, atoms array<{ATOM}>, bonds array<{BOND}>, error string"
    atom = pa.struct([("id", pa.int32()), ("text", pa.string()), ("x", pa.float64()), ("y", pa.float64())])
    bond = pa.struct([("id", pa.int32()), ("type", pa.string()), ("angle", pa.float64()), ("src", pa.int32()), ("dst", pa.int32()), ("hook", pa.string()), ("length", pa.float64())])
    types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(atom), pa.list_(bond), pa.string()]

    def of(text: str | None) -> Iterator[tuple]:
        try:
            rest, found = split_fragments(text or "")
        except ValueError as e:
            yield 0, None, None, text, None, None, str(e)
            return
        for i, markup in enumerate(found):
            try:
                yield i, place_holder(i), rest, markup, *parse_fragment(markup), None
            except ValueError as e:
                yield i, place_holder(i), rest, markup, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, owner = [], []
            for i, text in enumerate(b.column(text_col).to_pylist()):
                made = list(of(text))
                rows += made
                owner += [i] * len(made)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)]
            names = [*keys, "frag", "name", "rest", "markup", "atoms", "bonds", "error"]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(owner, pa.int64())) for k in keys), *columns], names)

    return map_batches(df.select(*dict.fromkeys([*keys, text_col])), run, schema)


def degrees() -> Column:
    """Array of (id, degree): the bonds at each atom."""
    at = lambda a: F.size(F.filter("bonds", lambda b: (b["src"] == a["id"]) | (b["dst"] == a["id"])))
    return F.transform("atoms", lambda a: F.struct(a["id"].alias("id"), at(a).alias("degree")))


def reach(start: Column | None = None) -> Column:
    """Sorted ids of the atoms that bonds lead to from ``start`` (the first atom).

    Each pass over the bonds adds neighbours; as many passes as there are atoms are enough.
    """
    first = F.array(start if start is not None else F.get(F.transform("atoms", lambda a: a["id"]), F.lit(0)))

    def grow(seen: Column, b: Column) -> Column:
        src, dst = F.array_contains(seen, b["src"]), F.array_contains(seen, b["dst"])
        return F.when(src & ~dst, F.concat(seen, F.array(b["dst"]))).when(dst & ~src, F.concat(seen, F.array(b["src"]))).otherwise(seen)

    def again(state: Column, _: Column) -> Column:
        grown = F.aggregate("bonds", state["seen"], grow)
        return F.when(state["before"] == F.size(state["seen"]), state).otherwise(F.struct(F.size(state["seen"]).alias("before"), grown.alias("seen")))

    start_state = F.struct(F.lit(-1).alias("before"), first.alias("seen"))
    return F.array_sort(F.aggregate("atoms", start_state, again)["seen"])


def merged_into(near: float = 0.01, texts_apart: bool = False) -> Column:
    """Array of (id, to): for each atom the first atom, in order, that lies within ``near`` of it (itself where none does).

    With ``texts_apart`` two atoms that both have a text stay apart.
    """
    close = lambda a, b: (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]) < near * near
    fits = lambda a, b: close(a, b) & ((a["id"] == b["id"]) | (a["text"] == "") | (b["text"] == "")) if texts_apart else close(a, b)
    first = lambda a: F.get(F.filter("atoms", lambda b: (b["id"] <= a["id"]) & fits(a, b)), F.lit(0))["id"]
    return F.transform("atoms", lambda a: F.struct(a["id"].alias("id"), first(a).alias("to")))


def merge_atoms(df: DataFrame, near: float = 0.01) -> DataFrame:
    """Molecules whose coincident atoms are one: the first atom stays, with its own text or else the one merged into it; atoms with a text each stay apart.

    Bonds follow their atoms; bonds within one atom go, and of several bonds
    between two atoms the strongest stays.  Atoms keep their ids.
    """
    to = df.withColumn("_to", molecule_map(merged_into(near, texts_apart=True)))
    own = lambda a: F.filter("atoms", lambda b: (F.get("_to", b["id"]) == a["id"]) & (b["text"] != ""))
    kept = F.transform(
        F.filter("atoms", lambda a: F.get("_to", a["id"]) == a["id"]),
        lambda a: a.withField("text", F.when(a["text"] == "", F.coalesce(F.get(own(a), F.lit(0))["text"], F.lit(""))).otherwise(a["text"])),
    )
    moved = F.transform("bonds", lambda b: b.withField("src", F.get("_to", b["src"])).withField("dst", F.get("_to", b["dst"])))
    one = to.withColumns({"atoms": kept, "bonds": moved}).withColumn("bonds", without_self_bonds())
    return one.withColumn("bonds", strongest_bonds()).drop("_to")


def molecule_map(pairs: Column) -> Column:
    """The ``to`` of each atom, at the atom's id (ids count from 0)."""
    return F.transform(pairs, lambda p: p["to"])


def seed_pairs(a: str, b: str, k: int = 4) -> Column:
    """The k pairs of atoms of two molecules' arrays that lie nearest, as (distance, a, b); each molecule is moved so that its least x and y are 0.

    Ties go to the lower ids.
    """
    least = lambda c, f: F.array_min(F.transform(c, lambda t: t[f]))
    at = lambda t, x, y: F.struct(t["id"].alias("id"), (t["x"] - x).alias("x"), (t["y"] - y).alias("y"))
    moved = lambda c: let(least(c, "x"), lambda x: let(least(c, "y"), lambda y: F.transform(c, lambda t: at(t, x, y))))
    far = lambda s, t: F.round(F.sqrt((s["x"] - t["x"]) * (s["x"] - t["x"]) + (s["y"] - t["y"]) * (s["y"] - t["y"])), 4)
    # No more than k pairs of one atom can be among the k nearest.
    own = lambda s, m: F.slice(F.array_sort(F.transform(m, lambda t: F.struct(far(s, t).alias("distance"), s["id"].alias("a"), t["id"].alias("b")))), 1, k)
    pairs = let(moved(b), lambda m: F.flatten(F.transform(moved(a), lambda s: own(s, m))))
    return F.slice(F.array_sort(pairs), 1, k)


def flat_text(within: float = 15.0) -> Column:
    """The text of a molecule that is a straight chain: all bonds lead on to the right, within ``within`` degrees; null for any other."""
    straight = F.forall("bonds", lambda b: b["hook"].isNull() & (b["src"] == b["id"]) & ((b["angle"] <= within) | (b["angle"] >= 360 - within)))
    pieces = F.transform("atoms", lambda a, i: F.concat(F.when(i > 0, F.get("bonds", i - 1)["type"]).otherwise(F.lit("")), a["text"]))
    return F.when(straight, F.array_join(pieces, ""))


def outer_bonds(found: Column) -> Column:
    """Array of (ring, bonds): the bonds with exactly one end in the ring."""
    inside = lambda r, x: F.array_contains(r["atoms"], x)
    of = lambda r: F.transform(F.filter("bonds", lambda b: inside(r, b["src"]) != inside(r, b["dst"])), lambda b: b["id"])
    return F.transform(found, lambda r: F.struct(r["ring"].alias("ring"), of(r).alias("bonds")))


def n_rings() -> Column:
    """Independent rings of a connected molecule: distinct pairs of bonded atoms less atoms plus one."""
    pairs = F.array_distinct(F.transform("bonds", lambda b: F.struct(F.least(b["src"], b["dst"]), F.greatest(b["src"], b["dst"]))))
    return F.size(pairs) - F.size("atoms") + 1


def strongest_bonds() -> Column:
    """One bond for each pair of atoms: by type ``-``, ``=``, ``~``, others, the greatest; the later among equals."""
    score = lambda b: F.when(b["type"] == "-", 0).when(b["type"] == "=", 1).when(b["type"] == "~", 2).otherwise(3) * 100000 + b["id"]
    same = lambda a, b: (F.least(a["src"], a["dst"]) == F.least(b["src"], b["dst"])) & (F.greatest(a["src"], a["dst"]) == F.greatest(b["src"], b["dst"]))
    return F.filter("bonds", lambda b: ~F.exists("bonds", lambda o: same(o, b) & (score(o) > score(b))))


def without_self_bonds() -> Column:
    """The bonds between two different atoms."""
    return F.filter("bonds", lambda b: b["src"] != b["dst"])


def extent() -> Column:
    """Struct of the least and greatest coordinates."""
    x, y = F.transform("atoms", lambda a: a["x"]), F.transform("atoms", lambda a: a["y"])
    return F.struct(F.array_min(x).alias("x0"), F.array_max(x).alias("x1"), F.array_min(y).alias("y0"), F.array_max(y).alias("y1"))


def signature(rounds: int = 6) -> Column:
    """A hash that equal graphs share, whatever the order of atoms: atom texts refined by their neighbours' hashes and bond types.

    Graphs of different hashes differ; equal hashes of different graphs are
    possible for highly regular ones.
    """
    turned = {">": "<", "<": ">", ">:": "<:", "<:": ">:", ">|": "<|", "<|": ">|"}
    back = F.create_map(*[F.lit(x) for pair in turned.items() for x in pair])

    def links(a: Column) -> Column:
        out = F.transform(F.filter("bonds", lambda b: b["src"] == a["id"]), lambda b: F.struct(b["type"].alias("type"), b["dst"].alias("to")))
        into = F.transform(
            F.filter("bonds", lambda b: b["dst"] == a["id"]),
            lambda b: F.struct(F.coalesce(F.element_at(back, b["type"]), b["type"]).alias("type"), b["src"].alias("to")),
        )
        return F.concat(out, into)

    def refined(held: Column, at: Column) -> Column:
        near = lambda around: F.array_sort(F.transform(around, lambda x: F.xxhash64(x["type"], F.get(held, x["to"]))))
        return F.zip_with(held, at, lambda own, around: F.xxhash64(own, near(around)))

    marks = F.transform("atoms", lambda a: F.xxhash64(a["text"]))
    steps = F.sequence(F.lit(1), F.lit(rounds))
    return let(F.transform("atoms", links), lambda at: F.xxhash64(F.array_sort(F.aggregate(steps, marks, lambda held, _: refined(held, at)))))


def rings() -> Column:
    """Array of (ring, atoms): for each hook's closing bond, the atoms of the ring it closes, sorted by id.

    Bonds other than hooks form a tree, in which every atom but the first has
    one bond that leads to it; a ring is what the two ends' ways to the root
    don't share, and the atom where they meet.  A hook that ends on its own
    atom, or doubles a bond, closes no ring.
    """
    tree = F.filter("bonds", lambda b: b["hook"].isNull())
    hooks = F.filter("bonds", lambda b: b["hook"].isNotNull() & (b["src"] != b["dst"]))

    def way(parents: Column, a: Column) -> Column:
        up = lambda path, _: F.when(F.get(parents, F.element_at(path, -1)).isNull(), path).otherwise(F.concat(path, F.array(F.get(parents, F.element_at(path, -1)))))
        return F.aggregate("atoms", F.array(a), up)

    def closed(ways: Column) -> Column:
        a, b = ways["a"], ways["b"]
        return F.array_sort(F.concat(F.array_except(a, b), F.array_except(b, a), F.slice(F.filter(a, lambda x: F.array_contains(b, x)), 1, 1)))

    parents = let(tree, lambda t: F.transform("atoms", lambda x: F.get(F.transform(F.filter(t, lambda b: b["dst"] == x["id"]), lambda b: b["src"]), F.lit(0))))
    found = let(parents, lambda p: F.transform(F.transform(hooks, lambda h: F.struct(way(p, h["src"]).alias("a"), way(p, h["dst"]).alias("b"))), closed))
    whole = let(found, lambda r: F.filter(r, lambda x: F.size(x) > 2))
    return let(whole, lambda r: F.transform(r, lambda x, i: F.struct(i.alias("ring"), x.alias("atoms"))))


def ring_pairs(found: Column) -> Column:
    """Array of (ri, rj, atoms): pairs of a molecule's rings with the atoms they share; rings that share none are left out."""
    pair = lambda a: F.transform(
        F.filter(found, lambda b: (b["ring"] > a["ring"]) & F.arrays_overlap(a["atoms"], b["atoms"])),
        lambda b: F.struct(a["ring"].alias("ri"), b["ring"].alias("rj"), F.array_intersect(a["atoms"], b["atoms"]).alias("atoms")),
    )
    return F.flatten(F.transform(found, pair))


def joined_atoms() -> Column:
    """The atoms that have a bond; all of them in a molecule of one atom."""
    bonded = F.filter("atoms", lambda a: F.exists("bonds", lambda b: (b["src"] == a["id"]) | (b["dst"] == a["id"])))
    return F.when(F.size("atoms") > 1, bonded).otherwise(F.col("atoms"))


def bonds_between(pairs: Column) -> Column:
    """``pairs`` (arrays of two atom ids) with the ids of the bonds between them, in either direction: array of (atoms, bonds)."""
    at = lambda b, x, y: (b["src"] == x) & (b["dst"] == y)
    either = lambda p: F.filter("bonds", lambda b: at(b, p[0], p[1]) | at(b, p[1], p[0]))
    return F.transform(pairs, lambda p: F.struct(p.alias("atoms"), F.transform(either(p), lambda b: b["id"]).alias("bonds")))


def prepared(df: DataFrame) -> DataFrame:
    """Molecules as they are compared: coincident atoms merged, one bond for each pair of atoms, atoms without a bond dropped."""
    return merge_atoms(df).withColumn("atoms", joined_atoms())
