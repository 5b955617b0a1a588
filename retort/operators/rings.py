"""Ring-free sequences of molecules: rings contracted to super-atoms and super-bonds, and expanded again.

Rings are taken one after another, the one with the fewest adjacent rings first,
the leftmost among equals.  A ring that shares a bond with no other becomes a
super-atom; one that shares one bond with one other ring becomes a super-bond in
place of that bond.  What is left is a tree, written from its leftmost atom; the
rings follow, last contracted first, each with the token it expands (``cond``)
and, after the atoms that hold branches, ``\\connbranch`` tokens that name the
branch's bond token (``ring_branch``).

A molecule stays in its row: nothing here shuffles.  Only the walk over one
molecule's atoms is Python, in Arrow batches.

Where rings are entangled (one shares bonds with several rings once all others
are contracted, or several bonds with one, or a bond leads back to its ring), one
of their bonds is cut beforehand and written as a pair of hooks, ``?[a]`` and
``?[a,{type}]``, behind its two atoms.

Defined results: a molecule without bonds is its text; a molecule of several parts
gives a null sequence and says why in ``error``.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from retort.operators.isomorphism import TURNED, with_codes
from retort.operators.molecules import ATOM, BOND, BONDS, without_self_bonds
from retort.session import map_batches

SUPER, BRANCH, END = "\\Superatom", "\\connbranch", "<ea>"
_STEP = re.compile(rf"({'|'.join(map(re.escape, BONDS))})([@#]?)\[:(\d+)\]")
_LINK = re.compile(r"\?\[([^,\]]*)(?:,\{([^}]*)\})?\]")
SEQ = "array<struct<token:string,ring_branch:int,cond:int>>"
_ATOM = pa.list_(pa.struct([("id", pa.int32()), ("text", pa.string()), ("x", pa.float64()), ("y", pa.float64())]))
_BOND = pa.list_(
    pa.struct([("id", pa.int32()), ("type", pa.string()), ("angle", pa.float64()), ("src", pa.int32()), ("dst", pa.int32()), ("hook", pa.string()), ("length", pa.float64())])
)
_SEQ = pa.list_(pa.struct([("token", pa.string()), ("ring_branch", pa.int32()), ("cond", pa.int32())]))


def turned(kind: str) -> str:
    """The bond type seen from the other end; a mark of contraction stays."""
    bare = kind.rstrip("@#")
    return TURNED.get(bare, bare) + kind[len(bare) :]


def coded_angle(angle: float) -> int:
    """The angle in steps of 15 degrees, from 0 to 345."""
    return int((angle % 360 + 7.5) // 15 * 15) % 360


def smallest_rings(bonds: list[dict]) -> list[list[int]]:
    """Independent rings as lists of bond ids: the shortest way around each bond that closes one, shortened by one another."""
    near: dict[int, list[tuple[int, int]]] = {}
    root: dict[int, int] = {}

    def top(a: int) -> int:
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    def link(b: dict) -> None:
        near.setdefault(b["src"], []).append((b["dst"], b["id"]))
        near.setdefault(b["dst"], []).append((b["src"], b["id"]))

    closing = []
    for b in bonds:
        if top(b["src"]) == top(b["dst"]):
            closing.append(b)
        else:
            root[top(b["src"])] = top(b["dst"])
            link(b)
    found: list[frozenset[int]] = []
    for b in closing:
        came, queue = {b["src"]: (-1, -1)}, deque([b["src"]])
        while queue and b["dst"] not in came:
            at = queue.popleft()
            for to, by in near.get(at, ()):
                if to not in came:
                    came[to] = (at, by)
                    queue.append(to)
        ring, at = {b["id"]}, b["dst"]
        while at != b["src"]:
            at, by = came[at]
            ring.add(by)
        link(b)
        found.append(frozenset(ring))
    shorter = True
    while shorter:
        shorter = False
        for i, a in enumerate(found):
            for j, b in enumerate(found):
                if i != j and len(a ^ b) < len(found[i]):
                    found[i], shorter = a ^ b, True
                    a = found[i]
    return [sorted(r) for r in found]


class _Tangled(ValueError):
    """Rings that can't be contracted one by one unless ``bond`` is cut."""

    def __init__(self, bond: int):
        super().__init__("entangled rings")
        self.bond = bond


def link_name(n: int) -> str:
    """a, b, …, z, aa, … for numbers from 0."""
    name = ""
    while n >= 0:
        name, n = chr(97 + n % 26) + name, n // 26 - 1
    return name


class _Graph:
    """Atoms and bonds of one molecule while rings are taken out of it or put back."""

    def __init__(self, atoms: list[dict], bonds: list[dict]):
        self.atoms = {a["id"]: (a["text"], a["x"], a["y"]) for a in atoms}
        self.bonds = {b["id"]: [b["type"], b["src"], b["dst"]] for b in bonds if b["src"] != b["dst"]}

    def around(self, ring: list[int], start: int | None = None) -> tuple[list[int], list[int]]:
        """The ring's atoms and bonds in order, counter-clockwise from ``start`` or else the leftmost, topmost atom."""
        at: dict[int, list[int]] = {}
        for b in ring:
            for end in self.bonds[b][1:]:
                at.setdefault(end, []).append(b)
        if any(len(x) != 2 for x in at.values()):
            raise ValueError("a ring meets itself")
        first = start if start is not None else min(at, key=lambda a: (self.atoms[a][1] * 10000 - self.atoms[a][2], a))
        walks = []
        for by in at[first]:
            atoms, bonds = [first], [by]
            while True:
                _, src, dst = self.bonds[bonds[-1]]
                to = dst if src == atoms[-1] else src
                if to == first:
                    break
                atoms.append(to)
                bonds.append(next(b for b in at[to] if b != bonds[-1]))
            walks.append((atoms, bonds))
        place = [self.atoms[a][1:] for a in walks[0][0]]
        area = sum(x * v - u * y for (x, y), (u, v) in zip(place, [*place[1:], place[0]]))
        return walks[0] if area >= 0 else walks[1]


def contract_rings(g: _Graph, rings: list[list[int]]) -> list[dict]:
    """Takes the rings out of the graph; returns them in that order, each with its walk and the branches on it.

    A step of a walk is (bond, type along the walk, whether the bond itself leads along).
    """
    left, records = dict(enumerate(rings)), []
    new = max(g.atoms, default=0) + 1
    while left:
        shared = {i: [set(r) & set(o) for j, o in left.items() if j != i and set(r) & set(o)] for i, r in left.items()}
        middle = {i: sum(g.atoms[a][1] for b in r for a in g.bonds[b][1:]) / (2 * len(r)) for i, r in left.items()}
        i = min(left, key=lambda r: (len(shared[r]), middle[r], r))
        if len(shared[i]) > 1:
            raise _Tangled(min(set.union(*shared[i])))
        ring, common = left.pop(i), sorted(shared[i][0]) if shared[i] else []
        if len(common) > 1:
            raise _Tangled(common[0])
        if common:
            kind, first, last = g.bonds[common[0]]
            order, path = g.around(ring, first)
            if path[0] == common[0]:  # the other way round ends with the shared bond
                order, path = [order[0], *order[:0:-1]], path[::-1]
            path = path[:-1]
            near = lambda a: first if math.dist(g.atoms[a][1:], g.atoms[first][1:]) <= math.dist(g.atoms[a][1:], g.atoms[last][1:]) else last  # noqa: B023, E731
            to = {a: near(a) for a in order[1:-1]}
            record = {"bond": common[0]}
            g.bonds[common[0]][0] = kind + "@"
        else:
            order, path = g.around(ring)
            g.atoms[new] = (SUPER, *(sum(g.atoms[a][k] for a in order) / len(order) for k in (1, 2)))
            to = dict.fromkeys(order, new)
            record = {"atom": new}
            new += 1
        steps = []
        for n, b in enumerate(path):
            kind, src, _ = g.bonds.pop(b)
            (x, y), (u, v) = g.atoms[order[n]][1:], g.atoms[order[(n + 1) % len(order)]][1:]
            steps.append((b, kind if src == order[n] else turned(kind), src == order[n], math.degrees(math.atan2(v - y, u - x))))
        record |= {"order": order, "steps": steps, "texts": [g.atoms[a][0] for a in order], "branches": {}}
        for b, bond in g.bonds.items():
            for end in (1, 2):
                if bond[end] in to:
                    record["branches"].setdefault(bond[end], []).append(b)
                    bond[end] = to[bond[end]]
            if bond[1] == bond[2] or (common and b != common[0] and {bond[1], bond[2]} == {first, last}):
                raise _Tangled(b)
        for a in to:
            del g.atoms[a]
        records.append(record)
    return records


def walk_tree(g: _Graph) -> tuple[list[tuple], dict[int, list[tuple[int, bool]]]]:
    """(what, id, angle, from) of a connected molecule depth first from its leftmost, topmost atom, bonds by angle, and
    the bonds that close rings, by atom: (bond, whether it opens there)."""
    near: dict[int, list[tuple[float, int, int]]] = {a: [] for a in g.atoms}
    for b, (_, src, dst) in g.bonds.items():
        (x, y), (u, v) = g.atoms[src][1:], g.atoms[dst][1:]
        angle = math.degrees(math.atan2(v - y, u - x)) % 360
        near[src].append((angle, b, dst))
        near[dst].append(((angle + 180) % 360, b, src))
    first = min(g.atoms, key=lambda a: (g.atoms[a][1] * 10000 - g.atoms[a][2], a))
    seen, used, tree, closing, stack = {first}, set(), {}, {}, [(first, iter(sorted(near[first])))]
    while stack:
        at, rest = stack[-1]
        for angle, b, to in rest:
            if b in used:
                continue
            used.add(b)
            if to not in seen:
                seen.add(to)
                tree.setdefault(at, []).append((angle, b, to))
                stack.append((to, iter(sorted(near[to]))))
                break
            closing.setdefault(to, []).append((b, True))
            closing.setdefault(at, []).append((b, False))
        else:
            stack.pop()
    if len(seen) < len(g.atoms):
        raise ValueError("a molecule of several parts")
    out, todo = [], [("atom", first, 0.0, -1)]
    while todo:
        item = todo.pop()
        out.append(item)
        if item[0] == "atom":
            later = tree.get(item[1], [])
            for n, (angle, b, to) in reversed(list(enumerate(later))):
                link = [("atom", to, 0.0, -1), ("bond", b, angle, item[1])]
                todo += link if n == len(later) - 1 else [("branch)", -1, 0.0, -1), *link, ("branch(", -1, 0.0, -1)]
    return out, closing


def write(atoms: list[dict], bonds: list[dict]) -> str:
    """Canonical markup: leftmost atom first, bonds by angle, angles in steps of 15 degrees, hooks named a, b, c, … as they open."""
    g = _Graph(atoms, bonds)
    if not g.atoms:
        return ""
    walk, closing = walk_tree(g)
    out: list[str] = []
    names: dict[int, tuple[str, int]] = {}
    for what, n, angle, at in walk:
        if what == "bond":
            kind, src, _ = g.bonds[n]
            out.append(f"{kind if src == at else turned(kind)}[:{coded_angle(angle)}]")
        elif what == "atom":
            out.append(g.atoms[n][0])
            for b, opens in closing.get(n, ()):
                if opens:
                    name = link_name(len(names))
                    names[b] = (name, n)
                    out.append(f"?[{name}]")
                else:
                    kind, src, _ = g.bonds[b]
                    out.append(f"?[{names[b][0]},{{{kind if src == names[b][1] else turned(kind)}}}]")
        else:
            out.append(what)
    return "".join(out)


def encode(atoms: list[dict], bonds: list[dict]) -> tuple[list[dict], int]:
    """The ring-free sequence, and its number of contracted rings."""
    if not atoms:
        return [], 0
    cut: list[dict] = []
    while True:  # each cut opens a ring
        g = _Graph(atoms, [b for b in bonds if b not in cut])
        try:
            records = contract_rings(g, smallest_rings([{"id": b, "src": s, "dst": t} for b, (_, s, t) in g.bonds.items()]))
            break
        except _Tangled as e:
            cut.append(next(b for b in bonds if b["id"] == e.bond))
    links: dict[int, list[str]] = {}
    for n, b in enumerate(cut):
        links.setdefault(b["src"], []).append(f"?[{link_name(n)}]")
        links.setdefault(b["dst"], []).append(f"?[{link_name(n)},{{{b['type']}}}]")
    walk, closing = walk_tree(g)
    if closing:
        raise ValueError("a ring is left")
    seq: list[dict] = []
    place: dict[tuple[str, int], int] = {}
    along: dict[int, bool] = {}

    def put(token: str, cond: int = -1, branch: int | None = None) -> int:
        if token:
            seq.append({"token": token, "ring_branch": branch, "cond": cond})
        return len(seq) - 1

    for what, n, angle, at in walk:
        if what == "bond":
            kind, src, _ = g.bonds[n]
            along[n] = src == at
            place["bond", n] = put(f"{kind if along[n] else turned(kind)}[:{coded_angle(angle)}]")
        elif what == "atom":
            place["atom", n] = put(g.atoms[n][0])
            for token in links.get(n, ()):
                put(token)
        else:
            put(what)
    for r in reversed(records):
        put(END)
        cond = place["atom", r["atom"]] if "atom" in r else place["bond", r["bond"]]
        order, steps, texts = r["order"], r["steps"], r["texts"]
        if "bond" in r and not along[r["bond"]]:  # the shared bond was written from its end
            order, texts = order[::-1], texts[::-1]
            steps = [(b, turned(kind), not own, angle + 180) for b, kind, own, angle in reversed(steps)]
        for n, a in enumerate(order):
            if "atom" in r or 0 < n < len(order) - 1:
                place["atom", a] = put(texts[n], cond)
                for token in links.get(a, ()):
                    put(token, cond)
                for b in r["branches"].get(a, ()):
                    put(BRANCH, cond, place["bond", b])
            if n < len(steps):
                b, kind, own, angle = steps[n]
                along[b] = own
                place["bond", b] = put(f"{kind}[:{coded_angle(angle)}]", cond)
    return seq, len(records)


def decode(seq: list[dict]) -> tuple[list[dict], list[dict]]:
    """Atoms and bonds of a ring-free sequence; coordinates follow from the angles, with bonds of length one."""
    texts: list[str] = []
    bonds: dict[int, list] = {}
    supers: dict[int, int] = {}
    gone: set[int] = set()
    links: dict[str, dict[str, tuple[int, str]]] = {}

    def new_atom() -> int:
        texts.append("")
        return len(texts) - 1

    def finish(cond: int, at: int, begin: int, branches: list[tuple[int, int]], last: list) -> None:
        if cond < 0:
            return
        gone.add(at)
        if cond in supers:
            ends = (supers[cond],)
            last[2] = begin
            gone.add(supers[cond])
        else:
            ends = tuple(bonds[cond][1:3])
            last[2] = ends[1]
        for a, b in branches:
            hit = [k for k in (1, 2) if bonds[b][k] in ends]
            if not hit:
                raise ValueError("a branch that isn't on its ring")
            bonds[b][hit[0]] = a

    at = begin = -1
    cond, stack, branches, last = -1, [], [], []
    for i, s in enumerate([*seq, {"token": END, "ring_branch": None, "cond": -1}]):
        token, step = s["token"], _STEP.fullmatch(s["token"])
        if token == END:
            finish(cond, at, begin, branches, last)
            if i < len(seq):
                cond, branches = seq[i + 1]["cond"] if i + 1 < len(seq) else -1, []
                if cond not in supers and cond not in bonds:
                    raise ValueError("a ring without its place")
                at = begin = new_atom() if cond in supers else bonds[cond][1]
        elif token == "branch(":
            at = at if at >= 0 else new_atom()
            stack.append(at)
        elif token == "branch)":
            at = stack.pop()
        elif token == BRANCH:
            branches.append((at, s["ring_branch"]))
        else:
            if at < 0:
                at = new_atom()
            link = _LINK.fullmatch(token)
            if link:
                links.setdefault(link[1], {})["start" if link[2] is None else "end"] = (at, link[2])
            elif step:
                to = new_atom()
                last = bonds[i] = [step[1], at, to, int(step[3])]
                at = to
            else:
                texts[at] += token
                if token == SUPER:
                    supers[i] = at
    near: dict[int, list[tuple[int, int]]] = {}
    for kind, src, dst, angle in bonds.values():
        near.setdefault(src, []).append((dst, angle))
        near.setdefault(dst, []).append((src, angle + 180))
    kept = [a for a in range(len(texts)) if a not in gone]
    number = {a: n for n, a in enumerate(kept)}
    where: dict[int, tuple[float, float]] = {}
    for start in kept:
        queue = deque([start] if start not in where else [])
        where.setdefault(start, (0.0, 0.0))
        while queue:
            a = queue.popleft()
            for to, angle in near.get(a, ()):
                if to not in where:
                    where[to] = (where[a][0] + math.cos(math.radians(angle)), where[a][1] + math.sin(math.radians(angle)))
                    queue.append(to)
    atoms = [{"id": number[a], "text": texts[a], "x": round(where[a][0], 6) + 0.0, "y": round(where[a][1], 6) + 0.0} for a in kept]
    made = [
        {"id": n, "type": kind, "angle": float(angle), "src": number[src], "dst": number[dst], "hook": None, "length": 1.0}
        for n, (kind, src, dst, angle) in enumerate(bonds.values())
    ]
    for name, ends in links.items():
        if len(ends) < 2:
            raise ValueError(f"link {name} has one end")
        src, (dst, kind) = ends["start"][0], ends["end"]
        (x, y), (u, v) = where[src], where[dst]
        angle, length = math.degrees(math.atan2(v - y, u - x)) % 360, math.dist(where[src], where[dst])
        made.append({"id": len(made), "type": kind, "angle": round(angle, 6), "src": number[src], "dst": number[dst], "hook": name, "length": round(length, 6)})
    return atoms, made


def _each(df: DataFrame, keep: list[str], inputs: list[str], f: Callable, out: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """``keep`` and the columns ``out`` of ``f``, which gets the inputs of a row; a ValueError, or a null input, gives nulls and ``error``."""
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} {t}" for c, (t, _) in out.items()] + ["error string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for values in zip(*(b.column(c).to_pylist() for c in inputs)):
                try:
                    rows.append((*f(*values), None) if None not in values else (None,) * (len(out) + 1))
                except ValueError as e:
                    rows.append((*(None,) * len(out), str(e)))
            made = zip(*rows) if rows else [[]] * (len(out) + 1)
            arrays = [pa.array(c, t) for c, t in zip(made, [*(t for _, t in out.values()), pa.string()])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *arrays], [*keep, *out, "error"])

    return map_batches(df.select(*dict.fromkeys([*keep, *inputs])), run, ", ".join(kinds))


def contract(df: DataFrame, keys: list[str], before: bool = True) -> DataFrame:
    """The keys, before (the digest of the molecule's graph, if wanted), seq, n_super, error."""
    rows = df.withColumns({"bonds": without_self_bonds()}).select(*keys, "atoms", "bonds")
    if before:
        rows = with_codes(rows, {"before": ("atoms", "bonds")})
    return _each(rows, [*keys, *(["before"] if before else [])], ["atoms", "bonds"], encode, {"seq": (SEQ, _SEQ), "n_super": ("int", pa.int32())})


def expand(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, atoms, bonds, error, from the column ``seq``."""
    return _each(df, keep, ["seq"], decode, {"atoms": (f"array<{ATOM}>", _ATOM), "bonds": (f"array<{BOND}>", _BOND)})


def written(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, canonical (markup of one form for one drawing), error."""
    return _each(df, keys, ["atoms", "bonds"], lambda atoms, bonds: (write(atoms, bonds),), {"canonical": ("string", pa.string())})
