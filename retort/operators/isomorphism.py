"""Exact comparison of molecules: a code that two graphs share if, and only if, they are the same up to the order of atoms.

Atoms are marked by their text and refined by their neighbours' marks and bond
types until nothing more splits.  Where equal marks are left, an atom of the
first such group is set apart, and the least code over the group's atoms counts;
an atom whose way leads to a code already met is the image of another one and
isn't followed further.

Only the code of one molecule is Python, in Arrow batches.  It is worked out where
``signature``, a hash that equal graphs share, leaves a choice.  Defined results:
null atoms or bonds give a null code.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from retort.session import map_batches

#: A directed bond seen from its other end.
TURNED = {">": "<", "<": ">", ">:": "<:", "<:": ">:", ">|": "<|", "<|": ">|"}

Links = list[list[tuple[str, int]]]


def _refined(marks: list[int], links: Links) -> list[int]:
    """Marks split by the neighbours' marks until none splits; numbered in an order that doesn't depend on the atoms' order."""
    n = len(set(marks))
    while True:
        kinds = [(m, tuple(sorted((kind, marks[to]) for kind, to in around))) for m, around in zip(marks, links)]
        place = {k: i for i, k in enumerate(sorted(set(kinds)))}
        marks = [place[k] for k in kinds]
        if len(place) == n:
            return marks
        n = len(place)


def _apart(marks: list[int], atom: int) -> list[int]:
    """The marks with ``atom`` before the others of its mark."""
    return [2 * m + (m == marks[atom] and a != atom) for a, m in enumerate(marks)]


def _tied(marks: list[int]) -> list[int]:
    """The atoms of the lowest mark that several have."""
    groups: dict[int, list[int]] = {}
    for a, m in enumerate(marks):
        groups.setdefault(m, []).append(a)
    return next((groups[m] for m in sorted(groups) if len(groups[m]) > 1), [])


def _code(marks: list[int], texts: list[str], links: Links) -> tuple:
    order = sorted(range(len(marks)), key=marks.__getitem__)
    return tuple((texts[a], tuple(sorted((kind, marks[to]) for kind, to in links[a]))) for a in order)


def _first_way(marks: list[int], texts: list[str], links: Links) -> tuple:
    marks = _refined(marks, links)
    while tied := _tied(marks):
        marks = _refined(_apart(marks, tied[0]), links)
    return _code(marks, texts, links)


def _least(marks: list[int], texts: list[str], links: Links) -> tuple:
    marks = _refined(marks, links)
    tied = _tied(marks)
    if not tied:
        return _code(marks, texts, links)
    found, met = [], set()
    for atom in tied:
        way = _first_way(_apart(marks, atom), texts, links)
        if way not in met:
            met.add(way)
            found.append(_least(_apart(marks, atom), texts, links))
    return min(found)


def canonical_code(atoms: list[dict], bonds: list[dict]) -> tuple:
    """The code of a molecule's graph: texts and typed bonds of the atoms in canonical order; places and angles play no part."""
    number = {a["id"]: i for i, a in enumerate(atoms)}
    texts = [a["text"] for a in atoms]
    links: Links = [[] for _ in atoms]
    for b in bonds:
        src, dst = number[b["src"]], number[b["dst"]]
        links[src].append((b["type"], dst))
        links[dst].append((TURNED.get(b["type"], b["type"]), src))
    place = {t: i for i, t in enumerate(sorted(set(texts)))}
    return _least([place[t] for t in texts], texts, links)


def with_codes(df: DataFrame, codes: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with, for each name of ``codes``, the digest (string) of the code of the molecule in its two columns (atoms, bonds)."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def digest(atoms: list[dict] | None, bonds: list[dict] | None) -> str | None:
        if atoms is None or bonds is None:
            return None
        return hashlib.sha256(repr(canonical_code(atoms, bonds)).encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [pa.array(map(digest, b.column(x).to_pylist(), b.column(y).to_pylist()), pa.string()) for x, y in codes.values()]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *codes])

    return map_batches(df, run, f"{kinds}, " + ", ".join(f"`{n}` string" for n in codes))
