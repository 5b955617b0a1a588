"""Deeply nested records as flat tables, by Dewey labels.

Every node of the nested arrays gets its ordinal path (positions from the top,
counted from 0); the parent's path is the path without its last ordinal, and the
depth of the path tells which table a node belongs to.  A null entry is no node
but keeps its position; null and empty arrays hold no nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "-"


def _level_types(kind: T.DataType, child: str) -> list[T.StructType]:
    """Struct types of the levels below an array column, from the top down."""
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
        raise TypeError(f"an array of structs is needed, not {kind.simpleString()}")
    levels = [kind.elementType]
    while child in levels[-1].fieldNames():
        below = levels[-1][child].dataType
        if not isinstance(below, T.ArrayType) or not isinstance(below.elementType, T.StructType):
            break
        levels.append(below.elementType)
    return levels


def _value(node: Column, field: str) -> Column:
    """A field of a node; a dotted name reaches into a struct."""
    return reduce(lambda at, name: at[name], field.split("."), node)


def dewey_nodes(df: DataFrame, array_col: str, fields: dict[str, str], child: str = "sub_areas", keep: list[str] | None = None) -> DataFrame:
    """One row a node: the ``keep`` columns, level, area_path, parent_path and the node's ``fields``.

    ``fields`` gives output names for fields of a node (dotted names reach into
    structs); a level whose type lacks a field gives null.  All levels come out
    of one pass over the input, without a shuffle.
    """
    levels = _level_types(df.schema[array_col].dataType, child)

    def has(kind: T.StructType, field: str) -> T.DataType | None:
        for name in field.split("."):
            if not isinstance(kind, T.StructType) or name not in kind.fieldNames():
                return None
            kind = kind[name].dataType
        return kind

    types = {out: next((t for k in levels if (t := has(k, f)) is not None), T.StringType()) for out, f in fields.items()}

    def label(node: Column, path: Column, depth: int) -> Column:
        values = [
            (_value(node, f) if has(levels[depth], f) is not None else F.lit(None)).cast(types[out]).alias(out)
            for out, f in fields.items()
        ]
        return F.struct(F.lit(depth + 1).alias("level"), path.alias("area_path"), *values)

    def walk(array: Column, above: Column | None, depth: int) -> Column:
        def one(node: Column, i: Column) -> Column:
            path = i.cast("string") if above is None else F.concat(above, F.lit(SEPARATOR), i.cast("string"))
            own = F.array(label(node, path, depth))
            if depth + 1 < len(levels):
                own = F.concat(own, walk(node[child], path, depth + 1))
            return F.when(node.isNotNull(), own)

        nodes = F.filter(F.transform(array, one), lambda x: x.isNotNull())
        empty = F.slice(F.array(label(F.lit(None).cast(levels[depth]), F.lit(""), depth)), 1, 0)
        return F.coalesce(F.flatten(nodes), empty)

    out = df.select(*(keep or []), F.inline(walk(F.col(array_col), None, 0)))
    parent = F.when(F.col("level") == 1, F.lit("")).otherwise(
        F.expr(f"substr(area_path, 1, length(area_path) - length(substring_index(area_path, '{SEPARATOR}', -1)) - 1)")
    )
    return out.select(*(keep or []), "level", "area_path", parent.alias("parent_path"), *fields)


def latest_records(records: DataFrame, columns: list[str]) -> DataFrame:
    """record_id and the columns of each record's last delivery (any one of equal loads, the same on every run)."""
    order = F.struct("loaded_at", F.xxhash64(*columns))
    last = records.groupBy("record_id").agg(F.max_by(F.struct(*columns), order).alias("last"))
    return last.select("record_id", "last.*")


def area_nodes(records: DataFrame) -> DataFrame:
    """All areas of ``records`` once: record_id, level, area_path, parent_path, idx, text, raw_text.

    Of a record delivered again only the last delivery counts, so that areas it no
    longer has are gone; rows with a null record_id count as one record.
    """
    fields = {"idx": "idx", "text": "text", "raw_text": "raw_info.text"}
    return dewey_nodes(latest_records(records, ["sub_areas"]), "sub_areas", fields, keep=["record_id"])


def area_table(records: DataFrame, level: int) -> DataFrame:
    """The flat table of one level: 1 topics, 2 columns, 3 lines."""
    return area_nodes(records).filter(F.col("level") == level).drop("level")


def record_table(records: DataFrame) -> DataFrame:
    """One row a record: record_id, src_image_path, image_path, n_topics (non-null entries of the top level)."""
    n = F.size(F.filter(F.coalesce("sub_areas", F.array()), lambda x: x.isNotNull()))
    last = latest_records(records, ["src_image_path", "image_path", "sub_areas"])
    return last.select("record_id", "src_image_path", "image_path", n.alias("n_topics"))
