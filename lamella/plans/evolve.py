"""Reading records of one model version with another, as one projection.

Members are matched by wire name. A member whose kind differs, or that the writer doesn't have, reads as not stored;
there is no widening. Nested records, lists and unions are matched in the same way all the way down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.model import Kind, Member, Obj, Struct, Type, Union, Vec, fingerprint, spark_type


class Unreadable(ValueError):
    """The writer's root can't be read as the reader's."""


def _same_shape(a: Type, b: Type) -> bool:
    if a.kind is not b.kind:
        return False
    return not isinstance(a, Struct) or a.shape() == b.shape()


def readable(reader: Type, writer: Type) -> bool:
    """Whether a value of the writer's type can be read at all (its members may still be missing)."""
    if not _same_shape(reader, writer):
        return False
    if isinstance(reader, Vec):
        return reader.optional == writer.optional and readable(reader.element, writer.element)
    return True


def convert(reader: Type, writer: Type, c: Column) -> Column:
    """The writer's value in the reader's wire form; null where it can't be read."""
    if not readable(reader, writer):
        return F.lit(None).cast(spark_type(reader))
    if isinstance(reader, Vec):
        if reader.element.kind in (Kind.OBJECT, Kind.VECTOR, Kind.UNION):
            return F.transform(c, lambda x: convert(reader.element, writer.element, x))
        return c
    if isinstance(reader, Union):
        kinds, out = spark_type(reader), [c["tag"].alias("tag")]
        theirs = {m.name: m for m in writer.members}
        for m in reader.members:
            branch = convert(m, theirs[m.name], c[m.name]) if m.name in theirs else F.lit(None).cast(kinds[m.name].dataType)
            out.append(branch.alias(m.name))
        return F.when(c.isNotNull(), F.struct(*out))
    if isinstance(reader, Obj):
        return F.when(c.isNotNull(), F.struct(*members(reader, writer, lambda m: c[m.name])))
    return c


def members(reader: Obj, writer: Obj, column) -> list[Column]:
    """Reader members in order, each taken from the writer's member of the same wire name. ``column`` maps a writer's
    member to its column."""
    theirs: dict[str, Member] = {m.wire_name: m for m in writer.all_members}
    kinds = spark_type(reader)
    out = []
    for m in reader.all_members:
        if m.name not in kinds.fieldNames():
            continue
        w = theirs.get(m.wire_name)
        value = convert(m.type, w.type, column(w)) if w else F.lit(None).cast(kinds[m.name].dataType)
        if reader.dictionary:
            value = F.coalesce(value, F.array().cast(kinds[m.name].dataType))  # a side that can't be read is empty
        elif m.keep and m.default_value is not None and not isinstance(m.default_value, dict):
            value = F.coalesce(value, F.lit(m.default_value).cast(kinds[m.name].dataType))  # always stored
        out.append(value.alias(m.name))
    return out


def read_as(df: DataFrame, writer: Obj, reader: Obj, *, has_schema: bool = True) -> DataFrame:
    """``df``, whose columns are the writer's members in wire form, as the reader's members. Equal fingerprints read
    directly; different ones need the data to carry its schema."""
    if fingerprint(writer) == fingerprint(reader) and [m.name for m in writer.all_members] == [m.name for m in reader.all_members]:
        return df
    if not has_schema and fingerprint(writer) != fingerprint(reader):
        raise Unreadable("SchemaMismatch")
    return df.select(*members(reader, writer, lambda m: F.col(m.name)))
