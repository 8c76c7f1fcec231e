"""Stored, default and null.

Wire form: a null column means *not stored*. Read form: what a reader returns, with declared defaults filled in.
``has`` looks at the wire form only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamella.model import Kind, Member, Obj, Scalar, Struct, spark_type

FLOATS = (Kind.FLOAT32, Kind.FLOAT64)


def same_bits(a: Column, b: Column) -> Column:
    """Whether two floating-point columns agree bit for bit as far as text shows it: -0.0 and 0.0 differ, NaNs agree."""
    return a.cast("string").eqNullSafe(b.cast("string"))


def elide(value: Column, default: object, *, floating: bool = False) -> Column:
    """The wire form of a value: null where it equals its default (for floats: has its default's bits)."""
    d = F.lit(default)
    if floating:
        return F.when(~same_bits(value, d.cast("double")), value)
    return F.when(value != d, value)


def elide_struct(value: Column, fields: Sequence[str]) -> Column:
    """A struct that is zero in every field isn't stored; -0.0 isn't zero."""
    zero = F.lit(True)
    for f in fields:
        zero = zero & value[f].cast("string").isin("0", "0.0", "false")
    return F.when(~zero, value)


def encode_member(value: Column, m: Member, *, write_defaults: bool = False) -> Column:
    """The wire form of a member: kept members and, with ``write_defaults``, all non-nullable ones are always stored;
    null never is."""
    default = m.default_value
    if default is None:
        return value
    if m.keep or write_defaults:
        return F.coalesce(value, _literal(default, m))
    if isinstance(m.type, Struct):
        return elide_struct(value, [n for n, _ in m.type.fields])
    return elide(value, default, floating=m.type.kind in FLOATS)


def _literal(default: object, m: Member) -> Column:
    kind = spark_type(m.type)
    if isinstance(default, dict):
        return F.struct(*(F.lit(v).cast(kind[n].dataType).alias(n) for n, v in default.items()))
    return F.lit(default).cast(kind)


def restore(wire: Column, m: Member) -> Column:
    """The read form of a member: its declared default where it isn't stored. Nullable members stay null."""
    default = m.default_value
    return wire if default is None else F.coalesce(wire, _literal(default, m))


def encode_record(o: Obj, values: dict[str, Column], *, write_defaults: bool = False) -> Column:
    """A record's wire form from member values; a member without a value isn't stored."""
    fields = [f for f in spark_type(o).fields if f.name in values]
    return F.struct(*(encode_member(values[f.name].cast(f.dataType), o.member(f.name), write_defaults=write_defaults).alias(f.name) for f in fields))


def read_record(o: Obj, wire: Column) -> Column:
    """A record's read form: every member, with defaults. An absent record reads as one whose members are absent."""
    return F.struct(*(restore(wire[f.name], o.member(f.name)).alias(f.name) for f in spark_type(o).fields))


def has(wire: Column) -> Column:
    """Whether a member was stored."""
    return wire.isNotNull()


def has_fixed(parent: Column) -> Column:
    """Whether a member that is always stored is: exactly when its record is there."""
    return parent.isNotNull()


def presence_bits(wire: Sequence[Column]) -> Column:
    """Presence bits packed into a number: bit j is set when column j is stored. At most 63 columns."""
    bits = F.lit(0).cast("bigint")
    for j, c in enumerate(wire):
        bits = bits.bitwiseOR(F.when(c.isNotNull(), F.lit(1 << j).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return bits


def boolean_pair(wire: Column) -> Column:
    """A bool member's two header bits, present first: 0 absent, 1 false, 3 true."""
    return F.when(wire.isNull(), 0).when(wire, 3).otherwise(1)


def is_plain(m: Member) -> bool:
    return isinstance(m.type, Scalar) and not m.type.nullable
